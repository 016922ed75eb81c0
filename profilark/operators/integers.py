"""Greatest common divisors and delta statistics of integer-backed columns."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilark.functions.cluster import materialize, ship
from profilark.functions.scalar import entropy, int_bytes
from profilark.operators.canon import INTEGER_BACKED, WIDE, physical
from profilark.operators.contract import Technique, by_frame, union
from profilark.operators.order import ORD, chunk_window, running_sum, with_halo, with_ordinal

D, L = T.DoubleType(), T.LongType()


def physical_stack(df: DataFrame, columns: list[str], *carry: str) -> DataFrame:
    """``carry, col, x``: the non-null physical integers of the columns."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), physical(F.col(f"`{c}`"), df.schema[c].dataType).alias("x")) for c in columns))).alias("p")
    return df.select(*carry, pairs).select(*carry, "p.col", "p.x").where("x is not null")


def gcds(df: DataFrame, columns: list[str]) -> DataFrame:
    """``col, gcd``: each task folds its values to one divisor, and these are folded again."""
    ship(df.sparkSession)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[str, int] = {}
        for pdf in batches:
            for col, x in pdf.groupby("col", sort=False)["x"]:
                own = x.drop_duplicates()
                low, high = int(own.min()), int(own.max())
                if -(1 << 62) < low and high < 1 << 62:
                    g = int(np.gcd.reduce(np.abs(own.astype("int64").to_numpy())))
                else:
                    g = math.gcd(*(int(v) for v in own))
                state[col] = math.gcd(state.get(col, 0), g)
        if state:
            yield pd.DataFrame({"col": list(state), "x": pd.Series([str(v) for v in state.values()])})

    names = df.sparkSession.createDataFrame([(c,) for c in columns], "col string")
    parts = physical_stack(df, columns).mapInPandas(fold, "col string, x string")
    # one divisor per task and column is left: Euclid over their distinct values
    euclid = F.aggregate(
        F.collect_set(F.col("x").cast(WIDE)), F.lit(0).cast(WIDE),
        lambda g, v: F.aggregate(F.sequence(F.lit(1), F.lit(190)), F.struct(g.alias("a"), v.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, F.lit(1).cast(WIDE)).otherwise(s["b"])).cast(WIDE).alias("b"))), lambda s: s["a"]),
    )
    return names.join(parts.groupBy("col").agg(euclid.alias("gcd")), "col", "left").select("col", F.coalesce("gcd", F.lit(0).cast(WIDE)).cast(WIDE).alias("gcd"))


class Gcd(Technique):
    DESCRIPTORS = {"dtype": T.StringType()}
    METRICS = {"gcd": WIDE}
    CONCLUSIONS = {"gcd_compressible": T.BooleanType()}

    def eligible(self, dtype):
        return isinstance(dtype, INTEGER_BACKED)

    def _compute(self, combos):
        return union([gcds(self.frames[n], [c for ((_, c),) in own]).select(F.lit(n).alias("df_a"), F.col("col").alias("col_a"), "gcd") for n, own in by_frame(combos).items()])

    def conclusions(self):
        return {"gcd_compressible": F.col("gcd") > 1}


BOUNDS = [1 << (8 * k - 1) for k in range(1, 9)]


def pairs_inside(counts: DataFrame) -> DataFrame:
    """``col, bound, inside``: ordered pairs of distinct rows whose difference lies in [-b, b).

    The number of rows up to any point is a running sum over values and query points merged in one
    order, so the range join of all pairs becomes a sort.
    """
    steps = F.explode(F.array(*(F.struct(F.lit(k).alias("bound"), F.lit(str(d)).cast(WIDE).alias("shift"), F.lit(s).alias("sign")) for k, b in enumerate(BOUNDS) for d, s in ((b - 1, 1), (-b - 1, -1))))).alias("q")
    points = counts.select("col", F.col("x").alias("key"), F.lit(0).alias("kind"), F.col("cnt").alias("add"), F.lit(0).cast("bigint").alias("ask"), F.lit(-1).alias("bound"), F.lit(0).alias("sign"))
    asks = counts.select("col", "x", "cnt", steps).select("col", (F.col("x") + F.col("q.shift")).cast(WIDE).alias("key"), F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("add"), F.col("cnt").alias("ask"), "q.bound", "q.sign")
    ordered = with_ordinal(points.unionByName(asks), ["col", "key", "kind", "bound", "sign"], "__q")
    summed = running_sum(ordered, "add", "upto", ("col",), "__q")
    inside = summed.where("kind = 1").groupBy("col", "bound").agg(F.sum(F.col("ask").cast(WIDE) * F.col("sign") * F.col("upto").cast("decimal(19,0)")).alias("inside"))
    return inside


class Delta(Technique):
    """Differences of consecutive non-null physical integers in row order, and their random-order baseline."""

    ORDERED = True
    DESCRIPTORS = {"dtype": T.StringType()}
    METRICS = {
        "n_rows": L, "n_non_null": L, "n_deltas": L, "delta_min": WIDE, "delta_max": WIDE, "double_delta_min": WIDE, "double_delta_max": WIDE,
        "value_bytes_mean": D, "delta_bytes_mean": D, "double_delta_bytes_mean": D, "zero_delta_fraction": D, "zero_double_delta_fraction": D,
        "delta_entropy": D, "double_delta_entropy": D, "expected_delta_bytes_mean": D,
    }
    RTOL = 1e-9

    def __init__(self, *, baseline: bool = True):
        super().__init__()
        self.baseline = baseline

    def eligible(self, dtype):
        return isinstance(dtype, INTEGER_BACKED)

    def needs_rows(self):
        return True

    def _compute(self, combos):
        return union([self._frame(n, [c for ((_, c),) in own]) for n, own in by_frame(combos).items()])

    def differences(self, n: str, columns: list[str]) -> DataFrame:
        """``col, x, d, dd`` for every non-null value, in order."""
        df = with_ordinal(self.frames[n].select(*dict.fromkeys([*columns, *self.orders[n]])), self.orders[n])
        long = physical_stack(df, columns, ORD).withColumn("one", F.lit(1))
        placed = running_sum(long, "one", "pos", ("col",), ORD)
        halo = with_halo(placed.withColumn("pos", F.col("pos") - 1), 2, ordinal="pos")
        w = chunk_window("col", ordinal="pos")
        x1, x2 = F.lag("x", 1).over(w), F.lag("x", 2).over(w)
        d = halo.withColumn("d", (F.col("x") - x1).cast(WIDE)).withColumn("dd", (F.col("x") - 2 * x1 + x2).cast(WIDE))
        return d.where("not __halo").select("col", "x", "d", "dd")

    def _frame(self, n, columns):
        df = self.frames[n]
        diffs = materialize(self.differences(n, columns), "deltas")
        nan = F.lit(float("nan"))
        mean = lambda v, alias: F.coalesce(F.avg(int_bytes(F.col(v)).cast("double")), nan).alias(alias)
        zero = lambda v: F.coalesce(F.try_divide(F.count_if(F.col(v) == 0), F.count(v)), nan)
        base = diffs.groupBy("col").agg(
            F.count("*").alias("n_non_null"), F.count("d").alias("n_deltas"), F.min("d").alias("delta_min"), F.max("d").alias("delta_max"), F.min("dd").alias("double_delta_min"), F.max("dd").alias("double_delta_max"),
            mean("x", "value_bytes_mean"), mean("d", "delta_bytes_mean"), mean("dd", "double_delta_bytes_mean"), zero("d").alias("zero_delta_fraction"), zero("dd").alias("zero_double_delta_fraction"),
        )
        out = df.sparkSession.createDataFrame([(c,) for c in columns], "col string").join(base, "col", "left").na.fill(0, ["n_non_null", "n_deltas"]).na.fill(math.nan)
        for v, name in (("d", "delta_entropy"), ("dd", "double_delta_entropy")):
            own = diffs.where(f"{v} is not null").groupBy("col", v).agg(F.count("*").alias("cnt")).groupBy("col").agg(F.greatest(entropy("cnt", "cnt"), F.lit(0.0)).alias(name))
            out = out.join(own, "col", "left").na.fill(math.nan, [name])
        if self.baseline:
            counts = materialize(diffs.groupBy("col", "x").agg(F.count("*").alias("cnt")), "values")
            rows = {r["col"]: [r["n"], r["equal"], {}] for r in counts.groupBy("col").agg(F.sum("cnt").alias("n"), F.sum(F.col("cnt").cast(WIDE) * (F.col("cnt") - 1)).alias("equal")).collect()}
            for r in pairs_inside(counts).collect():  # eight rows a column
                rows[r["col"]][2][r["bound"]] = int(r["inside"])
            means = []
            for col, (m, equal, inside) in rows.items():
                pairs = m * (m - 1)
                # sig = 1 where the difference is not 0, one more for each further bound that it reaches
                total = Fraction(pairs - int(equal), pairs) + sum(Fraction(pairs - (inside[k] - m), pairs) for k in range(8)) if pairs else math.nan
                means.append((col, float(total)))
            out = out.join(df.sparkSession.createDataFrame(means, "col string, expected_delta_bytes_mean double"), "col", "left").na.fill(math.nan, ["expected_delta_bytes_mean"])
        else:
            out = out.withColumn("expected_delta_bytes_mean", nan)
        return out.crossJoin(F.broadcast(df.agg(F.count("*").alias("n_rows")))).select(F.lit(n).alias("df_a"), F.col("col").alias("col_a"), *self.METRICS)
