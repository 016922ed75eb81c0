"""Association of two columns of a frame: chi-squared and the adjusted Rand index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilark.functions.cluster import ship
from profilark.functions.scalar import chi2_tail_udf
from profilark.operators.canon import INTEGERS, WIDE, canonical
from profilark.operators.contract import Technique, at_least, by_frame, union, unit

D, L, B = T.DoubleType(), T.LongType(), T.BooleanType()


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """``a, b, cnt`` of the rows where neither column is null."""
    own = df.select(canonical(F.col(f"`{a}`"), df.schema[a].dataType).alias("a"), canonical(F.col(f"`{b}`"), df.schema[b].dataType).alias("b")).na.drop()
    return own.groupBy("a", "b").agg(F.count("*").alias("cnt"))


def chi_squared(cells: DataFrame) -> DataFrame:
    """``chi2_stat, freedom, cramers_v, low_expected_count, n_valid`` of a contingency table.

    The statistic is n (sum of O^2 / (row total x column total)) - n, so empty cells need no rows.
    """
    rows, cols = (cells.groupBy(c).agg(F.sum("cnt").alias(f"n_{c}")) for c in "ab")
    each = cells.join(rows, "a").join(cols, "b")
    core = each.agg(F.sum(F.col("cnt").cast("double") * F.col("cnt") / (F.col("n_a").cast("double") * F.col("n_b"))).alias("ratio"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_valid"))
    shape = [m.agg(F.count("*").alias(f"k_{c}"), F.min(f"n_{c}").alias(f"least_{c}")) for c, m in (("a", rows), ("b", cols))]
    out = core.crossJoin(F.broadcast(shape[0])).crossJoin(F.broadcast(shape[1]))  # one row each
    nan = F.lit(float("nan"))
    defined = (F.col("k_a") > 1) & (F.col("k_b") > 1)
    stat = F.greatest(F.col("n_valid") * (F.col("ratio") - 1), F.lit(0.0))
    out = out.withColumn("chi2_stat", F.when(defined, stat).otherwise(nan))
    return out.select(
        "chi2_stat",
        F.when(defined, (F.col("k_a") - 1) * (F.col("k_b") - 1)).otherwise(0).cast("double").alias("freedom"),
        F.when(defined, F.sqrt(F.try_divide(F.col("chi2_stat"), F.col("n_valid") * (F.least("k_a", "k_b") - 1)))).otherwise(nan).alias("cramers_v"),
        F.coalesce(defined & (F.try_divide(F.col("least_a") * F.col("least_b"), F.col("n_valid")) < 5), F.lit(False)).alias("low_expected_count"),
        "n_valid",
    )


def adjusted_rand(cells: DataFrame) -> DataFrame:
    """``ari, n_valid``: agreement of two partitions, corrected for chance (one where both are trivial)."""
    choose = lambda c: (F.col(c).cast("decimal(19,0)") * (F.col(c) - 1)).cast(WIDE) / 2
    same = cells.agg(F.coalesce(F.sum(choose("cnt")), F.lit(0)).cast("double").alias("both"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_valid"))
    for c in "ab":
        margin = cells.groupBy(c).agg(F.sum("cnt").alias("m")).agg(F.coalesce(F.sum(choose("m")), F.lit(0)).cast("double").alias(f"in_{c}"))
        same = same.crossJoin(F.broadcast(margin))  # one row
    pairs = F.col("n_valid").cast("double") * (F.col("n_valid") - 1) / 2
    chance = F.coalesce(F.try_divide(F.col("in_a") * F.col("in_b"), pairs), F.lit(0.0))
    top = (F.col("in_a") + F.col("in_b")) / 2
    ari = F.when(F.col("n_valid") == 0, F.lit(float("nan"))).when(top == chance, 1.0).otherwise(F.try_divide(F.col("both") - chance, top - chance))
    return same.select(ari.alias("ari"), "n_valid")


class _Pair(Technique):
    SCOPE, ARITY = "ordered", 2

    def needs_rows(self):
        return True

    def _keyed(self, combos, one):
        parts = []
        for n, own in by_frame(combos).items():
            for (_, a), (_, b) in own:
                keys = (F.lit(x).alias(k) for k, x in zip(self.key_columns(), (n, a, n, b)))
                parts.append(one(contingency(self.frames[n], a, b)).select(*keys, "*"))
        return union(parts)


class ChiSquared(_Pair):
    METRICS = {"chi2_stat": D, "p_value": D, "cramers_v": D, "low_expected_count": B, "n_valid": L}
    CONCLUSIONS = {"associated": B}
    RTOL, ATOL = 1e-4, 1e-12

    def __init__(self, *, cramers_v_threshold: float = 0.3, max_unique: int | None = 1000):
        super().__init__()
        if max_unique is not None and max_unique < 2:
            raise ValueError("max_unique: 2 at least, or None")
        self.threshold, self.max_unique = unit("cramers_v_threshold", cramers_v_threshold), max_unique

    def eligible(self, dtype):
        return isinstance(dtype, (*INTEGERS, T.BooleanType, T.StringType))

    def result(self, combinations=None):
        """Columns of more than ``max_unique`` distinct values are ineligible: counted once per frame."""
        if self.max_unique is None:
            return super().result(combinations)
        wide = set()
        for n, f in self.frames.items():
            own = [c for c in f.columns if self.eligible(f.schema[c].dataType)]
            if own:
                row = f.agg(*(F.count_distinct(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(own)), *(F.max(F.isnull(F.col(f"`{c}`")).cast("int")).alias(f"n{i}") for i, c in enumerate(own))).first()
                wide |= {(n, c) for i, c in enumerate(own) if row[f"c{i}"] + (row[f"n{i}"] or 0) > self.max_unique}
        self._wide = wide
        return super().result(combinations)

    def compatible(self, combo):
        return not any(k in getattr(self, "_wide", ()) for k in combo)

    def _compute(self, combos):
        ship(next(iter(self.frames.values())).sparkSession)
        got = self._keyed(combos, chi_squared)
        tail = F.when(F.isnan("chi2_stat"), F.lit(float("nan"))).otherwise(chi2_tail_udf("chi2_stat", "freedom"))
        return got.withColumn("p_value", tail).drop("freedom")

    def conclusions(self):
        return {"associated": at_least("cramers_v", self.threshold)}


class AdjustedRand(_Pair):
    METRICS = {"ari": D, "n_valid": L}
    CONCLUSIONS = {"same_partition": B}
    RTOL = ATOL = 1e-9

    def __init__(self, *, threshold: float = 0.9):
        super().__init__()
        self.threshold = unit("threshold", threshold)

    def eligible(self, dtype):
        return not isinstance(dtype, (T.MapType, T.NullType, T.StructType, T.ArrayType))

    def _compute(self, combos):
        return self._keyed(combos, adjusted_rand)

    def conclusions(self):
        return {"same_partition": at_least("ari", self.threshold)}
