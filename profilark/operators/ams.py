"""Entropy of one or several columns from sampled positions (Chakrabarti, Cormode and McGregor's estimator).

A sample of row positions is drawn by seeded hash; for each, the rows from it on that hold its value
are counted.  The mean of n (f(r) - f(r - 1)), f(r) = r/n log2(n/r), estimates the entropy without bias.
A value that holds more than half of the rows is taken out first and added back in closed form, which
keeps the variance low where the entropy is.  The sample is bounded (``num_samples``), so it is broadcast.

Rows meet only samples of their value in the same stretch of the order, about one each; the stretches after
it are counted whole.  So the cost per row depends neither on the sample nor on how frequent the value is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from profilark.functions.cluster import materialize
from profilark.operators.canon import text
from profilark.operators.contract import by_frame, union
from profilark.operators.entropy import MarginalEntropy, PairwiseEntropy, ThreewayEntropy
from profilark.operators.order import ORD, with_ordinal

MOST_SAMPLES = 1 << 20


def joint_key(df: DataFrame, columns: tuple[str, ...]) -> Column:
    return F.to_json(F.struct(*(text(F.col(f"`{c}`"), df.schema[c].dataType).alias(f"v{i}") for i, c in enumerate(columns))), {"ignoreNullFields": "false"})


def ams_entropy(df: DataFrame, columns: tuple[str, ...], num_samples: int, seed: int = 0) -> DataFrame:
    """``h, n_rows``: the estimated joint entropy of the columns of a (materialised) frame with an ordinal."""
    rows = df.select(ORD, joint_key(df, columns).alias("v"))
    first = rows.agg(F.count("*").alias("n"), F.expr("approx_top_k(v, 1, 256)").alias("t")).first()
    n, top = first["n"], first["t"]
    if not n:
        return rows.agg(F.lit(float("nan")).alias("h"), F.count("*").alias("n_rows"))
    heavy, share = (top[0]["item"], 0.0) if top else (None, 0.0)
    m = n
    if heavy is not None:
        found = rows.where(F.col("v") == heavy).count()  # the sketch only proposes it
        share = found / n
        if share > 0.5:
            m = n - found  # no key is null
    rest = rows.where(F.col("v") != heavy) if share > 0.5 else rows
    if not m:
        return rows.agg(F.lit(0.0).alias("h"), F.count("*").alias("n_rows"))
    samples = min(num_samples, MOST_SAMPLES)
    picked = materialize(rest.orderBy(F.xxhash64(F.lit(seed), ORD)).limit(samples).select(F.col(ORD).alias("at"), "v"), "picked")
    later = rows_from(rest, picked, max(1, n // samples))
    f = lambda r: F.when(r > 0, r / m * F.log2(m / r)).otherwise(0.0)
    r = F.col("r").cast("double")
    h = F.greatest(F.avg(m * (f(r) - f(r - 1))), F.lit(0.0))
    if share > 0.5:
        import math

        p = share
        h = F.lit(p * math.log2(1 / p) + (1 - p) * math.log2(1 / (1 - p))) + (1 - p) * h
    return later.agg(h.alias("h"), F.lit(n).cast("bigint").alias("n_rows"))


def rows_from(rows: DataFrame, picked: DataFrame, stretch: int) -> DataFrame:
    """``at, r``: the rows that hold the value of a picked row, from it on."""
    part = lambda c: F.expr(f"{c} div {stretch}")
    own = picked.withColumn("s", part("at"))
    places = own.groupBy("v", "s").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    met = rows.select(ORD, "v", part(ORD).alias("s")).join(F.broadcast(own.select("v").distinct()), "v", "left_semi").join(F.broadcast(places), ["v", "s"], "left")
    # behind how many of its stretch's places a row lies: before the first it counts for earlier stretches only
    behind = F.coalesce(F.array_size(F.filter("ats", lambda x: x <= F.col(ORD))), F.lit(0))
    counts = met.groupBy("v", "s", behind.alias("k")).agg(F.count("*").alias("n"))
    after = F.sum("n").over(Window.partitionBy("v").orderBy(F.desc("s"), F.desc("k")))
    place = F.row_number().over(Window.partitionBy("v", "s").orderBy("at"))
    return own.withColumn("k", place).join(counts.withColumn("r", after), ["v", "s", "k"]).select("at", "r")


class _Sampled:
    ORDERED = True
    RTOL, ATOL = 0.1, 0.1

    def __init__(self, *, num_samples: int = 4096, seed: int = 0, **options):
        super().__init__(**options)
        if not 1 <= num_samples <= MOST_SAMPLES:
            raise ValueError(f"num_samples: 1 to {MOST_SAMPLES}")
        self.num_samples, self.seed = num_samples, seed

    def _placed(self, combos) -> dict[str, DataFrame]:
        """Each frame's wanted columns, put in order once."""
        out = {}
        for n in dict.fromkeys(n for combo in combos for n, _ in combo):
            columns = list(dict.fromkeys(c for combo in combos for m, c in combo if m == n))
            out[n] = materialize(with_ordinal(self.frames[n].select(*dict.fromkeys([*columns, *self.orders[n]])), self.orders[n]).select(ORD, *(F.col(f"`{c}`") for c in columns)), "placed")
        return out

    def _one(self, df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        return ams_entropy(df, columns, self.num_samples, self.seed)


class MarginalEntropyAms(_Sampled, MarginalEntropy):
    def _compute(self, combos):
        placed = self._placed(combos)
        return union([self._one(placed[n], (c,)).select(F.lit(n).alias("df_a"), F.lit(c).alias("col_a"), "h", "n_rows") for ((n, c),) in combos])


class PairwiseEntropyAms(_Sampled, PairwiseEntropy):
    def _compute(self, combos):
        placed = self._placed(combos)
        rows, spark = [], next(iter(self.frames.values())).sparkSession
        for n, own in by_frame(combos).items():
            single = {c: self._one(placed[n], (c,)).first() for c in {c for k in own for _, c in k}}
            for (_, a), (_, b) in own:
                both = self._one(placed[n], (a, b)).first()
                ha, hb = single[a]["h"], single[b]["h"]
                mi = max(ha + hb - both["h"], 0.0)
                rows.append((n, a, n, b, ha, hb, both["h"], mi, min(mi / min(ha, hb), 1.0) if min(ha, hb) > 0 else float("nan"), both["n_rows"]))
        fields = [T.StructField(k, T.StringType()) for k in self.key_columns()] + [T.StructField(m, t) for m, t in self.METRICS.items()]
        return spark.createDataFrame(rows, T.StructType(fields))


class ThreewayEntropyAms(_Sampled, ThreewayEntropy):
    def _compute(self, combos):
        parts, placed = [], self._placed(combos)
        for combo in combos:
            keys = [x for s, (n, c) in zip("abc", combo) for x in (F.lit(n).alias(f"df_{s}"), F.lit(c).alias(f"col_{s}"))]
            parts.append(self._one(placed[combo[0][0]], tuple(c for _, c in combo)).select(*keys, F.col("h").alias("h_abc"), "n_rows"))
        return union(parts)
