"""Entropies of one, two and three columns; null is a category of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilark.functions.scalar import entropy
from profilark.operators.canon import canonical, value_counts
from profilark.operators.contract import Technique, at_least, by_frame, union, unit

D, L = T.DoubleType(), T.LongType()


def marginal(df: DataFrame, columns: list[str]) -> DataFrame:
    """``col, h, n_rows`` for many columns from one grouping of their stacked values."""
    return value_counts(df, columns).groupBy("col").agg(F.greatest(entropy("cnt", "cnt"), F.lit(0.0)).alias("h"), F.sum("cnt").alias("n_rows"))


def joint(df: DataFrame, combos: list[tuple[str, ...]]) -> DataFrame:
    """``nth, h, n_rows`` of several column combinations of one frame."""
    parts = []
    for k, columns in enumerate(combos):
        own = df.select(*(canonical(F.col(f"`{c}`"), df.schema[c].dataType).alias(f"v{i}") for i, c in enumerate(columns)))
        counts = own.groupBy(*own.columns).agg(F.count("*").alias("cnt"))
        parts.append(counts.agg(F.greatest(entropy("cnt", "cnt"), F.lit(0.0)).alias("h"), F.sum("cnt").alias("n_rows")).select(F.lit(k).alias("nth"), "h", "n_rows"))
    return union(parts)


class MarginalEntropy(Technique):
    METRICS = {"h": D, "n_rows": L}
    RTOL, ATOL = 1e-9, 1e-9

    def eligible(self, dtype):
        return not isinstance(dtype, (T.MapType, T.NullType))

    def needs_rows(self):
        return True

    def _compute(self, combos):
        return union([marginal(self.frames[n], [c for ((_, c),) in own]).select(F.lit(n).alias("df_a"), F.col("col").alias("col_a"), "h", "n_rows") for n, own in by_frame(combos).items()])


class _Joint(Technique):
    SCOPE = "ordered"
    RTOL, ATOL = 1e-9, 1e-9

    def __init__(self, *, near_unique_margin: float = 0.1):
        super().__init__()
        self.near_unique_margin = near_unique_margin

    def eligible(self, dtype):
        return not isinstance(dtype, (T.MapType, T.NullType))

    def needs_rows(self):
        return True

    def _near_unique(self, h: str):
        return F.col(h) >= F.log2(F.col("n_rows").cast("double")) - self.near_unique_margin


class PairwiseEntropy(_Joint):
    ARITY = 2
    METRICS = {"h_a": D, "h_b": D, "h_ab": D, "mi": D, "nmi": D, "n_rows": L}
    CONCLUSIONS = {"redundant": T.BooleanType(), "near_unique": T.BooleanType()}

    def __init__(self, *, nmi_threshold: float = 0.9, near_unique_margin: float = 0.1):
        super().__init__(near_unique_margin=near_unique_margin)
        self.nmi_threshold = unit("nmi_threshold", nmi_threshold)

    def _compute(self, combos):
        return union([self._frame(n, own) for n, own in by_frame(combos).items()])

    def _frame(self, n, own):
        df = self.frames[n]
        pairs = [(a, b) for (_, a), (_, b) in own]
        names = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))
        # each marginal once, whatever the number of pairs it is part of
        single = marginal(df, sorted({c for p in pairs for c in p})).select("col", "h")
        both = joint(df, pairs).withColumn("p", F.element_at(names, F.col("nth") + 1)).select(F.lit(n).alias("df_a"), F.col("p.a").alias("col_a"), F.lit(n).alias("df_b"), F.col("p.b").alias("col_b"), F.col("h").alias("h_ab"), "n_rows")
        for s in "ab":
            both = both.join(F.broadcast(single.select(F.col("col").alias(f"col_{s}"), F.col("h").alias(f"h_{s}"))), f"col_{s}")
        low = F.least("h_a", "h_b")
        both = both.withColumn("mi", F.greatest(F.col("h_a") + F.col("h_b") - F.col("h_ab"), F.lit(0.0)))
        return both.withColumn("nmi", F.when(low > 0, F.least(F.try_divide(F.col("mi"), low), F.lit(1.0))).otherwise(F.lit(float("nan"))))

    def conclusions(self):
        return {"redundant": at_least("nmi", self.nmi_threshold), "near_unique": self._near_unique("h_ab")}


class ThreewayEntropy(_Joint):
    ARITY = 3
    METRICS = {"h_abc": D, "n_rows": L}
    CONCLUSIONS = {"near_unique": T.BooleanType()}

    def _compute(self, combos):
        parts = []
        for n, own in by_frame(combos).items():
            names = F.array(*(F.array(*(F.lit(c) for _, c in k)) for k in own))
            got = joint(self.frames[n], [tuple(c for _, c in k) for k in own]).withColumn("p", F.element_at(names, F.col("nth") + 1))
            keys = [x for i, s in enumerate("abc") for x in (F.lit(n).alias(f"df_{s}"), F.element_at("p", i + 1).alias(f"col_{s}"))]
            parts.append(got.select(*keys, F.col("h").alias("h_abc"), "n_rows"))
        return union(parts)

    def conclusions(self):
        return {"near_unique": self._near_unique("h_abc")}
