"""Storage trials: Parquet and ORC variants of a column, written, measured and queried in rounds."""

from __future__ import annotations

import itertools
import math
import random
import time
from dataclasses import dataclass

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilark.operators.order import least_before
from profilark.plans import predicates

FORMATS = ("parquet", "orc")
CODECS = {"parquet": ("none", "snappy", "gzip", "zstd", "lz4"), "orc": ("none", "snappy", "zlib", "zstd", "lz4")}
AXES = ("type", "format", "codec", "bloom", "sort", "row_group_mb", "dictionary")


@dataclass(frozen=True)
class Variant:
    type: str
    format: str = "parquet"
    codec: str = "zstd"
    bloom: bool = False
    sort: bool = False
    row_group_mb: int = 128
    dictionary: bool = True

    def problem(self, column_type: str) -> str | None:
        """Why this variant can't be built; None where it can."""
        if self.format not in FORMATS:
            return f"format {self.format} is not written"
        if self.codec not in CODECS[self.format]:
            return f"{self.format} has no codec {self.codec}"
        if self.bloom and self.type in ("double", "float", "boolean"):
            return f"bloom filters of {self.type} are not built"
        if self.type in ("tinyint", "smallint", "int", "bigint") and column_type in ("double", "float", "string", "timestamp"):
            return f"{column_type} values do not all fit {self.type}"
        if self.row_group_mb < 1:
            return "a row group holds one megabyte at least"
        return None


def grid(column_type: str, axes: dict[str, list]) -> tuple[list[Variant], list[tuple[Variant, str]]]:
    """The product of the axes: variants that can be built, and the others with their reasons; none is changed."""
    if unknown := set(axes) - set(AXES):
        raise ValueError(f"unknown axes {sorted(unknown)}")
    good, bad = [], []
    for values in itertools.product(*(axes[a] for a in axes)):
        v = Variant(**{"type": column_type, **dict(zip(axes, values))})
        reason = v.problem(column_type)
        bad.append((v, reason)) if reason else good.append(v)
    return good, bad


def write(df: DataFrame, column: str, v: Variant, path: str) -> str:
    """Write one column as the variant says."""
    own = df.select(F.col(column).cast(v.type).alias("v"))
    if v.sort:
        own = own.repartitionByRange("v").sortWithinPartitions("v")
    w = own.write.mode("overwrite").option("compression", v.codec)
    if v.format == "parquet":
        w = w.option("parquet.enable.dictionary", str(v.dictionary).lower()).option("parquet.block.size", v.row_group_mb << 20)
        if v.bloom:
            w = w.option("parquet.bloom.filter.enabled#v", "true")
        w.parquet(path)
    else:
        if v.bloom:
            w = w.option("orc.bloom.filter.columns", "v")
        w.orc(path)
    return path


def footer_sizes(spark: SparkSession, paths: list[str]) -> tuple[int, int]:
    """(compressed, uncompressed) bytes of the column chunks in these local Parquet files' footers."""
    packed = plain = 0
    for p in paths:
        meta = pq.ParquetFile(p).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                chunk = meta.row_group(g).column(c)
                packed += chunk.total_compressed_size
                plain += chunk.total_uncompressed_size
    return packed, plain


def rounds(frames: dict[str, DataFrame], queries: list[predicates.Query], n: int, seed: int = 0) -> list[tuple[int, str, str, float]]:
    """(round, variant, query id, seconds): after one untimed warm-up, each round runs everything once in shuffled order."""
    for df in frames.values():
        for q in queries:
            predicates.run(df, q).collect()
    out, r = [], random.Random(seed)
    for k in range(n):
        todo = [(name, q) for name in frames for q in queries]
        r.shuffle(todo)
        for name, q in todo:
            began = time.perf_counter()
            predicates.run(frames[name], q).collect()
            out.append((k, name, q.id(), time.perf_counter() - began))
    return out


def median_interval(n: int, confidence: float = 0.95) -> tuple[int, int] | None:
    """Ranks (from 0) of the order statistics that enclose the median; None where n is too small."""
    tail, k, total = (1 - confidence) / 2, 0, 0.0
    if n > 500:  # log-probabilities, from where the tail is still nothing
        k = max(0, n // 2 - math.isqrt(100 * n))
        chance = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2))
        while k < n // 2 and total + (p := chance(k)) <= tail:
            total, k = total + p, k + 1
        return k - 1, n - k
    while k < n // 2 and total + math.comb(n, k) / 2**n <= tail:
        total += math.comb(n, k) / 2**n
        k += 1
    return (k - 1, n - k) if k else None


def paired_ratio(samples: DataFrame, baseline: str, confidence: float = 0.95) -> DataFrame:
    """``variant, query, n, ratio, low, high``: medians of per-round ratios to a baseline, with order-statistic intervals.

    ``samples`` has columns round, variant, query, seconds.
    """
    base = samples.where(F.col("variant") == baseline).select("round", "query", F.col("seconds").alias("base"))
    ratios = samples.where(F.col("variant") != baseline).join(base, ["round", "query"]).withColumn("r", F.col("seconds") / F.col("base"))
    lists = ratios.groupBy("variant", "query").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("r")).alias("r"), F.median("r").alias("ratio"))
    spans = [(r["n"], *span) for r in lists.select("n").distinct().collect() if (span := median_interval(r["n"], confidence))]
    known = F.broadcast(samples.sparkSession.createDataFrame(spans, "n long, lo int, hi int"))
    return lists.join(known, "n", "left").select("variant", "query", "n", "ratio", F.get("r", F.col("lo")).alias("low"), F.get("r", F.col("hi")).alias("high"))


def report(samples: DataFrame, sizes: DataFrame, baseline: str) -> DataFrame:
    """Percentiles, bytes and ratios to the baseline for every variant and query."""
    stats = samples.groupBy("variant", "query").agg(F.count("*").alias("n"), *(F.expr(f"percentile(seconds, {p})").alias(f"p{round(100 * p)}") for p in (0.5, 0.9, 0.99)))
    base = stats.where(F.col("variant") == baseline).select("query", F.col("p50").alias("base_p50"))
    return stats.join(base, "query", "left").withColumn("p50_ratio", F.col("p50") / F.col("base_p50")).drop("base_p50").join(sizes, "variant", "left").withColumn("compression_ratio", F.col("plain_bytes") / F.col("bytes"))


def pareto(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """The points that no other of their key beats in one measure without losing in the other.

    A sweep in order of x, not a comparison of all pairs: a point stays where its y is below that of every
    point with a smaller x (of equal points all stay).
    """
    best = points.groupBy(key, x).agg(F.min(y).alias("__y"))
    front = least_before(best, "__y", "__before", key, x).where("__before is null or __y < __before").select(key, x, F.col("__y").alias(y))
    return points.join(front, [key, x, y], "left_semi")
