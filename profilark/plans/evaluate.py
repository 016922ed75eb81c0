"""Scores of recommendations: predictions joined with measurements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from profilark.operators.order import running_sum, with_ordinal
from profilark.plans.storage import pareto


def size_cells(predicted: DataFrame, measured: DataFrame) -> DataFrame:
    """Predicted and measured bytes of each (column, variant) with absolute and relative error."""
    both = predicted.select("column", "variant", F.col("bytes").alias("predicted")).join(measured.select("column", "variant", F.col("bytes").alias("measured")), ["column", "variant"])
    gap = F.col("predicted") - F.col("measured")
    return both.withColumn("error", gap).withColumn("relative_error", gap / F.nullif(F.col("measured"), F.lit(0))).withColumn("exact", gap == 0)


def size_regret(measured: DataFrame, chosen: DataFrame) -> DataFrame:
    """How much larger each column's recommended variant is than its smallest one (ties by name)."""
    rank = F.row_number().over(Window.partitionBy("column").orderBy("bytes", "variant"))
    best = measured.withColumn("r", rank).where("r = 1").select("column", F.col("variant").alias("best"), F.col("bytes").alias("best_bytes"))
    own = chosen.select("column", "variant").join(measured, ["column", "variant"]).join(best, "column")
    return own.select("column", "variant", "bytes", "best", "best_bytes", (F.col("bytes") / F.col("best_bytes") - 1).alias("regret"), (F.col("bytes") == F.col("best_bytes")).alias("hit"))


def measured_choice(measured: DataFrame, baseline: str = "none", least: float = 0.01) -> DataFrame:
    """The smallest variant of each column where it saves this share of the baseline's bytes, else the baseline."""
    base = measured.where(F.col("variant") == baseline).select("column", F.col("bytes").alias("base_bytes"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy("bytes", "variant"))
    best = measured.withColumn("r", rank).where("r = 1").select("column", F.col("variant").alias("best"), F.col("bytes").alias("best_bytes")).join(base, "column", "left")
    worth = F.col("base_bytes").isNull() | (F.col("best_bytes") <= F.col("base_bytes") * (1 - least))
    return best.select("column", F.when(worth, F.col("best")).otherwise(baseline).alias("variant"), F.when(worth, F.col("best_bytes")).otherwise(F.col("base_bytes")).alias("bytes"), "base_bytes")


def type_gain(sizes: DataFrame) -> DataFrame:
    """``column, type, bytes, original_bytes, gain``: what a recommended type saves; rows of column, type, original, bytes."""
    own = sizes.where("not original").select("column", "type", "bytes")
    base = sizes.where("original").select("column", F.col("bytes").alias("original_bytes"))
    return own.join(base, "column").withColumn("gain", 1 - F.col("bytes") / F.nullif(F.col("original_bytes"), F.lit(0)))


def query_cost(samples: DataFrame, rows: int) -> DataFrame:
    """Median seconds of each variant and query, and milliseconds a million rows."""
    got = samples.groupBy("variant", "query").agg(F.count("*").alias("n"), F.median("seconds").alias("seconds"))
    return got.withColumn("ms_per_million", F.col("seconds") * 1e9 / rows)


def skip_queries(blocks: DataFrame, probes: DataFrame, fpr: float = 0.0) -> DataFrame:
    """``column, by_rows, uniform``: predicted skips weighted by the probes' rows, and with every probe alike."""
    weighted = skip_predictions(blocks, probes, fpr).withColumnRenamed("predicted_skip", "by_rows")
    alike = skip_predictions(blocks, probes.withColumn("weight", F.lit(1.0)), fpr).withColumnRenamed("predicted_skip", "uniform")
    return weighted.join(alike, "column")


def skip_regret(predicted: DataFrame, measured: DataFrame) -> DataFrame:
    """How much more the best measured index of each column skips than the recommended one.

    ``predicted``: column, index (the recommended one, null for none).  ``measured``: column, index, skip.
    """
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("skip"), "index"))
    best = measured.withColumn("r", rank).where("r = 1").select("column", F.col("index").alias("best"), F.col("skip").alias("best_skip"))
    own = predicted.select("column", "index").join(measured, ["column", "index"], "left").select("column", "index", F.coalesce("skip", F.lit(0.0)).alias("skip"))
    return own.join(best, "column").withColumn("regret", F.col("best_skip") - F.col("skip")).withColumn("hit", F.col("regret") <= 1e-12)


#: Sections of a score with their fixed columns; others are errors.
SECTIONS = {
    "size_cells": "column string, variant string, predicted double, measured double, error double, relative_error double, exact boolean",
    "size_regret": "column string, variant string, bytes double, best string, best_bytes double, regret double, hit boolean",
    "measured_choice": "column string, variant string, bytes double, base_bytes double",
    "type_gain": "column string, type string, bytes double, original_bytes double, gain double",
    "size_frontier": "column string, variant string, bytes double, seconds double",
    "skip_queries": "column string, by_rows double, uniform double",
    "skip_regret": "column string, index string, skip double, best string, best_skip double, regret double, hit boolean",
    "query_cost": "variant string, query string, n long, seconds double, ms_per_million double",
}


def write_scores(sections: dict[str, DataFrame], folder: str, about: dict[str, str] | None = None) -> list[str]:
    """One Parquet table for each section, of its fixed schema, and one of what the scores are about."""
    from pyspark.sql.types import StructType

    if unknown := set(sections) - set(SECTIONS):
        raise ValueError(f"unknown sections {sorted(unknown)}")
    out = []
    for name, df in sections.items():
        fixed = StructType.fromDDL(SECTIONS[name])
        if missing := [f.name for f in fixed if f.name not in df.columns]:
            raise ValueError(f"{name}: no column {missing}")
        df.select(*(F.col(f.name).cast(f.dataType) for f in fixed)).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")
        out.append(name)
    spark = next(iter(sections.values())).sparkSession if sections else None
    if spark is not None:
        spark.createDataFrame([*sorted({"version": "1", **(about or {})}.items())], "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/about")
    return out


def size_frontier(measured: DataFrame, cost: DataFrame) -> DataFrame:
    """The variants of each column that no other beats in bytes and seconds."""
    return pareto(measured.join(cost, ["column", "variant"]), "column", "bytes", "seconds")


def skip_predictions(blocks: DataFrame, probes: DataFrame, fpr: float = 0.0) -> DataFrame:
    """``column, predicted_skip``: the share of (block, probe) pairs that block extremes would skip, by probe weight.

    ``blocks``: column, lo, hi.  ``probes``: column, value, weight.  Probes and block ends are merged in value
    order, so that no pair is ever made: the blocks that hold v are those with lo <= v less those with hi < v.
    """
    # 0 block begins, 1 probe, 2 block has ended
    marks = blocks.select("column", F.col("lo").alias("v"), F.lit(0).alias("kind"), F.lit(1).alias("step"), F.lit(0.0).alias("weight"))
    marks = marks.unionByName(blocks.select("column", F.col("hi").alias("v"), F.lit(2).alias("kind"), F.lit(-1).alias("step"), F.lit(0.0).alias("weight")))
    marks = marks.unionByName(probes.select("column", F.col("value").alias("v"), F.lit(1).alias("kind"), F.lit(0).alias("step"), F.col("weight").cast("double")))
    # in the order of column, value and kind; equal marks of one kind count alike whatever their order
    placed = with_ordinal(marks, ["column", "v", "kind"], "__o")
    asked = running_sum(placed, "step", "held", ("column",), "__o").where("kind = 1")
    n = blocks.groupBy("column").agg(F.count("*").alias("blocks"))
    return asked.join(n, "column").groupBy("column").agg((F.sum(F.col("weight") * (1 - F.col("held") / F.col("blocks"))) / F.sum("weight") * (1 - fpr)).alias("predicted_skip"))


def query_regret(ratios: DataFrame, tests: int) -> DataFrame:
    """Paired ratios whose interval lies below one: a faster variant exists.

    The intervals must be taken at confidence 1 - 0.05 / ``tests`` (Bonferroni) for this to be resolved.
    """
    return ratios.withColumn("confidence", F.lit(1 - 0.05 / max(1, tests))).withColumn("resolved", F.coalesce(F.col("high") < 1, F.lit(False))).withColumn("gain", 1 - F.col("ratio"))


def summarise(sections: dict[str, DataFrame]) -> DataFrame:
    """Sections of different columns under each other, named by ``section``."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("section", F.lit(name)) for name, df in sections.items()))


def compare(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two runs side by side: rows of either, null keys matched with null keys."""
    a, b = before.select(*(F.col(k).alias(f"a_{k}") for k in keys), F.col(value).alias("before")), after.select(*(F.col(k).alias(f"b_{k}") for k in keys), F.col(value).alias("after"))
    same = reduce(lambda x, y: x & y, (F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys))
    joined = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), same, "full")
    return joined.select(*(F.when(F.col("in_a"), F.col(f"a_{k}")).otherwise(F.col(f"b_{k}")).alias(k) for k in keys), "before", "after", (F.col("after") - F.col("before")).alias("change"))
