"""Row order: a dense ordinal, and windows over it that never gather a frame in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from profilark.functions.cluster import materialize

ORD = "__ord"
#: Rows of an ordered chunk: the unit of parallelism of ordered windows.
CHUNK = 1 << 16


def with_ordinal(df: DataFrame, order_by: list[str], name: str = ORD) -> DataFrame:
    """``df`` with 0 .. n-1 in the order of these columns (ties are in no defined order: check uniqueness).

    Rows are range partitioned and sorted once; each partition's count gives the next one its offset, so
    only one row per partition is ever brought together.
    """
    # monotonically_increasing_id is the partition (from bit 33 on) and the place in it
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn("__at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranged").withColumn("__pid", F.expr("shiftright(__at, 33)"))
    counts = ranged.groupBy("__pid").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(counts.select("__pid", F.coalesce(before, F.lit(0)).alias("__before")))
    return ranged.join(offsets, "__pid").withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__pid", "__at", "__before")


def check_unique(df: DataFrame, order_by: list[str]) -> None:
    """Raise where the order columns don't tell all rows apart."""
    if not df.groupBy(*order_by).count().where("count > 1").isEmpty():
        raise ValueError(f"{order_by} does not order the rows: some rows share a value")


def with_halo(df: DataFrame, before: int, keys: tuple[str, ...] = (), ordinal: str = ORD, chunk: int = CHUNK) -> DataFrame:
    """Rows by chunk (``__chunk``), each chunk led by the ``before`` rows that precede it (``__halo``).

    A window partitioned by ``keys`` and ``__chunk`` then sees what one over the whole order would see
    that far back.  Chunks grow with ``before``, so at most twice the rows are made.
    """
    chunk = max(chunk, before)
    own = F.floor(F.col(ordinal) / chunk).cast("long")
    copies = F.array(F.struct(own.alias("c"), F.lit(False).alias("h")))
    if before:
        late = F.col(ordinal) % chunk >= chunk - before
        copies = F.when(late, F.array(F.struct(own.alias("c"), F.lit(False).alias("h")), F.struct((own + 1).alias("c"), F.lit(True).alias("h")))).otherwise(copies)
    return df.withColumn("__copy", F.explode(copies)).withColumn("__chunk", F.col("__copy.c")).withColumn("__halo", F.col("__copy.h")).drop("__copy")


def chunk_window(*keys: str, ordinal: str = ORD):
    return Window.partitionBy(*keys, "__chunk").orderBy(ordinal)


def running_sum(df: DataFrame, value: str | dict[str, str], out: str | None, keys: tuple[str, ...], ordinal: str, chunk: int = CHUNK) -> DataFrame:
    """Cumulative sums along the ordinal within ``keys``: partial sums by chunk, then within chunks.

    ``value`` and ``out`` name one column and its sum, or ``value`` maps several to theirs: one pass for all.
    """
    sums = value if isinstance(value, dict) else {value: out}
    df = df.withColumn("__chunk", F.floor(F.col(ordinal) / chunk).cast("long"))
    totals = df.groupBy(*keys, "__chunk").agg(*(F.sum(v).alias(f"__t{k}") for k, v in enumerate(sums)))
    chunks = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__chunk", *(F.coalesce(F.sum(f"__t{k}").over(chunks), F.lit(0)).alias(f"__e{k}") for k in range(len(sums))))
    inside = Window.partitionBy(*keys, "__chunk").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    df = df.select("*", *(F.sum(v).over(inside).alias(f"__i{k}") for k, v in enumerate(sums))).join(totals, [*keys, "__chunk"])
    for k, name in enumerate(sums.values()):
        df = df.withColumn(name, F.col(f"__e{k}") + F.col(f"__i{k}")).drop(f"__e{k}", f"__i{k}")
    return df.drop("__chunk")


def least_before(df: DataFrame, value: str, out: str, key: str, order: str) -> DataFrame:
    """The smallest ``value`` of the rows of a key with a smaller ``order``: by chunks, so no key meets in one task.

    Each (key, order) stands on one row.
    """
    placed = with_ordinal(df, [key, order], "__o").withColumn("__chunk", F.floor(F.col("__o") / CHUNK).cast("long"))
    parts = placed.groupBy(key, "__chunk").agg(F.min(value).alias("__m"))
    chunks = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(key).alias("__k"), F.col("__chunk").alias("__c"), F.min("__m").over(chunks).alias("__e"))
    inside = F.min(value).over(Window.partitionBy(key, "__chunk").orderBy("__o").rowsBetween(Window.unboundedPreceding, -1))
    joined = placed.withColumn("__i", inside).join(parts, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__chunk") == F.col("__c")))
    return joined.withColumn(out, F.least("__i", "__e")).drop("__o", "__chunk", "__k", "__c", "__i", "__e")
