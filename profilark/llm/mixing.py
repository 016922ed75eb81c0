"""Mixing sources to target weights by systematic sampling.

Sizes are word counts.  Each source's target is its share by weight, stopped at ``most`` times
its own size with the excess reshared (water filling, in closed form over one row per source).
A document's expected copies are target / source size.  Within a source the documents, ordered
by size, then a hash of the id, then the id, then a hash of the row, get the prefix sum of their expected copies plus
one random offset per source, and are emitted once for each integer boundary that the sum
crosses.  Ordering by size makes the words taken miss the target by little more than one
document's words.  Copies never exceed ``most`` rounded up.

Prefix sums are exact (integers of 2^-24 copies) and distributed: the narrow rows are range
partitioned on (source, size, hash, id), so that a source with most of all rows spans many
partitions; partition totals give each its offset.  Only the target table (one row per source)
is ordered in a single task.

Definitions.  A null text has size 0.  Null is a source of its own, ordered last.  Rows that
share an id count separately.  A source of size 0 has target 0.  The same rows and seed give
the same result whatever the partitioning: only rows equal in all columns (maps aside) are
told apart by nothing.  A column named as the added one gets ``_`` behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from profilark.functions.cluster import materialize
from profilark.llm.columns import carried, named

UNIT = 1 << 24
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everyone = Window.partitionBy(F.lit(0))
    nth = F.row_number().over(everyone.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(nth, F.lit(len(weights))) + 1)
    t = totals.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    order = everyone.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    t = t.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    # the first source that its cap does not stop sets the level for all
    t = t.withColumn("level", F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("level").alias("level")))).over(everyone)["level"])
    return t.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _spread(*parts) -> Column:
    """60 bits of an MD5; the same in any SQL engine."""
    text = F.concat_ws(":", *(F.coalesce(F.col(p).cast("string"), F.lit("")) if isinstance(p, str) else p for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


class SourceMix:
    """``plan`` gives the copies of every document; ``run`` the mixed documents themselves."""

    def __init__(self, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 20, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"):
        if most < 1 or not weights or min(weights) < 1:
            raise ValueError("most and weights: at least 1")
        self.weights, self.most, self.seed, self.id_col, self.source_col, self.text_col = weights, most, seed, id_col, source_col, text_col

    def _mark(self, docs: DataFrame) -> Column:
        """A hash of all columns of a row."""
        return F.xxhash64(*(named(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString())).alias("mark")

    def _ranged(self, docs: DataFrame) -> DataFrame:
        text = named(self.text_col).cast("string")
        size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
        rows = docs.select(named(self.id_col).alias("id"), named(self.source_col).cast("string").alias("source"), size.alias("size"), self._mark(docs))
        rows = rows.withColumn("spread", _spread(F.lit(self.seed), "id")).repartitionByRange("source", "size", "spread", "id", "mark")
        return materialize(rows.withColumn("pid", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "ranged")

    def _copies(self, ranged: DataFrame) -> DataFrame:
        goal = materialize(targets(ranged, self.weights, self.most), "targets")
        per = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long")
        goal = goal.withColumn("per", F.least(per, F.lit(self.most * UNIT))).withColumn("start", _spread(F.lit(self.seed), F.lit("offset"), "source") % UNIT)
        rows = ranged.select("row", "pid", "id", "source", "size", "spread", "mark").alias("d").join(goal.alias("g"), F.expr("d.source <=> g.source")).select("d.*", "source_size", "target", "per", "start")
        parts = rows.groupBy("pid", "source").agg(F.sum("per").alias("sum"))
        before = F.sum("sum").over(Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
        parts = parts.select(F.col("pid").alias("p"), F.col("source").alias("s"), F.coalesce(before, F.lit(0)).alias("before"))
        inside = F.sum("per").over(Window.partitionBy("pid", "source").orderBy("size", "spread", "id", "mark", "row").rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("inside", inside).join(parts, F.expr("pid = p and source <=> s"))
        reach = F.col("start") + F.col("before") + F.col("inside")
        return rows.withColumn("copies", F.shiftright(reach, 24) - F.shiftright(reach - F.col("per"), 24))

    def plan(self, docs: DataFrame) -> DataFrame:
        """``id, size, source_size, target, taken, copies`` for every document."""
        rows = self._copies(self._ranged(docs))
        return rows.select(F.col("id").alias(self.id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")

    def run(self, docs: DataFrame, copy_col: str = "copy") -> DataFrame:
        """The mix: the columns of ``docs``, once per copy, with the copy's number in ``copy_col``.

        Texts are shuffled once, by a hash of the row that spreads them evenly (the order by size would
        gather the longest).  Equal rows are told apart by number; which of them gets which copies is all one.
        """
        # equal rows get at most ``most`` + 1 different numbers of copies: so many pairs of (copies, rows)
        shares = self._copies(self._ranged(docs)).groupBy("mark", "copies").agg(F.count("*").alias("rows"))
        shares = shares.groupBy("mark").agg(F.sort_array(F.collect_list(F.struct("copies", "rows"))).alias("shares"))
        kept = docs.select(F.struct(*carried(docs.columns, [copy_col])).alias("kept"), self._mark(docs))
        kept = kept.withColumn("nth", F.row_number().over(Window.partitionBy("mark").orderBy("mark")).cast("bigint")).join(shares, "mark")
        own = F.aggregate(
            "shares", F.struct(F.col("nth").alias("left"), F.lit(-1).cast("bigint").alias("copies")),
            lambda s, x: F.struct((s["left"] - x["rows"]).alias("left"), F.when((s["copies"] < 0) & (s["left"] <= x["rows"]), x["copies"]).otherwise(s["copies"]).alias("copies")), lambda s: s["copies"],
        )
        out = kept.select("kept", own.alias("copies")).where("copies > 0").select("kept", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy"))
        names = out.schema["kept"].dataType.names
        return out.select(*(F.col("kept")[c].alias(c) for c in names), F.col("__copy").alias(copy_col))
