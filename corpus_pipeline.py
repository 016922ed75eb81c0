"""The corpus pipeline: raw documents to a deduplicated, decontaminated mix.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)`` and returns the
documents that stay, with the columns of ``documents`` (the last adds ``copy``).  ``run`` applies
them in order and writes each result to the shared folder, so lost executors repeat one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilark.functions.cluster import materialize, small, table
from profilark.llm.columns import fresh, named
from profilark.llm.decontaminate import Decontaminator
from profilark.llm.langid import UNKNOWN, LanguageTagger
from profilark.llm.linededup import LineDedup
from profilark.llm.mixing import SourceMix
from profilark.llm.neardup import NearDuplicates

#: Below this mean posterior no language is credited to a text (even odds between four are 0.25).
LEAST_SCORE = 0.3


def _packed(docs: DataFrame) -> DataFrame:
    """``text``, and all other columns as ``doc``: a worker is sent each text once."""
    return docs.select(F.struct(*(named(c) for c in docs.columns if c != "text")).alias("doc"), "text")


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a recognisable language (null, without letters, or below ``LEAST_SCORE``)."""
    tagged = LanguageTagger().fit(docs).run(_packed(docs), "doc", "text")
    return _unpacked(tagged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines of five words or more that repeat an earlier one; drop documents left without words.

    A shorter line is no evidence of copying.  ``n_chars`` follows the text.
    """
    emptied = fresh("emptied", docs.columns)
    out = LineDedup(percent=80, least_words=5).run(docs, removed_col=None, emptied_col=emptied)
    return out.where(~F.col(emptied)).select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else named(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates (five-word shingles, similarity 0.8): that of the
    smallest id, null ids last.  Rows are numbered, so null and repeated ids lose no text that stands alone."""
    row = fresh("row", docs.columns)
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").cast("long").alias("id"), F.col(row).alias("row"))
    found = NearDuplicates(shingle=5, percent=80).placed(rows.select(key.alias("id"), F.col("text").cast("string").alias("text")))
    gone = materialize(found.where("id != component").select(F.col("id.row").alias(row)), "gone")
    return rows.join(small(gone), row, "left_anti").select(*map(named, docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten consecutive words of a benchmark item (or a whole shorter item)."""
    marked = Decontaminator(window=10, id_col="doc").run(_packed(docs), table(spark, sf_dir, "benchmark"), whole_text=True)
    return _unpacked(marked.where("n_hit = 0"), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources reach their target weights."""
    return SourceMix(weights=(1, 2, 3), most=3).run(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: Line and near-duplicate stages have no practical SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
