"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilark.functions.cluster import table
from profilark.llm import decontaminate, htmltext, langid, media, mixing
from profilark.llm.licenses import LicenseScan
from profilark.llm.linededup import LineDedup
from profilark.llm.neardup import near_duplicates
from profilark.llm.secrets import SecretScan
from profilark.llm.windowlm import WindowLM


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return LineDedup(percent=80).run(docs.select("doc_id", "text"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SecretScan().run(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return WindowLM().fit(docs).score(docs)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = htmltext.extract(table(spark, sf_dir, "pages"), "page_id", "url")
    return got.select("page_id", "url", F.col("main").alias("text"), F.length("main").cast("long").alias("n_chars"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.Decontaminator(window=10).run(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(marked).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.SourceMix(weights=(1, 2, 3), most=3).plan(table(spark, sf_dir, "documents")).drop("copies")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LicenseScan(percent=80).run(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tagger = langid.LanguageTagger().fit(docs.where(langid.remainder() != 1))
    return tagger.run(docs, "doc_id", F.coalesce(langid.remainder() == 1, F.lit(False)).alias("held_out"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_media_columns, op2_line_dedup, op3_secret_scan, op4_lm_scoring, op5_html_extraction, op6_minhash_near_dedup, op7_benchmark_decontamination, op8_source_mixing, op9_license_scan, op10_language_id)}


def _op7_sql() -> str:
    """Windows of ten words and whole shorter items, joined on their text."""
    alphabet = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = lambda c: f"regexp_extract_all({alphabet.format(c)}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {split("coalesce(text, '')")} AS w FROM documents),
    i AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, {split("text")} AS w FROM benchmark WHERE text IS NOT NULL),
    i2 AS (SELECT item, w, least(len(w), 10) AS n FROM i WHERE len(w) > 0),
    wins AS (SELECT DISTINCT item, n, array_to_string(w[s : s + n - 1], ' ') AS gram FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM i2)),
    sizes AS (SELECT DISTINCT n FROM wins),
    grams AS (SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS gram FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d CROSS JOIN sizes)),
    found AS (SELECT r, s, g.n AS n, item FROM grams g JOIN wins USING (n, gram)),
    hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM found) GROUP BY r),
    its AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
           coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""


_OP8_SQL = """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
    t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT source, source_size, 3 * source_size AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM t),
    l AS (SELECT *, cap / weight AS ratio, (CAST((SELECT sum(source_size) FROM w) AS BIGINT) - CAST(coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
            / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
    g AS (SELECT source, source_size, cap, least(CAST(cap AS DOUBLE), weight * (SELECT arg_min(level, ratio) FROM l WHERE level * weight <= cap)) AS target FROM l),
    p AS (SELECT source, source_size, target, least(CASE WHEN source_size > 0 THEN CAST(round(target / source_size * 16777216) AS BIGINT) ELSE 0 END, 3 * 16777216) AS per,
            CAST('0x' || substr(md5('20:offset:' || coalesce(source, '')), 1, 15) AS BIGINT) % 16777216 AS start FROM g),
    s AS (SELECT d.*, source_size, target, per, start + CAST(sum(per) OVER (PARTITION BY d.source ORDER BY size, CAST('0x' || substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT), doc_id, r) AS BIGINT) AS reach
          FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
    SELECT doc_id, size, source_size, target, CAST((reach // 16777216 - (reach - per) // 16777216) * size AS BIGINT) AS taken FROM s"""


def oracle_sql() -> dict[str, str]:
    return {"op7_benchmark_decontamination": _op7_sql(), "op8_source_mixing": _OP8_SQL, "op9_license_scan": LicenseScan(percent=80).oracle()}
