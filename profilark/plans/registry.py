"""Registered queries over the standard tables, and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilark.functions.cluster import table
from profilark.operators.ams import MarginalEntropyAms
from profilark.operators.cardinality import DistinctCount, PopulationCardinality, TopK
from profilark.operators.describe import Describe
from profilark.operators.entropy import MarginalEntropy, PairwiseEntropy, ThreewayEntropy
from profilark.operators.integers import Delta, Gcd
from profilark.operators.pairs import AdjustedRand, ChiSquared, contingency
from profilark.operators.sequence import MinMaxIndex, RunsTest, SetIndex
from profilark.operators.sets import Membership, Similarity
from profilark.plans import predicates, recommend, storage
from profilark.streaming.profile import StreamingProfiler

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to so many decimals, so that sums in another order compare equal."""
    return df.select(*(F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema))


def results(technique, name: str, df: DataFrame, columns: list[str], *metrics: str, order: list[str] | None = None, digits: int = 9) -> DataFrame:
    """The computed rows of a per-column technique: ``col_a`` and these metrics."""
    technique.add({name: df}, {name: order} if order else None)
    got = technique.result([((name, c),) for c in columns]).where("status = 'computed'")
    return rounded(got.select("col_a", *metrics), digits)


def each(columns: list[str], select: str) -> str:
    return " UNION ALL ".join(select.format(c=c) for c in columns)


FLAGS = ["l_returnflag", "l_linestatus", "l_linenumber"]


@query(each(FLAGS, "SELECT '{c}' AS col_a, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 9) AS h, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY {c})"))
def marginal_entropy(spark, sf_dir):
    return results(MarginalEntropy(), "lineitem", table(spark, sf_dir, "lineitem").select(*FLAGS), FLAGS, "h", "n_rows")


MIXED = ["l_partkey", "l_quantity", "l_returnflag", "l_shipdate"]


@query(each(MIXED, "SELECT '{c}' AS col_a, count({c}) AS n_non_null, CAST(count(DISTINCT {c}) AS DOUBLE) AS n_distinct FROM lineitem"))
def distinct_count(spark, sf_dir):
    return results(DistinctCount(), "lineitem", table(spark, sf_dir, "lineitem").select(*MIXED), MIXED, "n_non_null", "n_distinct")


@query()
def hll_distinct(spark, sf_dir):
    return results(DistinctCount(method="hll", precision=12), "lineitem", table(spark, sf_dir, "lineitem").select(*MIXED), MIXED, "n_non_null", "n_distinct", "low", "high", "std_error", "sketch_bytes")


@query()
def approx_distinct(spark, sf_dir):
    return results(DistinctCount(method="approx"), "lineitem", table(spark, sf_dir, "lineitem").select(*MIXED), MIXED, "n_non_null", "n_distinct")


def _top(df: DataFrame) -> DataFrame:
    return df.select("col_a", "n_non_null", F.posexplode("top_k").alias("rank", "i")).select("col_a", "n_non_null", (F.col("rank") + 1).cast("bigint").alias("rank"), F.col("i.value").alias("value"), F.col("i.count").alias("count"), F.col("i.error").alias("error"))


EVENTS = ["event_type", "user_id"]


@query(each(EVENTS, """SELECT '{c}' AS col_a, n_non_null, rank, value, count, CAST(0 AS BIGINT) AS error FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS count, CAST(sum(count(*)) OVER () AS BIGINT) AS n_non_null,
    row_number() OVER (ORDER BY count(*) DESC, min(event_id)) AS rank FROM events WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 5"""))
def top_k(spark, sf_dir):
    return _top(results(TopK(k=5), "events", table(spark, sf_dir, "events").select("event_id", *EVENTS), EVENTS, "n_non_null", "top_k", order=["event_id"]))


@query()
def space_saving_top_k(spark, sf_dir):
    return _top(results(TopK(k=5, method="space_saving", counters=512), "events", table(spark, sf_dir, "events").select("event_id", *EVENTS), EVENTS, "n_non_null", "top_k", order=["event_id"]))


@query()
def approx_top_k(spark, sf_dir):
    return _top(results(TopK(k=5, method="sketch"), "events", table(spark, sf_dir, "events").select("event_id", *EVENTS), EVENTS, "n_non_null", "top_k", order=["event_id"]))


PRICES = ["l_extendedprice", "l_discount", "l_quantity"]


@query(each(PRICES, """SELECT '{c}' AS col_a, count(*) AS n_rows, count_if({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_unique, CAST(count_if(isnan({c})) AS BIGINT) AS n_nan, CAST(count_if(isinf({c})) AS BIGINT) AS n_inf,
    CAST(count_if(isfinite({c}) AND {c} <> floor({c})) AS BIGINT) AS n_fractional, CAST(count_if(isfinite({c}) AND CAST(CAST({c} AS FLOAT) AS DOUBLE) <> {c}) AS BIGINT) AS n_f32_inexact FROM lineitem"""))
def float_profile(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *PRICES)
    return results(Describe(estimates=False), "lineitem", df, PRICES, "n_rows", "n_null", "n_unique", "n_nan", "n_inf", "n_fractional", "n_f32_inexact", order=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("""SELECT 'text' AS col_a, count(*) AS n_rows, count(DISTINCT text) AS n_unique, CAST(min(octet_length(encode(text))) AS BIGINT) AS min_len, CAST(max(octet_length(encode(text))) AS BIGINT) AS max_len,
    CAST(sum(octet_length(encode(text))) AS BIGINT) AS sum_len, (SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) FROM (SELECT DISTINCT text FROM documents)) AS sum_len_unique FROM documents""")
def length_profile(spark, sf_dir):
    return results(Describe(estimates=False), "documents", table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], "n_rows", "n_unique", "min_len", "max_len", "sum_len", "sum_len_unique", order=["doc_id"])


@query("""SELECT 'key' AS col_a, count(*) AS n_rows, count_if(k SIMILAR TO '-?[0-9]+(\\.[0-9]+)?') AS n_numeric, count_if(k SIMILAR TO '-?[0-9]+') AS n_numeric_int, count_if(k SIMILAR TO '-?0[0-9]+') AS n_leading_zero,
    CAST(min(CASE WHEN k SIMILAR TO '-?[0-9]+' THEN CAST(k AS BIGINT) END) AS DECIMAL(38,0)) AS numeric_int_min, CAST(max(CASE WHEN k SIMILAR TO '-?[0-9]+' THEN CAST(k AS BIGINT) END) AS DECIMAL(38,0)) AS numeric_int_max,
    CAST(max(CASE WHEN k SIMILAR TO '-?[0-9]+' THEN length(ltrim(k, '0')) END) AS INTEGER) AS numeric_max_int_digits
    FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN '00' ELSE '' END || CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '' END AS k FROM orders)""")
def numeric_string_scan(spark, sf_dir):
    key = F.concat(F.when(F.col("o_orderkey") % 7 == 0, "00").otherwise(""), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(""))
    df = table(spark, sf_dir, "orders").select("o_orderkey", key.alias("key"))
    return results(Describe(estimates=False), "orders", df, ["key"], "n_rows", "n_numeric", "n_numeric_int", "n_leading_zero", "numeric_int_min", "numeric_int_max", "numeric_max_int_digits", order=["o_orderkey"])


@query("""SELECT 'stamp' AS col_a, CAST(count_if(k SIMILAR TO '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS BIGINT) AS n_iso_date, CAST(count_if(k SIMILAR TO '[0-9]{2}:[0-9]{2}:[0-9]{2}') AS BIGINT) AS n_iso_time,
    CAST(count_if(k SIMILAR TO '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}') AS BIGINT) AS n_iso_datetime, CAST(count_if(k SIMILAR TO '.*T.*Z') AS BIGINT) AS n_iso_datetime_tz,
    CAST(count_if(k SIMILAR TO '.*[T ]00:00:00Z?') AS BIGINT) AS iso_n_midnight
    FROM (SELECT CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS k FROM events)""")
def iso_string_scan(spark, sf_dir):
    kind, f = F.col("event_id") % 4, lambda p: F.date_format("ts", p)
    stamp = F.when(kind == 0, f("yyyy-MM-dd")).when(kind == 1, f("HH:mm:ss")).when(kind == 2, f("yyyy-MM-dd HH:mm:ss")).otherwise(f("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    df = table(spark, sf_dir, "events").select("event_id", stamp.alias("stamp"))
    return results(Describe(estimates=False), "events", df, ["stamp"], "n_iso_date", "n_iso_time", "n_iso_datetime", "n_iso_datetime_tz", "iso_n_midnight", order=["event_id"])


KEYS = ["o_orderkey", "o_custkey", "big"]


@query(each(["o_orderkey", "o_custkey", "o_orderkey * 360"], "SELECT CASE '{c}' WHEN 'o_orderkey * 360' THEN 'big' ELSE '{c}' END AS col_a, CAST(list_reduce(list(abs({c})), lambda a, b: gcd(a, b)) AS DECIMAL(38,0)) AS gcd, list_reduce(list(abs({c})), lambda a, b: gcd(a, b)) > 1 AS gcd_compressible FROM orders"))
def gcd(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") * 360).alias("big"))
    return results(Gcd(), "orders", df, KEYS, "gcd", "gcd_compressible")


@query("""SELECT 'o_orderpriority' AS col_a, min(o_orderpriority) AS min, max(o_orderpriority) AS max, count(DISTINCT o_orderpriority) AS n_unique, CAST('categorical' AS VARCHAR) AS class FROM orders
    UNION ALL SELECT 'o_orderstatus', min(o_orderstatus), max(o_orderstatus), count(DISTINCT o_orderstatus), CASE count(DISTINCT o_orderstatus) WHEN 1 THEN 'constant' WHEN 2 THEN 'boolean' ELSE 'categorical' END FROM orders
    UNION ALL SELECT 'o_orderkey', CAST(min(o_orderkey) AS VARCHAR), CAST(max(o_orderkey) AS VARCHAR), count(DISTINCT o_orderkey), CASE WHEN max(o_orderkey) <= 2 * count(*) THEN 'ordinal' WHEN count(*) <= 10000 THEN 'categorical' ELSE 'discrete' END FROM orders""")
def classify(spark, sf_dir):
    columns = ["o_orderpriority", "o_orderstatus", "o_orderkey"]
    return results(Describe(), "orders", table(spark, sf_dir, "orders").select(*columns), columns, "min", "max", "n_unique", "class", order=["o_orderkey"])


@query("""WITH c AS (SELECT count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id), s AS (SELECT CAST(sum(n) AS BIGINT) AS n_non_null, count(*) AS n_distinct, count_if(n = 1) AS f1, count_if(n = 2) AS f2 FROM c)
    SELECT 'user_id' AS col_a, n_non_null, n_distinct, CAST(f1 AS BIGINT) AS f1, CAST(f2 AS BIGINT) AS f2, round(n_distinct + f1 * (f1 - 1) / (2.0 * (f2 + 1)), 9) AS chao1 FROM s""")
def population_chao1(spark, sf_dir):
    return results(PopulationCardinality(), "events", table(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"], "n_non_null", "n_distinct", "f1", "f2", "chao1", order=["event_id"])


@query()
def population_cardinality(spark, sf_dir):
    return results(PopulationCardinality(seed=1), "events", table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "n_non_null", "n_distinct", "chao1", "chao1_low", "chao1_high", "schnabel", "schnabel_low", "schnabel_high", order=["event_id"])


@query(each(EVENTS, """SELECT '{c}' AS col_a, n AS n_rows, r AS n_runs, round(1 + (n * n - s2) / n, 9) AS expected_runs, round(((n * (r - 1) - (n * n - s2)) / n) / sqrt((s2 * (s2 + n * (n + 1)) - 2 * n * s3 - n * n * n) / (CAST(n AS DOUBLE) * n * (n - 1))), 9) AS z, round(n / r, 9) AS mean_run_length
    FROM (SELECT count(*) AS n, count_if(first OR {c} IS DISTINCT FROM p) AS r FROM (SELECT {c}, lag({c}) OVER (ORDER BY event_id) AS p, row_number() OVER (ORDER BY event_id) = 1 AS first FROM events)),
    (SELECT CAST(sum(m * m) AS DOUBLE) AS s2, CAST(sum(m * m * m) AS DOUBLE) AS s3 FROM (SELECT count(*) AS m FROM events GROUP BY {c}))"""))
def runs_test(spark, sf_dir):
    return results(RunsTest(), "events", table(spark, sf_dir, "events").select("event_id", *EVENTS), EVENTS, "n_rows", "n_runs", "expected_runs", "z", "mean_run_length", order=["event_id"])


_SIG = "CASE WHEN {v} = 0 THEN 0 " + " ".join(f"WHEN {{v}} >= -{1 << (8 * k - 1)} AND {{v}} < {1 << (8 * k - 1)} THEN {k}" for k in range(1, 9)) + " ELSE 9 END"


def _delta_sql(c: str, x: str) -> str:
    mean = lambda v: f"round(avg({_SIG.format(v=v)}), 9)"
    h = lambda v: f"(SELECT round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 9) FROM (SELECT count(*) AS n FROM d WHERE {v} IS NOT NULL GROUP BY {v}))"
    return f"""SELECT * FROM (WITH b AS (SELECT event_id, CAST({x} AS HUGEINT) AS x FROM events WHERE {c} IS NOT NULL), a AS (SELECT *, x - lag(x) OVER (ORDER BY event_id) AS d FROM b), d AS (SELECT *, d - lag(d) OVER (ORDER BY event_id) AS dd FROM a)
    SELECT '{c}' AS col_a, count(*) AS n_non_null, count(d) AS n_deltas, CAST(min(d) AS DECIMAL(38,0)) AS delta_min, CAST(max(d) AS DECIMAL(38,0)) AS delta_max, CAST(min(dd) AS DECIMAL(38,0)) AS double_delta_min, CAST(max(dd) AS DECIMAL(38,0)) AS double_delta_max,
    {mean("x")} AS value_bytes_mean, round(avg(CASE WHEN d IS NOT NULL THEN {_SIG.format(v="d")} END), 9) AS delta_bytes_mean, round(avg(CASE WHEN dd IS NOT NULL THEN {_SIG.format(v="dd")} END), 9) AS double_delta_bytes_mean,
    round(count_if(d = 0) / count(d), 9) AS zero_delta_fraction, {h("d")} AS delta_entropy, {h("dd")} AS double_delta_entropy FROM d)"""


@query(" UNION ALL ".join(_delta_sql(c, x) for c, x in (("user_id", "user_id"), ("ts", "epoch_us(ts)"))))
def delta(spark, sf_dir):
    metrics = ["n_non_null", "n_deltas", "delta_min", "delta_max", "double_delta_min", "double_delta_max", "value_bytes_mean", "delta_bytes_mean", "double_delta_bytes_mean", "zero_delta_fraction", "delta_entropy", "double_delta_entropy"]
    return results(Delta(baseline=False), "events", table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id", "ts"], *metrics, order=["event_id"])


@query(f"""WITH c AS (SELECT CAST(user_id AS HUGEINT) AS x, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1)
    SELECT 'user_id' AS col_a, round(CAST(sum(CASE WHEN a.x = b.x THEN 0 ELSE a.n * b.n END * ({_SIG.format(v="(b.x - a.x)")})) AS DOUBLE) / ((SELECT sum(n) FROM c) * ((SELECT sum(n) FROM c) - 1)), 9) AS expected_delta_bytes_mean FROM c a CROSS JOIN c b""")
def delta_expected_bytes(spark, sf_dir):
    return results(Delta(), "events", table(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"], "expected_delta_bytes_mean", order=["event_id"])


def _ranked_sql(c: str) -> str:
    return f"""v AS (SELECT {c} AS v, count(*) AS cnt, CAST(row_number() OVER (ORDER BY {c}) - 1 AS BIGINT) AS id, CAST(sum(count(*)) OVER (ORDER BY {c}) - count(*) AS BIGINT) AS below FROM events WHERE {c} IS NOT NULL GROUP BY {c}),
    r AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS o, id, cnt, below FROM events LEFT JOIN v ON {c} = v.v), t AS (SELECT CAST(sum(cnt) AS BIGINT) AS nn, count(*) AS d FROM v)"""


@query(each(EVENTS, "SELECT * FROM (WITH " + _ranked_sql("{c}") + """, w AS (SELECT o, min(id) OVER k AS lo, max(id) OVER k AS hi, min(below) OVER k AS u, max(below + cnt) OVER k AS t FROM r WINDOW k AS (ORDER BY o ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)),
    s AS (SELECT coalesce(nn - (w.t - u), nn) AS rows, coalesce(d - (hi - lo + 1), d) AS vals, nn, d FROM w, t WHERE o >= 63)
    SELECT '{c}' AS col_a, (SELECT count(*) FROM events) AS n_rows, max(nn) AS n_non_null, max(d) AS n_distinct, count(*) AS n_windows, round(avg(rows / nn), 9) AS skip_rows_mean, round(stddev_pop(rows / nn), 9) AS skip_rows_std, round(avg(vals / d), 9) AS skip_values_mean, round(stddev_pop(vals / d), 9) AS skip_values_std FROM s)"""))
def minmax_index(spark, sf_dir):
    return results(MinMaxIndex(index_granularity=64), "events", table(spark, sf_dir, "events").select("event_id", *EVENTS), EVENTS, "n_rows", "n_non_null", "n_distinct", "n_windows", "skip_rows_mean", "skip_rows_std", "skip_values_mean", "skip_values_std", order=["event_id"])


@query(each(EVENTS, "SELECT * FROM (WITH " + _ranked_sql("{c}") + """, p AS (SELECT o, coalesce(id, -1) AS id, coalesce(cnt, 0) AS cnt, lag(o) OVER (PARTITION BY coalesce(id, -1) ORDER BY o) AS prev FROM r), k AS (SELECT count(*) - 63 AS k FROM r),
    i AS (SELECT id, cnt, greatest(o - 63, 0, coalesce(prev + 1, 0)) AS lo, least(o, k - 1) AS hi FROM p, k), e AS (SELECT lo AS pos, 1 AS s, id, cnt FROM i WHERE lo <= hi UNION ALL SELECT hi + 1, -1, id, cnt FROM i WHERE lo <= hi),
    g AS (SELECT pos, sum(CASE WHEN id >= 0 THEN s ELSE 0 END) AS pr, sum(CASE WHEN id >= 0 THEN s * cnt ELSE 0 END) AS ma, sum(CASE WHEN id < 0 THEN s ELSE 0 END) AS nu FROM e GROUP BY pos),
    x AS (SELECT sum(coalesce(pr, 0)) OVER z AS present, sum(coalesce(ma, 0)) OVER z AS mass, sum(coalesce(nu, 0)) OVER z AS nulls FROM r LEFT JOIN g ON o = pos WHERE o < (SELECT k FROM k) WINDOW z AS (ORDER BY o)),
    s AS (SELECT present + CASE WHEN nulls > 0 THEN 1 ELSE 0 END AS entries, present + CASE WHEN nulls > 0 THEN 1 ELSE 0 END > 50 AS over, mass, present, nn, d FROM x, t)
    SELECT '{c}' AS col_a, count(*) AS n_windows, round(avg(CASE WHEN over THEN 0 ELSE nn - mass END / nn), 9) AS skip_rows_mean, round(avg(CASE WHEN over THEN 0 ELSE d - present END / d), 9) AS skip_values_mean,
    round(avg(entries), 9) AS window_distinct_mean, CAST(max(entries) AS BIGINT) AS window_distinct_max, round(avg(CASE WHEN over THEN 1.0 ELSE 0.0 END), 9) AS overflow_fraction FROM s)"""))
def set_index(spark, sf_dir):
    return results(SetIndex(index_granularity=64, max_size=50), "events", table(spark, sf_dir, "events").select("event_id", *EVENTS), EVENTS, "n_windows", "skip_rows_mean", "skip_values_mean", "window_distinct_mean", "window_distinct_max", "overflow_fraction", order=["event_id"])


@query()
def skip_index_baselines(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", *EVENTS)
    low = results(MinMaxIndex(index_granularity=64), "events", df, EVENTS, "expected_skip_rows", "expected_skip_values", order=["event_id"]).withColumn("kind", F.lit("minmax"))
    return low.unionByName(results(SetIndex(index_granularity=64, max_size=50), "events", df, EVENTS, "expected_skip_rows", "expected_skip_values", order=["event_id"]).withColumn("kind", F.lit("set")))


def pair_results(technique, name, df, pairs, *metrics, digits=9):
    technique.add({name: df})
    got = technique.result([tuple((name, c) for c in p) for p in pairs]).where("status = 'computed'")
    return rounded(got.select(*(k for k in technique.key_columns() if k.startswith("col")), *metrics), digits)


PAIRS = [("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber"), ("l_linestatus", "l_linenumber")]


def _pairs_sql(select: str) -> str:
    return " UNION ALL ".join("SELECT * FROM (" + select.format(a=a, b=b) + ")" for a, b in PAIRS)


@query(_pairs_sql("""WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2), r AS (SELECT a, sum(n) AS m FROM c GROUP BY a), k AS (SELECT b, sum(n) AS m FROM c GROUP BY b),
    s AS (SELECT sum(n) AS n, sum(n) * (sum(CAST(n AS DOUBLE) * n / (CAST(r.m AS DOUBLE) * k.m)) - 1) AS x FROM c JOIN r USING (a) JOIN k USING (b))
    SELECT '{a}' AS col_a, '{b}' AS col_b, round(x, 6) AS chi2_stat, round(sqrt(x / (n * (least((SELECT count(*) FROM r), (SELECT count(*) FROM k)) - 1))), 6) AS cramers_v, (SELECT min(m) FROM r) * (SELECT min(m) FROM k) / n < 5 AS low_expected_count, CAST(n AS BIGINT) AS n_valid FROM s"""))
def chi_squared(spark, sf_dir):
    return pair_results(ChiSquared(), "lineitem", table(spark, sf_dir, "lineitem").select(*FLAGS), PAIRS, "chi2_stat", "cramers_v", "low_expected_count", "n_valid", digits=6)


@query("SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS cnt FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2")
def contingency_table(spark, sf_dir):
    return contingency(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query(_pairs_sql("""WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT (SELECT sum(n) FROM c) AS n, (SELECT sum(n * (n - 1) / 2) FROM c) AS t, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY a)) AS x, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY b)) AS y)
    SELECT '{a}' AS col_a, '{b}' AS col_b, round((t - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)), 9) AS ari, CAST(n AS BIGINT) AS n_valid FROM s"""))
def adjusted_rand(spark, sf_dir):
    return pair_results(AdjustedRand(), "lineitem", table(spark, sf_dir, "lineitem").select(*FLAGS), PAIRS, "ari", "n_valid")


_H = "(SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY {g}))"


@query(_pairs_sql(f"""SELECT '{{a}}' AS col_a, '{{b}}' AS col_b, round(h_a, 9) AS h_a, round(h_b, 9) AS h_b, round(h_ab, 9) AS h_ab, round(greatest(h_a + h_b - h_ab, 0), 9) AS mi, round(least(greatest(h_a + h_b - h_ab, 0) / least(h_a, h_b), 1), 9) AS nmi, (SELECT count(*) FROM lineitem) AS n_rows
    FROM (SELECT {_H.format(g="{a}")} AS h_a, {_H.format(g="{b}")} AS h_b, {_H.format(g="{a}, {b}")} AS h_ab)"""))
def pairwise_entropy(spark, sf_dir):
    return pair_results(PairwiseEntropy(), "lineitem", table(spark, sf_dir, "lineitem").select(*FLAGS), PAIRS, "h_a", "h_b", "h_ab", "mi", "nmi", "n_rows")


@query(f"SELECT 'l_returnflag' AS col_a, 'l_linestatus' AS col_b, 'l_linenumber' AS col_c, round({_H.format(g='l_returnflag, l_linestatus, l_linenumber')}, 9) AS h_abc, (SELECT count(*) FROM lineitem) AS n_rows")
def threeway_entropy(spark, sf_dir):
    return pair_results(ThreewayEntropy(), "lineitem", table(spark, sf_dir, "lineitem").select(*FLAGS), [tuple(FLAGS)], "h_abc", "n_rows")


SETS = [(("orders", "o_custkey"), ("customer", "c_custkey")), (("labels", "doc_id"), ("documents", "doc_id")), (("nation", "n_regionkey"), ("region", "r_regionkey")), (("customer", "c_nationkey"), ("supplier", "s_nationkey"))]


def _frames(spark, sf_dir, technique):
    used: dict[str, list[str]] = {}
    for pair in SETS:
        for n, c in pair:
            used.setdefault(n, []).append(c)
    return technique.add({n: table(spark, sf_dir, n).select(*dict.fromkeys(cs)) for n, cs in used.items()})


_BOTH = " UNION ALL ".join(
    f"SELECT '{a}' AS df_a, '{x}' AS col_a, '{b}' AS df_b, '{y}' AS col_b, (SELECT count(DISTINCT {x}) FROM {a}) AS da, (SELECT count(DISTINCT {y}) FROM {b}) AS db, (SELECT count({x}) FROM {a}) AS na, (SELECT count({y}) FROM {b}) AS nb, (SELECT count(DISTINCT {x}) FROM {a} WHERE {x} IN (SELECT {y} FROM {b})) AS s"
    for (a, x), (b, y) in SETS
)


@query(f"""SELECT df_a, col_a, df_b, col_b, round(s / da, 9) AS ratio_a_in_b, round(s / db, 9) AS ratio_b_in_a, da AS n_distinct_a, db AS n_distinct_b, na AS n_non_null_a, nb AS n_non_null_b,
    CASE WHEN s / da >= 0.95 AND s / db >= 0.95 AND da = na AND db = nb THEN 'pk_pk' WHEN s / da >= 0.95 AND db = nb AND da <> na THEN 'fk_pk' WHEN s / db >= 0.95 AND da = na AND db <> nb THEN 'pk_fk' WHEN s / da >= 0.95 AND s / db >= 0.95 THEN 'mutual' WHEN s / da >= 0.95 THEN 'a_in_b' WHEN s / db >= 0.95 THEN 'b_in_a' ELSE 'none' END AS relationship FROM ({_BOTH})""")
def membership(spark, sf_dir):
    got = _frames(spark, sf_dir, Membership()).result(SETS)
    return rounded(got.select("df_a", "col_a", "df_b", "col_b", "ratio_a_in_b", "ratio_b_in_a", "n_distinct_a", "n_distinct_b", "n_non_null_a", "n_non_null_b", "relationship"))


@query()
def membership_bloom(spark, sf_dir):
    got = _frames(spark, sf_dir, Membership(method="bloom")).result(SETS)
    return rounded(got.select("df_a", "col_a", "df_b", "col_b", "ratio_a_in_b", "ratio_b_in_a", "relationship"))


@query(f"SELECT df_a, col_a, df_b, col_b, round(s / (da + db - s), 9) AS jaccard, round(s / least(da, db), 9) AS overlap, s / (da + db - s) >= 0.6 AS passes_jaccard, s / least(da, db) >= 0.95 AS passes_overlap FROM ({_BOTH})")
def similarity(spark, sf_dir):
    got = _frames(spark, sf_dir, Similarity()).result(SETS)
    return rounded(got.select("df_a", "col_a", "df_b", "col_b", "jaccard", "overlap", "passes_jaccard", "passes_overlap"))


@query()
def minhash_similarity(spark, sf_dir):
    got = _frames(spark, sf_dir, Similarity(method="minhash")).result(SETS)
    return rounded(got.select("df_a", "col_a", "df_b", "col_b", "status", "jaccard", "overlap"))


@query("""WITH e AS (SELECT unnest(embedding) AS v FROM embeddings WHERE embedding IS NOT NULL) SELECT 'embedding' AS col_a, (SELECT count(*) FROM embeddings) AS n_rows, (SELECT CAST(min(len(embedding)) AS BIGINT) FROM embeddings) AS min_len, (SELECT CAST(max(len(embedding)) AS BIGINT) FROM embeddings) AS max_len,
    count(*) AS inner_n_values, CAST(count_if(v IS NULL) AS BIGINT) AS inner_n_null, count(DISTINCT v) AS inner_n_unique, CAST(count_if(isfinite(v) AND v <> floor(v)) AS BIGINT) AS inner_n_fractional FROM e""")
def list_inner_profile(spark, sf_dir):
    return results(Describe(estimates=False), "embeddings", table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), ["embedding"], "n_rows", "min_len", "max_len", "inner_n_values", "inner_n_null", "inner_n_unique", "inner_n_fractional", order=["vec_id"])


@query("SELECT count(*) AS n_rows, round(sum(l_extendedprice), 2) AS total FROM lineitem")
def full_scan(spark, sf_dir):
    return rounded(predicates.run(table(spark, sf_dir, "lineitem"), predicates.Query("full_scan", "l_extendedprice")), 2)


@query("""WITH s AS (SELECT o_orderkey AS v, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders), b AS (SELECT min(v) AS lo, max(v) AS hi FROM s WHERE r >= n // 4 AND r < n // 4 + n // 10)
    SELECT count(*) AS n_rows, CAST(sum(o_orderkey) AS DOUBLE) AS total FROM orders, b WHERE o_orderkey BETWEEN lo AND hi""")
def range_filter(spark, sf_dir):
    """A tenth of the rows, from a quarter of the way through the values in order."""
    df = table(spark, sf_dir, "orders")
    return predicates.run(df, predicates.choose_range(df, "o_orderkey", 0.1, start=df.count() // 4))


@query("""WITH c AS (SELECT event_type AS v, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1), p AS (SELECT v FROM c ORDER BY abs(n - (SELECT count(*) FROM events) * 0.2), n DESC, v LIMIT 1)
    SELECT count(*) AS n_rows, CAST(sum(octet_length(encode(event_type))) AS DOUBLE) AS total FROM events WHERE event_type IN (SELECT v FROM p)""")
def in_filter(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return predicates.run(df, predicates.choose_in(df, "event_type", 0.2, 1))


@query("""WITH p AS (SELECT event_type AS k, CAST(event_id % 97 AS BIGINT) AS x, CAST(user_id % 89 AS BIGINT) AS y FROM events)
    SELECT DISTINCT a.k, a.x, a.y FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.k = a.k AND b.x <= a.x AND b.y <= a.y AND (b.x < a.x OR b.y < a.y))""")
def pareto_frontier(spark, sf_dir):
    points = table(spark, sf_dir, "events").select(F.col("event_type").alias("k"), (F.col("event_id") % 97).alias("x"), (F.col("user_id") % 89).alias("y")).distinct()
    return storage.pareto(points, "k", "x", "y")


@query("""WITH s AS (SELECT event_id % 25 AS round, CASE (event_id // 25) % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS variant, 1 + event_id % 7 + (event_id // 25) / 4 AS seconds FROM events WHERE event_id < 75),
    r AS (SELECT v.variant, v.seconds / b.seconds AS r FROM s v JOIN s b ON v.round = b.round AND b.variant = 'a' WHERE v.variant <> 'a'), o AS (SELECT variant, r, row_number() OVER (PARTITION BY variant ORDER BY r) AS k, count(*) OVER (PARTITION BY variant) AS n FROM r)
    SELECT variant, n, round(median(r), 9) AS ratio, round(max(CASE WHEN k = 8 THEN r END), 9) AS low, round(max(CASE WHEN k = 18 THEN r END), 9) AS high FROM o GROUP BY variant, n""")
def paired_ratio_ci(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_id < 75")
    block = F.floor(F.col("event_id") / 25)
    samples = e.select((F.col("event_id") % 25).alias("round"), F.when(block % 3 == 0, "a").when(block % 3 == 1, "b").otherwise("c").alias("variant"), F.lit("q").alias("query"), (1 + F.col("event_id") % 7 + block / 4).alias("seconds"))
    return rounded(storage.paired_ratio(samples, "a").drop("query"))


@query()
def pareto_frontier_whole(spark, sf_dir):
    """The front of the unfolded ids of every event."""
    points = table(spark, sf_dir, "events").select(F.col("event_type").alias("k"), F.col("event_id").alias("x"), F.col("user_id").alias("y")).distinct()
    return storage.pareto(points, "k", "x", "y")


@query()
def paired_ratio_ci_whole(spark, sf_dir):
    """Every event is a sample: three consecutive ids make a round."""
    e = table(spark, sf_dir, "events")
    turn = F.col("event_id") % 3
    samples = e.select(F.expr("event_id div 3").alias("round"), F.when(turn == 0, "a").when(turn == 1, "b").otherwise("c").alias("variant"), F.lit("q").alias("query"), (1 + F.col("event_id") % 7 + turn / 4).alias("seconds"))
    return rounded(storage.paired_ratio(samples, "a").drop("query"))


WHOLE = {"lineitem": ["l_partkey", "l_linenumber"], "customer": ["c_custkey", "c_nationkey"], "labels": ["quality", "toxic"]}
_NARROW = "CASE WHEN lo >= 0 AND hi <= 1 THEN 'bool' " + "".join(f"WHEN lo >= 0 AND hi < {1 << b} THEN 'uint{b}' WHEN lo < 0 AND lo >= -{1 << (b - 1)} AND hi < {1 << (b - 1)} THEN 'int{b}' " for b in (8, 16, 32)) + "WHEN lo >= 0 THEN 'uint64' ELSE 'int64' END"


@query(f"SELECT col_a, lo, hi, {_NARROW} AS type FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS col_a, CAST(min({c}) AS BIGINT) AS lo, CAST(max({c}) AS BIGINT) AS hi FROM {t}" for t, cs in WHOLE.items() for c in cs) + ")")
def narrow_integer(spark, sf_dir):
    """The narrowest integer type of each column, by the recommender's rule on one row of extremes a column."""
    rows = []
    for t, columns in WHOLE.items():
        ends = table(spark, sf_dir, t).agg(*(f(c).cast("bigint").alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max)))).first()
        rows += [(c, ends[f"lo_{c}"], ends[f"hi_{c}"], recommend.integer_type(ends[f"lo_{c}"], ends[f"hi_{c}"])) for c in columns]
    return spark.createDataFrame(rows, "col_a string, lo long, hi long, type string")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_unique, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max FROM events" for c in ("event_id", "user_id", "event_type")))
def stream_profile(spark, sf_dir):
    """A profile merged from three batches in order of arrival."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    cut = events.agg(F.expr("percentile_approx(event_id, array(0.3, 0.7))")).first()[0]
    p = StreamingProfiler(distinct="exact", max_values=1 << 20)
    for part in (events.where(F.col("event_id") <= cut[0]), events.where((F.col("event_id") > cut[0]) & (F.col("event_id") <= cut[1])), events.where(F.col("event_id") > cut[1])):
        p.add(part, ["event_id"])
    return p.result().select("column", "n_rows", "n_null", "n_unique", "min", "max")


@query()
def recommendations(spark, sf_dir):
    """Types, store types and skip indexes of the events' columns."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    rec = recommend.OneShotRecommender(index_granularity=128, skip_granularities=(1, 4), set_max_sizes=(125,)).add(events, ["event_id"])
    return rec.result().select("column", "dtype", "class", "nullable", "type", "store_type", "predicted_bytes", "skip_index")


@query()
def ams_entropy(spark, sf_dir):
    return results(MarginalEntropyAms(), "events", table(spark, sf_dir, "events").select("event_id", *EVENTS), EVENTS, "h", "n_rows", order=["event_id"])


@query("SELECT CAST(event_id // 1000 AS BIGINT) AS block, min(user_id) AS lo, max(user_id) AS hi, count(DISTINCT user_id) AS n_distinct, CAST(count_if(user_id IS NULL) AS BIGINT) AS n_null FROM (SELECT user_id, row_number() OVER (ORDER BY event_id) - 1 AS event_id FROM events) GROUP BY 1")
def block_statistics(spark, sf_dir):
    return recommend.block_statistics(table(spark, sf_dir, "events"), "user_id", ["event_id"], 1000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


from profilark.plans import bounds  # noqa: E402,F401  (registers its queries)
