"""Registered queries that hold estimates to what they promise, and closed forms of what chance would give.

A sketch has no twin in SQL, but its bounds have: each query joins the estimates to exact results and
returns these with whether every bound holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilark.functions.cluster import table
from profilark.functions.scalar import splitmix_subset
from profilark.operators.ams import MarginalEntropyAms, PairwiseEntropyAms, ThreewayEntropyAms
from profilark.operators.cardinality import DistinctCount, PopulationCardinality, TopK
from profilark.operators.describe import Describe
from profilark.operators.entropy import MarginalEntropy, PairwiseEntropy, ThreewayEntropy
from profilark.operators.pairs import ChiSquared
from profilark.operators.sequence import MinMaxIndex, RunsTest, SetIndex
from profilark.operators.sets import Membership, Similarity
from profilark.plans import predicates, recommend
from profilark.plans.registry import _BOTH, _H, EVENTS, FLAGS, MIXED, PAIRS, SETS, _frames, _pairs_sql, each, pair_results, query, results, rounded


def _events(spark, sf_dir, *more: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", *EVENTS, *more)


@query(" UNION ALL ".join(each(MIXED, f"SELECT '{m}' AS method, '{{c}}' AS col_a, count({{c}}) AS n_non_null, count(DISTINCT {{c}}) AS n_distinct, TRUE AS within FROM lineitem") for m in ("hll", "approx")))
def distinct_sketch_bounds(spark, sf_dir):
    """Whether the exact count lies between the sketch's bounds of three standard errors."""
    df = table(spark, sf_dir, "lineitem").select(*MIXED)
    exact = results(DistinctCount(), "lineitem", df, MIXED, "n_distinct").withColumnRenamed("n_distinct", "exact")
    out = None
    for method in ("hll", "approx"):
        got = results(DistinctCount(method=method), "lineitem", df, MIXED, "n_non_null", "low", "high").join(exact, "col_a")
        got = got.select(F.lit(method).alias("method"), "col_a", "n_non_null", F.col("exact").cast("bigint").alias("n_distinct"), F.col("exact").between(F.col("low"), F.col("high")).alias("within"))
        out = got if out is None else out.unionByName(got)
    return out


@query(" UNION ALL ".join(each(EVENTS, f"SELECT '{m}' AS method, '{{c}}' AS col_a, least(5, count(DISTINCT {{c}})) AS n_reported, count({{c}}) AS n_non_null, TRUE AS within, TRUE AS frequent FROM events") for m in ("space_saving", "sketch")))
def top_k_sketch_bounds(spark, sf_dir):
    """Whether each reported count is within its error (n / counters without one), and each value frequent enough."""
    df = table(spark, sf_dir, "events").select("event_id", *EVENTS)
    parts = [df.where(F.col(c).isNotNull()).groupBy(F.lit(c).alias("col_a"), F.col(c).cast("string").alias("value")).agg(F.count("*").alias("true_count")) for c in EVENTS]
    exact = parts[0].unionByName(parts[1])
    out = None
    for method in ("space_saving", "sketch"):
        top = results(TopK(k=5, method=method, counters=512), "events", df, EVENTS, "n_non_null", "top_k", order=["event_id"])
        got = top.select("col_a", "n_non_null", F.explode("top_k").alias("i")).select("col_a", "n_non_null", "i.*").join(exact, ["col_a", "value"])
        room = F.coalesce(F.col("error").cast("double"), F.col("n_non_null") / 512)
        # no value that is left out may be more frequent than a reported one by more than the room
        fifth = exact.groupBy("col_a").agg(F.sort_array(F.collect_list("true_count"), asc=False).alias("all")).select("col_a", F.try_element_at("all", F.least(F.size("all"), F.lit(5))).alias("fifth"))
        got = got.join(fifth, "col_a").groupBy("col_a").agg(
            F.count("*").alias("n_reported"), F.max("n_non_null").alias("n_non_null"), F.every((F.col("count") - F.col("true_count")).between(-room, room)).alias("within"), F.every(F.col("true_count") >= F.col("fifth") - 2 * room).alias("frequent"),
        )
        got = got.select(F.lit(method).alias("method"), "*")
        out = got if out is None else out.unionByName(got)
    return out


_MIX = "CAST(xor({z}, {z} >> {s}) AS UHUGEINT) * {m} % 18446744073709551616"
_Z1 = "CAST((CAST(r AS UHUGEINT) + {seed} + 11400714819323198485) % 18446744073709551616 AS UBIGINT)"


def _subset_sql(seed: int, rows: str, parts: int = 3) -> str:
    """SQL of ``rows`` (with ``r``) and the subset of each row by SplitMix64."""
    a = f"SELECT *, {_Z1.format(seed=seed)} AS z1 FROM ({rows})"
    b = f"SELECT *, CAST({_MIX.format(z='z1', s=30, m='13787848793156543929')} AS UBIGINT) AS z2 FROM ({a})"
    c = f"SELECT *, CAST({_MIX.format(z='z2', s=27, m='10723151780598845931')} AS UBIGINT) AS z3 FROM ({b})"
    return f"SELECT *, CAST(xor(z3, z3 >> 31) % {parts} AS INTEGER) AS part FROM ({c})"


@query(f"SELECT part, count(*) AS n_rows, min(r) AS first_row FROM ({_subset_sql(7, 'SELECT row_number() OVER (ORDER BY event_id) - 1 AS r FROM events')}) GROUP BY part")
def splitmix_subsets(spark, sf_dir):
    """Rows of three seeded subsets of the events in order."""
    from profilark.operators.order import ORD, with_ordinal

    df = with_ordinal(table(spark, sf_dir, "events").select("event_id"), ["event_id"])
    return df.groupBy(splitmix_subset(7, F.col(ORD)).alias("part")).agg(F.count("*").alias("n_rows"), F.min(ORD).alias("first_row"))


def _population_sql(c: str) -> str:
    rows = f"SELECT {c} AS v, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events"
    h = lambda *masks: "(" + " + ".join(f"h{m}" for m in masks) + ")"
    return f"""SELECT * FROM (WITH b AS ({_subset_sql(1, rows)}), m AS (SELECT v, count(*) AS cnt, bit_or(1 << part) AS mask FROM b WHERE v IS NOT NULL GROUP BY v),
    t AS (SELECT CAST(sum(cnt) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS d, CAST(count_if(cnt = 1) AS DOUBLE) AS f1, CAST(count_if(cnt = 2) AS DOUBLE) AS f2, {", ".join(f"CAST(count_if(mask = {k}) AS DOUBLE) AS h{k}" for k in range(1, 8))} FROM m),
    s AS (SELECT *, {h(2, 3, 6, 7)} * {h(1, 3, 5, 7)} + {h(4, 5, 6, 7)} * {h(1, 2, 3, 5, 6, 7)} AS a, {h(3, 7)} + {h(5, 6, 7)} AS r FROM t)
    SELECT '{c}' AS col_a, CAST(n AS BIGINT) AS n_non_null, CAST(d AS BIGINT) AS n_distinct, round(a / (r + 1), 6) AS schnabel, round(a / ((r + 1) * pow(1 - 1 / (9 * (r + 1)) + 1.96 / (3 * sqrt(r + 1)), 3)), 6) AS schnabel_low, round(a / (r * pow(1 - 1 / (9 * r) - 1.96 / (3 * sqrt(r)), 3)), 6) AS schnabel_high,
    round(d + f1 * (f1 - 1) / (2 * (f2 + 1)), 6) AS chao1 FROM s)"""


@query(" UNION ALL ".join(_population_sql(c) for c in EVENTS))
def population_schnabel(spark, sf_dir):
    """Schnabel's estimate and interval over three seeded subsets, and Chao's."""
    return results(PopulationCardinality(seed=1), "events", _events(spark, sf_dir), EVENTS, "n_non_null", "n_distinct", "schnabel", "schnabel_low", "schnabel_high", "chao1", order=["event_id"], digits=6)


_MISS = "CASE WHEN n - ({m}) < w THEN 0 ELSE exp(lgamma(n - ({m}) + 1) - lgamma(n - ({m}) - w + 1) - lgamma(n + 1) + lgamma(n - w + 1)) END"
_SKIP = """SELECT * FROM (WITH c AS (SELECT {c} AS v, CAST(count(*) AS DOUBLE) AS cnt FROM events WHERE {c} IS NOT NULL GROUP BY 1), i AS (SELECT *, coalesce(sum(cnt) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
    s AS (SELECT (SELECT CAST(count(*) AS DOUBLE) FROM events) AS n, 64.0 AS w, sum(cnt) AS nn, CAST(count(*) AS DOUBLE) AS d FROM c)"""


@query(
    each(EVENTS, _SKIP + f""", p AS (SELECT cnt, nn, d, {_MISS.format(m="below + cnt")} + {_MISS.format(m="nn - below")} - {_MISS.format(m="nn")} AS p, {_MISS.format(m="cnt")} AS q FROM i, s)
    SELECT 'minmax' AS kind, '{{c}}' AS col_a, round(sum(cnt * p) / max(nn), 8) AS expected_skip_rows, round(sum(p) / max(d), 8) AS expected_skip_values FROM p
    UNION ALL SELECT 'set', '{{c}}', round(sum(cnt * q) / max(nn), 8), round(sum(q) / max(d), 8) FROM p)""")
)
def skip_index_expectations(spark, sf_dir):
    """What windows of a random order would skip, with an unlimited set index."""
    df = _events(spark, sf_dir)
    out = None
    for kind, technique in (("minmax", MinMaxIndex(index_granularity=64)), ("set", SetIndex(index_granularity=64, max_size=0))):
        got = results(technique, "events", df, EVENTS, "expected_skip_rows", "expected_skip_values", order=["event_id"], digits=8).select(F.lit(kind).alias("kind"), "*")
        out = got if out is None else out.unionByName(got)
    return out


@query(f"SELECT df_a, col_a, df_b, col_b, round(s / da, 9) AS exact_a_in_b, round(s / db, 9) AS exact_b_in_a, TRUE AS nothing_missed, TRUE AS few_extra FROM ({_BOTH})")
def membership_bloom_bounds(spark, sf_dir):
    """A Bloom filter misses no member; of the others it lets through a few in a hundred (1 % is asked for)."""
    keys = ["df_a", "col_a", "df_b", "col_b"]
    exact = _frames(spark, sf_dir, Membership()).result(SETS).select(*keys, F.col("ratio_a_in_b").alias("xa"), F.col("ratio_b_in_a").alias("xb"))
    got = _frames(spark, sf_dir, Membership(method="bloom")).result(SETS).join(exact, keys)
    extra = lambda r, x: F.col(r) - F.col(x) <= 0.04 * (1 - F.col(x)) + 1e-12
    return rounded(got.select(*keys, F.col("xa").alias("exact_a_in_b"), F.col("xb").alias("exact_b_in_a"), ((F.col("ratio_a_in_b") >= F.col("xa")) & (F.col("ratio_b_in_a") >= F.col("xb"))).alias("nothing_missed"), (extra("ratio_a_in_b", "xa") & extra("ratio_b_in_a", "xb")).alias("few_extra")))


@query(f"SELECT df_a, col_a, df_b, col_b, round(s / (da + db - s), 9) AS exact, TRUE AS found, TRUE AS within FROM ({_BOTH})")
def minhash_bounds(spark, sf_dir):
    """Every pair that exceeds a threshold is found, and estimates are within four standard errors (128 hashes at least)."""
    keys = ["df_a", "col_a", "df_b", "col_b"]
    exact = _frames(spark, sf_dir, Similarity()).result(SETS).select(*keys, F.col("jaccard").alias("exact"), (F.col("passes_jaccard") | F.col("passes_overlap")).alias("wanted"))
    got = _frames(spark, sf_dir, Similarity(method="minhash")).result(SETS).join(exact, keys)
    done = F.col("status") == "computed"
    near = F.abs(F.col("jaccard") - F.col("exact")) <= 4 * F.sqrt(F.col("exact") * (1 - F.col("exact")) / 128) + 1e-12
    return rounded(got.select(*keys, "exact", (done | ~F.coalesce("wanted", F.lit(False))).alias("found"), F.coalesce(near | ~done, F.lit(True)).alias("within")))


_HE = _H.replace("lineitem", "events")


@query(
    each(EVENTS, f"SELECT '{{c}}' AS what, round({_HE.format(g='{c}')}, 9) AS exact, TRUE AS within FROM (SELECT 1)")
    + f" UNION ALL SELECT 'pair', round({_H.format(g='l_returnflag, l_linestatus')}, 9), TRUE UNION ALL SELECT 'three', round({_H.format(g='l_returnflag, l_linestatus, l_linenumber')}, 9), TRUE"
)
def ams_entropy_bounds(spark, sf_dir):
    """Sampled entropies of one, two and three columns within 0.1 bit (and a tenth) of the exact ones."""
    df, items = _events(spark, sf_dir), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

    def both(sampled, exact, name, frame, keys, metric, order):
        sampled.add({name: frame}, {name: order})
        exact.add({name: frame})
        own = [k for k in exact.key_columns() if k.startswith("col")]
        x = exact.result(keys).select(*own, F.col(metric).alias("exact"))
        return sampled.result(keys).select(*own, F.col(metric).alias("h")).join(x, own)

    one = both(MarginalEntropyAms(), MarginalEntropy(), "events", df, [(("events", c),) for c in EVENTS], "h", ["event_id"]).select(F.col("col_a").alias("what"), "h", "exact")
    two = both(PairwiseEntropyAms(), PairwiseEntropy(), "lineitem", items, [(("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"))], "h_ab", order).select(F.lit("pair").alias("what"), "h", "exact")
    three = both(ThreewayEntropyAms(), ThreewayEntropy(), "lineitem", items, [tuple(("lineitem", c) for c in FLAGS)], "h_abc", order).select(F.lit("three").alias("what"), "h", "exact")
    got = one.unionByName(two).unionByName(three)
    return rounded(got.select("what", "exact", (F.abs(F.col("h") - F.col("exact")) <= 0.1 + 0.1 * F.col("exact")).alias("within")))


@query(_pairs_sql("""WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2), r AS (SELECT a, sum(n) AS m FROM c GROUP BY a), k AS (SELECT b, sum(n) AS m FROM c GROUP BY b),
    s AS (SELECT sum(n) * (sum(CAST(n AS DOUBLE) * n / (CAST(r.m AS DOUBLE) * k.m)) - 1) / 2 AS x, ((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM k) - 1) AS f FROM c JOIN r USING (a) JOIN k USING (b)),
    t AS (SELECT x, f, unnest(range(0, f // 2)) AS k FROM s)
    SELECT '{a}' AS col_a, '{b}' AS col_b, round(sum(exp(-x + k * ln(x) - lgamma(k + 1))), 8) AS p_value FROM t"""))
def chi_squared_tail(spark, sf_dir):
    """P-values; with an even number of degrees of freedom the tail is a finite sum."""
    return pair_results(ChiSquared(), "lineitem", table(spark, sf_dir, "lineitem").select(*FLAGS), PAIRS, "p_value", digits=8)


@query(each(EVENTS, """SELECT '{c}' AS col_a, round(0.5 + sum(CASE WHEN k % 2 = 1 THEN 4.0 WHEN k IN (0, 4000) THEN 1.0 ELSE 2.0 END * exp(-(z * k / 4000) * (z * k / 4000) / 2)) * max(z) / 12000 / sqrt(2 * pi()), 8) AS p_value FROM (SELECT unnest(range(0, 4001)) AS k),
    (SELECT ((n * (r - 1) - (n * n - s2)) / n) / sqrt((s2 * (s2 + n * (n + 1)) - 2 * n * s3 - n * n * n) / (CAST(n AS DOUBLE) * n * (n - 1))) AS z
    FROM (SELECT count(*) AS n, count_if(first OR {c} IS DISTINCT FROM p) AS r FROM (SELECT {c}, lag({c}) OVER (ORDER BY event_id) AS p, row_number() OVER (ORDER BY event_id) = 1 AS first FROM events)),
    (SELECT CAST(sum(m * m) AS DOUBLE) AS s2, CAST(sum(m * m * m) AS DOUBLE) AS s3 FROM (SELECT count(*) AS m FROM events GROUP BY {c})))"""))
def runs_test_tail(spark, sf_dir):
    """P-values; the SQL integrates the normal density by Simpson's rule."""
    return results(RunsTest(), "events", _events(spark, sf_dir), EVENTS, "p_value", order=["event_id"], digits=8)


@query("""SELECT 'ts' AS col_a, count(*) AS n_rows, CAST(count_if(date_trunc('day', ts) = ts) AS BIGINT) AS n_midnight, count(DISTINCT ts) = count(ts) AS is_unique,
    CAST(count(DISTINCT ts) AS DOUBLE) AS est_cardinality, 'observed' AS est_method FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN date_trunc('day', ts) + CAST(event_id AS INTEGER) * INTERVAL 1 DAY ELSE ts END AS ts FROM events)""")
def describe_times(spark, sf_dir):
    """Midnights, uniqueness and the estimate of a time column."""
    ts = F.expr("CASE WHEN event_id % 9 = 0 THEN date_trunc('DAY', ts) + make_dt_interval(cast(event_id as int)) ELSE ts END")
    df = table(spark, sf_dir, "events").select("event_id", ts.alias("ts"))
    return results(Describe(), "events", df, ["ts"], "n_rows", "n_midnight", "unique", "est_cardinality", "est_method", order=["event_id"]).withColumnRenamed("unique", "is_unique")


_DECIMALS = "CASE WHEN instr({v}, '.') > 0 THEN {v} ELSE {v} || '.' END"


@query("""SELECT 'amount' AS col_a, CAST(count(*) AS BIGINT) AS n_numeric, CAST(max(length(split_part(v, '.', 2))) AS INTEGER) AS numeric_max_frac_digits, CAST(min(length(split_part(v, '.', 2))) AS INTEGER) AS numeric_min_frac_digits,
    CAST(max(length(ltrim(replace(v, '.', ''), '0'))) AS INTEGER) AS numeric_max_sig_digits FROM (SELECT CAST(o_orderkey % 1000 AS VARCHAR) || '.' || substr('123456789', 1, 1 + CAST(o_orderkey % 5 AS INTEGER)) AS v FROM orders)""")
def numeric_string_digits(spark, sf_dir):
    """Digits after the point, and significant ones, of numbers kept as text."""
    v = F.concat((F.col("o_orderkey") % 1000).cast("string"), F.lit("."), F.expr("substr('123456789', 1, 1 + cast(o_orderkey % 5 as int))"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", v.alias("amount"))
    return results(Describe(), "orders", df, ["amount"], "n_numeric", "numeric_max_frac_digits", "numeric_min_frac_digits", "numeric_max_sig_digits", order=["o_orderkey"])


_WIDTH = "CASE WHEN lo >= 0 AND hi < 256 THEN 1 WHEN lo >= 0 AND hi < 65536 THEN 2 WHEN lo >= 0 AND hi < 4294967296 THEN 4 ELSE 8 END"


@query(
    " UNION ALL ".join(f"SELECT '{c}' AS column, 'uint' || CAST(8 * {_WIDTH} AS VARCHAR) AS type, n_null > 0 AS nullable, CAST(n * {_WIDTH} AS DOUBLE) AS predicted_bytes FROM (SELECT min({c}) AS lo, max({c}) AS hi, count(*) AS n, count_if({c} IS NULL) AS n_null FROM events)" for c in ("event_id", "user_id"))
    + """ UNION ALL SELECT 'event_type', 'dictionary[int8, string]', FALSE, CAST((SELECT count(*) FROM events) + ceil(4 * (count(*) + 1) / 8.0) * 8 + ceil(sum(strlen(v)) / 8.0) * 8 AS DOUBLE) FROM (SELECT DISTINCT event_type AS v FROM events)
    UNION ALL SELECT 'value', CASE WHEN count_if(CAST(CAST(value AS FLOAT) AS DOUBLE) <> value) = 0 THEN 'float' ELSE 'double' END, FALSE, CAST(count(*) * 8 AS DOUBLE) FROM events"""
)
def recommended_types(spark, sf_dir):
    """The type of each column and the Arrow bytes that it would take."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    rec = recommend.OneShotRecommender(skip=False).add(events, ["event_id"])
    return rec.result().select("column", "type", "nullable", "predicted_bytes")


@query("""SELECT 'full_scan' AS kind, 'p_retailprice' AS column, count(*) AS n_rows, round(sum(p_retailprice), 6) AS total, TRUE AS agrees, 16 AS id_length FROM part
    UNION ALL SELECT 'filter', 'p_size', count(*), CAST(sum(p_size) AS DOUBLE), TRUE, 16 FROM part, (SELECT min(v) AS lo, max(v) AS hi FROM (SELECT p_size AS v, row_number() OVER (ORDER BY p_size) - 1 AS r, count(*) OVER () AS n FROM part) WHERE r >= 50 AND r < 50 + round(n * 0.2)) WHERE p_size BETWEEN lo AND hi
    UNION ALL SELECT 'filter', 'p_brand', count(*), CAST(sum(strlen(p_brand)) AS DOUBLE), TRUE, 16 FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY abs(count(*) - (SELECT count(*) FROM part) * 0.1), count(*) DESC, 1 LIMIT 1)""")
def generated_queries(spark, sf_dir):
    """Generated queries as DataFrames and as SQL text of typed literals, and whether both agree."""
    part = table(spark, sf_dir, "part")
    part.createOrReplaceTempView("profilark_part")
    rows = []
    for q in (predicates.Query("full_scan", "p_retailprice"), predicates.choose_range(part, "p_size", 0.2, start=50), predicates.choose_in(part, "p_brand", 0.1, 1)):
        a = predicates.run(part, q).first()
        b = spark.sql(predicates.sql(q, "profilark_part", part.schema[q.column].dataType)).first()
        rows.append((q.kind, q.column, a["n_rows"], round(a["total"], 6), predicates.agree(tuple(a), tuple(b)), len(q.id())))
    return spark.createDataFrame(rows, "kind string, column string, n_rows long, total double, agrees boolean, id_length int")
