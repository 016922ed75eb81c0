"""Recommender, streaming, predicates, storage trials, synthetic data, evaluation, sources."""

import datetime
import decimal
import random

import pyarrow as pa
import pytest

from profilark.operators.order import with_ordinal
from profilark.plans import evaluate, predicates, recommend, storage
from profilark.sources import readers, synthetic
from profilark.streaming.profile import StreamingProfiler


def frame(spark, n=400):
    r = random.Random(2)
    rows = [
        (
            i, r.randrange(200), r.choice([0, 1]), -5 + r.randrange(300), float(r.randrange(100)), r.randrange(1000) / 100, decimal.Decimal(r.randrange(50) * 10).scaleb(-2),
            datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=60 * i), f"{r.randrange(10**6)}", r.choice(["True", "false"]), r.choice(["red", "green", None]), f"2024-02-{1 + i % 28:02d}", None, f"{r.randrange(100)}.{r.randrange(100):02d}", f"free text {i}",
        )
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "o long, small long, bit int, signed long, whole double, price double, dec decimal(10,2), ts timestamp, number string, flag string, colour string, day string, gone string, amount string, note string")


def test_recommended_types(spark):
    df = frame(spark)
    rec = recommend.OneShotRecommender(skip=False).add(df, ["o"])
    got = {r.column: r for r in rec.result().collect()}
    want = {"small": "uint8", "bit": "bool", "signed": "int16", "whole": "uint8", "dec": "decimal128(2, 1)", "ts": "timestamp[s, tz]", "number": "uint32", "flag": "bool", "colour": "dictionary[int8, string]", "gone": "null", "note": "string"}
    assert {c: got[c].type for c in want} == want
    assert got["price"].type in ("decimal128(3, 2)", "double", "float") and got["amount"].type.startswith(("decimal", "float"))
    assert any(c.type == "date32" and c.outcome == "passed over" for c in got["day"].candidates)  # 28 days: a dictionary is smaller
    assert got["colour"].store_type == "LowCardinality(Nullable(String))" and got["ts"].store_type.startswith("DateTime") and got["small"].store_type == "UInt8"
    assert sorted(x.value for x in got["colour"].top_k) == ["green", "red"]
    assert all(sum(c.outcome == "chosen" for c in r.candidates) == 1 for r in got.values())
    with pytest.raises(ValueError):
        rec.add(df, ["o"])


def test_skip_decision():
    M = recommend.Measured
    best = recommend.decide_skip([M("minmax", 1, 0.9, 0.1, 100), M("minmax", 4, 0.89, 0.1, 25), M("set", 1, 0.95, 0.5, 900, 125, 0.5)], lambda: [], 1e6)
    assert (best.kind, best.granularity) == ("minmax", 4)
    asked = []
    bloom = recommend.decide_skip([M("minmax", 1, 0.1, 0.1, 100)], lambda: asked.append(1) or [M("bloom", 1, 0.8, 0.1, 10)], 1000)
    assert bloom.kind == "bloom" and asked
    assert recommend.decide_skip([M("minmax", 1, 0.4, 0.39, 100)], lambda: [M("bloom", 1, 0.8, 0.1, 10**9)], 1000) is None
    assert recommend.pick_compression({"none": 100, "lz4": 60, "zstd:1": 50, "zstd:3": 49, "zstd:9": 48}) == "zstd:9"
    assert recommend.pick_compression({"none": 100, "lz4": 60, "zstd:1": 55, "zstd:3": 55, "zstd:9": 55}) == "lz4"
    assert recommend.integer_type(-(2**63), 2**63 - 1) == "int64" and recommend.integer_type(0, 2**64).startswith("decimal128")


def test_skip_recommendation(spark):
    df = spark.createDataFrame([(i, i // 40, (i * 7919) % 50) for i in range(4000)], "o long, sorted long, random long")
    got = {r.column: r.skip_index for r in recommend.OneShotRecommender(index_granularity=100, skip_granularities=(1, 4), set_max_sizes=(20,)).add(df, ["o"]).result().collect()}
    assert got["sorted"].startswith("minmax GRANULARITY") and got["random"] is None


def test_stream_equals_one_frame_however_cut(spark):
    df = frame(spark).select("o", "small", "price", "number", "colour", "ts")
    whole = None
    for cuts in ([400], [1, 150, 400], [90, 91, 300, 400]):
        p, a = StreamingProfiler(block_rows=32, blocks=3), 0
        for b in cuts:
            p.add(df.where(f"o >= {a} and o < {b}"), ["o"])
            a = b
        rows = sorted(map(tuple, p.result().collect()), key=repr)
        whole = whole or rows
        assert [r[:10] + r[10:] for r in rows] == whole
    by = {r[0]: r for r in whole}
    assert by["small"][10] == "uint8" and by["colour"][4] == df.where("colour is null").count() and by["number"][10] == "uint32" and by["o"][15] == 3


def test_stream_of_changing_columns(spark):
    p = StreamingProfiler()
    p.add(spark.createDataFrame([(0, 5)], "o long, a int"), ["o"])
    p.add(spark.createDataFrame([(1, "x")], "o long, b string"), ["o"])
    with pytest.raises(ValueError):
        p.add(spark.createDataFrame([(2, "x")], "o long, a string"), ["o"])
    got = {r.column: r for r in p.result().collect()}
    assert (got["a"].n_rows, got["a"].n_null, got["a"].first_row) == (2, 1, 0) and (got["b"].n_null, got["b"].first_row) == (1, 1)


def test_structured_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(3):
        spark.range(100 * k, 100 * k + 100).selectExpr("id AS o", "id % 7 AS v").coalesce(1).write.mode("append").parquet(source)
    p = StreamingProfiler()
    stream = spark.readStream.schema("o long, v long").option("maxFilesPerTrigger", 1).parquet(source)
    q = p.attach(stream, ["o"], str(tmp_path / "check")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.column: r for r in p.result().collect()}
    assert got["v"].n_rows == 300 and got["v"].n_unique == 7 and got["o"].type == "uint16"


def test_predicates(spark):
    df = spark.createDataFrame([(i, i % 10, None if i % 4 else float("nan") if i % 8 else i / 3, "t'x" if i % 3 else None) for i in range(1000)], "o long, k long, f double, s string")
    q = predicates.choose_range(df, "o", 0.1, seed=3)
    assert q.achieved == pytest.approx(0.1) and predicates.run(df, q).first().n_rows == 100 and len(q.id()) == 16 and q.id() == predicates.choose_range(df, "o", 0.1, seed=3).id()
    some = predicates.choose_in(df, "k", 0.3, 3)
    assert some.values == (0, 1, 2) and some.achieved == pytest.approx(0.3)
    f = predicates.choose_range(df, "f", 0.05)
    assert all(v == v for v in f.values)
    df.createOrReplaceTempView("t")
    for q in (some, f, predicates.Query("filter", "s", ("t'x",), "in"), predicates.Query("full_scan", "f")):
        a = predicates.run(df, q).first()
        b = spark.sql(predicates.sql(q, "t", df.schema[q.column].dataType)).first()
        assert predicates.agree((a.n_rows, a.total), (b.n_rows, b.total))
    assert not predicates.agree((1, 1.0), (2, 1.0)) and not predicates.agree((1, 1.0), (1, 1.1)) and predicates.agree((1, float("nan")), (1, float("nan")))


def test_storage_trials(spark, tmp_path):
    good, bad = storage.grid("bigint", {"codec": ["zstd", "zlib"], "bloom": [False, True], "sort": [True]})
    assert len(good) == 2 and all("codec" in reason for _, reason in bad) and len(bad) == 2
    df = spark.range(5000).selectExpr("id % 100 AS v")
    frames, sizes = {}, []
    for k, v in enumerate(good):
        path = storage.write(df, "v", v, str(tmp_path / str(k)))
        frames[str(k)] = spark.read.parquet(path)
        packed, plain = storage.footer_sizes(spark, [str(p) for p in (tmp_path / str(k)).glob("*.parquet")])
        sizes.append((str(k), packed, plain))
    samples = spark.createDataFrame(storage.rounds(frames, [predicates.Query("full_scan", "v")], 6), "round int, variant string, query string, seconds double")
    assert samples.count() == 12
    ratio = storage.paired_ratio(samples, "0").first()
    assert ratio.n == 6 and ratio.low <= ratio.ratio <= ratio.high
    assert storage.report(samples, spark.createDataFrame(sizes, "variant string, bytes long, plain_bytes long"), "0").count() == 2
    assert storage.median_interval(5) is None and storage.median_interval(10) == (1, 8)


def test_evaluation(spark):
    measured = spark.createDataFrame([("a", "x", 10), ("a", "y", 8), ("b", "x", 5), ("b", "y", 9)], "column string, variant string, bytes long")
    chosen = spark.createDataFrame([("a", "x"), ("b", "x")], "column string, variant string")
    regret = {r.column: r for r in evaluate.size_regret(measured, chosen).collect()}
    assert regret["a"].regret == pytest.approx(0.25) and regret["b"].hit
    assert {r.exact for r in evaluate.size_cells(measured, measured).collect()} == {True}
    cost = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 1.0), ("b", "y", 2.0)], "column string, variant string, seconds double")
    assert sorted((r.column, r.variant) for r in evaluate.size_frontier(measured, cost).collect()) == [("a", "x"), ("a", "y"), ("b", "x")]
    r = random.Random(1)
    blocks = [(lo := r.randrange(50), lo + r.randrange(20)) for _ in range(30)]
    probes = [(v, 1 + v % 3) for v in range(70)]
    got = evaluate.skip_predictions(spark.createDataFrame([("c", *b) for b in blocks], "column string, lo long, hi long"), spark.createDataFrame([("c", *p) for p in probes], "column string, value long, weight long")).first()
    want = sum(w * sum(not lo <= v <= hi for lo, hi in blocks) / 30 for v, w in probes) / sum(w for _, w in probes)
    assert got.predicted_skip == pytest.approx(want)
    diff = evaluate.compare(spark.createDataFrame([("a", 1), (None, 2)], "k string, v long"), spark.createDataFrame([(None, 5), ("z", 1)], "k string, v long"), ["k"], "v")
    assert sorted((tuple(r) for r in diff.collect()), key=repr) == sorted([("a", 1, None, None), (None, 2, 5, 3), ("z", None, 1, None)], key=repr)
    assert evaluate.summarise({"one": measured, "two": chosen}).count() == 6


def test_synthetic(spark):
    C = synthetic.ColumnSpec
    spec = synthetic.FrameSpec(4000, (C("h", "int64", 64, entropy_bits=3.0), C("r", "string", 30, order="runs", mean_run=8), C("s", "int64", 4000, order="sorted"), C("n", "float64", 10, null_share=0.25), C("m", "int64", 50, structure="multiples", multiple=6)), 3, (synthetic.NoisyCopy("copy", "h", 0.1), synthetic.Relabel("names", "h"), synthetic.Subset("part", "m", 0.5), synthetic.CompositeKey("k", "h")))
    df = synthetic.generate(spark, spec)
    a, b = df.collect(), synthetic.generate(spark, spec).repartition(3).collect()
    assert sorted(a) == sorted(b)
    stats = {r.col: r for r in synthetic.measure(df, ["h", "r", "s"], ["row"]).collect()}
    assert stats["h"].entropy_norm * 6 == pytest.approx(3.0, abs=0.15) and stats["r"].run_ratio < 0.16 and stats["s"].distinct > 3900
    assert 0.2 < sum(r.n is None for r in a) / 4000 < 0.3 and all(r.m % 6 == 0 for r in a)
    assert 0.05 < sum(r.copy != r.h for r in a) / 4000 < 0.15 and len({(r.h, r.k) for r in a}) == 4000
    keyed = synthetic.foreign_key(df, "fk", spark.range(10).toDF("id"), "id")
    assert {r.fk for r in keyed.collect()} == set(range(10)) and keyed.count() == 4000
    rows = synthetic.covering({"a": [1, 2, 3], "b": "xy", "c": [True, False]})
    assert {(r["a"], r["b"]) for r in rows} == {(a, b) for a in (1, 2, 3) for b in "xy"} and {(r["b"], r["c"]) for r in rows} == {(b, c) for b in "xy" for c in (True, False)}
    assert synthetic.generate(spark, synthetic.scenario("gcd", 500)).count() == 500
    with pytest.raises(ValueError):
        C("x", entropy_bits=9.0, distinct=4)


def test_sources(spark, tmp_path):
    t = pa.table({"u": pa.array([1, 2**63], pa.uint64()), "d": pa.array(["a", "b"]).dictionary_encode(), "t": pa.array([1, 2], pa.time64("ns")), "s": ["x", None]})
    df = readers.arrow_frame(spark, t)
    assert [r.u for r in df.collect()] == [1, 2**63] and dict(df.dtypes)["t"] == "bigint"
    path = str(tmp_path / "f.arrow")
    assert readers.write_ipc(df.select("s", "t"), path, "zstd", 3) > 0 and readers.read_ipc(spark, path, ["t"]).count() == 2
    with pytest.raises(ValueError):
        readers.checked(pa.table([pa.array([1]), pa.array([2])], names=["a", "a"]))
    made = []
    for _ in range(2):
        got = readers.cached(spark, str(tmp_path / "cache"), {"n": 5}, lambda: made.append(1) or spark.range(5))
    assert got.count() == 5 and len(made) == 1
    for kind in ("parquet", "orc", "json", "csv"):
        out = readers.write(spark.range(7), str(tmp_path / kind), kind)
        assert readers.read(spark, out, kind, schema="id long").count() == 7
    assert readers.read(spark, str(tmp_path / "parquet"), ordinal=True).select("__file", "__row").distinct().count() == 7


def test_ordinals(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 AS k").repartition(6)
    got = with_ordinal(df, ["k"]).collect()
    assert all(r["k"] == r["__ord"] for r in got) and len(got) == 1000


def test_whole_event_queries_against_brute_force(spark, tiny):
    import statistics

    from profilark.plans import registry

    rows = spark.read.parquet(f"{tiny}/events.parquet").select("event_id", "user_id", "event_type").collect()
    points = {(r.event_type, r.event_id, r.user_id) for r in rows}
    by = {}
    for k, x, y in points:
        by.setdefault(k, []).append((x, y))
    want, least = set(), None
    for k, own in by.items():
        least = None
        for x, y in sorted(own):
            if least is None or y < least:
                want.add((k, x, y))
                least = y
    assert {tuple(r) for r in registry.queries()["pareto_frontier_whole"](spark, tiny).select("k", "x", "y").collect()} == want
    seconds = {r.event_id: 1 + r.event_id % 7 + r.event_id % 3 / 4 for r in rows}
    got = {r.variant: r for r in registry.queries()["paired_ratio_ci_whole"](spark, tiny).collect()}
    for turn, variant in ((1, "b"), (2, "c")):
        ratios = sorted(seconds[i] / seconds[i - turn] for i in seconds if i % 3 == turn and i - turn in seconds)
        assert got[variant].n == len(ratios) and abs(got[variant].ratio - statistics.median(ratios)) < 1e-6
        lo, hi = storage.median_interval(len(ratios), 0.95)
        assert abs(got[variant].low - ratios[lo]) < 1e-6 and abs(got[variant].high - ratios[hi]) < 1e-6


def test_median_interval_of_many_rounds_goes_on_from_few():
    import math

    for n in (501, 800):
        k, total = 0, 0.0
        while total + math.comb(n, k) / 2**n <= 0.025:
            total += math.comb(n, k) / 2**n
            k += 1
        assert storage.median_interval(n) == (k - 1, n - k)
    assert storage.median_interval(10**8)[0] > 10**8 // 2 - 10**4


def test_nested_stream_columns_are_not_computed(spark):
    df = spark.createDataFrame([(1, [1, 2], {"a": 1}), (2, [3], {"b": 2})], "i long, l array<long>, m map<string,long>")
    got = {r["column"]: (r.n_rows, r.n_null, r.type) for r in StreamingProfiler().add(df, ["i"]).result().collect()}
    assert got["l"] == got["m"] == (2, None, "not computed") and got["i"][1] == 0
