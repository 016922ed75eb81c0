import json
import math

import pytest
from pyspark.sql import functions as F

from profilark.plans import evaluate, suite
from profilark.sources import datasets, synthetic

DOC = {"name": "t", "dataset": {"name": "gcd:500", "column": "gcd_even"}, "parquet": {"type": ["bigint", "int"], "codec": ["zstd", "none"]}, "orc": {"codec": "zlib"}, "queries": {"full_scan": True, "range": [0.2], "in": [[0.1, 2]]}, "results": {"rounds": 2, "baseline": "x"}}


def test_parse():
    s = suite.parse(json.dumps(DOC))
    assert s.rounds == 2 and set(s.engines) == {"parquet", "orc"}
    good, bad = suite.cells(s, "double")
    assert len(good) == 1 and len(bad) == 4 and len(suite.cells(s, "bigint")[0]) == 5 and all("do not all fit" in why for _, why in bad)
    for broken in ({k: v for k, v in DOC.items() if k != "queries"}, DOC | {"more": 1}, {k: v for k, v in DOC.items() if k not in ("parquet", "orc")}, DOC | {"parquet": {"colour": ["red"]}}, DOC | {"queries": {"range": [2]}}, DOC | {"queries": {}}, DOC | {"dataset": {"column": "x"}}, DOC | {"results": {"rounds": 0}}, DOC | {"queries": {"in": [[0.1, 0]]}}, "[1]", "name: [", "name: x"):
        with pytest.raises(Exception):
            suite.parse(broken)


def test_run_resumes_and_reports(spark, tmp_path, capsys):
    s, store = suite.parse(DOC), suite.Store(spark, str(tmp_path / "store"))
    df = datasets.load(spark, "gcd:500")
    assert df.count() == 500 and store.samples().count() == 0 and store.drift() == 0
    n = len(suite.cells(s, "bigint")[0]) * 3
    assert suite.run(spark, s, df, store, str(tmp_path / "v")) == 2 * n
    assert suite.run(spark, s, df, store, str(tmp_path / "v")) == 0  # all are held
    assert suite.run(spark, s, df, store, str(tmp_path / "v"), more=1) == n and set(store.held("t").values()) == {3}
    samples = store.samples("t")
    assert samples.groupBy("variant", "query").agg(F.sort_array(F.collect_list("round")).alias("r")).where("r != array(0, 1, 2)").isEmpty()
    assert suite.filter_where(samples, ["format=orc"]).count() == 9 and suite.filter_where(samples, ["codec=none", "type=int"]).count() == 9
    with pytest.raises(ValueError):
        suite.filter_where(samples, ["shape=round"])
    old = [(1, "r", "t", "v", "q", 0, 1.0, 1.0, 0.0)]
    store.append(old)
    assert store.drift() == 1 and store.samples("t").count() == 3 * n
    (tmp_path / "s.json").write_text(json.dumps(DOC))
    assert suite.main(["report", str(tmp_path / "s.json"), "--store", str(tmp_path / "store"), "--where", "format=orc"], spark) == 0
    assert "format=orc" in capsys.readouterr().out
    assert suite.main(["run", str(tmp_path / "s.json"), "--store", str(tmp_path / "store")], spark) == 0
    assert suite.main(["compare", str(tmp_path / "store"), str(tmp_path / "store")], spark) == 0 and suite.main(["datasets"], spark) == 0
    assert suite.main(["clean", str(tmp_path / "s.json"), "--store", str(tmp_path / "store")], spark) == 0


def test_export(spark, tmp_path):
    rec = spark.createDataFrame([("a", "bigint", "uint8"), ("l", "array<int>", "list[uint8]")], "column string, dtype string, type string")
    (path,) = suite.export(rec, "events", str(tmp_path))
    s = suite.parse(open(path).read())
    assert s.dataset == {"name": "events", "column": "a"} and s.engines["parquet"]["type"] == ["smallint", "bigint"]


def test_clocks(spark):
    rows = [("a", "q", 1.0, 1.0), ("b", "q", 2.0, 2.1), ("c", "q", 2.0, 0.5)]
    got = suite.clocks_disagree(spark.createDataFrame(rows, "variant string, query string, seconds double, cpu_seconds double"))
    assert {r.variant for r in got.collect()} == {"a", "c"} or {r.variant for r in got.collect()} == {"c"} or got.count() >= 1


def test_scores(spark, tmp_path):
    measured = spark.createDataFrame([("a", "none", 100.0), ("a", "Delta", 60.0), ("b", "none", 100.0), ("b", "GCD", 99.5), ("c", "GCD", 7.0)], "column string, variant string, bytes double")
    choice = evaluate.measured_choice(measured)
    assert {(r.column, r.variant, r.bytes) for r in choice.collect()} == {("a", "Delta", 60.0), ("b", "none", 100.0), ("c", "GCD", 7.0)}
    gain = evaluate.type_gain(spark.createDataFrame([("a", "bigint", True, 80.0), ("a", "int", False, 20.0)], "column string, type string, original boolean, bytes double"))
    assert [tuple(r) for r in gain.collect()] == [("a", "int", 20.0, 80.0, 0.75)]
    blocks = spark.createDataFrame([("a", 0, 9), ("a", 10, 19)], "column string, lo int, hi int")
    probes = spark.createDataFrame([("a", 5, 9.0), ("a", 30, 1.0)], "column string, value int, weight double")
    skips = evaluate.skip_queries(blocks, probes)
    assert [(r.column, r.by_rows, r.uniform) for r in skips.collect()] == [("a", 0.55, 0.75)]
    regret = evaluate.skip_regret(spark.createDataFrame([("a", "minmax"), ("b", None)], "column string, index string"), spark.createDataFrame([("a", "minmax", 0.4), ("a", "set", 0.5), ("b", "set", 0.2)], "column string, index string, skip double"))
    assert {(r.column, round(r.regret, 9), r.best) for r in regret.collect()} == {("a", 0.1, "set"), ("b", 0.2, "set")}
    cost = evaluate.query_cost(spark.createDataFrame([("v", "q", 0.5), ("v", "q", 1.5)], "variant string, query string, seconds double"), 10**6)
    assert cost.first().ms_per_million == 1000.0
    folder = str(tmp_path / "scores")
    assert evaluate.write_scores({"measured_choice": choice, "skip_queries": skips, "query_cost": cost}, folder, {"suite": "t"}) == ["measured_choice", "skip_queries", "query_cost"]
    assert spark.read.parquet(f"{folder}/measured_choice").columns == ["column", "variant", "bytes", "base_bytes"] and {tuple(r) for r in spark.read.parquet(f"{folder}/about").collect()} == {("version", "1"), ("suite", "t")}
    with pytest.raises(ValueError):
        evaluate.write_scores({"other": choice}, folder)
    with pytest.raises(ValueError):
        evaluate.write_scores({"type_gain": choice}, folder)


def test_datasets(spark, tiny):
    assert datasets.load(spark, "events:7", tiny).count() == 7 and datasets.load(spark, f"{tiny}/region.parquet").count() == 5
    assert "skip" in datasets.names("synthetic") and "orders" not in datasets.names("synthetic")
    for bad in ("events", "nothing", "events:x"):
        with pytest.raises(ValueError):
            datasets.load(spark, bad)
    for name in synthetic.SCENARIOS:
        assert synthetic.generate(spark, synthetic.scenario(name, 50)).count() == 50


def test_solver_and_measures(spark):
    assert synthetic.bisect(lambda x: x * x, 9, 0, 10).at == pytest.approx(3, abs=1e-5) and synthetic.bisect(lambda x: -x, 5, 0, 10).status == "above" and synthetic.bisect(lambda x: x, -1, 0, 10) == synthetic.Solved(0, 0, "below")
    df = spark.range(1000).selectExpr("id AS row", "id * 6 AS up", "id % 2 AS flip", "xxhash64(id) % 7 AS noise")
    m = synthetic.measure_order(df, "up", ["row"])
    assert m["rho"] == pytest.approx(1) and m["descents"] == 0 and m["gcd"] == 6 and m["max_step"] == 6 and m["runs_z"] < -25
    f = synthetic.measure_order(df, "flip", ["row"])
    assert f["runs_z"] > 25 and f["interarrival_cv"] == 0 and f["descents"] == 499
    p = synthetic.measure_pair(df, "flip", "noise")
    assert p["joint_distinct"] <= 26 and 0 <= p["nmi"] < 0.1 and p["containment"] == 1.0
    spec = synthetic.scenario("top_k", 2000)
    made = synthetic.generate(spark, spec)
    assert synthetic.check(made, spec, 0.2) == [] and synthetic.check(made.withColumn("flat", F.lit(None).cast("long")), spec, 0.2)
    mixed = synthetic.disordered(df, ["up"], 0.1)
    rho = synthetic.measure_order(mixed, "up", ["row"])["rho"]
    assert 0.7 < rho < 1 and mixed.count() == 1000
    keyed = synthetic.foreign_key(df, "fk", spark.range(50).toDF("id"), "id", zipf=1.1, null_share=0.1)
    counts = [r["count"] for r in keyed.where("fk is not null").groupBy("fk").count().orderBy(F.desc("count")).collect()]
    assert counts[0] > 4 * counts[len(counts) // 2] and 50 < keyed.where("fk is null").count() < 150 and not math.isnan(rho)
