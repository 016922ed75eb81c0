import random

from profilark.operators import order
from profilark.operators.cardinality import score_top_k, score_top_k_frames
from profilark.plans.storage import pareto


def test_least_before_and_fronts_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(order, "CHUNK", 8)
    r = random.Random(6)
    rows = sorted({(r.choice(["a", "b", None]), r.randrange(90), 0) for _ in range(200)}, key=repr)
    rows = [(k, x, r.randrange(50)) for k, x, _ in rows]
    df = spark.createDataFrame(rows, "k string, x int, y int")
    got = {(g.k, g.x): g.low for g in order.least_before(df, "y", "low", "k", "x").collect()}
    assert len(got) == len(rows)
    for k, x, _ in rows:
        assert got[k, x] == min((c for a, b, c in rows if a == k and b < x), default=None)
    named = df.where("k is not null")
    front = {tuple(p) for p in pareto(named, "k", "x", "y").collect()}
    own = [p for p in rows if p[0]]
    assert front == {p for p in own if not any(q[0] == p[0] and q[1] <= p[1] and q[2] <= p[2] and q[1:] != p[1:] for q in own)}


def test_scores_of_reports_by_join(spark):
    true = {"a": 50, "b": 30, "c": 30, "d": 5}
    reported = [("a", 49, 0), ("c", 33, 2), ("x", 8, 9)]
    want = score_top_k(reported, true, 3)
    rows = [("v", k + 1, *r) for k, r in enumerate(reported)]
    got = score_top_k_frames(spark.createDataFrame(rows, "col string, rank int, value string, count long, error long"), spark.createDataFrame([("v", v, n) for v, n in true.items()], "col string, value string, count long"), 3).first().asDict()
    assert {k: round(got[k], 9) for k in want} == {k: round(v, 9) for k, v in want.items()}
