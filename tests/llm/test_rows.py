"""Rows whose ids repeat or are null, and columns named as the operators' own."""

import corpus_pipeline as cp
from profilark.functions import cluster
from profilark.functions.cluster import materialize
from profilark.llm import langid
from profilark.llm.decontaminate import Decontaminator
from profilark.llm.linededup import LineDedup
from profilark.llm.mixing import SourceMix
from profilark.llm.neardup import NearDuplicates
from tests.llm import brute

V = [f"v{k}" for k in range(61)]
A, B, W = " ".join(V), " ".join([*V[:60], "x"]), " ".join(f"w{k}" for k in range(40))


def test_line_dedup_keeps_lines_of_another_text_under_the_same_id(spark):
    rows = [(1, "a line that is the first"), (5, "a line that is the first\nsecond of five here"), (5, "a line all of its own\nanother such line stands alone"), (6, "another such line stands alone"), (5, "a line all of its own\nanother such line stands alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.removed_lines) for r in LineDedup().run(df).collect())
    own = "a line all of its own\nanother such line stands alone"
    assert got == sorted([(1, rows[0][1], []), (5, "second of five here", [0]), (5, own, []), (5, own, []), (6, "", [0])])


def test_line_dedup_of_repeated_ids_against_brute_force(spark):
    texts = ["\n".join(f"l{(d * k) % 37} m{d % 5} n{k} o p q r s t u" for k in range(1, 6)) for d in range(60)]
    rows = [(d % 20, t) for d, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = [(r.doc_id, r.h, r.text) for r in df.selectExpr("*", "xxhash64(text) AS h").distinct().orderBy("doc_id", "h").collect()]
    want = brute.removed_lines([(n, t) for n, (_, _, t) in enumerate(order)], 80)
    number = {(i, t): n for n, (i, _, t) in enumerate(order)}
    for hot in (2, 256):
        got = LineDedup(hot=hot).run(df).collect()
        assert len(got) == len(rows)
        sent = [r for r in got if r.removed_lines]
        assert len(sent) > 10
        kept = {(r.doc_id, r.text): r.removed_lines for r in got}
        for (i, t), n in number.items():
            left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(n, ()))
            assert kept[i, left] == want.get(n, [])


def test_near_duplicates_of_one_id(spark):
    df = spark.createDataFrame([(1, W), (5, W), (5, A), (3, B)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in NearDuplicates(shingle=4).run(df).collect())
    assert got == [(1, 1, True), (3, 3, True), (5, 1, False), (5, 3, False)]


def test_large_sides_are_not_broadcast(spark, monkeypatch):
    """With nothing small enough to broadcast the results are the same, and no plan has a broadcast of a table."""
    texts = ["\n".join(f"l{(d * k) % 37} m{d % 5} n{k} o p" for k in range(1, 6)) for d in range(60)] + [W, W, A, B]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = lambda: {r.doc_id: r.removed_lines for r in LineDedup(hot=2).run(df).collect()}
    near = lambda: {r.doc_id: r.component_id for r in NearDuplicates(shingle=4).run(df).collect()}
    before = lines(), near()
    monkeypatch.setattr(cluster, "BROADCAST_BYTES", 0)
    assert (lines(), near()) == before
    side = materialize(df.select("doc_id"), "side")
    assert cluster.small(side) is side
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df.join(cluster.small(side), "doc_id")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
        monkeypatch.undo()
        assert "BroadcastHashJoin" in df.join(cluster.small(side), "doc_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)


def test_pipeline_drops_copies_and_keeps_the_rest_whatever_the_ids(spark, small):
    rows = [(1, W), (5, W), (5, A), (7, A + " and"), (9, "only here " * 3 + W[:40]), (9, "only here " * 3 + W[:40]), (None, W), (None, "this null one stands alone in all the table"), (None, "this null one stands alone in all the table")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "r", "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, kept string")
    stages = dict(cp.STAGES)
    got = sorted(((r.doc_id, r.text) for r in stages["near_dedup"](spark, docs, small).collect()), key=repr)
    assert got == sorted([(1, W), (5, A), rows[4], rows[7]], key=repr)
    odd = docs.withColumnsRenamed({"row": "emptied", "kept": "lang_pred"}).selectExpr("*", "'x' AS `a.b`", "1 AS score", "2 AS doc")
    columns = odd.columns
    for name, stage in cp.STAGES[:-1]:
        odd = materialize(stage(spark, odd, small), name)
        assert odd.columns == columns
    assert odd.where("doc_id = 1").count() == 1


def test_fit_reads_no_more_rows_than_it_keeps(spark, monkeypatch):
    rows = [(None, f"word{k} and more text of number {k}", "en") for k in range(3000)] + [(None, "der und die", "de")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(langid, "train", lambda texts, rounds: seen.extend(texts) or langid.Model([], *[None] * 4))
    langid.LanguageTagger(sample_docs=10).fit(df)
    assert len(seen) == 20 and {x for x, _ in seen} == {"en", "de"}
    again = seen.copy()
    seen.clear()
    langid.LanguageTagger(sample_docs=10).fit(df.repartition(7))
    assert seen == again


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "one two three", "s", 7, 8, 9, "dot")], "doc_id long, text string, source string, emptied int, copy int, n_words int, `a.b` string")
    got = LineDedup().run(df)
    assert got.columns == ["doc_id", "text", "source", "emptied_", "copy", "n_words", "a.b", "removed_lines", "emptied"] and got.first()["emptied_"] == 7
    mixed = SourceMix().run(df)
    assert mixed.columns == ["doc_id", "text", "source", "emptied", "copy_", "n_words", "a.b", "copy"] and mixed.first()["copy_"] == 8
    assert Decontaminator().run(df, df.selectExpr("doc_id AS item_id", "text")).first().n_words == 3
    tagged = langid.LanguageTagger(rounds=1).fit(df.selectExpr("*", "'en' AS lang")).run(df.selectExpr("*", "1 AS score"), "doc_id", "score", "text")
    assert tagged.columns == ["doc_id", "score_", "text", "lang_pred", "score"]


def test_mix_of_repeated_and_null_ids_does_not_depend_on_partitions(spark):
    rows = [(None if k % 3 else 4, " ".join(["w"] * (k % 4)) + f" u{k % 50}", "ab"[k % 2]) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = sorted(tuple(r) for r in SourceMix().run(df.repartition(1)).selectExpr("coalesce(doc_id, -1)", "text", "source").collect())
    many = sorted(tuple(r) for r in SourceMix().run(df.repartition(7)).selectExpr("coalesce(doc_id, -1)", "text", "source").collect())
    assert one == many
