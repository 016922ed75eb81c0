import corpus_pipeline as cp
from profilark.functions.cluster import materialize, table
from tests.llm import brute
from tests.llm.test_decontaminate import expected


def test_each_stage_against_brute_force(spark, small):
    docs = table(spark, small, "documents")
    columns = docs.columns
    stages = dict(cp.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontaminate", "mix_sources"]

    def after(name, before):
        out = materialize(stages[name](spark, before, small), name)
        return out, {r.doc_id: r.text for r in out.collect()}

    first, kept = after("language_id", docs)
    assert first.columns == columns and first.schema == docs.schema
    whole = {r.doc_id: r.text for r in docs.collect()}
    assert all(kept[i] == whole[i] for i in kept) and len(kept) >= 0.99 * len(whole)

    second, lines = after("line_dedup", first)
    assert second.columns == columns
    gone = brute.removed_lines([(i, "\n".join(x if len(x.split()) >= 5 else "" for x in t.split("\n"))) for i, t in kept.items()], 80)
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in kept.items()}
    assert lines == {i: t for i, t in want.items() if t.split() or i not in gone}
    assert all(r.n_chars == len(r.text) for r in second.collect())

    third, near = after("near_dedup", second)
    comp = brute.near_duplicates(list(lines.items()), 5, 80)
    assert third.columns == columns and near == {i: t for i, t in lines.items() if comp[i][1] == i}

    fourth, clean = after("decontaminate", third)
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    hit = {d for d, _, n, _ in expected(list(near.items()), items, 10) if n}
    assert fourth.columns == columns and hit and clean == {i: t for i, t in near.items() if i not in hit}

    last = stages["mix_sources"](spark, fourth, small).collect()
    words = {i: len(t.split()) for i, t in clean.items()}
    assert {r.doc_id for r in last} <= set(clean) and all(r.text == clean[r.doc_id] and 1 <= r["copy"] <= 3 for r in last)
    assert abs(sum(words[r.doc_id] for r in last) - sum(words.values())) <= 0.02 * sum(words.values())


def test_nulls_repeats_and_extra_columns(spark, small):
    rows = [(None, None, None, None, None, 1), (None, "some text without an id here", "en", None, 3, 1), (1, "", "en", "a", 0, 1), (2, "the same line of words\nthe end of it all now", "en", "a", 9, 1), (2, "the same line of words\nthe end of it all now", "en", "a", 9, 1), (3, "the same line of words", "en", "b", 9, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, doc int")
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, small), name)
    assert {r.doc_id for r in docs.collect()} <= {None, 2}
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "doc", "copy"]
