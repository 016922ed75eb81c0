import zlib

import numpy as np
import pytest

from profilark.functions.cluster import table
from profilark.llm import langid
from profilark.llm.queries import queries


def test_query_and_held_out_accuracy(spark, small):
    got = {r.doc_id: r for r in queries()["op10_language_id"](spark, small).collect()}
    docs = {r.doc_id: r for r in table(spark, small, "documents").collect()}
    assert set(got) == set(docs)
    held = [i for i in got if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1 for i in got)
    right = sum(got[i].lang_pred == docs[i].lang for i in held)
    assert right >= 0.97 * len(held)


def test_posteriors_equal_enumeration():
    r = np.random.default_rng(0)
    scores, move = r.normal(size=(9, 3)).astype(np.float32), r.normal(size=(3, 3)).astype(np.float32)
    ptr = np.array([0, 4, 4, 9])
    got = langid.posteriors(scores, ptr, move)
    for a, b in ((0, 4), (4, 9)):
        n = b - a
        mass = np.zeros((n, 3))
        for k in range(3**n):
            y = [k // 3**j % 3 for j in range(n)]
            p = np.exp(sum(scores[a + j, y[j]] for j in range(n)) + sum(move[y[j], y[j + 1]] for j in range(n - 1)))
            for j in range(n):
                mass[j, y[j]] += p
        assert np.allclose(got[a:b], mass / mass.sum(1, keepdims=True), atol=1e-5)


@pytest.fixture(scope="module")
def fitted(spark, small):
    return langid.LanguageTagger(rounds=150).fit(table(spark, small, "documents"))


def test_switched_words(spark, small, fitted):
    docs = fitted.run(table(spark, small, "documents"), "doc_id", "lang", "text").where("length(text) > 600 and score > 0.98 and lang = lang_pred")
    en = [x for x in docs.where("lang = 'en'").orderBy("doc_id").first().text.split() if x.isalpha()][:40]
    de = [x for x in docs.where("lang = 'de'").orderBy("doc_id").first().text.split() if x.isalpha()][:40]
    df = spark.createDataFrame([(1, " ".join(en + de))], "doc_id long, text string")
    tags = [r.lang_pred for r in fitted.words(df, "doc_id").orderBy("word_no").collect()]
    assert tags[: len(en)].count("en") >= 0.9 * len(en) and tags[len(en) :].count("de") >= 0.9 * len(de)


def test_edges(spark, fitted):
    rows = [(None, None), (1, ""), (2, "12 34 !?"), (3, "— · 😀"), (4, "the"), (5, "日本"), (5, "日本"), (6, "the and of " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS lang", "text AS rest")
    got = [(r.doc_id, r.lang_pred, r.score) for r in fitted.run(df, "doc_id").collect()]
    assert len(got) == len(rows)
    und = {i for i, name, _ in got if name == "und"}
    assert und == {None, 1, 2, 3}
    assert fitted.run(df.limit(0), "doc_id").count() == 0
    empty = langid.LanguageTagger().fit(df.limit(0))
    assert {r.lang_pred for r in empty.run(df, "doc_id").collect()} == {"und"}
    assert empty.words(df, "doc_id").where("lang_pred <> 'und'").count() == 0
