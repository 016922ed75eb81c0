import math
import random

import numpy as np
import pyarrow as pa
import pytest

from profilark.functions.cluster import table
from profilark.llm import textscan as ts
from profilark.llm import windowlm as lm


@pytest.fixture(scope="module")
def model(spark, small):
    return lm.WindowLM().fit(table(spark, small, "documents"))


def test_held_out_prose_scores_above_its_shuffle(spark, small):
    docs = table(spark, small.replace("sf0.01", "sf0.1"), "documents")
    fitted = lm.WindowLM().fit(docs.where("doc_id % 5 != 0"))
    texts = [r.text for r in docs.where("doc_id % 5 = 0 and lang is not null and length(text) between 600 and 6000").orderBy("doc_id").limit(600).collect()]
    r = random.Random(1)
    rows = list(enumerate(texts))
    rows += [(1000 + k, " ".join(r.sample(t.split(), len(t.split())))) for k, t in enumerate(texts)]
    rows += [(2000 + k, " ".join("".join(r.choice("qxzjkv0123") for _ in w) for w in t.split())) for k, t in enumerate(texts)]
    got = {x.doc_id: x.mean_log_probability for x in fitted.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(texts)
    assert n >= 60
    assert sum(got[k] > got[1000 + k] for k in range(n)) >= 0.95 * n
    assert all(got[k] > got[2000 + k] for k in range(n))


def test_scores_do_not_depend_on_partitions(spark, small):
    docs = table(spark, small, "documents")
    scores = []
    for parts in (1, 8):
        own = docs.repartition(parts)
        scores.append({r.doc_id: r.mean_log_probability or 0.0 for r in lm.WindowLM(shard_words=100_000).fit(own).score(own).collect()})
    assert scores[0].keys() == scores[1].keys()
    assert max(abs(scores[0][k] - scores[1][k]) for k in scores[0]) <= 0.001


def _member(v, w, i):
    """Member and beginning of one word, by its bytes."""
    at = np.flatnonzero(v.frequent == w.hash[i])
    if len(at):
        return int(v.place[at[0]]), None
    b = bytes(w.buf[w.start[i] : w.end[i]]).lower() if bytes(w.buf[w.start[i] : w.end[i]]).isascii() else bytes(ts.LOWER[w.buf[w.start[i] : w.end[i]]])
    last, before, second = b[-1], b[-2] if len(b) > 1 else 0, b[1] if len(b) > 1 else 0
    return (last * 31 + before * 7) % (v.leaves - v.own) + v.own, (b[0] * 5 + second * 3) % lm.HEADS


def test_sums_equal_word_by_word(spark, model):
    text = "The of and thing, the to. Que de la Über x"
    w, v = ts.words(pa.array([text])), model.vocabulary
    embed, first, b1, w2, b2, w3, b3, w4, b4 = (p.astype(float) for p in model.network.parts)
    known = [_member(v, w, i) for i in range(len(w.hash))]
    lse = lambda z: np.log(np.exp(z - z.max()).sum()) + z.max()
    total = 0.0
    for i, (member, head) in enumerate(known):
        h = b1.copy()
        for k, s in enumerate(lm.SIDES):
            h += embed[known[i + s][0] if 0 <= i + s < len(known) else v.leaves] @ first[k]
        h = np.tanh(h)
        g, m = divmod(member, v.side)
        z, y = h @ w2 + b2, h @ w3[g] + b3[g]
        total += z[g] - lse(z) + y[m] - lse(y)
        if head is not None:
            own = v.heads[member - v.own]
            x = h @ w4 + b4 + np.log((own + 0.5) / (own.sum() + 0.5 * lm.HEADS))
            at = np.flatnonzero(v.words == w.hash[i])
            n = float(v.counts[at[0]]) if len(at) else 0.0
            total += x[head] - lse(x) + min(0.0, math.log((n + 0.5) / (max(own[head], n) + 1)))
    got = model.score(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_words == len(text.split()) and got.log_probability == pytest.approx(total, abs=0.01)


def test_probabilities_sum_to_one(model):
    """Over all members, and over all beginnings of a shared member, in some windows."""
    v, net = model.vocabulary, model.network
    r = np.random.default_rng(4)
    for _ in range(3):
        context = np.repeat(r.integers(0, v.leaves + 1, (1, len(lm.SIDES))), v.leaves, 0)
        alone = net.log_probability(context, np.arange(v.leaves), np.full(v.leaves, -1), net.tables())
        assert np.exp(alone).sum() == pytest.approx(1, abs=1e-4)
        member = np.full(lm.HEADS, v.leaves - 1)
        both = net.log_probability(context[: lm.HEADS], member, np.arange(lm.HEADS), net.tables())
        assert np.exp(both).sum() == pytest.approx(np.exp(alone[-1]), rel=1e-4)


def test_the_window_reaches_rare_words(model):
    """A word that shares its member is scored otherwise between other neighbours."""
    v, net = model.vocabulary, model.network
    member, head = np.full(2, v.leaves - 1), np.full(2, 3)
    context = np.array([[0, 1, 2, 3], [v.leaves] * 4])
    a, b = net.log_probability(context, member, head, net.tables()) - net.log_probability(context, member, np.full(2, -1), net.tables())
    assert abs(a - b) > 1e-3


def test_gradient():
    r = np.random.default_rng(0)
    side = lm.side_of(100)
    heads = r.integers(1, 9, (side * side // 4, lm.HEADS)).astype(float)
    v = lm.Vocabulary(side, side * side * 3 // 4, *(np.zeros(0, np.uint64),) * 3, np.zeros(0), np.ones(side * side), heads)
    context, member = r.integers(0, v.leaves + 1, (40, 4)), r.integers(0, v.leaves, 40)
    head = np.where(member >= v.own, r.integers(0, lm.HEADS, 40), -1)
    loss = lambda flat: -lm.Network(v, flat).log_probability(context, member, head, lm.Network(v, flat).tables()).mean()
    net = lm.Network(v, seed=1)
    before, state = net.flat.astype(np.float64), np.full(net.flat.size, 1e12, np.float32)
    net.train(context, member, head, state, rate=1e6)
    grad = before - net.flat  # rate / sqrt(state) = 1
    for a, e in net.cuts:
        some = a + np.flatnonzero(np.abs(grad[a:e]) > 1e-3)
        assert len(some)
        for k in r.choice(some, min(8, len(some)), replace=False):
            d = np.zeros(before.size)
            d[k] = 1e-2
            assert (loss(before + d) - loss(before - d)) / 2e-2 == pytest.approx(grad[k], rel=0.05, abs=2e-3)


class Shared:
    def __init__(self, value):
        self.value = value


def test_every_word_is_a_training_target_once(model):
    texts = ["one", "two short words", "the of and " * 40_000, "", None, "the end"]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0, 0, 0, 0, 3], pa.int32()), pa.array(texts, pa.string())], names=["shard", "text"])
    flat = model.network.flat
    got = [b.column(1)[0].as_py() for b in lm._train(Shared((model.vocabulary, flat, np.zeros_like(flat))))([batch.slice(0, 2), batch.slice(2)])]
    assert got == [1 + 3 + 120_000, 2]


def test_training_raises_the_likelihood(spark, small, model):
    docs = table(spark, small, "documents").where("lang = 'en'").limit(100)
    start = lm.WindowLM()
    start.vocabulary, start.network = model.vocabulary, lm.Network(model.vocabulary).start()
    mean = lambda m: m.score(docs).selectExpr("sum(log_probability) / sum(n_words)").first()[0]
    assert mean(model) > mean(start) + 0.2


def test_words_out_of_memory_are_joined_by_exact_count(spark, small, model):
    docs = table(spark, small, "documents").limit(200)
    tight = lm.WindowLM(in_memory=100).fit(table(spark, small, "documents"))
    tight.network = model.network
    assert model.beyond is None and tight.beyond is not None and len(tight.vocabulary.words) == 100
    want = sorted((r.doc_id, r.n_words, r.log_probability) for r in model.score(docs).collect())
    got = sorted((r.doc_id, r.n_words, r.log_probability) for r in tight.score(docs).collect())
    assert [g[:2] for g in got] == [x[:2] for x in want] and np.allclose([g[2] for g in got], [x[2] for x in want], atol=0.05)


def test_counts_are_exact_and_members_follow_the_vocabulary(spark, small, model):
    v = model.vocabulary
    words = table(spark, small, "documents").selectExpr("explode(filter(split(lower(text), '[ \\t-\\r]+'), x -> x <> '')) AS w").groupBy("w").count().collect()
    by = {r.w: r["count"] for r in words if r.w.isascii()}
    some = sorted(by)[:: max(1, len(by) // 500)]
    w = ts.words(pa.array([" ".join(some)]))
    member, head = lm.members(v, w)
    at, hit = lm.found(v.words, w.hash)
    assert all(hit[k] and v.counts[at[k]] == by[x] if head[k] >= 0 else v.totals[member[k]] == by[x] for k, x in enumerate(some))
    assert v.totals.sum() == sum(r["count"] for r in words) and v.heads.sum() == v.totals[v.own :].sum()
    assert lm.side_of(100) == lm.LEAST_SIDE and lm.side_of(10**9) == 268


def test_edges(spark, model):
    rows = [(None, None), (1, ""), (2, " \n"), (3, "the"), (3, "the"), (4, "of the and " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'w' AS weights", "'x' AS `a.b`")
    got = sorted(((r.doc_id, r.n_words, r.mean_log_probability is None) for r in model.score(df).collect()), key=repr)
    assert got == sorted([(None, 0, True), (1, 0, True), (2, 0, True), (3, 1, False), (3, 1, False), (4, 150_000, False)], key=repr)
    assert model.score(df.limit(0)).count() == 0
    empty = lm.WindowLM().fit(df.limit(0))
    assert empty.score(df).count() == len(rows)
    nameless = spark.createDataFrame([(None, f"w{k} and the other {k}") for k in range(300)], "doc_id long, text string")
    assert lm.WindowLM(shard_words=200).fit(nameless).score(nameless).where("mean_log_probability < 0").count() == 300
