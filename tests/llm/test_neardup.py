import random

import pytest

from profilark.functions.cluster import table
from profilark.llm import neardup
from profilark.llm.graph import components
from profilark.llm.queries import queries
from tests.llm import brute


def as_dict(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query_equals_brute_force(spark, small):
    query = next(f for k, f in queries().items() if k.startswith("op6_"))
    got = query(spark, small)
    rows = [(r.doc_id, r.text) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    want = brute.near_duplicates(rows, 4, 80)
    assert as_dict(got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_chains_hubs_and_copies(spark):
    """A hub whose variants are not similar to each other, exact copies of it, and a chain."""
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = [(100 + k, " ".join(base)) for k in range(30)]
    for k in range(20):
        v = base[:]
        v[6 * k : 6 * k + 5] = [f"x{k}{j}" for j in range(5)]
        rows.append((k, " ".join(v)))
    step = base[::-1]
    for k in range(15):
        step = step[8:] + [f"y{k}{j}" for j in range(8)]
        rows.append((200 + k, " ".join(step)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_dict(neardup.near_duplicates(df, shingle=4)) == brute.near_duplicates(rows, 4, 80)


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t", None), (4, "One two", "b"), (5, "one  TWO", "b"), (6, "one", "c"), (None, "one two", "d"), (7, "one", None), (7, "one", None), (8, "ÉÀ x y z", "k"), (9, "éà x y z", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long" if False else "doc_id long, text string, s0 string")
    got = sorted((tuple(r) for r in neardup.near_duplicates(df, shingle=4).collect()), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (None, 1, None, True), (7, 1, 6, False), (7, 1, 6, False), (8, 1, 8, True), (9, 1, 9, True)]
    assert got == sorted(want, key=str)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(40)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == brute.components({x for e in real for x in e}, real)


def test_cutoffs_prune_with_the_posterior():
    cut = neardup.posterior_cutoffs(0.8, 1e-6)
    assert cut == sorted(cut) and 0 < cut[-1] < 0.8 * neardup.PERMUTATIONS
    assert neardup.miss_probability(0.8) < 1e-7
    with pytest.raises(ValueError):
        neardup.NearDuplicates(shingle=1)
