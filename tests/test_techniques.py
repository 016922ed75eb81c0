"""Techniques against brute force on small frames with nulls, NaN, negative zero and ties."""

import math
import random
from collections import Counter

import pytest

from profilark.functions import scalar
from profilark.operators.ams import MarginalEntropyAms, PairwiseEntropyAms, ThreewayEntropyAms
from profilark.operators.cardinality import DistinctCount, PopulationCardinality, TopK, score_top_k
from profilark.operators.describe import Describe
from profilark.operators.entropy import MarginalEntropy, PairwiseEntropy, ThreewayEntropy
from profilark.operators.integers import Delta, Gcd
from profilark.operators.pairs import AdjustedRand, ChiSquared
from profilark.operators.sequence import MinMaxIndex, RunsTest, SetIndex
from profilark.operators.sets import Membership, Similarity


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = []
    for i in range(300):
        f = r.choice([None, 0.0, -0.0, float("nan"), 1.5, float(r.randrange(5))])
        out.append((i, r.choice([None, r.randrange(-6, 7)]), f, r.choice([None, "a", "b", "cc", "ä"]), i // 20, r.choice([True, False, None])))
    return out


NAMES = ["o", "i", "f", "s", "c", "b"]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "o long, i long, f double, s string, c int, b boolean").repartition(5)


def key(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else 0.0 if v == 0 and isinstance(v, float) else v


def by_col(technique, frame, columns, order=True):
    technique.add({"f": frame}, {"f": ["o"]} if order else None)
    return {r["col_a"]: r for r in technique.result([(("f", c),) for c in columns]).collect()}


def entropy(values):
    n = len(values)
    return -sum(k / n * math.log2(k / n) for k in Counter(values).values())


def test_entropies(frame, rows):
    cols = {n: [key(r[k]) for r in rows] for k, n in enumerate(NAMES)}
    got = by_col(MarginalEntropy(), frame, NAMES)
    assert all(got[n]["h"] == pytest.approx(entropy(cols[n])) and got[n]["n_rows"] == 300 for n in NAMES)
    pair = PairwiseEntropy().add({"f": frame}).result([(("f", "i"), ("f", "s"))]).first()
    hi, hs, both = entropy(cols["i"]), entropy(cols["s"]), entropy(list(zip(cols["i"], cols["s"])))
    assert pair.h_ab == pytest.approx(both) and pair.mi == pytest.approx(hi + hs - both) and pair.nmi == pytest.approx((hi + hs - both) / min(hi, hs))
    three = ThreewayEntropy().add({"f": frame}).result([(("f", "i"), ("f", "s"), ("f", "b"))]).first()
    assert three.h_abc == pytest.approx(entropy(list(zip(cols["i"], cols["s"], cols["b"]))))


def test_sampled_entropies(spark, frame, rows):
    got = by_col(MarginalEntropyAms(num_samples=2000), frame, ["i", "s"])
    assert got["i"]["h"] == pytest.approx(entropy([r[1] for r in rows]), rel=0.05)
    skew = spark.createDataFrame([(i, "x" if i % 20 else str(i)) for i in range(2000)], "o long, s string")
    assert by_col(MarginalEntropyAms(num_samples=500), skew, ["s"])["s"]["h"] == pytest.approx(entropy(["x" if i % 20 else str(i) for i in range(2000)]), rel=0.05)
    pair = PairwiseEntropyAms(num_samples=2000).add({"f": frame}, {"f": ["o"]}).result([(("f", "i"), ("f", "s"))]).first()
    assert pair.h_ab == pytest.approx(entropy([(r[1], r[3]) for r in rows]), rel=0.05)
    three = ThreewayEntropyAms(num_samples=2000).add({"f": frame}, {"f": ["o"]}).result([(("f", "i"), ("f", "s"), ("f", "b"))]).first()
    assert three.h_abc == pytest.approx(entropy([(r[1], r[3], r[5]) for r in rows]), rel=0.05)


def test_counts(frame, rows):
    got = by_col(DistinctCount(), frame, NAMES, order=False)
    for k, n in enumerate(NAMES):
        values = [key(r[k]) for r in rows if r[k] is not None]
        assert (got[n]["n_non_null"], got[n]["n_distinct"]) == (len(values), len(set(values)))
    sketch = by_col(DistinctCount(method="hll"), frame, ["o", "i"], order=False)
    assert sketch["o"]["low"] <= 300 <= max(sketch["o"]["high"], 300) and sketch["o"]["n_distinct"] == pytest.approx(300, rel=0.03)
    top = by_col(TopK(k=3), frame, ["s", "i"])
    first, count = {}, Counter()
    for r in rows:
        if r[1] is not None:
            first.setdefault(r[1], r[0])
            count[r[1]] += 1
    want = sorted(count, key=lambda v: (-count[v], first[v]))[:3]
    assert [(x["value"], x["count"]) for x in top["i"]["top_k"]] == [(str(v), count[v]) for v in want]
    saving = by_col(TopK(k=3, method="space_saving", counters=8), frame, ["i"])["i"]["top_k"]
    scores = score_top_k([(x["value"], x["count"], x["error"]) for x in saving], {str(k): v for k, v in count.items()}, 3)
    assert scores["bound_violation"] == 0


def test_population(spark):
    r = random.Random(8)
    rows = [(i, r.randrange(400)) for i in range(3000)]
    got = by_col(PopulationCardinality(seed=5), spark.createDataFrame(rows, "o long, v long"), ["v"])["v"]
    count, mask = Counter(v for _, v in rows), {}
    import numpy as np

    part = scalar.splitmix64(5, np.arange(3000)) % np.uint64(3)
    for i, v in rows:
        mask[v] = mask.get(v, 0) | 1 << int(part[i])
    d, f1, f2 = len(count), sum(c == 1 for c in count.values()), sum(c == 2 for c in count.values())
    assert (got.n_distinct, got.f1, got.f2) == (d, f1, f2)
    h = Counter(mask.values())
    s1, s2, s3 = (sum(h[m] for m in range(1, 8) if m >> k & 1) for k in range(3))
    r2, r3, u = h[3] + h[7], h[5] + h[6] + h[7], d - h[4]
    assert got.schnabel == pytest.approx((s2 * s1 + s3 * u) / (r2 + r3 + 1)) and got.schnabel_low < got.schnabel < got.schnabel_high
    assert 300 < got.chao1 < 500


def test_gcd_and_delta(spark, frame, rows):
    from fractions import Fraction

    odd = spark.createDataFrame([(0, 12, -(2**63), None), (1, -18, 0, None), (2, None, 2**62, None), (3, 0, 2**63 - 1, None), (4, 30, -1, None)], "o long, g long, w long, n long")
    got = by_col(Gcd(), odd, ["g", "w", "n"], order=False)
    assert [int(got[c]["gcd"]) for c in "gwn"] == [6, 1, 0] and got["g"]["gcd_compressible"] and not got["n"]["gcd_compressible"]

    def sig(v):
        return 0 if v == 0 else next(k for k in range(1, 10) if k == 9 or -(1 << 8 * k - 1) <= v < 1 << 8 * k - 1)

    for df, name, x in ((frame, "i", [r[1] for r in rows if r[1] is not None]), (odd, "w", [-(2**63), 0, 2**62, 2**63 - 1, -1])):
        r = by_col(Delta(), df, [name])[name]
        d = [b - a for a, b in zip(x, x[1:])]
        dd = [b - a for a, b in zip(d, d[1:])]
        assert (r.n_deltas, int(r.delta_min), int(r.delta_max), int(r.double_delta_min), int(r.double_delta_max)) == (len(d), min(d), max(d), min(dd), max(dd))
        assert r.delta_bytes_mean == pytest.approx(sum(map(sig, d)) / len(d)) and r.zero_delta_fraction == pytest.approx(d.count(0) / len(d))
        assert r.delta_entropy == pytest.approx(entropy(d)) and r.double_delta_entropy == pytest.approx(entropy(dd))
        pairs = [sig(b - a) for k, a in enumerate(x) for m, b in enumerate(x) if k != m]
        assert r.expected_delta_bytes_mean == pytest.approx(float(Fraction(sum(pairs), len(pairs))))
    none = by_col(Delta(), odd, ["n"])["n"]
    assert none.n_deltas == 0 and none.delta_min is None and math.isnan(none.delta_entropy)


def test_runs(frame, rows):
    got = by_col(RunsTest(), frame, NAMES)
    for k, n in enumerate(NAMES):
        v = [key(r[k]) for r in rows]
        runs = 1 + sum(a != b for a, b in zip(v, v[1:]))
        assert got[n]["n_runs"] == runs and got[n]["mean_run_length"] == pytest.approx(300 / runs)
    assert math.isnan(got["o"]["z"]) and got["c"]["p_value"] < 1e-9


def test_skip_indexes(frame, rows):
    w = 7
    low = by_col(MinMaxIndex(index_granularity=w), frame, NAMES)
    sets = by_col(SetIndex(index_granularity=w, max_size=3), frame, NAMES)
    for k, n in enumerate(NAMES):
        v = [key(r[k]) for r in rows]
        order = lambda x: (1, 0) if x == "nan" else (0, x)
        count = Counter(x for x in v if x is not None)
        skip, skip_set, entries = [], [], []
        for s in range(len(v) - w + 1):
            own = [x for x in v[s : s + w] if x is not None]
            inside = [x for x in count if own and min(map(order, own)) <= order(x) <= max(map(order, own))]
            skip.append((sum(c for x, c in count.items() if x not in inside), len(count) - len(inside)))
            e = set(v[s : s + w])
            entries.append(len(e))
            skip_set.append((0, 0) if len(e) > 3 else (sum(c for x, c in count.items() if x not in e), len([x for x in count if x not in e])))
        nn, d, m = sum(count.values()), len(count), len(skip)
        assert low[n]["n_windows"] == m and low[n]["skip_rows_mean"] == pytest.approx(sum(a for a, _ in skip) / m / nn)
        assert low[n]["skip_values_mean"] == pytest.approx(sum(b for _, b in skip) / m / d)
        assert sets[n]["skip_rows_mean"] == pytest.approx(sum(a for a, _ in skip_set) / m / nn) and sets[n]["skip_values_mean"] == pytest.approx(sum(b for _, b in skip_set) / m / d)
        assert sets[n]["window_distinct_mean"] == pytest.approx(sum(entries) / m) and sets[n]["window_distinct_max"] == max(entries)
        assert sets[n]["overflow_fraction"] == pytest.approx(sum(e > 3 for e in entries) / m)


def test_random_order_baselines(spark):
    r = random.Random(3)
    values = [1] * 12 + [2] * 6 + [3, 4, 5, 6] + [None] * 5
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "o long, v long")
    low = by_col(MinMaxIndex(index_granularity=4), df, ["v"])["v"]
    full = by_col(SetIndex(index_granularity=4, max_size=0), df, ["v"])["v"]
    hit_low = hit_set = distinct = trials = 0
    count = Counter(v for v in values if v)
    for _ in range(6000):
        own = r.sample(values, 4)
        real = [x for x in own if x]
        hit_low += sum(c for x, c in count.items() if not real or not min(real) <= x <= max(real)) / sum(count.values())
        hit_set += sum(c for x, c in count.items() if x not in own) / sum(count.values())
        distinct += len(set(own))
        trials += 1
    assert low.expected_skip_rows == pytest.approx(hit_low / trials, abs=0.02)
    assert full.expected_skip_rows == pytest.approx(hit_set / trials, abs=0.02) and full.expected_window_distinct == pytest.approx(distinct / trials, abs=0.05)


def test_association(spark):
    r = random.Random(6)
    rows = [(a := r.choice("xyz"), a if r.random() < 0.7 else r.choice("pq"), None if r.random() < 0.1 else a, 1) for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, b string, c string, k int")
    t = ChiSquared().add({"f": df})
    got = {(x.col_a, x.col_b): x for x in t.result().collect()}
    cells = Counter((x[0], x[1]) for x in rows)
    ra, cb = Counter(x[0] for x in rows), Counter(x[1] for x in rows)
    stat = sum((cells[i, j] - ra[i] * cb[j] / 400) ** 2 / (ra[i] * cb[j] / 400) for i in ra for j in cb)
    assert got["a", "b"].chi2_stat == pytest.approx(stat) and got["a", "b"].p_value < 1e-9 and got["a", "b"].associated
    assert math.isnan(got["a", "k"].chi2_stat) and math.isnan(got["a", "k"].p_value)
    assert scalar.gamma_q(1.0, 3.0) == pytest.approx(math.exp(-3)) and scalar.gamma_q(0.5, 2.0) == pytest.approx(math.erfc(math.sqrt(2)))
    ari = {(x.col_a, x.col_b): x for x in AdjustedRand().add({"f": df}).result().collect()}
    assert ari["a", "c"].ari == pytest.approx(1.0) and ari["a", "c"].same_partition and ari["a", "c"].n_valid == sum(x[2] is not None for x in rows)


def test_value_sets(spark):
    a = spark.createDataFrame([(k, f"n{k}") for k in range(100)], "id int, name string")
    b = spark.createDataFrame([(k % 50, f"n{k % 60}") for k in range(200)] + [(None, None)], "a_id long, other string")
    keys = [(("a", "id"), ("b", "a_id")), (("a", "name"), ("b", "other")), (("a", "id"), ("b", "other"))]
    got = [r for r in Membership().add({"a": a, "b": b}).result(keys).orderBy("nth").collect()]
    assert [(r.ratio_a_in_b, r.ratio_b_in_a, r.relationship) for r in got[:2]] == [(0.5, 1.0, "pk_fk"), (0.6, 1.0, "pk_fk")]
    assert got[2].status == "ineligible" and got[2].ratio_a_in_b is None
    bloom = Membership(method="bloom").add({"a": a, "b": b}).result(keys).orderBy("nth").collect()
    assert bloom[0].ratio_b_in_a == 1.0 and 0.5 <= bloom[0].ratio_a_in_b <= 0.6
    sim = Similarity().add({"a": a, "b": b}).result(keys).orderBy("nth").collect()
    assert (sim[0].jaccard, sim[0].overlap) == (0.5, 1.0)
    near = Similarity(method="minhash").add({"a": a, "b": b}).result(keys).orderBy("nth").collect()
    assert all(x.status in ("computed", "pruned") for x in near[:2]) and all(x.jaccard in (None, y.jaccard) for x, y in zip(near, sim))


def test_describe(spark):
    rows = [(0, "007", 1.5, "2024-02-29", [1, 2], b"\x01", None), (1, "-12", float("nan"), "2023-02-29", [], b"\x01\x02", None), (2, "3.140", -0.0, "12:30:00.250", None, None, None), (3, None, 0.0, "2024-01-02T00:00:00+01:00", [2, None], b"", None), (4, "3.140", float("inf"), "2024-01-02 00:00", [7], b"\x01", None), (5, "x\n", 1e-7, None, [1], b"\x01", None)]
    df = spark.createDataFrame(rows, "o long, n string, f double, d string, l array<int>, y binary, z string")
    got = by_col(Describe(sizes=True), df, ["o", "n", "f", "d", "l", "y", "z"])
    n = got["n"]
    assert (n.n_rows, n.n_null, n.n_unique, n.n_numeric, n.n_numeric_int, n.n_leading_zero, int(n.numeric_int_min), int(n.numeric_int_max)) == (6, 1, 4, 4, 2, 1, -12, 7)
    assert (n.numeric_max_frac_digits, n.numeric_max_sig_digits, n.sum_len, n.sum_len_unique) == (2, 3, 18, 13)
    f = got["f"]
    assert (f.n_nan, f.n_inf, f.n_fractional, f.max_frac_digits, f.n_f32_inexact, f.n_unique, f.min) == (1, 1, 2, 7, 1, 5, "-0.0")
    d = got["d"]
    assert (d.n_iso_date, d.n_iso_time, d.n_iso_datetime, d.n_iso_datetime_tz, d.iso_n_offsets, d.iso_n_midnight, d.iso_max_frac_digits, d.iso_max_sig_frac_digits) == (1, 1, 1, 1, 1, 2, 3, 2)
    inner = got["l"]
    assert (inner.min_len, inner.max_len, inner.inner_n_values, inner.inner_n_null, inner.inner_n_unique, inner.inner_min, inner.inner_max) == (0, 2, 6, 1, 3, "1", "7")
    assert got["z"]["class"] == "null" and got["o"]["class"] == "ordinal" and got["y"].min_len == 0 and got["o"].size_bytes > 0


def test_contract(spark, frame):
    t = MarginalEntropy().add({"f": frame.select("i", "s")})
    with pytest.raises(ValueError):
        t.add({"f": frame})
    for bad in ([(("f", "i"), ("f", "s"))], [(("f", "x"),)], [(("f", "i"),), (("f", "i"),)]):
        with pytest.raises(ValueError):
            t.result(bad)
    with pytest.raises(ValueError):
        RunsTest().add({"f": frame})
    assert t.agreement(t.result(), t.result()) == [] and t.accuracy(t.result(), t.result())["h_max"] == 0
    empty = MarginalEntropy().add({"e": frame.limit(0)}).result().collect()
    assert {r.status for r in empty} == {"ineligible"} and all(r.h is None for r in empty)
