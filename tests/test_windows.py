import numpy as np
import pytest

from profilark.operators import sequence
from profilark.operators.sequence import MinMaxIndex, SetIndex
from profilark.plans import recommend


def test_sliding_extremes():
    x = np.random.default_rng(1).integers(-50, 50, 97)
    for w in (1, 2, 7, 64, 96, 97):
        for f, fill in ((np.minimum, 99), (np.maximum, -99)):
            assert sequence.sliding(x, w, f, fill).tolist() == [f.reduce(x[k : k + w]) for k in range(len(x) - w + 1)]
    assert sequence.square_sum(np.array([3, (1 << 21) + 5, (1 << 39) + 7])) == 9 + ((1 << 21) + 5) ** 2 + ((1 << 39) + 7) ** 2
    assert sequence.square_sum(np.array([1 << 41, 1])) == (1 << 82) + 1


def test_windows_over_chunks(spark, monkeypatch):
    rows = [(i, None if i % 11 == 3 or 40 <= i < 60 else (i * 37 + i // 9) % 23) for i in range(200)]
    df = spark.createDataFrame(rows, "o long, v int")
    techniques = [kind(index_granularity=g, **more) for g in (1, 5, 16, 150) for kind, more in ((MinMaxIndex, {}), (SetIndex, {"max_size": 4}), (SetIndex, {"max_size": 0}))]
    halo = sequence.with_halo
    monkeypatch.setattr(sequence, "with_halo", lambda *a: halo(*a, chunk=16))
    together = sequence.measure(sequence.Ranked(sequence.with_ordinal(df, ["o"]), "v", 200), techniques)
    v, count = [x for _, x in rows], {x: [y for _, y in rows].count(x) for _, x in rows if x is not None}
    nn, d = sum(count.values()), len(count)
    for t, got in zip(techniques, together):
        w, skipped, values, sizes = t.window_rows, [], [], []
        for s in range(200 - w + 1):
            own = {x for x in v[s : s + w] if x is not None}
            held = own if isinstance(t, SetIndex) else {x for x in count if own and min(own) <= x <= max(own)}
            sizes.append(len(set(v[s : s + w])))
            full = isinstance(t, SetIndex) and t.max_size and sizes[-1] > t.max_size
            skipped.append(0 if full else nn - sum(count[x] for x in held))
            values.append(0 if full else d - len(held))
        assert got["n_windows"] == len(skipped)
        for key, want, den in (("skip_rows", skipped, nn), ("skip_values", values, d)):
            assert got[f"{key}_mean"] == pytest.approx(np.mean(want) / den, abs=1e-12) and got[f"{key}_std"] == pytest.approx(np.std(want) / den, abs=1e-9)
        if isinstance(t, SetIndex):
            assert (got["window_distinct_max"], got["window_distinct_mean"]) == (max(sizes), pytest.approx(np.mean(sizes)))
        alone = t.add({"f": df}, {"f": ["o"]}).result([(("f", "v"),)]).first()
        assert all(alone[k] == pytest.approx(x) for k, x in got.items())


def test_more_windows_need_no_more_tables(spark, monkeypatch):
    df = spark.createDataFrame([(i, i // 40, (i * 7919) % 50) for i in range(2000)], "o long, a long, b long")
    made = []
    for module in (sequence, recommend):
        own = getattr(module, "materialize", None)
        monkeypatch.setattr(module, "materialize", lambda *a, own=own: made.append(1) or own(*a), raising=False)
    sizes = []
    for granularities in ((1,), (1, 2, 4)):
        made.clear()
        recommend.OneShotRecommender(index_granularity=50, skip_granularities=granularities, set_max_sizes=(20, 40)).add(df, ["o"]).result()
        sizes.append(len(made))
    assert sizes[0] == sizes[1] <= 4  # the ordered rows, and the ranks of each column
