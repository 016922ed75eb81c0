import pytest

from profilark.llm.mixing import SourceMix, targets


def waterfill(sizes, weights, most=3):
    goal, free, left = {}, dict(sizes), sum(sizes.values())
    while free:
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total > most * sizes[s]]
        if not over:
            return goal | {s: left * weights[s] / total for s in free}
        for s in over:
            goal[s] = most * sizes[s]
        left -= sum(goal[s] for s in over)
        for s in over:
            del free[s]
    return goal


def test_targets_are_reshared(spark):
    sizes = {"a": 100, "b": 5, "c": 10, "d": 3000, "é": 1, "z": 0, None: 7}
    rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    order = sorted((k for k in sizes if k is not None), key=lambda x: x.encode()) + [None]
    want = waterfill(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)})
    got = {r.source: r.target for r in targets(rows).collect()}
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_plan_and_mix(spark):
    rows = [(i, " ".join(["w"] * (i * 7919 % 60)), "big" if i % 3 else f"s{i % 5}", i) for i in range(900)] + [(None, None, None, 1), (3, "a b c", None, 2), (3, "a b c", None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    mix = SourceMix()
    plan = mix.plan(df).collect()
    assert len(plan) == len(rows)
    sums = {}
    for r in plan:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        sums[r.source_size, r.target] = sums.get((r.source_size, r.target), 0) + r.taken
    assert all(abs(v - t) <= 3 * 60 for (_, t), v in sums.items())
    again = mix.plan(df.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, plan))
    mixed = mix.run(df)
    assert mixed.columns == [*df.columns, "copy"] and mixed.count() == sum(r.copies for r in plan)
    assert mix.plan(df.limit(0)).count() == 0 and mix.run(df.limit(0)).count() == 0
