import datetime
import decimal
import math
import random

import numpy as np
import pytest

from profilark.functions.scalar import log_factorial, miss_chance, normal_below
from profilark.operators.order import running_sum
from profilark.plans import predicates


def test_values_at_ranks(spark):
    r = random.Random(4)
    rows = [(r.choice([5, 7, 10**15, -(10**17), r.randrange(10**6)]), r.choice([0.0, -1.5, 1e308, -1e308, math.inf, math.nan, 5e-324, r.random()]), datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=r.randrange(10**12)), datetime.date(2020, 1, 1) + datetime.timedelta(days=r.randrange(900)), decimal.Decimal(r.randrange(10**30)), None) for _ in range(700)]
    df = spark.createDataFrame(rows, "i long, f double, t timestamp, d date, n decimal(38,0), z int")
    for k, c in enumerate("iftdn"):
        values = sorted(x[k] for x in rows if x[k] == x[k])
        ranks = [0, 1, len(values) // 3, len(values) // 2, len(values) - 1]
        assert predicates.at_ranks(df, c, ranks) == [values[x] for x in ranks]
    q = predicates.choose_range(df, "i", 0.2, start=100)
    values = sorted(x[0] for x in rows)
    assert q.values == (values[100], values[239])
    with pytest.raises(ValueError):
        predicates.choose_range(df, "z", 0.1)


def test_range_query_does_not_sort(spark, small):
    df = spark.read.parquet(f"{small}/orders.parquet")
    seen = predicates.run(df, predicates.choose_range(df, "o_orderkey", 0.1, start=3))._jdf.queryExecution().toString()
    assert "Sort" not in seen and "Window" not in seen


def test_log_factorials_and_miss_chances():
    k = np.array([0, 1, 2, 9, 170, 12_345, 10**9])
    assert np.allclose(log_factorial(k), [math.lgamma(x + 1) for x in k], rtol=1e-13, atol=1e-13)
    for rows, drawn in ((10, 3), (50, 50), (1000, 1), (7, 0)):
        want = [math.comb(rows - m, drawn) / math.comb(rows, drawn) for m in range(rows + 1)]
        assert np.allclose(miss_chance(rows, drawn, np.arange(rows + 1)), want, rtol=1e-10, atol=1e-14)
    assert (miss_chance(3, 5, np.array([0, 1])) == 0).all()
    assert normal_below(0.0) == 0.5 and normal_below(-30.0) == pytest.approx(4.906713927148187e-198) and normal_below(1.96) == pytest.approx(0.9750021048517795)


def test_running_sums_of_several_columns(spark):
    df = spark.range(500).selectExpr("id AS o", "id % 7 AS a", "id * id % 11 AS b", "id % 2 AS k")
    got = running_sum(df, {"a": "x", "b": "y"}, None, ("k",), "o", chunk=16)
    assert set(got.columns) == {"o", "a", "b", "k", "x", "y"}
    for r in got.collect():
        mine = [j for j in range(r.o + 1) if j % 2 == r.k]
        assert (r.x, r.y) == (sum(j % 7 for j in mine), sum(j * j % 11 for j in mine))
