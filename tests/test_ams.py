import math

import pytest
from pyspark.sql import functions as F

from profilark.operators import ams
from profilark.operators.order import ORD


def test_rows_from_each_sample(spark):
    rows = [(i, "a" if i % 3 else "b" if i % 2 else f"c{i // 40}") for i in range(400)]
    df = spark.createDataFrame(rows, f"{ORD} long, v string")
    at = sorted({i * i * 7 % 400 for i in range(60)} | {0, 399})
    picked = df.where(F.col(ORD).isin(at)).select(F.col(ORD).alias("at"), "v")
    want = {x: sum(v == rows[x][1] for _, v in rows[x:]) for x in at}
    for stretch in (1, 6, 50, 400):
        got = ams.rows_from(df, picked, stretch).collect()
        assert len(got) == len(at) and {r["at"]: r["r"] for r in got} == want


def test_estimates_by_hand(spark):
    n, samples = 1200, 300
    df = spark.range(n).select(F.col("id").alias(ORD), (F.col("id") % 4).alias("v"))
    at = [r[0] for r in df.orderBy(F.xxhash64(F.lit(0), ORD)).limit(samples).select(ORD).collect()]
    f = lambda r: r / n * math.log2(n / r) if r else 0.0
    r = [(n - 1 - x) // 4 + 1 for x in at]
    assert ams.ams_entropy(df, ("v",), samples).first()["h"] == pytest.approx(sum(n * (f(x) - f(x - 1)) for x in r) / samples, abs=1e-9)
    # all rows as samples: the sum telescopes to the entropy itself
    assert ams.ams_entropy(df, ("v",), n).first()["h"] == pytest.approx(2, abs=1e-9)
    skew = spark.range(300).select(F.col("id").alias(ORD), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("v"))
    want = -0.9 * math.log2(0.9) + 0.1 * math.log2(300)
    assert ams.ams_entropy(skew, ("v",), 300).first()["h"] == pytest.approx(want, abs=1e-9)
