import pytest

from profilark.streaming.profile import StreamingProfiler


def test_exact_distinct_values_of_a_stream(spark, tmp_path):
    df = spark.range(5000).selectExpr("id", "id % 1700 AS v")

    def feed(p, ends):
        for a, b in zip(ends, ends[1:]):
            p.add(df.where(f"id >= {a} and id < {b}"), ["id"])
        return p

    p = feed(StreamingProfiler(distinct="exact", max_values=100), [0, 1000, 2000, 3000])
    p.save(str(tmp_path / "state"), spark)
    again = feed(StreamingProfiler(distinct="exact", max_values=100).load(str(tmp_path / "state"), spark), [3000, 5000])
    assert {r.column: r.n_unique for r in again.result().collect()} == {"id": 5000, "v": 1700}
    with pytest.raises(ValueError):
        StreamingProfiler().load(str(tmp_path / "state"), spark)
    with pytest.raises(ValueError):
        StreamingProfiler(distinct="some")
