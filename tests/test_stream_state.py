import math

from pyspark.sql import types as T

from profilark.operators.pick import pick, stratum
from profilark.plans import cells
from profilark.streaming import profile as sp


def batches(spark, path, first, many):
    for k in range(first, first + many):
        spark.range(100 * k, 100 * k + 100).selectExpr("id AS o", "id % 7 AS v", "cast(id / 4 AS double) AS f", "concat('k', id % 3) AS s", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS t").coalesce(1).write.mode("append").parquet(path)


def run(spark, source, checkpoint):
    p = sp.StreamingProfiler()
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = p.attach(stream, ["o"], checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return {r["column"]: r.asDict() for r in p.result().collect()}


def test_a_restarted_stream_goes_on_from_its_state(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "check")
    batches(spark, source, 0, 3)
    first = run(spark, source, checkpoint)
    assert first["v"]["n_rows"] == 300
    batches(spark, source, 3, 2)
    again = run(spark, source, checkpoint)  # a new profiler, as after a crash of the driver
    once = {r["column"]: r.asDict() for r in sp.StreamingProfiler().add(spark.read.parquet(source), ["o"]).result().collect()}
    skip = {"exemplar_row", "n_sampled_blocks"}
    assert {c: {k: x for k, x in r.items() if k not in skip} for c, r in again.items()} == {c: {k: x for k, x in r.items() if k not in skip} for c, r in once.items()}
    assert again["o"]["n_rows"] == 500 and again["o"]["max"] == "499"


def test_prove():
    whole = {"n_rows": 10, "n_null": 2, "min": 0, "max": 300}
    assert sp.prove("uint16", whole, T.LongType()) is None and "do not fit" in sp.prove("uint8", whole, T.LongType()) and "do not fit" in sp.prove("int8", whole, T.LongType())
    real = {"n_rows": 5, "n_null": 0, "min": 0.25, "max": 12.5, "n_nan": 0, "n_inf": 0, "n_fractional": 2, "n_f32_inexact": 0, "max_frac_digits": 2}
    assert sp.prove("float", real, T.DoubleType()) is None and sp.prove("decimal128(4, 2)", real, T.DoubleType()) is None
    assert sp.prove("decimal128(4, 1)", real, T.DoubleType()) and sp.prove("uint8", real, T.DoubleType()) and sp.prove("float", real | {"n_f32_inexact": 1}, T.DoubleType()) and sp.prove("uint8", real | {"n_nan": 1, "n_fractional": 0}, T.DoubleType())
    text = {"n_rows": 4, "n_null": 0, "n_unique": 4, "min": "1", "max": "9.50", "n_numeric": 4, "n_numeric_int": 2, "n_leading_zero": 0, "numeric_int_min": 1, "numeric_int_max": 3, "numeric_max_frac_digits": 2, "numeric_max_int_digits": 1, "numeric_max_sig_digits": 3, "n_iso_date": 0, "n_iso_time": 0, "n_iso_datetime": 0, "n_iso_datetime_tz": 0}
    assert sp.prove("decimal128(3, 2)", text, T.StringType()) is None and sp.prove("uint8", text, T.StringType()) and sp.prove("date32", text, T.StringType()) and sp.prove("double", text, T.StringType()) is None
    assert sp.prove("uint8", text | {"n_numeric_int": 4, "numeric_int_max": 300}, T.StringType()) and sp.prove("float", text | {"n_leading_zero": 1}, T.StringType())
    time = {"n_rows": 3, "n_null": 0, "gcd": 2000, "n_midnight": 0}
    assert sp.prove("timestamp[ms]", time, T.TimestampNTZType()) is None and sp.prove("timestamp[s]", time, T.TimestampNTZType()) and sp.prove("date32", time, T.TimestampNTZType())
    assert sp.prove("null", {"n_rows": 3, "n_null": 3}, T.LongType()) is None and sp.prove("null", whole, T.LongType()) == "8 values"


def test_state_survives_json():
    import datetime
    import decimal
    import json

    for x in (None, 3, 0.5, math.inf, decimal.Decimal("1.20"), datetime.datetime(2024, 1, 2, 3), datetime.date(2024, 1, 2), b"\x00a", "t"):
        assert sp._typed(json.loads(json.dumps(sp._plain(x)))) == x
    assert math.isnan(sp._typed(sp._plain(math.nan)))


def test_scaling_and_granularities():
    assert sp.scaled_up(100.0, 50, 500) == 1000 and math.isnan(sp.scaled_up(1.0, 0, 5))
    assert sp.usable_granularities((1, 2, 8), 8192, 16384) == ([1, 2], [(8, "a window of 65536 rows exceeds a block of 16384")])


def test_entropy_cells(spark):
    counts = spark.createDataFrame([(k, 1 + k % 9) for k in range(3000)], "v long, cnt long")
    n = sum(1 + k % 9 for k in range(3000))
    e = cells.exact(counts)
    want = -sum((1 + k % 9) / n * math.log2((1 + k % 9) / n) for k in range(3000))
    assert abs(e.bits - want) < 1e-9 and e.low == e.high == e.bits
    sample = cells.bottom_k(counts.orderBy("v").where("xxhash64(v) % 5 = 0"), 3000, n)
    assert sample.low <= want <= sample.high and sample.low < sample.high
    whole = cells.bottom_k(counts, 3000, n)
    assert abs(whole.bits - want) < 1e-9 and whole.low == whole.high
    assert cells.ams(50.0, 100, 1024).high == 10.0 and cells.ams(-1.0, 100, 1024).bits == 0.0 and cells.exact(counts.limit(0)).bits == 0.0


def test_pick():
    family = {"a": "int", "b": "int", "c": "text", "d": "text"}
    distinct = {"a": 10, "b": 1 << 30, "c": 5, "d": 1 << 40}
    combos = [(x, y) for x in "abcd" for y in "abcd" if x < y]
    got = pick(combos, family, distinct, 4, seed=3)
    assert len(got) == 4 and got == sorted(got, key=combos.index) and got == pick(combos, family, distinct, 4, seed=3)
    assert len({stratum([family[m] for m in c], [distinct[m] for m in c]) for c in got}) == 4
    assert pick(combos, family, distinct, 99) == combos and stratum(["b", "a"], [1 << 40, 1 << 40]) == ("a", "b", 2)
