import pytest

from profilark.plans import recommend as rec


def result(spark, df, **options):
    return {r["column"]: r for r in rec.OneShotRecommender(skip=False, **options).add(df, ["o"]).result().collect()}


def test_lists_and_structs(spark):
    rows = [(k, [k % 5, None], [float(k)], [k, k + 1, k + 2], {"a": k, "b": f"x{k % 3}"}, [["u", "v"][k % 2]] * (k % 3), None if k % 2 else [k]) for k in range(100)]
    schema = "o long, pairs array<long>, one array<double>, three array<int>, s struct<a: long, b: string>, words array<string>, gaps array<long>"
    got = result(spark, spark.createDataFrame(rows, schema))
    kinds = {c: r["type"] for c, r in got.items()}
    assert kinds == {"o": "uint8", "pairs": "fixed_size_list[uint8, 2]", "one": "uint8", "three": "fixed_size_list[uint8, 3]", "s": "struct[a: uint8, b: dictionary[int8, string]]", "words": "list[dictionary[int8, string]]", "gaps": "list[uint8]"}
    assert got["pairs"].store_type == "Array(Nullable(UInt8))" and got["s"].store_type == "Tuple(a UInt8, b LowCardinality(String))" and got["words"].store_type == "Array(LowCardinality(String))"
    assert got["three"].predicted_bytes == rec.padded(300) and got["gaps"].predicted_bytes == rec.padded(100 / 8) + rec.padded(4 * 101) + rec.padded(50)
    assert got["pairs"].predicted_bytes == rec.padded(200 / 8) + rec.padded(200)
    assert [tuple(x) for x in got["words"].top_k] == [("v", 50), ("u", 49)] or sum(x["count"] for x in got["words"].top_k) == 99
    assert {x.outcome for x in got["one"].candidates} == {"passed over", "chosen"}


def test_store_types():
    f = rec.column_store_type
    assert f("dictionary[int8, string]", None, None, False, ["b", "it's"]) == "Enum8('b' = 1, 'it\\'s' = 2)"
    assert f("dictionary[int16, string]", None, None, True, [f"{k:03}" for k in range(200)]).startswith("Nullable(Enum16('000' = 1, ")
    assert f("fixed_size_binary[16]", None, None, False) == "FixedString(16)" and rec.body_bytes("fixed_size_binary[16]", rec.Shape(10, 1)) == 8 + 160
    assert f("list[list[uint8]]", None, None, False) == "Array(Array(UInt8))" and f("fixed_size_list[double, 3]", None, None, True) == "Array(Nullable(Float64))"
    assert rec.struct_fields("struct[a: uint8, b: struct[c: list[string], d: decimal128(5, 2)]]") == [("a", "uint8"), ("b", "struct[c: list[string], d: decimal128(5, 2)]")]
    assert f("struct[a: uint8, b: struct[c: string]]", None, None, False) == "Tuple(a UInt8, b Tuple(c String))"


def test_measured_choices(spark):
    assert rec.transform_winner({"none": 1000, "Delta": 995, "GCD": 1000}) == "none" and rec.transform_winner({"none": 1000, "Delta": 500, "GCD": 499}) == "GCD"
    df = spark.range(20_000).selectExpr("id AS o", "id % 3 AS few", "cast(hex(xxhash64(id)) as string) AS noise")
    got = result(spark, df, compression=True)
    assert got["few"].compression == "lz4" or got["few"].compression.startswith("zstd:")
    sizes = {c: dict((x.codec, x.bytes) for x in r.measured) for c, r in got.items()}
    assert set(sizes["few"]) == {"none", "lz4", "zstd:1", "zstd:3", "zstd:9"} and all(rec.pick_compression(s) == got[c].compression for c, s in sizes.items())
    assert sizes["few"]["lz4"] < sizes["few"]["none"] and got["noise"].compression is not None
    with pytest.raises(ValueError):
        rec.OneShotRecommender().add(df, ["o"]).add(df, ["o"])
