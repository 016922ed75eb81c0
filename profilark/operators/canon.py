"""Type families and canonical forms: one spelling of equality, order and physical integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)
SCALARS = (*INTEGERS, *FLOATS, *TEMPORAL, T.DecimalType, T.BooleanType, T.StringType, T.BinaryType)
INTEGER_BACKED = (*INTEGERS, T.DecimalType, *TEMPORAL)
WIDE = T.DecimalType(38, 0)


def family(dtype: T.DataType) -> str:
    """The value family: integers of all widths share one, so do strings; other types stand alone."""
    if isinstance(dtype, INTEGERS):
        return "int"
    if isinstance(dtype, T.StringType):
        return "str"
    if isinstance(dtype, T.ArrayType):
        return f"array<{family(dtype.elementType)}>"
    return dtype.simpleString()


def canonical(value: Column, dtype: T.DataType) -> Column:
    """Equal values get equal forms: -0.0 is 0.0 (Spark's grouping makes all NaNs equal)."""
    if isinstance(dtype, FLOATS):
        return F.when(value == 0, F.lit(0.0).cast(dtype)).otherwise(value)
    if isinstance(dtype, INTEGERS):
        return value.cast("bigint")
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, FLOATS):
        return F.transform(value, lambda x: F.when(x == 0, F.lit(0.0).cast(dtype.elementType)).otherwise(x))
    return value


def text(value: Column, dtype: T.DataType) -> Column:
    """A canonical value as text: equal exactly when the values are equal."""
    value = canonical(value, dtype)
    if isinstance(dtype, T.BinaryType):
        return F.hex(value)
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(value)
    return value.cast("string")


def physical(value: Column, dtype: T.DataType) -> Column:
    """The raw integer of an integer-backed value (unscaled, days, microseconds)."""
    if isinstance(dtype, T.DecimalType):
        return (value * F.lit(10**dtype.scale).cast(T.DecimalType(38, 0))).cast(WIDE) if dtype.scale else value.cast(WIDE)
    if isinstance(dtype, T.DateType):
        return F.unix_date(value).cast(WIDE)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(value).cast(WIDE)
    if isinstance(dtype, T.TimestampNTZType):
        return F.unix_micros(value.cast("timestamp")).cast(WIDE)
    if isinstance(dtype, T.DayTimeIntervalType):
        return F.floor(value.cast("decimal(38,6)") * 1000000).cast(WIDE)
    return value.cast(WIDE)


def stacks(df: DataFrame, columns: list[str], *carry: str) -> list[DataFrame]:
    """Long frames (``carry``, col, v) that cover the columns, one for each common type; one scan each."""
    by: dict[str, list[str]] = {}
    for c in columns:
        dtype = df.schema[c].dataType
        kind = "bigint" if isinstance(dtype, INTEGERS) else "double" if isinstance(dtype, FLOATS) else "string"
        by.setdefault(kind, []).append(c)
    out = []
    for kind, own in sorted(by.items()):
        form = canonical if kind in ("bigint", "double") else text
        pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), form(F.col(f"`{c}`"), df.schema[c].dataType).cast(kind).alias("v")) for c in own))).alias("p")
        out.append(df.select(*carry, pairs).select(*carry, "p.col", "p.v"))
    return out


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``col, absent, cnt``: rows of every distinct value of every column (null is one, marked ``absent``)."""
    parts = [s.groupBy("col", "v").agg(F.count("*").alias("cnt")).select("col", F.isnull("v").alias("absent"), "cnt") for s in stacks(df, columns)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
