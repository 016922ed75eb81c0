"""Column profiles: counts, lengths, extremes, float and text scanners, estimates and classes.

Every group is one aggregation over the frame (or over its lists' values, one level down, as
``inner_`` metrics); value frequencies come from one grouping of stacked values.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilark.functions.cluster import ship
from profilark.operators.canon import FLOATS, INTEGER_BACKED, INTEGERS, WIDE, canonical
from profilark.operators.cardinality import chao1, frequency_inputs, schnabel
from profilark.operators.contract import Technique, by_frame, union
from profilark.operators.integers import gcds
from profilark.operators.order import ORD, with_ordinal

D, L, I, S, B = T.DoubleType(), T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()

_DAY = "[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"
_CLOCK = "(?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:[.][0-9]{1,9})?)?"
_ZONE = "(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])"
NUMBER, WHOLE, PADDED = r"^-?[0-9]++(?:[.][0-9]++)?\z", r"^-?[0-9]++\z", r"^-?0[0-9]++\z"


def rlike(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def float_stats(v: Column, dtype: T.DataType) -> dict[str, Column]:
    """NaN, infinite and fractional values, decimal places, and values that 32 bits would change."""
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    shown = v.cast("string")  # the shortest digits that read back as the value, in its own width
    fraction = F.length(F.regexp_replace(F.regexp_extract(shown, "[.]([0-9]+)", 1), "0+$", ""))
    power = F.coalesce(F.regexp_extract(shown, "E(-?[0-9]+)", 1).try_cast("int"), F.lit(0))
    out = {
        "n_nan": F.count_if(F.isnan(v)),
        "n_inf": F.count_if(F.abs(v) == float("inf")),
        "n_fractional": F.count_if(finite & (v != F.floor(v.cast("double")).cast("double")) & (F.abs(v) < 2.0**53)),
        "max_frac_digits": F.max(F.when(finite, F.greatest(fraction - power, F.lit(0)))),
    }
    if isinstance(dtype, T.DoubleType):
        out["n_f32_inexact"] = F.count_if(finite & (v.cast("float").cast("double") != v))
    return out


def text_stats(v: Column) -> dict[str, Column]:
    """Numbers and ISO 8601 dates and times spelled as text."""
    number, whole = rlike(v, NUMBER), rlike(v, WHOLE)
    head = F.regexp_extract(v, "^-?0*([0-9]*)", 1)
    tail = F.regexp_replace(F.regexp_extract(v, "[.]([0-9]+)$", 1), "0+$", "")
    significant = F.length(F.regexp_replace(F.concat(head, tail), "^0+", ""))
    when = lambda c, x: F.when(c, x)
    real_day = F.try_to_date(F.substring(v, 1, 10), "yyyy-MM-dd").isNotNull()
    day, clock = rlike(v, rf"^{_DAY}\z") & real_day, rlike(v, rf"^{_CLOCK}\z")
    stamp, zoned = rlike(v, rf"^{_DAY}[T ]{_CLOCK}\z") & real_day, rlike(v, rf"^{_DAY}[T ]{_CLOCK}{_ZONE}\z") & real_day
    part = F.regexp_extract(v, ":[0-5][0-9][.]([0-9]+)", 1)
    offset = F.regexp_replace(F.regexp_extract(v, f"({_ZONE})$", 1), "^(?:Z|-00:00)$", "+00:00")
    digits = F.max(when(whole, F.length(head)))
    value = when(whole & (F.length(head) <= 38), v.try_cast("decimal(38,0)"))
    in_range = lambda agg: F.when(digits <= 38, agg)
    return {
        "n_numeric": F.count_if(number), "n_numeric_int": F.count_if(whole), "n_leading_zero": F.count_if(rlike(v, PADDED)),
        "numeric_int_min": in_range(F.min(value)), "numeric_int_max": in_range(F.max(value)),
        "numeric_max_int_digits": F.max(when(number, F.length(head))), "numeric_max_frac_digits": F.max(when(number, F.length(tail))), "numeric_min_frac_digits": F.min(when(number, F.length(tail))), "numeric_max_sig_digits": F.max(when(number, significant)),
        "n_iso_date": F.count_if(day), "n_iso_time": F.count_if(clock), "n_iso_datetime": F.count_if(stamp), "n_iso_datetime_tz": F.count_if(zoned),
        "iso_max_frac_digits": F.max(when(clock | stamp | zoned, F.length(part))), "iso_max_sig_frac_digits": F.max(when(clock | stamp | zoned, F.length(F.regexp_replace(part, "0+$", "")))),
        "iso_n_offsets": F.count_distinct(when(zoned, offset)), "iso_n_midnight": F.count_if((stamp | zoned) & rlike(v, rf"[T ]00:00(?::00(?:[.]0+)?)?{_ZONE}?\z")),
    }


WHOLES = ["n_unique", "min_len", "max_len", "sum_len", "sum_len_unique", "n_nan", "n_inf", "n_fractional", "n_f32_inexact", "n_numeric", "n_numeric_int", "n_leading_zero", "n_iso_date", "n_iso_time", "n_iso_datetime", "n_iso_datetime_tz", "iso_n_offsets", "iso_n_midnight"]
SMALL = ["max_frac_digits", "numeric_max_int_digits", "numeric_max_frac_digits", "numeric_min_frac_digits", "numeric_max_sig_digits", "iso_max_frac_digits", "iso_max_sig_frac_digits"]
BIG = ["gcd", "numeric_int_min", "numeric_int_max"]
VALUE_METRICS: dict[str, T.DataType] = {**dict.fromkeys(WHOLES, L), **dict.fromkeys(SMALL, I), **dict.fromkeys(BIG, WIDE)}
LEVEL: dict[str, T.DataType] = {"min": S, "max": S, "unique": B, "est_cardinality": D, "est_low": D, "est_high": D, "est_method": S, "estimates_agree": B, "class": S}
SIZES = {"size_bytes": L, "size_zstd_bytes": L}


def value_profile(df: DataFrame, dtype: T.DataType, ordered: bool = True) -> DataFrame:
    """One row of metrics of a frame ``__ord, v`` (without ``ordered`` equal extremes are shown by their least text)."""
    v = F.col("v")
    aggs: dict[str, Column] = {"n_values": F.count("*"), "n_null": F.count_if(F.isnull(v))}
    nested = isinstance(dtype, (T.ArrayType, T.StructType, T.MapType))
    if not isinstance(dtype, T.MapType):
        aggs["n_unique"] = F.count_distinct(canonical(v, dtype))
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        aggs |= {"min_len": F.min(F.octet_length(v)), "max_len": F.max(F.octet_length(v)), "sum_len": F.coalesce(F.sum(F.octet_length(v)), F.lit(0))}
    elif isinstance(dtype, T.ArrayType):
        aggs |= {"min_len": F.min(F.when(v.isNotNull(), F.size(v))), "max_len": F.max(F.when(v.isNotNull(), F.size(v)))}
    if isinstance(dtype, FLOATS):
        aggs |= float_stats(v, dtype)
    if isinstance(dtype, T.StringType):
        aggs |= text_stats(v)
    if not nested:
        real = v.isNotNull() & ~F.isnan(v) if isinstance(dtype, FLOATS) else v.isNotNull()
        c = canonical(v, dtype)
        shown = F.hex(v) if isinstance(dtype, T.BinaryType) else v.cast("string")
        if ordered:  # of equal extremes the first row's text
            aggs |= {"min": F.min_by(shown, F.when(real, F.struct(c.alias("c"), F.col(ORD).alias("o")))), "max": F.max_by(shown, F.when(real, F.struct(c.alias("c"), (-F.col(ORD)).alias("o"))))}
        else:
            aggs |= {"min": F.min(F.when(real, F.struct(c.alias("c"), shown.alias("s"))))["s"], "max": F.max(F.when(real, F.struct(c.alias("c"), shown.alias("s"))))["s"]}
        aggs |= {"lo": F.min(F.when(real, c)), "hi": F.max(F.when(real, c))}
    if isinstance(dtype, T.TimestampType) or isinstance(dtype, T.TimestampNTZType):
        aggs["n_midnight"] = F.count_if(F.date_trunc("DAY", v) == v)
    return df.agg(*(a.alias(k) for k, a in aggs.items()))


class Describe(Technique):
    """The profile of each column; ``order_by`` decides which of equal extremes is shown and the seeded split.

    Without ``estimates`` there is no split, so rows are neither sorted nor numbered; estimates and class are null.
    """

    ORDERED = True
    DESCRIPTORS = {"dtype": S}
    METRICS = {"n_rows": L, "n_null": L, **VALUE_METRICS, "n_midnight": L, **SIZES, "inner_n_values": L, "inner_n_null": L, **{f"inner_{k}": t for k, t in VALUE_METRICS.items()}, **LEVEL, **{f"inner_{k}": t for k, t in LEVEL.items()}}

    def __init__(self, *, categorical_threshold: int = 10_000, seed: int = 0, sizes: bool = False, zstd_level: int = 3, estimates: bool = True):
        super().__init__()
        self.estimates = estimates
        self.categorical_threshold, self.seed, self.sizes, self.zstd_level = categorical_threshold, seed, sizes, zstd_level

    def eligible(self, dtype):
        if isinstance(dtype, (T.NullType, T.MapType)):
            return False
        if isinstance(dtype, T.ArrayType):
            return self.eligible(dtype.elementType)
        return not isinstance(dtype, T.StructType) or all(self.eligible(f.dataType) for f in dtype.fields)

    def needs_rows(self):
        return True

    def _compute(self, combos):
        out = []
        for n, own in by_frame(combos).items():
            columns = [c for ((_, c),) in own]
            df = self._placed(self.frames[n].select(*dict.fromkeys([*columns, *self.orders[n]])), self.orders[n])
            for c in columns:
                out.append(self._column(n, c, df))
        return union(out)

    def _placed(self, df: DataFrame, order: list[str]) -> DataFrame:
        return with_ordinal(df, order) if self.estimates else df.withColumn(ORD, F.lit(0))

    def _column(self, n: str, c: str, df: DataFrame) -> DataFrame:
        dtype = df.schema[c].dataType
        row = self._level(df.select(ORD, F.col(f"`{c}`").alias("v")), dtype)
        row = row.withColumnRenamed("n_values", "n_rows")
        if isinstance(dtype, T.ArrayType):
            # lists one level down, in order of row and place
            flat = df.select(F.col(ORD).alias("__row"), F.posexplode(F.col(f"`{c}`")).alias("__at", "v"))
            inner = self._level(self._placed(flat, ["__row", "__at"]).select(ORD, "v"), dtype.elementType)
            row = row.crossJoin(F.broadcast(inner.select(*(F.col(k).alias(f"inner_{k}") for k in inner.columns))))  # one row
        if self.sizes:
            row = row.crossJoin(F.broadcast(ipc_sizes(df.select(F.col(f"`{c}`").alias("v")), self.zstd_level)))
        have = set(row.columns)
        return row.select(F.lit(n).alias("df_a"), F.lit(c).alias("col_a"), *((F.col(k) if k in have else F.lit(None)).cast(t).alias(k) for k, t in self.METRICS.items()))

    def _level(self, long: DataFrame, dtype: T.DataType) -> DataFrame:
        row = value_profile(long, dtype, self.estimates)
        if isinstance(dtype, (T.StringType, T.BinaryType)):
            unique = long.select("v").distinct().agg(F.coalesce(F.sum(F.octet_length("v")), F.lit(0)).alias("sum_len_unique"))
            row = row.crossJoin(F.broadcast(unique))
        if isinstance(dtype, INTEGER_BACKED):
            row = row.crossJoin(F.broadcast(gcds(long, ["v"]).select("gcd")))
        if not self.estimates:
            return row.drop("lo", "hi")
        if not isinstance(dtype, T.StructType):
            names = [f"h{k}" for k in range(1, 8)]
            inputs = long.sparkSession.range(1).select(F.lit("v").alias("col")).join(frequency_inputs(long, ["v"], self.seed), "col", "left").na.fill(0)
            row = row.crossJoin(F.broadcast(inputs.select("n_non_null", "f1", "f2", *names)))
            row = self._estimate(row, [F.col(k) for k in names])
        return row.withColumn("class", self._class(row, dtype)).drop("lo", "hi", "f1", "f2", "n_non_null", *(f"h{k}" for k in range(1, 8)))

    def _estimate(self, row: DataFrame, history: list[Column]) -> DataFrame:
        d, n = F.col("n_unique"), F.col("n_non_null")
        c, c_low, c_high = chao1(d, F.col("f1"), F.col("f2"))
        s, s_low, s_high = schnabel(history, d, n)
        plain, recaptured = (n == 0) | (F.try_divide(d, n) >= 0.5), ~F.isnan(s)
        best = lambda a, b: F.when(plain, d.cast("double")).when(recaptured, a).otherwise(b)
        est = F.greatest(best(s, c), d.cast("double"))
        return (
            row.withColumn("unique", (n > 0) & (d == n))
            .withColumn("est_cardinality", est)
            .withColumn("est_low", F.greatest(best(s_low, c_low), d.cast("double")))
            .withColumn("est_high", F.greatest(best(s_high, c_high), F.col("est_cardinality")))
            .withColumn("est_method", F.when(plain, "observed").when(recaptured, "schnabel").otherwise("chao1"))
            .withColumn("estimates_agree", F.when(~plain & recaptured, (c_low <= s_high) & (s_low <= c_high)))
        )

    def _class(self, row: DataFrame, dtype: T.DataType) -> Column:
        n = F.col("n_values") - F.col("n_null")
        lo = hi = None
        if isinstance(dtype, INTEGERS) or (isinstance(dtype, T.DecimalType) and dtype.scale == 0):
            whole, lo, hi = F.lit(True), F.col("lo"), F.col("hi")
        elif isinstance(dtype, FLOATS):
            whole, lo, hi = F.col("n_fractional") + F.col("n_nan") + F.col("n_inf") == 0, F.col("lo"), F.col("hi")
        elif isinstance(dtype, T.StringType):
            whole, lo, hi = (F.col("n_numeric_int") == n) & (F.col("n_leading_zero") == 0) & F.col("numeric_int_min").isNotNull(), F.col("numeric_int_min"), F.col("numeric_int_max")
        out = F.when(F.col("n_null") == F.col("n_values"), "null")
        if "n_unique" in row.columns:
            out = out.when(F.col("n_unique") == 1, "constant").when(F.col("n_unique") == 2, "boolean")
        if lo is not None:
            out = out.when(whole & (lo >= 0) & (hi <= 2 * F.col("n_values")), "ordinal")
        if "est_cardinality" in row.columns:
            out = out.when(F.col("est_cardinality") <= self.categorical_threshold, "categorical")
        return out.otherwise("discrete")


def ipc_sizes(df: DataFrame, zstd_level: int = 3) -> DataFrame:
    """``size_bytes, size_zstd_bytes``: Arrow IPC bodies of the column, added up over the tasks' batches."""
    ship(df.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = packed = 0
        for batch in batches:
            for codec in (None, pa.Codec("zstd", zstd_level)):
                sink = io.BytesIO()
                options = pa.ipc.IpcWriteOptions(compression=codec)
                with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                    head = sink.tell()
                    writer.write_batch(batch)
                    size = sink.tell() - head
                if codec is None:
                    plain += size
                else:
                    packed += size
        yield pa.RecordBatch.from_arrays([pa.array([plain]), pa.array([packed])], names=["plain", "packed"])

    got = df.mapInArrow(measure, "plain long, packed long")
    return got.agg(F.sum("plain").alias("size_bytes"), F.sum("packed").alias("size_zstd_bytes"))
