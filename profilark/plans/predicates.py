"""Generated queries: full scans and filters of a wanted selectivity, with typed literals and answers."""

from __future__ import annotations

import hashlib
import json
import math
import random
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from profilark.operators.canon import FLOATS, INTEGERS
from profilark.operators.order import with_ordinal


@dataclass(frozen=True)
class Query:
    """``full_scan`` of a column, or ``filter`` by a range (two values) or a list of values."""

    kind: str
    column: str
    values: tuple = ()
    operator: str = ""
    achieved: float | None = None
    extra: dict = field(default_factory=dict)

    def id(self) -> str:
        """16 hexadecimal digits of a hash of the fields."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, default=str).encode()).hexdigest()[:16]


def usable(value: Column, dtype: T.DataType) -> Column:
    """Values that a predicate may choose: neither null nor NaN."""
    return value.isNotNull() & ~F.isnan(value) if isinstance(dtype, FLOATS) else value.isNotNull()


#: Buckets of a histogram when a rank is looked up.
BUCKETS = 1024


def at_ranks(df: DataFrame, column: str, ranks: list[int]) -> list:
    """The values at these places (from 0) of a numeric or temporal column in ascending order.

    No sort: histograms of equal widths, each of one scan that gathers ``BUCKETS`` counts a rank, close in on
    every rank at once, until its bucket holds one value.
    """
    kind = df.schema[column].dataType
    number = F.unix_micros(F.col(column).cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else F.unix_date(F.col(column)) if isinstance(kind, T.DateType) else F.col(column)
    real = isinstance(kind, FLOATS)
    rows = df.where(usable(F.col(column), kind)).select(F.col(column).alias("v"), number.cast("double" if real else "decimal(38,0)" if isinstance(kind, T.DecimalType) else "bigint").alias("x"))
    ends = rows.agg(F.min("x"), F.max("x")).first()
    spans = {r: (ends[0], ends[1], 0) for r in ranks}  # a rank lies among the values lo .. hi, with so many below lo
    out = {}
    while spans:
        wide = sorted({(lo, hi, below) for lo, hi, below in spans.values()})
        step = {s: (s[1] - s[0]) / BUCKETS if real else -((s[0] - s[1]) // BUCKETS) or 1 for s in wide}
        cell = F.lit(None)
        for k, s in enumerate(wide):
            if math.isinf(s[0]) or math.isinf(s[1]):  # infinite ends stand alone
                where = F.when(F.col("x") == s[0], 0).when(F.col("x") == s[1], 2).otherwise(1)
            elif math.isinf(step[s]):
                where = F.when(F.col("x") <= s[0] / 2 + s[1] / 2, 0).otherwise(1)
            elif not step[s]:
                where = F.when(F.col("x") < s[1], 0).otherwise(1)
            else:
                where = F.floor((F.col("x") - F.lit(s[0])) / F.lit(step[s])).cast("int")
            cell = F.when(F.col("x").between(F.lit(s[0]), F.lit(s[1])), F.struct(F.lit(k).alias("span"), where.alias("cell"))).otherwise(cell)
        got = rows.select("v", "x", cell.alias("c")).where("c is not null").groupBy("c").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("v").alias("v"))
        by = {}
        for r in sorted(got.collect(), key=lambda r: (r["c"]["span"], r["lo"])):
            by.setdefault(r["c"]["span"], []).append(r)
        for r, s in list(spans.items()):
            below = s[2]
            for c in by[wide.index(s)]:
                if r < below + c["n"]:
                    if c["lo"] == c["hi"]:
                        out[r] = c["v"]
                        del spans[r]
                    else:
                        spans[r] = (c["lo"], c["hi"], below)
                    break
                below += c["n"]
    return [out[r] for r in ranks]


def choose_range(df: DataFrame, column: str, fraction: float, seed: int = 0, start: int | None = None) -> Query:
    """``BETWEEN`` two values that hold about this share of all rows, from a seeded (or given) place in value order.

    The bounds of numbers and times are looked up by histograms; of other types the counts of distinct
    values are ordered (by range partitions).
    """
    if not 0 < fraction <= 1:
        raise ValueError("fraction: above 0, at most 1")
    dtype = df.schema[column].dataType
    good = usable(F.col(column), dtype)
    total, n = df.agg(F.count("*"), F.count_if(good)).first()
    if not n:
        raise ValueError(f"{column} has no values to choose")
    take = max(1, min(n, round(fraction * total)))
    start = random.Random(seed).randrange(n - take + 1) if start is None else max(0, min(start, n - take))
    if isinstance(dtype, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)) and not (isinstance(dtype, T.DecimalType) and dtype.scale):
        lo, hi = at_ranks(df, column, [start, start + take - 1])
    else:
        from profilark.operators.order import running_sum

        counts = df.where(good).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("cnt"))
        placed = running_sum(with_ordinal(counts, ["v"], "id").withColumn("one", F.lit(0)), "cnt", "upto", ("one",), "id")
        lo, hi = placed.agg(F.min(F.when(F.col("upto") > start, F.col("v"))), F.min(F.when(F.col("upto") > start + take - 1, F.col("v")))).first()
    held = df.where(F.col(column).between(F.lit(lo), F.lit(hi)) & good).count()
    return Query("filter", column, (lo, hi), "between", held / total)


def choose_in(df: DataFrame, column: str, fraction: float, n_values: int) -> Query:
    """``IN`` a list of values whose frequencies add up to about this share, found one nearest value at a time.

    Ties go to the more frequent, then to the smaller value.  Of equally frequent values at most
    ``n_values`` smallest can be chosen, so only so many a frequency reach the driver.
    """
    dtype = df.schema[column].dataType
    total = df.count()
    counts = df.where(usable(F.col(column), dtype)).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("cnt"))
    few = counts.withColumn("nth", F.row_number().over(Window.partitionBy("cnt").orderBy("v"))).where(F.col("nth") <= n_values)
    left = {r["v"]: r["cnt"] for r in few.orderBy("v").collect()}
    chosen, have, target = [], 0, fraction * total
    for step in range(n_values):
        if not left:
            break
        share = (target - have) / (n_values - step)
        v = min(left, key=lambda x: (abs(left[x] - share), -left[x], x))
        chosen.append(v)
        have += left.pop(v)
    return Query("filter", column, tuple(sorted(chosen)), "in", have / total)


def predicate(q: Query) -> Column | None:
    if q.kind == "full_scan":
        return None
    return F.col(q.column).between(F.lit(q.values[0]), F.lit(q.values[1])) if q.operator == "between" else F.col(q.column).isin(*q.values)


def total(column: str, dtype: T.DataType) -> Column:
    """What a query adds up: bytes of text and binary values, else the values themselves."""
    v = F.col(column)
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.coalesce(F.sum(F.octet_length(v)), F.lit(0)).cast("double")
    if isinstance(dtype, (T.DateType,)):
        return F.coalesce(F.sum(F.unix_date(v)), F.lit(0)).cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(F.sum(F.unix_micros(v.cast("timestamp")).cast("decimal(38,0)")), F.lit(0)).cast("double")
    if isinstance(dtype, T.BooleanType):
        return F.count_if(v).cast("double")
    return F.coalesce(F.sum(v.cast("double")), F.lit(0.0))


def run(df: DataFrame, q: Query) -> DataFrame:
    """``n_rows, total`` of a query."""
    where = predicate(q)
    got = df if where is None else df.where(where)
    return got.agg(F.count("*").alias("n_rows"), total(q.column, df.schema[q.column].dataType).alias("total"))


def literal(value, dtype: T.DataType) -> str:
    """A value as SQL text of its type."""
    if value is None:
        return "NULL"
    if isinstance(dtype, T.BooleanType):
        return str(value).upper()
    if isinstance(dtype, INTEGERS):
        return str(int(value))
    if isinstance(dtype, T.DecimalType):
        return f"CAST('{value:.{dtype.scale}f}' AS DECIMAL({dtype.precision},{dtype.scale}))"
    if isinstance(dtype, FLOATS):
        return repr(float(value)) if math.isfinite(value) else f"CAST('{value}' AS DOUBLE)"
    if isinstance(dtype, T.DateType):
        return f"DATE '{value.isoformat()}'"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(dtype, T.BinaryType):
        return f"unhex('{bytes(value).hex()}')"
    return "'" + str(value).replace("'", "''") + "'"


def sql(q: Query, table: str, dtype: T.DataType) -> str:
    """The query as SQL text."""
    what = f"sum(octet_length({q.column}))" if isinstance(dtype, (T.StringType, T.BinaryType)) else f"sum(CAST({q.column} AS DOUBLE))"
    text = f"SELECT count(*) AS n_rows, {what} AS total FROM {table}"
    if q.kind == "filter":
        shown = [literal(v, dtype) for v in q.values]
        text += f" WHERE {q.column} " + (f"BETWEEN {shown[0]} AND {shown[1]}" if q.operator == "between" else f"IN ({', '.join(shown)})")
    return text


def agree(a: tuple[int, float], b: tuple[int, float], magnitude: float | None = None) -> bool:
    """Counts are equal; totals too, up to 1e-9 of the magnitude of what was added; non-finite ones alike."""
    if a[0] != b[0]:
        return False
    x, y = float(a[1] or 0), float(b[1] or 0)
    if not (math.isfinite(x) and math.isfinite(y)):
        return (math.isnan(x) and math.isnan(y)) or x == y
    return abs(x - y) <= 1e-9 * max(magnitude or 0.0, abs(x), abs(y), 1.0)
