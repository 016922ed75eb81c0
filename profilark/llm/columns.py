"""Names of columns that an operator adds beside those that it is given, and keys of rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def named(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, or with ``_`` behind it as often as it takes to be none of the others (in any case of letters)."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def renamed(columns: Iterable[str], outputs: Iterable[str]) -> list[str]:
    """The names; one that is the name of an output gets ``_`` behind it."""
    taken, out = [*outputs], []
    for c in columns:
        out.append(fresh(c, taken))
        taken.append(out[-1])
    return out


def carried(columns: Iterable[str], outputs: Iterable[str]) -> list[Column]:
    """The columns under these names."""
    columns = [*columns]
    return [named(c).alias(name) for c, name in zip(columns, renamed(columns, outputs))]


def typed(rows: DataFrame, name: str, rest: str) -> StructType:
    """A schema of one column of ``rows`` as it is (whatever its fields are called), and of others in DDL."""
    return StructType([StructField(name, rows.schema[name].dataType), *StructType.fromDDL(rest).fields])


def keyed(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rows whose ``key`` tells different texts apart: as it is where no id repeats, else (id, hash of the text).

    Such keys sort by id first.  Rows equal in both are one.
    """
    if rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows
    return rows.withColumn(key, row_key(key, text))


def row_key(key: str, text: str = "text") -> Column:
    """The longer form of ``keyed``."""
    return F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("text_hash"))
