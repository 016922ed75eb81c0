"""Named datasets: the standard tables and the synthetic scenarios, optionally cut to a number of rows, or a path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from profilark.sources import synthetic

TABLES = ("lineitem", "orders", "customer", "part", "supplier", "events", "documents", "labels")
GROUPS = {"tables": TABLES, "synthetic": synthetic.SCENARIOS}


def names(group: str | None = None) -> list[str]:
    """Of one group, or all; a group's names are its own."""
    if group is not None and group not in GROUPS:
        raise ValueError(f"group: one of {sorted(GROUPS)}")
    return [n for g, own in GROUPS.items() if group in (None, g) for n in own]


def load(spark: SparkSession, name: str, tables: str | None = None) -> DataFrame:
    """``name``, ``name:rows`` (synthetic ones are made with so many rows, tables keep their first) or a Parquet path."""
    base, _, rows = name.partition(":") if "/" not in name else (name, "", "")
    if rows and not rows.isdigit():
        raise ValueError(f"{name!r}: rows are a number")
    if base in TABLES:
        if tables is None:
            raise ValueError(f"{base}: the folder of the tables is not given")
        df = spark.read.parquet(f"{tables.rstrip('/')}/{base}.parquet")
        return df.limit(int(rows)) if rows else df
    if base in synthetic.SCENARIOS:
        return synthetic.generate(spark, synthetic.scenario(base, int(rows or 10_000)))
    if "/" in base:
        return spark.read.parquet(base)
    raise ValueError(f"{name!r}: no such dataset; there are {names()}")
