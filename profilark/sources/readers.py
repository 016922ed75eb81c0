"""Sources and sinks: Parquet, ORC, CSV, JSON, Arrow IPC files, a dataset cache, and result tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, is_dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "csv", "json")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema=None, ordinal: bool = False, **options) -> DataFrame:
    """Read files; with ``ordinal``, rows carry their file and place in it (Parquet) as an order."""
    if kind not in FORMATS:
        raise ValueError(f"kind: one of {FORMATS}")
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.format(kind).load(path)
    if ordinal:
        if kind != "parquet":
            raise ValueError("only Parquet files number their rows")
        df = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return df


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options) -> str:
    if kind not in FORMATS:
        raise ValueError(f"kind: one of {FORMATS}")
    w = df.write.mode(mode).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).format(kind).save(path)
    return path


def checked(table: pa.Table) -> pa.Table:
    """The table where Spark can hold all of it: valid buffers, distinct names, no types beyond its own."""
    table.validate(full=True)
    if len(set(table.column_names)) != len(table.column_names):
        raise ValueError("two columns share a name")
    for f in table.schema:
        if pa.types.is_union(f.type) or pa.types.is_decimal256(f.type):
            raise ValueError(f"{f.name}: {f.type} is not read")
    return table


def arrow_frame(spark: SparkSession, table: pa.Table) -> DataFrame:
    """A frame of a (driver-side) Arrow table: unsigned integers widen, dictionaries decode, times become ticks."""
    out = checked(table)
    for i, f in enumerate(out.schema):
        kind = f.type
        column = out.column(i)
        if pa.types.is_dictionary(kind):
            column, kind = column.cast(kind.value_type), kind.value_type
        wider = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0)}.get(kind)
        if wider is None and (pa.types.is_time(kind) or (pa.types.is_timestamp(kind) and kind.unit == "ns")):
            column, wider = column.cast(pa.int32() if pa.types.is_time32(kind) else pa.int64()), pa.int64()
        column = column.cast(wider) if wider is not None else column
        out = out.set_column(i, f.name, column)
    return spark.createDataFrame(out)


def read_ipc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Columns of one Arrow IPC file (a local, driver-side source)."""
    with pa.memory_map(path) as source:
        table = pa.ipc.open_file(source).read_all()
    return arrow_frame(spark, table.select(columns) if columns else table)


def write_ipc(df: DataFrame, path: str, compression: str | None = None, level: int | None = None, batch_rows: int = 65_536) -> int:
    """Write a (small) frame as one Arrow IPC file; its size in bytes."""
    table = df.toArrow()
    codec = pa.Codec(compression, level) if compression == "zstd" and level else compression
    with pa.ipc.new_file(path, table.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as w:
        w.write_table(table, max_chunksize=batch_rows)
    return Path(path).stat().st_size


def cached(spark: SparkSession, folder: str, spec, make: Callable[[], DataFrame]) -> DataFrame:
    """The dataset of a spec: read where it was made before, else made and kept as Parquet with a manifest."""
    body = json.dumps(asdict(spec) if is_dataclass(spec) else spec, sort_keys=True, default=str)
    name = hashlib.sha256(body.encode()).hexdigest()[:16]
    path, manifest = f"{folder}/{name}.parquet", Path(folder) / f"{name}.json"
    if not manifest.exists():
        made = make()
        made.write.mode("overwrite").parquet(path)
        Path(folder).mkdir(parents=True, exist_ok=True)
        manifest.write_text(json.dumps({"spec": json.loads(body), "rows": spark.read.parquet(path).count()}))
    return spark.read.parquet(path)
