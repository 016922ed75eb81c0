"""Session helpers: shared storage for cut lineages, and shipping this package to workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

_shipped: set[str] = set()
_folders: set[str] = set()
#: Bytes of a batch that goes to a Python worker, unless the session sets its own bound.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where there is neither, one is created and set on ``local`` masters only; a cluster must name its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext._jsc.sc()
        given = context.getCheckpointDir()
        if given.isDefined():
            named = given.get()
        elif context.isLocal():
            named = Path(tempfile.mkdtemp(prefix="profilark-")).as_uri()
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def _folder(spark: SparkSession) -> str:
    """This application's tables in the shared folder; it goes with the application."""
    path = f"{shared_dir(spark).rstrip('/')}/profilark-{spark.sparkContext.applicationId}"
    if path not in _folders:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
        _folders.add(path)
    return path


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and return it reread: a cut lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if path.startswith("file:"):  # no checksum file beside each part: Parquet has its own, and each costs two forks
        writer = writer.option("fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem").option("fs.file.impl.disable.cache", "true")
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for these; nothing that is still to be computed may read them."""
    for df in tables:
        path = getattr(df, "_written", None)
        if path:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


#: Bytes of rows that may be broadcast.
BROADCAST_BYTES = 32 << 20


def _bytes(c: Column, kind) -> Column:
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        return F.greatest(F.size(c), F.lit(0)) * 8 + 24
    if isinstance(kind, StructType):
        return F.lit(16 + 8 * len(kind))
    return F.lit(8)


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` marked for broadcast where its measured bytes allow it, else as it is; for materialised tables."""
    one = F.lit(16)
    for f in df.schema:
        one = one + _bytes(F.col(f"`{f.name}`"), f.dataType)
    size = df.agg(F.sum(one)).first()[0] or 0
    return F.broadcast(df) if size <= (BROADCAST_BYTES if most is None else most) else df


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application (as ``--py-files`` would), and bound their batches."""
    app = spark.sparkContext.applicationId
    if spark.conf.get(_BATCH, "1b") == "1b":
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="profilark-ship-")) / f"profilark_{os.getpid()}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the standard Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _located(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _located(spark, path)
    fs.delete(at, True)
