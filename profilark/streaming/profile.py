"""Profiles and recommendations of a stream: mergeable state per column.

Each batch is reduced to one row of sums and extremes per column and to counts of its values; these
are merged into the state.  The row number at arrival is the clock: rows are numbered on from the rows
seen before, so nothing depends on how the stream is cut into batches.  ``attach`` runs it on a
Structured Streaming query through ``foreachBatch``: the state is written beside the query's checkpoint
after each batch, under the batch's number, and read when the query starts again.

A type is not cast and compared, as there is no table to compare: ``prove`` decides from the statistics
of all rows whether each value fits, and the sampled blocks are cast as a cross-check.
"""

from __future__ import annotations

import datetime
import decimal
import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilark.functions.cluster import materialize
from profilark.functions.scalar import entropy
from profilark.operators.canon import FLOATS, INTEGER_BACKED, canonical, family, physical, text
from profilark.operators.cardinality import chao1
from profilark.operators.integers import gcds
from profilark.operators.order import with_ordinal
from profilark.plans.recommend import Candidate, Rules, verify

#: Sums are added, minima and maxima compared, divisors folded.
SUMS = ["n_rows", "n_null", "sum_len", "n_nan", "n_inf", "n_fractional", "n_f32_inexact", "n_numeric", "n_numeric_int", "n_leading_zero", "n_iso_date", "n_iso_time", "n_iso_datetime", "n_iso_datetime_tz"]
LEAST = ["min_len", "numeric_int_min"]
MOST = ["max_len", "max_frac_digits", "numeric_int_max", "numeric_max_int_digits", "numeric_max_frac_digits", "numeric_max_sig_digits"]


class StreamingProfiler:
    """``add`` batches in order of arrival; ``result`` at any time, without ending the stream.

    Columns may appear (earlier rows count as null), stay away (the batch's rows count as null) or begin
    without a type; a change of type is an error, and then the state is as it was.  Value counts are exact
    up to ``max_values`` values a column, beyond that those of smallest hash are kept (a bottom-k sample:
    counts of kept values stay exact, the number of distinct values comes from a HyperLogLog sketch, or with
    ``distinct="exact"`` from a table of all values, which grows with them).
    """

    def __init__(self, *, distinct: str = "sketch", max_values: int = 10_000, precision: int = 14, block_rows: int = 65_536, blocks: int = 8, seed: int = 0):
        if distinct not in ("sketch", "exact"):
            raise ValueError("distinct: sketch or exact")
        self.distinct = distinct
        self.max_values, self.precision, self.block_rows, self.blocks, self.seed = max_values, precision, block_rows, blocks, seed
        self.n_rows = 0
        self.types: dict[str, T.DataType] = {}
        self.first_row: dict[str, int] = {}
        self.state: dict[str, dict] = {}
        self.values: DataFrame | None = None
        self.sketches: DataFrame | None = None
        self.seen: DataFrame | None = None
        self.sample: DataFrame | None = None

    def add(self, batch: DataFrame, order_by: list[str]) -> StreamingProfiler:
        for f in batch.schema:
            known = self.types.get(f.name)
            if known is not None and not isinstance(known, T.NullType) and not isinstance(f.dataType, T.NullType) and family(known) != family(f.dataType):
                raise ValueError(f"{f.name} was {known.simpleString()} and is {f.dataType.simpleString()}")
        usable = [f.name for f in batch.schema if not isinstance(f.dataType, (T.NullType, T.MapType, T.StructType, T.ArrayType))]
        placed = materialize(with_ordinal(batch, order_by).withColumn("__ord", F.col("__ord") + self.n_rows), "batch")
        rows = placed.count()
        stats = {c: self._reduce(placed, c) for c in usable} if rows else {}
        values, sketches, seen = self.values, self.sketches, self.seen
        if rows and usable:
            values, sketches = self._values(placed, usable)
            seen = self._seen(placed, usable) if self.distinct == "exact" else None
        sample = self._sample(placed, rows)
        # nothing above changes the state, so a failed batch leaves it whole
        for f in batch.schema:
            self.first_row.setdefault(f.name, self.n_rows)
            if f.name not in self.types or isinstance(self.types[f.name], T.NullType):
                self.types[f.name] = f.dataType
        for c, own in stats.items():
            self.state[c] = merge(self.state.get(c), own)
        self.values, self.sketches, self.seen, self.sample = values, sketches, seen, sample
        self.n_rows += rows
        return self

    def _reduce(self, df: DataFrame, c: str) -> dict:
        from profilark.operators.describe import float_stats, text_stats

        v, dtype = F.col(f"`{c}`"), df.schema[c].dataType
        aggs = {"n_rows": F.count("*"), "n_null": F.count_if(v.isNull())}
        if isinstance(dtype, (T.StringType, T.BinaryType)):
            aggs |= {"sum_len": F.coalesce(F.sum(F.octet_length(v)), F.lit(0)), "min_len": F.min(F.octet_length(v)), "max_len": F.max(F.octet_length(v))}
        if isinstance(dtype, T.StringType):
            aggs |= {k: a for k, a in text_stats(v).items() if k in SUMS + LEAST + MOST}
        if isinstance(dtype, FLOATS):
            aggs |= float_stats(v, dtype)
        real = v.isNotNull() & ~F.isnan(v) if isinstance(dtype, FLOATS) else v.isNotNull()
        key = canonical(v, dtype)
        aggs |= {"min": F.min(F.when(real, key)), "max": F.max(F.when(real, key)), "exemplar_row": F.min(F.when(v.isNotNull(), F.col("__ord"))), "null_exemplar_row": F.min(F.when(v.isNull(), F.col("__ord"))), "exemplar_value": F.min_by(text(v, dtype), F.when(v.isNotNull(), F.col("__ord")))}
        if isinstance(dtype, INTEGER_BACKED):
            aggs["ticks_min"], aggs["ticks_max"] = F.min(physical(v, dtype)), F.max(physical(v, dtype))
        out = df.agg(*(a.alias(k) for k, a in aggs.items())).first().asDict()
        out["gcd"] = int(gcds(df.select(v.alias("v")), ["v"]).first()["gcd"]) if isinstance(dtype, INTEGER_BACKED) else None
        return out

    def _long(self, df: DataFrame, columns: list[str]) -> DataFrame:
        pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), text(F.col(f"`{c}`"), df.schema[c].dataType).alias("v")) for c in columns))).alias("p")
        return df.select("__ord", pairs).select("__ord", "p.col", "p.v").where("v is not null")

    def _seen(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """All values so far, once each."""
        new = self._long(df, columns).select("col", "v")
        return materialize((new if self.seen is None else new.unionByName(self.seen)).distinct(), "seen")

    def _values(self, df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
        long = self._long(df, columns)
        counts = long.groupBy("col", "v").agg(F.count("*").alias("cnt"), F.min("__ord").alias("first"))
        if self.values is not None:
            counts = counts.unionByName(self.values.select("col", "v", "cnt", "first"))
        merged = counts.groupBy("col", "v").agg(F.sum("cnt").alias("cnt"), F.min("first").alias("first")).withColumn("h", F.xxhash64("v"))
        # a value that was left out can't come back: the k-th smallest hash never grows
        from pyspark.sql.window import Window

        nth = F.row_number().over(Window.partitionBy("col").orderBy("h", "v"))
        kept = materialize(merged.withColumn("nth", nth).where(F.col("nth") <= self.max_values).drop("nth"), "values")
        sketch = long.groupBy("col").agg(F.hll_sketch_agg("v", self.precision).alias("sketch"))
        if self.sketches is not None:
            sketch = sketch.unionByName(self.sketches).groupBy("col").agg(F.hll_union_agg("sketch").alias("sketch"))
        return kept, materialize(sketch, "sketches")

    def _sample(self, df: DataFrame, rows: int) -> DataFrame | None:
        """The ``blocks`` contiguous blocks of smallest seeded hash: a sample that batches can't change."""
        block = F.floor(F.col("__ord") / self.block_rows)
        own = df.withColumn("__block", block)
        if self.sample is not None:
            own = own.unionByName(self.sample, allowMissingColumns=True)
        if not rows and self.sample is None:
            return None
        ids = own.select("__block").distinct().orderBy(F.xxhash64(F.lit(self.seed), "__block"), "__block").limit(self.blocks)
        return materialize(own.join(F.broadcast(ids), "__block", "left_semi"), "sample")

    def result(self) -> DataFrame:
        """A row per column: its profile, estimates, the recommended type and the sample's size."""
        spark = self.values.sparkSession if self.values is not None else None
        if spark is None:
            raise ValueError("no batch with rows was added")
        counted = self.values.groupBy("col").agg(F.count("*").alias("held"), F.sum("cnt").alias("held_rows"), F.count_if(F.col("cnt") == 1).alias("f1"), F.count_if(F.col("cnt") == 2).alias("f2"), F.greatest(entropy("cnt", "cnt"), F.lit(0.0)).alias("entropy"), F.sum(F.octet_length("v")).alias("held_bytes"))
        c1 = chao1(F.col("held"), F.col("f1"), F.col("f2"))
        held = {r["col"]: r for r in counted.withColumn("est", c1[0]).withColumn("high", c1[2]).collect()}
        total = self.sketches.select("col", F.hll_sketch_estimate("sketch").alias("n")) if self.seen is None else self.seen.groupBy("col").agg(F.count("*").alias("n"))
        totals = {r["col"]: r["n"] for r in total.collect()}
        sampled = {"rows": 0, "blocks": 0}
        if self.sample is not None:
            r = self.sample.agg(F.count("*").alias("rows"), F.count_distinct("__block").alias("blocks")).first()
            sampled = r.asDict()
        out = []
        for c, dtype in self.types.items():
            own = self.state.get(c)
            if own is None and isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
                out.append((c, dtype.simpleString(), self.first_row[c], self.n_rows, None, None, None, None, None, None, "not computed", None, None, None, sampled["rows"], sampled["blocks"]))
                continue
            if own is None:
                out.append((c, dtype.simpleString(), self.first_row[c], self.n_rows, self.n_rows, 0, None, None, None, None, "null", None, None, None, sampled["rows"], sampled["blocks"]))
                continue
            absent = self.n_rows - own["n_rows"]  # rows of batches without the column
            p = dict(own, n_rows=self.n_rows, n_null=own["n_null"] + absent)
            h = held.get(c)
            exact = h is None or h["held"] < self.max_values
            distinct = (h["held"] if h else 0) if exact else max(round(totals.get(c, 0)), h["held"])
            n = p["n_rows"] - p["n_null"]
            plain = not exact or not n or distinct / n >= 0.5
            est, high = (float(distinct), float(distinct)) if plain else (max(h["est"], distinct), max(h["high"], distinct))
            p |= {"n_unique": distinct, "est_cardinality": est, "est_high": high, "sum_len_unique": round(h["held_bytes"] / h["held"] * distinct) if h else 0, "n_midnight": 0}
            kind = None
            if not isinstance(dtype, (T.DecimalType, *(() if n else (T.DataType,)))):
                kind = self._choose(c, Rules(p, dtype).candidates(), p, dtype).type
            entropy_bits = (h["entropy"] if h else 0.0) if exact else None
            out.append((c, dtype.simpleString(), self.first_row[c], p["n_rows"], p["n_null"], distinct, est, entropy_bits, str(p["min"]) if p["min"] is not None else None, str(p["max"]) if p["max"] is not None else None, kind, p.get("exemplar_row"), p.get("exemplar_value"), p.get("null_exemplar_row") if not absent or p.get("null_exemplar_row") is not None else None, sampled["rows"], sampled["blocks"]))
        return spark.createDataFrame(out, "column string, dtype string, first_row long, n_rows long, n_null long, n_unique long, est_cardinality double, entropy double, min string, max string, type string, exemplar_row long, exemplar_value string, null_exemplar_row long, n_sampled_rows long, n_sampled_blocks long")

    def _choose(self, c: str, found: list[Candidate], p: dict, dtype: T.DataType) -> Candidate:
        """The smallest candidate that the statistics prove and the sampled rows do not contradict."""
        for x in sorted((x for x in found if x.outcome != "rejected"), key=lambda x: x.projected_bytes):
            x.reason = prove(x.type, p, dtype)
            if x.reason is None and self.sample is not None and c in self.sample.columns and (bad := verify(self.sample, c, x.type)):
                x.reason = f"{bad} sampled values would change"
            if x.reason is None:
                x.outcome = "chosen"
                return x
            x.outcome = "failed"
        return Candidate(dtype.simpleString(), "original", "nothing smaller is proved")

    def save(self, path: str, spark) -> None:
        """Write the state; a file ``_DONE`` is written last."""
        for name in ("values", "sketches", "seen", "sample"):
            df = getattr(self, name)
            if df is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")
        flat = {"n_rows": self.n_rows, "distinct": self.distinct, "types": {k: t.json() for k, t in self.types.items()}, "first_row": self.first_row, "state": {c: {k: _plain(x) for k, x in own.items()} for c, own in self.state.items()}}
        spark.createDataFrame([(json.dumps(flat),)], "state string").coalesce(1).write.mode("overwrite").text(f"{path}/state")
        fs, at = _file_system(spark, f"{path}/_DONE")
        fs.create(at, True).close()

    def load(self, path: str, spark) -> StreamingProfiler:
        """Take on a state that was written."""
        flat = json.loads(spark.read.text(f"{path}/state").first()[0])
        if (kept := flat.get("distinct", "sketch")) != self.distinct:
            raise ValueError(f"the state was kept with distinct={kept}")
        self.n_rows, self.first_row = flat["n_rows"], flat["first_row"]
        self.types = {k: T._parse_datatype_json_string(t) for k, t in flat["types"].items()}
        self.state = {c: {k: _typed(x) for k, x in own.items()} for c, own in flat["state"].items()}
        for name in ("values", "sketches", "seen", "sample"):
            fs, at = _file_system(spark, f"{path}/{name}")
            setattr(self, name, spark.read.parquet(f"{path}/{name}") if fs.exists(at) else None)
        return self

    def attach(self, stream: DataFrame, order_by: list[str], checkpoint: str) -> Callable:
        """A writer that feeds every micro-batch to ``add``; a replayed batch is taken once, also after a restart."""
        spark = stream.sparkSession
        root = f"{checkpoint.rstrip('/')}/profile"

        def saved() -> list[int]:
            fs, at = _file_system(spark, root)
            if not fs.exists(at):
                return []
            names = [x.getPath().getName() for x in fs.listStatus(at)]
            return sorted(int(n) for n in names if n.isdigit() and fs.exists(_file_system(spark, f"{root}/{n}/_DONE")[1]))

        last = [-1]
        if done := saved():
            self.load(f"{root}/{done[-1]}", spark)
            last[0] = done[-1]

        def take(batch: DataFrame, number: int) -> None:
            if number <= last[0]:
                return
            self.add(batch, order_by)
            self.save(f"{root}/{number}", spark)
            last[0] = number
            for old in saved()[:-2]:  # the state in use reads the newest tables only through its own copies
                fs, at = _file_system(spark, f"{root}/{old}")
                fs.delete(at, True)

        return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)


def _file_system(spark, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _plain(x):
    """A statistic as JSON: what JSON lacks goes by name."""
    if isinstance(x, float) and not math.isfinite(x):
        return {"float": repr(x)}
    for name, kind in (("decimal", decimal.Decimal), ("datetime", datetime.datetime), ("date", datetime.date)):
        if isinstance(x, kind):
            return {name: str(x) if name == "decimal" else x.isoformat()}
    return {"bytes": bytes(x).hex()} if isinstance(x, (bytes, bytearray)) else x


def _typed(x):
    if not isinstance(x, dict):
        return x
    ((name, v),) = x.items()
    return {"float": float, "decimal": decimal.Decimal, "datetime": datetime.datetime.fromisoformat, "date": datetime.date.fromisoformat, "bytes": bytes.fromhex}[name](v)


def prove(kind: str, p: dict, dtype: T.DataType) -> str | None:
    """Why the statistics of all rows do not prove that every value fits the type and comes back; None where they do."""
    base, n = kind.split("[")[0].split("(")[0], p["n_rows"] - p["n_null"]
    if base == "null":
        return None if not n else f"{n} values"
    if not n or base in ("string", "large_string", "binary", "large_binary", "dictionary") or kind == dtype.simpleString():
        return None
    ranges = {"bool": (0, 1)} | {f"{u}int{b}": (0, 2**b - 1) if u else (-(2 ** (b - 1)), 2 ** (b - 1) - 1) for b in (8, 16, 32, 64) for u in ("", "u")}
    text_ = isinstance(dtype, T.StringType)
    if text_ and base in (*ranges, "decimal128", "float", "double"):
        if base == "bool" and p.get("n_numeric_int") != n:
            return None if p["n_unique"] <= 2 and {str(p["min"]).lower(), str(p["max"]).lower()} <= {"true", "false"} else "other words than two"
        if p["n_leading_zero"] or p["n_numeric"] != n:
            return f"{n - p['n_numeric']} values are no numbers, {p['n_leading_zero']} have leading zeros"
        if base in ranges:
            lo, hi = p["numeric_int_min"], p["numeric_int_max"]
            if p["n_numeric_int"] != n or lo is None:
                return "not all are whole"
            return None if ranges[base][0] <= lo and hi <= ranges[base][1] else f"{lo} to {hi} do not fit"
        if base == "decimal128":
            digits, places = (int(x) for x in kind[11:-1].split(","))
            return None if p["numeric_max_frac_digits"] <= places and p["numeric_max_int_digits"] + places <= digits else "more digits"
        return None if p["numeric_max_sig_digits"] <= (6 if base == "float" else 15) else f"{p['numeric_max_sig_digits']} significant digits"
    if text_:
        count = {"date32": "n_iso_date", "time64": "n_iso_time", "timestamp": "n_iso_datetime_tz" if "tz" in kind else "n_iso_datetime"}.get(base)
        return None if count and p[count] == n else "not all are of this form"
    if base == "timestamp":
        unit = {"s": 1_000_000, "ms": 1_000, "us": 1}[kind.split("[")[1].split(",")[0].rstrip("]")]
        return None if int(p["gcd"] or 0) % unit == 0 else f"ticks share only the divisor {p['gcd']}"
    if base == "date32":
        return None if p["n_midnight"] == n or isinstance(dtype, T.DateType) else "not all are midnights"
    if isinstance(dtype, FLOATS):
        if base == "float":
            return None if not p["n_f32_inexact"] else f"{p['n_f32_inexact']} values need 64 bits"
        if p["n_nan"] or p["n_inf"]:
            return "values that are no numbers"
        if base == "decimal128":
            digits, places = (int(x) for x in kind[11:-1].split(","))
            whole = len(str(int(max(abs(p["min"]), abs(p["max"])))))
            return None if p["max_frac_digits"] <= places and whole + places <= digits <= 15 else "more digits than a double surely holds"
        if p["n_fractional"]:
            return f"{p['n_fractional']} values are no whole numbers"
    if base in ranges:
        lo, hi = p["min"], p["max"]
        return None if ranges[base][0] <= lo and hi <= ranges[base][1] else f"{lo} to {hi} do not fit"
    return "no statistic speaks for it"


def scaled_up(sampled_bytes: float, sampled_rows: int, rows: int) -> float:
    """Bytes of a sample, scaled to the rows of the stream."""
    return sampled_bytes * rows / sampled_rows if sampled_rows else math.nan


def usable_granularities(granularities: tuple[int, ...], index_granularity: int, block_rows: int) -> tuple[list[int], list[tuple[int, str]]]:
    """Skip index granularities whose windows fit a sampled block, and the others with the reason."""
    fits = [g for g in granularities if g * index_granularity <= block_rows]
    return fits, [(g, f"a window of {g * index_granularity} rows exceeds a block of {block_rows}") for g in granularities if g not in fits]


def merge(a: dict | None, b: dict) -> dict:
    """The statistics of two runs of rows, the first before the second."""
    if a is None:
        return dict(b)
    out = dict(b)
    for k in set(a) | set(b):
        x, y = a.get(k), b.get(k)
        if x is None or y is None:
            out[k] = y if x is None else x
        elif k in SUMS:
            out[k] = x + y
        elif k in LEAST or k in ("min", "ticks_min", "exemplar_row", "null_exemplar_row"):
            out[k] = min(x, y)
        elif k in MOST or k in ("max", "ticks_max"):
            out[k] = max(x, y)
        elif k == "gcd":
            out[k] = math.gcd(x, y)
        elif k == "exemplar_value":
            out[k] = x
    return out


def replay(profiler: StreamingProfiler, batches: list[DataFrame], order_by: list[str]) -> StreamingProfiler:
    for b in batches:
        profiler.add(b, order_by)
    return profiler


