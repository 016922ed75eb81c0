"""Storage recommendations per column: the narrowest lossless type, a codec chain, compression and a skip index.

One profile of the frame (see ``Describe``) proposes candidate types by rule; they are tried in order
of (rejected, projected size, rank) and the first whose values all come back from a cast wins, checked
by one aggregation over the column.  Everything that reaches the driver is one row per column.
"""

from __future__ import annotations

import io
import math
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilark.functions.cluster import materialize, ship
from profilark.operators.canon import FLOATS, INTEGERS, SCALARS, physical
from profilark.operators.describe import Describe
from profilark.operators.integers import Delta
from profilark.operators.order import with_ordinal
from profilark.operators.sequence import MinMaxIndex, Ranked, SetIndex, measure

UNITS = (("s", 1_000_000), ("ms", 1_000), ("us", 1))
BLOOM_BITS = {0.001: 15, 0.01: 10, 0.025: 8, 0.05: 7}


@dataclass
class Candidate:
    """A proposed type: its name, the rule and evidence, sizes, and what became of it."""

    type: str
    rule: str
    evidence: str
    predicted_bytes: float | None = None
    projected_bytes: float | None = None
    outcome: str = "proposed"  # chosen, rejected, failed, passed over
    reason: str | None = None
    values: tuple = field(default=(), repr=False)


@dataclass(frozen=True)
class Shape:
    """What an Arrow body's size depends on."""

    rows: int
    nulls: int
    bytes: int = 0
    distinct: int = 0
    distinct_bytes: int = 0

    def with_distinct(self, c: float) -> Shape:
        mean = self.distinct_bytes / self.distinct if self.distinct else 0
        return Shape(self.rows, self.nulls, self.bytes, round(c), round(mean * c))


def padded(n: float) -> int:
    return -(-math.ceil(n) // 8) * 8


WIDTHS = {"bool": 0.125, "int8": 1, "uint8": 1, "int16": 2, "uint16": 2, "int32": 4, "uint32": 4, "int64": 8, "uint64": 8, "float": 4, "double": 8, "date32": 4, "time32": 4, "time64": 8, "timestamp": 8, "duration": 8}


def body_bytes(kind: str, s: Shape) -> int:
    """Bytes of an Arrow IPC body: buffers padded to eight bytes, validity only where there are nulls."""
    base = kind.split("[")[0].split("(")[0]
    valid = padded(s.rows / 8) if s.nulls else 0
    if base == "null":
        return 0
    if base.startswith("decimal"):
        return valid + padded(16 * s.rows)
    if base.startswith("fixed_size_binary"):
        return valid + padded(int(kind[18:-1]) * s.rows)
    if base in ("string", "binary"):
        return valid + padded(4 * (s.rows + 1)) + padded(s.bytes)
    if base in ("large_string", "large_binary"):
        return valid + padded(8 * (s.rows + 1)) + padded(s.bytes)
    if base == "dictionary":
        key = key_type(s.distinct)
        return valid + padded(WIDTHS[key] * s.rows) + padded(4 * (s.distinct + 1)) + padded(s.distinct_bytes)
    return valid + padded(WIDTHS[base] * s.rows)


def key_type(c: float) -> str:
    """The narrowest key of a dictionary of c values."""
    return next((k for k, top in (("int8", 127), ("int16", 32_767), ("int32", 2**31 - 1)) if c <= top), "int64")


def integer_type(lo: int, hi: int) -> str:
    """0 and 1 are Booleans; else the narrowest unsigned type from 0 on, the narrowest signed one, or a decimal."""
    if 0 <= lo and hi <= 1:
        return "bool"
    for bits in (8, 16, 32, 64):
        if lo >= 0 and hi < 1 << bits:
            return f"uint{bits}"
        if lo < 0 and -(1 << (bits - 1)) <= lo and hi < 1 << (bits - 1):
            return f"int{bits}"
    return f"decimal128({max(len(str(abs(lo))), len(str(abs(hi))))}, 0)"


def spark_type(kind: str) -> str:
    """The Spark type that holds a recommended type (unsigned ones take the next wider signed)."""
    base = kind.split("[")[0]
    known = {"bool": "boolean", "int8": "tinyint", "uint8": "smallint", "int16": "smallint", "uint16": "int", "int32": "int", "uint32": "bigint", "int64": "bigint", "uint64": "decimal(20,0)", "float": "float", "double": "double", "date32": "date", "timestamp": "timestamp", "string": "string", "large_string": "string", "dictionary": "string", "binary": "binary"}
    return known.get(base) or (kind.replace("decimal128", "decimal").replace(" ", "") if base.startswith("decimal128") else "string")


def original_type(dtype: T.DataType) -> str:
    simple = dtype.simpleString()
    names = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "boolean": "bool", "date": "date32", "timestamp": "timestamp[us, tz]", "timestamp_ntz": "timestamp[us]"}
    return names.get(simple) or (f"decimal128({dtype.precision}, {dtype.scale})" if isinstance(dtype, T.DecimalType) else simple)


class Rules:
    """Candidate types of one column from its profile ``p``."""

    def __init__(self, p: dict, dtype: T.DataType, categorical_threshold: int = 10_000, boolean_pairs: tuple[tuple[str, str], ...] = (("true", "false"),)):
        self.p, self.dtype, self.threshold, self.pairs = p, dtype, categorical_threshold, boolean_pairs
        self.shape = Shape(p["n_rows"], p["n_null"], p.get("sum_len") or 0, p.get("n_unique") or 0, p.get("sum_len_unique") or 0)
        self.n = p["n_rows"] - p["n_null"]

    def candidates(self) -> list[Candidate]:
        """All candidates, sized; the original type is always one, and the only one but Null where all is null."""
        out = [Candidate("null", "null", "every row is null")] if not self.n else []
        if self.n:
            for rule in (self._integer, self._decimal, self._float, self._temporal, self._text, self._dictionary):
                out += rule() or []
        if original_type(self.dtype) not in {c.type for c in out}:
            out.append(Candidate(original_type(self.dtype), "original", "as it is"))
        for c in out:
            c.predicted_bytes = body_bytes(c.type, self.shape)
            c.projected_bytes = body_bytes(c.type, self.shape.with_distinct(self.cardinality())) if c.type.startswith("dictionary") else c.predicted_bytes
        return out

    def cardinality(self) -> float:
        return max(self.p.get("est_high") or self.p.get("est_cardinality") or 0, self.p.get("n_unique") or 0)

    def _integer(self):
        if isinstance(self.dtype, INTEGERS):
            lo, hi = int(self.p["min"]), int(self.p["max"])
            return [Candidate(integer_type(lo, hi), "integer", f"{lo} to {hi}")]

    def _decimal(self):
        if isinstance(self.dtype, T.DecimalType):
            zeros, g = 0, int(self.p["gcd"] or 0)
            while g and g % 10 == 0 and zeros < self.dtype.scale:
                g, zeros = g // 10, zeros + 1
            scale = self.dtype.scale - zeros
            from decimal import Decimal

            ends = [int(Decimal(self.p[k]).scaleb(scale)) for k in ("min", "max")]
            kind = integer_type(*ends) if scale == 0 else f"decimal128({max(max(len(str(abs(x))) for x in ends), scale)}, {scale})"
            return [Candidate(kind, "decimal", f"{zeros} common trailing zeros")]

    def _float(self):
        p = self.p
        if not isinstance(self.dtype, FLOATS):
            return None
        out = []
        if not p["n_nan"] and not p["n_inf"]:
            lo, hi = float(p["min"]), float(p["max"])
            if not p["n_fractional"]:
                out.append(Candidate(integer_type(int(lo), int(hi)), "whole floats", f"{lo:g} to {hi:g}"))
            else:
                digits = len(str(int(max(abs(lo), abs(hi))))) + p["max_frac_digits"]
                if digits <= 38:
                    out.append(Candidate(f"decimal128({digits}, {p['max_frac_digits']})", "float as decimal", f"{p['max_frac_digits']} decimal places"))
        if isinstance(self.dtype, T.DoubleType) and not p["n_f32_inexact"]:
            out.append(Candidate("float", "narrow float", "every value fits 32 bits"))
        return out

    def _temporal(self):
        if not isinstance(self.dtype, (T.TimestampType, T.TimestampNTZType)):
            return None
        out = []
        if isinstance(self.dtype, T.TimestampNTZType) and self.p["n_midnight"] == self.n:
            out.append(Candidate("date32", "midnights", "every value is a midnight"))
        g = int(self.p["gcd"] or 0)
        unit = next(u for u, k in UNITS if g % k == 0)
        zone = ", tz" if isinstance(self.dtype, T.TimestampType) else ""
        return [*out, Candidate(f"timestamp[{unit}{zone}]", "coarser unit", f"ticks share the divisor {g}")]

    def _text(self):
        p = self.p
        if not isinstance(self.dtype, T.StringType):
            return None
        values = {str(p["min"]).lower(), str(p["max"]).lower()}
        if p["n_unique"] <= 2 and any(values <= {a.lower(), b.lower()} for a, b in self.pairs):
            return [Candidate("bool", "boolean text", f"only {' and '.join(sorted(values))}")]
        if p["n_numeric_int"] == self.n and not p["n_leading_zero"] and p["numeric_int_min"] is not None:
            return [Candidate(integer_type(int(p["numeric_int_min"]), int(p["numeric_int_max"])), "integer text", "all whole numbers")]
        if p["n_numeric"] == self.n and not p["n_leading_zero"]:
            places, whole = p["numeric_max_frac_digits"], max(p["numeric_max_int_digits"], 1)
            out = []
            if whole + places <= 38:
                out.append(Candidate(f"decimal128({whole + places}, {places})", "decimal text", f"{places} decimal places"))
            if p["numeric_max_sig_digits"] <= 15:
                out.append(Candidate("float" if p["numeric_max_sig_digits"] <= 6 else "double", "float text", f"{p['numeric_max_sig_digits']} digits"))
            return out
        for count, kind in (("n_iso_date", "date32"), ("n_iso_time", "time64[us]"), ("n_iso_datetime", "timestamp[us]"), ("n_iso_datetime_tz", "timestamp[us, tz]")):
            if p[count] == self.n:
                return [Candidate(kind, "ISO 8601 text", f"all {count[2:]}")]
        return [Candidate("string" if self.shape.bytes < 1 << 31 else "large_string", "text", f"{self.shape.bytes} bytes")]

    def _dictionary(self):
        if not isinstance(self.dtype, T.StringType):
            return None
        c = self.cardinality()
        made = Candidate(f"dictionary[{key_type(c)}, string]", "dictionary", f"{c:.0f} values")
        if c > self.threshold:
            made.outcome, made.reason = "rejected", f"{c:.0f} values exceed {self.threshold}"
        return [made]


def verify(df: DataFrame, column: str, kind: str) -> int:
    """Rows whose value a cast to the type and back would change (numbers in text are compared by value)."""
    v, dtype = F.col(f"`{column}`"), df.schema[column].dataType
    base = kind.split("[")[0]
    if base in ("string", "large_string", "dictionary", "null", dtype.simpleString()):
        return 0
    if base == "timestamp" and not isinstance(dtype, T.StringType):
        ticks = dict(UNITS)[kind.split("[")[1].split(",")[0].rstrip("]")]
        bad = physical(v, dtype) % ticks != 0
    elif isinstance(dtype, T.StringType):
        if base == "bool":
            bad = ~F.lower(v).isin("true", "false", "0", "1", "yes", "no", "t", "f", "y", "n")
        elif base == "time64":
            bad = F.concat(F.lit("1970-01-01 "), v).try_cast("timestamp_ntz").isNull()
        elif base in ("date32", "timestamp"):
            bad = v.try_cast(spark_type(kind)).isNull()
        elif base in ("float", "double"):
            bad = v.try_cast(spark_type(kind)).isNull() | (v.try_cast(spark_type(kind)).cast("string").try_cast("decimal(38,15)") != v.try_cast("decimal(38,15)"))
        else:
            bad = v.try_cast(spark_type(kind)).isNull() | (v.try_cast(spark_type(kind)).cast("decimal(38,15)") != v.try_cast("decimal(38,15)"))
    else:
        back = v.try_cast(spark_type(kind))
        bad = back.isNull() | (back.cast(dtype) != v)
    return df.where(v.isNotNull() & F.coalesce(bad, F.lit(True))).count()


def choose(df: DataFrame, column: str, candidates: list[Candidate]) -> Candidate:
    """The first candidate in order that verifies; failures keep their reasons."""
    order = sorted(enumerate(candidates), key=lambda x: (x[1].outcome == "rejected", x[1].projected_bytes, x[0]))
    chosen = None
    for _, c in order:
        if c.outcome == "rejected":
            continue
        if chosen is not None:
            c.outcome = "passed over"
        elif bad := verify(df, column, c.type):
            c.outcome, c.reason = "failed", f"{bad} values would change"
        else:
            c.outcome, chosen = "chosen", c
    assert chosen is not None  # the original type always verifies
    return chosen


def column_store_type(kind: str, lo: int | None, hi: int | None, nullable: bool, values: list[str] | None = None) -> str:
    """The type's name in a column store with 8 to 64 bit integers, scaled decimals and low-cardinality text.

    Lists are arrays and structs tuples, neither of them nullable; text of one length is a fixed string; a
    dictionary whose few ``values`` are all known is an enumeration.
    """
    if kind.startswith(("list[", "large_list[", "fixed_size_list[")):
        inner = kind[kind.index("[") + 1 : -1]
        inner = inner.rsplit(",", 1)[0] if kind.startswith("fixed_size_list") else inner
        return f"Array({column_store_type(inner, lo, hi, nullable)})"
    if kind.startswith("struct["):
        return "Tuple(" + ", ".join(f"{n} {column_store_type(t, None, None, nullable)}" for n, t in struct_fields(kind)) + ")"
    base = kind.split("[")[0]
    if base == "dictionary":
        if values is not None and 0 < len(values) <= 32_768:
            shown = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + f"' = {k}" for k, v in enumerate(sorted(values), 1))
            name = f"Enum{8 if len(values) <= 127 else 16}({shown})"
            return f"Nullable({name})" if nullable else name
        return "LowCardinality(Nullable(String))" if nullable else "LowCardinality(String)"
    if base.startswith("decimal128"):
        p, s = (int(x) for x in kind[11:-1].split(","))
        name = f"Decimal{32 if p <= 9 else 64 if p <= 18 else 128}({s})"
    elif base.startswith("fixed_size_binary"):
        name = f"FixedString({kind[18:-1]})"
    elif base == "timestamp":
        unit = kind[10:].rstrip("]").split(",")[0]
        digits = {"s": 0, "ms": 3, "us": 6, "ns": 9}[unit]
        name = "DateTime" if unit == "s" and lo is not None and 0 <= lo and hi < 1 << 32 else f"DateTime64({digits})"
    elif base == "date32":
        name = "Date" if lo is not None and 0 <= lo and hi <= 65_535 else "Date32"
    elif base in ("time64", "time32"):
        name = "Time64(6)"
    elif base in ("string", "large_string", "binary", "large_binary"):
        name = "String"
    else:
        names = {"bool": "Bool", "float": "Float32", "double": "Float64", "null": "Nothing"}
        name = names.get(base) or base.replace("int", "Int").replace("u", "U", 1)
    return f"Nullable({name})" if nullable else name


def struct_fields(kind: str) -> list[tuple[str, str]]:
    """Names and types of ``struct[a: uint8, b: list[string]]``."""
    out, depth, at = [], 0, 7
    for k, ch in enumerate(kind[7:], 7):
        depth += ch in "[("
        depth -= ch in "])"
        if (ch == "," and depth == 0) or depth < 0:
            name, _, inner = kind[at:k].partition(":")
            out.append((name.strip(), inner.strip()))
            at = k + 1
    return out


def transform_winner(sizes: dict[str, int], least: float = 0.01) -> str:
    """The transform of the smallest measured size; ``none`` unless it saves this share of the bytes."""
    best = min(sizes, key=lambda k: (sizes[k], k != "none", k))
    return best if sizes[best] <= sizes["none"] * (1 - least) else "none"


def measured_sizes(df: DataFrame, column: str, kind: str, levels: tuple[int, ...] = (1, 3, 9)) -> dict[str, int]:
    """Bytes of the column's Arrow bodies as the type, plain and by codec, added up over batches of the whole column."""
    ship(df.sparkSession)
    own = df.select(F.col(f"`{column}`").cast(spark_type(kind)).alias("v"))

    def run(batches):
        total: dict[str, int] = {}
        for batch in batches:
            if kind.startswith("dictionary"):
                batch = pa.RecordBatch.from_arrays([batch.column(0).dictionary_encode()], names=["v"])
            for name in ("none", "lz4", *(f"zstd:{k}" for k in levels)):
                codec, _, level = name.partition(":")
                options = pa.ipc.IpcWriteOptions(compression=None if codec == "none" else pa.Codec("lz4" if codec == "lz4" else "zstd", int(level) if level else None))
                sink = io.BytesIO()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                    head = sink.tell()
                    out.write_batch(batch)
                    total[name] = total.get(name, 0) + sink.tell() - head
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([*total]), pa.array([*total.values()])], names=["codec", "bytes"])

    got = own.mapInArrow(run, "codec string, bytes long").groupBy("codec").agg(F.sum("bytes").alias("bytes")).collect()
    return {r["codec"]: r["bytes"] for r in got}


def transforms(width: int, gcd: int, delta: dict | None, value_bytes: float | None = None) -> list[tuple[str, str, str]]:
    """(transform, outcome, evidence): which of GCD, Delta and DoubleDelta is worth a trial."""
    out = [("none", "kept", "")]
    freed = gcd > 1 and gcd.bit_length() > 8 or gcd > 1 and value_bytes is not None and value_bytes - math.log2(gcd) / 8 <= value_bytes - 1
    out.append(("GCD", "kept" if freed else "pruned", f"divisor {gcd}"))
    if delta and delta["n_deltas"]:
        v, d, dd = (delta[k] for k in ("value_bytes_mean", "delta_bytes_mean", "double_delta_bytes_mean"))
        out.append(("Delta", "kept" if d < v else "pruned", f"{d:.2f} bytes a difference, {v:.2f} a value"))
        out.append(("DoubleDelta", "kept" if dd < min(v, d) else "pruned", f"{dd:.2f} bytes a second difference"))
    return out


def pick_compression(sizes: dict[str, int], min_saving: float = 0.10, level_tolerance: float = 0.01) -> str:
    """LZ4 unless ZSTD is ``min_saving`` smaller; then its lowest level within the tolerance of the best."""
    levels = {int(k.split(":")[1]): v for k, v in sizes.items() if k.startswith("zstd:")}
    best = min(levels.values())
    if best > sizes["lz4"] * (1 - min_saving):
        return "lz4" if sizes["lz4"] < sizes["none"] else "none"
    return f"zstd:{min(k for k, v in levels.items() if v <= best * (1 + level_tolerance))}"


@dataclass
class Measured:
    """A skip index that was measured."""

    kind: str  # minmax, set, bloom
    granularity: int
    skip_rows: float
    expected_skip_rows: float
    bytes: int
    max_size: int | None = None
    overflow: float = 0.0
    outcome: str = "proposed"
    evidence: str = ""


RANK = {"minmax": 0, "set": 1, "bloom": 2}


def decide_skip(cheap: list[Measured], bloom, column_bytes: float, min_skip: float = 0.3, min_gain: float = 0.1, max_overflow: float = 0.1, tie: float = 0.02) -> Measured | None:
    """Screen, then per kind the largest granularity within ``tie`` of its best, then the best kind.

    ``bloom`` is called only where nothing cheaper passes, and must save more bytes a query than it takes.
    """

    def passes(m: Measured) -> bool:
        if m.kind == "set" and m.overflow >= max_overflow:
            m.outcome, m.evidence = "pruned", f"{m.overflow:.2f} of windows overflow"
        elif not m.skip_rows >= min_skip:
            m.outcome, m.evidence = "rejected", f"skips {m.skip_rows:.2f}, below {min_skip:.2f}"
        elif not m.skip_rows - m.expected_skip_rows >= min_gain:
            m.outcome, m.evidence = "rejected", f"gains {m.skip_rows - m.expected_skip_rows:.2f} over a random order"
        elif m.kind == "bloom" and m.skip_rows * column_bytes <= m.bytes:
            m.outcome, m.evidence = "rejected", f"saves {m.skip_rows * column_bytes:.0f} bytes a query and takes {m.bytes}"
        return m.outcome == "proposed"

    left = [m for m in cheap if passes(m)] or [m for m in bloom() if passes(m)]
    winners = []
    for kind in {(m.kind, m.max_size) for m in left}:
        own = [m for m in left if (m.kind, m.max_size) == kind]
        top = max(m.skip_rows for m in own)
        win = max((m for m in own if m.skip_rows >= top - tie), key=lambda m: m.granularity)
        for m in own:
            if m is not win:
                m.outcome, m.evidence = "rejected", f"granularity {win.granularity} does as well"
        winners.append(win)
    if not winners:
        return None
    top = max(m.skip_rows for m in winners)
    chosen = min((m for m in winners if m.skip_rows >= top - tie), key=lambda m: (m.bytes, RANK[m.kind]))
    for m in winners:
        m.outcome = "chosen" if m is chosen else "rejected"
    return chosen


SCHEMA = "column string, dtype string, class string, nullable boolean, type string, store_type string, predicted_bytes double, transforms array<struct<transform: string, outcome: string, evidence: string>>, skip_index string, candidates array<struct<type: string, rule: string, evidence: string, predicted_bytes: double, projected_bytes: double, outcome: string, reason: string>>, exemplar string, top_k array<struct<value: string, count: bigint>>"


class OneShotRecommender:
    """``add`` one frame, then ``result``: a row per column; the result is kept."""

    def __init__(self, *, categorical_threshold: int = 10_000, top_k: int | None = 256, boolean_pairs=(("true", "false"),), skip_granularities=(1, 2, 4, 8), set_max_sizes=(125, 250), bloom_fprs=(0.025,), index_granularity: int = 8192, skip: bool = True, compression: bool = False, **skip_options):
        self.compression = compression
        self.options = {"categorical_threshold": categorical_threshold, "boolean_pairs": boolean_pairs}
        self.top_k, self.granularities, self.set_sizes, self.fprs, self.index_granularity, self.skip, self.skip_options = top_k, skip_granularities, set_max_sizes, bloom_fprs, index_granularity, skip, skip_options
        self.frame: DataFrame | None = None
        self._result: DataFrame | None = None

    def add(self, frame: DataFrame, order_by: list[str]) -> OneShotRecommender:
        if self.frame is not None:
            raise ValueError("a frame was added before")
        self.frame, self.order_by = frame, order_by
        return self

    def result(self) -> DataFrame:
        if self._result is None:
            self._result = self._recommend()
        return self._result

    def _recommend(self) -> DataFrame:
        df = self.frame
        describe = Describe(categorical_threshold=self.options["categorical_threshold"]).add({"f": df}, {"f": self.order_by})
        profiles = {r["col_a"]: r.asDict() for r in describe.result().collect() if r["status"] == "computed"}
        whole = [c for c in profiles if not isinstance(df.schema[c].dataType, (T.DecimalType, *FLOATS)) and profiles[c]["gcd"] is not None]
        deltas = {r["col_a"]: r.asDict() for r in Delta(baseline=False).add({"f": df}, {"f": self.order_by}).result([(("f", c),) for c in whole]).collect()} if whole else {}
        indexed = [c for c, p in profiles.items() if self.skip and isinstance(df.schema[c].dataType, SCALARS) and p["n_rows"] > p["n_null"]]
        if indexed:  # put in order once for all columns and windows
            ordered = materialize(with_ordinal(df.select(*dict.fromkeys([*indexed, *self.order_by])), self.order_by), "ordered")
            n_rows = ordered.count()
        rows = []
        for c, p in profiles.items():
            dtype = df.schema[c].dataType
            if isinstance(dtype, (T.ArrayType, T.StructType)):
                found = self._nested(df, c, dtype, p)
                kind, nullable = found[-1].type, p["n_null"] > 0
                inner = bool(p.get("inner_n_null")) if isinstance(dtype, T.ArrayType) else nullable
                rows.append((c, dtype.simpleString(), p["class"], nullable, kind, column_store_type(kind, None, None, inner), found[-1].predicted_bytes, [], None, [(x.type, x.rule, x.evidence, x.predicted_bytes, x.projected_bytes, x.outcome, x.reason) for x in found], None, self._inner_top(df, c) if isinstance(dtype, T.ArrayType) and self.top_k and kind.startswith(("list[dict", "fixed_size_list[dict")) else []))
                continue
            found = Rules(p, dtype, **self.options).candidates()
            chosen = choose(df, c, found)
            lo = hi = None
            if isinstance(dtype, INTEGERS) and p["min"] is not None:
                lo, hi = int(p["min"]), int(p["max"])
            steps = transforms(round(WIDTHS.get(chosen.type.split("[")[0], 16)), int(p["gcd"] or 0), deltas.get(c), (deltas.get(c) or {}).get("value_bytes_mean")) if c in deltas else []
            skip = self._skip(ordered, n_rows, c, chosen.predicted_bytes or 0) if c in indexed else None
            top = self._top(c) if self.top_k and any(x.rule == "dictionary" and x.outcome != "rejected" for x in found) else []
            shown = [(x.type, x.rule, x.evidence, float(x.predicted_bytes), float(x.projected_bytes), x.outcome, x.reason) for x in found]
            rows.append((c, dtype.simpleString(), p["class"], p["n_null"] > 0, chosen.type, column_store_type(chosen.type, lo, hi, p["n_null"] > 0), float(chosen.predicted_bytes), steps, skip, shown, p["min"], top))
        out = df.sparkSession.createDataFrame(rows, SCHEMA)
        if not self.compression:
            return out
        picked = []
        for row in rows:
            flat = not isinstance(df.schema[row[0]].dataType, (T.ArrayType, T.StructType)) and row[4] != "null"
            sizes = measured_sizes(df, row[0], row[4]) if flat and df.schema[row[0]].dataType != T.BinaryType() else {}
            picked.append((row[0], pick_compression(sizes) if sizes else None, sorted(sizes.items())))
        return out.join(F.broadcast(df.sparkSession.createDataFrame(picked, "column string, compression string, measured array<struct<codec: string, bytes: bigint>>")), "column", "left")

    def _nested(self, df: DataFrame, c: str, dtype: T.DataType, p: dict) -> list[Candidate]:
        """Candidates of a list or struct, the chosen one last: inner types first, then the shape around them."""
        v, n = F.col(f"`{c}`"), p["n_rows"]
        valid = padded(n / 8) if p["n_null"] else 0
        if isinstance(dtype, T.StructType):
            parts = [(f.name, self._inner(df.select(v.getField(f.name).alias("v")), f.dataType)) for f in dtype.fields]
            size = float(valid + sum(x.predicted_bytes or 0 for _, x in parts))
            return [Candidate("struct[" + ", ".join(f"{k}: {x.type}" for k, x in parts) + "]", "struct", "field by field", size, size, "chosen")]
        flat = df.where(v.isNotNull()).select(F.explode(v).alias("v"))
        inner = self._inner(flat, dtype.elementType)
        body = float(inner.predicted_bytes or 0)
        kept = Candidate(f"list[{inner.type}]", "list", f"inner {inner.rule}: {inner.evidence}", valid + padded(4 * (n + 1)) + body, None, "chosen")
        out, lo, hi = [kept], p["min_len"], p["max_len"]
        if lo is not None and lo == hi and lo > 0 and not p["n_null"]:
            kept.outcome = "passed over"
            out.append(Candidate(inner.type, "single item", "every list holds one item", body, None, "chosen") if hi == 1 else Candidate(f"fixed_size_list[{inner.type}, {hi}]", "one length", f"every list holds {hi} items", body, None, "chosen"))
        for x in out:
            x.projected_bytes = x.predicted_bytes
        return out

    def _inner(self, values: DataFrame, dtype: T.DataType) -> Candidate:
        """The chosen candidate of a column ``v`` (one level down, at any depth)."""
        values = values.withColumn("o", F.monotonically_increasing_id())
        p = Describe(categorical_threshold=self.options["categorical_threshold"]).add({"f": values}, {"f": ["o"]}).result([(("f", "v"),)]).first().asDict()
        if isinstance(dtype, (T.ArrayType, T.StructType)):
            return self._nested(values, "v", dtype, p)[-1]
        return choose(values, "v", Rules(p, dtype, **self.options).candidates())

    def _inner_top(self, df: DataFrame, c: str) -> list[tuple[str, int]]:
        counts = df.select(F.explode(F.col(f"`{c}`")).alias("v")).where("v is not null").groupBy(F.col("v").cast("string").alias("v")).count()
        return [(r["v"], r["count"]) for r in counts.orderBy(F.desc("count"), "v").limit(self.top_k).collect()]

    def _top(self, c: str) -> list[tuple[str, int]]:
        counts = self.frame.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("v")).count()
        return [(r["v"], r["count"]) for r in counts.orderBy(F.desc("count"), "v").limit(self.top_k).collect()]

    def _skip(self, ordered: DataFrame, n: int, c: str, column_bytes: float) -> str | None:
        fits = [g for g in self.granularities if self.index_granularity * g <= n] or [self.granularities[0]]
        tried = [("minmax", g, None, MinMaxIndex(index_granularity=self.index_granularity, granularity=g)) for g in fits]
        tried += [("set", g, s, SetIndex(index_granularity=self.index_granularity, granularity=g, max_size=s or 0)) for g in fits for s in (*self.set_sizes, None)]  # None: what a Bloom filter would hold
        found = []
        for (kind, g, size, _), r in zip(tried, measure(Ranked(ordered, c, n), [x[-1] for x in tried])):
            entry = 16 if kind == "minmax" else 8 * r["window_distinct_mean"]
            found.append(Measured(kind, g, r["skip_rows_mean"], r["expected_skip_rows"], round(-(-n // (self.index_granularity * g)) * entry), size, r["overflow_fraction"] if kind == "set" else 0.0))
        cheap = [m for m in found if m.kind == "minmax"] + [m for m in found if m.kind == "set" and m.max_size is not None]

        def bloom():
            out = []
            for m in (m for m in found if m.kind == "set" and m.max_size is None):
                for fpr in self.fprs:
                    bits = BLOOM_BITS.get(fpr, math.ceil(-math.log(fpr) / math.log(2) ** 2))
                    out.append(Measured("bloom", m.granularity, m.skip_rows * (1 - fpr), m.expected_skip_rows * (1 - fpr), round(m.bytes * bits / 64)))
            return out

        best = decide_skip(cheap, bloom, column_bytes, **self.skip_options)
        if best is None:
            return None
        name = "minmax" if best.kind == "minmax" else f"set({best.max_size})" if best.kind == "set" else "bloom_filter"
        return f"{name} GRANULARITY {best.granularity}"


def block_statistics(df: DataFrame, column: str, order_by: list[str], block_rows: int) -> DataFrame:
    """``block, lo, hi, n_distinct, n_null`` of contiguous blocks of rows: what a skip index would hold."""
    placed = with_ordinal(df.select(*dict.fromkeys([column, *order_by])), order_by)
    v = F.col(column)
    return placed.groupBy(F.floor(F.col("__ord") / block_rows).alias("block")).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count_distinct(v).alias("n_distinct"), F.count_if(v.isNull()).alias("n_null"))
