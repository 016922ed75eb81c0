"""Order-dependent techniques: runs of equal values, and how well skip indexes would do."""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilark.functions.cluster import materialize, ship
from profilark.functions.scalar import miss_chance, normal_below
from profilark.operators.canon import SCALARS, canonical, stacks, value_counts
from profilark.operators.contract import Technique, by_frame, union
from profilark.operators.order import ORD, chunk_window, running_sum, with_halo, with_ordinal

D, L = T.DoubleType(), T.LongType()


def run_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``col, n_rows, n_runs`` of a frame with an ordinal; nulls are one value."""
    parts = []
    for s in stacks(df, columns, ORD):
        w = chunk_window("col")
        new = (F.col(ORD) == 0) | ~F.col("v").eqNullSafe(F.lag("v").over(w))
        parts.append(with_halo(s, 1).withColumn("new", new).where("not __halo").groupBy("col").agg(F.count("*").alias("n_rows"), F.count_if("new").alias("n_runs")))
    return union(parts)


def moments(n: int, s2: int, s3: int) -> tuple[float, float]:
    """Mean and variance of the number of runs of a random order, from power sums of the counts."""
    top, bottom = s2 * (s2 + n * (n + 1)) - 2 * n * s3 - n**3, n * n * (n - 1)
    return 1 + (n * n - s2) / n, top / bottom if bottom else math.nan


class RunsTest(Technique):
    """Runs of equal values, and whether they are fewer than chance would make (one-sided)."""

    ORDERED = True
    DESCRIPTORS = {"dtype": T.StringType()}
    METRICS = {"n_rows": L, "n_runs": L, "expected_runs": D, "z": D, "p_value": D, "mean_run_length": D}
    RTOL, ATOL = 1e-9, 1e-300

    def eligible(self, dtype):
        return isinstance(dtype, SCALARS)

    def needs_rows(self):
        return True

    def _compute(self, combos):
        out = []
        for n, own in by_frame(combos).items():
            columns = [c for ((_, c),) in own]
            df = with_ordinal(self.frames[n].select(*dict.fromkeys([*columns, *self.orders[n]])), self.orders[n])
            sums = value_counts(df, columns).groupBy("col").agg(*(F.sum(_power("cnt", k)).alias(f"s{k}") for k in (2, 3)))
            rows = []
            for r in run_counts(df, columns).join(sums, "col").collect():  # one row a column
                m, runs, s2, s3 = r["n_rows"], r["n_runs"], int(r["s2"]), int(r["s3"])
                expected, variance = moments(m, s2, s3)
                z = ((m * (runs - 1) - (m * m - s2)) / m) / math.sqrt(variance) if variance > 0 else math.nan
                rows.append((n, r["col"], m, runs, float(expected), z, math.nan if math.isnan(z) else normal_below(z), m / runs))
            out.append(df.sparkSession.createDataFrame(rows, "df_a string, col_a string, n_rows long, n_runs long, expected_runs double, z double, p_value double, mean_run_length double"))
        return union(out)


def _power(column: str, k: int):
    x = F.col(column).cast("decimal(12,0)")
    return x * x if k == 2 else (x * x).cast("decimal(24,0)") * x


COMMON = {"n_rows": L, "n_non_null": L, "n_distinct": L, "window_rows": L, "n_windows": L, "skip_rows_mean": D, "skip_rows_std": D, "skip_values_mean": D, "skip_values_std": D, "expected_skip_rows": D, "expected_skip_values": D}


class Ranked:
    """A column in order: rows with the id of their value (by size), its count and the rows below it (-1, 0, 0: null)."""

    def __init__(self, df: DataFrame, column: str, rows: int):
        values = df.select(ORD, canonical(F.col(f"`{column}`"), df.schema[column].dataType).alias("v"))
        counts = values.where("v is not null").groupBy("v").agg(F.count("*").alias("cnt"))
        ids = running_sum(with_ordinal(counts, ["v"], "id").withColumn("one", F.lit(0)), "cnt", "upto", ("one",), "id")
        self.ids = materialize(ids.select("v", "id", "cnt", (F.col("upto") - F.col("cnt")).alias("below")), "ids")
        total = self.ids.agg(F.count("*").alias("d"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("nn")).first()
        self.n, self.d, self.nn = rows, total["d"], total["nn"]
        self.rows = values.join(self.ids, "v", "left").select(ORD, F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("cnt", F.lit(0)).alias("cnt"), F.coalesce("below", F.lit(0)).alias("below"))
        self._classes: dict[int, int] | None = None

    def classes(self) -> dict[int, int]:
        """How many values have each count."""
        if self._classes is None:
            self._classes = {r["cnt"]: r["m"] for r in self.ids.groupBy("cnt").agg(F.count("*").alias("m")).collect()}
        return self._classes


def sliding(x: np.ndarray, w: int, f: np.ufunc, fill: int) -> np.ndarray:
    """``f`` (minimum or maximum) of each ``w`` rows on end, in time that does not depend on ``w``: every window is
    the end of one block of ``w`` rows and the start of the next."""
    blocks = np.concatenate([x, np.full(-len(x) % w, fill, x.dtype)]).reshape(-1, w)
    ahead, back = f.accumulate(blocks, axis=1).ravel(), f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[: len(x) - w + 1], ahead[w - 1 : len(x)])


def square_sum(x: np.ndarray) -> int:
    """The exact sum of squares of whole numbers from 0 on."""
    if len(x) > 1 << 22 or x.max(initial=0) >= 1 << 40:
        return sum(int(v) ** 2 for v in x)
    hi, lo = x >> 20, x & ((1 << 20) - 1)
    return (int(hi @ hi) << 40) + (int(hi @ lo) << 21) + int(lo @ lo)


SUMS = "which int, n long, rows decimal(38,0), rows2 decimal(38,0), vals decimal(38,0), vals2 decimal(38,0), entries decimal(38,0), most long, over long"


def measure(column: Ranked, techniques: list[_SkipIndex]) -> list[dict]:
    """The metrics of several skip indexes over one column: one pass over its rows in chunks, whose sums are exact."""
    ship(column.rows.sparkSession)
    n, d, nn = column.n, column.d, column.nn
    wanted = [(isinstance(t, SetIndex), min(n, t.window_rows), getattr(t, "max_size", 0)) for t in techniques]
    wide = max(w for _, w, _ in wanted)

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ORD)
        ids, cnt, below, halo = (pdf[c].to_numpy() for c in ("id", "cnt", "below", "__halo"))
        first, own, there = int(pdf[ORD].iloc[0]), int(halo.sum()), ids >= 0
        found: dict[tuple, tuple] = {}
        out = []
        for which, (is_set, w, size) in enumerate(wanted):
            start = max(own, w - 1 - first) - (w - 1)  # of the first window that ends in this chunk
            if start + w > len(ids):
                continue
            if (is_set, w) not in found:
                found[is_set, w] = (_set_windows if is_set else _minmax_windows)(ids, cnt, below, there, w, start, d, nn)
            rows, values, entries = found[is_set, w]
            over = entries > size if size else np.zeros(len(rows), bool)
            rows, values = np.where(over, 0, rows), np.where(over, 0, values)
            out.append((which, len(rows), *(Decimal(x) for x in (int(rows.sum()), square_sum(rows), int(values.sum()), square_sum(values), int(entries.sum()))), int(entries.max()), int(over.sum())))
        return pd.DataFrame(out, columns=["which", "n", "rows", "rows2", "vals", "vals2", "entries", "most", "over"])

    parts = with_halo(column.rows, wide - 1).groupBy("__chunk").applyInPandas(sums, SUMS)
    total = parts.groupBy("which").agg(*(F.sum(c).alias(c) for c in ("n", "rows", "rows2", "vals", "vals2", "entries", "over")), F.max("most").alias("most"))
    by = {r["which"]: {k: int(x) for k, x in r.asDict().items()} for r in total.collect()}
    out = []
    for which, (t, (is_set, w, _)) in enumerate(zip(techniques, wanted)):
        r = by[which]
        m = r["n"]
        mean = lambda s, den: s / (m * den) if den else math.nan
        spread = lambda s, q, den: math.sqrt(q * m - s * s) / (m * den) if den else math.nan
        row = {
            "n_rows": n, "n_non_null": nn, "n_distinct": d, "window_rows": w, "n_windows": m,
            "skip_rows_mean": mean(r["rows"], nn), "skip_rows_std": spread(r["rows"], r["rows2"], nn), "skip_values_mean": mean(r["vals"], d), "skip_values_std": spread(r["vals"], r["vals2"], d),
        }
        if is_set:
            row |= {"window_distinct_mean": r["entries"] / m, "window_distinct_max": r["most"], "overflow_fraction": r["over"] / m}
            row |= t._baseline(column.classes(), n - nn, n, w)
        else:
            row |= t._baseline(column.ids, n, w, nn, d)
        out.append(row)
    return out


def _minmax_windows(ids, cnt, below, there, w, start, d, nn):
    """What each window skips: the rows and values outside its smallest and largest value (all, if it holds nulls only)."""
    big = np.iinfo(np.int64).max
    least = lambda x: sliding(np.where(there, x, big)[start:], w, np.minimum, big)
    most = lambda x: sliding(np.where(there, x, -1)[start:], w, np.maximum, -1)
    lo, hi, under, upto = least(ids), most(ids), least(below), most(below + cnt)
    some = hi >= 0
    lo, under = np.where(some, lo, 0), np.where(some, under, 0)
    rows, values = np.where(some, nn - (upto - under), nn), np.where(some, d - (hi - lo + 1), d)
    return rows, values, np.zeros(len(rows), np.int64)


def _set_windows(ids, cnt, below, there, w, start, d, nn):
    """What each window skips, and its entries: a row stands for its value in the windows that hold no earlier row of it."""
    at, last = np.arange(len(ids)), len(ids) - w
    order = np.argsort(ids, kind="stable")
    same = ids[order][1:] == ids[order][:-1]
    lo = np.zeros(len(ids), np.int64)
    lo[order[1:][same]] = order[:-1][same] + 1
    lo, hi = np.maximum(np.maximum(lo, at - (w - 1)), start), np.minimum(at, last)
    used = lo <= hi

    def now(mask, weights=None):
        pick = used & mask
        own = None if weights is None else weights[pick]
        steps = [np.bincount(x[pick] - start, own, minlength=last - start + 2) for x in (lo, hi + 1)]
        return np.cumsum(steps[0] - steps[1])[:-1].astype(np.int64)  # whole numbers below 2^53 at every step

    present = now(there)
    return nn - now(there, cnt.astype(np.float64)), d - present, present + (now(~there) > 0)


class _SkipIndex(Technique):
    """A window of ``index_granularity * granularity`` rows slides over the column: the share of point
    queries ``col = v`` that it would let a scan skip, with v by row frequency or over distinct values."""

    ORDERED = True
    DESCRIPTORS = {"dtype": T.StringType()}
    METRICS = COMMON
    RTOL, ATOL = 1e-6, 1e-12

    def __init__(self, *, index_granularity: int = 8192, granularity: int = 1):
        super().__init__()
        if index_granularity < 1 or granularity < 1:
            raise ValueError("index_granularity and granularity: 1 at least")
        self.window_rows = index_granularity * granularity

    def eligible(self, dtype):
        return isinstance(dtype, SCALARS)

    def needs_rows(self):
        return True

    def _compute(self, combos):
        out = []
        for n, own in by_frame(combos).items():
            columns = [c for ((_, c),) in own]
            df = materialize(with_ordinal(self.frames[n].select(*dict.fromkeys([*columns, *self.orders[n]])), self.orders[n]), "ordered")
            rows = df.count()
            fields = [T.StructField(k, T.StringType()) for k in ("df_a", "col_a")] + [T.StructField(k, t) for k, t in self.METRICS.items()]
            found = [(c, measure(Ranked(df, c, rows), [self])[0]) for c in columns]
            out.append(df.sparkSession.createDataFrame([(n, c, *(r[k] for k in self.METRICS)) for c, r in found], T.StructType(fields)))
        return union(out)


class MinMaxIndex(_SkipIndex):
    """A window is skipped unless its smallest and largest values enclose v; one of nulls only always is."""

    def _baseline(self, ids, n, w, nn, d) -> dict[str, float]:
        """Exact expectations of a random order; one term a distinct value, summed where the values are."""
        if not d:
            return {"expected_skip_rows": math.nan, "expected_skip_values": math.nan}
        ship(ids.sparkSession)
        all_null = float(miss_chance(n, w, nn))

        @F.pandas_udf("double")
        def chance(below: pd.Series, cnt: pd.Series) -> pd.Series:
            return pd.Series(miss_chance(n, w, (below + cnt).to_numpy()) + miss_chance(n, w, (nn - below).to_numpy()) - all_null)

        r = ids.withColumn("p", chance("below", "cnt")).agg(F.sum(F.col("cnt") * F.col("p")).alias("rows"), F.sum("p").alias("values")).first()
        return {"expected_skip_rows": r["rows"] / nn, "expected_skip_values": r["values"] / d}


class SetIndex(_SkipIndex):
    """A window stores its distinct entries (null is one), or nothing beyond ``max_size`` (0: no limit)."""

    METRICS = COMMON | {"window_distinct_mean": D, "window_distinct_max": L, "overflow_fraction": D, "expected_window_distinct": D, "expected_overflow_fraction": D}

    def __init__(self, *, index_granularity: int = 8192, granularity: int = 1, max_size: int = 100):
        super().__init__(index_granularity=index_granularity, granularity=granularity)
        if max_size < 0:
            raise ValueError("max_size: not negative")
        self.max_size = max_size

    def _baseline(self, values: dict[int, int], n_null: int, n: int, w: int) -> dict[str, float]:
        """Expectations of a random order over classes of equally frequent entries (null is an entry).

        An entry of c rows is in a window with probability 1 - miss_chance(n, w, c); the number of entries is
        taken as normal where a limit makes its distribution matter.
        """
        sizes = np.array(sorted({*values, *([n_null] if n_null else [])}), np.int64)
        distinct = np.array([values.get(int(c), 0) for c in sizes], float)
        members = distinct + (sizes == n_null) * bool(n_null)
        missing = miss_chance(n, w, sizes)
        expected = float(members @ (1 - missing))
        variance = 0.0
        if self.max_size:  # row by row of the matrix of joint chances, which is never held whole
            for i, c in enumerate(sizes.tolist()):
                others = members * members[i]
                others[i] -= members[i]
                variance += float(members[i] * missing[i] * (1 - missing[i]) + others @ (miss_chance(n, w, sizes + c) - missing * missing[i]))
        spread = math.sqrt(max(0.0, variance))

        def room(mean: float) -> float:
            slack = self.max_size + 0.5 - mean
            return 1.0 if not self.max_size else normal_below(slack / spread) if spread > 0 else float(slack >= 0)

        skip = missing.copy()
        if self.max_size:
            for i in np.flatnonzero((missing > 0) & (distinct > 0)):
                left = members - (np.arange(len(sizes)) == i)
                skip[i] *= room(float(left @ (1 - miss_chance(n - int(sizes[i]), w, sizes))))
        rows, kinds = float(distinct @ sizes), float(distinct.sum())
        return {
            "expected_skip_rows": float(distinct @ (sizes * skip)) / rows if rows else math.nan,
            "expected_skip_values": float(distinct @ skip) / kinds if kinds else math.nan,
            "expected_window_distinct": expected,
            "expected_overflow_fraction": 1 - room(expected),
        }
