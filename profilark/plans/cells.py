"""Entropy cells: an entropy with its interval, from whatever is known of a column, never outside [0, log2 n]."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cell:
    """Bits, an interval of three deviations, and how they were found (``exact``, ``sample`` or ``ams``)."""

    bits: float
    low: float
    high: float
    method: str


def _cell(bits: float, deviation: float, rows: int, method: str) -> Cell:
    top = math.log2(rows) if rows > 1 else 0.0
    clamp = lambda x: min(max(x, 0.0), top)
    return Cell(clamp(bits), clamp(bits - 3 * deviation), clamp(bits + 3 * deviation), method)


def exact(counts: DataFrame, count: str = "cnt") -> Cell:
    """From the count of every value."""
    n, s = counts.agg(F.sum(count), F.sum(F.col(count) * F.log2(F.col(count).cast("double")))).first()
    return _cell(math.log2(n) - s / n if n else 0.0, 0.0, n or 0, "exact")


def bottom_k(values: DataFrame, distinct: float, rows: int, count: str = "cnt") -> Cell:
    """From the exact counts of a hash sample of the values: the mean of c/n log2(n/c) times the distinct values."""
    term = F.col(count) / F.lit(float(rows)) * F.log2(F.lit(float(rows)) / F.col(count))
    k, mean, deviation = values.agg(F.count("*"), F.avg(term), F.stddev_samp(term)).first()
    if not k:
        return _cell(0.0, 0.0, rows, "sample")
    left = math.sqrt(max(0.0, 1 - k / distinct)) if distinct > 1 else 0.0  # a sample of all values has no error
    return _cell(distinct * mean, distinct * (deviation or 0.0) / math.sqrt(k) * left, rows, "sample")


def ams(bits: float, samples: int, rows: int) -> Cell:
    """From a sampled-position estimate: each sample's value lies within log2 n + log2 e of another."""
    spread = (math.log2(rows) if rows > 1 else 0.0) + math.log2(math.e)
    return _cell(bits, spread / math.sqrt(max(samples, 1)) / 2, rows, "ams")
