"""The first key column's range, and a grid of equal parts over it.

Spark deals rows out by itself, so the grid bounds no memory here: it is reported,
numbers rows for counts by part, and the range that both sides share prunes scans.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeyStats:
    n: int
    nulls: int
    lo: int | None
    hi: int | None

    def share(self, lo: int, hi: int) -> Fraction:
        """The part of this side's keys that lies in a range, were they dense."""
        if self.lo is None:
            return Fraction(0)
        inside = range(max(lo, self.lo), min(hi, self.hi) + 1)
        return Fraction(len(inside), len(range(self.lo, self.hi + 1)))


@dataclass(frozen=True)
class Grid:
    """Parts of ``width`` keys from ``lo`` to ``hi`` (both included), then one for null
    keys if there are any. Without a range there is no part, or one for all rows."""

    lo: int | None = None
    hi: int | None = None
    width: int = 1
    nulls: bool = False
    whole: bool = False

    def __len__(self) -> int:
        ranged = 0 if self.lo is None else len(range(self.lo, self.hi + 1, self.width))
        return 1 if self.whole else ranged + self.nulls

    def id(self, key: str) -> Column:
        """The number of the part that holds a key; null outside of all."""
        if self.whole:
            return F.lit(0)
        k, at = F.col(key).cast("long"), F.lit(None)
        if self.lo is not None:
            at = F.when(k.between(self.lo, self.hi), F.floor((k - F.lit(self.lo)) / F.lit(self.width)))
        return F.when(k.isNull(), F.lit(len(self) - 1 if self.nulls else None)).otherwise(at).cast("int")


def key_stats_frame(df: DataFrame, key: str) -> DataFrame:
    """One row: n, nulls, lo, hi."""
    k = F.col(key)
    return df.agg(F.count("*").alias("n"), F.count_if(k.isNull()).alias("nulls"), F.min(k).alias("lo"), F.max(k).alias("hi"))


def shared_range(*sides: KeyStats) -> tuple[int, int] | None:
    """The range, ends included, in which all sides have keys."""
    if any(s.lo is None for s in sides):
        return None
    ends = max(s.lo for s in sides), min(s.hi for s in sides)
    return ends if ends[0] <= ends[1] else None


def rows_per_part(asked: int | str | None, cells: int, floor: int, columns: int, *sides: KeyStats) -> int | None:
    """What ``window_rows`` asks for; "auto" parts only sides of over ``cells`` cells,
    into parts of about that many. None: one part."""
    if asked != "auto":
        return asked
    per_row = max(columns, 1)
    return max(cells // per_row, floor) if any(s.n * per_row > cells for s in sides) else None


def grid(rows: int | None, *sides: KeyStats, shared_only: bool = False) -> Grid:
    """Parts of about ``rows`` rows of the larger side: over all keys, where one part
    is enough for what fits into it, or over the shared range only."""
    nulls = any(s.nulls for s in sides)
    keyed = [s for s in sides if s.lo is not None]
    if shared_only:
        ends = shared_range(*sides)
        if ends is None:
            return Grid(nulls=nulls)
        expected = max(ceil((s.n - s.nulls) * s.share(*ends)) for s in sides)
    else:
        expected = max(s.n for s in sides)
        if not keyed or rows is None or expected <= rows:
            return Grid(whole=True)
        ends = min(s.lo for s in keyed), max(s.hi for s in keyed)
    parts = max(1, ceil(Fraction(expected, rows))) if rows else 1
    return Grid(*ends, ceil(Fraction(ends[1] - ends[0] + 1, parts)), nulls)
