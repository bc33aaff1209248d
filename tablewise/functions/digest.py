"""Row digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_digest(columns: list[str]) -> Column:
    """A 64-bit digest of the columns in their order. ``xxhash64`` skips nulls, so
    each column goes in with a mark of its nullness; it takes -0.0 for 0.0 and all
    NaN for one. No columns: 0."""
    if not columns:
        return F.lit(0).cast("long")
    return F.xxhash64(*[x for c in columns for x in (F.isnull(c), F.col(c))])
