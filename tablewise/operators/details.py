"""Differences by column: flags, counts, and the first differing rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .membership import row_states, same_key

#: A match for each column, by its name: (left name, right name) -> Column.
Matches = dict[str, Column]


def right_name(column: str) -> str:
    return f"__r_{column}"


def joined(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], only: DataFrame | None = None) -> DataFrame:
    """Common rows: keys, left values, and right values under ``right_name``. With
    ``only``, just the rows of these keys are read."""
    if only is not None:
        left = left.join(only, same_key(left, only, keys), "left_semi")
        right = right.join(only, same_key(right, only, keys), "left_semi")
    lhs = left.select(*keys, *columns)
    rhs = right.select(*[F.col(c).alias(right_name(c)) for c in (*keys, *columns)])
    on = reduce(lambda a, b: a & b, [lhs[k].eqNullSafe(rhs[right_name(k)]) for k in keys])
    return lhs.join(rhs, on).drop(*[right_name(k) for k in keys])


def flagged(rows: DataFrame, matches: Matches) -> DataFrame:
    """``rows`` with ``__m_<column>``: whether the column matches."""
    return rows.select("*", *[m.alias(f"__m_{c}") for c, m in matches.items()])


def differs(columns) -> Column:
    return reduce(or_, [~F.col(f"__m_{c}") for c in columns]) if columns else F.lit(False)


def column_mismatches(rows: DataFrame, columns: list[str], batch: int = 50) -> DataFrame:
    """(column, mismatches) of all ``columns`` from flagged rows; one aggregate for
    each batch of columns."""
    parts = []
    for at in range(0, len(columns), batch):
        some = columns[at : at + batch]
        one = rows.agg(*[F.count_if(~F.col(f"__m_{c}")).alias(c) for c in some])
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("mismatches")) for c in some])
        parts.append(one.select(F.inline(pairs)))
    return reduce(DataFrame.unionAll, parts)


def mismatched_keys(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], matches: Matches | None = None) -> DataFrame:
    """Keys of common rows that differ: by digest, or by the matches."""
    if matches is None:
        return row_states(left, right, keys, columns).filter("state = 1").select(*keys)
    return flagged(joined(left, right, keys, columns), matches).filter(differs(columns)).select(*keys)


def mismatch_samples(rows: DataFrame, keys: list[str], columns: list[str], count: int) -> DataFrame:
    """(column, rank, keys, left_value, right_value): the first differing rows of
    each column by key, nulls first, values as text. Rows beyond ``count`` are
    dropped before they are shuffled."""
    text = lambda c: F.col(c).cast("string")
    cells = F.array(*[F.when(~F.col(f"__m_{c}"), F.struct(F.lit(c).alias("column"), text(c).alias("left_value"), text(right_name(c)).alias("right_value"))) for c in columns])
    long = rows.select(*keys, F.inline(F.array_compact(cells)))
    first = W.partitionBy("column").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    return long.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= count).select("column", "rank", *keys, "left_value", "right_value")


def sample_keys(rows: DataFrame, keys: list[str], columns: list[str], count: int) -> DataFrame:
    """(column, rank, keys) of the same rows, without values."""
    names = F.array(*[F.when(~F.col(f"__m_{c}"), F.lit(c)) for c in columns])
    long = rows.select(*keys, F.explode(F.array_compact(names)).alias("__column"))
    first = W.partitionBy("__column").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    return long.withColumn("__rank", F.row_number().over(first)).filter(F.col("__rank") <= count)
