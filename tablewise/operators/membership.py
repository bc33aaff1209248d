"""Rows by key: membership, states, duplicates.

Keys meet null-safe, and repeated ones count as joined pairs. Counts come from both
sides stacked and grouped by key: one shuffle of narrow rows, without sorting, and no
pair is made. Joins are used where a row for each pair, or its values, are asked for.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digest import row_digest

#: States of a row.
EQUAL, DIFFERENT, LEFT_ONLY, RIGHT_ONLY = range(4)


def same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(and_, [left[f"`{k}`"].eqNullSafe(right[f"`{k}`"]) for k in keys])


def _side(df: DataFrame, keys: list[str], columns: list[str], side: int) -> DataFrame:
    return df.select(*keys, row_digest(columns).alias("__digest"), F.lit(side).alias("__side"))


def stacked(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row a key: rows of each side, and how many of their joined pairs have equal
    digests. Digests are counted within their key, so no pair is made."""
    both = _side(left, keys, columns, 0).unionAll(_side(right, keys, columns, 1))
    on, pairs = F.col("__side") == 0, F.col("__nl") * F.col("__nr")
    counts = F.count_if(on).alias("__nl"), F.count_if(~on).alias("__nr")
    if not columns:
        return both.groupBy(*keys).agg(*counts).withColumn("__same", pairs)
    by_digest = both.repartition(*keys).groupBy(*keys, "__digest").agg(*counts)  # dealt by key: no other shuffle follows
    return by_digest.groupBy(*keys).agg(F.sum("__nl").alias("__nl"), F.sum("__nr").alias("__nr"), F.sum(pairs).alias("__same"))


def _state(has_left: Column, has_right: Column, equal: Column) -> Column:
    state = F.when(~has_right, LEFT_ONLY).when(~has_left, RIGHT_ONLY).when(equal, EQUAL).otherwise(DIFFERENT)
    return state.cast("tinyint")


def row_states(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys with ``state``: 0 equal, 1 different, 2 left only, 3 right only, by the
    digests of ``columns``; one row for each joined pair and each row without one."""
    lhs = left.select(*keys, row_digest(columns).alias("__hl"), F.lit(True).alias("__l"))
    rhs = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], row_digest(columns).alias("__hr"), F.lit(True).alias("__r"))
    on = reduce(and_, [lhs[k].eqNullSafe(rhs[f"__r_{k}"]) for k in keys])
    has_l, has_r = F.col("__l").isNotNull(), F.col("__r").isNotNull()
    state = _state(has_l, has_r, F.col("__hl") == F.col("__hr"))
    return lhs.join(rhs, on, "full").select(*[F.when(has_l, F.col(k)).otherwise(F.col(f"__r_{k}")).alias(k) for k in keys], state.alias("state"))


def state_counts(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The rows of ``row_states``, equal ones once, with their number ``__n``."""
    s = stacked(left, right, keys, columns)
    nl, nr, same = F.col("__nl"), F.col("__nr"), F.col("__same")
    numbers = {EQUAL: same, DIFFERENT: nl * nr - same, LEFT_ONLY: F.when(nr == 0, nl), RIGHT_ONLY: F.when(nl == 0, nr)}
    cells = F.array(*[F.struct(F.lit(k).cast("tinyint").alias("state"), n.alias("__n")) for k, n in numbers.items()])
    return s.select(*keys, F.inline(cells)).filter("__n > 0")


def rule_states(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], matches: dict[str, Column]) -> DataFrame:
    """As ``row_states``, with a match for each column over its left name and the
    right one, ``__r_<column>``."""
    lhs = left.select(*keys, *columns, F.lit(True).alias("__l"))
    rhs = right.select(*[F.col(c).alias(f"__r_{c}") for c in (*keys, *columns)], F.lit(True).alias("__r"))
    on = reduce(and_, [lhs[k].eqNullSafe(rhs[f"__r_{k}"]) for k in keys])
    has_l, has_r = F.col("__l").isNotNull(), F.col("__r").isNotNull()
    state = _state(has_l, has_r, reduce(and_, [matches[c] for c in columns], F.lit(True)))
    return lhs.join(rhs, on, "full").select(*[F.when(has_l, F.col(k)).otherwise(F.col(f"__r_{k}")).alias(k) for k in keys], state.alias("state"))


def summary(states: DataFrame) -> DataFrame:
    """One row of counts from ``state``; rows of ``state_counts`` stand for ``__n``."""
    each = F.col("__n") if "__n" in states.columns else F.lit(1).cast("long")
    n = lambda *kinds: F.coalesce(F.sum(F.when(F.col("state").isin(*kinds), each)), F.lit(0).cast("long"))
    return states.agg(
        n(EQUAL, DIFFERENT, LEFT_ONLY).alias("left_total"), n(EQUAL, DIFFERENT, RIGHT_ONLY).alias("right_total"),
        n(EQUAL, DIFFERENT).alias("common"), n(LEFT_ONLY).alias("left_only"), n(RIGHT_ONLY).alias("right_only"), n(DIFFERENT).alias("mismatched"),
    )


def membership(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: common, left_only, right_only."""
    return summary(state_counts(left, right, keys, [])).select("common", "left_only", "right_only")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows have, with their number ``n``; NULL is a key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def duplicate_surplus(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: ``surplus``, rows beyond the first of each key."""
    return duplicate_keys(df, keys).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("surplus"))


def only_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the left side whose key the right side lacks."""
    return left.join(right.select(*keys), same_key(left, right, keys), "left_anti")


def only_right(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return only_left(right, left, keys)


def common_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that both sides have, each once."""
    own = left.select(*keys)
    other = right.select(*keys)
    return own.join(other, same_key(own, other, keys), "left_semi").distinct()


def outside_range(df: DataFrame, key: str, bounds: tuple[int, int] | None) -> DataFrame:
    """Rows whose non-null key lies outside of the bounds, ends included; without
    bounds, all rows with a key."""
    k = F.col(key)
    return df.filter(k.isNotNull() if bounds is None else k.isNotNull() & ((k < bounds[0]) | (k > bounds[1])))
