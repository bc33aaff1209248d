"""Equality rules, each a boolean Column over a left and a right Column.

NULL equals NULL and nothing else, NaN equals NaN, and -0.0 equals 0.0: that is
what ``<=>`` does.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)


class BaseComparator(ABC):
    """A rule for one column. ``compare`` gets the NAMES of the left and the right
    column of the joined table and returns whether they are equal; nulls are dealt
    with around it. Keywords: abs_tol, rel_tol, ignore_spaces, ignore_case,
    is_float, and column, the user's own name of the column."""

    @abstractmethod
    def compare(self, col_l: str, col_r: str, **kwargs) -> Column: ...


class NumericComparator(BaseComparator):
    """Equal, or apart by at most abs_tol + rel_tol * |right|. NaN and infinities
    are only equal to themselves."""

    def compare(self, col_l: str, col_r: str, *, abs_tol: float = 0.0, rel_tol: float = 0.0, is_float: bool = True, **kwargs) -> Column:
        left, right = F.col(col_l), F.col(col_r)
        same = left.eqNullSafe(right)
        if not abs_tol and not rel_tol:
            return same
        # integers by way of decimals: their difference may overflow
        wide = "double" if is_float else "decimal(20,0)"
        apart = F.abs(left.cast(wide) - right.cast(wide)).cast("double")
        near = apart <= F.lit(float(abs_tol)) + F.lit(float(rel_tol)) * F.abs(right.cast("double"))
        if is_float:
            odd = [F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")) for x in (left, right)]
            near = near & ~odd[0] & ~odd[1]
        return same | F.coalesce(near, F.lit(False))


class StringComparator(BaseComparator):
    """Equal text, if asked for whatever its case and without white space."""

    def compare(self, col_l: str, col_r: str, *, ignore_spaces: bool = False, ignore_case: bool = False, **kwargs) -> Column:
        def plain(name: str) -> Column:
            x = F.col(name)
            x = F.lower(x) if ignore_case else x
            return F.regexp_replace(x, r"(?U)\s+", "") if ignore_spaces else x

        return plain(col_l).eqNullSafe(plain(col_r))


class ListComparator(BaseComparator):
    """Equal elements in any order, repeated ones as often."""

    def compare(self, col_l: str, col_r: str, **kwargs) -> Column:
        return F.sort_array(F.col(col_l)).eqNullSafe(F.sort_array(F.col(col_r)))


class ExactComparator(BaseComparator):
    """``<=>``; maps by their sorted entries."""

    def __init__(self, is_map: bool = False):
        self.is_map = is_map

    def compare(self, col_l: str, col_r: str, **kwargs) -> Column:
        if not self.is_map:
            return F.col(col_l).eqNullSafe(F.col(col_r))
        return F.sort_array(F.map_entries(F.col(col_l))).eqNullSafe(F.sort_array(F.map_entries(F.col(col_r))))


def _holds(dtype: T.DataType, kinds) -> bool:
    inner = {T.ArrayType: lambda t: [t.elementType], T.MapType: lambda t: [t.keyType, t.valueType], T.StructType: lambda t: [f.dataType for f in t.fields]}
    return isinstance(dtype, kinds) or any(_holds(x, kinds) for x in inner.get(type(dtype), lambda t: [])(dtype))


def is_nested(dtype: T.DataType) -> bool:
    """Types that a row digest doesn't take."""
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType))


def is_comparable(dtype: T.DataType) -> bool:
    """Whether there is a rule for the type: variants, and maps within others,
    have none."""
    if isinstance(dtype, T.MapType):
        return not _holds(dtype.keyType, (T.MapType, T.VariantType)) and not _holds(dtype.valueType, (T.MapType, T.VariantType))
    return not _holds(dtype, (T.MapType, T.VariantType))


def comparator_for(dtype: T.DataType) -> BaseComparator:
    if isinstance(dtype, (*_INTEGERS, *_FLOATS, T.DecimalType)):
        return NumericComparator()
    if isinstance(dtype, T.StringType):
        return StringComparator()
    if isinstance(dtype, T.ArrayType):
        return ListComparator()
    return ExactComparator(isinstance(dtype, T.MapType))


def matches(
    col_l: str, col_r: str, dtype: T.DataType, *, abs_tol: float = 0.0, rel_tol: float = 0.0, ignore_spaces: bool = False, ignore_case: bool = False,
    custom: BaseComparator | None = None, column: str = "",
) -> Column:
    """Whether two columns of one type are equal; never null. A custom rule is
    asked only where both sides have a value, and its null is a no."""
    rule = custom or comparator_for(dtype)
    options = {"abs_tol": abs_tol, "rel_tol": rel_tol, "ignore_spaces": ignore_spaces, "ignore_case": ignore_case, "is_float": not isinstance(dtype, _INTEGERS)}
    said = rule.compare(col_l, col_r, **options, column=column) if custom else rule.compare(col_l, col_r, **options)
    if custom is None:
        return said
    no_left, no_right = F.col(col_l).isNull(), F.col(col_r).isNull()
    return F.when(no_left | no_right, no_left & no_right).otherwise(F.coalesce(said, F.lit(False)))
