"""Schema alignment: names, one-sided columns, types and casts. No data is read."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


def type_name(dtype: T.DataType) -> str:
    """The type without nullability, which doesn't tell types apart."""
    return dtype.simpleString()


@dataclass
class Alignment:
    keys: list[str]
    types: dict[str, T.DataType] = field(default_factory=dict)  # after casts
    compared: list[str] = field(default_factory=list)
    left_only: list[str] = field(default_factory=list)
    right_only: list[str] = field(default_factory=list)
    type_mismatches: list[tuple[str, str, str]] = field(default_factory=list)
    left_casts: dict[str, T.DataType] = field(default_factory=dict)
    right_casts: dict[str, T.DataType] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)


def normalize_schema(schema: T.StructType, lowercase: bool) -> dict[str, T.DataType]:
    """Types by name, in order. Names that meet once lower-cased are an error."""
    out: dict[str, T.DataType] = {}
    for f in schema.fields:
        name = f.name.lower() if lowercase else f.name
        if name in out:
            raise ValueError(f"Column names collide when lower-cased: '{name}'" if lowercase else f"Column name repeats: '{name}'")
        out[name] = f.dataType
    return out


def align_schemas(left: dict[str, T.DataType], right: dict[str, T.DataType], keys: list[str], casting: str = "none") -> Alignment:
    out = Alignment(list(keys))
    out.left_only, out.right_only = [c for c in left if c not in right], [c for c in right if c not in left]
    for side, own in (("left", left), ("right", right)):
        gone = [k for k in keys if k not in own]
        if gone:
            out.errors.append(f"Join keys missing from the {side} table: {gone}")
    if out.errors:
        return out
    for c in [*keys, *(c for c in left if c in right and c not in keys)]:
        if type_name(left[c]) == type_name(right[c]):
            out.types[c] = left[c]
        elif casting == "left":
            out.types[c] = out.right_casts[c] = left[c]
        elif casting == "right":
            out.types[c] = out.left_casts[c] = right[c]
        elif c in keys:
            out.errors.append(f"Join key '{c}' has different types: left {type_name(left[c])}, right {type_name(right[c])}")
        else:
            out.type_mismatches.append((c, type_name(left[c]), type_name(right[c])))
    if not out.errors:
        out.compared = [c for c in out.types if c not in keys]
    return out
