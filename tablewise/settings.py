"""Options of a comparison, of its sources and of its report."""

from __future__ import annotations

from pathlib import Path
from typing import Annotated, Literal

from pydantic import AfterValidator, BaseModel, ConfigDict, Field, StrictInt, model_validator

from .functions.equality import BaseComparator

#: Automatic windows hold about this many cells, and rows at least.
AUTO_WINDOW_CELLS = 30_000_000
AUTO_WINDOW_MIN_ROWS = 100_000
#: Fixed value: kept inputs of more cells than this get a warning.
CACHE_CELLS = 100_000_000

Amount = Annotated[float, Field(ge=0, allow_inf_nan=False)]
Tolerance = Amount | dict[str, Amount]


def _different(names: list[str]) -> list[str]:
    folded = [n.lower() for n in names]
    if twice := sorted({n for n in folded if folded.count(n) > 1}):
        raise ValueError(f"columns named twice: {', '.join(twice)}")
    return names


def tolerance_of(value: Tolerance, column: str) -> float:
    return value.get(column, 0.0) if isinstance(value, dict) else value


class CompareSettings(BaseModel):
    """How two tables are compared. Unknown options are refused."""

    model_config = ConfigDict(extra="forbid", arbitrary_types_allowed=True)

    #: The key, at least one column.
    join_columns: Annotated[list[Annotated[str, Field(pattern=r"\S")]], Field(min_length=1), AfterValidator(_different)]
    left_name: str = Field("left", min_length=1)
    right_name: str = Field("right", min_length=1)
    #: Column names are the same whatever their case.
    lowercase_columns: bool = True
    #: Which side's type wins where types differ; "none" reports them.
    casting: Literal["left", "right", "none"] = "none"
    #: Tolerances: one for all numeric columns, or one for each named column.
    abs_tol: Tolerance = 0.0
    rel_tol: Tolerance = 0.0
    #: Text: white space and case that don't count.
    ignore_spaces: bool = False
    ignore_case: bool = False
    custom_comparators: dict[str, BaseComparator] = Field(default_factory=dict)
    #: Repeated keys end the comparison; unchecked, they count as joined pairs.
    check_duplicate_keys: bool = True
    #: Count differences by column and fetch samples.
    column_details: bool = True
    sample_count: int = Field(5, ge=0)
    #: Columns whose differences one aggregate counts.
    columns_per_batch: int = Field(50, gt=0)
    #: Key-range windows: planned and reported, while Spark deals out the rows.
    window_rows: Annotated[StrictInt, Field(gt=0)] | Literal["auto"] | None = "auto"
    #: Keep both aligned inputs between the jobs (memory, then disk); "auto": no.
    cache_windows: bool | Literal["auto"] = "auto"
    #: Accepted for compatibility; Spark overlaps its tasks anyway.
    prefetch_windows: bool = False
    #: Compare only within the common range of the first key column.
    common_keys_only: bool = False

    @model_validator(mode="after")
    def _keys_are_plain(self):
        for c in self.custom_comparators:
            if self.name(c) in map(self.name, self.join_columns):
                raise ValueError(f"'{c}' is a key column, and keys have no custom comparator")
        return self

    def name(self, column: str) -> str:
        return column.lower() if self.lowercase_columns else column

    def tolerances(self, value: Tolerance) -> Tolerance:
        return {self.name(k): v for k, v in value.items()} if isinstance(value, dict) else value

    def value_rules(self) -> list[str]:
        """The options that are set and need values, not digests, to tell equality."""
        given = {name: getattr(self, name) for name in ("abs_tol", "rel_tol", "ignore_spaces", "ignore_case", "custom_comparators")}
        return [name for name, x in given.items() if (any(x.values()) if isinstance(x, dict) else x)]

    def uses_exact_hash(self) -> bool:
        return self.value_rules() == []


class SourceOptions(BaseModel):
    """How files are opened; for both sides."""

    model_config = ConfigDict(extra="forbid")

    #: Wins over the extension.
    format: Literal["parquet", "csv", "sas"] | None = None
    #: Lines that tell a CSV's types; None: all, 0: all columns are text.
    csv_infer_schema_length: int | None = Field(10_000, ge=0)
    csv_separator: str = Field(",", min_length=1, max_length=1)
    recursive: bool = True


class ReportSettings(BaseModel):
    """How a result is shown."""

    model_config = ConfigDict(extra="forbid")

    print_output: bool = True
    format: Literal["text", "markdown", "html", "json"] | None = None
    style: Literal["auto", "unicode", "ascii"] = "auto"
    width: int = Field(100, ge=60, le=200)
    max_columns: int = Field(20, ge=1)
    max_sample_columns: int = Field(10, ge=0)
    save_path: Path | None = None

    def resolved_format(self) -> str:
        """The format that was asked for, else the one of the file's extension."""
        by_extension = {"md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "json": "json"}
        extension = self.save_path.suffix.lower()[1:] if self.save_path else ""
        return self.format or by_extension.get(extension, "text")
