"""The comparison of two tables, from sources to result.

Jobs: one groups the stacked narrow sides by key, and tells membership, equality,
repeated keys and key ranges at once; as it goes it writes the keys that differ (with
``common_keys_only`` and rules: those in common) to the shared folder. Where rows
differ, a second job reads only these keys' rows and counts by column, and a third
fetches samples. With rules (tolerances and the like) the second reads all common rows.
"""

from __future__ import annotations

import time
from collections import defaultdict
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.equality import is_comparable, is_nested, matches
from ..operators import column_mismatches
from ..operators.details import differs, flagged, joined, right_name, sample_keys
from ..operators.membership import same_key, stacked
from ..results import ColumnStat, ColumnSummary, ComparisonResult, ExecutionInfo, RowSummary, SampleTable, TypeMismatch
from ..settings import AUTO_WINDOW_CELLS, AUTO_WINDOW_MIN_ROWS, CACHE_CELLS, CompareSettings, SourceOptions, tolerance_of
from ..sources import open_source
from ..sources.shared import remove, reread, shared_path
from .schema import Alignment, align_schemas, normalize_schema, type_name
from .windows import KeyStats, grid, rows_per_part, shared_range

#: Why a path was taken.
_WHY_RULES = "tolerances, string options or custom comparators are enabled"
_WHY_NESTED = "nested columns can't be hashed: {}"
_WHY_HASH = "exact equality on all columns (row hash)"


def compare(left, right, settings: CompareSettings | dict, source: SourceOptions | None = None, spark=None) -> ComparisonResult:
    """Compare two DataFrames or paths by key."""
    if isinstance(settings, dict):
        settings = CompareSettings(**settings)
    return Comparison(left, right, settings, source, spark).result()


class Comparison:
    """An aligned pair of tables. Inside, columns have names of their own (k0, c0,
    ...), so that any user's names do."""

    def __init__(self, left, right, settings: CompareSettings, source=None, spark=None):
        self.settings, self.started = settings, time.perf_counter()
        self.timings: dict[str, float] = defaultdict(float)
        self.errors: list[str] = []
        self.warnings: list[str] = []
        self.alignment: Alignment | None = None
        self.path, self.reason = None, ""
        self.windows, self.rows_per_window = 1, None
        self.kept: list[DataFrame] = []
        self.written: list[str] = []
        self.keys = [settings.name(k) for k in settings.join_columns]
        with self.timed("open"):
            self._open(left, right, source, spark)

    @contextmanager
    def timed(self, phase: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.timings[phase] += time.perf_counter() - began

    # -- alignment ------------------------------------------------------------

    def _open(self, left, right, source, spark) -> None:
        s = self.settings
        frames = [open_source(x, source, spark, self.warnings) for x in (left, right)]
        self.version = frames[0].sparkSession.version
        try:
            schemas = [normalize_schema(f.schema, s.lowercase_columns) for f in frames]
        except ValueError as e:
            self.errors.append(str(e))
            return
        a = self.alignment = align_schemas(*schemas, self.keys, s.casting)
        self.errors += a.errors
        bad = [k for k in self.keys if k in a.types and (not is_comparable(a.types[k]) or isinstance(a.types[k], T.MapType))]
        self.errors += [f"Join key '{k}' has a type that can't be compared: {type_name(a.types[k])}" for k in bad]
        if self.errors:
            return
        odd = [c for c in a.compared if not is_comparable(a.types[c])]
        if odd:
            self.warnings.append(f"Columns of types without an equality rule are not compared: {', '.join(odd)}")
            a.compared = [c for c in a.compared if c not in odd]
        self.inner = {c: f"k{i}" for i, c in enumerate(self.keys)} | {c: f"c{i}" for i, c in enumerate(a.compared)}
        self.own_keys, self.own_columns = [self.inner[k] for k in self.keys], [self.inner[c] for c in a.compared]
        self.left = self._aligned(frames[0], schemas[0], a.left_casts)
        self.right = self._aligned(frames[1], schemas[1], a.right_casts)
        named = {c for t in (s.abs_tol, s.rel_tol) if isinstance(t, dict) for c in s.tolerances(t)} | {s.name(c) for c in s.custom_comparators}
        if unknown := sorted(named - set(a.compared)):
            self.warnings.append(f"Tolerances or comparators for columns that are not compared: {', '.join(unknown)}")
        nested = [c for c in a.compared if is_nested(a.types[c])]
        if not s.uses_exact_hash():
            self.path, self.reason = "columnwise", _WHY_RULES
        elif nested:
            self.path, self.reason = "columnwise", _WHY_NESTED.format(", ".join(nested))
        else:
            self.path, self.reason = "hash", _WHY_HASH
        if not a.compared:
            self.warnings.append("No common columns besides the join key: only row membership was compared.")

    def _aligned(self, frame: DataFrame, schema: dict, casts: dict) -> DataFrame:
        """Positional names first: a frame may hold A beside a."""
        at = {c: i for i, c in enumerate(schema)}
        plain = frame.toDF(*[f"x{i}" for i in range(len(schema))])
        pick = [F.col(f"x{at[c]}").cast(casts[c]) if c in casts else F.col(f"x{at[c]}") for c in self.inner]
        return plain.select(*[p.alias(n) for p, n in zip(pick, self.inner.values())])

    def matches(self) -> dict:
        """The match of each compared column, by its inner name."""
        s, a = self.settings, self.alignment
        custom = {s.name(c): rule for c, rule in s.custom_comparators.items()}
        abs_tol, rel_tol = s.tolerances(s.abs_tol), s.tolerances(s.rel_tol)
        return {
            self.inner[c]: matches(
                self.inner[c], right_name(self.inner[c]), a.types[c], abs_tol=tolerance_of(abs_tol, c), rel_tol=tolerance_of(rel_tol, c),
                ignore_spaces=s.ignore_spaces, ignore_case=s.ignore_case, custom=custom.get(c), column=c,
            )
            for c in a.compared
        }

    # -- jobs -----------------------------------------------------------------

    def _keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def _whole_key(self) -> bool:
        return isinstance(self.alignment.types[self.keys[0]], (T.ByteType, T.ShortType, T.IntegerType, T.LongType))

    def _grouped(self) -> tuple[dict, DataFrame | None]:
        """The one pass over both sides: state counts, repeated keys, key ranges, and
        the keys whose rows are read next (None: not asked for). The counts are taken
        in the stage that writes the keys, whose tasks count once however often they
        are tried."""
        s = stacked(self.left, self.right, self.own_keys, self.own_columns if self.path == "hash" else [])
        has_l, has_r, pairs = F.col("__nl") > 0, F.col("__nr") > 0, F.col("__nl") * F.col("__nr")
        k0 = F.col(self.own_keys[0])
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        told = {"both": total(pairs), "differ": total(pairs - F.col("__same"))}  # repeated keys: joined pairs
        for name, own, n, other in (("l", has_l, F.col("__nl"), has_r), ("r", has_r, F.col("__nr"), has_l)):
            told |= {
                f"only_{name}": total(F.when(~other, n)), f"surplus_{name}": total(F.greatest(n - 1, F.lit(0))),
                f"n_{name}": total(n), f"nulls_{name}": total(F.when(k0.isNull(), n)),
            }
            if self._whole_key():
                told |= {f"lo_{name}": F.min(F.when(own, k0)), f"hi_{name}": F.max(F.when(own, k0))}
        counts = [c.alias(name) for name, c in told.items()]
        if not self.own_columns or not (self.settings.column_details if self.path == "hash" else self.settings.common_keys_only):
            return s.agg(*counts).first().asDict(), None
        wanted = pairs > F.col("__same") if self.path == "hash" else has_l & has_r
        seen, path = Observation("groups"), shared_path(s.sparkSession, "keys")
        keys = s.observe(seen, *counts).filter(wanted).select(*self.own_keys)
        self.written.append(path)
        keys.write.parquet(path)
        return seen.get, reread(keys, path)

    def _plan(self, left: KeyStats, right: KeyStats) -> None:
        """Report the grid of key ranges that the options ask for."""
        s = self.settings
        if s.window_rows is None and not s.common_keys_only:
            return
        if not self._whole_key():
            if isinstance(s.window_rows, int):
                self.warnings.append(f"window_rows ignored: the first join key '{self.keys[0]}' is not an integer column")
            return
        width = len(self.alignment.compared) + len(self.keys)
        self.rows_per_window = rows_per_part(s.window_rows, AUTO_WINDOW_CELLS, AUTO_WINDOW_MIN_ROWS, width, left, right)
        self.windows = len(grid(self.rows_per_window, left, right, shared_only=s.common_keys_only))

    def _pruned(self, left: KeyStats, right: KeyStats) -> None:
        """With ``common_keys_only`` scans keep to the range that both sides share."""
        if not (self.settings.common_keys_only and self._whole_key()):
            return
        k, ends = F.col(self.own_keys[0]), shared_range(left, right)
        inside = k.isNull() if ends is None else k.isNull() | k.between(*ends)
        self.left, self.right = self.left.filter(inside), self.right.filter(inside)

    def result(self) -> ComparisonResult:
        try:
            return self._run()
        finally:
            for df in self.kept:
                df.unpersist()
            for path in self.written:
                remove(self.left.sparkSession, path)

    def _run(self) -> ComparisonResult:
        if self.errors:
            return self._made()
        s = self.settings
        if s.cache_windows is True:
            with self.timed("cache"):
                self.left, self.right = self._keep(self.left), self._keep(self.right)
        with self.timed("compare"):
            g, keys = self._grouped()
        both, differ, repeated = g["both"], g["differ"], (g["surplus_l"], g["surplus_r"])
        stats = [KeyStats(g[f"n_{x}"], g[f"nulls_{x}"], g.get(f"lo_{x}"), g.get(f"hi_{x}")) for x in "lr"]
        self._plan(*stats)
        cells = sum(x.n for x in stats) * (len(self.own_columns) + len(self.own_keys))
        if s.cache_windows is True and cells > CACHE_CELLS:
            self.warnings.append(f"cache_windows keeps {cells:,} cells, which may fill the executors' memory and disks")
        if s.check_duplicate_keys and any(repeated):
            self.errors += [f"Duplicate join keys in the {side} table: {n:,} surplus rows" for side, n in zip(("left", "right"), repeated) if n]
            return self._made()
        self._pruned(*stats)
        counts: dict[str, int] = {}
        samples: dict[str, list] = {}
        if self.path == "hash":
            if differ and s.column_details and self.own_columns:
                with self.timed("details"):
                    differ, counts, samples = self._details(joined(self.left, self.right, self.own_keys, self.own_columns, keys))
        elif self.own_columns:
            with self.timed("details"):
                differ, counts, samples = self._details(joined(self.left, self.right, self.own_keys, self.own_columns, keys))
        summary = RowSummary(
            left_total=both + g["only_l"], right_total=both + g["only_r"], common=both, left_only=g["only_l"], right_only=g["only_r"],
            mismatched=differ, matched=both - differ, mismatch_rate=differ / both if both else 0.0,
        )
        return self._made(summary, counts if s.column_details else {}, samples if s.column_details else {})

    def _details(self, rows: DataFrame) -> tuple[int, dict[str, int], dict[str, list]]:
        """The number of differing rows, counts by column, and samples, from one join:
        the rows that differ are kept until the samples are there."""
        s, own = self.settings, self.own_columns
        different = flagged(rows, self.matches()).filter(differs(own))
        wants_samples = s.column_details and s.sample_count > 0
        several = len(own) > s.columns_per_batch
        if wants_samples or several:
            different = self._keep(different)
        if several:
            differ, by = different.count(), dict(column_mismatches(different, own, s.columns_per_batch).collect())
        else:
            differ, *each = different.agg(F.count("*"), *[F.count_if(~F.col(f"__m_{c}")) for c in own]).first()
            by = dict(zip(own, each))
        samples = self._samples(different, [c for c in own if by[c]]) if wants_samples and differ else {}
        outer = {v: k for k, v in self.inner.items()}
        return differ, {outer[c]: n for c, n in by.items()}, {outer[c]: v for c, v in samples.items()}

    def _samples(self, different: DataFrame, columns: list[str]) -> dict[str, list]:
        """The first differing rows of each column, by key, nulls first. Narrow rows
        tell which keys come first; their rows are ranked once more, since a key may
        have many, so that ``sample_count`` rows a column reach the driver."""
        count, keys = self.settings.sample_count, self.own_keys
        first = sample_keys(different, keys, columns, count).select(*keys).distinct()
        found = different.join(F.broadcast(first), same_key(different, first, keys), "left_semi")
        names = F.array_compact(F.array(*[F.when(~F.col(f"__m_{c}"), F.lit(c)) for c in columns]))
        order = Window.partitionBy("__column").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
        ranked = found.withColumn("__column", F.explode(names)).withColumn("__rank", F.row_number().over(order))
        out: dict[str, list] = defaultdict(list)
        for r in sorted(ranked.filter(F.col("__rank") <= count).collect(), key=lambda r: (r["__column"], r["__rank"])):
            c = r["__column"]
            out[c].append([*[r[k] for k in keys], r[c], r[right_name(c)]])
        return out

    # -- result ---------------------------------------------------------------

    def _made(self, rows: RowSummary | None = None, counts=None, samples=None) -> ComparisonResult:
        s, a = self.settings, self.alignment or Alignment(self.keys)
        rows = rows or RowSummary(left_total=0, right_total=0, common=0, left_only=0, right_only=0, mismatched=0)
        ranked = sorted(((c, n) for c, n in (counts or {}).items() if n), key=lambda x: (-x[1], x[0]))
        stats = [ColumnStat(column=c, dtype=type_name(a.types[c]), mismatches=n, rate=n / rows.common if rows.common else 0.0) for c, n in ranked]
        tables = [
            SampleTable(column=c, total_mismatches=n, headers=[*self.keys, f"{c} ({s.left_name})", f"{c} ({s.right_name})"], rows=samples[c])
            for c, n in ranked
            if samples and samples.get(c)
        ]
        execution = ExecutionInfo(
            path=self.path, path_reason=self.reason, windows=self.windows, rows_per_window=self.rows_per_window, common_keys_only=s.common_keys_only,
            column_details_computed=s.column_details and not self.errors, engine_version=self.version,
            total_seconds=round(time.perf_counter() - self.started, 4), timings={k: round(v, 4) for k, v in self.timings.items()},
        )
        columns = ColumnSummary(
            join_columns=self.keys, compared=a.compared, left_only=a.left_only, right_only=a.right_only,
            type_mismatches=[TypeMismatch(column=c, left=x, right=y) for c, x, y in a.type_mismatches],
        )
        return ComparisonResult(
            left_name=s.left_name, right_name=s.right_name, join_columns=self.keys, rows=rows, columns=columns, column_stats=stats,
            samples=tables, fatal_errors=self.errors, warnings=self.warnings, execution=execution,
        )
