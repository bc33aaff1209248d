import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise import BaseComparator, CompareSettings, ReportSettings, compare
from tablewise.functions.equality import matches
from tablewise.plans.windows import Grid, KeyStats, grid, rows_per_part, shared_range

MODES = [{}, {"window_rows": 3}, {"window_rows": None}, {"common_keys_only": True}, {"cache_windows": True}, {"cache_windows": False}]
RULED = [{"abs_tol": 1e-12}, {"ignore_case": True, "common_keys_only": True}]


@pytest.fixture
def df(spark):
    return lambda schema, rows: spark.createDataFrame(rows, schema)


def run(left, right, keys=("id",), **options):
    return compare(left, right, {"join_columns": list(keys), **options})


def counts(r):
    return r.rows.common, r.rows.left_only, r.rows.right_only, r.rows.mismatched


@pytest.mark.parametrize("mode", MODES + RULED)
def test_identical(df, mode):
    d = df("id long, a long, b string", [(1, 1, "x"), (2, None, "y"), (3, 3, None)])
    r = run(d, d, **mode)
    assert r.is_match and counts(r) == (3, 0, 0, 0) and not r.column_stats


@pytest.mark.parametrize("mode", MODES + RULED)
def test_differences_exclusives_and_samples(df, mode):
    left = df("id long, a long, s string", [(1, 1, "x"), (2, 2, "y"), (3, None, "z"), (9, 1, "q")])
    right = df("id long, a long, s string", [(2, 5, "y"), (3, 3, "w"), (1, 1, "x"), (-4, 0, "n")])
    r = run(left, right, **mode)
    assert counts(r) == (3, 1, 1, 2) and (r.rows.left_total, r.rows.right_total) == (4, 4)
    assert {s.column: s.mismatches for s in r.column_stats} == {"a": 2, "s": 1}
    assert {t.column: t.rows for t in r.samples} == {"a": [[2, 2, 5], [3, None, 3]], "s": [[3, "z", "w"]]}


def test_digest_depends_on_position_and_nulls(df):
    s = "id long, a long, b long"
    assert run(df(s, [(1, 1, 2)]), df(s, [(1, 2, 1)])).rows.mismatched == 1
    assert run(df(s, [(1, None, 5)]), df(s, [(1, 5, None)])).rows.mismatched == 1


@pytest.mark.parametrize("kind", ["double", "float"])
@pytest.mark.parametrize("mode", [{}, {"ignore_case": True}])
def test_floats(df, kind, mode):
    nan, s = float("nan"), f"id long, x {kind}"
    r = run(df(s, [(1, nan), (2, -0.0), (3, None), (4, nan)]), df(s, [(1, -nan), (2, 0.0), (3, None), (4, None)]), **mode)
    assert r.rows.mismatched == 1


def test_tolerance_is_relative_to_the_right(df):
    s = "id long, a double"
    left, right = df(s, [(1, 1.0), (2, 2.0), (3, None), (4, 100.0)]), df(s, [(1, 1.05), (2, 2.5), (3, None), (4, 100.5)])
    assert [run(left, right, **o).rows.mismatched for o in ({"abs_tol": 0.1}, {"abs_tol": {"a": 0.1}}, {"abs_tol": 0.5}, {"rel_tol": 0.05})] == [2, 2, 0, 1]


def test_tolerance_and_odd_floats(df):
    s, inf, nan = "id long, a double", float("inf"), float("nan")
    left, right = df(s, [(1, 5.0), (2, inf), (3, nan), (4, 1.0), (5, inf)]), df(s, [(1, inf), (2, inf), (3, nan), (4, nan), (5, -inf)])
    assert run(left, right, abs_tol=0.1).rows.mismatched == 3


def test_tolerance_on_extreme_integers(df):
    s = "id long, a long"
    top = 2**63 - 1
    assert run(df(s, [(1, top), (2, -top)]), df(s, [(1, top - 1), (2, top)]), abs_tol=1).rows.mismatched == 1


def test_text_options(df):
    s = "id long, s string"
    left, right = df(s, [(1, "ABC"), (2, "x y"), (3, "q")]), df(s, [(1, "abc"), (2, "x  y"), (3, "z")])
    assert [run(left, right, **o).rows.mismatched for o in ({"ignore_case": True}, {"ignore_case": True, "ignore_spaces": True})] == [2, 1]


@pytest.mark.parametrize("options", [{}, {"check_duplicate_keys": False}])
def test_duplicates(df, options):
    r = run(df("id long, a long", [(1, 1), (1, 2), (1, 3), (2, 2)]), df("id long, a long", [(1, 1), (2, 2)]), **options)
    if options:
        assert (r.rows.common, r.rows.mismatched) == (4, 2)
    else:
        assert r.aborted and "2 surplus" in r.fatal_errors[0] and r.rows.common == 0


def test_duplicates_outside_the_overlap_abort(df):
    s = "id long, a long"
    assert run(df(s, [(1, 1), (1, 1), (5, 1)]), df(s, [(5, 1), (6, 1)]), common_keys_only=True).aborted


@pytest.mark.parametrize("mode", MODES)
def test_null_keys_meet(df, mode):
    s = "id long, a long"
    r = run(df(s, [(None, 0), *((i, i) for i in range(11))]), df(s, [(None, 1), *((i, i) for i in range(11))]), **mode)
    assert counts(r) == (12, 0, 0, 1) and r.samples[0].rows == [[None, 0, 1]]


def test_disjoint_keys(df):
    s = "id long, a long"
    for mode in MODES:
        assert counts(run(df(s, [(1, 1), (2, 2)]), df(s, [(3, 3), (4, 4)]), **mode)) == (0, 2, 2, 0)


def test_composite_keys_are_not_joined_as_text(df):
    s = "k1 string, k2 string, v long"
    assert counts(run(df(s, [("a|b", "c", 1), (None, "c", 2)]), df(s, [("a", "b|c", 1), (None, "c", 3)]), ["k1", "k2"])) == (1, 1, 1, 1)


def test_text_key_ignores_windows(df):
    d = df("k string, v long", [("a", 1)])
    r = run(d, d, ["k"], window_rows=5)
    assert r.is_match and "window_rows ignored" in r.warnings[0]


def test_casting(df):
    left, right = df("id long, a int", [(1, 1), (2, 2)]), df("id int, a string", [(1, "1"), (2, "3")])
    assert run(left, right).aborted
    assert run(left, right, casting="left").rows.mismatched == 1
    assert run(left, right, casting="right").rows.mismatched == 1
    bad = df("id int, a string", [(1, "x"), (2, "2")])
    with pytest.raises(Exception, match="CAST_INVALID"):
        run(left, bad, casting="left")
    same_key = df("id long, a string", [(1, "1")])
    r = run(left, same_key)
    assert [t.column for t in r.columns.type_mismatches] == ["a"] and not r.is_match


def test_names(df, spark):
    r = run(df("ID long, A long", [(1, 1)]), df("id long, a long", [(1, 2)]))
    assert r.rows.mismatched == 1 and r.join_columns == ["id"]
    both = spark.sql("SELECT 1L AS id, 2L AS a").toDF("id", "a").select(F.col("id"), F.col("a"), (F.col("a") + 1).alias("A"))
    assert run(both, both).aborted
    r = run(both, both.select("id", F.col("id").alias("x.y"), F.lit(2).cast("long").alias("a")), lowercase_columns=False)
    assert r.columns.left_only == ["A"] and r.columns.right_only == ["x.y"]


def test_missing_key_and_exclusive_columns(df):
    assert run(df("id long", [(1,)]), df("other long", [(1,)])).aborted
    r = run(df("id long, a long, x long", [(1, 1, 1)]), df("id long, a long, y long", [(1, 1, 1)]))
    assert (r.columns.left_only, r.columns.right_only, r.is_match) == (["x"], ["y"], False)
    r = run(df("id long", [(1,), (2,)]), df("id long", [(1,)]))
    assert counts(r) == (1, 1, 0, 0) and r.warnings


def test_nested_types(spark):
    left = spark.sql("SELECT 1L id, array(3, 1, 1) a, named_struct('x', 1) s, map('k', 1, 'j', 2) m")
    right = spark.sql("SELECT 1L id, array(1, 3, 1) a, named_struct('x', 1) s, map('j', 2, 'k', 1) m")
    r = run(left, right)
    assert r.is_match and r.execution.path == "columnwise" and "nested" in r.execution.path_reason
    assert run(left, right.withColumn("a", F.array(F.lit(1), F.lit(3)))).column_stats[0].column == "a"


def test_other_scalars(spark):
    left = spark.sql("SELECT 1L id, DATE'2024-01-01' d, TIMESTAMP_NTZ'2024-01-01 00:00:00' t, true b, X'01' y")
    assert run(left, left).is_match
    assert run(left, left.withColumn("d", F.date_add("d", 1))).rows.mismatched == 1


class Rounded(BaseComparator):
    def compare(self, col_l, col_r, **kwargs):
        assert kwargs["column"] == "a"
        return F.round(F.col(col_l)) == F.round(F.col(col_r))


def test_custom_comparator(df):
    s = "id long, a double"
    r = run(df(s, [(1, 1.1), (2, None), (3, None), (4, 2.0)]), df(s, [(1, 0.9), (2, None), (3, 1.0), (4, 3.0)]), custom_comparators={"A": Rounded()})
    assert r.rows.mismatched == 2 and r.execution.path == "columnwise"
    with pytest.raises(ValueError, match="key"):
        CompareSettings(join_columns=["a"], custom_comparators={"A": Rounded()})


def test_wide_tables_and_batches(spark):
    n = 120
    left = spark.range(50).select("id", *[(F.col("id") * i).alias(f"c{i:03d}") for i in range(n)])
    right = left.withColumns({"c007": F.when(F.col("id") == 3, 0).otherwise(F.col("c007")), "c119": F.when(F.col("id") < 2, -1).otherwise(F.col("c119"))})
    for o in ({}, {"columns_per_batch": 7}, {"columns_per_batch": 7, "abs_tol": 1e-9}, {"abs_tol": 1e-9, "columns_per_batch": 500}):
        r = run(left, right, **o)
        assert {s.column: s.mismatches for s in r.column_stats} == {"c119": 2, "c007": 1} and r.rows.mismatched == 3


@pytest.mark.parametrize("seed", [42, 7])
def test_modes_agree_on_random_tables(spark, seed):
    rng = random.Random(seed)
    pick = lambda *v: None if rng.random() < 0.1 else rng.choice(v)
    row = lambda i: (i, pick(1, 2, 3), pick(0.0, -0.0, 1.5, float("nan")), pick("a", "b", ""))
    schema = "id long, i long, f double, s string"
    left = spark.createDataFrame([row(i) for i in range(0, 400)], schema)
    right = spark.createDataFrame([row(i) for i in range(100, 500)], schema)
    seen = {json.dumps([counts(r), [(c.column, c.mismatches) for c in r.column_stats], [(t.column, t.rows) for t in r.samples]], default=str) for r in (run(left, right, **m) for m in [*MODES, {"abs_tol": 1e-300}])}
    assert len(seen) == 1


VALUES = {
    "double": [None, 0.0, -0.0, 1.0, 1.0 + 1e-9, 2.5, float("nan"), -float("nan")],
    "long": [None, 0, 1, 2, -3],
    "string": [None, "", "a", "A", " a ", "b"],
}


@pytest.mark.parametrize("kind", VALUES)
def test_matches_truth_table(spark, kind):
    pairs = list(itertools.product(VALUES[kind], repeat=2))
    d = spark.createDataFrame(pairs, f"l {kind}, r {kind}")
    dtype = d.schema["l"].dataType

    def same(a, b):
        if a is None or b is None:
            return a is b
        if isinstance(a, float) and (math.isnan(a) or math.isnan(b)):
            return math.isnan(a) and math.isnan(b)
        return a == b

    got = [r.m for r in d.select(matches("l", "r", dtype).alias("m")).collect()]
    assert got == [same(a, b) for a, b in pairs]
    if kind != "string":
        got = [r.m for r in d.select(matches("l", "r", dtype, abs_tol=1.0).alias("m")).collect()]
        near = lambda a, b: a is not None and b is not None and not any(isinstance(x, float) and math.isnan(x) for x in (a, b)) and abs(a - b) <= 1.0
        assert got == [same(a, b) or near(a, b) for a, b in pairs]


def test_planner(spark):
    a, b = KeyStats(100, 0, 0, 99), KeyStats(50, 2, 50, 149)
    assert shared_range(a, b) == (50, 99) and shared_range(a, KeyStats(1, 0, 200, 201)) is None and shared_range(a, KeyStats(1, 1, None, None)) is None
    assert a.share(90, 200) * 10 == 1 and KeyStats(3, 0, 0, 9).share(0, 0) * 10 == 1 and a.share(300, 400) == 0
    assert rows_per_part("auto", 1000, 10, 10, a, b) is None and rows_per_part("auto", 500, 10, 10, a, b) == 50
    assert rows_per_part(None, 1, 1, 1, a, b) is None and rows_per_part(7, 1, 1, 1, a, b) == 7
    assert grid(None, a, b) == Grid(whole=True) and len(grid(None, a, b)) == 1 and grid(100, a, b).whole
    g = grid(30, a, b)
    assert (g.lo, g.hi, g.width, g.nulls, len(g)) == (0, 149, 38, True, 5)
    assert grid(None, a, b, shared_only=True) == Grid(50, 99, 50, True) and len(grid(None, a, KeyStats(3, 0, 200, 201), shared_only=True)) == 0
    ids = spark.createDataFrame([(k,) for k in (None, -1, 0, 37, 38, 149, 150)], "k long").select(g.id("k").alias("i"))
    assert [r.i for r in ids.collect()] == [4, None, 0, 0, 1, 3, None]


@pytest.mark.parametrize("options", [{}, {"ignore_case": True}, {"common_keys_only": True}, {"ignore_case": True, "common_keys_only": True}])
def test_keys_of_any_type(spark, options):
    keys = {"a array<int>": "array(1, 2)", "s struct<x:int,y:string>": "named_struct('x', 1, 'y', 'b')", "d double": "double('NaN')", "b binary": "X'0102'", "t string": "'k'"}
    for name, value in keys.items():
        k = name.split()[0]
        make = lambda v: spark.sql(f"SELECT {value} {k}, {v} v UNION ALL SELECT NULL, 0 UNION ALL SELECT NULL, 0 WHERE false")  # noqa: B023, E731
        r = run(make(1), make(2), [k], **options)
        assert counts(r) == (2, 0, 0, 1) and [t[-2:] for t in r.samples[0].rows] == [[1, 2]]


@pytest.mark.parametrize("options", [{}, {"abs_tol": 0.5}])
def test_samples_of_a_key_with_many_pairs_are_bounded(spark, options, monkeypatch):
    left = spark.range(300).select(F.lit(1).alias("id"), F.col("id").alias("a"), F.lit(0).alias("b"))
    right = left.select("id", (F.col("a") + 1000).alias("a"), F.lit(1).alias("b"))
    collected = []
    whole = type(left).collect
    monkeypatch.setattr(type(left), "collect", lambda self: collected.append(whole(self)) or collected[-1])
    r = run(left, right, check_duplicate_keys=False, sample_count=4, **options)
    assert counts(r) == (90_000, 0, 0, 90_000) and {c.column: c.mismatches for c in r.column_stats} == {"a": 90_000, "b": 90_000}
    assert [len(t.rows) for t in r.samples] == [4, 4] and max(map(len, collected)) <= 8


@pytest.mark.parametrize("options", [{}, {"ignore_case": True}])
def test_common_keys_only_of_text_keys(df, options):
    s = "k string, a string"
    left, right = df(s, [("a", "x"), ("b", "y"), ("c", "z"), (None, "n")]), df(s, [("b", "y"), ("c", "w"), ("d", "v"), (None, "n")])
    r = run(left, right, ["k"], common_keys_only=True, **options)
    assert counts(r) == (3, 1, 1, 1) and r.samples[0].rows == [["c", "z", "w"]]


def test_large_caches_are_warned_of(df, monkeypatch):
    from tablewise.plans import compare as module

    monkeypatch.setattr(module, "CACHE_CELLS", 3)
    d = df("id long, a long", [(1, 1), (2, 2)])
    assert any("cells" in w for w in run(d, d, cache_windows=True).warnings) and not run(d, d).warnings


def test_settings_are_checked():
    for bad in ({"join_columns": []}, {"join_columns": [" "]}, {"join_columns": ["a", "A"]}, {"join_columns": ["a"], "abs_tol": -1}, {"join_columns": ["a"], "rel_tol": {"x": float("inf")}}, {"join_columns": ["a"], "window_rows": True}, {"join_columns": ["a"], "window_rows": 0}, {"join_columns": ["a"], "typo": 1}):
        with pytest.raises(ValueError):
            CompareSettings(**bad)
    assert not CompareSettings(join_columns=["a"], abs_tol={"b": 0.1}).uses_exact_hash() and CompareSettings(join_columns=["a"], abs_tol={"b": 0.0}).uses_exact_hash()


@pytest.mark.parametrize("fmt", ["text", "markdown", "html", "json"])
def test_reports(df, fmt, tmp_path, capsys):
    s = "id long, a long, s string"
    left, right = df(s, [(1, 1, "<b>"), (2, 2, "y")]), df(s, [(1, 3, "|"), (3, 2, "y")])
    r = run(left, right, left_name="base", right_name="new")
    path = tmp_path / "deep" / f"r.{ {'text': 'txt', 'markdown': 'md'}.get(fmt, fmt)}"
    text = r.report(ReportSettings(save_path=path, style="ascii"))
    assert path.read_text(encoding="utf-8") == text and text.strip() in capsys.readouterr().out and "base" in text and "new" in text
    assert text == r.report(ReportSettings(format=fmt, style="ascii", print_output=False)) and capsys.readouterr().out == ""
    if fmt == "json":
        data = json.loads(text)
        assert data["rows"]["mismatched"] == 1 and data["is_match"] is False
    if fmt == "html":
        assert "&lt;b&gt;" in text and "<b>y" not in text
    if fmt == "text":
        assert text.isascii()
    for other in (run(left, left), run(left, df("x long", [(1,)]))):
        assert other.report(ReportSettings(format=fmt, print_output=False))


def test_report_limits(spark):
    left = spark.range(2).select("id", *[F.lit(1).alias(f"c{i:02d}") for i in range(30)])
    r = run(left, left.select("id", *[F.lit(2).alias(f"c{i:02d}") for i in range(30)]))
    assert "c29" not in r.report(ReportSettings(max_columns=5, max_sample_columns=0, print_output=False))
    assert len(json.loads(r.to_json())["column_stats"]) == 30


def test_details_off(df):
    s = "id long, a long"
    r = run(df(s, [(1, 1)]), df(s, [(1, 2)]), column_details=False)
    assert r.rows.mismatched == 1 and not r.column_stats and not r.samples
    assert not run(df(s, [(1, 1)]), df(s, [(1, 2)]), sample_count=0).samples


def test_unsupported_type_is_skipped(spark):
    d = spark.sql("SELECT 1L id, parse_json('1') v, 2 a")
    r = run(d, d)
    assert r.columns.compared == ["a"] and any("v" in w for w in r.warnings)
    assert isinstance(d.schema["v"].dataType, T.VariantType)
