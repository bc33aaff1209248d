"""Registered queries over orders whose changed copy repeats keys: its new keys, a
million higher, are taken there once a table has so many."""

import duckdb
import pytest

from tablewise import queries as own

NAMES = [
    "row_states_orders",
    "mismatched_keys_orders",
    "exact_summary_orders",
    "membership_orders",
    "window_counts_orders",
    "compare_orders",
    "compare_orders_ignore_case_spaces",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("repeated")
    rest = "o_orderstatus, {} AS o_totalprice, o_orderdate, o_orderpriority FROM '/root/testdata/sf0.001/orders.parquet'"
    same, dearer = rest.format("o_totalprice"), rest.format("o_totalprice + 1")
    duckdb.sql(
        f"COPY (SELECT o_orderkey, o_custkey, {same} UNION ALL SELECT o_orderkey + 1000000, o_custkey + 1, {same} "
        f"UNION ALL SELECT o_orderkey, o_custkey, {dearer} WHERE o_orderkey IN (777, 801) "  # twice on both sides
        f"UNION ALL SELECT o_orderkey + 1000000, o_custkey, {same} WHERE o_orderkey IN (890, 979, 1200)) TO '{at}/orders.parquet' (FORMAT parquet)"
    )
    return str(at)


@pytest.mark.parametrize("name", NAMES)
def test_repeated_keys_count_as_in_sql(spark, folder, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet'")
    df = own.queries()[name](spark, folder)
    columns = sorted(df.columns)
    listed = ", ".join(f'"{x}"' for x in columns)
    wanted = c.execute(f"SELECT {listed} FROM ({own.oracle_sql()[name]}) t").fetchall()
    assert sorted(map(str, wanted)) == sorted(str(tuple(r[x] for x in columns)) for r in df.collect())
