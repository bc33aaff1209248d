import duckdb
import pytest

import __spark_entry__ as driver
from tablewise import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(row):
    return tuple("NaN" if x != x else str(round(x, 9)) if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query_agrees_with_sql(spark, duck, name):
    df = own.queries()[name](spark, SF)
    columns = sorted(df.columns)
    said = duck.sql(own.oracle_sql()[name])
    at = [said.columns.index(c) for c in columns]
    assert sorted(_plain(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(_plain(tuple(r[i] for i in at)) for r in said.fetchall())


def test_known_counts(spark):
    row = own.queries()["exact_summary_orders"](spark, "/root/testdata/sf0.01").first()
    assert (row.common, row.left_only, row.right_only, row.mismatched) == (14845, 155, 169, 1483)


def test_entry(spark):
    assert driver.entry(spark).count() == 3
    assert set(driver.oracle_sql()) <= set(driver.queries())
