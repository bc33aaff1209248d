"""CSV folders whose first file holds no row, as Spark writes them if its first
partition is empty."""

import shutil

from tablewise import SourceOptions, queries
from tablewise.sources import open_source


def test_types_come_from_files_with_rows(spark, tmp_path):
    for i, text in enumerate(["id,x,s\n", "id,x,s\n1,,a\n", "id,x,s\n2,1.5,b\n3,2.5,c\n"]):
        (tmp_path / f"part-{i}.csv").write_text(text)
    df = open_source(tmp_path, spark=spark)
    assert df.dtypes == [("id", "bigint"), ("x", "double"), ("s", "string")]
    assert sorted(map(tuple, df.collect())) == [(1, None, "a"), (2, 1.5, "b"), (3, 2.5, "c")]
    assert dict(open_source(tmp_path, SourceOptions(csv_infer_schema_length=1), spark).dtypes)["x"] == "string"


def test_orders_of_several_splits(spark, tmp_path):
    """One row group in several splits leaves the first one without rows."""
    shutil.copy("/root/testdata/sf0.001/orders.parquet", tmp_path / "orders.parquet")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert spark.read.parquet(str(tmp_path / "orders.parquet")).rdd.glom().map(len).first() == 0
        row = queries.queries()["csv_vs_parquet_orders"](spark, str(tmp_path)).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert (row.common, row.left_only, row.right_only, row.mismatched) == (1500, 0, 0, 0)
