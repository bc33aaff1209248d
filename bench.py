"""Headline timings: one JSON line. Whole comparisons of files, as a user runs them."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from tablewise import CompareSettings, compare, queries

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    with tempfile.TemporaryDirectory() as folder:
        cases = {"orders": (queries.ORDERS, {}), "lineitem": (queries.ITEMS, {}), "events_abs_tol": (queries.SUMMARIES["abs_tol_events"], {"abs_tol": {"value": 0.01}}), "orders_ignore_case": (queries.ORDERS, {"ignore_case": True}), "orders_common_keys": (queries.SHIFT, {"common_keys_only": True})}
        runs = {}
        for name, (case, options) in cases.items():
            for side, df in zip(("left", "right"), case.sides(spark, SF)):
                df.write.parquet(f"{folder}/{name}/{side}")
            settings = CompareSettings(join_columns=case.keys, **options)
            runs[f"compare_{name}"] = lambda n=name, s=settings: compare(f"{folder}/{n}/left", f"{folder}/{n}/right", s, spark=spark)
        own = queries.queries()
        for name in ("membership_orders", "row_states_orders", "column_mismatches_orders", "duplicate_surplus_lineitem", "samples_orders"):
            runs[name] = lambda q=own[name]: q(spark, SF).collect()
        took = {}
        for name, run in runs.items():
            run()  # warm-up
            times = []
            for _ in range(RUNS):
                began = time.perf_counter()
                run()
                times.append(time.perf_counter() - began)
            took[name] = round(sorted(times)[len(times) // 2] if len(times) % 2 else sum(sorted(times)[len(times) // 2 - 1 :][:2]) / 2, 4)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    sys.exit(main())
