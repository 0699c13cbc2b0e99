"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

from cohortlens.operators.counters import count_sketch_build
from cohortlens.operators.estimate import key_estimates, query_key, query_keys
from cohortlens.operators.evaluate import accuracy_report
from cohortlens.operators.exact import exact_gsum, exact_gsum_cube, exact_gsum_of
from cohortlens.operators.items import count_items_of, to_items
from cohortlens.operators.sketch import build_sketch, merge_sketches
from cohortlens.params import SketchParams
from cohortlens.session import RECOMMENDED, new_path, write_and_read
from cohortlens.sources.rows import query_keys_of
from cohortlens.sources.store import load_sketch, save_sketch

RUNS = 3  # the median counts


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cohortlens-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in RECOMMENDED.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    params = SketchParams()  # the shipped shape: 3 x 800 cells, 15 layers, 30 heavy hitters
    rows = to_items(lineitem, ["l_suppkey"], ["l_partkey"])
    items = count_items_of(lineitem, ["l_suppkey"], ["l_partkey"])
    keys = query_keys_of(supplier, ["s_suppkey"])
    saved = new_path(spark, "bench-sketch")

    def save():
        counted = write_and_read(items, "items")
        save_sketch(build_sketch(counted, params, items=counted), saved)
        return load_sketch(spark, saved).hh

    def merge():
        halves = [
            build_sketch(to_items(part, ["l_suppkey"], ["l_partkey"]), params)
            for part in (lineitem.where("l_orderkey % 2 = 0"), lineitem.where("l_orderkey % 2 = 1"))
        ]
        return merge_sketches(*halves).hh

    queries = {
        "exact_gsum": lambda: exact_gsum_of(lineitem, ["l_suppkey"], ["l_partkey"]),
        "exact_gsum_multikey": lambda: exact_gsum_of(
            lineitem, ["l_returnflag", "l_linestatus"], ["l_suppkey"]
        ),
        "exact_gsum_heavy_repeats": lambda: exact_gsum_of(
            orders, ["o_orderstatus"], ["o_orderpriority"]
        ),
        "exact_gsum_cube": lambda: exact_gsum_cube(
            lineitem, ["l_returnflag", "l_linestatus"], ["l_suppkey"]
        ),
        "sketch_exact_counts": lambda: build_sketch(rows, params, items=items).hh,
        "sketch_count_sketch": lambda: build_sketch(rows, params, "count_sketch", items=items).hh,
        "sketch_bounded": lambda: build_sketch(rows, params, "bounded", items=items).hh,
        "count_sketch_counters": lambda: count_sketch_build(items, params),
        "sketch_save": save,
        "sketch_query_keys": lambda: query_keys(load_sketch(spark, saved), keys),
        "sketch_query_one_key": lambda: query_key(load_sketch(spark, saved), "7"),
        "sketch_merge": merge,
        "ingest_and_query": lambda: query_keys(build_sketch(rows, params, items=items), keys),
        "accuracy_report": lambda: accuracy_report(
            exact_gsum(items, counted=True), key_estimates(load_sketch(spark, saved))
        ),
    }
    spark.range(1).count()  # the session's own start is not a query's time
    seconds = {}
    for name, query in queries.items():
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(median(runs), 3)
        print(f"{name}: {seconds[name]:.3f}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
