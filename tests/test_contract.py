import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from cohortlens.plans import catalog
from cohortlens.plans.twins import SQL

NAMES = sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(r[i] for i in order) for r in rows]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_twin(spark, sql, sf_dir, name):
    df = contract.queries()[name](spark, sf_dir)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    assert got
    if name in SQL:
        result = sql.execute(SQL[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows_of(result.fetchall(), columns)


def test_every_twin_has_a_query():
    assert set(SQL) <= set(NAMES)
    assert set(NAMES) - set(SQL) == {"hash_lanes_xx"}


def test_entry(spark):
    assert contract.entry(spark).columns == ["key", "entropy", "l2", "l1", "card"]


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    execution = df._jdf.queryExecution()
    execution.executedPlan().execute().count()
    return execution.executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in NAMES if not n.startswith("stream")])
def test_no_cross_joins_and_no_python_in_plans(spark, sf_dir, name):
    plan = contract.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython"):
        assert operator not in plan


def test_scans_read_only_what_is_needed(spark, sf_dir):
    plan = contract.queries()["exact_gsum"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>" in plan


def test_top_k_is_cut_before_the_shuffle(spark, sf_dir):
    for name in ("sketch_build", "propagate_layers", "merge_sketches"):
        plan = contract.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "row_number(), 30, Partial" in plan and "row_number(), 30, Final" in plan


@pytest.mark.parametrize("name", ["sketch_build", "count_sketch_estimate", "accuracy_report"])
def test_items_are_scanned_and_counted_once(spark, sf_dir, name):
    plan = final_plan(catalog.QUERIES[name](spark, sf_dir))
    final = plan.split("Initial Plan")[0]
    assert "ReusedExchange" in final and final.count("FileScan") == 1


def test_bucketed_query_leaves_no_table(spark, sf_dir):
    before = {t.name for t in spark.catalog.listTables()}
    found = contract.queries()["bucketed_query"](spark, sf_dir)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert "Bucketed: true" in found._jdf.queryExecution().executedPlan().toString()
    want = contract.queries()["sketch_roundtrip"](spark, sf_dir)
    assert found.count() and sorted(found.collect()) == sorted(want.collect())


def test_batch_answers_have_several_writers(spark, sf_dir):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small parts are joined
    try:
        assert len(contract.queries()["file_job_batch"](spark, sf_dir).inputFiles()) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_batch_windows_hold_every_day(spark, sf_dir):
    found = contract.queries()["batch_window_gsum"](spark, sf_dir)
    days = {r[0] for r in found.select("window_start").distinct().collect()}
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert days == {r[0] for r in events.selectExpr("unix_date(cast(ts as date)) * 86400L").distinct().collect()}
    assert found.selectExpr("sum(l1)").first()[0] == events.count()
