from dataclasses import replace

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from cohortlens import (
    SketchParams,
    build_sketch,
    exact_gsum,
    key_estimates,
    load_sketch,
    query_key,
    query_keys,
    read_query_keys,
    read_rows,
    save_sketch,
    to_items,
    write_estimates,
)
from cohortlens import __main__ as cli
from cohortlens.plans import jobs
from cohortlens.session import new_path, settings_for, work_dir
from cohortlens.sources import store
from cohortlens.sources.rows import query_keys_of
from cohortlens.sources.store import format_estimates, has_sketch

from brute import gsums

LINES = [f'10.0.0.{i % 5},dst{i % 3},x,"a,{i % 7}",6,{i % 2}' for i in range(400)]
KEYS = ["dst0,1,2,3,500", "dst1,1,2,3,50", "dst9,1,2,3,5", "dst0,1,2,3,500"]
PARAMS = SketchParams(w=16, k=1000)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    (folder / "rows.csv").write_text("\n".join(LINES) + "\n")
    (folder / "keys.csv").write_text("\n".join(KEYS) + "\n")
    return folder


def want():
    pairs = []
    for i in range(400):
        pairs.append((f"dst{i % 3}", f'10.0.0.{i % 5}|"a,{i % 7}"|6|{i % 2}'))
    return gsums(pairs)


def lines_of(path):
    return sorted(line for part in path.glob("part-*") for line in part.read_text().splitlines())


def expected_lines(keys, spaced=False):
    sep = ", " if spaced else ","
    sums = want()
    return sorted(
        sep.join([k, *[f"{x:.2f}" for x in sums.get(k, (0, 0, 0, 0))]]) for k in keys
    )


def test_lines(spark, files):
    rows = read_rows(spark, str(files / "rows.csv"))
    got = exact_gsum(to_items(rows, [1], [0, 3, 4, 5]))
    sums = want()
    for r in got.collect():
        assert r["entropy"] == pytest.approx(sums[r["key"]][0])
        assert (int(r["l2"]), r["l1"], r["card"]) == sums[r["key"]][1:]


def test_formats_partitions_and_repeats(spark, files):
    schema = "src string, dst string, x string, q string, p string, f string"
    csv = read_rows(spark, str(files / "rows.csv"), "csv", schema, min_partitions=5, repeat=2)
    assert csv.count() == 800 and csv.rdd.getNumPartitions() >= 5
    assert csv.first()["q"].startswith("a,")  # a csv reader takes the quotes off
    for fmt in ("parquet", "orc", "json"):
        path = new_path(spark, fmt)
        csv.write.format(fmt).save(path)
        assert read_rows(spark, path, fmt, schema).count() == 800


def test_query_keys(spark, files):
    path = str(files / "keys.csv")
    keys = [r["key"] for r in read_query_keys(spark, path, 2).collect()]
    assert sorted(keys) == ["dst0|1", "dst0|1", "dst1|1", "dst9|1"]
    big = read_query_keys(spark, path, quoted=True, min_group_size=50, min_partitions=2)
    assert sorted(r["key"] for r in big.collect()) == ["dst0", "dst0", "dst1"]
    table = spark.createDataFrame([("a", 5), ("b", 50)], "k string, n int")
    assert [r["key"] for r in query_keys_of(table, ["k"], "n", 10).collect()] == ["b"]


def test_save_and_load(spark, files):
    rows = to_items(read_rows(spark, str(files / "rows.csv")), [1], [0, 3, 4, 5])
    for mode in ("exact_counts", "count_sketch"):
        sketch = build_sketch(rows, PARAMS, mode)
        path = new_path(spark, "sketch")
        assert not has_sketch(spark, path)
        save_sketch(sketch, path)
        back = load_sketch(spark, path)
        assert has_sketch(spark, path) and back.params == PARAMS
        assert back.hh.schema.simpleString() == sketch.hh.schema.simpleString()
        assert sorted(back.hh.collect()) == sorted(sketch.hh.collect())
        assert sorted(back.cells.collect()) == sorted(sketch.cells.collect())
        assert (back.counters is None) == (mode == "exact_counts")
        save_sketch(sketch, path)  # again: replaces, does not add
        assert load_sketch(spark, path).hh.count() == sketch.hh.count()


def test_point_query_reads_only_its_cells(spark, files):
    rows = to_items(read_rows(spark, str(files / "rows.csv")), [1], [0, 3, 4, 5])
    path = new_path(spark, "sketch")
    save_sketch(build_sketch(rows, PARAMS), path)
    plan = query_key(load_sketch(spark, path), "dst1")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "cnt" in line)
    assert "EqualTo(w," in scan and "PartitionFilters: [((" in scan


def test_write_estimates(spark, files, tmp_path):
    rows = to_items(read_rows(spark, str(files / "rows.csv")), [1], [0, 3, 4, 5])
    est = key_estimates(build_sketch(rows, PARAMS))
    for _ in range(2):
        write_estimates(est, str(tmp_path / "one"), single_file=True, spaced=True)
    assert len(list((tmp_path / "one").glob("part-*"))) == 1
    assert lines_of(tmp_path / "one") == expected_lines(["dst0", "dst1", "dst2"], spaced=True)
    write_estimates(est, str(tmp_path / "table"), fmt="parquet")
    assert spark.read.parquet(str(tmp_path / "table")).columns == est.columns
    assert format_estimates(est).columns == ["line"]


def test_jobs(spark, files, tmp_path):
    sketch = str(tmp_path / "sketch")
    out = jobs.ingest_and_answer(
        spark, str(files / "rows.csv"), sketch, str(files / "keys.csv"), str(tmp_path / "a"), PARAMS
    )
    assert out.count() == 4
    assert lines_of(tmp_path / "a") == expected_lines(["dst0", "dst0", "dst1", "dst9"])
    jobs.answer_saved(spark, sketch, str(files / "keys.csv"), str(tmp_path / "b"), min_group_size=100)
    assert lines_of(tmp_path / "b") == expected_lines(["dst0", "dst0"])


def test_command_line(spark, files, tmp_path):
    cli.main(
        ["run", "--input", str(files / "rows.csv"), "--sketch", str(tmp_path / "s"), "--w", "16",
         "--k", "1000", "--keys", str(files / "keys.csv"), "--output", str(tmp_path / "o")]
    )
    assert lines_of(tmp_path / "o") == expected_lines(["dst0", "dst0", "dst1", "dst9"])
    help_text = subprocess.run(
        [sys.executable, "-m", "cohortlens", "query", "--help"],
        capture_output=True, text=True, check=True, timeout=120,
    ).stdout
    assert "--min-group-size" in help_text


def test_settings_for_an_input():
    assert settings_for(100 << 40, 8000)["spark.sql.shuffle.partitions"] == "409600"  # 256 MB each, at any size
    assert settings_for(1 << 40, 800)["spark.sql.shuffle.partitions"] == "4096"
    assert settings_for(1 << 20, 8)["spark.sql.shuffle.partitions"] == "8"


def test_work_dir_is_the_configured_one(spark):
    assert work_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert new_path(spark, "x") != new_path(spark, "x")


def test_min_partitions_is_a_floor(spark, files):
    many = read_rows(spark, [str(files / "rows.csv")] * 4, min_partitions=2)
    assert many.rdd.getNumPartitions() >= 2
    assert many.agg(F.count(F.lit(1))).first()[0] == 1600


def test_splits_are_cut_where_files_are_read(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("".join(f"{i},{'x' * 90}\n" for i in range(400_000)))
    before = dict(spark.conf.getAll)
    rows = read_rows(spark, str(path), min_partitions=9)
    assert rows.rdd.getNumPartitions() >= 9
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 400_000
    assert spark.conf.getAll == before  # nothing of it stays
    assert read_rows(spark, str(path)).rdd.getNumPartitions() < 100
    # rows of both kinds of read can meet
    both = rows.unionByName(read_rows(spark, str(path))).groupBy("fields").count()
    assert both.where("count <> 2").isEmpty()
    # a file that can't be cut
    rows.select(F.array_join("fields", ",")).coalesce(1).write.option("compression", "gzip").text(str(tmp_path / "gz"))
    packed = read_rows(spark, str(tmp_path / "gz"), min_partitions=4)
    assert packed.rdd.getNumPartitions() == 4 and packed.count() == 400_000


@pytest.mark.parametrize("mode", ["exact_counts", "count_sketch"])
def test_a_build_reads_its_input_once(spark, files, tmp_path, monkeypatch, mode):
    path = tmp_path / "rows.csv"
    path.write_text((files / "rows.csv").read_text())
    want = jobs.ingest(spark, str(path), str(tmp_path / "a"), PARAMS, mode=mode)
    build = jobs.build_sketch

    def after_the_input_is_gone(*args, **kwargs):
        path.unlink()
        return build(*args, **kwargs)

    monkeypatch.setattr(jobs, "build_sketch", after_the_input_is_gone)
    got = jobs.ingest(spark, str(path), str(tmp_path / "b"), PARAMS, mode=mode)
    for name in ("hh", "cells"):
        assert sorted(getattr(got, name).collect()) == sorted(getattr(want, name).collect())


@pytest.mark.parametrize("stop_at", ["cells", "counters", "current"])
def test_a_save_that_stops_leaves_the_old_sketch(spark, tmp_path, monkeypatch, stop_at):
    from pyspark.sql.readwriter import DataFrameWriter

    path, rows = str(tmp_path / "sketch"), spark.range(300).selectExpr("'k' key", "cast(id as string) value")
    save_sketch(build_sketch(rows, PARAMS, "count_sketch"), path)
    reader = load_sketch(spark, path)
    before = query_key(reader, "k").first()
    write = DataFrameWriter.parquet

    def stopping(self, where, *args, **kwargs):
        if where.endswith(f"/{stop_at}"):
            raise RuntimeError("stopped")
        return write(self, where, *args, **kwargs)

    other = build_sketch(rows.limit(20), replace(PARAMS, w=16), "count_sketch")
    def stopped(*args):
        raise RuntimeError("stopped")

    if stop_at == "current":
        monkeypatch.setattr(store.files, "write_once", stopped)
    monkeypatch.setattr(DataFrameWriter, "parquet", stopping)
    with pytest.raises(RuntimeError):
        save_sketch(other, path)
    monkeypatch.undo()
    assert load_sketch(spark, path).params == PARAMS
    assert query_key(load_sketch(spark, path), "k").first() == before
    save_sketch(other, path)
    assert query_key(load_sketch(spark, path), "k").first() != before
    assert query_key(reader, "k").first() == before


def test_bucketed_sketch_is_not_shuffled(spark, tmp_path):
    rows = spark.range(3000).selectExpr("concat('k', id % 40) key", "concat('v', id % 300) value")
    params = SketchParams(d=3, w=50, k=8)
    path = str(tmp_path / "it's a sketch")
    save_sketch(build_sketch(rows, params), path)
    keys = spark.createDataFrame([(f"k{i % 45}", i) for i in range(60)], "key string, tag int")
    want = sorted(query_keys(load_sketch(spark, path), keys).collect())
    save_sketch(build_sketch(rows, params), path, buckets=4)
    sketch = load_sketch(spark, path)
    spark.sql(f"DROP TABLE {store._bucket_table(store._latest(spark, path)[1]['version'])}")  # as in another session
    sketch = load_sketch(spark, path)
    assert sorted(query_keys(sketch, keys).collect()) == want
    assert sorted(query_keys(sketch, keys, prune_cells=True).collect()) == want
    assert query_key(sketch, "k7", combine="median").first()["l1"] == next(r["l1"] for r in want if r["key"] == "k7")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = query_keys(sketch, keys)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plan.splitlines()
    scan = next(i for i, line in enumerate(above) if "FileScan" in line)
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in above]
    ancestors, level = [], depth[scan]
    for i in range(scan, -1, -1):
        if depth[i] < level:
            ancestors.append(above[i])
            level = depth[i]
    join = next(i for i, line in enumerate(ancestors) if "SortMergeJoin" in line)
    assert "Bucketed: true" in above[scan] and not any("Exchange" in line for line in ancestors[:join])
    save_sketch(build_sketch(rows, params), path)
    assert len(store.remove_old_versions(spark, path)) == 2
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("cohortlens_")]


def test_two_writers_give_one_winner_and_one_error(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "sketch"), spark.range(300).selectExpr("'k' key", "cast(id as string) value")
    first, other = build_sketch(rows, PARAMS), build_sketch(rows, replace(PARAMS, w=16), "bounded")
    write, done = store.write_tables, []

    def while_another_saves(*args):
        write(*args)
        if not done:
            done.append(1)
            save_sketch(other, path)

    monkeypatch.setattr(store, "write_tables", while_another_saves)
    with pytest.raises(store.SaveConflict):
        save_sketch(first, path)
    monkeypatch.undo()
    back = load_sketch(spark, path)
    assert back.params == other.params and back.mode == "bounded"
    assert sorted(back.cuts.collect()) == sorted(other.cuts.collect())
    assert len(list((tmp_path / "sketch" / "versions").iterdir())) == 1
    save_sketch(first, path)  # later, not at the same time
    assert load_sketch(spark, path).params == PARAMS
    # a writer that died between its tables and the end of its marker is in nobody's way
    (tmp_path / "sketch" / "current" / f"{3:020d}").write_text("")
    assert load_sketch(spark, path).params == PARAMS
    save_sketch(other, path)
    assert load_sketch(spark, path).params == other.params


def test_old_versions_go_when_nobody_reads_them(spark, tmp_path):
    path, rows = str(tmp_path / "sketch"), spark.range(300).selectExpr("'k' key", "cast(id as string) value")
    with pytest.raises(FileNotFoundError), store.held_sketch(spark, path):
        pass
    save_sketch(build_sketch(rows.limit(7), PARAMS), path)
    with store.held_sketch(spark, path) as held:
        for n in (20, 300):
            save_sketch(build_sketch(rows.limit(n), PARAMS), path)
        assert store.remove_old_versions(spark, path) == [f"{2:020d}"]
        assert held.cells.agg(F.max("total_count")).first()[0] == 7
    assert load_sketch(spark, path).cells.agg(F.max("total_count")).first()[0] == 300
    assert store.remove_old_versions(spark, path, keep=2) == []
    assert store.remove_old_versions(spark, path) == [f"{1:020d}"]
    assert len(list((tmp_path / "sketch" / "versions").iterdir())) == 1
    # holds that a dead reader left do not last
    (tmp_path / "sketch" / "holds" / f"{3:020d}-dead").write_text("{}")
    save_sketch(build_sketch(rows, PARAMS), path)
    assert store.remove_old_versions(spark, path) == []
    assert store.remove_old_versions(spark, path, hold_seconds=0) == [f"{3:020d}"]
    with pytest.raises(ValueError):
        store.remove_old_versions(spark, path, keep=0)
