import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens import SketchParams, build_sketch, count_items, exact_gsum, key_estimates
from cohortlens.operators.counters import count_sketch_build
from cohortlens.operators.bounded import key_bounds
from cohortlens.session import new_path, write_and_read
from cohortlens.sources import files
from cohortlens.streaming import incremental
from cohortlens.streaming.incremental import _cover, _logged, latest_sketch, remove_merged, sketch_updater
from cohortlens.streaming.windows import sliding_gsum, window_gsum

PARAMS = SketchParams(w=8, k=20, k_store=5000)


def table(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("key"),
        F.col("event_type").alias("value"),
    )


def stream_of(spark, df, n_files):
    # one after the other: a file source takes files by age, and late rows would be dropped
    path = new_path(spark, "input")
    part = F.ntile(n_files).over(Window.orderBy("ts"))
    parts = df.withColumn("part", part).cache()
    for i in range(1, n_files + 1):
        parts.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_closed_windows_equal_batch(spark, events):
    out = new_path(spark, "windows")
    query = (
        window_gsum(stream_of(spark, events, 3), "ts", "1 day", "2 hours")
        .writeStream.outputMode("append")
        .option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True)
        .start(f"{out}/table", format="parquet")
    )
    query.awaitTermination()
    got = spark.read.parquet(f"{out}/table")
    rounded = lambda df: table(df.withColumn("entropy", F.round("entropy", 6)))
    end = events.agg(F.max("ts") - F.expr("interval 2 hours")).first()[0]
    batch = window_gsum(events, "ts", "1 day", "2 hours")
    closed = batch.where(F.col("window_end") <= F.lit(end))
    assert 20 < got.select("window_start").distinct().count()
    assert rounded(got) == rounded(closed)
    day = events.where(F.to_date("ts") == F.to_date(F.lit(end)) - 1)
    one = batch.where(F.to_date("window_start") == F.to_date(F.lit(end)) - 1)
    assert table(one.select("key", "l2", "l1", "card")) == table(
        exact_gsum(day).select("key", "l2", "l1", "card")
    )


def test_sliding_windows_of_a_stream_equal_batch(spark, events):
    out = new_path(spark, "windows")
    query = (
        sliding_gsum(stream_of(spark, events, 3), "ts", "3 days", "1 day", "2 hours")
        .writeStream.outputMode("append")
        .option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True)
        .start(f"{out}/table", format="parquet")
    )
    query.awaitTermination()
    got = spark.read.parquet(f"{out}/table")
    end = events.agg(F.max("ts") - F.expr("interval 2 hours")).first()[0]
    batch = sliding_gsum(events, "ts", "3 days", "1 day", "2 hours")
    rounded = lambda df: table(df.withColumn("entropy", F.round("entropy", 6)))
    assert rounded(got) == rounded(batch.where(F.col("window_end") <= F.lit(end)))
    plain = events.withColumn("w", F.window("ts", "3 days", "1 day"))
    one = plain.groupBy("w", "key").agg(F.count("value").alias("l1"), F.countDistinct("value").alias("card"))
    assert table(one.select("w.start", "key", "l1", "card")) == table(batch.select("window_start", "key", "l1", "card"))


def test_stream_sketch_equals_one_shot(spark, events):
    out = new_path(spark, "stream")
    rows = stream_of(spark, events, 3).select("key", "value")
    query = (
        rows.writeStream.foreachBatch(sketch_updater(f"{out}/sketch", PARAMS))
        .option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    merged, once = latest_sketch(spark, f"{out}/sketch"), build_sketch(events, PARAMS)
    assert table(merged.hh) == table(once.hh)
    assert table(merged.cells) == table(once.cells)
    assert table(merged.counters) == table(count_sketch_build(count_items(events), PARAMS))
    assert table(key_estimates(merged).select("key", "l1")) == table(
        exact_gsum(events).select("key", "l1")
    )


def test_half_written_state_is_not_taken(spark, events, monkeypatch):
    path = new_path(spark, "log")
    update = sketch_updater(path, PARAMS, with_counters=False)
    rows = events.select("key", "value")
    update(rows, 0)

    def stopped(*args):
        raise RuntimeError("stopped")

    # batch 1 stops after its tables, before its mark
    monkeypatch.setattr(files, "write_once", stopped)
    with pytest.raises(RuntimeError):
        update(rows.limit(5), 1)
    monkeypatch.undo()
    assert table(latest_sketch(spark, path).cells) == table(build_sketch(events, PARAMS).cells)
    update(rows.limit(0), 1)
    assert table(latest_sketch(spark, path).cells) == table(build_sketch(events, PARAMS).cells)


def test_segments_are_merged_by_levels(spark, events):
    """Nine batches, merged by threes: the segments that count, what is removed, and the answers."""
    path = new_path(spark, "log")
    update = sketch_updater(path, PARAMS, keep_items=True, fan=3, kept_seconds=1e9)
    rows = write_and_read(events.select("key", "value"), "rows")
    part = F.pmod(F.xxhash64("key", "value"), F.lit(10))
    cover = []
    for n in range(10):
        update(rows.where(part == n), n)
        cover.append(_cover(_logged(spark, path)))
    assert cover[1] == [(0, 0), (1, 1)] and cover[2] == [(0, 2)] and cover[7] == [(0, 2), (3, 5), (6, 6), (7, 7)]
    assert cover[8] == [(0, 8)] and cover[9] == [(0, 8), (9, 9)]
    once = build_sketch(events, PARAMS)
    for _ in range(2):
        merged = latest_sketch(spark, path)
        assert table(merged.hh) == table(once.hh) and table(merged.cells) == table(once.cells)
        assert table(merged.counters) == table(count_sketch_build(count_items(events), PARAMS))
        remove_merged(spark, path, kept_seconds=0)
        assert _logged(spark, path) == [(0, 8), (9, 9)]


def test_a_merge_that_stopped_is_made_up_for(spark, events, monkeypatch):
    path = new_path(spark, "log")
    update = sketch_updater(path, PARAMS, with_counters=False, fan=2)
    rows = events.select("key", "value")
    first, second = rows.where("value = 'click'"), rows.where("value <> 'click'")
    update(first, 0)
    monkeypatch.setattr(incremental, "merge_sketches", lambda *s: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        update(second, 1)
    monkeypatch.undo()
    assert _cover(_logged(spark, path)) == [(0, 0), (1, 1)]
    update(second, 1)  # as Spark runs it again
    assert _cover(_logged(spark, path)) == [(0, 1)]
    assert table(latest_sketch(spark, path).cells) == table(build_sketch(events, PARAMS).cells)


def test_what_a_batch_writes_follows_the_batch(spark):
    path = new_path(spark, "log")
    update = sketch_updater(path, PARAMS, with_counters=False, keep_items=True)
    big = spark.range(400_000).selectExpr("concat('k', id % 97) key", "concat('v', id) value")
    update(big, 0)
    before = files.size_bytes(spark, path)
    update(big.limit(50), 1)
    assert files.size_bytes(spark, path) - before < before / 100
    assert latest_sketch(spark, path).cells.where("d = 0").agg(F.sum("total_count")).first()[0] == 400_050


def test_bounded_streams_tell_what_they_miss(spark, events):
    path = new_path(spark, "log")
    small = SketchParams(d=3, w=4, levels=3, k=2)
    update = sketch_updater(path, small, "bounded", with_counters=False, fan=2)
    rows = events.select("key", "value")
    for n in range(5):
        update(rows.where(F.pmod(F.xxhash64("key", "value", F.lit(1)), F.lit(5)) == n), n)
    exact = {r["key"]: r["l1"] for r in exact_gsum(events, ["l1"]).collect()}
    bounds = key_bounds(latest_sketch(spark, path), events.select("key").distinct()).collect()
    assert all(r["l1_low"] <= exact[r["key"]] <= r["l1_high"] for r in bounds)
    assert any(r["l1_low"] < r["l1_high"] for r in bounds)


def test_replayed_batch_counts_once(spark, events):
    path = new_path(spark, "slots")
    update = sketch_updater(path, PARAMS, with_counters=False)
    rows = events.select("key", "value")
    first, second = rows.where("value = 'click'"), rows.where("value <> 'click'")
    update(first, 0)
    update(first, 0)
    update(second, 1)
    update(second, 1)
    assert table(latest_sketch(spark, path).cells) == table(build_sketch(events, PARAMS).cells)
    with pytest.raises(ValueError):
        update(first, 5)
    with pytest.raises(ValueError):
        update(first, 0)  # another query on the same path
    with pytest.raises(FileNotFoundError):
        latest_sketch(spark, new_path(spark, "none"))
