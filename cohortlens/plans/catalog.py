"""The registered queries: each reads the tables of a folder and returns a DataFrame.

The SQL twin of every query that has one is in ``plans.twins`` under the same name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_lanes, item_layer, wide_layer_hash
from ..functions.metrics import METRICS, Metric, relative_errors_pct, shannon_entropy
from ..functions.text import format_array, split_quoted
from ..operators.bounded import key_bounds
from ..operators.cells import assign_cells, cell_totals, place_items, with_layer
from ..operators.counters import count_sketch_build, count_sketch_estimate, merge_counters
from ..operators.estimate import cell_gsum, key_estimates, propagate, query_key, query_keys
from ..operators.evaluate import accuracy_report, key_errors
from ..operators.exact import exact_gsum, exact_gsum_cube, exact_gsum_of
from ..operators.items import (
    count_items,
    count_items_of,
    repeat_items,
    restrict_to_keys,
    to_items,
)
from ..operators.lattice import cube_errors, cube_estimates
from ..operators.sketch import (
    Sketch,
    build_sketch,
    heavy_hitters,
    merge_sketches,
    sketch_stats,
    top_of_cells,
)
from ..operators.topk import topk_items
from ..params import SketchParams
from ..session import new_path, write_and_read
from ..sources.rows import query_keys_of, read_rows, repeat_rows
from ..sources.store import format_estimates, leave_catalog, load_sketch, save_sketch
from ..streaming.incremental import latest_sketch, sketch_updater
from ..streaming.windows import sliding_gsum, window_gsum
from . import jobs

Query = Callable[[SparkSession, str], DataFrame]

# md5 lanes, so that any SQL engine can check the sketch.
PARAMS = SketchParams(d=3, w=64, levels=15, k=30, rows=3, cols=400, algo="md5")
WIDE_PARAMS = SketchParams(d=3, w=1_000_000, levels=25, k=30, algo="md5")
CUBE_PARAMS = SketchParams(levels=15, k=30, k_store=120, algo="md5")
CUBE_DIMS = ["l_returnflag", "l_linestatus"]
SMALL_K = 5
POINT_KEY = "7"
TOP_KEYS = 10
REPEATS = 3
BOUNDED_ITEMS = 40
BUCKETS = 16
SLIDING_DAYS = 7
MIN_GROUP_SIZE = 600
MIN_PAIR_SIZE = 3
DELAY_DAYS = 1
ENTROPY_DIGITS = 4

QUERIES: dict[str, Query] = {}


def _query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_items(_table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_partkey"])


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_items_of(_table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_partkey"])


def _sketch(
    spark: SparkSession, sf_dir: str, params: SketchParams = PARAMS, mode: str = "exact_counts"
) -> Sketch:
    rows, items = _rows(spark, sf_dir), _items(spark, sf_dir)
    return build_sketch(rows, params, mode, items=items)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).withColumnRenamed("f", "cnt")
    return place_items(items, PARAMS)


def _supplier_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_keys_of(_table(spark, sf_dir, "supplier"), ["s_suppkey"])


def _tidy(df: DataFrame) -> DataFrame:
    """Answers in comparable types: entropy rounded, the wide second moment as a double."""
    out = []
    for name in df.columns:
        if name == "entropy":
            out.append(F.round(name, ENTROPY_DIGITS).alias(name))
        elif name == "l2":
            out.append(F.col(name).cast("double").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


# --- exact -------------------------------------------------------------------------------


@_query("exact_gsum")
def exact_gsum_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = _table(spark, sf_dir, "lineitem")
    return _tidy(exact_gsum_of(lineitem, ["l_suppkey"], ["l_partkey"]))


@_query("exact_gsum_multikey")
def exact_gsum_multikey(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = _table(spark, sf_dir, "lineitem")
    return _tidy(exact_gsum_of(lineitem, ["l_returnflag", "l_linestatus"], ["l_suppkey"]))


@_query("exact_gsum_heavy_repeats")
def exact_gsum_heavy_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few groups and few values: every frequency is large."""
    orders = _table(spark, sf_dir, "orders")
    return _tidy(exact_gsum_of(orders, ["o_orderstatus"], ["o_orderpriority"]))


@_query("exact_gsum_tuple_value")
def exact_gsum_tuple_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return _tidy(exact_gsum(to_items(events, ["user_id"], ["event_type", "props"])))


@_query("exact_gsum_prefix_key")
def exact_gsum_prefix_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key columns by position: the first two, and the third as the value."""
    customer = _table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey", "c_custkey")
    return _tidy(exact_gsum_of(customer, [0, 1], [2]))


@_query("exact_gsum_custom_g")
def exact_gsum_custom_g(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = _table(spark, sf_dir, "lineitem")
    metrics = {
        "capped": Metric(lambda f: F.least(f, F.lit(3).cast("bigint")), "bigint"),
        "cubes": lambda f: f * f * f,
    }
    return exact_gsum_of(lineitem, ["l_suppkey"], ["l_partkey"], metrics)


@_query("exact_gsum_global")
def exact_gsum_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(exact_gsum(_items(spark, sf_dir), by_key=False, counted=True))


@_query("exact_gsum_cube")
def exact_gsum_by_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = _table(spark, sf_dir, "lineitem")
    return _tidy(exact_gsum_cube(lineitem, ["l_returnflag", "l_linestatus"], ["l_suppkey"]))


@_query("shannon_entropy")
def group_shannon_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = _table(spark, sf_dir, "lineitem")
    sums = exact_gsum_of(lineitem, ["l_suppkey"], ["l_partkey"], ["entropy", "l1"])
    bits = shannon_entropy(F.col("entropy"), F.col("l1"))
    return sums.select("key", F.round(bits, ENTROPY_DIGITS).alias("shannon"))


@_query("repeat_ingest")
def repeat_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same file read several times."""
    rows = read_rows(spark, f"{sf_dir}/lineitem.parquet", fmt="parquet", repeat=REPEATS)
    return _tidy(exact_gsum_of(rows, ["l_suppkey"], ["l_partkey"]))


@_query("repeat_counted")
def repeat_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answer from one read: frequencies times the number of repeats."""
    return _tidy(exact_gsum(repeat_items(_items(spark, sf_dir), REPEATS), counted=True))


@_query("split_quoted")
def split_quoted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    line = F.format_string('%s,"%s,%s",%s', "event_id", "event_type", "user_id", "user_id")
    fields = events.select(split_quoted(line).alias("fields"))
    picked = [F.get("fields", F.lit(i)).alias(f"field{i}") for i in range(3)]
    return fields.select(F.size("fields").alias("n_fields"), *picked)


@_query("split_quoted_documents")
def split_quoted_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text full of quotes and commas: JSON as it is, whole documents, odd quotes included."""
    documents = _table(spark, sf_dir, "documents")
    fields = split_quoted(F.col("text"))
    return documents.select(
        "doc_id",
        F.size(fields).alias("n_fields"),
        F.md5(F.array_join(fields, "\n")).alias("fields_md5"),
    )


@_query("restrict_top_keys")
def restrict_top_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))
    # before anything is counted
    kept = restrict_to_keys(_rows(spark, sf_dir), suppliers, TOP_KEYS, ["key"])
    return _tidy(exact_gsum(kept))


# --- hashing -----------------------------------------------------------------------------


def _lanes(items: DataFrame, algo: str) -> DataFrame:
    lanes = hash_lanes(F.col("key"), F.col("value"), salt="item", algo=algo)
    hashed = items.select("key", "value", lanes.alias("lanes"))
    lane: list[Column] = [F.get("lanes", F.lit(i)) for i in range(4)]
    return hashed.select(
        "key",
        "value",
        *[x.alias(f"lane{i}") for i, x in enumerate(lane)],
        item_layer(lane[3], PARAMS.levels).alias("layer"),
        wide_layer_hash(*lane).alias("wide_hash"),
    )


@_query("hash_lanes")
def hash_lanes_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lanes(_items(spark, sf_dir), "md5")


@_query("hash_lanes_xx")
def hash_lanes_xx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lanes(_items(spark, sf_dir), "xxhash64")


@_query("layer_histogram")
def layer_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = _lanes(_items(spark, sf_dir), "md5").groupBy("layer")
    return layers.agg(F.count(F.lit(1)).alias("n_items"))


@_query("cell_assignment")
def cell_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_cells(_supplier_keys(spark, sf_dir), PARAMS)


@_query("cell_assignment_wide")
def wide_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid wider than one 16-bit lane."""
    return assign_cells(_supplier_keys(spark, sf_dir), WIDE_PARAMS)


@_query("layer_histogram_wide")
def deep_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More layers than one 16-bit lane can tell apart."""
    layers = with_layer(_items(spark, sf_dir), WIDE_PARAMS).groupBy("layer")
    return layers.agg(F.count(F.lit(1)).alias("n_items"))


# --- counters ----------------------------------------------------------------------------


@_query("count_sketch_build")
def count_sketch_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_sketch_build(_items(spark, sf_dir), PARAMS)


@_query("count_sketch_low_sign")
def count_sketch_low_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs from the lowest bit of a lane; the counters straight from the raw rows."""
    return count_sketch_build(_rows(spark, sf_dir), replace(PARAMS, sign_bit=0))


@_query("count_sketch_estimate")
def count_sketch_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    counters = count_sketch_build(items, PARAMS)
    return count_sketch_estimate(items, counters, PARAMS).drop("f")


@_query("merge_counters")
def merged_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = _halves(spark, sf_dir)
    return merge_counters(*[count_sketch_build(count_items(h), PARAMS) for h in halves])


# --- top-k and the sketch itself -----------------------------------------------------------


@_query("topk_items")
def topk_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small k, so that the cut bites."""
    placed = _placed(spark, sf_dir).select("d", "w", "layer", "key", "value", "cnt")
    return top_of_cells(placed, PARAMS, SMALL_K)


@_query("topk_items_ties")
def topk_items_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _placed(spark, sf_dir).select("d", "w", "layer", "key", "value", "cnt")
    cell_layers = PARAMS.d * PARAMS.w * PARAMS.levels
    return topk_items(placed, ["d", "w", "layer"], SMALL_K, ties=True, most_groups=cell_layers)


@_query("sketch_build")
def sketch_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sketch(spark, sf_dir).hh


@_query("cell_totals")
def totals_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_totals(_rows(spark, sf_dir), PARAMS)


@_query("sketch_stats")
def stats_of_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_stats(_sketch(spark, sf_dir))


@_query("heavy_hitters")
def top_layer_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_hitters(_sketch(spark, sf_dir))


def _halves(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The whole table as two inputs that were sketched apart."""
    lineitem = _table(spark, sf_dir, "lineitem")
    return [
        to_items(lineitem.where(F.col("l_orderkey") % 2 == part), ["l_suppkey"], ["l_partkey"])
        for part in (0, 1)
    ]


@_query("merge_sketches")
def merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_sketches(*[build_sketch(h, PARAMS) for h in _halves(spark, sf_dir)]).hh


@_query("merge_sketches_kept")
def merged_without_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs that carry their counted items: the answers are those of one sketch of everything."""
    merged = merge_sketches(*[build_sketch(h, PARAMS, keep_items=True) for h in _halves(spark, sf_dir)])
    return _tidy(key_estimates(merged))


# --- estimates ---------------------------------------------------------------------------


@_query("propagate_layers")
def propagate_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propagate(_sketch(spark, sf_dir).hh, PARAMS)


@_query("sketch_gsum_median")
def sketch_gsum_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _supplier_keys(spark, sf_dir)
    return _tidy(query_keys(_sketch(spark, sf_dir), keys, combine="median"))


@_query("sketch_gsum_min")
def sketch_gsum_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _supplier_keys(spark, sf_dir)
    return _tidy(query_keys(_sketch(spark, sf_dir), keys, combine="min"))


@_query("sketch_gsum_layered")
def sketch_gsum_layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(key_estimates(_sketch(spark, sf_dir, replace(PARAMS, layered=True))))


@_query("sketch_gsum_count_sketch")
def sketch_gsum_count_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked by, and counted with, Count-Sketch estimates."""
    return _tidy(key_estimates(_sketch(spark, sf_dir, mode="count_sketch")))


@_query("sketch_gsum_custom_g")
def sketch_gsum_custom_g(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = {"cubes": lambda f: f * f * f}
    return key_estimates(_sketch(spark, sf_dir), metrics)


@_query("cell_gsum_all")
def cell_gsum_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = propagate(_sketch(spark, sf_dir).hh, PARAMS)
    return _tidy(cell_gsum(assigned, by="cell"))


@_query("table_gsum")
def table_gsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = propagate(_sketch(spark, sf_dir).hh, PARAMS)
    return _tidy(cell_gsum(assigned, by="table"))


@_query("point_query")
def point_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(query_key(_sketch(spark, sf_dir), POINT_KEY))


@_query("saved_point_query")
def saved_point_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key of a saved sketch; the other cells are not read."""
    path = new_path(spark, "sketch")
    save_sketch(_sketch(spark, sf_dir), path)
    return _tidy(query_key(load_sketch(spark, path), POINT_KEY))


@_query("sketch_xx_whole")
def sketch_that_holds_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default hash, and room for the fullest cell: whatever the hash, every item stays in
    layer 0 and the answers are the exact ones."""
    params = replace(PARAMS, algo="xxhash64")
    items = write_and_read(_items(spark, sf_dir), "items")
    sizes = assign_cells(items, params).groupBy("d", "w").agg(F.count(F.lit(1)).alias("n"))
    fullest = sizes.agg(F.max("n")).first()[0] or 1
    return _tidy(key_estimates(build_sketch(items, replace(params, k=fullest), items=items)))


@_query("missing_keys")
def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier once under its own key and once under one that does not exist."""
    known = _supplier_keys(spark, sf_dir)
    unknown = known.select(F.concat(F.lit("none:"), "key").alias("key"))
    return _tidy(query_keys(_sketch(spark, sf_dir), known.union(unknown)))


@_query("query_repeated")
def query_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of keys with repeats: every one is answered."""
    keys = repeat_rows(_supplier_keys(spark, sf_dir), 2)
    return _tidy(query_keys(_sketch(spark, sf_dir), keys))


@_query("query_distinct")
def query_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of keys with many repeats, taken as a set."""
    keys = _rows(spark, sf_dir).select("key")
    return _tidy(query_keys(_sketch(spark, sf_dir), keys, distinct=True, prune_cells=True))


@_query("query_keys_min_group")
def query_keys_min_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = _table(spark, sf_dir, "lineitem")
    groups = lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("group_size"))
    keys = query_keys_of(groups, ["l_suppkey"], "group_size", MIN_GROUP_SIZE)
    return _tidy(query_keys(_sketch(spark, sf_dir), keys))


@_query("sketch_roundtrip")
def sketch_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "sketch")
    save_sketch(_sketch(spark, sf_dir), path)
    return _tidy(query_keys(load_sketch(spark, path), _supplier_keys(spark, sf_dir)))


@_query("bucketed_query")
def bucketed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sketch stored in buckets of cells; the keys go to its cells, and it is not shuffled."""
    path = new_path(spark, "sketch")
    save_sketch(_sketch(spark, sf_dir), path, buckets=BUCKETS)
    answers = _tidy(query_keys(load_sketch(spark, path), _supplier_keys(spark, sf_dir)))
    leave_catalog(spark, path)  # the caller's catalog is as it was
    return answers


@_query("file_job")
def files_to_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job on text files: lines with quoted commas in, result lines out."""
    events = _table(spark, sf_dir, "events")
    out = new_path(spark, "file-job")
    line = F.format_string(
        '%s,%s,%s,"%s,%s",%s,%s',
        "event_type", "user_id", "event_id", "event_type", "event_type", "props", "event_type",
    )
    events.select(line).write.text(f"{out}/rows")
    groups = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    groups.select(F.format_string("%s,0,0,0,%s", "user_id", "n")).write.text(f"{out}/keys")
    jobs.ingest_and_answer(
        spark, f"{out}/rows", f"{out}/sketch", f"{out}/keys", f"{out}/answers", PARAMS
    )
    return spark.read.text(f"{out}/answers").select(F.col("value").alias("line"))


@_query("file_job_batch")
def batch_of_keys_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of two fields, one of them quoted, from a file with group sizes; spaced lines out, in
    as many files as there are writers: they grow with the users."""
    events = _table(spark, sf_dir, "events")
    out = new_path(spark, "file-job")
    line = F.format_string(
        '%s,%s,%s,"%s,%s",%s', "event_id", "user_id", "event_id", "event_type", "event_type", "props"
    )
    events.select(line).write.text(f"{out}/rows")
    groups = events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    key_line = F.format_string('%s,"%s,%s",0,0,%s', "user_id", "event_type", "event_type", "n")
    groups.select(key_line).write.text(f"{out}/keys")
    jobs.ingest_and_answer(
        spark, f"{out}/rows", f"{out}/sketch", f"{out}/keys", f"{out}/answers", PARAMS,
        {"key_cols": [1, 3], "value_cols": [4]},
        {"key_fields": 2, "quoted": True, "min_group_size": MIN_PAIR_SIZE,
         "combine": "median", "spaced": True},
    )
    return spark.read.text(f"{out}/answers").select(F.col("value").alias("line"))


# --- output and accuracy -------------------------------------------------------------------


@_query("format_estimates")
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    estimates = query_keys(_sketch(spark, sf_dir), _supplier_keys(spark, sf_dir), combine="min")
    return format_estimates(estimates)


@_query("format_array")
def array_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = _table(spark, sf_dir, "lineitem")
    sums = exact_gsum_of(lineitem, ["l_suppkey"], ["l_partkey"])
    numbers = F.array(*[F.col(m).cast("double") for m in METRICS])
    return sums.select("key", format_array(numbers).alias("line"))


def _exact_and_estimated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    exact = exact_gsum(_items(spark, sf_dir), counted=True)
    return exact, key_estimates(_sketch(spark, sf_dir))


@_query("errors_by_key")
def errors_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = key_errors(*_exact_and_estimated(spark, sf_dir))
    return errors.select("key", *[F.round(f"err_{m}", 4).alias(f"err_{m}") for m in METRICS])


@_query("grid_row_errors")
def errors_of_grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of every grid row's own answer for the row count of a key."""
    assigned = propagate(_sketch(spark, sf_dir).hh, PARAMS)
    per_row = cell_gsum(assigned, ["l1"]).groupBy("key").agg(
        *[F.max(F.when(F.col("d") == d, F.col("l1"))).alias(f"_{d}") for d in range(PARAMS.d)]
    )
    answers = F.array(*[F.coalesce(f"_{d}", F.lit(0)) for d in range(PARAMS.d)])
    exact = exact_gsum(_items(spark, sf_dir), ["l1"], counted=True)
    errors = exact.join(per_row, "key", "left").select(
        "key", relative_errors_pct(F.col("l1"), answers).alias("errors")
    )
    each = [F.round(F.get("errors", F.lit(d)), 4).alias(f"err{d}") for d in range(PARAMS.d)]
    return errors.select("key", *each)


def _cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_estimates(_table(spark, sf_dir, "lineitem"), CUBE_DIMS, ["l_partkey"], CUBE_PARAMS)


@_query("cube_estimates")
def estimates_of_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of dimensions from the sketches of the finest groups."""
    return _tidy(_cube(spark, sf_dir))


@_query("cube_errors")
def errors_of_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far they are from the exact sums."""
    exact = exact_gsum_cube(_table(spark, sf_dir, "lineitem"), CUBE_DIMS, ["l_partkey"])
    report = cube_errors(exact, _cube(spark, sf_dir), CUBE_DIMS)
    errors = [F.round(c, ENTROPY_DIGITS).alias(c) for c in ("mean_err", "max_err")]
    return report.select("grouping_id", "metric", "n_groups", *errors)


@_query("accuracy_report")
def report_of_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = accuracy_report(*_exact_and_estimated(spark, sf_dir))
    errors = [c for c in report.columns if c.endswith("_err")]
    return report.select("metric", "n_keys", *[F.round(c, 4).alias(c) for c in errors])


@_query("sketch_bounded")
def sketch_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed number of items per cell layer and limits for the rest: the answers of a sketch that was
    never merged are those of the exact counts at any scale."""
    sketch = _sketch(spark, sf_dir, mode="bounded")
    return _tidy(query_keys(sketch, _supplier_keys(spark, sf_dir)))


# --- streams -----------------------------------------------------------------------------


def _utc(ts: str) -> Column:
    """A timestamp without zone read as UTC, whatever the session's zone."""
    here = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(ts))
    return here.cast("timestamp")


@_query("stream_window_gsum")
def stream_window_gsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the event stream that the watermark has closed; rows may be a day late."""
    schema = _table(spark, sf_dir, "events").schema
    events = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
        .select(_utc("ts").alias("ts"), "user_id", "event_type")
    )
    rows = events.select(
        "ts", F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value")
    )
    out = new_path(spark, "windows")
    query = (
        window_gsum(rows, "ts", "1 day", f"{DELAY_DAYS} days")
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{out}/table")
        .option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    closed = spark.read.parquet(f"{out}/table")
    return _tidy(
        closed.select(F.unix_seconds("window_start").alias("window_start"), "key", *METRICS)
    )


@_query("batch_window_gsum")
def batch_window_gsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sums from the table itself: every day, also those a stream still holds open."""
    rows = _table(spark, sf_dir, "events").select(
        _utc("ts").alias("ts"), F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value")
    )
    sums = window_gsum(rows, "ts", "1 day", f"{DELAY_DAYS} days")
    return _tidy(sums.select(F.unix_seconds("window_start").alias("window_start"), "key", *METRICS))


def _event_rows(events: DataFrame) -> DataFrame:
    return events.select(
        _utc("ts").alias("ts"), F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value")
    )


@_query("batch_sliding_gsum")
def batch_sliding_gsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week's sums for every day, from shared panes of a day."""
    rows = _event_rows(_table(spark, sf_dir, "events"))
    sums = sliding_gsum(rows, "ts", f"{SLIDING_DAYS} days", "1 day", f"{DELAY_DAYS} days")
    return _tidy(sums.select(F.unix_seconds("window_start").alias("window_start"), "key", *METRICS))


@_query("merged_bounds")
def merged_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bounded sketches merged: limits between which the exact answers of every supplier lie."""
    bounds = key_bounds(_merged_bounded(spark, sf_dir), _supplier_keys(spark, sf_dir))
    names = [c for c in bounds.columns if c != "key"]
    return bounds.select("key", *[F.round(c, ENTROPY_DIGITS).alias(c) for c in names])


@_query("bounds_hold")
def bounds_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the exact sums of every key lie between the limits of a sketch that was cut and merged."""
    exact = exact_gsum(_items(spark, sf_dir), counted=True)
    bounds = key_bounds(_merged_bounded(spark, sf_dir), exact.select("key"))
    slack = F.lit(1e-6)  # of sums in floating point
    inside = [
        F.col(m).between(F.col(f"{m}_low") * (1 - slack) - slack, F.col(f"{m}_high") * (1 + slack) + slack)
        for m in METRICS
    ]
    return exact.join(bounds, "key").select("key", *[c.alias(f"{m}_inside") for c, m in zip(inside, METRICS)])


def _merged_bounded(spark: SparkSession, sf_dir: str) -> Sketch:
    parts = [build_sketch(h, PARAMS, "bounded", BOUNDED_ITEMS) for h in _halves(spark, sf_dir)]
    return merge_sketches(*parts)


@_query("stream_sketch_merge")
def stream_sketch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream in two micro-batches, merged into one stored sketch: its counters."""
    return _streamed_sketch(spark, sf_dir).counters


@_query("stream_sketch_answers")
def stream_sketch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stream, with the counted items kept: the answers are those of one sketch of
    everything."""
    return _tidy(key_estimates(_streamed_sketch(spark, sf_dir, keep_items=True)))


@_query("stream_sketch_log")
def stream_sketch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream in seven micro-batches, so that segments of several levels are merged: the answers
    are those of one sketch of everything."""
    sketch = _streamed_sketch(spark, sf_dir, batches=7, keep_items=True, with_counters=False, fan=2)
    return _tidy(key_estimates(sketch))


def _streamed_sketch(spark: SparkSession, sf_dir: str, batches: int = 2, **options) -> Sketch:
    out = new_path(spark, "stream-sketch")
    events = _table(spark, sf_dir, "events").select("user_id", "event_type", "props")
    events.repartition(batches).write.parquet(f"{out}/input")
    stream = (
        spark.readStream.schema(events.schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{out}/input")
    )
    rows = to_items(stream, ["user_id"], ["event_type", "props"])
    query = (
        rows.writeStream.foreachBatch(sketch_updater(f"{out}/sketch", PARAMS, **options))
        .option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return latest_sketch(spark, f"{out}/sketch")
