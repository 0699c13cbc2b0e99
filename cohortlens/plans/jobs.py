"""The three jobs: build a sketch from files, answer a key file from it, or both at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.estimate import query_keys
from ..operators.items import ColumnSpec, count_items_of, to_items
from ..operators.sketch import Sketch, build_sketch
from ..params import SketchParams
from ..session import write_and_read
from ..sources.rows import read_query_keys, read_rows
from ..sources.store import load_sketch, save_sketch, write_estimates

# Where key and value stand in an input line when nothing else is said.
DEFAULT_KEY_FIELDS = [1]
DEFAULT_VALUE_FIELDS = [0, 3, 4, 5]


def ingest(
    spark: SparkSession,
    paths: str | Sequence[str],
    sketch_path: str,
    params: SketchParams,
    key_cols: ColumnSpec = tuple(DEFAULT_KEY_FIELDS),
    value_cols: ColumnSpec = tuple(DEFAULT_VALUE_FIELDS),
    fmt: str = "lines",
    mode: str = "exact_counts",
    min_partitions: int | None = None,
    repeat: int = 1,
) -> Sketch:
    """Build the sketch of the files, save it, and return the saved one. The input is read once:
    its counted items are written, and every table of the sketch comes from them. (``bounded``
    counts raw rows and reads them again.)"""
    table = read_rows(spark, paths, fmt, min_partitions=min_partitions, repeat=repeat)
    items = write_and_read(count_items_of(table, key_cols, value_cols), "items")
    rows = to_items(table, key_cols, value_cols) if mode == "bounded" else items
    save_sketch(build_sketch(rows, params, mode, items=items), sketch_path)
    return load_sketch(spark, sketch_path)


def answer(
    spark: SparkSession,
    sketch: Sketch,
    keys_path: str,
    out_path: str,
    key_fields: int = 1,
    combine: str = "min",
    quoted: bool = False,
    min_group_size: float | None = None,
    min_partitions: int | None = None,
    spaced: bool = False,
    single_file: bool = False,
) -> DataFrame:
    """Answer the keys of a file, write the result lines, and return the answers."""
    keys = read_query_keys(
        spark,
        keys_path,
        key_fields,
        quoted=quoted,
        min_group_size=min_group_size,
        min_partitions=min_partitions,
    )
    estimates = query_keys(sketch, keys, combine=combine)
    write_estimates(estimates, out_path, single_file=single_file, spaced=spaced)
    return estimates


def ingest_and_answer(
    spark: SparkSession,
    paths: str | Sequence[str],
    sketch_path: str,
    keys_path: str,
    out_path: str,
    params: SketchParams,
    ingest_options: dict | None = None,
    answer_options: dict | None = None,
) -> DataFrame:
    """Both in one job; the answers come from the sketch as saved."""
    sketch = ingest(spark, paths, sketch_path, params, **(ingest_options or {}))
    return answer(spark, sketch, keys_path, out_path, **(answer_options or {}))


def answer_saved(spark: SparkSession, sketch_path: str, keys_path: str, out_path: str, **options):
    """Answer the keys of a file from a saved sketch."""
    return answer(spark, load_sketch(spark, sketch_path), keys_path, out_path, **options)
