"""Exact G-sums per group, over everything, or for every combination of dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import MetricSpec, resolve_metrics
from ..functions.text import join_parts
from .items import ColumnSpec, columns_of, count_items, native_columns


def exact_gsum(
    rows: DataFrame, metrics: MetricSpec = None, by_key: bool = True, counted: bool = False
) -> DataFrame:
    """Per key (or over the whole table) the sum of g(f) over the values. ``counted`` says that the
    rows are items already, each pair once, and need no second count.

    Both aggregations combine on the map side: the second one moves at most one row per key
    and task, however large a group is.
    """
    items = rows if counted else count_items(rows)
    groups = ["key"] if by_key else []
    freq = F.col("f")
    return items.groupBy(*groups).agg(
        *[m.total(freq).alias(name) for name, m in resolve_metrics(metrics).items()]
    )


def exact_gsum_of(
    df: DataFrame,
    key_cols: ColumnSpec,
    value_cols: ColumnSpec,
    metrics: MetricSpec = None,
    keep_columns: bool = False,
) -> DataFrame:
    """``exact_gsum`` of the rows of a table, grouped by the columns themselves.

    Numbers are compared as numbers, keys become text once per group, and values never do.
    ``keep_columns`` keeps the key columns beside the key text.
    """
    keys, values = native_columns(df, key_cols, "_k"), native_columns(df, value_cols, "_v")
    groups = [f"_k{i}" for i in range(len(keys))]
    parts = [f"_v{i}" for i in range(len(values))]
    freq = df.select(*keys, *values).groupBy(*groups, *parts).agg(F.count(F.lit(1)).alias("f"))
    sums = [m.total(F.col("f")).alias(name) for name, m in resolve_metrics(metrics).items()]
    per_group = freq.groupBy(*groups).agg(*sums)
    key = join_parts([F.col(g) for g in groups]).alias("key")
    names = df.select(*columns_of(df, key_cols)).columns
    kept = [F.col(g).alias(n) for g, n in zip(groups, names)] if keep_columns else []
    return per_group.select(*kept, key, *resolve_metrics(metrics))


def exact_gsum_cube(
    df: DataFrame, dims: Sequence[str], value_cols: Sequence[str], metrics: MetricSpec = None
) -> DataFrame:
    """Exact G-sums of every subset of the dimensions in one pass.

    ``grouping_id`` has bit i set (last dimension = bit 0) when a dimension is rolled up.
    Frequencies are counted at the finest level first; only these counts are expanded.
    """
    parts = [f"_v{i}" for i in range(len(value_cols))]
    values = native_columns(df, value_cols, "_v")
    finest = df.select(*dims, *values).groupBy(*dims, *parts).agg(F.count(F.lit(1)).alias("f"))
    # A value counted under a coarser grouping must keep its identity: it joins the cube as a
    # dimension, and only the groupings that do not roll it up are built.
    n = len(dims)
    sets = [
        [d for i, d in enumerate(dims) if not (gid >> (n - 1 - i)) & 1] for gid in range(1 << n)
    ]
    freq = finest.groupingSets(
        [[F.col(c) for c in [*s, *parts]] for s in sets],
        *[F.col(c) for c in [*dims, *parts]],
    ).agg(F.grouping_id().alias("_gid"), F.sum("f").alias("f"))
    # the value columns come last and are never rolled up: their bits are the lowest and zero
    freq = freq.withColumn("grouping_id", F.shiftright("_gid", len(parts)).cast("bigint"))
    return freq.groupBy(*dims, "grouping_id").agg(
        *[m.total(F.col("f")).alias(name) for name, m in resolve_metrics(metrics).items()]
    )
