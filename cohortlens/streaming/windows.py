"""Exact G-sums per event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import MetricSpec, resolve_metrics


def window_gsum(
    rows: DataFrame,
    time_col: str,
    window: str,
    delay: str,
    metrics: MetricSpec = None,
) -> DataFrame:
    """G-sums per window and key of rows(<time_col>, key, value); works on streams and tables.

    Two chained aggregations: frequencies per (window, key, value), then the sums per
    (window, key). On a stream use append mode: a window is emitted once, when the watermark
    has passed it, so that the second step never sees a frequency that still grows. State is
    keyed by item, so a hot key spreads, and the watermark drops what is done.
    """
    freq = (
        rows.withWatermark(time_col, delay)
        .groupBy(F.window(time_col, window).alias("_w"), "key", "value")
        .agg(F.count(F.lit(1)).alias("f"))
    )
    sums = [m.total(F.col("f")).alias(name) for name, m in resolve_metrics(metrics).items()]
    out = freq.groupBy(F.window(F.window_time("_w"), window).alias("_window"), "key").agg(*sums)
    return out.select(
        F.col("_window.start").alias("window_start"),
        F.col("_window.end").alias("window_end"),
        "key",
        *resolve_metrics(metrics),
    )


def sliding_gsum(
    rows: DataFrame,
    time_col: str,
    window: str,
    slide: str,
    delay: str,
    metrics: MetricSpec = None,
) -> DataFrame:
    """G-sums per sliding window and key of rows(<time_col>, key, value); works on streams and tables.

    Windows share panes of one ``slide`` each: a row is counted once, in its pane, and only the
    counted (pane, key, value) are added up for the window / slide windows that hold the pane. The
    window must be a multiple of the slide. On a stream use append mode, as with ``window_gsum``.
    """
    panes = (
        rows.withWatermark(time_col, delay)
        .groupBy(F.window(time_col, slide).alias("_pane"), "key", "value")
        .agg(F.count(F.lit(1)).alias("f"))
    )
    freq = panes.groupBy(F.window(F.window_time("_pane"), window, slide).alias("_window"), "key", "value").agg(
        F.sum("f").alias("f")
    )
    sums = [m.total(F.col("f")).alias(name) for name, m in resolve_metrics(metrics).items()]
    out = freq.groupBy("_window", "key").agg(*sums)
    return out.select(
        F.col("_window.start").alias("window_start"),
        F.col("_window.end").alias("window_end"),
        "key",
        *resolve_metrics(metrics),
    )
