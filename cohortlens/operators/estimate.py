"""Answers from a sketch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import grid_columns, key_lanes
from ..functions.metrics import MetricSpec, combine_rows, resolve_metrics
from ..params import SketchParams
from .cells import assign_cells
from .sketch import Sketch, top_of_cells
from .topk import is_large, split_crowded


def propagate(hh: DataFrame, params: SketchParams, in_place: bool = False) -> DataFrame:
    """assigned(d, w, m, key, value, cnt): every surviving item with its shallowest layer.

    An item of layer l is a candidate in all layers 0..l; each layer keeps its top k. The item
    belongs to the first layer that kept it. A layered sketch already holds its items in every
    layer, so there the candidates are the rows themselves.

    One shuffle by cell serves the ranking, the assignment and the sums that follow; a cell
    holds at most levels*k_kept rows. ``in_place`` says that the rows lie together by cell already.
    Where ``k`` is large, cells of at most k items are not ranked or shuffled: their layer 0 keeps all.
    """
    whole = None
    if is_large(hh, params.k) and not params.layered:
        whole, hh = split_crowded(hh, ["d", "w"], params.k)
    by_cell = hh if in_place else hh.repartition("d", "w")
    if params.layered:
        candidates = by_cell.withColumnRenamed("layer", "m")
    else:
        candidates = by_cell.withColumn("m", F.explode(F.sequence(F.lit(0), "layer"))).drop("layer")
    kept = top_of_cells(candidates, params, params.k, layer="m")
    assigned = kept.groupBy("d", "w", "key", "value").agg(
        F.min("m").alias("m"), F.max("cnt").alias("cnt")
    )
    if whole is None:
        return assigned
    return whole.select("d", "w", "key", "value", F.lit(0).alias("m"), "cnt").unionByName(assigned)


def cell_gsum(assigned: DataFrame, metrics: MetricSpec = None, by: str = "key") -> DataFrame:
    """Sums of 2^m * g(cnt) per key and cell (``by="key"``), per cell (``"cell"``) or per grid
    row, that is over the whole table (``"table"``)."""
    groups = {"key": ["d", "w", "key"], "cell": ["d", "w"], "table": ["d"]}[by]
    return assigned.groupBy(*groups).agg(
        *[
            m.weighted_total(F.col("cnt"), F.col("m")).alias(name)
            for name, m in resolve_metrics(metrics).items()
        ]
    )


def key_estimates(
    sketch: Sketch, metrics: MetricSpec = None, combine: str = "median"
) -> DataFrame:
    """One row per key that the sketch holds: its answers combined over the grid rows.

    A grid row in which no item of the key survived answers 0.
    """
    resolved = resolve_metrics(metrics)
    per_cell = cell_gsum(propagate(sketch.hh, sketch.params, sketch.bucketed), resolved)
    return _over_grid_rows(per_cell, sketch.params, resolved, combine)


def _over_grid_rows(per_cell: DataFrame, params: SketchParams, resolved: dict, combine: str) -> DataFrame:
    rows = range(params.d)
    answers = per_cell.groupBy("key").agg(
        *[
            F.max(F.when(F.col("d") == i, F.col(name))).alias(f"_{name}{i}")
            for name in resolved
            for i in rows
        ]
    )
    return answers.select(
        "key",
        *[
            combine_rows([F.coalesce(F.col(f"_{name}{i}"), m.zero()) for i in rows], combine).alias(name)
            for name, m in resolved.items()
        ],
    )


def _found_in_cells(sketch: Sketch, keys: DataFrame, resolved: dict, combine: str) -> DataFrame:
    """``key_estimates`` of some keys, fetched where their cells are stored: the keys travel to the
    cells, one row per grid row, and the sketch stays where it is. A cell's answers are a map of at
    most levels*k_kept keys."""
    per_cell = cell_gsum(propagate(sketch.hh, sketch.params, in_place=True), resolved)
    entry = F.struct("key", F.struct(*resolved))
    cells = per_cell.groupBy("d", "w").agg(F.map_from_entries(F.collect_list(entry)).alias("_answers"))
    wanted = assign_cells(keys.select("key").distinct(), sketch.params).select("key", "d", "w")
    met = wanted.join(cells, ["d", "w"], "left").withColumn("_own", F.element_at("_answers", F.col("key")))
    found = met.select("key", "d", *[F.col(f"_own.{name}").alias(name) for name in resolved])
    return _over_grid_rows(found, sketch.params, resolved, combine)


def _keep_cells_of(sketch: Sketch, keys: DataFrame) -> Sketch:
    # By cell, never by key: in a cell the other keys compete for the places.
    params = sketch.params
    wanted = assign_cells(keys.select("key").distinct(), params).select("d", "w").distinct()
    hh = sketch.hh.join(wanted, ["d", "w"], "left_semi")
    return Sketch(params, hh, sketch.cells, bucketed=sketch.bucketed)


def query_keys(
    sketch: Sketch,
    keys: DataFrame,
    metrics: MetricSpec = None,
    combine: str = "median",
    distinct: bool = False,
    prune_cells: bool = False,
) -> DataFrame:
    """Answers for a table of keys; a key the sketch does not know gets zeros.

    All columns of ``keys`` are kept, and so are repeated keys unless ``distinct``.
    ``prune_cells`` first drops the cells that no key falls in; worth it for short key lists.
    A sketch stored in buckets is not shuffled: the keys go to its cells. Which side is broadcast is left to Spark, which goes by the sizes it measures.
    """
    resolved = resolve_metrics(metrics)
    if distinct:
        keys = keys.select("key").distinct()
    if prune_cells:
        sketch = _keep_cells_of(sketch, keys)
    if sketch.bucketed:
        answers = _found_in_cells(sketch, keys, resolved, combine)
    else:
        answers = key_estimates(sketch, resolved, combine)
    found = keys.join(answers, "key", "left")
    return found.select(
        *keys.columns, *[F.coalesce(name, m.zero()).alias(name) for name, m in resolved.items()]
    )


def query_key(
    sketch: Sketch, key: str, metrics: MetricSpec = None, combine: str = "min"
) -> DataFrame:
    """Answer for one key. Its cells are constants, so a saved sketch is read only there."""
    params = sketch.params
    in_cells = F.lit(False)
    for d, w in enumerate(grid_columns(key_lanes(params).of(F.lit(key)), params)):
        in_cells = in_cells | ((F.col("d") == d) & (F.col("w") == w))
    pruned = Sketch(params, sketch.hh.where(in_cells), sketch.cells)
    resolved = resolve_metrics(metrics)
    found = key_estimates(pruned, resolved, combine).where(F.col("key") == key)
    # without groups there is one row, also for an unknown key
    return found.agg(*[F.max(name).alias(name) for name in resolved]).select(
        F.lit(key).alias("key"),
        *[F.coalesce(name, m.zero()).alias(name) for name, m in resolved.items()],
    )
