"""The sketch: heavy hitters per cell layer. Build, merge, inspect.

A sketch is a bundle of tables. ``hh(d, w, layer, key, value, cnt)`` is what queries read; it
never exceeds d*w*levels*k_kept rows. ``cuts`` tells what it may be short of.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import SketchParams
from ..session import write_and_read
from .bounded import TRACKED, first_cuts, layer_totals, merge_cuts
from .cells import cell_totals, place_items, with_tie_break
from .counters import count_sketch_build, count_sketch_estimate, merge_counters
from .items import count_items
from .topk import is_large, kth_best_floor, split_crowded, topk_items

CELL_LAYER = ["d", "w", "layer"]
HH_COLUMNS = ["d", "w", "layer", "key", "value", "cnt"]
MODES = ("exact_counts", "count_sketch", "bounded")


@dataclass(frozen=True)
class Sketch:
    params: SketchParams
    hh: DataFrame
    cells: DataFrame
    counters: DataFrame | None = None
    items: DataFrame | None = None
    mode: str = "exact_counts"
    cuts: DataFrame | None = None
    bucketed: bool = False  # hh is stored in buckets of cells

    def materialize(self) -> Sketch:
        """The same sketch read from tables in the session's shared folder, for many queries."""
        counters = self.counters
        return replace(
            self,
            hh=write_and_read(self.hh, "hh"),
            cells=write_and_read(self.cells, "cells"),
            counters=None if counters is None else write_and_read(counters, "counters"),
            items=None if self.items is None else write_and_read(self.items, "items"),
            cuts=None if self.cuts is None else write_and_read(self.cuts, "cuts"),
            bucketed=False,
        )


TIE_BREAK = ["_tie", "key", "value"]
_COUNT_BITS = 31

# Floors are broadcast, 16 bytes for each of at most d*w*levels cell layers, up to this many.
MAX_BROADCAST_CELL_LAYERS = 1_000_000
# A merge adds up so many items in a task; more make more tasks.
ITEMS_PER_TASK = 1_000_000


def top_of_cells(
    ranked: DataFrame, params: SketchParams, k: int, layer: str = "layer"
) -> DataFrame:
    """The ``k`` items of every cell layer with the highest ``cnt``; ties go by hash."""
    keyed = with_tie_break(ranked, params)
    return topk_items(keyed, ["d", "w", layer], k, tie_break=TIE_BREAK).select(*ranked.columns)


def _top_of_many(ranked: DataFrame, params: SketchParams, k: int) -> DataFrame:
    """``top_of_cells`` for a table far larger than the sketch.

    A first pass finds a floor per cell layer, a second one keeps what reaches it; only these
    few rows are sorted and shuffled. Both passes read the same shuffled items. There are never
    more buckets in use than items, and their aggregation spills, so any k takes this path; beyond
    the k that Spark cuts to before a shuffle only cell layers of more than k items do.
    """
    cell = (F.col("d") * F.lit(params.w) + F.col("w")).cast("bigint") * F.lit(
        params.levels
    ) + F.col("layer")
    # Never falls when the rank rises: the count and below it the inverted tie-break. Counts of
    # 2^31 and more, of which there can only be few, all pass.
    score = F.when(
        F.col("cnt") < F.lit(1 << _COUNT_BITS),
        F.shiftleft("cnt", 32).bitwiseOR(F.lit((1 << 32) - 1) - F.col("_tie")),
    ).otherwise(F.lit((1 << 63) - 1))
    keyed = with_tie_break(ranked, params).withColumns({"_cell": cell, "_score": score})
    whole = None
    if is_large(keyed, k):
        whole, keyed = split_crowded(keyed, ["_cell"], k)
    floors = kth_best_floor(keyed, "_cell", k, F.col("_score"), F.col("_tie"))
    if params.d * params.w * params.levels <= MAX_BROADCAST_CELL_LAYERS:
        floors = F.broadcast(floors)
    passing = keyed.join(floors, "_cell", "left").where(
        F.col("_floor").isNull() | (F.col("_score") >= F.col("_floor"))
    )
    top = topk_items(passing, ["_cell"], k, tie_break=TIE_BREAK).select(*HH_COLUMNS)
    return top if whole is None else whole.select(*HH_COLUMNS).unionByName(top)


def _cut(ranked: DataFrame, params: SketchParams, few: bool) -> tuple[DataFrame, DataFrame]:
    """The top of every cell layer, and dropped(d, w, layer, most): the count of the heaviest item that is
    not in it. One more than is kept is ranked, and written, as both tables come from it."""
    k = params.k_kept + 1
    top = top_of_cells(ranked, params, k) if few else _top_of_many(ranked, params, k)
    top = with_tie_break(write_and_read(top.select(*HH_COLUMNS), "top"), params)
    order = [F.col("cnt").desc(), *TIE_BREAK]
    numbered = top.withColumn("_rn", F.row_number().over(Window.partitionBy(*CELL_LAYER).orderBy(*order)))
    hh = numbered.where(F.col("_rn") < k).select(*HH_COLUMNS)
    return hh, numbered.where(F.col("_rn") == k).select(*CELL_LAYER, F.col("cnt").alias("most"))


def build_sketch(
    rows: DataFrame,
    params: SketchParams,
    mode: str = "exact_counts",
    items_tracked: int | None = None,
    items: DataFrame | None = None,
    keep_items: bool = False,
) -> Sketch:
    """Sketch of rows(key, value[, f]). ``items`` are the counted rows, if there already;
    ``keep_items`` keeps them with the sketch, so that it can be merged without loss; what was not
    counted before is then written to the shared folder, once for all its uses.

    exact_counts  count every distinct item, then keep the top of each cell layer
    count_sketch  the same, but rank by and store Count-Sketch estimates. Items and counters
                  are written to the shared folder first, each counted once
    bounded       like exact_counts, but ``items_tracked`` items of each cell layer are kept (by default
                  ``TRACKED`` times ``k``) and what is not is accounted for in ``cuts``: merged or
                  not, ``key_bounds`` tells between which limits the exact answers lie. Answers of a
                  sketch that was never merged are those of exact_counts
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if params.layered and mode != "exact_counts":
        raise ValueError("a layered build needs exact counts")
    counters = cuts = None
    if items is None:
        items = write_and_read(count_items(rows), "items") if keep_items else count_items(rows)
    if mode == "count_sketch":
        items = write_and_read(items, "items")
        counters = write_and_read(count_sketch_build(items, params), "counters")
        ranked = count_sketch_estimate(items, counters, params)
        hh = top_of_cells(ranked.select(*HH_COLUMNS), params, params.k_kept)
    else:
        ranked = place_items(items, params, tie_break=True).withColumnRenamed("f", "cnt")
        if params.layered:
            ranked = ranked.withColumn("layer", F.explode(F.sequence(F.lit(0), "layer")))
        if mode == "exact_counts":
            hh = _top_of_many(ranked, params, params.k_kept)
        else:
            tracked = items_tracked or max(TRACKED * params.k, params.k_kept)
            if tracked < params.k_kept:
                raise ValueError("items_tracked must not be below the number of heavy hitters kept")
            params = replace(params, k_store=tracked)
            hh, dropped = _cut(ranked, params, few=False)
            cuts = first_cuts(layer_totals(items, params), dropped)
    return Sketch(params, hh, cell_totals(items, params), counters, items if keep_items else None, mode, cuts)


def empty_sketch(spark, params: SketchParams) -> Sketch:
    """A sketch of nothing: the identity of merging."""
    return Sketch(
        params,
        spark.createDataFrame([], "d int, w int, layer int, key string, value string, cnt bigint"),
        spark.createDataFrame([], "d int, w int, total_count bigint"),
        spark.createDataFrame([], "d int, w int, layer int, r int, pos int, c bigint"),
    )


def _counted_again(items: DataFrame) -> DataFrame:
    """``count_items`` of items that rarely repeat: nothing is combined before the shuffle, and a task gets
    ``ITEMS_PER_TASK`` of them however many there are."""
    parts = max(-(-items.count() // ITEMS_PER_TASK), items.sparkSession.sparkContext.defaultParallelism)
    return count_items(items.repartition(parts, "key", "value"))


def merge_sketches(*sketches: Sketch) -> Sketch:
    """One sketch of all inputs, in any order: counts are added per item, then cut again.

    Inputs that all carry their items are merged without loss: the items are added up and the
    result is the sketch of everything. Otherwise what an input had already cut is gone, and
    a ``k_store`` above ``k`` keeps more. Counters are kept when all inputs have them, and so are
    cuts: bounded sketches stay bounded, and their bounds hold for the merged one.
    """
    if not sketches:
        raise ValueError("nothing to merge")
    params = sketches[0].params
    if any(s.params != params for s in sketches):
        raise ValueError("only sketches with the same parameters can be merged")
    if all(s.items is not None for s in sketches):
        union = reduce(DataFrame.unionByName, [s.items for s in sketches])
        every = write_and_read(_counted_again(union), "items")
        mode = sketches[0].mode if len({s.mode for s in sketches}) == 1 else "exact_counts"
        merged = build_sketch(every, params, mode, params.k_store, items=every, keep_items=True)
        if mode == "exact_counts" and all(s.counters is not None for s in sketches):
            merged = replace(merged, counters=merge_counters(*[s.counters for s in sketches]))
        return merged
    hh = reduce(DataFrame.unionByName, [s.hh.select(*HH_COLUMNS) for s in sketches])
    summed = hh.groupBy(*CELL_LAYER, "key", "value").agg(F.sum("cnt").alias("cnt"))
    cells = reduce(DataFrame.unionByName, [s.cells for s in sketches])
    counters = None
    if all(s.counters is not None for s in sketches):
        counters = merge_counters(*[s.counters for s in sketches])
    cuts = None
    if all(s.cuts is not None for s in sketches):
        top, dropped = _cut(summed, params, few=True)
        cuts = merge_cuts([s.cuts for s in sketches], dropped)
    else:
        top = top_of_cells(summed, params, params.k_kept)
    return Sketch(
        params,
        top,
        cells.groupBy("d", "w").agg(F.sum("total_count").alias("total_count")),
        counters,
        mode=sketches[0].mode,
        cuts=cuts,
    )


def sketch_stats(sketch: Sketch) -> DataFrame:
    """Per grid row: heavy hitters held, cells in use and rows seen."""
    held = sketch.hh.groupBy("d").agg(F.count(F.lit(1)).alias("heavy_hitters"))
    used = sketch.cells.groupBy("d").agg(
        F.count(F.lit(1)).alias("cells_used"), F.sum("total_count").alias("rows_seen")
    )
    return used.join(held, "d", "left").select(
        "d", F.coalesce("heavy_hitters", F.lit(0)).alias("heavy_hitters"), "cells_used", "rows_seen"
    )


def heavy_hitters(sketch: Sketch, layer: int = 0) -> DataFrame:
    """Heavy hitters of one layer of every cell, largest first."""
    return sketch.hh.where(F.col("layer") == layer).orderBy(
        "d", "w", F.col("cnt").desc(), "key", "value"
    )
