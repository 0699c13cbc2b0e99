"""What a cut leaves open: frequent items of fixed number per cell layer, with bounds for the rest.

A cell layer keeps its ``k_kept`` heaviest items. Beside them stand, per cell layer, the mass that
came in and two numbers: no kept item's count is short by more than ``short``, and no item that is
not kept occurs more often than ``cut``. Both add up when sketches are merged, so they hold
however often a sketch was cut. A cut that leaves m items drops none heavier than the mass in it
divided by m + 1, so after h merges in a row ``cut`` is at most (h + 1) times that.

All of it is aggregations, cut rankings and joins, which spill; nothing is held in a task's heap.
Frequencies must not be negative.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import assign_cells, place_items

CELL_LAYER = ["d", "w", "layer"]
# A bounded sketch tracks so many times the items it is asked for.
TRACKED = 4
_LN2 = 0.6931471805599453
BOUNDED_METRICS = ("entropy", "l2", "l1", "card")


def layer_totals(items: DataFrame, params) -> DataFrame:
    """(d, w, layer, total_count): mass per cell layer, at most d*w*levels rows from a task."""
    placed = place_items(items.select("key", "value", "f"), params)
    return placed.groupBy(*CELL_LAYER).agg(F.sum("f").alias("total_count"))


def first_cuts(totals: DataFrame, dropped: DataFrame) -> DataFrame:
    """cuts(d, w, layer, total_count, short, cut) of a sketch of counted items: what is kept is
    exact, what is not is at most as heavy as the heaviest of ``dropped(d, w, layer, most)``."""
    joined = totals.join(dropped, CELL_LAYER, "left")
    none = F.lit(0).cast("bigint")
    return joined.select(*CELL_LAYER, "total_count", none.alias("short"), F.coalesce("most", none).alias("cut"))


def merge_cuts(tables: list[DataFrame], dropped: DataFrame) -> DataFrame:
    """cuts of merged sketches of which ``dropped(d, w, layer, most)`` was cut once more."""
    union = reduce(DataFrame.unionByName, tables)
    summed = union.groupBy(*CELL_LAYER).agg(
        F.sum("total_count").alias("total_count"), F.sum("cut").alias("short")
    )
    joined = summed.join(dropped, CELL_LAYER, "left")
    most = F.coalesce("most", F.lit(0).cast("bigint"))
    return joined.select(*CELL_LAYER, "total_count", "short", (F.col("short") + most).alias("cut"))


def _exact(f):
    """The metrics of one item with frequency ``f``."""
    return {"entropy": f * F.log2(f), "l2": f * f, "l1": f, "card": F.lit(1.0)}


def _open(missing, short, cut, heaviest) -> dict:
    """What ``missing`` mass can add to a key's metrics in a cell layer: as items that are not kept,
    at most ``cut`` heavy, or on top of kept ones, each by at most ``short``. Per unit of mass an
    item of f adds f to l2 and log2 f to entropy; on top of h, the slope of g beyond h counts."""
    on_kept = (short > 0) & heaviest.isNotNull()
    top = F.coalesce(heaviest, F.lit(0.0)) + short
    return {
        "entropy": missing * F.greatest(F.log2(F.greatest(cut, F.lit(1.0))), F.when(on_kept, F.log2(top) + 1 / _LN2)),
        "l2": missing * F.greatest(cut, F.when(on_kept, 2 * top)),
        "l1": missing,
        "card": missing,
    }


def key_bounds(sketch, keys: DataFrame) -> DataFrame:
    """``keys`` with ``<metric>_low`` and ``<metric>_high`` (double) for entropy, l2, l1 and card: the exact
    sums lie between them, whatever the sketch dropped. A key that it does not know gets 0 below.

    Every grid row gives bounds of its own, from the key's kept items and the mass its cell is
    missing; the tightest count. The sketch needs ``cuts``.
    """
    if sketch.cuts is None:
        raise ValueError("the sketch was built without bounds")
    names = BOUNDED_METRICS
    held = sketch.hh.groupBy(*CELL_LAYER).agg(F.sum("cnt").alias("held"))
    missing = (F.col("total_count") - F.coalesce("held", F.lit(0).cast("bigint"))).cast("double")
    slack = sketch.cuts.join(held, CELL_LAYER, "left").select(
        *CELL_LAYER, missing.alias("_missing"), F.col("short").cast("double"), F.col("cut").cast("double")
    )
    f = F.col("cnt").cast("double")
    kept = sketch.hh.groupBy("key", *CELL_LAYER).agg(
        *[F.sum(g).alias(f"_{m}") for m, g in _exact(f).items()], F.max(f).alias("_heaviest")
    )
    wanted = assign_cells(keys.select("key").distinct(), sketch.params).select("key", "d", "w")
    layers = wanted.join(slack, ["d", "w"]).join(kept, ["key", *CELL_LAYER], "left")
    more = _open(F.col("_missing"), F.col("short"), F.col("cut"), F.col("_heaviest"))
    low = {m: F.coalesce(f"_{m}", F.lit(0.0)) for m in names}
    rows = layers.groupBy("key", "d").agg(
        *[F.sum(low[m]).alias(f"{m}_low") for m in names],
        *[F.sum(low[m] + more[m]).alias(f"{m}_high") for m in names],
    )
    best = rows.groupBy("key").agg(
        *[F.max(f"{m}_low").alias(f"{m}_low") for m in names],
        # a grid row without anything in the key's cell has nothing of the key
        *[
            F.when(F.count(F.lit(1)) == sketch.params.d, F.min(f"{m}_high")).otherwise(0.0).alias(f"{m}_high")
            for m in names
        ],
    )
    sides = [f"{m}_{side}" for m in names for side in ("low", "high")]
    return keys.join(best, "key", "left").select(*keys.columns, *[F.coalesce(s, F.lit(0.0)).alias(s) for s in sides])
