"""Where keys and items go: grid cells, layers and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import (
    LANE_BITS,
    Lanes,
    counter_addr,
    counter_lane,
    item_lanes,
    key_grid_columns,
    key_lanes,
    sketch_layer,
)
from ..params import SketchParams
from .items import row_weight


def assign_cells(keys: DataFrame, params: SketchParams) -> DataFrame:
    """Every row once per grid row, with its cell (d, w)."""
    cells = F.array(
        *[
            F.struct(F.lit(d).alias("d"), w.alias("w"))
            for d, w in enumerate(key_grid_columns(params))
        ]
    )
    return key_lanes(params).attach(keys, "key").select(*keys.columns, F.inline(cells))


def _tie_break(lanes: Lanes) -> Column:
    """32 bits of an item's hash, which settle equal counts.

    By key or value the same few keys would win every tie of a cell; by hash the survivors are
    a fair pick among the cell's keys.
    """
    high, low = lanes.lane(0).cast("bigint"), lanes.lane(1).cast("bigint")
    return F.shiftleft(high, LANE_BITS).bitwiseOR(low).alias("_tie")


def with_tie_break(items: DataFrame, params: SketchParams) -> DataFrame:
    """Items with ``_tie``."""
    if "_tie" in items.columns:
        return items
    lanes = item_lanes(params, counters=False)
    return lanes.attach(items, "key", "value").select(*items.columns, _tie_break(lanes))


def with_layer(items: DataFrame, params: SketchParams, tie_break: bool = False) -> DataFrame:
    """Items with the layer their hash picks, and ``_tie`` if asked for."""
    lanes = item_lanes(params, counters=False)
    hashed = lanes.attach(items, "key", "value")
    extra = [_tie_break(lanes)] if tie_break else []
    return hashed.select(*items.columns, sketch_layer(lanes, params).alias("layer"), *extra)


def place_items(items: DataFrame, params: SketchParams, tie_break: bool = False) -> DataFrame:
    """Items with layer, once per grid row with their cell. Hashes are taken before the rows
    multiply."""
    return assign_cells(with_layer(items, params, tie_break), params)


def counter_addresses(items: DataFrame, params: SketchParams) -> DataFrame:
    """Items with layer and, per Count-Sketch row r, columns ``_pos<r>`` and ``_sign<r>``."""
    lanes = item_lanes(params)
    hashed = lanes.attach(items, "key", "value")
    out = [F.col(c) for c in items.columns] + [sketch_layer(lanes, params).alias("layer")]
    for r in range(params.rows):
        pos, sign = counter_addr(lanes.lane(counter_lane(r)), params.cols, params.sign_bit)
        out += [pos.alias(f"_pos{r}"), sign.alias(f"_sign{r}")]
    return hashed.select(*out)


def cell_totals(rows: DataFrame, params: SketchParams) -> DataFrame:
    """cells(d, w, total_count): input rows per cell.

    Reads only the key; at most d*w partial sums leave a task.
    """
    weighed = rows.select("key", row_weight(rows).alias("f"))
    return (
        assign_cells(weighed, params)
        .groupBy("d", "w")
        .agg(F.sum("f").alias("total_count"))
    )
