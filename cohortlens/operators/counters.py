"""Count-Sketch counters as a table: build, estimate, merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import median_of
from ..params import SketchParams
from .cells import assign_cells, counter_addresses
from .items import row_weight

ADDRESS = ["d", "w", "layer", "r", "pos"]


def _packed(params: SketchParams, r: Column, pos: Column) -> Column:
    """The counter address as one number: one grouping and join key instead of five."""
    out = F.col("d").cast("bigint")
    for size, part in (
        (params.w, F.col("w")),
        (params.levels, F.col("layer")),
        (params.rows, r),
        (params.cols, pos),
    ):
        out = out * F.lit(size) + part
    return out


def _unpacked(params: SketchParams) -> list[Column]:
    rest, out = F.col("_addr"), []
    for name, size in (
        ("pos", params.cols),
        ("r", params.rows),
        ("layer", params.levels),
        ("w", params.w),
    ):
        out.insert(0, F.pmod(rest, F.lit(size)).cast("int").alias(name))
        rest = F.call_function("div", rest, F.lit(size))
    return [rest.cast("int").alias("d"), *out]


def count_sketch_build(rows: DataFrame, params: SketchParams) -> DataFrame:
    """counters(d, w, layer, r, pos, c): signed sums of the frequencies.

    Counters are linear: raw rows and pre-counted items give the same table. Only occupied
    addresses become rows, at most d*w*levels*rows*cols of them whatever the input.
    """
    weighed = rows.select("key", "value", row_weight(rows).alias("f"))
    placed = assign_cells(counter_addresses(weighed, params), params)
    updates = F.array(
        *[
            F.struct(
                _packed(params, F.lit(r), F.col(f"_pos{r}")).alias("_addr"),
                (F.col(f"_sign{r}") * F.col("f")).alias("c"),
            )
            for r in range(params.rows)
        ]
    )
    sums = placed.select(F.inline(updates)).groupBy("_addr").agg(F.sum("c").alias("c"))
    return sums.select(*_unpacked(params), "c")


# Counters of a cell layer are packed in blocks of so many neighbouring addresses.
BLOCK = 20
# The items of layer 0 are dealt to so many parts of their cell, those of every deeper layer, which holds
# half as many, to half as many.
PARTS = 16


def _cell_layer(params: SketchParams) -> Column:
    cell = F.col("d").cast("bigint") * F.lit(params.w) + F.col("w")
    return cell * F.lit(params.levels) + F.col("layer")


def _parts() -> Column:
    return F.greatest(F.call_function("shiftright", F.lit(PARTS), F.col("layer")), F.lit(1))


def packed_counters(counters: DataFrame, params: SketchParams) -> DataFrame:
    """(_cell, layer, _packed): the counters of a cell layer as a map from block to its counters, at most
    rows*cols numbers. Only blocks in use are there."""
    addr = F.col("r") * F.lit(params.cols) + F.col("pos")
    block = F.call_function("div", addr, F.lit(BLOCK)).cast("int").alias("_block")
    at = counters.select(
        _cell_layer(params).alias("_cell"), "layer", block, F.pmod(addr, F.lit(BLOCK)).alias("_at"), "c"
    )
    places = [F.sum(F.when(F.col("_at") == i, F.col("c"))).alias(f"_p{i}") for i in range(BLOCK)]
    blocks = at.groupBy("_cell", "layer", "_block").agg(*places)
    entry = F.struct("_block", F.array(*[f"_p{i}" for i in range(BLOCK)]))
    return blocks.groupBy("_cell", "layer").agg(F.map_from_entries(F.collect_list(entry)).alias("_packed"))


def count_sketch_estimate(
    items: DataFrame, counters: DataFrame, params: SketchParams
) -> DataFrame:
    """Items per grid row with ``cnt``: the median of their signed counters, at least 1.

    The items cross one shuffle, by cell layer, and meet all counters of theirs there, packed. The
    cells of hot keys are dealt to several tasks, most of them in layer 0, which holds half of all
    items; the packed counters are a fixed size that goes to each. What is still skewed is left to Spark's
    skew join.
    """
    rows = range(params.rows)
    part = F.pmod(F.xxhash64("key", "value"), _parts()).cast("int")
    located = assign_cells(counter_addresses(items, params), params).select(
        *items.columns,
        "d", "w", "layer",
        _cell_layer(params).alias("_cell"),
        part.alias("_part"),
        *[(F.lit(r * params.cols) + F.col(f"_pos{r}")).alias(f"_addr{r}") for r in rows],
        sum(F.when(F.col(f"_sign{r}") > 0, 1 << r).otherwise(0) for r in rows).alias("_signs"),
    )
    packed = packed_counters(counters, params)
    each = packed.select("_cell", F.explode(F.sequence(F.lit(0), _parts() - 1)).alias("_part"), "_packed")
    met = located.join(each.hint("shuffle_hash"), ["_cell", "_part"], "left")
    signed = []
    for r in rows:
        sign = F.lit(2) * F.shiftright("_signs", r).bitwiseAND(F.lit(1)) - F.lit(1)
        block = F.call_function("div", F.col(f"_addr{r}"), F.lit(BLOCK)).cast("int")
        counter = F.get(F.element_at("_packed", block), F.pmod(F.col(f"_addr{r}"), F.lit(BLOCK)))
        signed.append(sign * F.coalesce(counter, F.lit(0).cast("bigint")))
    estimate = F.greatest(median_of(F.array(*signed), params.rows), F.lit(1).cast("bigint"))
    return met.select(*items.columns, "d", "w", "layer", estimate.alias("cnt"))


def merge_counters(*tables: DataFrame) -> DataFrame:
    """Counters of all inputs together: the sum per address."""
    union = reduce(DataFrame.unionByName, tables)
    return union.groupBy(*ADDRESS).agg(F.sum("c").alias("c"))
