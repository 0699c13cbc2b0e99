"""One sketch for every combination of dimensions: built for the finest groups, merged for the others.

Unlike in a grid sketch, the layer of an item follows from its value alone. A value is then in the
same layer in every group, and the sketch of a coarser group is the sum of the finer ones, layer by
layer, cut again. So the input is counted and cut once, however many combinations are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import LANE_BITS, Lanes, item_layer
from ..functions.metrics import METRICS, MetricSpec, relative_error_pct, resolve_metrics
from ..functions.text import join_parts
from ..params import SketchParams
from .items import native_columns
from .topk import topk_items

_VALUE_SALT = "value"
_TIE = ["_tie", "value"]


def finest_sketch(df: DataFrame, dims: Sequence[str], value_cols: Sequence[str], params: SketchParams) -> DataFrame:
    """(<dims>, layer, value, cnt, _tie): the ``k_kept`` most frequent values of every group and layer."""
    if params.levels > LANE_BITS + 1:
        raise ValueError(f"at most {LANE_BITS + 1} levels: the layer comes from one lane")
    parts = [f"_v{i}" for i in range(len(value_cols))]
    counted = df.select(*dims, *native_columns(df, value_cols, "_v")).groupBy(*dims, *parts)
    items = counted.agg(F.count(F.lit(1)).alias("cnt")).select(
        *dims, join_parts([F.col(p) for p in parts]).alias("value"), "cnt"
    )
    lanes = Lanes(_VALUE_SALT, params.algo, 4)
    tie = F.shiftleft(lanes.lane(0).cast("bigint"), LANE_BITS).bitwiseOR(lanes.lane(1).cast("bigint"))
    placed = lanes.attach(items, "value").select(
        *dims, item_layer(lanes.lane(3), params.levels).alias("layer"), "value", "cnt", tie.alias("_tie")
    )
    return topk_items(placed, [*dims, "layer"], params.k_kept, tie_break=_TIE)


def merged_sketches(finest: DataFrame, dims: Sequence[str], params: SketchParams) -> DataFrame:
    """(grouping_id, <dims>, layer, value, cnt, _tie) for every subset of the dimensions: counts are added
    up over the finest groups, then cut to ``k``. ``grouping_id`` has bit i set (last dimension = bit
    0) when a dimension is rolled up; its column is null then."""
    n, rest = len(dims), ["layer", "value", "_tie"]
    sets = [[d for i, d in enumerate(dims) if not (g >> (n - 1 - i)) & 1] for g in range(1 << n)]
    summed = finest.groupingSets(
        [[F.col(c) for c in [*s, *rest]] for s in sets], *[F.col(c) for c in [*dims, *rest]]
    ).agg(F.grouping_id().alias("_gid"), F.sum("cnt").alias("cnt"))
    # the columns behind the dimensions are never rolled up: their bits are the lowest and zero
    named = summed.withColumn("grouping_id", F.shiftright("_gid", len(rest)).cast("bigint")).drop("_gid")
    return topk_items(named, ["grouping_id", *dims, "layer"], params.k, tie_break=_TIE)


def group_estimates(
    sketches: DataFrame, dims: Sequence[str], params: SketchParams, metrics: MetricSpec = None
) -> DataFrame:
    """(grouping_id, <dims>, metrics): every group's values become candidates in the shallower layers,
    each layer keeps its top ``k``, and a value first kept in layer m counts 2^m g(cnt)."""
    group = ["grouping_id", *dims]
    candidates = sketches.withColumn("m", F.explode(F.sequence(F.lit(0), "layer"))).drop("layer")
    kept = topk_items(candidates, [*group, "m"], params.k, tie_break=_TIE)
    assigned = kept.groupBy(*group, "value").agg(F.min("m").alias("m"), F.max("cnt").alias("cnt"))
    return assigned.groupBy(*group).agg(
        *[
            m.weighted_total(F.col("cnt"), F.col("m")).alias(name)
            for name, m in resolve_metrics(metrics).items()
        ]
    )


def cube_estimates(
    df: DataFrame, dims: Sequence[str], value_cols: Sequence[str], params: SketchParams, metrics: MetricSpec = None
) -> DataFrame:
    """Estimated G-sums of every subset of the dimensions, from one build."""
    finest = finest_sketch(df, dims, value_cols, params)
    return group_estimates(merged_sketches(finest, dims, params), dims, params, metrics)


def cube_errors(
    exact: DataFrame, estimates: DataFrame, dims: Sequence[str], metrics: Sequence[str] = tuple(METRICS)
) -> DataFrame:
    """Per subset of dimensions and metric: number of groups, mean and largest error in percent."""
    group = ["grouping_id", *dims]
    guessed = estimates.select(*[F.col(c).alias(f"_{c}") for c in group], *[F.col(m).alias(f"_est_{m}") for m in metrics])
    same: Column = reduce(Column.__and__, [exact[c].eqNullSafe(guessed[f"_{c}"]) for c in group])
    error = {
        m: relative_error_pct(F.col(m), F.coalesce(F.col(f"_est_{m}").cast("double"), F.lit(0.0))) for m in metrics
    }
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), e.alias("err")) for m, e in error.items()])
    rows = exact.join(guessed, same, "left").select("grouping_id", F.inline(entries))
    return rows.groupBy("grouping_id", "metric").agg(
        F.count(F.lit(1)).alias("n_groups"), F.avg("err").alias("mean_err"), F.max("err").alias("max_err")
    )
