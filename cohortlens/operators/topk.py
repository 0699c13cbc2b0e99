"""Top-k per group, safe for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64
# So many groups get their cutoffs, a few bytes each, by broadcast.
MAX_BROADCAST_GROUPS = 1_000_000
_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"


def is_large(df: DataFrame, k: int) -> bool:
    """Whether Spark no longer cuts a ranking to ``k`` before the shuffle."""
    return k > int(df.sparkSession.conf.get(_LIMIT_CONF, "1000"))


def split_crowded(df: DataFrame, groups: Sequence[str], k: int) -> tuple[DataFrame, DataFrame]:
    """The rows of groups that have at most ``k`` rows, of which nothing needs to be ranked, and those of
    the others. For a large ``k``: the names of the others are broadcast, at most one for ``k`` rows."""
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > k)
    crowded = F.broadcast(sizes.select(*[F.col(g).alias(f"_crowded{i}") for i, g in enumerate(groups)]))
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_crowded{i}"))
    return df.join(crowded, same, "left_anti"), df.join(crowded, same, "left_semi")


def _order(count: str, tie_break: Sequence[str]) -> list[Column]:
    return [F.col(count).desc(), *[F.col(c).asc() for c in tie_break]]


def _cut(df: DataFrame, groups: Sequence[str], order: list[Column], k: int) -> DataFrame:
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.where(F.col("_rn") <= k).drop("_rn")


def _salt(cols: Sequence[str], salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(F.lit("salt"), *cols), F.lit(salts)).cast("int")


def topk_items(
    df: DataFrame,
    groups: Sequence[str],
    k: int,
    count: str = "cnt",
    tie_break: Sequence[str] = ("key", "value"),
    ties: bool = False,
    most_groups: int | None = None,
) -> DataFrame:
    """The ``k`` rows of every group with the highest ``count``.

    Equal counts are settled by ``tie_break``, so the result does not depend on row order. With
    ``ties`` all rows that equal the k-th count are kept as well; ``most_groups`` tells it, where that is
    known, how many groups there can be.

    Spark cuts a ranking to k before the shuffle, so a task receives at most k rows per group
    and map task. It does so only up to a configured k; beyond, the cut is made in two steps,
    the first on groups salted to as many parts as the session's shuffles have.
    """
    if ties:
        few = most_groups is not None and most_groups <= MAX_BROADCAST_GROUPS
        return _topk_with_ties(df, list(groups), k, count, list(tie_break), few)
    order = _order(count, tie_break)
    if is_large(df, k):
        salts = max(SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        salted = df.withColumn("_salt", _salt([count, *tie_break], salts))
        df = _cut(salted, [*groups, "_salt"], order, k).drop("_salt")
    return _cut(df, groups, order, k)


def _topk_with_ties(
    df: DataFrame, groups: list[str], k: int, count: str, tie_break: list[str], few_groups: bool
) -> DataFrame:
    # Rows are added up by group and count, so that none of them is sorted; the cutoff is the lowest
    # count that less than k rows of the group exceed. Ranking with ties instead would bring a group
    # of equal counts, however large, into one task. The cutoffs are broadcast, or meet the rows on
    # salted groups for the same reason.
    equal = df.groupBy(*groups, count).agg(F.count(F.lit(1)).alias("_rows"))
    highest = Window.partitionBy(*groups).orderBy(F.col(count).desc())
    above = equal.withColumn("_above", F.sum("_rows").over(highest) - F.col("_rows"))
    cutoff = above.where(F.col("_above") < k).groupBy(*groups).agg(F.min(count).alias("_cutoff"))
    if few_groups:
        met = df.join(F.broadcast(cutoff), groups)
        return met.where(F.col(count) >= F.col("_cutoff")).select(*df.columns)
    cutoff = cutoff.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = df.withColumn("_salt", _salt([count, *tie_break]))
    joined = salted.join(cutoff, [*groups, "_salt"])
    return joined.where(F.col(count) >= F.col("_cutoff")).select(*df.columns)


def buckets_for(k: int) -> int:
    """At least 2k buckets, so that the k-th best of them is close to the k-th best row."""
    return 1 << (2 * k - 1).bit_length()


def kth_best_floor(
    df: DataFrame, group: str, k: int, score: Column, spread: Column
) -> DataFrame:
    """Per ``group`` a ``_floor`` that no row of its top k scores below.

    Rows are dealt into buckets by ``spread``; the k-th largest of the buckets' best scores is
    reached by k different rows, so the k-th best row scores at least that. It takes one
    aggregation with at most 2k..4k buckets per group, and lets little more than k rows pass,
    so the large table need not be sorted. Groups with fewer than k buckets get no floor.
    """
    bucket = F.pmod(spread, F.lit(buckets_for(k)))
    best = df.groupBy(group, bucket.alias("_bucket")).agg(F.max(score).alias("_best"))
    # at most ``buckets`` numbers per group
    ranked = best.groupBy(group).agg(F.sort_array(F.collect_list("_best"), asc=False).alias("_all"))
    return ranked.select(group, F.get("_all", F.lit(k - 1)).alias("_floor")).where(
        F.col("_floor").isNotNull()
    )
