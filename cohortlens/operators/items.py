"""From rows to (key, value) pairs and their frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import join_parts

ColumnSpec = Sequence[str | int | Column]


def columns_of(df: DataFrame, spec: ColumnSpec) -> list[Column]:
    """Names, positions or expressions as columns. Positions count from 0; on a table with one
    array column ``fields`` they pick fields of the line."""
    by_field = df.columns == ["fields"]
    out = []
    for c in spec:
        if isinstance(c, Column):
            out.append(c)
        elif isinstance(c, int):
            out.append(F.get("fields", F.lit(c)) if by_field else F.col(df.columns[c]))
        else:
            out.append(F.col(c))
    if not out:
        raise ValueError("at least one column is needed")
    return out


def to_items(
    df: DataFrame,
    key_cols: ColumnSpec,
    value_cols: ColumnSpec,
    escape: bool = True,
    weight: str | None = None,
) -> DataFrame:
    """(key, value) of every row; several columns are joined by ``|``.

    ``weight`` names a column that says how many rows a row stands for; it becomes ``f``.
    """
    out = [
        join_parts(columns_of(df, key_cols), escape).alias("key"),
        join_parts(columns_of(df, value_cols), escape).alias("value"),
    ]
    if weight is not None:
        out.append(F.col(weight).cast("bigint").alias("f"))
    return df.select(*out)


def row_weight(rows: DataFrame) -> Column:
    """How many input rows a row stands for: its ``f``, or one."""
    return F.col("f") if "f" in rows.columns else F.lit(1).cast("bigint")


def count_items(rows: DataFrame) -> DataFrame:
    """items(key, value, f): frequency of every distinct pair.

    Spark combines repeats on the map side, and the shuffle is by key *and* value, so a key
    that holds a third of all rows is spread like any other. Pairs of weight zero do not occur;
    negative weights, as of rows taken back, count as they are.
    """
    counted = rows.groupBy("key", "value").agg(F.sum(row_weight(rows)).alias("f"))
    return _occurring(counted)


def _occurring(counted: DataFrame) -> DataFrame:
    # Also keeps the shuffles of two uses of the items alike when one of them has no need of f,
    # so that Spark runs the scan and the counting once for both.
    return counted.where(F.col("f") != 0)


# Types whose text is different for different values; others are grouped as text.
_TEXT_IS_UNIQUE = (T.IntegralType, T.BooleanType, T.DateType, T.DecimalType)


def native_columns(df: DataFrame, spec: ColumnSpec, prefix: str) -> list[Column]:
    """Columns to group by before they become text: numbers stay numbers."""
    out = []
    for i, c in enumerate(columns_of(df, spec)):
        dtype = df.select(c).schema[0].dataType
        if not isinstance(dtype, _TEXT_IS_UNIQUE):
            c = join_parts([c])
        out.append(c.alias(f"{prefix}{i}"))
    return out


def count_items_of(df: DataFrame, key_cols: ColumnSpec, value_cols: ColumnSpec) -> DataFrame:
    """``count_items(to_items(df, key_cols, value_cols))``, with the counting done on the
    columns themselves: only distinct items become text."""
    keys, values = native_columns(df, key_cols, "_k"), native_columns(df, value_cols, "_v")
    names = [f"_k{i}" for i in range(len(keys))] + [f"_v{i}" for i in range(len(values))]
    counted = df.select(*keys, *values).groupBy(*names).agg(F.count(F.lit(1)).alias("f"))
    return to_items(_occurring(counted), names[: len(keys)], names[len(keys) :], weight="f")


def repeat_items(items: DataFrame, n: int) -> DataFrame:
    """The items of an input read ``n`` times: every frequency times ``n``."""
    return items.withColumn("f", F.col("f") * F.lit(n).cast("bigint"))


def restrict_to_keys(rows: DataFrame, keys: DataFrame, n: int, order_by: ColumnSpec) -> DataFrame:
    """Rows whose key is among the first ``n`` of ``keys`` (a table with a column ``key``) in
    the given order. Repeats use up places, as in a list of which the first n lines are read."""
    allowed = keys.orderBy(*order_by).limit(n).select(F.col("key").cast("string"))
    return rows.join(allowed, "key", "left_semi")
