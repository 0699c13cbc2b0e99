"""Input rows and query keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import make_key, split_quoted


_MIN_SPLITS_CONF = "spark.sql.files.minPartitionNum"
_OPEN_COST_CONF = "spark.sql.files.openCostInBytes"
# Text in these codecs is read from its start to its end.
_WHOLE_FILES = (".gz", ".zst", ".lz4", ".snappy", ".deflate", ".xz")


def _session_with(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session like ``spark`` but for some settings; ``spark`` itself stays as it is."""
    own = spark.newSession()
    for name, value in {**spark.conf.getAll, **settings}.items():
        if own.conf.get(name, None) != value:
            own.conf.set(name, value)
    return own


def _reader_session(spark: SparkSession, min_partitions: int | None) -> SparkSession:
    """The session to read with: one that cuts files into at least so many splits where they are read."""
    if min_partitions is None:
        return spark
    # Splits are as large as their share of the input, however small: nothing is added per file.
    return _session_with(spark, {_MIN_SPLITS_CONF: str(min_partitions), _OPEN_COST_CONF: "1"})


def _at_least(df: DataFrame, min_partitions: int | None) -> DataFrame:
    """``df``, a scan by a session that cuts files. Only if they are too few and can't be cut, its rows
    are dealt out anew."""
    if min_partitions is None:
        return df
    found = df.inputFiles()
    whole = len(found) < min_partitions and any(f.endswith(_WHOLE_FILES) for f in found)
    return df.repartition(min_partitions) if whole else df


def read_rows(
    spark: SparkSession,
    paths: str | Sequence[str],
    fmt: str = "lines",
    schema: StructType | str | None = None,
    min_partitions: int | None = None,
    repeat: int = 1,
    **options: str,
) -> DataFrame:
    """Rows of files. ``repeat`` reads every path that many times.

    ``fmt="lines"`` reads comma-separated text without header into one array column ``fields``;
    quotes protect commas and stay in the fields. Any other format is a Spark reader's
    (``csv``, ``parquet``, ``orc``, ``json``, ...), with its options.
    """
    paths = ([paths] if isinstance(paths, str) else list(paths)) * repeat
    spark = _reader_session(spark, min_partitions)
    if fmt == "lines":
        df = spark.read.text(paths).select(split_quoted(F.col("value")).alias("fields"))
    else:
        reader = spark.read.format(fmt).options(**options)
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.load(paths)
    return _at_least(df, min_partitions)


def repeat_rows(df: DataFrame, n: int) -> DataFrame:
    """Every row ``n`` times."""
    copies = F.explode(F.array_repeat(F.lit(0), n)).alias("_copy")
    return df.select(*df.columns, copies).drop("_copy")


def read_query_keys(
    spark: SparkSession,
    path: str,
    key_fields: int = 1,
    quoted: bool = False,
    min_group_size: float | None = None,
    group_size_field: int = 4,
    min_partitions: int | None = None,
) -> DataFrame:
    """keys(key) of a comma-separated key file: the first ``key_fields`` fields of a line.

    ``quoted`` lets quotes protect commas. ``min_group_size`` keeps keys whose group size, given
    in field ``group_size_field``, is at least that.
    """
    lines = _reader_session(spark, min_partitions).read.text(path)
    split = split_quoted(F.col("value")) if quoted else F.split("value", ",", -1)
    fields = lines.select(split.alias("fields"))
    if min_group_size is not None:
        size = F.get("fields", F.lit(group_size_field)).cast("double")
        fields = fields.where(size >= F.lit(float(min_group_size)))
    keys = fields.select(make_key([F.get("fields", F.lit(i)) for i in range(key_fields)]).alias("key"))
    return _at_least(keys, min_partitions)


def query_keys_of(
    df: DataFrame,
    key_cols: Sequence[str],
    group_size: str | None = None,
    min_group_size: float | None = None,
) -> DataFrame:
    """keys(key) of a table, optionally only groups of at least ``min_group_size`` rows."""
    if min_group_size is not None:
        df = df.where(F.col(group_size) >= F.lit(min_group_size))
    return df.select(make_key(list(key_cols)).alias("key"))
