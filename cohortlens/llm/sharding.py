"""Placing rows on shards by a lookup table that shards fill in turns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh, quoted


@dataclass(frozen=True)
class ShardParams:
    """Names of the shards and the size of the table: a prime, well above their number. Balance
    is within a slot a shard; the larger the table, the fewer rows move when shards change."""

    shards: tuple[str, ...] = tuple(f"shard-{i:04d}" for i in range(64))
    size: int = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], size: int) -> list[int]:
    """For every slot the number of its shard. A shard prefers slots in the order of a
    permutation of its own, an offset and a step from its name's hashes; in turns, each claims
    the first slot on its list that is still free."""
    if not _is_prime(size) or not 0 < len(shards) <= size or len(set(shards)) != len(shards):
        raise ValueError("the size must be prime and at least the number of different shards")
    at = [xxhash.xxh64_intdigest(s, 1) % size for s in shards]
    step = [xxhash.xxh64_intdigest(s, 2) % (size - 1) + 1 if size > 2 else 1 for s in shards]
    slots, free = [-1] * size, size
    while free:
        for i in range(len(shards)):
            while slots[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            slots[at[i]] = i
            free -= 1
            if not free:
                break
    return slots


def place(rows: DataFrame, key: str = "doc_id", params: ShardParams = ShardParams()) -> DataFrame:
    """All columns of ``rows`` with ``slot`` and ``shard`` (names lengthened by ``_`` where taken).

    A key hashes to a slot, and the table, ``size`` rows whatever the data, is sent to all
    tasks: no shuffle, whatever the sizes of sources or groups. Equal keys share a shard; null
    keys share one too. Empty tables give no rows. Equal shard lists give equal placements.
    """
    spark = rows.sparkSession
    slot, shard = fresh(rows, "slot", "shard")
    filled = [(n, params.shards[i]) for n, i in enumerate(fill_table(params.shards, params.size))]
    lookup = spark.createDataFrame(filled, f"`{slot}` bigint, `{shard}` string")
    keyed = rows.withColumn(slot, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(params.size)))
    return keyed.join(F.broadcast(lookup), slot).select(*rows.columns, slot, shard)


def write_shards(placed: DataFrame, path: str, shard: str = "shard", files: int = 4, rows: int = 20_000) -> None:
    """One folder for each shard. Its rows are dealt into ``files`` parts, or as many more as make
    parts of about ``rows`` rows, by their own hash, so neither a shard nor a key, null included,
    is bound to one writer; copies of a row go apart by the input partition they come from.
    Adaptive execution may write small parts together."""
    n, dealt = fresh(placed, "n", "dealt")
    hashed = [F.col(quoted(c)) for c, kind in placed.dtypes if "map<" not in kind and kind != "variant"]
    counts = placed.groupBy(shard).agg(F.greatest(F.lit(files), F.ceil(F.count(F.lit(1)) / rows)).alias(n))
    salted = placed.withColumn(dealt, F.xxhash64(*hashed, F.spark_partition_id())).join(F.broadcast(counts), shard)
    out = salted.repartition(shard, F.pmod(F.col(dealt), F.col(n)))
    out.select(*[quoted(c) for c in placed.columns]).write.partitionBy(shard).parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all shards; ``schema`` is that of the rows written."""
    return spark.read.schema(schema).parquet(path)
