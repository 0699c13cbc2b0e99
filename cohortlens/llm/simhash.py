"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_and_read
from .common import small_batches, text_hash
from .components import components

BITS = 64
SEED = 42
CHUNK = 1 << 16  # shingles whose bits are unpacked at a time


@dataclass(frozen=True)
class SimHashParams:
    """Shingles of ``shingle`` words; fingerprints at ``distance`` (even) or fewer differing bits
    are linked; a fingerprint has ``segments`` segments."""

    shingle: int = 3
    distance: int = 2
    segments: int = 4


def fingerprint(raw: bytes, shingle: int) -> int:
    """64 bits, each 1 if it is set in more than half of the shingles' hashes; 0 without words."""
    words = raw.lower().split()  # on bytes: A-Z only, and exactly [\x20\x09-\x0D]
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    rows = zip(*(words[i : i + n] for i in range(min(shingle, len(words)))))
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, rows), repeat(SEED))
    ones = np.zeros(BITS, np.int64)
    for start in range(0, n, CHUNK):
        some = np.fromiter(hashes, ">u8", min(CHUNK, n - start))
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprinting(shingle: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = [fingerprint((t or "").encode(), shingle) for t in batch.column("text").to_pylist()]
            signed = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), pa.array(signed)],
                ["doc_id", "text_hash", "fp"],
            )

    return run


def ball_masks(params: SimHashParams) -> list[int]:
    """The bit flips that lead from a fingerprint to its table entries, as signed numbers:
    within each segment the balls of small radius, joined where the radius allows flips in
    several segments; at most half the linking distance in all."""
    width, radius = BITS // params.segments, params.distance // 2
    found = {0}
    for segment in range(params.segments):
        inside = {
            sum(1 << (segment * width + b) for b in flips)
            for r in range(radius + 1)
            for flips in combinations(range(width), r)
        }
        found |= {a | b for a in found for b in inside if (a | b).bit_count() <= radius}
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in sorted(found)]


def fingerprint_links(distinct: DataFrame, params: SimHashParams) -> DataFrame:
    """edges(u, v) between different fingerprints of ``distinct(fp)`` that connect exactly what
    linking all pairs at ``distance`` or fewer bits would connect.

    Every fingerprint enters the tables under each word of the small balls around its segments.
    Two fingerprints at distance 2r or less have a word in between, at most r flips from both,
    and meet there. Whoever shares an entry is fetched, and the complete distance to the
    smallest of the entry is verified; all of an entry are within 2r of each other, so linking
    them to one loses nothing and no entry is paired out. An entry cannot hold more than the
    number of words in a ball (65 with the default), whatever the data, as repeated
    fingerprints were merged before.
    """
    masks = F.array(*[F.lit(m).cast("bigint") for m in ball_masks(params)])
    entries = distinct.select("fp", F.explode_outer(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("entry"))
    least = F.min("fp").over(Window.partitionBy("entry"))
    met = entries.select("fp", least.alias("least")).where(F.col("fp") != F.col("least"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= params.distance
    return met.where(close).select(F.col("fp").alias("u"), F.col("least").alias("v"))


def simhash_groups(documents: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """(doc_id, fingerprint, component_id, group, text_hash): ``component_id`` is the smallest
    doc_id reachable over linked fingerprints, ``group`` names the group whatever its ids.

    Null text and text without words have fingerprint zero and are linked like any other. Texts
    shorter than a shingle are one shingle. Repeated rows stay and fall in one group. A row
    without id gets its group's id; a group of such rows only has none. Empty tables give no
    rows. Other columns are not looked at.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", text_hash().alias("text_hash"))
    found = docs.mapInArrow(_fingerprinting(params.shingle), "doc_id bigint, text_hash bigint, fp bigint")
    prints = write_and_read(found, "prints")
    leads = prints.groupBy("fp").agg(F.min("doc_id").alias("lead"))
    linked = components(fingerprint_links(leads.select("fp"), params))
    rooted = leads.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "lead", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("lead").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id", F.col("root").alias("group"))
    return prints.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"),
        "component_id",
        "group",
        "text_hash",
    )
