"""Groups of documents whose sets of word n-grams are similar, by a prefix-filtering join.

The n-grams of a set are put in one global order, the rare ones first. Two similar sets share an
n-gram among the first few of each, so only these prefixes are joined. What meets there has to
pass the length, the positional and the suffix filter before whole sets are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_and_read
from .common import same_row, small_batches, text_hash
from .components import components
from .quality import word_hashes


@dataclass(frozen=True)
class JaccardParams:
    """Sets of ``shingle``-word n-grams are linked from a Jaccard similarity of ``percent`` on.

    ``counters`` hashed counts of all n-grams tell rare from frequent ones; they only decide how
    much the filters leave to do, never the result. The suffix filter splits a set in ``parts``.
    Sets that share an n-gram meet in cells of about ``cells`` sets, round by round; ``salted``
    rows of one n-gram are one task's work in the last one. Up to ``broadcast`` bytes of row names
    are sent to all tasks to fetch their texts, else they meet the texts by a shuffle."""

    shingle: int = 4
    percent: int = 85
    counters: int = 1 << 18
    parts: int = 64
    cells: tuple[int, ...] = (8, 64)
    salted: int = 1000
    broadcast: int = 8 << 20


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingle_hashes(raw: bytes, shingle: int) -> np.ndarray:
    """64-bit hashes of the n-grams in order; fewer words than one are an n-gram of their own."""
    hashes = word_hashes(raw.lower().split())  # bytes: A-Z only, and exactly [\x20\x09-\x0D]
    n = min(shingle, len(hashes))
    if not n:
        return hashes
    last = len(hashes) - n + 1
    out = np.full(last, n, np.uint64)
    for i in range(n):
        out = (out ^ hashes[i : last + i]) * _ODD
        out ^= out >> np.uint64(31)
    out *= _MIX
    return out ^ (out >> np.uint64(29))


def shingle_set(raw: bytes, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(raw, shingle))


def prefix_size(n: int, percent: int) -> int:
    """So many of the first n-grams that a similar set must share one of them."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _counter_of(grams: np.ndarray, params: JaccardParams) -> np.ndarray:
    return (grams % np.uint64(params.counters)).astype(np.int64)


def _counting(params: JaccardParams) -> Callable:
    """At most ``counters`` rows leave a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(params.counters, np.int64)
        for batch in small_batches(batches, "text"):
            grams = [shingle_hashes((t or "").encode(), params.shingle) for t in batch.column("text").to_pylist()]
            total += np.bincount(_counter_of(np.concatenate(grams), params), minlength=params.counters)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["counter", "n"])

    return run


def gram_counts(docs: DataFrame, params: JaccardParams) -> np.ndarray:
    """N-grams per counter, over all documents; ``counters`` numbers, whatever the corpus."""
    rows = docs.select("text").mapInArrow(_counting(params), "counter bigint, n bigint")
    summed = rows.groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(params.counters, np.int64)
    out[summed["counter"]] = summed["n"]
    return out


_SETS = "doc_id bigint, _th bigint, key binary, n int, prefix array<bigint>, parts array<tinyint>, bits array<bigint>"


def _part_sizes(grams: np.ndarray, parts: int) -> np.ndarray:
    """Sizes beyond 127 stay 127: their differences can only get smaller by that."""
    of = (grams >> np.uint64(32)) % np.uint64(parts)
    return np.minimum(np.bincount(of.astype(np.int64), minlength=parts), 127).astype(np.int8)


def _parities(grams: np.ndarray) -> np.ndarray:
    """A set's finest split, in one to two parts an n-gram: a bit for each part, 1 if its size is odd.
    Words of 64 bits; twice as many words fold to half of them by XOR."""
    size = max(64, 1 << max(0, len(grams) - 1).bit_length())
    of = (grams >> np.uint64(32)) % np.uint64(size)
    odd = np.bincount(of.astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _prefixes(params: JaccardParams, counts) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            keys, sizes, prefixes, parts, bits = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                grams = shingle_set((text or "").encode(), params.shingle)
                keys.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                sizes.append(len(grams))
                rare_first = np.argsort(counts.value[_counter_of(grams, params)], kind="stable")
                prefixes.append(grams[rare_first[: prefix_size(len(grams), params.percent)]].view(np.int64))
                parts.append(_part_sizes(grams, params.parts))
                bits.append(_parities(grams))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("_th"),
                    pa.array(keys, pa.binary()),
                    pa.array(sizes, pa.int32()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                    pa.array(parts, pa.list_(pa.int8())),
                    pa.array(bits, pa.list_(pa.int64())),
                ],
                ["doc_id", "_th", "key", "n", "prefix", "parts", "bits"],
            )

    return run


def _whole_sets(params: JaccardParams) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            grams = [
                shingle_set((t or "").encode(), params.shingle).view(np.int64) for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(grams, pa.list_(pa.int64()))], ["id", "grams"]
            )

    return run


def _may_be_similar(params: JaccardParams) -> Column:
    """Length and positional filter for rows x and y that meet at one n-gram.

    The positional filter takes it for the first one the two share. At the first one it is right,
    and a pair that it drops elsewhere is judged there.
    """
    p = params.percent
    both, left = F.col("x.n") + F.col("y.n"), F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    length = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * p
    return length & (left * (100 + p) >= both * p)


def _most_apart(params: JaccardParams) -> Column:
    """So many n-grams at most are in one only of two similar sets x and y."""
    p, both = params.percent, F.col("x.n") + F.col("y.n")
    return both - F.lit(2) * F.ceil(both * p / (100 + p))


def _parts_agree(params: JaccardParams) -> Column:
    """Suffix filter: sets are split at fixed hash values, and the sizes of the parts can't differ by more in
    all than similar sets do."""
    apart = F.aggregate(
        F.zip_with("x.parts", "y.parts", lambda a, b: F.abs(a.cast("int") - b.cast("int"))), F.lit(0), lambda s, d: s + d
    )
    return apart <= _most_apart(params)


def _parities_agree(params: JaccardParams) -> Column:
    """Suffix filter on the finest split: a part whose sizes are odd and even has an n-gram of one set only."""

    def folded(bits: str, words: Column) -> Column:
        half = F.shiftright(F.size(bits), 1)
        two = F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(bits) > words, two).otherwise(F.col(bits))

    words = F.least(F.size("x.bits"), F.size("y.bits"))
    flips = F.zip_with(folded("x.bits", words), folded("y.bits", words), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    apart = F.aggregate(flips, F.lit(0), lambda s, d: s + d)
    return F.coalesce(apart <= _most_apart(params), F.lit(True))  # null: more than twice as many words


def _pairs(x: DataFrame, y: DataFrame, on: list[str], one: DataFrame, params: JaccardParams) -> DataFrame:
    """Different pairs (u, v), u below v, that meet on ``on``, belong to different groups so far, and
    pass the filters. Where the rows have parts, the suffix filter is part of the join; elsewhere it
    follows, on what the others let through."""
    rule = (F.col("x.id") != F.col("y.id")) & (F.col("x.group") != F.col("y.group")) & _may_be_similar(params)
    for c in on:
        rule = (F.col(f"x.{c}") == F.col(f"y.{c}")) & rule
    if "parts" in x.columns:
        rule = rule & _parts_agree(params)
    met = x.alias("x").join(y.alias("y"), rule)
    pairs = met.select(F.least("x.id", "y.id").alias("u"), F.greatest("x.id", "y.id").alias("v")).distinct()
    if "parts" in x.columns:
        return pairs
    sizes = one.select("id", "n", "parts")
    a, b = sizes.alias("x"), sizes.alias("y")
    both = pairs.join(a, F.col("u") == F.col("x.id")).join(b, F.col("v") == F.col("y.id"))
    return both.where(_parts_agree(params)).select("u", "v")


def _verified(pairs: DataFrame, one: DataFrame, docs: DataFrame, params: JaccardParams) -> DataFrame:
    """The pairs whose whole sets are similar. The finest split of their sets is compared first. The sets of what
    is left are made anew from the texts, so that no table of all sets is needed."""
    split = one.select("id", "n", "bits")
    x, y = split.alias("x"), split.alias("y")
    both = pairs.join(x, F.col("u") == F.col("x.id")).join(y, F.col("v") == F.col("y.id"))
    near = write_and_read(both.where(_parities_agree(params)).select("u", "v"), "near")
    ends = near.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    wanted = write_and_read(one.join(ends, "id", "left_semi").select("id", "lead.doc_id", "lead._th"), "wanted")
    few = 24 * wanted.count() <= params.broadcast  # three numbers a row: else the texts are shuffled
    texts = docs.join(F.broadcast(wanted) if few else wanted, same_row(docs, wanted)).select("id", "text")
    whole = texts.dropDuplicates(["id"]).mapInArrow(_whole_sets(params), "id bigint, grams array<bigint>")
    whole = write_and_read(whole, "whole")
    a = whole.select(F.col("id").alias("u"), F.col("grams").alias("a"))
    b = whole.select(F.col("id").alias("v"), F.col("grams").alias("b"))
    fetched = near.join(a, "u").join(b, "v")
    shared = F.size(F.array_intersect("a", "b"))
    similar = shared * (100 + params.percent) >= (F.size("a") + F.size("b")) * params.percent
    return fetched.where(similar).select("u", "v")


def _grouped(members: DataFrame, links: DataFrame | None) -> DataFrame:
    """Members with ``group``, the smallest id they are linked to so far."""
    if links is None:
        return members.withColumn("group", F.col("id"))
    named = components(links).select(F.col("node").alias("id"), F.col("root").alias("group"))
    return members.join(named, "id", "left").withColumn("group", F.coalesce("group", "id"))


def _hubs(members: DataFrame) -> DataFrame:
    """Per n-gram the set that has the fewest rarer ones: of near copies the one in their middle."""
    first = F.min(F.struct("pos", "id", "n", "group")).alias("hub")
    return write_and_read(members.groupBy("gram").agg(first).select("gram", "hub.*"), "hubs")


def _rest(members: DataFrame, one: DataFrame, params: JaccardParams) -> tuple[DataFrame, DataFrame]:
    """Per n-gram, those outside its largest group, and all, dealt to salts by how many they are."""
    sizes = members.groupBy("gram", "group").agg(F.count(F.lit(1)).alias("size"))
    most = sizes.groupBy("gram").agg(F.max(F.struct("size", "group")).alias("most"), F.count(F.lit(1)).alias("groups"))
    open_grams = write_and_read(
        most.where("groups > 1").select("gram", F.col("most.group").alias("main")), "open"
    )
    salts = F.ceil(F.col("m") / params.salted).cast("int")
    active = members.join(open_grams, "gram").join(one.select("id", "parts"), "id")
    every = active.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int"))
    others = active.where(F.col("group") != F.col("main"))
    return others.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))), every


def similar_sets(one: DataFrame, docs: DataFrame, params: JaccardParams) -> DataFrame | None:
    """links(u, v) between ids of the different sets ``one`` that connect what linking all similar sets would
    connect; None where no pair passes the filters.

    Each n-gram's sets meet one of them first, and what turns out similar is joined into groups.
    In later rounds only sets of different groups meet: in random cells, small and then larger, and
    in the last round all that are outside the largest group of their n-gram meet all others. So
    every similar pair is either compared or already connected, and a large group of near copies
    costs a few comparisons per copy instead of one per pair. No pair is compared twice.
    """
    rows = write_and_read(one.select("id", F.posexplode("prefix").alias("pos", "gram")), "prefixes")
    often = write_and_read(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "often")
    members = write_and_read(rows.join(often, "gram").join(one.select("id", "n"), "id"), "members")
    links = tried = None
    for size in (2, *params.cells, None):
        now = _grouped(members, links)
        if size is None:
            now = write_and_read(now, "grouped")
            pairs = _pairs(*_rest(now, one, params), ["gram", "salt"], one, params)
        elif size == 2:
            pairs = _pairs(now, _hubs(now), ["gram"], one, params)
        else:
            # cells of a power of two in number, by one hash: sets meet in the same cell at every n-gram
            cells = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("m") / size, F.lit(1.0))))).cast("bigint")
            celled = now.withColumn("cell", F.pmod(F.xxhash64("id"), cells))
            now = write_and_read(celled.join(one.select("id", "parts"), "id"), "grouped")
            pairs = _pairs(now, now, ["gram", "cell"], one, params)
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = write_and_read(pairs, "pairs")
        if not pairs.isEmpty():
            found = write_and_read(_verified(pairs, one, docs, params), "links")
            links = found if links is None else links.union(found)
            tried = pairs if tried is None else tried.union(pairs)
        if size is not None:
            members = members.where(F.col("m") > size)  # smaller ones have met completely
            if members.isEmpty():
                break
    return links


def jaccard_groups(documents: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """(doc_id, n_shingles, component_id): the size of every document's set, and the smallest doc_id
    that links lead to, its own included.

    Null text and text without words have the empty set and are linked with nothing. Texts of fewer
    words than an n-gram are one n-gram. Equal sets are one set, so copies and repeated rows cost
    one comparison. A row without id gets its group's id; a group of such rows only has none.
    Long texts are read whole, one at a time. Empty tables give no rows. Other columns are not
    looked at. N-grams are compared by 64-bit, whole sets by 128-bit hashes.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", text_hash().alias("_th"))
    counts = docs.sparkSession.sparkContext.broadcast(gram_counts(docs, params))
    sets = write_and_read(docs.mapInArrow(_prefixes(params, counts), _SETS), "sets")
    firsts = [F.first(c).alias(c) for c in ("n", "prefix", "parts", "bits")]
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th")).alias("lead")
    once = sets.where("n > 0").groupBy("key").agg(*firsts, lead)
    # numbered when it is written: what is read back has one number for good
    one = write_and_read(once.withColumn("id", F.monotonically_increasing_id()), "sets-once")
    leads = one.select("key", "id", F.col("lead.doc_id").alias("lead"))
    rooted = _grouped(leads, similar_sets(one, docs, params)).withColumnRenamed("group", "root")
    rooted = write_and_read(rooted, "rooted")
    least = write_and_read(rooted.groupBy("root").agg(F.min("lead").alias("component_id")), "least")
    named = write_and_read(rooted.join(least, "root").select("key", "component_id"), "named")
    empty = F.col("n") == 0
    return sets.join(named, "key", "left").select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
