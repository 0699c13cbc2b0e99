"""Removal of long repeated byte strings, by sorting sampled suffixes.

Where a suffix is sampled depends on nothing but the bytes around it, so equal strings are
sampled alike. Only suffixes that share their first bytes with another one are ever compared;
they are sorted deep-shallow: multikey quicksort down to a shallow depth, blind tries below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_and_read
from .common import same_row, small_batches, texts


@dataclass(frozen=True)
class SuffixParams:
    """Strings of ``length`` bytes are looked for; a sampled suffix is known by its first ``head``
    bytes; quicksort goes ``shallow`` bytes deep. Groups of more than ``group`` different
    surroundings are not sorted in one task but counted window by window."""

    length: int = 400
    head: int = 128
    shallow: int = 16
    group: int = 1000


# --- sampling -------------------------------------------------------------------------------

_CHUNK = 1 << 20  # bytes hashed at a time; positions must fit in 20 bits
_ODD = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def _tables() -> list[tuple[np.ndarray, int, int]]:
    rng = np.random.default_rng(400)
    return [(rng.integers(0, 1 << 64, 256, np.uint64), o, pow(o, -1, 1 << 64)) for o in _ODD]


_TABLES = _tables()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class _Sums:
    """Sums of b[i] * x^i modulo 2^64, from which any stretch can be hashed."""

    powers: dict[int, np.ndarray] = {}

    def __init__(self, data: np.ndarray, which: int) -> None:
        table, x, inverse = _TABLES[which]
        for base in (x, inverse):
            if len(self.powers.get(base, ())) < len(data) + 1:
                factors = np.full(len(data) + 1, base, np.uint64)
                factors[0] = 1
                self.powers[base] = np.cumprod(factors)
        self.back = self.powers[inverse]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * self.powers[x][: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])


def _least(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours: running minima of blocks from both sides."""
    n = len(keys) - w + 1
    padded = np.full(-(-len(keys) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def samples(raw: bytes, params: SuffixParams) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (at, least, most, head, around) of the suffixes sampled from a text.

    Every string of ``length`` bytes belongs to the suffix inside it whose first ``head`` bytes
    hash lowest, the leftmost of equals. The suffix at ``at`` has the strings that start from
    ``at - most`` to ``at - least``; ``head`` hashes its first bytes, ``around`` all the bytes
    of its strings and its place among them. Texts beyond a chunk are taken in chunks that
    overlap by a string less one byte, so each string is in one chunk.
    """
    data = np.frombuffer(raw, np.uint8)
    w = params.length - params.head + 1
    step = _CHUNK - params.length + 1
    for begin in range(0, max(len(data) - params.length + 1, 0), step):
        part = data[begin : begin + _CHUNK]
        sums, other = _Sums(part, 0), _Sums(part, 1)
        places = np.arange(len(part) - params.head + 1)
        heads = sums.of(places, places + params.head)
        low = np.uint64(_CHUNK - 1)
        at = (_least((heads & ~low) | places.astype(np.uint64), w) & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)] - 1
        at = at[first]
        spans = other.of(first, last + params.length)
        shape = (at - first).astype(np.uint64) * np.uint64(_CHUNK) + (last - first).astype(np.uint64)
        yield at + begin, at - last, at - first, heads[at], _mix(spans + _mix(shape * np.uint64(_ODD[0])))


_SAMPLE = "doc_id bigint, _th bigint, at bigint, least int, most int, head bigint, around bigint"


def _sampling(params: SuffixParams) -> Callable:
    names = ["doc_id", "_th", "at", "least", "most", "head", "around"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            found, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for arrays in samples(text.encode(), params):
                    found.append(arrays)
                    rows.append(np.full(len(arrays[0]), i))
            if not found:
                continue
            at, least, most, head, around = (np.concatenate(x) for x in zip(*found))
            row = pa.array(np.concatenate(rows))
            columns = [
                batch.column("doc_id").take(row),
                batch.column("_th").take(row),
                pa.array(at),
                pa.array(least.astype(np.int32)),
                pa.array(most.astype(np.int32)),
                pa.array(head.view(np.int64)),
                pa.array(around.view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


# --- sorting --------------------------------------------------------------------------------


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, given that the first ``start`` bytes agree."""
    end = min(len(a), len(b))
    if a[start:end] == b[start:end]:
        return end
    while end - start > 1:  # the first difference is in [start, end)
        middle = (start + end) // 2
        if a[start:middle] == b[start:middle]:
            start = middle
        else:
            end = middle
    return start


class _Branch:
    """Inner node of a blind trie: strings below agree up to ``depth`` and differ there."""

    __slots__ = ("depth", "below")

    def __init__(self, depth: int) -> None:
        self.depth = depth
        self.below: dict[int, _Branch | list[int]] = {}


def _at(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


def blind_trie_order(strings: Sequence[bytes], members: Sequence[int], depth: int) -> list[int]:
    """``members`` in the order of their strings, which agree in the first ``depth`` bytes.

    A new string goes down by the branching bytes alone, without looking at what is skipped;
    one comparison with the leaf it reaches tells where it leaves the path.
    """
    root: _Branch | list[int] = [members[0]]
    for new in members[1:]:
        s, node = strings[new], root
        while isinstance(node, _Branch):
            node = node.below.get(_at(s, node.depth)) or next(iter(node.below.values()))
        leaf = strings[node[0]]
        split = common(s, leaf, depth)
        if split == len(s) == len(leaf):
            node.append(new)
            continue
        parent, node = None, root
        while isinstance(node, _Branch) and node.depth < split:
            parent, node = node, node.below[_at(s, node.depth)]
        if isinstance(node, _Branch) and node.depth == split:
            node.below[_at(s, split)] = [new]
            continue
        branch = _Branch(split)
        branch.below = {_at(leaf, split): node, _at(s, split): [new]}
        if parent is None:
            root = branch
        else:
            parent.below[_at(s, parent.depth)] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, _Branch):
            stack += [node.below[b] for b in sorted(node.below, reverse=True)]
        else:
            out += node
    return out


def deep_shallow_order(strings: Sequence[bytes], shallow: int) -> list[int]:
    """Numbers of the strings in sorted order: multikey quicksort on single bytes, and blind
    tries for what still agrees after ``shallow`` bytes."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0, False)]
    while stack:
        group, depth, ended = stack.pop()
        if len(group) < 2 or ended:
            out += group
        elif depth >= shallow:
            out += blind_trie_order(strings, group, depth)
        else:
            pivot = _at(strings[group[len(group) // 2]], depth)
            less, equal, more = [], [], []
            for i in group:
                b = _at(strings[i], depth)
                (equal if b == pivot else less if b < pivot else more).append(i)
            stack += [(more, depth, False), (equal, depth + 1, pivot < 0), (less, depth, False)]
    return out


def shared_offsets(
    lefts: Sequence[bytes], rights: Sequence[bytes], params: SuffixParams
) -> list[list[tuple[int, int]]]:
    """Per member of a group with one head, ranges of offsets: strings that start so many bytes
    before the head and are found with another member as well.

    Both sides are sorted. Going down the sorted left sides, every block of members agrees on
    the bytes before the head up to some depth; inside a block, a member's longest match to
    the right is with a neighbour in the order of the right sides.
    """
    need = params.length - params.head
    rank = {m: r for r, m in enumerate(deep_shallow_order(rights, params.shallow))}
    order = deep_shallow_order(lefts, params.shallow)
    agree = [common(lefts[a], lefts[b]) for a, b in zip(order, order[1:])]
    out: list[list[tuple[int, int]]] = [[] for _ in lefts]
    stack = [(0, len(order), -1)]
    while stack:
        begin, end, above = stack.pop()
        if end - begin < 2:
            continue
        depth = min(agree[begin : end - 1])
        if depth > above:
            block = sorted(order[begin:end], key=rank.__getitem__)
            match = [common(rights[a], rights[b]) for a, b in zip(block, block[1:])]
            for i, m in enumerate(block):
                best = max(match[i - 1] if i else -1, match[i] if i < len(match) else -1)
                first = max(above + 1, need - best)
                if first <= depth:
                    out[m].append((first, depth))
        cuts = [i + 1 for i in range(begin, end - 1) if agree[i] == depth]
        edges = [begin, *cuts, end]
        stack += [(a, b, depth) for a, b in zip(edges, edges[1:]) if b - a > 1]
    return out


# --- the job --------------------------------------------------------------------------------

_SURROUNDINGS = "head bigint, around bigint, before binary, after binary"


def _cut_surroundings(params: SuffixParams) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            rows = []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                raw = text.encode()
                for x in wanted:
                    at, body = x["at"], x["at"] + params.head
                    rows.append(
                        (x["head"], x["around"], raw[at - x["most"] : at][::-1], raw[body : at - x["least"] + params.length])
                    )
            yield _batch(rows, [pa.int64(), pa.int64(), pa.binary(), pa.binary()], ["head", "around", "before", "after"])

    return run


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _sorting(params: SuffixParams) -> Callable:
    """Over rows sorted by head: one group is held at a time, at most ``group`` members."""
    types, names = [pa.int64(), pa.int64(), pa.int32(), pa.int32()], ["head", "around", "lo", "hi"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for head, members in groupby(_rows_of(batches), key=lambda r: r[0]):
            group = list(members)
            found = shared_offsets([m[2] for m in group], [m[3] for m in group], params)
            out += [(head, m[1], lo, hi) for m, ranges in zip(group, found) for lo, hi in ranges]
            if len(out) > 50_000:
                yield _batch(out, types, names)
                out = []
        yield _batch(out, types, names)

    return run


def _windows(params: SuffixParams) -> Callable:
    """Every string of a member, by offset and 128-bit hash."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for head, around, before, after in _rows_of(batches):
            # what lies between is the same for all of a head
            side = before[::-1] + after
            for o in range(max(0, params.length - params.head - len(after)), len(before) + 1):
                start = len(before) - o
                text = side[start : start + params.length - params.head]
                out.append((head, around, o, hashlib.blake2b(text, digest_size=16).digest()))
            if len(out) > 50_000:
                yield _batch(out, types, ["head", "around", "lo", "window"])
                out = []
        yield _batch(out, types, ["head", "around", "lo", "window"])

    return run


def _cutting(params: SuffixParams) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            kept, spans = [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw, merged = text.encode(), []
                for start, end in sorted((s["start"], s["end"]) for s in found or ()):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(end, merged[-1][1])
                    else:
                        merged.append([start, end])
                edges = [0, *[x for m in merged for x in m], len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                spans.append([{"start": a, "end": b} for a, b in merged])
            n_bytes = [len(t.encode()) for t in batch.column("text").to_pylist()]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, span)],
                ["doc_id", "n_bytes", "kept", "spans"],
            )

    return run


def repeated_spans(documents: DataFrame, params: SuffixParams = SuffixParams()) -> DataFrame:
    """(doc_id, _th, spans): byte ranges of the strings of ``length`` bytes that start anywhere
    else too, for documents that have any; ranges may overlap.

    Sampled suffixes whose head occurs once are dropped first. Those with equal surroundings
    are one class: if it has two members, all its strings repeat. Classes with one head and
    different surroundings are compared by sorting, a representative each. A head with more
    than ``group`` classes is compared by counting its strings instead, which Spark combines on
    the map side, so no group is ever held whole; equality there is that of a 128-bit hash.
    """
    docs = texts(documents).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    sampled = write_and_read(docs.mapInArrow(_sampling(params), _SAMPLE), "suffixes")
    # What is counted per head is written before it is joined: the join then has a shuffle of its own on
    # either side and can split a head that very many suffixes have.
    often = sampled.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("head")
    met = write_and_read(sampled.join(write_and_read(often, "often"), "head"), "met")
    rep = F.min(F.struct("doc_id", "_th", "at", "least", "most"))
    classes = write_and_read(
        met.groupBy("head", "around").agg(F.count(F.lit(1)).alias("n"), rep.alias("rep")), "classes"
    )
    whole = classes.where("n > 1").select(
        "head", "around", F.array(F.struct(F.col("rep.least").alias("lo"), F.col("rep.most").alias("hi"))).alias("ranges")
    )
    mixed = write_and_read(classes.groupBy("head").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "mixed")
    wanted = (
        classes.join(mixed, "head")
        .groupBy("rep.doc_id", "rep._th")
        .agg(F.collect_list(F.struct("head", "around", "rep.at", "rep.least", "rep.most")).alias("wanted"))
    )
    reps = docs.join(wanted, same_row(docs, wanted)).select("text", "wanted")
    # of repeated rows one is enough
    around = write_and_read(
        reps.mapInArrow(_cut_surroundings(params), _SURROUNDINGS).dropDuplicates(["head", "around"]), "around"
    ).join(mixed, "head")
    few = around.where(F.col("m") <= params.group).drop("m")
    compared = few.repartition("head").sortWithinPartitions("head").mapInArrow(
        _sorting(params), "head bigint, around bigint, lo int, hi int"
    )
    many = around.where(F.col("m") > params.group).drop("m")
    strings = write_and_read(
        many.mapInArrow(_windows(params), "head bigint, around bigint, lo int, window binary"), "strings"
    )
    twice = strings.groupBy("head", "lo", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = write_and_read(twice.select("head", "lo", "window"), "twice")
    counted = strings.join(twice, ["head", "lo", "window"]).select("head", "around", "lo", F.col("lo").alias("hi"))
    ranges = (
        compared.union(counted)
        .groupBy("head", "around")
        .agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))  # at most one for each offset
    )
    found = met.join(whole.union(ranges), ["head", "around"]).select(
        "doc_id",
        "_th",
        F.explode_outer(
            F.transform(
                "ranges",
                lambda r: F.struct(
                    (F.col("at") - r["hi"]).alias("start"), (F.col("at") - r["lo"] + params.length).alias("end")
                ),
            )
        ).alias("span"),
    )
    return found.groupBy("doc_id", "_th").agg(F.collect_set("span").alias("spans"))


def suffix_dedup(documents: DataFrame, params: SuffixParams = SuffixParams()) -> DataFrame:
    """(doc_id, n_bytes, kept, spans): every text as UTF-8 bytes without what repeats, and the
    maximal ranges removed from it.

    Null text is empty text; texts below ``length`` bytes stay whole. Repeated rows are texts of
    their own, so both lose what they share. Null ids are as good as others. Empty tables give
    no rows. Other columns are not looked at.
    """
    docs = texts(documents).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    spans = repeated_spans(documents, params)
    joined = docs.join(spans, same_row(docs, spans), "left").select(docs["doc_id"], docs["text"], "spans")
    return joined.mapInArrow(
        _cutting(params), "doc_id bigint, n_bytes bigint, kept binary, spans array<struct<start:bigint,end:bigint>>"
    )
