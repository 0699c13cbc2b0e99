"""Importance resampling towards a target distribution, over hashed runs of words.

An Aho-Corasick automaton holds the frequent distinct words, each between two delimiters, with
the CRC and the length of the word as payload. A scan of a text gives a payload per word; the
CRC of a run of words is put together from the payloads of its words, without its bytes.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_and_read
from .common import UPPER, small_batches

# Letters, digits and everything beyond ASCII belong to words; all else delimits them.
_KEPT = b"abcdefghijklmnopqrstuvwxyz0123456789"
_NORMAL = bytes(
    ord(chr(b).lower()) if chr(b) in UPPER else b if b >= 128 or b in _KEPT else 32 for b in range(256)
)
_BLANK = ord(" ")
_BLANK_CRC = zlib.crc32(b" ")


@dataclass(frozen=True)
class ResampleParams:
    """Features are runs of 1 to ``longest`` words in ``buckets`` buckets. The automaton holds the
    ``dictionary`` most frequent words of at most ``word_bytes`` bytes; all other words get their
    payloads one by one. ``percent`` of the documents of at least ``min_words`` words are drawn,
    with noise that follows from ``seed`` and the document's id."""

    buckets: int = 10_000
    longest: int = 2
    dictionary: int = 200_000
    word_bytes: int = 40
    seed: int = 7
    min_words: int = 20
    percent: int = 25


# --- payloads ---------------------------------------------------------------------------------


def _zero_tables() -> np.ndarray:
    """[k, i, b]: what byte b at place i of a CRC becomes when 2^k zero bytes follow."""
    byte = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    tables = np.zeros((40, 4, 256), np.uint32)
    for i in range(4):
        x = np.arange(256, dtype=np.uint32) << np.uint32(8 * i)
        tables[0, i] = (x >> np.uint32(8)) ^ byte[x & np.uint32(255)]
    for k in range(1, len(tables)):
        for i in range(4):
            tables[k, i] = _apply(tables[k - 1], tables[k - 1, i])
    return tables


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    low = np.uint32(255)
    return (
        table[0][crc & low]
        ^ table[1][(crc >> np.uint32(8)) & low]
        ^ table[2][(crc >> np.uint32(16)) & low]
        ^ table[3][crc >> np.uint32(24)]
    )


_ZEROS = _zero_tables()


def compose(left: np.ndarray, right: np.ndarray, right_bytes: np.ndarray) -> np.ndarray:
    """CRC of two strings in a row, from the CRC of each and the length of the second."""
    out = left.copy()
    for k in range(int(right_bytes.max(initial=0)).bit_length()):
        some = np.flatnonzero((right_bytes >> k) & 1)
        out[some] = _apply(_ZEROS[k], out[some])
    return out ^ right


def feature_crcs(crcs: np.ndarray, lengths: np.ndarray, longest: int) -> np.ndarray:
    """CRCs of all runs of 1 to ``longest`` consecutive words, joined by a blank."""
    parts, run = [crcs], crcs
    ones = np.ones(len(crcs), np.int64)
    for n in range(2, min(longest, len(crcs)) + 1):
        blank = compose(run[:-1], np.full(len(run) - 1, _BLANK_CRC, np.uint32), ones[: len(run) - 1])
        run = compose(blank, crcs[n - 1 :], lengths[n - 1 :])
        parts.append(run)
    return np.concatenate(parts)


class PayloadScanner:
    """Payloads of a text's words, by one pass of the automaton."""

    def __init__(self, words: list[str]) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, word in enumerate(words):
            self.automaton.add_word(f" {word} ", i)
        self.automaton.make_automaton()
        raw = [w.encode() for w in words]
        self.crcs = np.array([zlib.crc32(w) for w in raw], np.uint32)
        self.lengths = np.array([len(w) for w in raw], np.int64)

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(crcs, lengths) of all words in order. A match ends at the delimiter behind its word,
        so it tells which word it is; words that no match ends at are not in the automaton."""
        text = f" {raw.translate(_NORMAL).decode()} "
        blank = np.frombuffer(text.encode("utf-32-le"), np.uint32) == _BLANK
        starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        crcs, lengths = np.zeros(len(ends), np.uint32), np.zeros(len(ends), np.int64)
        if not len(ends):
            return crcs, lengths
        known = np.zeros(len(ends), bool)
        if len(self.crcs):
            found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
            at, ids = np.searchsorted(ends, found[:, 0]), found[:, 1]
            known[at] = True
            crcs[at], lengths[at] = self.crcs[ids], self.lengths[ids]
        rest = np.flatnonzero(~known)
        words = [text[a:b].encode() for a, b in zip(starts[rest].tolist(), ends[rest].tolist())]
        crcs[rest] = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        lengths[rest] = np.fromiter(map(len, words), np.int64, len(words))
        return crcs, lengths


_scanners: dict[int, PayloadScanner] = {}


def _scanner(shared) -> PayloadScanner:
    """The scanner of a broadcast dictionary, built once per Python worker."""
    if shared.value[0] not in _scanners:
        _scanners.clear()
        _scanners[shared.value[0]] = PayloadScanner(shared.value[1])
    return _scanners[shared.value[0]]


# --- passes over the texts ----------------------------------------------------------------------

_MOST_COUNTED = 400_000  # words a task counts at a time before it hands on what it has


def _word_counting(params: ResampleParams) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            some = {w: n for w, n in counts.items() if len(w) <= params.word_bytes}
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in some], pa.string()), pa.array(list(some.values()), pa.int64())], ["word", "n"]
            )

        counts: Counter = Counter()
        for batch in small_batches(batches, "text"):
            for text in batch.column("text").to_pylist():
                counts.update((text or "").encode().translate(_NORMAL).split(b" "))
                if len(counts) > _MOST_COUNTED:
                    yield rows()
                    counts = Counter()
        yield rows()

    return run


def frequent_words(texts: DataFrame, params: ResampleParams) -> list[str]:
    """The most frequent words of ``texts(text)``, counted over all of them: as many of the fine classes of
    equal frequency, from the top, as have at most ``dictionary`` words together."""
    counted = texts.mapInArrow(_word_counting(params), "word string, n bigint").where("word <> ''")
    level = F.floor(F.log2("n") * 32).alias("level")  # at most 32 * 63 levels
    words = write_and_read(counted.groupBy("word").agg(F.sum("n").alias("n")).select("word", level), "words")
    sizes = words.groupBy("level").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect()
    lowest, room = math.inf, params.dictionary
    for level, n in sizes:
        room -= n
        if room < 0:
            break
        lowest = level
    wanted = words.where(F.col("level") >= F.lit(lowest))  # bounded by two parameters
    return [r["word"] for r in wanted.select("word").collect()]


def _bucket_counting(params: ResampleParams, shared) -> Callable:
    """At most ``buckets`` rows leave a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, total = _scanner(shared), np.zeros(params.buckets, np.int64)
        for batch in small_batches(batches, "text"):
            found = [
                feature_crcs(*scan((t or "").encode()), params.longest) for t in batch.column("text").to_pylist()
            ]
            total += np.bincount(np.concatenate(found) % np.uint32(params.buckets), minlength=params.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, params: ResampleParams, shared) -> np.ndarray:
    """Features per bucket of all of ``texts(text)``; ``buckets`` numbers, whatever the corpus."""
    counted = texts.mapInArrow(_bucket_counting(params, shared), "bucket bigint, n bigint")
    out = np.zeros(params.buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(smoothed target share / smoothed corpus share)) per bucket."""
    more = len(corpus)
    s_all, t_all = int(corpus.sum()) + more, int(target.sum()) + more
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all)))
            for s, t in zip(corpus.tolist(), target.tolist())
        ],
        np.int64,
    )


def noise(doc_id: int | None, seed: int) -> int:
    """floor(1000 g) with g of a Gumbel distribution, from the id alone."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"


def _scoring(params: ResampleParams, shared, gains: np.ndarray) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(shared)
        for batch in small_batches(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                crcs, lengths = scan((text or "").encode())
                found = feature_crcs(crcs, lengths, params.longest)
                weight = int(gains[found % np.uint32(params.buckets)].sum()) // max(1, len(found))
                rows.append((doc_id, len(crcs), len(found), weight, weight + noise(doc_id, params.seed)))
            columns = zip(*rows)
            names = [field.split()[0] for field in _SCORED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


# --- the draw -------------------------------------------------------------------------------------


def _ranked(rows: DataFrame, *order) -> DataFrame:
    """Rows with ``rank``, 1 for the first: sorted by ranges, written, and numbered from the sizes
    of the ranges, so that no task sees more than its own."""
    numbered = rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    sorted_rows = write_and_read(numbered, "ranked")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))  # a row per range
    before = F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")
    offsets = sizes.select("_part", before.alias("_before"))
    placed = sorted_rows.withColumn("_part", part).join(offsets, "_part")
    return placed.withColumn("rank", F.col("_before") + within + 1).drop("_at", "_part", "_before")


def resample(
    documents: DataFrame, target: DataFrame, params: ResampleParams = ResampleParams()
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; ``rank`` counts the
    drawn documents from the highest score on, and is null for the others.

    The weight of a document is the mean gain of its features: how much more likely their
    buckets are in ``target(text)`` than in all documents. Adding Gumbel noise and taking the
    highest scores draws without replacement, in proportion to the exponentials of the weights.

    Null text is empty text: no features, weight 0, never drawn. Equal scores go by the smaller
    doc_id, null ids last; a null id takes its noise from the empty text. Repeated rows are rows
    of their own and have ranks of their own. Long texts are scanned whole, one at a time, and
    long words get their CRC by themselves. An empty table gives no rows, an empty target leaves
    smoothed counts only. Other columns are not looked at.

    What the driver holds is bounded by parameters: the dictionary's words and a number per
    bucket.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    wanted = target.select("text")
    words = frequent_words(docs.select("text").unionAll(wanted), params)
    context = documents.sparkSession.sparkContext
    shared = context.broadcast((hash(tuple(words)), words))
    gains = bucket_gains(
        bucket_counts(docs.select("text"), params, shared), bucket_counts(wanted, params, shared)
    )
    scored = write_and_read(docs.mapInArrow(_scoring(params, shared, gains), _SCORED), "scored")
    able = F.col("n_words") >= params.min_words
    n_able = scored.where(able).count()
    ranked = _ranked(scored, able.desc(), F.desc("score"), F.col("doc_id").asc_nulls_last())
    drawn = able & (F.col("rank") <= params.percent * n_able // 100)
    return ranked.withColumn("rank", F.when(drawn, F.col("rank")))
