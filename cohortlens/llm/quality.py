"""Quality rules: hashed n-gram log-likelihood ratio of trusted text against the whole corpus."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_and_read
from .common import small_batches, text_hash

SYMBOLS = b"#*$%&|<>"
BLANK = b" \t\n\x0b\f\r"


@dataclass(frozen=True)
class QualityParams:
    """``buckets`` hashed n-grams of one word up to ``longest`` words. Half of the trusted rows fit
    the target distribution and half set the threshold: the score that a share ``lost`` of them stays
    below. All trusted rows count, unless ``sample`` bounds them. ``smoothing`` is added to every bucket.
    The base rules reject below ``min_words`` words and beyond ``max_repeat_pct`` percent of
    words in repeated windows of ``window`` words."""

    buckets: int = 1 << 16
    longest: int = 2
    sample: int | None = None
    lost: float = 0.001
    smoothing: float = 1.0
    min_words: int = 20
    max_repeat_pct: int = 30
    window: int = 8


class _WordHashes(dict):
    """64-bit hash by word, kept for words seen lately."""

    MOST = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _WordHashes()
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for every n consecutive words."""
    out = hashes[: len(hashes) - n + 1].copy()
    for i in range(1, n):
        out *= _ODD
        out ^= out >> np.uint64(29)
        out += hashes[i : len(hashes) - n + 1 + i]
    return out


def gram_buckets(hashes: np.ndarray, params: QualityParams) -> np.ndarray:
    parts = []
    for n in range(1, params.longest + 1):
        if len(hashes) >= n:
            mixed = (_grams(hashes, n) + np.uint64(n)) * _ODD
            parts.append(((mixed >> np.uint64(32)) % np.uint64(params.buckets)).astype(np.int64))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def repeated_words(words: list[bytes], hashes: np.ndarray, window: int) -> int:
    """Words that lie in a window of words found at least twice. Hashes only pick candidates;
    the windows themselves are compared."""
    if len(words) <= window:
        return 0
    grams = _grams(hashes, window)
    order = np.argsort(grams, kind="stable")
    equal = grams[order[1:]] == grams[order[:-1]]
    if not equal.any():
        return 0
    maybe = np.zeros(len(grams), bool)
    maybe[order[1:][equal]] = maybe[order[:-1][equal]] = True
    at: dict[bytes, list[int]] = {}
    for i in np.flatnonzero(maybe).tolist():
        at.setdefault(b" ".join(words[i : i + window]), []).append(i)
    change = np.zeros(len(words) + 1, np.int64)
    for starts in at.values():
        if len(starts) > 1:
            for i in starts:
                change[i] += 1
                change[i + window] -= 1
    return int((np.cumsum(change[:-1]) > 0).sum())


def base_facts(raw: bytes, n_points: int, window: int) -> tuple[list[bytes], np.ndarray, tuple]:
    words = raw.split()  # bytes are split at exactly the characters of BLANK
    hashes = word_hashes(words)
    lines = [x for x in raw.split(b"\n") if x.strip(BLANK)]
    facts = (
        len(words),
        n_points - (len(raw) - len(raw.translate(None, BLANK))),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words, hashes, window),
    )
    return words, hashes, facts


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int]]:
    for text in batch.column("text").to_pylist():
        yield (text or "").encode(), len(text or "")


def _counting(params: QualityParams) -> Callable:
    """Per task one row for each bucket in use: at most ``buckets`` rows leave a task."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(params.buckets, np.int64)
        for batch in small_batches(batches, "text"):
            for text, _ in _rows(batch):
                found = gram_buckets(word_hashes(text.split()), params)
                if len(found) * 4 > params.buckets:
                    n += np.bincount(found, minlength=params.buckets)
                else:
                    np.add.at(n, found, 1)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(n[used])], ["bucket", "n"])

    return count


def bucket_counts(docs: DataFrame, params: QualityParams) -> np.ndarray:
    """n-grams per bucket; ``buckets`` numbers, whatever the corpus."""
    counts = docs.select("text").mapInArrow(_counting(params), "bucket bigint, n bigint")
    out = np.zeros(params.buckets)
    for row in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def log_ratios(raw: np.ndarray, target: np.ndarray, params: QualityParams) -> np.ndarray:
    """ln(target share / corpus share) per bucket."""
    add = params.smoothing
    return np.log((target + add) / (target.sum() + add * params.buckets)) - np.log(
        (raw + add) / (raw.sum() + add * params.buckets)
    )


def _placed(ids: DataFrame) -> DataFrame:
    """(doc_id, place): distinct ids numbered from 0 by their hash. Numbers are counted within 4096
    ranges of hashes, which are even, so only these ranges are ever ordered in one task."""
    hashed = ids.withColumn("_hash", F.xxhash64("doc_id")).withColumn("_range", F.shiftright("_hash", 52))
    sizes = hashed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_hash", "doc_id"))
    numbered = hashed.withColumn("_within", within)
    met = numbered.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    return met.select("doc_id", (F.col("_before") + F.col("_within") - 1).alias("place"))


MOST_BITS = 1 << 27


def _of_ids(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The documents that have one of ``n`` distinct ids. Texts are only shuffled where the bit of their
    id is set in a table of 32 to 64 bits an id, 16 MB at most; the ids themselves decide."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(min(MOST_BITS, 1 << max(15, (32 * n).bit_length()))))
    part, bit = F.bitmap_bucket_number(slot).alias("_part"), F.bitmap_bit_position(slot).alias("_bit")
    bits = ids.select(part, bit).groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.substring("_bits", (F.call_function("div", F.col("_bit"), F.lit(8)) + 1).cast("int"), F.lit(1))
    is_set = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod("_bit", F.lit(8)).cast("int")) == 1
    maybe = docs.select("*", part, bit).join(F.broadcast(bits), "_part").where(is_set).select(*docs.columns)
    return maybe.join(ids.select("doc_id"), "doc_id").select(*docs.columns)


def _percentile(numbers: DataFrame, share: float) -> float | None:
    """``percentile`` of the only column: the same number, but no task holds all of them."""
    (name,) = numbers.columns
    ordered = numbers.orderBy(name).withColumn("_at", F.monotonically_increasing_id())
    ordered = write_and_read(ordered, "ordered")
    parts = ordered.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sorted(map(tuple, parts.collect()))  # one row for each task that wrote
    n = sum(size for _, size in sizes)
    if not n:
        return None
    position = share * (n - 1)
    wanted = [math.floor(position), math.ceil(position)]
    at, start = {}, 0
    for part, size in sizes:
        at |= {(part << 33) + w - start: w for w in wanted if start <= w < start + size}
        start += size
    found = {at[i]: x for x, i in ordered.where(F.col("_at").isin(list(at))).collect()}
    low, high = (found[w] for w in wanted)
    return low if low == high else (wanted[1] - position) * low + (position - wanted[0]) * high


_FACTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in _FACTS) + ", llr double, text_hash bigint"


def _scoring(params: QualityParams, ratios) -> Callable:
    """``ratios``: a broadcast array, or None where nothing is trusted: every score is then 0."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_bucket = None if ratios is None else ratios.value
        for batch in small_batches(batches, "text"):
            facts, scores = [], []
            for text, points in _rows(batch):
                _, hashes, row = base_facts(text, points, params.window)
                found = gram_buckets(hashes, params)
                facts.append(row)
                some = per_bucket is not None and len(found)
                scores.append(float(per_bucket[found].mean()) if some else 0.0)
            table = np.array(facts, np.int64).reshape(len(facts), len(_FACTS))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    *[pa.array(table[:, i]) for i in range(len(_FACTS))],
                    pa.array(scores, pa.float64()),
                    batch.column("text_hash"),
                ],
                ["doc_id", *_FACTS, "llr", "text_hash"],
            )

    return score


def quality_rules(
    documents: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()
) -> DataFrame:
    """One row per document: base facts, score (``llr``), hash of the text and verdict.

    The corpus distribution counts the n-grams of all documents. The target distribution counts
    every other trusted document (``labels.quality`` 1 and not ``toxic``), in the order of their
    ids' hashes, so that runs agree; the others set the threshold. With ``sample`` only so many ids
    are taken, the ones that hash lowest. A document's score is the mean log ratio over its n-grams,
    so length does not matter. Everything that reaches the threshold and passes the base rules is
    kept; equal scores get equal verdicts.

    Null text is empty text: no words, rejected by the base rules. A null id is no trusted id.
    Repeated rows are rows of their own and count as often as they occur. Without trusted rows
    only the base rules judge. Empty tables give no rows. Other columns are not looked at.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", text_hash().alias("text_hash"))
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))
    ids = good.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    placed = _placed(ids) if params.sample is None else _placed(ids).where(F.col("place") < params.sample)
    trusted = write_and_read(placed, "trusted")
    n = trusted.count()
    ratios, threshold = None, None
    if n:
        fit = trusted.where("place % 2 = 0")
        check = trusted.where("place % 2 = 1") if n > 1 else trusted
        raw, target = bucket_counts(docs, params), bucket_counts(_of_ids(docs, fit, n), params)
        ratios = spark.sparkContext.broadcast(log_ratios(raw, target, params))
        scored = _of_ids(docs, check, n).mapInArrow(_scoring(params, ratios), _SCHEMA)
        threshold = _percentile(scored.where(F.col("n_words") >= params.min_words).select("llr"), params.lost)
    base = (F.col("n_words") < params.min_words) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(params.max_repeat_pct) * F.col("n_words")
    )
    good_score = F.lit(True) if threshold is None else F.col("llr") >= F.lit(threshold)
    out = docs.mapInArrow(_scoring(params, ratios), _SCHEMA)
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & good_score)
