"""Benchmark passages in documents, found by winnowing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_and_read
from .common import ascii_lower, same_row, texts

# A word is a run of letters, digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class WinnowParams:
    """Passages of ``window`` words; fingerprints are hashes of ``gram`` words. The benchmark is
    met in blocks of at most ``block`` windows, each small enough to send to all tasks."""

    window: int = 10
    gram: int = 5
    block: int = 200_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _ahead(values: str, n: int) -> list[Column]:
    """The values up to n places behind the current one, inside a transform."""
    return [lambda i, k=k: F.get(F.col(values), i + k) for k in range(n)]


def _windows(df: DataFrame, length: int, gram: int) -> DataFrame:
    """Adds ``fps``: for every window of ``length`` words the least hash of its k-grams. Equal
    windows have equal ones, so no shared passage of ``length`` words can be missed."""
    k = min(gram, length)
    hashed = df.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    grams = hashed.withColumn(
        "_g", F.transform("_h", lambda x, i: F.xxhash64(x, *[f(i) for f in _ahead("_h", k)[1:]]))
    )
    w = length - k + 1
    least = F.transform("_g", lambda x, i: F.least(x, *[f(i) for f in _ahead("_g", w)[1:]])) if w > 1 else F.col("_g")
    fps = grams.withColumn("_m", least)
    n = F.size("words")
    return fps.withColumn(
        "fps", F.when(n >= length, F.slice("_m", 1, n - (length - 1))).otherwise(F.array().cast("array<bigint>"))
    ).drop("_h", "_g", "_m")


def _passage(words: str, start: Column, length: int) -> Column:
    return F.array_join(F.slice(F.col(words), start + 1, length), " ")


def benchmark_windows(benchmark: DataFrame, params: WinnowParams = WinnowParams()) -> DataFrame:
    """(item_id, length, fp, passage): every window of every item with its fingerprint. An item
    of fewer words than a window is one window of its own length; without words it has none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    items = benchmark.select("item_id", words_of(text).alias("words"))
    n = F.size("words")
    short = items.select(n.alias("n")).where((F.col("n") > 0) & (F.col("n") < params.window)).distinct()
    out = None
    for length in [*sorted(r[0] for r in short.collect()), params.window]:  # fewer than ``window`` numbers
        some = items.where(n >= length) if length == params.window else items.where(n == length)
        placed = _windows(some, length, params.gram).select(
            "item_id", "words", F.posexplode_outer("fps").alias("at", "fp")
        ).where(F.col("at").isNotNull())
        rows = placed.select(
            "item_id", F.lit(length).alias("length"), "fp", _passage("words", F.col("at"), length).alias("passage")
        )
        out = rows if out is None else out.union(rows)
    return out.distinct()


def _hits(docs: DataFrame, windows: DataFrame, length: int, params: WinnowParams) -> DataFrame:
    """Per document with a hit: the places of the passages found, and the items they are of.

    A document's windows meet the fingerprints of one block in the task that reads the document;
    where a fingerprint agrees, the hit is extended to the passage and compared word by word.
    """
    placed = _windows(docs.withColumn("words", words_of(F.col("text"))), length, params.gram)
    # outer: else the plan computes all fingerprints once more, to leave out texts without any
    rows = placed.select("doc_id", "_th", "words", F.posexplode_outer("fps").alias("at", "fp"))
    met = rows.join(F.broadcast(windows), "fp")  # at most ``block`` rows
    found = _passage("words", F.col("at"), length)
    # Equality in two halves, so that it stays a check of the few candidates and does not
    # become a join key that is computed for every window.
    same = found.startswith(F.col("passage")) & F.col("passage").startswith(found)
    return (
        met.where(same)
        .groupBy("doc_id", "_th")
        .agg(
            F.collect_set(F.struct(F.col("at").alias("start"), (F.col("at") + length).alias("end"))).alias("spans"),
            F.collect_set(F.col("item_id").cast("string")).alias("items"),
        )
    )


def _covered(spans: Column) -> Column:
    """Words under sorted spans, each once."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def add(so_far: Column, span: Column) -> Column:
        new = F.greatest(span["end"] - F.greatest(span["start"], so_far["end"]), F.lit(0))
        return F.struct(
            F.greatest(so_far["end"], span["end"]).alias("end"), (so_far["n"] + new).alias("n")
        )

    return F.aggregate(spans, start, add, lambda x: x["n"])


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, params: WinnowParams = WinnowParams()
) -> DataFrame:
    """One row per document: n_words, n_hit, spans (word positions), items, the hash of the text
    and contaminated.

    Null text has no words and no hits; an item without words hits nothing. Repeated documents
    are judged alike, each as a row; repeated items count once; item ids are reported as text,
    a null one not at all, though its passages still hit. An empty benchmark leaves every
    document clean. Other columns are not looked at.

    The benchmark's windows are written once and counted; each block of them is one pass over
    the documents, so nothing larger than a block is sent to the tasks.
    """
    docs = texts(documents)
    windows = write_and_read(benchmark_windows(benchmark, params), "benchmark-windows")
    sizes = {r["length"]: r["n"] for r in windows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = []
    for length, n in sorted(sizes.items()):  # at most ``window`` lengths
        own = windows.where(F.col("length") == length).drop("length")
        # dealt by hash: a quarter of slack keeps blocks under the bound
        blocks = -(-n * 5 // (4 * params.block)) if n > params.block else 1
        block = F.pmod(F.xxhash64("fp", "passage", "item_id"), F.lit(blocks))
        parts += [_hits(docs, own.where(block == b), length, params) for b in range(blocks)]
    counted = docs.select("doc_id", "_th", F.regexp_count(ascii_lower(F.col("text")), F.lit(WORD)).cast("bigint").alias("n_words"))
    if not parts:
        none = F.array().cast("array<struct<start:int,end:int>>")
        joined = counted.select("doc_id", "_th", "n_words", none.alias("spans"), F.array().cast("array<string>").alias("items"))
    else:
        hits = parts[0]
        for part in parts[1:]:
            hits = hits.union(part)
        if len(parts) > 1:
            hits = hits.groupBy("doc_id", "_th").agg(
                F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
                F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
            )
        joined = counted.join(hits, same_row(counted, hits), "left").select(
            counted["doc_id"],
            counted["_th"],
            "n_words",
            F.sort_array(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))).alias("spans"),
            F.sort_array(F.coalesce("items", F.array().cast("array<string>"))).alias("items"),
        )
    n_hit = _covered(F.col("spans"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items", F.col("_th").alias("text_hash")).withColumn(
        "contaminated", F.col("n_hit") > 0
    )
