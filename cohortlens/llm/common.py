"""Small helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\x0b\f\r"  # the characters [\x20\x09-\x0D]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def texts(documents: DataFrame, extra: Column | None = None) -> DataFrame:
    """(doc_id, text, _th): the two columns that matter, null text as empty text, and a hash of
    the text. ``(doc_id, _th)`` names a row even where ids are repeated or null; rows that share
    both are copies of each other and are treated alike."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    more = [] if extra is None else [extra]
    return documents.select("doc_id", text, text_hash().alias("_th"), *more)


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["_th"] == b["_th"])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def small_batches(
    batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 8 << 20
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of text, so that what a task holds beside
    them is bounded by the longest text and not by the number of rows in an Arrow batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        share = max(1, -(-batch.column(column).nbytes // most_bytes))
        step = max(1, batch.num_rows // share)
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
