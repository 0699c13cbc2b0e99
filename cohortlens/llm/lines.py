"""Dropping lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_and_read
from .common import SPACES, ascii_lower, fresh, quoted, same_row, texts


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def line_dedup(
    documents: DataFrame, min_chars: int = 10, min_docs: int = 2, with_columns: bool = False
) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): every document with the lines it keeps. Or, asked
    ``with_columns``, all columns of ``documents``, the text (and ``n_chars``, if there) anew.

    Lines are exploded with their position, and those whose key has ``min_chars`` code points
    are hashed (128 bits). Distinct documents are counted per hash; a hash found in ``min_docs``
    or more loses its lines everywhere but in the smallest doc_id that holds it. The verdicts,
    a few bytes a line, go back to the document, which puts its lines together by position.

    Counting combines on the map side, so a line of very many documents is counted in parts; its
    verdicts are spread by the skew join. Only one shuffle carries text.

    Null or empty text is one empty line. Blank lines have short keys and stay. Rows with the
    same doc_id are one document to the count. A null id is a document that any id precedes.
    Empty tables give no rows. Other columns are at most handed on.
    """
    docs = texts(documents)
    lines = docs.select("doc_id", "_th", F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).select(
        "doc_id",
        "_th",
        "pos",
        F.when(F.char_length("key") >= min_chars, F.xxhash64("key")).alias("h1"),
        F.when(F.char_length("key") >= min_chars, F.xxhash64(F.lit("second"), "key")).alias("h2"),
    )
    long_lines = keyed.where(F.col("h1").isNotNull())
    holders = long_lines.select("h1", "h2", "doc_id").distinct()
    # Written, so that the join has a shuffle of its own on either side and can split a hot hash.
    shared = write_and_read(
        holders.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first"))
        .where(F.col("docs") >= min_docs)
        .select("h1", "h2", "first"),
        "shared-lines",
    )
    lost = (
        long_lines.join(shared, ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("first")))
        .groupBy("doc_id", "_th")
        .agg(F.sort_array(F.collect_set("pos")).alias("lost"))  # at most the lines of one document
    )
    source = texts(documents)
    if with_columns:
        (own,) = fresh(documents, "_columns")
        row = F.struct(*[F.col(quoted(c)) for c in documents.columns if c not in ("doc_id", "text")])
        source = texts(documents, row.alias(own) if len(documents.columns) > 2 else None)
    joined = source.join(lost, same_row(source, lost), "left").select(
        source["doc_id"], source["text"], "lost", *source.columns[3:]
    )
    # Kept lines are the runs between lost positions: no search per line.
    n = F.size("parts")
    bounds = F.concat(F.array(F.lit(-1)), F.col("lost"), F.array(n))
    runs = F.transform(
        F.sequence(F.lit(1), F.size("bounds") - 1),
        lambda i: F.slice(
            F.col("parts"),
            F.get("bounds", i - 1) + 2,
            F.get("bounds", i) - F.get("bounds", i - 1) - 1,
        ),
    )
    whole = joined.withColumn("parts", F.split("text", "\n", -1))
    cut = whole.withColumn("bounds", F.when(F.col("lost").isNotNull(), bounds))
    kept = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    if with_columns:
        new = {"doc_id": F.col("doc_id"), "text": kept, "n_chars": F.char_length(kept).cast("bigint")}
        own_columns = [new[c] if c in new else F.col(source.columns[3])[c] for c in documents.columns]
        return cut.select(*[c.alias(n) for c, n in zip(own_columns, documents.columns)])
    return cut.select(
        "doc_id",
        kept.alias("text"),
        n.cast("bigint").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
