"""From raw documents to token ids: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the shared
folder and hands it on as the next one's docs. All stages but the last return the columns of
their documents; rows without a doc_id are treated like any other row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import fresh, table, text_hash
from cohortlens.llm.decontaminate import decontaminate
from cohortlens.llm.lines import line_dedup
from cohortlens.llm.pieces import round_trip_digests
from cohortlens.llm.quality import quality_rules
from cohortlens.llm.queries import tokenizer
from cohortlens.llm.simhash import simhash_groups
from cohortlens.session import write_and_read


def _only(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``rows(doc_id, text_hash)`` name. A row is named by its id and
    its text, so that repeated and missing ids are no matter."""
    names = fresh(docs, "_kept_id", "_kept_hash")
    wanted = rows.select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "text_hash"), names)]).distinct()
    same = docs["doc_id"].eqNullSafe(wanted[names[0]]) & (text_hash() == wanted[names[1]])
    return docs.join(wanted, same, "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return _only(docs, quality_rules(docs, table(spark, sf_dir, "labels")).where("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that others hold as well; ``n_chars`` follows the text."""
    return line_dedup(docs, with_columns=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id, once even where its
    row is repeated."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    first = simhash_groups(docs).groupBy("group").agg(F.min(row).alias("row"))
    (name,) = fresh(docs, "_text_hash")
    once = _only(docs, first.select("row.*")).withColumn(name, text_hash())
    return once.dropDuplicates(["doc_id", name]).drop(name)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _only(docs, found.where(~F.col("contaminated")))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return round_trip_digests(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding", pieces),
]

# A trained score and a tokenizer's merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
