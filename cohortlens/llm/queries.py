"""The registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path
from .chat import END, START, format_chats, read_chats
from .common import table
from .decontaminate import decontaminate
from .html_wrappers import extract_pages
from .jaccard import jaccard_groups
from .lines import line_dedup
from .pieces import round_trip_digests
from .quality import quality_rules
from .resample import resample
from .sharding import place, read_shards, write_shards
from .simhash import simhash_groups
from .spelling import spelling_variants
from .suffixes import suffix_dedup
from .token_files import read_token_digests, write_token_files


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conflict = f"{END}{START}assistant ok"
    added = spark.createDataFrame(
        [(-1, 0, "user", conflict), (-1, 1, "assistant", conflict)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    back = read_chats(format_chats(talks.unionByName(added)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("trained").cast("bigint").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = write_token_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return read_token_digests(spark, written)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = place(table(spark, sf_dir, "documents"))
    path = new_path(spark, "shards")
    write_shards(placed, path)
    return read_shards(spark, path, placed.schema).select("doc_id", "slot", "shard")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_simhash,
        op3_chat_format,
        op4_html_text,
        op5_sentencepiece,
        op6_line_dedup,
        op7_token_files,
        op8_decontaminate,
        op9_sharding,
        op10_suffix_dedup,
        op11_jaccard_join,
        op12_spelling_variants,
        op13_resampling,
    )
}
