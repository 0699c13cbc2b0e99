"""Chat transcripts as text, proven to read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's fixed strings.
START, END = "<|im_start|>", "<|im_end|>"
_MARKED = r"<(\^*)\|(im_start|im_end)\|>"
_ESCAPED = r"<\^(\^*)\|(im_start|im_end)\|>"
_TURN_END = END + "\n"


def escape(text: Column) -> Column:
    """One caret more in everything that looks like a control string. Undone by ``unescape``."""
    return F.regexp_replace(text, _MARKED, "<^$1|$2|>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "<$1|$2|>")


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(_TURN_END))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation: whatever follows a start mark up to its
    end mark, the first line being the role; escapes are undone."""
    split = F.split(formatted, r"<\|im_start\|>", -1)
    pieces = F.slice(split, 2, F.size(split) - 1)

    def turn(piece: Column) -> Column:
        body = F.substring_index(piece, END, 1)
        role = F.substring_index(body, "\n", 1)
        rest = F.substr(body, F.char_length(role) + 2)
        return F.struct(unescape(role).alias("role"), unescape(rest).alias("text"))

    return F.transform(pieces, turn)


def format_chats(conversations: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, mask, n_turns): every conversation as one text.

    A turn is rendered as it is, parsed and compared; if it does not come back, what looks like
    a control string in it is escaped. Then the conversation as a whole is parsed and must equal
    its source, or the job fails. ``mask`` has the code-point ranges (start, end) of the texts
    of ``trained_roles``, on which a model's loss is taken.

    Rows go by turn; equal or null turns by role and text, nulls first. Null text or role is
    empty. A line break in a role becomes a space. Repeated rows are repeated turns. Rows of a
    null conv_id are one conversation. Empty tables give no rows. Other columns are not looked
    at. A conversation is one text and so one task's work, as it must be.
    """
    role = F.translate(F.coalesce(F.col("role"), F.lit("")), "\n", " ")
    text = F.coalesce(F.col("text"), F.lit(""))
    source = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    plain = parse(_render(F.col("role"), F.col("text"))) == F.array(F.struct("role", "text"))
    tried = source.withColumn("plain", plain)
    safe_role = F.when(F.col("plain"), F.col("role")).otherwise(escape(F.col("role")))
    safe_text = F.when(F.col("plain"), F.col("text")).otherwise(escape(F.col("text")))
    rendered = tried.withColumns({"safe_role": safe_role, "safe_text": safe_text}).withColumn(
        "rendered", _render(F.col("safe_role"), F.col("safe_text"))
    )
    so_far = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    size = F.char_length("rendered")
    end = F.col("begin") + size - F.lit(len(_TURN_END))
    placed = rendered.withColumn("begin", F.sum(size).over(so_far) - size).select(
        "conv_id",
        F.struct(
            "begin",
            "rendered",
            F.struct("role", "text").alias("source"),
            F.struct((end - F.char_length("safe_text")).alias("start"), end.alias("end")).alias("span"),
        ).alias("row"),
    )
    whole = (
        placed.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("row")).alias("rows"))
        .select(
            "conv_id",
            F.array_join(F.col("rows.rendered"), "").alias("formatted"),
            F.transform(
                F.filter("rows", lambda r: r["source"]["role"].isin(*trained_roles)), lambda r: r["span"]
            ).alias("mask"),
            F.col("rows.source").alias("turns"),
        )
    )
    back = parse(F.col("formatted")) == F.col("turns")
    proven = F.when(back, F.col("formatted")).otherwise(
        F.raise_error(
            F.concat(F.lit("does not read back: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
        )
    )
    return whole.select(
        "conv_id", proven.alias("formatted"), "mask", F.size("turns").cast("bigint").alias("n_turns")
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, trained, formatted): the turns, and the text under the loss mask, read
    back from nothing but the formatted text and its mask."""
    size = (lambda m: (m["end"] - m["start"]).cast("int"))
    under = F.transform(
        "mask",
        lambda m: unescape(F.substr(F.col("formatted"), (m["start"] + 1).cast("int"), size(m))),
    )
    return formatted.select(
        "conv_id", parse(F.col("formatted")).alias("turns"), F.array_join(under, "").alias("trained"), "formatted"
    )
