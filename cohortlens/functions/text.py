"""Keys, values and result lines as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The separators and formats of keys and result lines.
PART_SEPARATOR = "|"
RESULT_LINE = "%s,%.2f,%.2f,%.2f,%.2f"
RESULT_LINE_SPACED = "%s, %.2f, %.2f, %.2f, %.2f"
ARRAY_ELEMENT = "%.2f"

# One field: runs without comma or quote, and quoted stretches; an open quote runs to the end of
# the line. The line is read with a comma put in front, so every field starts at a comma and no
# match is empty. Possessive quantifiers keep it linear, and free of recursion, on long lines.
QUOTED_FIELD = r',((?:[^,"]++|"[^"]*+(?:"|$))*+)'


def split_quoted(line: Column) -> Column:
    """Fields of a comma-separated line as an array.

    Commas inside double quotes do not split, quotes stay in the field, empty fields count.
    """
    return F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(QUOTED_FIELD), F.lit(1))


def _part(col: Column, escape: bool) -> Column:
    text = F.coalesce(col.cast("string"), F.lit(""))
    if not escape:
        return text
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(escaped, F.lit(PART_SEPARATOR), F.lit("\\" + PART_SEPARATOR))


def join_parts(cols: Sequence[Column], escape: bool = True) -> Column:
    """Columns joined by ``|``. Null counts as empty text.

    With ``escape``, a ``|`` or backslash inside a part of a multi-part key gets a backslash,
    so different parts never give the same text. A single part is taken as it is.
    """
    if len(cols) == 1:
        return _part(cols[0], escape=False)
    return F.concat_ws(PART_SEPARATOR, *[_part(c, escape) for c in cols])


def make_key(cols: Sequence[Column | str], first_n: int | None = None, escape: bool = True) -> Column:
    """Key of the given columns, or of the first ``first_n`` of them."""
    picked = list(cols) if first_n is None else list(cols)[:first_n]
    if not picked:
        raise ValueError("a key needs at least one column")
    return join_parts([F.col(c) if isinstance(c, str) else c for c in picked], escape)


def parse_positions(spec: str) -> list[int]:
    """``"1,3"`` -> ``[1, 3]``: a key given as column positions."""
    return [int(p) for p in spec.split(",")]


def format_line(
    key: Column, entropy: Column, l2: Column, l1: Column, card: Column, spaced: bool = False
) -> Column:
    """Result line: key, entropy, l2, l1 and card with two decimals."""
    numbers = [c.cast("double") for c in (entropy, l2, l1, card)]
    return F.format_string(RESULT_LINE_SPACED if spaced else RESULT_LINE, key, *numbers)


def format_array(values: Column) -> Column:
    """``[1.00, 2.50]``; a null array gives ``null``."""
    parts = F.transform(
        values.cast("array<double>"), lambda x: F.format_string(ARRAY_ELEMENT, x)
    )
    text = F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))
    return F.coalesce(text, F.lit("null"))
