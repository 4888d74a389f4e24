"""Column expressions on texts that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space is exactly U+0020 and U+0009 to U+000D everywhere here.
BLANK = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole(text: Column) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column, separator: str = BLANK + "+") -> Column:
    """Maximal runs without separators, in order."""
    return F.filter(F.split(whole(text), separator, -1), lambda w: w != "")


def word_count(text: Column, separator: str = BLANK + "+") -> Column:
    """How many such runs there are; only the first and last piece of a split can be empty."""
    pieces = F.split(whole(text), separator, -1)
    blank_at = lambda i: (F.element_at(pieces, i) == "").cast("long")
    return F.when(F.size(pieces) == 1, 1 - blank_at(1)).otherwise(F.size(pieces).cast("long") - blank_at(1) - blank_at(-1))
