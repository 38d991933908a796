"""Native text expressions that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null stays null.

    A text of one byte per character holds nothing but ASCII, where the full
    ``lower`` does the same and is much faster than ``translate``.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def plain_word_count(text: Column) -> Column:
    """Number of runs free of blanks and \\x09-\\x0D; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
