"""Scalar text functions; all of them stay inside the JVM."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from incident_signals import fixed_values as fixed

# Word boundaries that treat letters and digits of every alphabet alike on every Java version.
WORD_START = r"(?<![\p{L}\p{N}_])"
WORD_END = r"(?![\p{L}\p{N}_])"


@functools.cache
def _ascii_folding() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition restricted to ASCII, derived from the Unicode database.

    Returns source characters, their one-character results, and the characters
    that become several ASCII characters.
    """
    sources, targets, longer = [], [], {}
    for code in range(128, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        folded = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            sources.append(char)
            targets.append(folded)
        elif folded:
            longer[char] = folded
    return "".join(sources), "".join(targets), longer


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ranges(chars: list[str]) -> str:
    """Character class of the given characters, adjacent ones joined to ranges."""
    spans: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if spans and code == spans[-1][1] + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in spans) + "]"


def fold_to_ascii(text: Column) -> Column:
    """Accents removed, compatibility forms spelled out, other non-ASCII characters dropped."""
    sources, targets, longer = _ascii_folding()
    entries = F.create_map(*[F.lit(part) for item in longer.items() for part in item])
    long_class = _ranges(list(longer))

    def spell(value: Column) -> Column:
        # one lookup and one replacement per distinct character of this kind; results are ASCII, so order is free
        found = F.array_distinct(F.regexp_extract_all(value, F.lit(long_class), F.lit(0)))
        return F.aggregate(found, value, lambda spelled, char: F.replace(spelled, char, F.try_element_at(entries, char)))

    foreign = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    spelled = F.when(foreign.rlike(long_class), spell(text)).otherwise(text)
    single = F.regexp_replace(F.translate(spelled, sources, targets), r"[^\x00-\x7F]+", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), single).otherwise(text)


def _expand_abbreviations(plain: Column) -> Column:
    expanded = plain
    for short, full in fixed.pairs(fixed.ABBREVIATIONS):
        expanded = F.regexp_replace(expanded, rf"\b{short}\b", full)
    present = rf"\b(?:{'|'.join(short for short, _ in fixed.pairs(fixed.ABBREVIATIONS))})\b"
    return F.when(plain.rlike(present), expanded).otherwise(plain)


def normalize_text(text: Column) -> Column:
    """Clean report text; a missing text becomes the empty string."""
    plain = F.translate(F.lower(let(F.coalesce(text, F.lit("")), fold_to_ascii)), "\n\r", "  ")
    spelled = let(plain, _expand_abbreviations)
    # dropped punctuation and white space both end as one space
    return F.btrim(F.regexp_replace(spelled, r"[^\w.-]+", " "))


def is_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"^\s*$")


def split_clauses(text: Column) -> Column:
    """Clauses longer than ten characters."""
    parts = F.split(text, r"[.?!;]| but | and | so | while ")
    return F.filter(
        F.transform(parts, lambda part: F.regexp_replace(part, r"^\s+|\s+$", "")),
        lambda part: F.length(part) > fixed.MIN_CLAUSE_LENGTH,
    )


def title_case_sql(text: str) -> str:
    """SQL for upper case after every non-letter and lower case elsewhere."""
    return (
        rf"""array_join(transform(regexp_extract_all({text}, r'\p{{L}}*[^\p{{L}}]|\p{{L}}+', 0),
              p -> concat(upper(left(p, 1)), lower(substr(p, 2)))), '')"""
    )


def title_case(text: Column) -> Column:
    pieces = F.split(text, r"(?<=[^\p{L}])")
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substr(p, F.lit(2))))), "")


def excerpt(text: Column, length: int = fixed.EXCERPT_LENGTH) -> Column:
    shown = F.coalesce(text, F.lit(""))
    return F.concat(F.substring(shown, 1, length), F.when(F.length(shown) > length, "...").otherwise(""))


def clean_entity_name(name: Column) -> Column:
    """Plain name out of a cell that may hold the printed form of a record or list."""
    trimmed = F.btrim(name)
    printed = trimmed.rlike(r"(?s)^(\{.*\}|\[.*\])$")
    first = F.regexp_replace(trimmed, r"^\[\s*", "")
    bare = F.nullif(F.regexp_extract(first, r"""^['"]([^'"]*)['"]""", 1), F.lit(""))

    def field(key: str) -> Column:
        single = F.regexp_extract(first, rf"""^\{{.*?['"]{key}['"]:\s*'([^']*)'""", 1)
        double = F.regexp_extract(first, rf"""^\{{.*?['"]{key}['"]:\s*"([^"]*)\"""", 1)
        return F.coalesce(F.nullif(single, F.lit("")), F.nullif(double, F.lit("")))

    inner = F.coalesce(field("value"), field("rule"), field("name"), bare, trimmed)
    return F.when(name.isNull(), "Unknown").when(printed, F.btrim(inner)).otherwise(trimmed)


def sif_text(prediction: Column) -> Column:
    return F.when(prediction == 1, "SIF-Potential").otherwise("Non-SIF")
