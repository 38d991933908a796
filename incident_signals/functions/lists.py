"""Multi-valued cells: parsing, de-duplication and rule tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from incident_signals import fixed_values as fixed

_NO_ITEMS = "array<string>"


def empty_list() -> Column:
    return F.array().cast(_NO_ITEMS)


def _is_empty_cell(cell: Column) -> Column:
    return cell.isNull() | F.btrim(cell).isin("", "null")


def parse_list(cell: Column) -> Column:
    """JSON list cell to an array; a bare scalar is a list of one, damaged text is no list."""
    items = F.from_json(cell, _NO_ITEMS)
    scalar = F.try_variant_get(F.try_parse_json(cell), "$", "string")
    return (
        F.when(_is_empty_cell(cell), empty_list())
        .when(items.isNotNull(), F.filter(items, lambda item: item.isNotNull()))
        .when(scalar.isNotNull(), F.array(scalar))
        .otherwise(empty_list())
    )


def is_malformed_list(cell: Column) -> Column:
    return ~_is_empty_cell(cell) & F.try_parse_json(cell).isNull()


def distinct_items(items: Column) -> Column:
    """Trimmed, non-blank, first occurrence kept."""
    trimmed = F.transform(items, lambda item: F.btrim(item))
    return F.array_distinct(F.filter(trimmed, lambda item: item.isNotNull() & (item != "")))


def parse_rule_tags(cell: Column, valid: list[str] = fixed.LIFE_SAVING_RULES) -> Column:
    """Rule tags joined by ``|``, as a JSON or quoted list, or single; unknown tags are dropped."""
    quoted = F.coalesce(F.from_json(cell, _NO_ITEMS), F.from_json(F.translate(cell, "'", '"'), _NO_ITEMS))
    tags = (
        F.when(cell.isNull() | cell.isin("", "None"), empty_list())
        .when(F.contains(cell, F.lit("|")), F.transform(F.split(cell, r"\|"), lambda tag: F.btrim(tag)))
        .when(F.startswith(cell, F.lit("[")), F.coalesce(quoted, empty_list()))
        .otherwise(F.array(F.btrim(cell)))
    )
    known = F.array(*[F.lit(rule) for rule in valid])
    return F.filter(tags, lambda tag: F.array_contains(known, tag))
