"""Recurring combinations of dimension values.

All pattern definitions share one scan, one explode and one keyed aggregation.
Counts are first reduced per pattern and site, which both bounds what is
shuffled for a frequent pattern and yields the affected sites without
collecting report rows.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incident_signals import fixed_values as fixed
from incident_signals.functions.numbers import ratio
from incident_signals.functions.text import clean_entity_name, excerpt, title_case
from incident_signals.schema import as_date, short_name, values_of
from incident_signals.session import MAX_BROADCAST_BYTES

ALL_PATTERNS = fixed.PAIR_PATTERNS + fixed.TRIPLE_PATTERNS
KEY = ["pattern_type", "a", "b", "c"]
# What a row of a few short strings takes beside its letters, about.
_ROW_BYTES = 100


def available(df: DataFrame, definitions) -> list[tuple[str, list[str]]]:
    """Definitions whose columns all exist."""
    return [(kind, columns) for kind, columns in definitions if all(name in df.columns for name in columns)]


def _sides(kind: str, columns: list[str]) -> Column:
    """The value arrays whose combinations a definition counts; a pair has one empty third value."""
    third = F.col(f"_values_{columns[2]}") if len(columns) > 2 else F.array(F.lit(None).cast("string"))
    return F.named_struct(
        F.lit("pattern_type"), F.lit(kind),
        F.lit("_a"), F.col(f"_values_{columns[0]}"),
        F.lit("_b"), F.col(f"_values_{columns[1]}"),
        F.lit("_c"), third,
    )


def pattern_rows(df: DataFrame, definitions, keep: list[Column], unique_ids: bool = True) -> DataFrame:
    """One row per report and combination, carrying ``keep``."""
    definitions = available(df, definitions)
    names = list(dict.fromkeys(name for _, columns in definitions for name in columns))
    values = [F.transform(values_of(df, n), lambda v: v.cast("string")).alias(f"_values_{n}") for n in names]
    kept = df.select(F.col("report_id").alias("_id"), *keep, *values)
    carried = [name for name in kept.columns if not name.startswith("_values_")]
    # plain explodes, one per side: they all stay in one generated stage with the partial aggregation
    rows = kept.select(*carried, F.inline(F.array(*[_sides(kind, cols) for kind, cols in definitions])))
    rows = rows.select(*carried, "pattern_type", F.explode("_a").alias("a"), "_b", "_c")
    rows = rows.select(*carried, "pattern_type", "a", F.explode("_b").alias("b"), "_c")
    rows = rows.select(*carried, *KEY[:3], F.explode("_c").alias("c"))
    return rows if unique_ids else rows.dropDuplicates(["_id", *KEY])


def _components(definitions) -> tuple[Column, Column]:
    """Component map, and the values in sorted key order, for the pattern type of a row."""
    names, orders = [], []
    for kind, columns in definitions:
        keys = [short_name(column) for column in columns]
        names += [F.lit(kind), F.array(*[F.lit(key) for key in keys])]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        orders += [F.lit(kind), F.array(*[F.lit(i + 1) for i in order])]
    values = F.filter(F.array("a", "b", "c"), lambda value: value.isNotNull())
    components = F.map_from_arrays(F.element_at(F.create_map(*names), F.col("pattern_type")), values)
    in_key_order = F.transform(
        F.element_at(F.create_map(*orders), F.col("pattern_type")), lambda i: F.element_at(values, i)
    )
    return components, in_key_order


def pattern_id(kind: Column, values_in_key_order: Column) -> Column:
    """Type and values, lower case, blanks and slashes as underscores."""
    parts = F.transform(values_in_key_order, lambda value: F.translate(F.lower(value), " /", "__"))
    return F.concat_ws("__", kind, parts)


def pattern_label(components: Column) -> Column:
    """``Key: Value | Key: Value`` with title-cased keys."""
    return F.array_join(
        F.transform(
            F.map_entries(components),
            lambda e: F.concat(title_case(F.translate(e["key"], "_", " ")), F.lit(": "), clean_entity_name(e["value"])),
        ),
        " | ",
    )


def short_label(components: Column) -> Column:
    return F.array_join(F.transform(F.map_values(components), clean_entity_name), " + ")


def _order_code(df: DataFrame) -> Column:
    """A number that never falls as the report id rises: the id itself, or of texts seven bytes behind what all begin with.

    Least texts per group can only be found by sorting, least numbers while hashing.
    """
    if not isinstance(df.schema["report_id"].dataType, T.StringType):
        return F.col("report_id")
    ends = df.agg(F.min("report_id"), F.max("report_id")).first()
    # what the first and the last id begin with, all between them begin with
    shared = len(os.path.commonprefix([(end or "").encode() for end in ends]))
    part = F.rpad(F.substring(F.hex("report_id"), 2 * shared + 1, 14), 14, "0")
    return F.conv(part, 16, 10).cast("bigint")


def count_patterns(
    df: DataFrame,
    min_support: int = fixed.MIN_PATTERN_SUPPORT,
    definitions=ALL_PATTERNS,
    windows: dict[str, Column] | None = None,
    unique_ids: bool = True,
    bounds: bool = False,
) -> DataFrame:
    """Pattern statistics with at least ``min_support`` occurrences.

    ``windows`` adds one conditional count per entry, a condition over ``_date``;
    ``bounds`` adds ``_upto``, which the order codes of a pattern's examples cannot
    exceed: as many sites as there are examples have a report up to it.  Null is no
    bound.
    """
    windows = windows or {}
    used = available(df, definitions)
    keep = [F.col("site").alias("_site"), as_date(df).alias("_date"), F.col("sif_prediction"), F.col("sif_probability")]
    keep += [_order_code(df).alias("_code")] if bounds else []
    rows = pattern_rows(df, definitions, keep, unique_ids)
    per_site = rows.groupBy(*KEY, "_site").agg(
        F.count("_id").alias("n"),
        F.sum("sif_prediction").alias("sif"),
        F.sum("sif_probability").alias("p_sum"),
        F.count("sif_probability").alias("p_n"),
        F.min("_date").alias("first"),
        F.max("_date").alias("last"),
        *[F.count_if(condition).alias(name) for name, condition in windows.items()],
        *([F.min("_code").alias("least")] if bounds else []),
    )
    least = F.get(F.array_sort(F.collect_list("least")), F.lit(fixed.EXAMPLE_COUNT - 1)) if bounds else None
    counts = (
        per_site.groupBy(*KEY)
        .agg(
            F.sum("n").alias("occurrences"),
            F.coalesce(F.sum("sif"), F.lit(0)).cast("bigint").alias("sif_count"),
            F.try_divide(F.sum("p_sum"), F.sum("p_n")).alias("p"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.array_sort(F.collect_list("_site")).alias("affected_sites"),
            *[F.sum(name).alias(name) for name in windows],
            *([least.alias("_upto")] if bounds else []),
        )
        .where(F.col("occurrences") >= min_support)
    )
    components, in_key_order = _components(used)
    occurrences, sif = F.col("occurrences"), F.col("sif_count")
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return counts.select(
        pattern_id(F.col("pattern_type"), in_key_order).alias("pattern_id"),
        "pattern_type",
        components.alias("components"),
        "occurrences",
        "sif_count",
        (occurrences - sif).alias("non_sif_count"),
        ratio(sif, occurrences).alias("sif_density"),
        F.round("p", 4).alias("avg_sif_probability"),
        ratio(occurrences, total).alias("support_ratio"),
        F.size("affected_sites").alias("affected_site_count"),
        "affected_sites",
        F.struct(F.col("first").cast("string").alias("min"), F.col("last").cast("string").alias("max")).alias(
            "date_range"
        ),
        F.when(occurrences < fixed.LOW_PATTERN_SUPPORT, F.array(F.lit("LOW_PATTERN_SUPPORT")))
        .otherwise(F.array().cast("array<string>"))
        .alias("data_quality_warnings"),
        *windows,
        "a",
        "b",
        "c",
        *(["_upto"] if bounds else []),
    )


def _up_to(rows: DataFrame, keyed: DataFrame, code: str = "report_id") -> DataFrame:
    """Rows that can be examples: up to their pattern's bound.  All of them if the bounds are too large to be sent to every task."""
    bounds = keyed.groupBy(*KEY).agg(F.when(F.count("_upto") == F.count(F.lit(1)), F.max("_upto")).alias("_upto"))
    letters = sum((F.length(F.coalesce(name, F.lit(""))) for name in KEY), F.lit(0))
    size = keyed.agg(F.sum(4 * letters + _ROW_BYTES)).first()[0] or 0
    if size > MAX_BROADCAST_BYTES:
        return rows
    near = rows.join(F.broadcast(bounds), KEY)
    return near.where(F.col("_upto").isNull() | F.col(code).isNull() | (F.col(code) <= F.col("_upto"))).drop("_upto")


def with_examples(patterns: DataFrame, df: DataFrame, definitions=ALL_PATTERNS, unique_ids: bool = True) -> DataFrame:
    """Adds the first report ids of each pattern and excerpts of the first descriptions.

    The rank limit is applied before the shuffle as well (window group limit), so
    a frequent pattern sends at most five rows per task.  Patterns counted with
    ``bounds``, which should be at rest, spare the rest of their rows the sort.
    """
    bounded = "_upto" in patterns.columns
    code = [_order_code(df).alias("_code")] if bounded else []
    rows = pattern_rows(df, definitions, code, unique_ids).select(
        *KEY[:3], F.coalesce("c", F.lit("")).alias("c"), F.col("_id").alias("report_id"), *(["_code"] if bounded else [])
    )
    keyed = patterns.withColumn("c", F.coalesce("c", F.lit("")))
    if bounded:
        rows = _up_to(rows, keyed, "_code").drop("_code")
        keyed = keyed.drop("_upto")
    order = Window.partitionBy(*KEY).orderBy("report_id")
    first = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= fixed.EXAMPLE_COUNT)
    wanted = first.join(keyed.select(*KEY), KEY, "left_semi")
    shown = F.lit("")
    if "description" in df.columns:
        # a few ids per pattern pick the texts before any of them is moved
        texts = df.select("report_id", excerpt(F.col("description")).alias("text")).join(
            wanted.select("report_id").distinct(), "report_id", "left_semi"
        )
        wanted = wanted.join(texts, "report_id", "left")
        shown = F.coalesce("text", F.lit(""))
    examples = wanted.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("rank", "report_id", shown.alias("description_excerpt")))).alias("e")
    )
    return (
        keyed.join(examples, KEY, "left")
        .withColumn("example_report_ids", F.col("e.report_id"))
        .withColumn(
            "example_reports",
            F.transform(F.slice("e", 1, fixed.EXCERPT_COUNT), lambda x: x.dropFields("rank")),
        )
        .drop("e")
    )


def published(patterns: DataFrame) -> DataFrame:
    return patterns.drop("a", "b", "c")


def mine_pairs(df: DataFrame, min_support: int = fixed.MIN_PATTERN_SUPPORT, **options) -> DataFrame:
    return count_patterns(df, min_support, fixed.PAIR_PATTERNS, **options)


def mine_triples(df: DataFrame, min_support: int = fixed.MIN_PATTERN_SUPPORT, **options) -> DataFrame:
    return count_patterns(df, min_support, fixed.TRIPLE_PATTERNS, **options)


def cross_site(patterns: DataFrame, min_sites: int = fixed.CROSS_SITE_MINIMUM) -> DataFrame:
    return patterns.where(F.col("affected_site_count") >= min_sites)


def select_patterns(
    patterns: DataFrame,
    min_occurrences: int | None = None,
    site: str | None = None,
    pattern_type: str | None = None,
    min_density: float | None = None,
) -> DataFrame:
    """Any combination of the four filters."""
    if min_occurrences is not None:
        patterns = patterns.where(F.col("occurrences") >= min_occurrences)
    if site is not None:
        patterns = patterns.where(F.array_contains("affected_sites", site))
    if pattern_type is not None:
        patterns = patterns.where(F.col("pattern_type") == pattern_type)
    if min_density is not None:
        patterns = patterns.where(F.col("sif_density") >= min_density)
    return patterns


def pattern_by_id(patterns: DataFrame, wanted: str) -> DataFrame:
    return patterns.where(F.col("pattern_id") == wanted)
