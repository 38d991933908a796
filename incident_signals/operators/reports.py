"""Report listings, lookups, filters and the table feeds of the report views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incident_signals import fixed_values as fixed
from incident_signals.functions.numbers import ratio
from incident_signals.functions.text import clean_entity_name
from incident_signals.operators.patterns import pattern_label

SITE_SORT_KEYS = ["sif_density", "total_reports", "sif_count", "avg_sif_probability"]
TRUTH_COLUMNS = fixed.FORBIDDEN_FEATURE_COLUMNS + ["activity", "equipment"]
# Rows of the range that a page is cut from; larger ranges are narrowed first.
RANGE_ROWS = 65_536
# Splitters of one narrowing step, and the sample that they are drawn from.
SPLITTERS, SAMPLE = 63, 2_048


def _range_number(column: Column, splitters: list, low: int = 0, high: int | None = None) -> Column:
    """2 i for a value between splitters i - 1 and i, 2 i + 1 for splitter i itself, by binary decisions."""
    high = len(splitters) if high is None else high
    if low == high:
        return F.lit(2 * low)
    middle = (low + high) // 2
    return (
        F.when(column < F.lit(splitters[middle]), _range_number(column, splitters, low, middle))
        .when(column == F.lit(splitters[middle]), F.lit(2 * middle + 1))
        .otherwise(_range_number(column, splitters, middle + 1, high))
    )


def _narrowed(df: DataFrame, names: list[str], start: int, most: int) -> tuple[DataFrame, int]:
    """(rows of a range of the order that holds row ``start`` and all after it that ``most`` rows reach, row in the range).

    Each step reads one column: a sample for splitters, then the rows of each
    range between them.  A value that fills a range goes on by the next column.
    """
    if df.count() <= RANGE_ROWS:
        return df, start
    for name in names:
        column = F.col(f"`{name}`")
        while True:
            sample = df.where(column.isNotNull()).select(column.alias("v")).orderBy(F.xxhash64("v", F.monotonically_increasing_id())).limit(SAMPLE)
            values = sorted({r["v"] for r in sample.collect()})
            step = max(1, len(values) // (SPLITTERS + 1))
            splitters = values[step // 2 :: step][: SPLITTERS + 1]
            number = F.when(column.isNull(), F.lit(-1)).otherwise(_range_number(column, splitters))
            counts = sorted((r["number"], r["n"]) for r in df.groupBy(number.alias("number")).agg(F.count(F.lit(1)).alias("n")).collect())
            total = sum(n for _, n in counts)
            if total <= RANGE_ROWS or start >= total:
                return df, start
            before, chosen = 0, []
            for place, n in counts:
                if chosen and before >= start + most:
                    break
                if before + n > start:
                    chosen.append((place, n, before))
                before += n
            first, last = chosen[0], chosen[-1]
            start -= first[2]
            if len(chosen) == 1 and (first[0] < 0 or first[0] % 2 == 1):
                df = df.where(column.isNull() if first[0] < 0 else column == F.lit(splitters[first[0] // 2]))
                break
            low = splitters[(first[0] - 1) // 2] if first[0] > 0 else None
            high = splitters[last[0] // 2] if last[0] // 2 < len(splitters) else None
            bounds = F.lit(True)
            if low is not None:
                bounds = (column >= F.lit(low)) if first[0] % 2 else (column > F.lit(low))
            if high is not None:
                bounds = bounds & ((column <= F.lit(high)) if last[0] % 2 else (column < F.lit(high)))
            if first[0] >= 0:
                df = df.where(column.isNotNull() & bounds)
            elif high is not None:
                df = df.where(column.isNull() | bounds)
            if len(chosen) > 1 or sum(n for _, n, _ in chosen) == total:
                return df, start
    return df, start


def page(df: DataFrame, number: int = 1, size: int = 20, order: str | list[str] = "report_id") -> DataFrame:
    """Reports of one page, ordered, nulls first.

    Rows equal in ``order`` are ordered by report id and then by a hash of all
    columns.  The order's range that holds the page is found from counts of
    ranges, so no more than a few columns are read for it and no table is sorted
    or numbered, however deep the page lies.
    """
    if number < 1 or size < 1:
        raise ValueError("page and page_size must be at least 1")
    names = [order] if isinstance(order, str) else list(order)
    if "report_id" in df.columns and "report_id" not in names:
        names.append("report_id")
    rows, start = _narrowed(df, names, (number - 1) * size, size)
    return rows.orderBy(*[F.col(f"`{n}`") for n in names], F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).offset(start).limit(size)


def page_totals(df: DataFrame, size: int = 20) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(n.alias("total_items"), F.ceil(n / size).cast("bigint").alias("total_pages"))


def report_by_id(df: DataFrame, report_id, include_truth: bool = False) -> DataFrame:
    """One report; truth columns only on request, gathered in one struct."""
    found = df.where(F.col("report_id") == report_id).limit(1)
    truth = [name for name in TRUTH_COLUMNS if name in df.columns]
    kept = [F.col(name) for name in df.columns if name not in truth]
    if include_truth and truth:
        kept.append(F.struct(*truth).alias("ground_truth"))
    return found.select(*kept)


def select_reports(
    df: DataFrame,
    sites: list[str] | None = None,
    report_types: list[str] | None = None,
    sif: bool | None = None,
    primary_rules: list[str] | None = None,
) -> DataFrame:
    """Reports matching all given choices; an empty choice means no restriction."""
    if sites:
        df = df.where(F.col("site").isin(sites))
    if report_types:
        df = df.where(F.col("report_type").isin(report_types))
    if sif is not None:
        df = df.where(F.col("sif_prediction") == (1 if sif else 0))
    if primary_rules:
        df = df.where(F.col("primary_lsr_predicted").isin(primary_rules))
    return df


def most_probable_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("sif_probability"), "report_id")


def filter_choices(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-null values of several columns, from one scan."""
    items = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(items)).where(F.col("value").isNotNull()).distinct().orderBy("field", "value")


def sites_by(densities: DataFrame, sort_by: str) -> DataFrame:
    if sort_by not in SITE_SORT_KEYS:
        raise ValueError(f"Invalid sort_by parameter. Must be one of {SITE_SORT_KEYS}")
    return densities.orderBy(F.desc(sort_by), F.desc("total_reports"), "name")


def top_n(densities: DataFrame, n: int, metric: str = "sif_count") -> DataFrame:
    return densities.orderBy(F.desc(metric), F.desc("total_reports"), "name").limit(n)


def without_truth(df: DataFrame) -> DataFrame:
    """The exportable columns of a report table."""
    return df.drop(*[name for name in TRUTH_COLUMNS if name in df.columns])


def _either(df: DataFrame, *names: str) -> Column:
    present = [F.col(name) for name in names if name in df.columns]
    return F.coalesce(*present) if present else F.lit(None)


def summary_view(summary: DataFrame) -> DataFrame:
    """Key figures; what is missing stays missing."""
    total = _either(summary, "total_reports").cast("bigint")
    sif = _either(summary, "total_predicted_sif_reports", "sif_reports").cast("bigint")
    return summary.select(
        total.alias("total_reports"),
        sif.alias("sif_reports"),
        (total - sif).alias("non_sif_reports"),
        _either(summary, "overall_sif_density", "sif_density").cast("double").alias("sif_density"),
        _either(summary, "avg_sif_probability").cast("double").alias("avg_sif_probability"),
    )


def _density_or_ratio(df: DataFrame, total: str) -> Column:
    return F.coalesce(_either(df, "sif_density").cast("double"), ratio(F.col("sif_count"), F.col(total)), F.lit(0.0))


def dimension_view(densities: DataFrame, label: str) -> DataFrame:
    """Dimension table for display, most risk reports first; ``label`` names the value column."""
    return densities.select(
        clean_entity_name(F.col("name")).alias(label),
        F.coalesce("total_reports", F.lit(0)).alias("total_reports"),
        F.coalesce("sif_count", F.lit(0)).alias("sif_reports"),
        _density_or_ratio(densities, "total_reports").alias("sif_density"),
    ).orderBy(F.desc("sif_reports"), F.desc("total_reports"), label)


def rule_view(densities: DataFrame) -> DataFrame:
    view = dimension_view(densities, "rule")
    return view.select("rule", F.col("total_reports").alias("mapped_reports"), "sif_reports")


def pattern_view(patterns: DataFrame) -> DataFrame:
    """Pattern table for display, most risk reports first."""
    sites = F.nullif(F.array_join("affected_sites", ", "), F.lit(""))
    return patterns.select(
        pattern_label(F.col("components")).alias("pattern"),
        F.coalesce("occurrences", F.lit(0)).alias("occurrences"),
        F.coalesce("sif_count", F.lit(0)).alias("sif_reports"),
        _density_or_ratio(patterns, "occurrences").alias("sif_density"),
        F.coalesce(sites, F.lit("Unspecified")).alias("affected_sites"),
    ).orderBy(F.desc("sif_reports"), F.desc("occurrences"), "pattern")
