"""Risk density of reports by dimension.

A report counts once per value: values are made distinct inside the row, so the
only shuffle is the one of the partial aggregates.  Callers whose table repeats
report ids pass ``unique_ids=False``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incident_signals import fixed_values as fixed
from incident_signals.functions.numbers import ratio
from incident_signals.schema import is_list, values_of


def report_measures() -> list[Column]:
    return [
        F.count("sif_prediction").alias("total_reports"),
        F.coalesce(F.sum("sif_prediction"), F.lit(0)).cast("bigint").alias("sif_count"),
        F.avg("sif_probability").alias("avg_sif_probability"),
    ]


def density_columns() -> list[Column]:
    """Published columns, computed from the three measures."""
    return [
        F.col("total_reports"),
        F.col("sif_count"),
        (F.col("total_reports") - F.col("sif_count")).alias("non_sif_count"),
        F.coalesce(ratio(F.col("sif_count"), F.col("total_reports")), F.lit(0.0)).alias("sif_density"),
        F.round("avg_sif_probability", 4).alias("avg_sif_probability"),
        F.when(F.col("total_reports") < fixed.LOW_SAMPLE_SIZE, F.array(F.lit("LOW_SAMPLE_SIZE")))
        .otherwise(F.array().cast("array<string>"))
        .alias("data_quality_warnings"),
    ]


def dimension_items(df: DataFrame, columns: list[str]) -> Column:
    """All (dim, value) pairs of a report as one array."""

    def items(name: str) -> Column:
        return F.transform(
            values_of(df, name),
            lambda value: F.named_struct(F.lit("dim"), F.lit(name), F.lit("value"), value.cast("string")),
        )

    return F.concat(*[items(name) for name in columns])


def long_values(df: DataFrame, columns: list[str], keep: list[str], unique_ids: bool = True) -> DataFrame:
    """One row per report, dimension and value."""
    wanted = list(dict.fromkeys(keep if unique_ids else ["report_id", *keep]))
    if len(columns) == 1 and not is_list(df, columns[0]):
        # a single scalar needs no explode, and its null test reaches the scan
        value = F.col(columns[0])
        plain = df.where(value.isNotNull())
        rows = plain.select(*wanted, F.lit(columns[0]).alias("dim"), value.cast("string").alias("value"))
    else:
        rows = df.select(*wanted, F.inline(dimension_items(df, columns)))
    return rows if unique_ids else rows.dropDuplicates(["report_id", "dim", "value"])


def density(df: DataFrame, column: str, unique_ids: bool = True) -> DataFrame:
    """Totals, density and mean probability per value of a scalar or list column."""
    rows = long_values(df, [column], ["sif_prediction", "sif_probability"], unique_ids)
    return rows.groupBy(F.col("value").alias("name")).agg(*report_measures()).select("name", *density_columns())


def density_of_all(df: DataFrame, columns: list[str], unique_ids: bool = True) -> DataFrame:
    """``density`` of several dimensions from one scan and one shuffle."""
    rows = long_values(df, columns, ["sif_prediction", "sif_probability"], unique_ids)
    return rows.groupBy("dim", F.col("value").alias("name")).agg(*report_measures()).select(
        "dim", "name", *density_columns()
    )


def ranked(densities: DataFrame) -> DataFrame:
    return densities.orderBy(F.desc("total_reports"), F.asc("name"))


def probability_by(df: DataFrame, column: str, unique_ids: bool = True) -> DataFrame:
    """Count, mean and maximum probability per value."""
    rows = long_values(df, [column], ["sif_probability"], unique_ids)
    return (
        rows.groupBy(F.col("value").alias("name"))
        .agg(
            F.count("sif_probability").alias("count"),
            F.round(F.avg("sif_probability"), 4).alias("avg_sif_probability"),
            F.round(F.max("sif_probability"), 4).alias("max_sif_probability"),
        )
        .orderBy(F.desc("avg_sif_probability"), F.asc("name"))
    )


def top_by_volume(densities: DataFrame, k: int = fixed.PROFILE_TOP_K) -> DataFrame:
    return ranked(densities).limit(k)


def top_by_volume_per_dimension(densities: DataFrame, k: int = fixed.PROFILE_TOP_K) -> DataFrame:
    """First k values of every dimension of ``density_of_all``, ranked from 1."""
    order = Window.partitionBy("dim").orderBy(F.desc("total_reports"), F.asc("name"))
    return densities.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_by_density(densities: DataFrame, k: int = fixed.PROFILE_TOP_K, min_sample: int | None = None) -> DataFrame:
    if min_sample is not None:
        densities = densities.where(F.col("total_reports") >= min_sample)
    return densities.orderBy(F.desc("sif_density"), F.desc("total_reports"), F.asc("name")).limit(k)
