"""Column sets and schemas of the report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incident_signals import fixed_values as fixed

RAW_REPORT_SCHEMA = T.StructType(
    [
        T.StructField(
            name,
            T.IntegerType() if name == "sif_label" else T.DoubleType() if name == "sif_potential" else T.StringType(),
        )
        for name in fixed.REQUIRED_RAW_COLUMNS
    ]
)

EXTRACTION_ITEM = "struct<value:string,evidence:string,confidence:string,match_method:string>"


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [name for name in required if name not in df.columns]


def require(df: DataFrame, required: list[str] = fixed.REQUIRED_ENRICHED_COLUMNS) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"the table lacks columns: {missing}")
    return df


def is_list(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.ArrayType)


def values_of(df: DataFrame, name: str) -> Column:
    """Values a report has in a dimension, each once: a list column's items or the scalar itself."""
    if is_list(df, name):
        items = F.filter(F.col(name), lambda item: item.isNotNull() & (item != ""))
        return F.coalesce(F.array_distinct(items), F.array().cast("array<string>"))
    return F.filter(F.array(F.col(name)), lambda item: item.isNotNull())


def short_name(column: str) -> str:
    return column.replace("predicted_", "")


def as_date(df: DataFrame, name: str = "date") -> Column:
    """Report date; text that is no date becomes null."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.col(name).try_cast("date")
    return F.col(name).cast("date")
