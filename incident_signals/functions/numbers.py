"""Ratios, scaling and clean-up of numeric values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(F.try_divide(part, whole), digits)


def share(part: Column, whole: Column) -> Column:
    """Unrounded ratio that is 0 on an empty denominator."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def percent_change(current: Column, previous: Column) -> Column:
    """Relative change, null on a zero base."""
    return F.round(F.try_divide(current - previous, previous), 4)


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scaled to [0, 1]; 0.5 when all values are equal."""
    return F.when(high == low, 0.5).otherwise(F.try_divide(value - low, high - low))


def unit_interval(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))


def finite_or_null(df: DataFrame) -> DataFrame:
    """NaN and infinite values become null in every floating-point column, nested ones too."""
    return df.select(*[_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _finite(value: Column, kind: T.DataType) -> Column:
    """The value with non-finite numbers nulled, inside structs, arrays and map values too."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if not _holds_floats(kind):
        return value
    if isinstance(kind, T.StructType):
        inner = F.struct(*[_finite(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _finite(x, kind.elementType))
    return F.transform_values(value, lambda _, x: _finite(x, kind.valueType))


def _holds_floats(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_floats(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds_floats(kind.elementType)
    if isinstance(kind, T.MapType):
        return _holds_floats(kind.valueType)
    return isinstance(kind, (T.DoubleType, T.FloatType))
