"""Consecutive row numbers over a whole table without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incident_signals.session import cut_lineage

_POSITION_BITS = 33


def numbered(df: DataFrame, order: list[str] | None, name: str, start: int = 0) -> DataFrame:
    """Numbers rows ``start, start + 1, ...`` in the given (unique) order, or as they are read.

    With an order, rows are range-partitioned and sorted inside their
    partitions; without one they stay where they are.  The result is fixed by a
    checkpoint, because both reads below must see the same partitions.  A
    partition's offset comes from the partition sizes, one row per partition.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    placed = cut_lineage(ranged.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _POSITION_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    position = F.col("_place").bitwiseAND((1 << _POSITION_BITS) - 1)
    return (
        placed.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(name, F.col("_before") + position + start)
        .drop("_part", "_place", "_before")
    )
