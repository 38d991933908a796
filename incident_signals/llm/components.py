"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incident_signals.session import new_path


# For rows of many MB: a writer looks at its size after each row, not only after a hundred, and a reader holds one row group.
LARGE_ROWS = {
    "parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1",
}


def settled(df: DataFrame, name: str, options: dict[str, str] = {}) -> DataFrame:
    """Written to the shared folder and read again: later reads see one result, whatever executors are lost."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """``id, label`` of every id in ``links`` (``a``, ``b``); the label is the smallest id of its component.

    Each round takes the smallest label among the neighbours, then the label of
    that label, so a chain shrinks by half or more.  Repeated links, links of an
    id with itself and links with a null are harmless; without links there are no rows.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    both = settled(links.union(links.select("b", "a")).distinct(), "links")
    labels = settled(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("_near"))
        )
        lower = labels.join(near, "id").select(
            "id", F.col("label").alias("_old"), F.least("label", "_near").alias("label")
        )
        lower = settled(lower, "labels")
        jumped = lower.join(lower.select(F.col("id").alias("_at"), F.col("label").alias("_next")), F.col("label") == F.col("_at"))
        labels = settled(jumped.select("id", "_old", F.least("label", "_next").alias("label")), "labels")
        changed = labels.where("label <> _old").limit(1).count()
        labels = labels.select("id", "label")
        if not changed:
            return labels
