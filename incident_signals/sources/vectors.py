"""The vector table of report texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incident_signals.functions.text import normalize_text
from incident_signals.operators.numbering import numbered
from incident_signals.sources.reports import drop_blank

METADATA = ["report_id", "date", "site", "location", "report_type"]


def build_vectors(df: DataFrame, embedder, text: str = "description") -> DataFrame:
    """Reports with text, cleaned, embedded to unit vectors and numbered 0..n-1 by report id."""
    valid = drop_blank(df, text)
    columns = [F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in METADATA[1:]]
    # numbered before texts are cleaned and vectors made: sorting neither moves them nor computes them twice
    placed = numbered(valid.select("report_id", *columns, F.col(text).alias("_text")), ["report_id"], "vector_id")
    rows = placed.select(
        "report_id", *METADATA[1:], F.regexp_replace("_text", r"^\s+|\s+$", "").alias("description"),
        normalize_text(F.col("_text")).alias("_clean"), "vector_id",
    )
    # a text of nothing but dropped characters stands for itself
    stated = rows.withColumn(
        "clean_description", F.when(F.col("_clean") == "", F.col("description")).otherwise(F.col("_clean"))
    ).drop("_clean")
    embedded = embedder.embed(stated, "clean_description", "embedding")
    return embedded.withColumn("embedding", F.col("embedding").cast("array<float>"))
