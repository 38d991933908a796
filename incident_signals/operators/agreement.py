"""Agreement of two assessments of the same reports, and checks of cited reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incident_signals.functions.text import sif_text

# Message formats
SIF_CONFLICT = "Legacy classifier predicted %s while the RAG assessment identified %s."
RULE_CONFLICT = "LSR mismatch: Legacy model identified %s whereas RAG assessment identified %s."
CITATION_WARNING = "LLM referenced historical incident %s, which was not present in retrieved context."


def _printed(items: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(F.array_sort(items), "', '"), F.lit("']"))


def consistency(model: DataFrame, other: DataFrame, key: str = "report_id") -> DataFrame:
    """Risk agreement, shared rules and conflicts per report.

    ``model`` has sif_prediction, rules and optionally primary_rule; ``other``
    has sif_potential and rules.  Where one side is missing, all results are null.
    """
    primary = F.array("primary_rule") if "primary_rule" in model.columns else F.array().cast("array<string>")
    given = lambda rules: F.filter(F.coalesce(rules, F.array().cast("array<string>")), lambda r: r.isNotNull())
    left = model.select(
        key,
        F.col("sif_prediction").cast("boolean").alias("_a"),
        F.array_distinct(given(F.concat(F.coalesce("rules", F.array().cast("array<string>")), primary))).alias("_ar"),
    )
    right = other.select(
        key, F.col("sif_potential").cast("boolean").alias("_b"), F.array_distinct(given(F.col("rules"))).alias("_br")
    )
    both = F.col("_ar").isNotNull() & F.col("_br").isNotNull()
    agree = F.col("_a") == F.col("_b")
    disjoint = (F.size("_ar") > 0) & (F.size("_br") > 0) & ~F.arrays_overlap("_ar", "_br")
    text = lambda flag: sif_text(flag.cast("int"))
    conflicts = F.array(
        F.when(~agree, F.format_string(SIF_CONFLICT, text(F.col("_a")), text(F.col("_b")))),
        F.when(disjoint, F.format_string(RULE_CONFLICT, _printed(F.col("_ar")), _printed(F.col("_br")))),
    )
    return left.join(right, key, "full_outer").select(
        key,
        F.when(both, agree).alias("sif_agreement"),
        F.when(both, F.array_sort(F.array_intersect("_ar", "_br"))).alias("lsr_overlap"),
        F.when(both, F.filter(conflicts, lambda c: c.isNotNull())).alias("conflicts"),
    )


def check_citations(citations: DataFrame, allowed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Citations found among ``allowed`` and one warning row per other citation.

    Both tables hold ``keys`` and incident_id.
    """
    on = [*keys, "incident_id"]
    known = allowed.select(*on)
    kept = citations.join(known, on, "left_semi")
    dropped = citations.join(known, on, "left_anti")
    return kept, dropped.withColumn("warning", F.format_string(CITATION_WARNING, F.col("incident_id").cast("string")))
