"""Per-value profiles: for each value of an anchor dimension, the leading values of other dimensions.

One scan pairs every anchor value of a report with the report's values in the
other dimensions; one aggregation counts all pairs.  Ranking and nesting then
work on counts only, never on reports.  ``all_profiles`` counts the pairs of all
anchors together.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incident_signals import fixed_values as fixed
from incident_signals.operators.density import density_columns, dimension_items, report_measures
from incident_signals.schema import as_date, values_of
from incident_signals.session import cut_lineage

ITSELF = "itself"
DENSITY_NAMES = ["total_reports", "sif_count", "non_sif_count", "sif_density", "avg_sif_probability",
                 "data_quality_warnings"]


class Profile(NamedTuple):
    """Anchor dimension, output columns with the dimension each one ranks, and the name of the affected-site list."""

    anchor: str
    leading: dict[str, str]
    sites: str | None = None


SITE = Profile("site", {
    "top_activities": "predicted_activity", "top_hazards": "predicted_hazards", "top_barriers": "predicted_barrier_failures",
    "top_lsr": "predicted_lsr", "top_precursor_tags": "predicted_precursor_tags"})
ACTIVITY = Profile("predicted_activity", {
    "common_hazards": "predicted_hazards", "common_barriers": "predicted_barrier_failures", "common_lsr": "predicted_lsr"},
    "affected_sites")
RULE = Profile("predicted_lsr", {
    "associated_activities": "predicted_activity", "common_barriers": "predicted_barrier_failures"}, "associated_sites")
HAZARD = Profile("predicted_hazards", {
    "associated_activities": "predicted_activity", "associated_barriers": "predicted_barrier_failures"}, "associated_sites")
BARRIER = Profile("predicted_barrier_failures", {
    "associated_activities": "predicted_activity", "associated_hazards": "predicted_hazards"}, "affected_sites")
CONSEQUENCE = Profile("predicted_potential_consequences", {
    "associated_hazards": "predicted_hazards", "associated_barriers": "predicted_barrier_failures",
    "affected_activities": "predicted_activity"})


def _dimensions(df: DataFrame, wanted: Profile) -> list[str]:
    named = [*wanted.leading.values(), *(["site"] if wanted.sites else [])]
    return [name for name in dict.fromkeys(named) if name in df.columns]


def shared_pair_counts(df: DataFrame, anchors: dict[str, list[str]], unique_ids: bool = True) -> DataFrame:
    """Measures per (kind, anchor value, dim, value) from one scan and one shuffle.

    ``anchors`` maps each anchor column, the ``kind``, to the dimensions counted
    within its values; an anchor value's own measures have dim ``itself``.
    Dates are summed up where the table has them and ``site`` is an anchor.
    """
    itself = F.array(F.struct(F.lit(ITSELF).alias("dim"), F.lit("").alias("value")))
    sides = []
    for anchor, dimensions in anchors.items():
        present = [name for name in dimensions if name in df.columns]
        items = F.concat(itself, dimension_items(df, present)) if present else itself
        values = F.transform(values_of(df, anchor), lambda value: value.cast("string"))
        sides.append(F.named_struct(F.lit("kind"), F.lit(anchor), F.lit("_anchors"), values, F.lit("_items"), items))
    keep = ["sif_prediction", "sif_probability"] + ([] if unique_ids else ["report_id"])
    dates = []
    if "site" in anchors and "date" in df.columns:
        df = df.withColumn("_date", as_date(df))
        keep.append("_date")
        dates = [F.count("_date").alias("_dated"), F.min("_date").alias("_first"), F.max("_date").alias("_last")]
    rows = df.select(*keep, F.inline(F.array(*sides)))
    rows = rows.select(*keep, "kind", F.explode("_anchors").alias("anchor"), "_items").select(
        *keep, "kind", "anchor", F.inline("_items")
    )
    if not unique_ids:
        rows = rows.dropDuplicates(["report_id", "kind", "anchor", "dim", "value"])
    return rows.groupBy("kind", "anchor", "dim", "value").agg(*report_measures(), *dates)


def pair_counts(df: DataFrame, anchor: str, dimensions: list[str], unique_ids: bool = True) -> DataFrame:
    """Measures per (anchor value, dim, value); the anchor's own measures have dim ``itself``."""
    return shared_pair_counts(df, {anchor: dimensions}, unique_ids).drop("kind")


def reports_per_month(dated: Column, first: Column, last: Column) -> Column:
    months = F.greatest(F.lit(1.0), F.datediff(last, first) / 30.0)
    return F.when(dated > 0, F.round(dated / months, 2)).otherwise(0.0)


def profile(
    df: DataFrame,
    anchor: str,
    leading: dict[str, str],
    sites: str | None = None,
    k: int = fixed.PROFILE_TOP_K,
    unique_ids: bool = True,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Density of each anchor value plus one array of leading values per entry of ``leading``.

    ``leading`` maps output column to dimension; ``sites`` names the affected-site
    list; ``counts`` are this anchor's pair counts where they are there already.
    """
    if counts is None:
        counts = pair_counts(df, anchor, _dimensions(df, Profile(anchor, leading, sites)), unique_ids)
    counts = counts.repartition("anchor")
    order = Window.partitionBy("anchor", "dim").orderBy(F.desc("total_reports"), F.asc("value"))
    ordered = counts.withColumn("_rank", F.row_number().over(order))
    extra = [name for name in counts.columns if name.startswith("_")]
    rows = ordered.select("anchor", "dim", "_rank", F.col("value").alias("name"), *density_columns(), *extra)

    item = F.struct("_rank", "name", *DENSITY_NAMES)
    own = F.col("dim") == ITSELF

    def leaders(dimension: str) -> Column:
        chosen = F.collect_list(F.when((F.col("dim") == dimension) & (F.col("_rank") <= k), item))
        return F.transform(F.array_sort(chosen), lambda x: x.dropFields("_rank"))

    outputs = [F.first(F.when(own, F.col(name)), ignorenulls=True).alias(name) for name in [*DENSITY_NAMES, *extra]]
    if sites:
        outputs.append(F.array_sort(F.collect_list(F.when(F.col("dim") == "site", F.col("name")))).alias(sites))
    outputs += [leaders(dimension).alias(output) for output, dimension in leading.items()]
    wide = rows.groupBy(F.col("anchor").alias("name")).agg(*outputs)
    if sites:
        wide = wide.withColumn(sites.replace("sites", "site_count"), F.size(sites))
    if "_dated" in extra:
        wide = wide.withColumn("reports_per_month", reports_per_month(F.col("_dated"), F.col("_first"), F.col("_last")))
    elif anchor == "site":
        wide = wide.withColumn("reports_per_month", F.lit(0.0))
    return wide.drop(*extra)


def site_profile(df: DataFrame, **options) -> DataFrame:
    return profile(df, *SITE, **options)


def activity_profile(df: DataFrame, **options) -> DataFrame:
    return profile(df, *ACTIVITY, **options)


def rule_profile(df: DataFrame, **options) -> DataFrame:
    return profile(df, *RULE, **options)


def hazard_profile(df: DataFrame, **options) -> DataFrame:
    return profile(df, *HAZARD, **options)


def barrier_profile(df: DataFrame, **options) -> DataFrame:
    return profile(df, *BARRIER, **options)


def consequence_profile(df: DataFrame, **options) -> DataFrame | None:
    """None when the table has no consequences."""
    if CONSEQUENCE.anchor not in df.columns:
        return None
    return profile(df, *CONSEQUENCE, **options).withColumn("label", F.lit("Potential Consequence"))


def all_profiles(df: DataFrame, unique_ids: bool = True, **options) -> dict[str, DataFrame]:
    """The six profiles by published name, from pair counts made once and fixed.

    The counts are as many as pairs of values, however many reports there are.
    """
    makers = {
        "site_analytics": (SITE, site_profile),
        "activity_analytics": (ACTIVITY, activity_profile),
        "lsr_analytics": (RULE, rule_profile),
        "hazard_analytics": (HAZARD, hazard_profile),
        "barrier_analytics": (BARRIER, barrier_profile),
        "consequence_analytics": (CONSEQUENCE, consequence_profile),
    }
    makers = {name: made for name, made in makers.items() if made[0].anchor in df.columns}
    shared = cut_lineage(shared_pair_counts(df, {wanted.anchor: _dimensions(df, wanted) for wanted, _ in makers.values()}, unique_ids))
    dates = [name for name in shared.columns if name.startswith("_")]

    def own(wanted: Profile) -> DataFrame:
        return shared.where(F.col("kind") == wanted.anchor).drop("kind", *([] if wanted is SITE else dates))

    return {name: make(df, counts=own(wanted), **options) for name, (wanted, make) in makers.items()}


def affected_sites(df: DataFrame, column: str, unique_ids: bool = True) -> DataFrame:
    """Sorted site list and site count per value."""
    counts = pair_counts(df, column, ["site"], unique_ids).where(F.col("dim") == "site")
    return (
        counts.groupBy(F.col("anchor").alias("name"))
        .agg(F.array_sort(F.collect_set("value")).alias("affected_sites"))
        .withColumn("affected_site_count", F.size("affected_sites"))
    )
