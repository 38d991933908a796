"""Densities, profiles, summary and audit over the derived reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incident_signals.catalog.adapter import REPORTS_SQL, TRUTH_SQL, dims_sql, reports, with_sql
from incident_signals.catalog.registry import query
from incident_signals.operators import density as d
from incident_signals.operators import profiles as p
from incident_signals.operators import summary as s

ACTIVITY, HAZARDS = "predicted_activity", "predicted_hazards"
BARRIERS, RULES = "predicted_barrier_failures", "predicted_lsr"
TAGS, CONSEQUENCES = "predicted_precursor_tags", "predicted_potential_consequences"

DENSITY_SELECT = """count(sif_prediction) AS total_reports, CAST(sum(sif_prediction) AS BIGINT) AS sif_count,
  count(sif_prediction) - CAST(sum(sif_prediction) AS BIGINT) AS non_sif_count,
  round(CAST(sum(sif_prediction) AS DOUBLE) / count(sif_prediction), 4) AS sif_density,
  round(avg(sif_probability), 4) AS avg_sif_probability,
  CASE WHEN count(sif_prediction) < 10 THEN 'LOW_SAMPLE_SIZE' ELSE '' END AS data_quality_warnings"""


def flat(df: DataFrame) -> DataFrame:
    return df.withColumn("data_quality_warnings", F.array_join("data_quality_warnings", ","))


def density_sql(column: str) -> str:
    return (
        with_sql(REPORTS_SQL, dims_sql(column))
        + f"SELECT value AS name, {DENSITY_SELECT} FROM dims JOIN reports USING (report_id) GROUP BY value"
    )


def _scalar(column: str):
    sql = with_sql(REPORTS_SQL) + f"SELECT {column} AS name, {DENSITY_SELECT} FROM reports GROUP BY {column}"
    query(f"d1_density_by_{column}", sql)(
        lambda spark, sf: d.ranked(flat(d.density(reports(spark, sf), column)))
    )


for _column in ("site", "location", "report_type"):
    _scalar(_column)


def _listed(column: str):
    query(f"d2_density_by_{column.removeprefix('predicted_')}", density_sql(column))(
        lambda spark, sf: d.ranked(flat(d.density(reports(spark, sf, column), column)))
    )


EVERY = [ACTIVITY, HAZARDS, BARRIERS, RULES, TAGS, CONSEQUENCES, "predicted_equipment"]

for _column in EVERY:
    _listed(_column)


@query(
    "d2_density_all_dimensions",
    with_sql(REPORTS_SQL, dims_sql(*EVERY))
    + f"SELECT dim, value AS name, {DENSITY_SELECT} FROM dims JOIN reports USING (report_id) GROUP BY dim, value",
)
def density_all(spark, sf):
    columns = EVERY
    return flat(d.density_of_all(reports(spark, sf, *columns), columns))


@query(
    "d3_probability_by_hazard",
    with_sql(REPORTS_SQL, dims_sql(HAZARDS))
    + """SELECT value AS name, count(sif_probability) AS count, round(avg(sif_probability), 4) AS avg_sif_probability,
       round(max(sif_probability), 4) AS max_sif_probability
       FROM dims JOIN reports USING (report_id) GROUP BY value""",
)
def probability_by_hazard(spark, sf):
    return d.probability_by(reports(spark, sf, HAZARDS), HAZARDS)


@query(
    "d4_top5_by_dimension",
    with_sql(REPORTS_SQL, dims_sql(*EVERY))
    + f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY total_reports DESC, name) AS rank
       FROM (SELECT dim, value AS name, {DENSITY_SELECT} FROM dims JOIN reports USING (report_id) GROUP BY dim, value))
       WHERE rank <= 5""",
)
def top_by_dimension(spark, sf):
    columns = EVERY
    top = d.top_by_volume_per_dimension(d.density_of_all(reports(spark, sf, *columns), columns))
    return flat(top).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "d5_top_sites_by_density",
    with_sql(REPORTS_SQL)
    + f"""SELECT * FROM (SELECT site AS name, {DENSITY_SELECT} FROM reports GROUP BY site) WHERE total_reports >= 10
       ORDER BY sif_density DESC, total_reports DESC, name LIMIT 5""",
)
def top_sites(spark, sf):
    return flat(d.top_by_density(d.density(reports(spark, sf), "site"), min_sample=10))


@query(
    "d7_reports_per_month",
    with_sql(REPORTS_SQL)
    + """SELECT site AS name, round(count(date) / greatest(1.0, date_diff('day', min(date), max(date)) / 30.0), 2)
       AS reports_per_month FROM reports GROUP BY site""",
)
def site_rate(spark, sf):
    return p.site_profile(reports(spark, sf)).select("name", "reports_per_month")


@query(
    "d13_affected_sites_by_hazard",
    with_sql(REPORTS_SQL, dims_sql(HAZARDS))
    + """SELECT value AS name, string_agg(DISTINCT site, ',' ORDER BY site) AS affected_sites,
       count(DISTINCT site) AS affected_site_count FROM dims JOIN reports USING (report_id) GROUP BY value""",
)
def sites_of_hazards(spark, sf):
    found = p.affected_sites(reports(spark, sf, HAZARDS), HAZARDS)
    return found.select(
        "name", F.array_join("affected_sites", ",").alias("affected_sites"), F.col("affected_site_count").cast("bigint").alias("affected_site_count")
    )


@query(
    "d12_hazards_within_activity",
    with_sql(REPORTS_SQL, dims_sql(ACTIVITY, HAZARDS))
    + """SELECT a.value AS anchor, b.value AS value, count(sif_prediction) AS total_reports,
       CAST(sum(sif_prediction) AS BIGINT) AS sif_count, round(avg(sif_probability), 4) AS avg_sif_probability
       FROM dims a JOIN dims b ON a.report_id = b.report_id AND a.dim = 'predicted_activity' AND b.dim = 'predicted_hazards'
       JOIN reports r ON r.report_id = a.report_id GROUP BY 1, 2""",
)
def hazards_within_activity(spark, sf):
    counts = p.pair_counts(reports(spark, sf, ACTIVITY, HAZARDS), ACTIVITY, [HAZARDS])
    return counts.where(F.col("dim") == HAZARDS).select(
        "anchor", "value", "total_reports", "sif_count", F.round("avg_sif_probability", 4).alias("avg_sif_probability")
    )


def profile_sql(anchor: str, leading: dict[str, str], sites: str | None, rate: bool = False) -> str:
    """Independent form: one ranked list per dimension, aggregated to text."""
    columns = [c for c in dict.fromkeys([anchor, *leading.values()]) if c != "site"]
    anchors = (
        "SELECT report_id, site AS anchor FROM reports"
        if anchor == "site"
        else f"SELECT report_id, value AS anchor FROM dims WHERE dim = '{anchor}'"
    )
    lists = ", ".join(
        f"""(SELECT string_agg(value || ':' || total, ', ' ORDER BY rank) FROM tops
             WHERE tops.anchor = base.name AND dim = '{dim}' AND rank <= 5) AS {output}"""
        for output, dim in leading.items()
    )
    site_columns = (
        f"""(SELECT string_agg(DISTINCT site, ',' ORDER BY site) FROM anchored
             WHERE anchored.anchor = base.name) AS {sites}, """
        if sites
        else ""
    )
    rate_column = (
        """round(count(date) / greatest(1.0, date_diff('day', min(date), max(date)) / 30.0), 2) AS reports_per_month,"""
        if rate
        else ""
    )
    return (
        with_sql(REPORTS_SQL, dims_sql(*columns))
        + f""", anchored AS (SELECT a.anchor, r.* FROM ({anchors}) a JOIN reports r USING (report_id)),
        base AS (SELECT anchor AS name, {rate_column} {DENSITY_SELECT} FROM anchored GROUP BY anchor),
        tops AS (SELECT *, row_number() OVER (PARTITION BY anchor, dim ORDER BY total DESC, value) AS rank
          FROM (SELECT anchor, dim, value, count(sif_prediction) AS total FROM anchored JOIN dims USING (report_id)
                GROUP BY anchor, dim, value))
        SELECT base.*, {site_columns} {lists} FROM base"""
    )


def flat_profile(df: DataFrame, leading: list[str], sites: str | None) -> DataFrame:
    for name in leading:
        df = df.withColumn(
            name, F.array_join(F.transform(name, lambda x: F.concat_ws(":", x["name"], x["total_reports"])), ", ")
        )
    if sites:
        df = df.withColumn(sites, F.array_join(sites, ",")).drop(sites.replace("sites", "site_count"))
    return flat(df)


def _profile(name: str, anchor: str, function, leading: dict[str, str], sites: str | None = None):
    columns = [c for c in dict.fromkeys([anchor, *leading.values()]) if c != "site"]
    query(name, profile_sql(anchor, leading, sites, rate=anchor == "site"))(
        lambda spark, sf: flat_profile(function(reports(spark, sf, *columns)), list(leading), sites).drop("label")
    )


_profile("d6_site_profile", "site", p.site_profile,
         {"top_activities": ACTIVITY, "top_hazards": HAZARDS, "top_barriers": BARRIERS, "top_lsr": RULES,
          "top_precursor_tags": TAGS})
_profile("d8_activity_profile", ACTIVITY, p.activity_profile,
         {"common_hazards": HAZARDS, "common_barriers": BARRIERS, "common_lsr": RULES}, "affected_sites")
_profile("d9_rule_profile", RULES, p.rule_profile,
         {"associated_activities": ACTIVITY, "common_barriers": BARRIERS}, "associated_sites")
_profile("d10_hazard_profile", HAZARDS, p.hazard_profile,
         {"associated_activities": ACTIVITY, "associated_barriers": BARRIERS}, "associated_sites")
_profile("d10_barrier_profile", BARRIERS, p.barrier_profile,
         {"associated_activities": ACTIVITY, "associated_hazards": HAZARDS}, "affected_sites")
_profile("d11_consequence_profile", CONSEQUENCES, p.consequence_profile,
         {"associated_hazards": HAZARDS, "associated_barriers": BARRIERS, "affected_activities": ACTIVITY})

SITE_TABLE_SQL = f"site_table AS (SELECT site AS name, {DENSITY_SELECT} FROM reports GROUP BY site)"


def _first(source: str, order: str) -> str:
    return f"(SELECT name FROM {source} ORDER BY {order} LIMIT 1)"


SUMMARY_SQL = (
    with_sql(REPORTS_SQL, dims_sql(ACTIVITY, HAZARDS, BARRIERS, RULES), SITE_TABLE_SQL)
    + """, value_table AS (SELECT dim, value AS name, count(*) AS total_reports FROM dims GROUP BY dim, value)
    SELECT (SELECT count(*) FROM reports) AS total_reports,
      (SELECT CAST(sum(sif_prediction) AS BIGINT) FROM reports) AS total_predicted_sif_reports,
      (SELECT round(CAST(sum(sif_prediction) AS DOUBLE) / count(*), 4) FROM reports) AS overall_sif_density,
      (SELECT round(avg(sif_probability), 4) FROM reports) AS avg_sif_probability,"""
    + _first("site_table", "total_reports DESC, name") + " AS highest_volume_site,"
    + _first("site_table", "sif_count DESC, total_reports DESC, name") + " AS highest_sif_count_site,"
    + _first("site_table WHERE total_reports >= 10", "sif_density DESC, total_reports DESC, name")
    + " AS highest_sif_density_site_with_adequate_sample,"
    + _first("site_table", "sif_density DESC, total_reports DESC, name")
    + " AS highest_sif_density_site_unrestricted,"
    + ", ".join(
        _first(f"value_table WHERE dim = '{dim}'", "total_reports DESC, name") + f" AS {name}"
        for name, dim in {"most_frequent_activity": ACTIVITY, "most_frequent_lsr": RULES,
                          "most_frequent_hazard": HAZARDS, "most_frequent_barrier_failure": BARRIERS}.items()
    )
)


@query("d14_overall_summary", SUMMARY_SQL)
def summary(spark, sf):
    return s.overall_summary(reports(spark, sf, ACTIVITY, HAZARDS, BARRIERS, RULES))


@query(
    "d15_audit",
    """SELECT count(*) AS row_count, count(*) FILTER (WHERE text IS NULL) AS missing_descriptions,
    count(*) - count(DISTINCT doc_id) AS duplicate_report_ids FROM documents""",
)
def audit_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    renamed = docs.select(F.col("doc_id").alias("report_id"), F.col("text").alias("description"))
    return s.audit(renamed, ["report_id", "description"])


@query(
    "d15_relative_frequency",
    with_sql(REPORTS_SQL, TRUTH_SQL)
    + """, cells AS (SELECT 'sif_label' AS field, CAST(sif_label AS VARCHAR) AS value FROM reports
      UNION ALL SELECT 'report_type', report_type FROM reports
      UNION ALL SELECT 'location', location FROM reports
      UNION ALL SELECT 'activity', activity FROM truths)
    SELECT field, value, count(*) AS n,
      round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY field), 6) AS share
    FROM cells WHERE value IS NOT NULL GROUP BY field, value""",
)
def frequencies(spark, sf):
    df = reports(spark, sf, ACTIVITY, truth=True)
    return s.relative_frequency(df, ["sif_label", "report_type", "location", "activity"])
