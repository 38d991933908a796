"""Report listings, filters, ranking and display tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from incident_signals.catalog.adapter import REPORTS_SQL, TRUTH_SQL, dims_sql, reports, with_sql
from incident_signals.catalog.density_queries import DENSITY_SELECT, SITE_TABLE_SQL, SUMMARY_SQL, flat
from incident_signals.catalog.registry import query
from incident_signals.operators import density as d
from incident_signals.operators import reports as r
from incident_signals.session import new_path
from incident_signals.sources import reports as source
from incident_signals.operators import summary as s

REPORT = "report_id, CAST(date AS VARCHAR) AS date, site, location, report_type, sif_prediction, sif_probability"


def _shown(df):
    return df.select(
        "report_id", F.col("date").cast("string").alias("date"), "site", "location", "report_type", "sif_prediction",
        "sif_probability",
    )


@query("r1_report_page", with_sql(REPORTS_SQL) + f"SELECT {REPORT} FROM reports ORDER BY reports.report_id LIMIT 50 OFFSET 50")
def report_page(spark, sf):
    return _shown(r.page(reports(spark, sf), number=2, size=50))


@query(
    "r1_middle_page",
    with_sql(REPORTS_SQL, "numbered AS (SELECT *, row_number() OVER (ORDER BY report_id) - 1 AS nth, count(*) OVER () AS n FROM reports)")
    + f"SELECT {REPORT} FROM numbered reports WHERE nth >= (n // 2 // 50) * 50 AND nth < (n // 2 // 50) * 50 + 50",
)
def middle_page(spark, sf):
    df = reports(spark, sf)
    return _shown(r.page(df, number=df.count() // 2 // 50 + 1, size=50))


@query(
    "r1_last_page_by_site",
    with_sql(REPORTS_SQL, "numbered AS (SELECT *, row_number() OVER (ORDER BY site, report_id) - 1 AS nth, count(*) OVER () AS n FROM reports)")
    + f"SELECT {REPORT} FROM numbered reports WHERE nth >= ((n - 1) // 50) * 50",
)
def last_page_by_site(spark, sf):
    """Many reports share a site; within it they are ordered by id."""
    df = reports(spark, sf)
    return _shown(r.page(df, number=(df.count() - 1) // 50 + 1, size=50, order="site"))


@query(
    "r1_page_totals",
    with_sql(REPORTS_SQL)
    + "SELECT count(*) AS total_items, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM reports",
)
def totals(spark, sf):
    return r.page_totals(reports(spark, sf), 20)


@query(
    "r2_report_lookup",
    with_sql(REPORTS_SQL, TRUTH_SQL)
    + f"SELECT {REPORT}, sif_label, activity, hazard FROM reports JOIN truths USING (report_id) WHERE report_id = 77",
)
def lookup(spark, sf):
    found = r.report_by_id(reports(spark, sf, truth=True), 77, include_truth=True)
    truth = F.col("ground_truth")
    return found.select(
        *[F.col(c).cast("string").alias(c) if c == "date" else F.col(c)
          for c in ("report_id", "date", "site", "location", "report_type", "sif_prediction", "sif_probability")],
        *[truth[c].alias(c) for c in ("sif_label", "activity", "hazard")],
    )


@query(
    "r3_filtered_reports",
    with_sql(REPORTS_SQL)
    + f"""SELECT {REPORT} FROM reports WHERE site IN ('NATION_1', 'NATION_2', 'NATION_7') AND report_type IN ('F', 'P')
      AND sif_prediction = 1""",
)
def filtered(spark, sf):
    chosen = r.select_reports(reports(spark, sf), ["NATION_1", "NATION_2", "NATION_7"], ["F", "P"], sif=True)
    return _shown(r.most_probable_first(chosen))


def _layout(spark, sf):
    path = new_path(spark, "report-layout")
    source.write_report_layout(reports(spark, sf, truth=True), path)
    return path


@query(
    "r2_lookup_in_layout",
    with_sql(REPORTS_SQL) + f"SELECT {REPORT} FROM reports WHERE report_id = 77",
)
def lookup_in_layout(spark, sf):
    return _shown(r.report_by_id(source.read_report_layout(spark, _layout(spark, sf)), 77))


@query(
    "r3_filter_in_layout",
    with_sql(REPORTS_SQL)
    + f"SELECT {REPORT} FROM reports WHERE site IN ('NATION_3', 'NATION_9') AND date >= DATE '1996-01-01' AND date < DATE '1998-01-01'",
)
def filter_in_layout(spark, sf):
    """Two sites in two years: only those years' folders are read."""
    found = source.read_report_layout(spark, _layout(spark, sf), [1996, 1997])
    return _shown(r.select_reports(found, ["NATION_3", "NATION_9"]))


@query(
    "r4_filter_choices",
    with_sql(REPORTS_SQL)
    + """SELECT DISTINCT 'site' AS field, site AS value FROM reports WHERE site IS NOT NULL
      UNION ALL SELECT DISTINCT 'location', location FROM reports
      UNION ALL SELECT DISTINCT 'report_type', report_type FROM reports""",
)
def choices(spark, sf):
    return r.filter_choices(reports(spark, sf), ["site", "location", "report_type"])


@query("r5_sites_by_probability", with_sql(REPORTS_SQL, SITE_TABLE_SQL) + "SELECT * FROM site_table")
def ranked_sites(spark, sf):
    return r.sites_by(flat(d.density(reports(spark, sf), "site")), "avg_sif_probability")


@query(
    "r6_top_hazards",
    with_sql(REPORTS_SQL, dims_sql("predicted_hazards"))
    + f"""SELECT value AS name, {DENSITY_SELECT} FROM dims JOIN reports USING (report_id) GROUP BY value
      ORDER BY sif_count DESC, total_reports DESC, name LIMIT 8""",
)
def top_hazards(spark, sf):
    return r.top_n(flat(d.density(reports(spark, sf, "predicted_hazards"), "predicted_hazards")), 8)


@query(
    "r6_top_sites",
    with_sql(REPORTS_SQL, SITE_TABLE_SQL)
    + "SELECT * FROM site_table ORDER BY sif_count DESC, total_reports DESC, name LIMIT 10",
)
def top_sites(spark, sf):
    return r.top_n(flat(d.density(reports(spark, sf), "site")), 10)


@query(
    "c14_summary_view",
    "SELECT total_reports, total_predicted_sif_reports AS sif_reports, "
    "total_reports - total_predicted_sif_reports AS non_sif_reports, overall_sif_density AS sif_density, "
    f"avg_sif_probability FROM ({SUMMARY_SQL})",
)
def summary_view(spark, sf):
    columns = ["predicted_activity", "predicted_hazards", "predicted_barrier_failures", "predicted_lsr"]
    return r.summary_view(s.overall_summary(reports(spark, sf, *columns)))


@query(
    "c15_site_view",
    with_sql(REPORTS_SQL, SITE_TABLE_SQL)
    + "SELECT name AS site, total_reports, sif_count AS sif_reports, sif_density FROM site_table",
)
def site_view(spark, sf):
    return r.dimension_view(d.density(reports(spark, sf), "site"), "site")


@query(
    "c15_rule_view",
    with_sql(REPORTS_SQL, dims_sql("predicted_lsr"))
    + """SELECT value AS rule, count(*) AS mapped_reports, CAST(sum(sif_prediction) AS BIGINT) AS sif_reports
      FROM dims JOIN reports USING (report_id) GROUP BY value""",
)
def rule_view(spark, sf):
    return r.rule_view(d.density(reports(spark, sf, "predicted_lsr"), "predicted_lsr"))
