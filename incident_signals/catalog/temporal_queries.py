"""Periods, trends and monthly frequencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from incident_signals.catalog.adapter import REPORTS_SQL, dims_sql, reports, table, with_sql
from incident_signals.catalog.registry import query
from incident_signals.operators import temporal as t

PERIOD_SQL = {
    "month": "strftime(date, '%Y-%m')",
    "quarter": "CAST(year(date) AS VARCHAR) || 'Q' || CAST(quarter(date) AS VARCHAR)",
    "year": "CAST(year(date) AS VARCHAR)",
}


def summary_sql(kind: str) -> str:
    return f"""SELECT {PERIOD_SQL[kind]} AS period, '{kind}' AS period_type, count(report_id) AS report_volume,
      CAST(sum(sif_prediction) AS BIGINT) AS sif_count,
      round(CAST(sum(sif_prediction) AS DOUBLE) / count(report_id), 4) AS sif_density,
      round(avg(sif_probability), 4) AS avg_sif_probability FROM reports WHERE date IS NOT NULL GROUP BY 1"""


def _summary(name: str, kind: str):
    query(name, with_sql(REPORTS_SQL) + summary_sql(kind))(lambda spark, sf: t.summary_by(reports(spark, sf), kind))


_summary("t2_monthly_summary", "month")
_summary("t3_quarterly_summary", "quarter")
_summary("t4_yearly_summary", "year")


@query(
    "t1_parsed_dates",
    """SELECT try_cast(substr(url, length(url) - 9, 10) AS DATE) IS NULL AS unparsed, count(*) AS n FROM pages GROUP BY 1
    UNION ALL SELECT try_cast(strftime(ts, '%Y-%m-%d') AS DATE) IS NULL, count(*) FROM events GROUP BY 1""",
)
def parsed(spark, sf):
    from incident_signals.schema import as_date

    urls = table(spark, sf, "pages").select(F.expr("substr(url, length(url) - 9, 10)").alias("date"))
    days = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date"))
    found = [df.groupBy(as_date(df).isNull().alias("unparsed")).agg(F.count(F.lit(1)).alias("n")) for df in (urls, days)]
    return found[0].unionByName(found[1])


@query(
    "t5_monthly_frequency",
    with_sql(REPORTS_SQL, dims_sql(*t.FREQUENCY_DIMENSIONS))
    + """SELECT dim, value AS name, strftime(date, '%Y-%m') AS period, count(*) AS count,
      CAST(sum(sif_prediction) AS BIGINT) AS sif_count FROM dims JOIN reports USING (report_id) GROUP BY 1, 2, 3""",
)
def frequency(spark, sf):
    return t.monthly_frequency(reports(spark, sf, *t.FREQUENCY_DIMENSIONS))


def _trend_columns(metric: str) -> str:
    previous = f"lag({metric}) OVER (PARTITION BY period_type ORDER BY period)"
    return f"""CAST({previous} AS DOUBLE) AS {metric}_previous, CAST(round({metric} - {previous}, 4) AS DOUBLE) AS {metric}_change,
      round(CAST({metric} - {previous} AS DOUBLE) / nullif({previous}, 0), 4) AS {metric}_percent"""


ALL_SQL = " UNION ALL ".join(summary_sql(kind) for kind in PERIOD_SQL)


def flat_trends(df):
    out = [F.col(c) for c in df.columns if c != "trends"]
    for metric in t.METRICS:
        trend = F.col("trends")[metric]
        out += [
            trend["previous_value"].cast("double").alias(f"{metric}_previous"),
            trend["absolute_change"].cast("double").alias(f"{metric}_change"),
            trend["percentage_change"].alias(f"{metric}_percent"),
        ]
    return df.select(*out)


@query(
    "t6_monthly_trends",
    with_sql(REPORTS_SQL, f"periods AS ({summary_sql('month')})")
    + "SELECT *, " + ", ".join(_trend_columns(m) for m in t.METRICS) + " FROM periods",
)
def monthly_trends(spark, sf):
    return flat_trends(t.with_trends(t.summary_by(reports(spark, sf), "month")))


@query(
    "t7_all_periods",
    with_sql(REPORTS_SQL, f"periods AS ({ALL_SQL})")
    + "SELECT *, " + ", ".join(_trend_columns(m) for m in t.METRICS) + " FROM periods",
)
def periods(spark, sf):
    return flat_trends(t.all_periods(reports(spark, sf)))


@query(
    "t7_date_warnings",
    with_sql(REPORTS_SQL)
    + "SELECT CASE WHEN count(date) = 0 THEN 'MISSING_DATE_DATA' ELSE '' END AS data_quality_warnings FROM reports",
)
def warnings(spark, sf):
    return t.date_warnings(reports(spark, sf)).withColumn(
        "data_quality_warnings", F.array_join("data_quality_warnings", ",")
    )
