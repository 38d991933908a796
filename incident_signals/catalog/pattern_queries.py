"""Recurring, cross-site and emerging patterns, priority scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incident_signals import fixed_values as fixed
from incident_signals.catalog.adapter import REPORTS_SQL, dims_sql, reports, with_sql
from incident_signals.catalog.registry import query
from incident_signals.operators import emerging as e
from incident_signals.operators import patterns as p
from incident_signals.operators import reports as r
from incident_signals.operators import scoring as sc
from incident_signals.schema import short_name
from incident_signals.session import cut_lineage

COLUMNS = ["predicted_activity", "predicted_hazards", "predicted_barrier_failures", "predicted_lsr",
           "predicted_precursor_tags"]
SCALARS = ("site", "location")


def mined(spark, sf) -> DataFrame:
    return reports(spark, sf, *COLUMNS)


def flat_patterns(df: DataFrame) -> DataFrame:
    """Nested columns as text, so that rows compare across engines."""
    out = df.withColumn("affected_sites", F.array_join("affected_sites", ","))
    out = out.withColumn("label", p.pattern_label(F.col("components")))
    out = out.withColumn("data_quality_warnings", F.array_join("data_quality_warnings", ","))
    out = out.withColumn("first_date", F.col("date_range.min")).withColumn("last_date", F.col("date_range.max"))
    return out.drop("components", "date_range", "a", "b", "c").withColumn(
        "affected_site_count", F.col("affected_site_count").cast("bigint")
    )


def _side(column: str, alias: str) -> str:
    if column in SCALARS:
        return f"(SELECT report_id, {column} AS value FROM reports) {alias}"
    return f"(SELECT report_id, value FROM dims WHERE dim = '{column}') {alias}"


def _combination(kind: str, columns: list[str]) -> str:
    sides = ["x", "y", "z"][: len(columns)]
    joins = _side(columns[0], "x") + "".join(
        f" JOIN {_side(c, s)} ON {s}.report_id = x.report_id" for c, s in zip(columns[1:], sides[1:])
    )
    keys = [short_name(c) for c in columns]
    ordered = [sides[i] for i in sorted(range(len(keys)), key=keys.__getitem__)]
    pid = " || '__' || ".join(
        [f"'{kind}'"] + [f"replace(replace(lower({s}.value), ' ', '_'), '/', '_')" for s in ordered]
    )
    label = " || ' | ' || ".join(
        f"'{k.replace('_', ' ').title()}: ' || trim({s}.value)" for k, s in zip(keys, sides)
    )
    return f"SELECT '{kind}' AS pattern_type, {pid} AS pattern_id, {label} AS label, x.report_id FROM {joins}"


def combos_sql(definitions) -> str:
    return "combos AS (" + " UNION ALL ".join(_combination(k, c) for k, c in definitions) + ")"


def patterns_sql(definitions, min_support: int) -> str:
    """CTEs up to ``patterns``, in flat form."""
    return with_sql(
        REPORTS_SQL,
        dims_sql(*COLUMNS),
        combos_sql(definitions),
        f"""patterns AS (
      SELECT pattern_id, pattern_type, label, count(*) AS occurrences,
        CAST(sum(sif_prediction) AS BIGINT) AS sif_count, count(*) - CAST(sum(sif_prediction) AS BIGINT) AS non_sif_count,
        round(CAST(sum(sif_prediction) AS DOUBLE) / count(*), 4) AS sif_density,
        round(avg(sif_probability), 4) AS avg_sif_probability,
        round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM reports), 4) AS support_ratio,
        count(DISTINCT site) AS affected_site_count,
        string_agg(DISTINCT site, ',' ORDER BY site) AS affected_sites,
        CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date,
        CASE WHEN count(*) < 10 THEN 'LOW_PATTERN_SUPPORT' ELSE '' END AS data_quality_warnings
      FROM combos JOIN reports USING (report_id) GROUP BY pattern_id, pattern_type, label
      HAVING count(*) >= {min_support})""",
    )


@query("p1_pair_patterns", patterns_sql(fixed.PAIR_PATTERNS, 5) + "SELECT * FROM patterns")
def pairs(spark, sf):
    return flat_patterns(p.mine_pairs(mined(spark, sf)))


@query("p2_pair_patterns_high_support", patterns_sql(fixed.PAIR_PATTERNS, 1200) + "SELECT * FROM patterns")
def frequent_pairs(spark, sf):
    return flat_patterns(p.mine_pairs(mined(spark, sf), min_support=1200))


@query("p3_triple_patterns", patterns_sql(fixed.TRIPLE_PATTERNS, 5) + "SELECT * FROM patterns")
def triples(spark, sf):
    return flat_patterns(p.mine_triples(mined(spark, sf)))


@query("p4_all_patterns", patterns_sql(p.ALL_PATTERNS, 5) + "SELECT * FROM patterns")
def every_pattern(spark, sf):
    return flat_patterns(p.count_patterns(mined(spark, sf)))


@query(
    "p2_pattern_examples",
    patterns_sql(p.ALL_PATTERNS, 5)
    + """, ranked AS (SELECT pattern_id, c.report_id, description,
        row_number() OVER (PARTITION BY pattern_id ORDER BY c.report_id) AS rank
      FROM combos c JOIN reports r ON c.report_id = r.report_id)
    SELECT pattern_id, string_agg(CAST(report_id AS VARCHAR), ',' ORDER BY rank) FILTER (WHERE rank <= 5) AS example_ids,
      string_agg(CAST(report_id AS VARCHAR) || '=' || CASE WHEN length(description) > 120
        THEN substr(description, 1, 120) || '...' ELSE description END, '#' ORDER BY rank) FILTER (WHERE rank <= 3) AS excerpts
    FROM ranked JOIN patterns USING (pattern_id) GROUP BY pattern_id""",
)
def examples(spark, sf):
    df = mined(spark, sf)
    chosen = p.ALL_PATTERNS
    found = p.with_examples(cut_lineage(p.count_patterns(df, definitions=chosen, bounds=True)), df, chosen)
    excerpts = F.transform("example_reports", lambda x: F.concat_ws("=", x["report_id"], x["description_excerpt"]))
    return found.select(
        "pattern_id",
        F.array_join(F.col("example_report_ids").cast("array<string>"), ",").alias("example_ids"),
        F.array_join(excerpts, "#").alias("excerpts"),
    )


@query("p5_cross_site_patterns", patterns_sql(p.ALL_PATTERNS, 5) + "SELECT * FROM patterns WHERE affected_site_count >= 2")
def several_sites(spark, sf):
    return flat_patterns(p.cross_site(p.count_patterns(mined(spark, sf))))


def emerging_sql(period: str, definitions) -> str:
    months = e.MONTHS[period]
    return with_sql(
        REPORTS_SQL,
        dims_sql(*COLUMNS),
        combos_sql(definitions),
        f"""bounds AS (SELECT latest, start, CAST(start - INTERVAL {months} MONTH AS DATE) AS earlier FROM
          (SELECT latest, CAST(latest - INTERVAL {months} MONTH AS DATE) AS start
           FROM (SELECT max(date) AS latest FROM reports)))""",
        f"""changes AS (SELECT pattern_id, pattern_type, '{period}' AS comparison_period,
            start || ' to ' || latest AS current_period, earlier || ' to ' || start AS previous_period,
            count(*) AS occurrences,
            count(*) FILTER (WHERE date >= start AND date <= latest) AS current_count,
            count(*) FILTER (WHERE date >= earlier AND date < start) AS previous_count
          FROM combos JOIN reports USING (report_id), bounds
          GROUP BY pattern_id, pattern_type, start, latest, earlier HAVING count(*) >= 5)""",
        """emerging AS (SELECT *, current_count - previous_count AS absolute_change,
            round((current_count - previous_count) / CAST(nullif(previous_count, 0) AS DOUBLE), 4) AS percentage_change,
            CASE WHEN previous_count = 0 THEN 'NEW_PATTERN'
              WHEN round((current_count - previous_count) / CAST(previous_count AS DOUBLE), 4) >= 1.0 THEN 'EMERGING'
              WHEN current_count > previous_count THEN 'INCREASING'
              WHEN current_count < previous_count THEN 'DECREASING' ELSE 'STABLE' END AS status
          FROM changes WHERE current_count >= 5)""",
    )


def _emerging(spark, sf, period, definitions):
    return e.detect_emerging(mined(spark, sf), period, definitions=definitions).drop("components")


@query("p6_emerging_by_quarter", emerging_sql("quarter", p.ALL_PATTERNS) + "SELECT * FROM emerging")
def emerging_quarter(spark, sf):
    return e.in_status_order(_emerging(spark, sf, "quarter", p.ALL_PATTERNS))


@query("p6_emerging_by_month", emerging_sql("month", p.ALL_PATTERNS) + "SELECT * FROM emerging")
def emerging_month(spark, sf):
    return _emerging(spark, sf, "month", p.ALL_PATTERNS)


@query(
    "p7_emerging_order",
    emerging_sql("quarter", p.ALL_PATTERNS)
    + """SELECT pattern_id, row_number() OVER (ORDER BY CASE status WHEN 'EMERGING' THEN 0 WHEN 'NEW_PATTERN' THEN 1
      WHEN 'INCREASING' THEN 2 WHEN 'STABLE' THEN 3 ELSE 4 END, absolute_change DESC, pattern_type, occurrences DESC,
      pattern_id) AS position FROM emerging""",
)
def emerging_first(spark, sf):
    return e.status_positions(_emerging(spark, sf, "quarter", p.ALL_PATTERNS)).select("pattern_id", "position")


SCORED_SQL = (
    patterns_sql(p.ALL_PATTERNS, 5)
    + """, bounds AS (SELECT min(occurrences) lo, max(occurrences) hi, min(affected_site_count) few,
        max(affected_site_count) many FROM patterns),
    parts AS (SELECT pattern_id, pattern_type, occurrences,
        CASE WHEN hi = lo THEN 0.5 ELSE CAST(occurrences - lo AS DOUBLE) / (hi - lo) END AS frequency,
        CAST(sif_density AS DOUBLE) AS density, CAST(avg_sif_probability AS DOUBLE) AS probability,
        CASE WHEN many = few THEN 0.5 ELSE CAST(affected_site_count - few AS DOUBLE) / (many - few) END AS sites
      FROM patterns, bounds),
    scored AS (SELECT pattern_id, pattern_type, occurrences, round(frequency, 4) AS frequency,
        round(sites, 4) AS cross_site,
        round((CAST(0.2 AS DOUBLE) * frequency + CAST(0.35 AS DOUBLE) * density + CAST(0.25 AS DOUBLE) * probability
          + CAST(0.2 AS DOUBLE) * sites) * 100, 1) AS priority_score FROM parts) """
)


@query("p8_priority_scores", SCORED_SQL + "SELECT * FROM scored")
def scores(spark, sf):
    scored = sc.score_patterns(p.count_patterns(mined(spark, sf)))
    parts = F.col("priority_components")
    return sc.by_priority(scored).select(
        "pattern_id", "pattern_type", "occurrences", parts["frequency"].alias("frequency"),
        parts["cross_site"].alias("cross_site"), "priority_score",
    )


@query(
    "p9_filtered_patterns",
    patterns_sql(fixed.PAIR_PATTERNS, 5)
    + """SELECT * FROM patterns WHERE occurrences >= 20 AND list_contains(string_split(affected_sites, ','), 'NATION_3')
      AND pattern_type = 'hazard_barrier' AND sif_density >= 0.2""",
)
def filtered(spark, sf):
    chosen = p.select_patterns(
        p.count_patterns(mined(spark, sf), definitions=fixed.PAIR_PATTERNS), 20, "NATION_3", "hazard_barrier", 0.2
    )
    return flat_patterns(chosen)


@query(
    "p10_pattern_by_id",
    patterns_sql(fixed.PAIR_PATTERNS, 5) + "SELECT * FROM patterns WHERE pattern_id = 'site_lsr__asia__nation_3'",
)
def by_id(spark, sf):
    return flat_patterns(p.pattern_by_id(p.mine_pairs(mined(spark, sf)), "site_lsr__asia__nation_3"))


@query(
    "p11_status_totals",
    emerging_sql("quarter", p.ALL_PATTERNS) + "SELECT status, count(*) AS patterns FROM emerging GROUP BY status",
)
def totals(spark, sf):
    return e.status_totals(_emerging(spark, sf, "quarter", p.ALL_PATTERNS))


@query(
    "p11_largest_increases",
    emerging_sql("quarter", p.ALL_PATTERNS)
    + """SELECT pattern_id, status, absolute_change FROM emerging WHERE absolute_change > 0
      AND status IN ('EMERGING', 'INCREASING') ORDER BY absolute_change DESC, pattern_id LIMIT 10""",
)
def increases(spark, sf):
    found = e.largest_increases(_emerging(spark, sf, "quarter", p.ALL_PATTERNS), 10, ["EMERGING", "INCREASING"])
    return found.select("pattern_id", "status", "absolute_change")


@query(
    "c16_pattern_view",
    patterns_sql(fixed.PAIR_PATTERNS, 5)
    + """SELECT label AS pattern, occurrences, sif_count AS sif_reports, sif_density,
      replace(affected_sites, ',', ', ') AS affected_sites FROM patterns""",
)
def pattern_table(spark, sf):
    return r.pattern_view(p.mine_pairs(mined(spark, sf)))


@query(
    "c13_short_labels",
    patterns_sql(p.ALL_PATTERNS, 5)
    + """SELECT pattern_id, array_to_string(list_transform(string_split(label, ' | '),
        lambda part: substr(part, instr(part, ': ') + 2)), ' + ') AS label FROM patterns""",
)
def short_labels(spark, sf):
    found = p.count_patterns(mined(spark, sf))
    return found.select("pattern_id", p.short_label(F.col("components")).alias("label"))
