"""Predicted against truth, label metrics, score metrics and thresholds."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incident_signals import fixed_values as fixed
from incident_signals.catalog.adapter import REPORTS_SQL, TRUTH_SQL, dims_sql, reports, table, with_sql
from incident_signals.catalog.registry import query
from incident_signals.operators import quality as q

PREDICTED = ["predicted_activity", "predicted_hazards", "predicted_barrier_failures"]


def _flat_overlap(df):
    for name in ("predicted_top5", "ground_truth_top5", "overlapping_items"):
        df = df.withColumn(name, F.array_join(name, ","))
    return df.withColumn("overlap_count", F.col("overlap_count").cast("bigint"))


def _overlap_sql(predicted: str, truth: str, dimension: str) -> str:
    return f"""SELECT '{dimension}' AS dimension,
      (SELECT string_agg(name, ',' ORDER BY rank) FROM {predicted}) AS predicted_top5,
      (SELECT string_agg(name, ',' ORDER BY rank) FROM {truth}) AS ground_truth_top5,
      (SELECT count(*) FROM {predicted} JOIN {truth} USING (name)) AS overlap_count,
      round((SELECT count(*) FROM {predicted} JOIN {truth} USING (name)) /
        greatest(1, least(5, (SELECT count(*) FROM {predicted}))), 2) AS overlap_ratio,
      coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM {predicted} JOIN {truth} USING (name)), '') AS overlapping_items"""


def _dimension_sql() -> str:
    ctes, selects = [], []
    for truth, predicted in q.VALIDATED.items():
        for side, source in ((f"p_{truth}", f"SELECT value AS name FROM dims WHERE dim = '{predicted}'"),
                             (f"t_{truth}", f"SELECT {truth} AS name FROM truths WHERE {truth} IS NOT NULL")):
            ctes.append(f"""{side} AS (SELECT name, row_number() OVER (ORDER BY n DESC, name) AS rank
              FROM (SELECT name, count(*) AS n FROM ({source}) GROUP BY name) QUALIFY rank <= 5)""")
        selects.append(_overlap_sql(f"p_{truth}", f"t_{truth}", truth))
    return with_sql(REPORTS_SQL, dims_sql(*PREDICTED), TRUTH_SQL, *ctes) + " UNION ALL ".join(selects)


@query("q1_dimension_overlap", _dimension_sql())
def dimension_overlap(spark, sf):
    return _flat_overlap(q.validate_dimensions(reports(spark, sf, *PREDICTED, truth=True)))


SITES = """sites AS (SELECT site AS name, count(sif_prediction) AS total,
    round(CAST(sum(sif_prediction) AS DOUBLE) / count(sif_prediction), 4) AS p,
    CAST(sum(sif_label) AS DOUBLE) / count(sif_label) AS t FROM reports GROUP BY site),
  p AS (SELECT name, row_number() OVER (ORDER BY p DESC, total DESC, name) AS rank FROM sites QUALIFY rank <= 5),
  t AS (SELECT name, row_number() OVER (ORDER BY t DESC, name) AS rank FROM sites QUALIFY rank <= 5)"""


@query("q2_site_overlap", with_sql(REPORTS_SQL, SITES) + _overlap_sql("p", "t", "site_sif_density"))
def site_overlap(spark, sf):
    return _flat_overlap(q.validate_sites(reports(spark, sf)))


# Truth labels of a report are its first value; predicted labels are all its values.
OUTCOMES_SQL = with_sql(
    dims_sql("predicted_hazards"),
    TRUTH_SQL,
    """outcomes AS (SELECT coalesce(d.report_id, t.report_id) AS report_id, coalesce(d.value, t.hazard) AS label,
      CASE WHEN d.value IS NOT NULL AND t.hazard IS NOT NULL THEN 'tp' WHEN d.value IS NOT NULL THEN 'fp' ELSE 'fn' END AS outcome
      FROM dims d FULL OUTER JOIN (SELECT report_id, CASE WHEN report_id % 3 = 0 THEN 'Brand#1' ELSE hazard END AS hazard
        FROM truths) t ON d.report_id = t.report_id AND d.value = t.hazard)""",
    """counts AS (SELECT label, count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'fp') AS fp,
      count(*) FILTER (WHERE outcome = 'fn') AS fn FROM outcomes GROUP BY label)""",
)


def _outcomes(spark, sf):
    df = reports(spark, sf, "predicted_hazards", truth=True).where(F.col("hazard").isNotNull())
    stated = F.when(F.col("report_id") % 3 == 0, F.lit("Brand#1")).otherwise(F.col("hazard"))
    return q.label_outcomes(df.withColumn("truth", F.array(stated)), "truth", "predicted_hazards")


def _share_sql(part: str, whole: str) -> str:
    return f"coalesce(CAST({part} AS DOUBLE) / nullif({whole}, 0), 0)"


PRF_SQL = f"""round({_share_sql('tp', 'tp + fp')}, 9) AS precision, round({_share_sql('tp', 'tp + fn')}, 9) AS recall,
  round({_share_sql('2 * tp', '2 * tp + fp + fn')}, 9) AS f1"""


def rounded(df, *names, digits=9):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("q3_label_metrics", OUTCOMES_SQL + f"SELECT label, tp, fp, fn, {PRF_SQL}, tp + fn AS support FROM counts")
def label_metrics(spark, sf):
    return rounded(q.label_metrics(_outcomes(spark, sf)), "precision", "recall", "f1")


@query(
    "q3_micro_metrics",
    OUTCOMES_SQL
    + f"""SELECT tp, fp, fn, {PRF_SQL} FROM (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
      CAST(sum(fn) AS BIGINT) AS fn FROM counts)""",
)
def micro_metrics(spark, sf):
    return rounded(q.micro_metrics(_outcomes(spark, sf)), "precision", "recall", "f1")


@query("q3_metrics_of_two_tables", OUTCOMES_SQL + f"SELECT label, tp, fp, fn, {PRF_SQL}, tp + fn AS support FROM counts")
def metrics_of_tables(spark, sf):
    df = reports(spark, sf, "predicted_hazards", truth=True).where(F.col("hazard").isNotNull())
    stated = F.when(F.col("report_id") % 3 == 0, F.lit("Brand#1")).otherwise(F.col("hazard"))
    predicted = df.select("report_id", F.explode("predicted_hazards").alias("label"))
    outcomes = q.outcomes_of_tables(df.select("report_id", stated.alias("label")), predicted)
    return rounded(q.label_metrics(outcomes), "precision", "recall", "f1")


@query(
    "q4_error_samples",
    OUTCOMES_SQL
    + """SELECT report_id, label, outcome, row_number() OVER (PARTITION BY outcome ORDER BY report_id, label) AS rank
      FROM outcomes WHERE outcome != 'tp' QUALIFY rank <= 15""",
)
def samples(spark, sf):
    return q.error_samples(_outcomes(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


GATED = {"activity": "predicted_activity", "equipment_type": "predicted_equipment", "hazard": "predicted_hazards",
         "barrier_failure": "predicted_barrier_failures"}
_GATES = ", ".join(f"('{name}', '{GATED[name]}', {gate})" for name, gate in fixed.READINESS_F1.items())


@query(
    "q5_readiness",
    with_sql(
        dims_sql(*GATED.values()),
        "firsts AS (SELECT report_id, dim, min(value) AS value FROM dims GROUP BY ALL)",
        """counts AS (SELECT dim, count(*) FILTER (WHERE f.value IS NOT NULL) AS tp, count(*) FILTER (WHERE f.value IS NULL) AS fp
          FROM dims LEFT JOIN firsts f USING (report_id, dim, value) GROUP BY dim)""",
        f"""gates AS (SELECT name AS dimension, gate, coalesce(2.0 * tp / nullif(2 * tp + fp, 0), 0) AS f1
          FROM (VALUES {_GATES}) g(name, dim, gate) LEFT JOIN counts USING (dim))""",
    )
    + """SELECT dimension, round(f1, 9) AS f1, f1 >= gate AS passed, (SELECT bool_and(f1 >= gate) FROM gates) AS ready FROM gates""",
)
def ready(spark, sf):
    """All four gates: a report's first value of each dimension against all of its values."""
    df = reports(spark, sf, *GATED.values())
    parts = []
    for name, column in GATED.items():
        held = df.where(F.size(column) > 0).withColumn("truth", F.array(F.array_min(column)))
        parts.append(q.micro_metrics(q.label_outcomes(held, "truth", column)).select(F.lit(name).alias("dimension"), "f1"))
    metrics = functools.reduce(DataFrame.unionByName, parts)
    gate = F.create_map(*[F.lit(part) for item in fixed.READINESS_F1.items() for part in item])[F.col("dimension")]
    ready = q.readiness(metrics).scalar()
    return metrics.select("dimension", F.round("f1", 9).alias("f1"), (F.col("f1") >= gate).alias("passed"), ready.alias("ready"))


LABELS_SQL = "scored AS (SELECT quality AS label, ((doc_id * 37) % 101) / 101.0 * 0.5 + quality * 0.25 AS score FROM labels)"


def _scored(spark, sf):
    """Quality labels with a score that is a fixed function of the document id."""
    return table(spark, sf, "labels").select(
        F.col("quality").alias("label"),
        (((F.col("doc_id") * 37) % 101) / 101.0 * 0.5 + F.col("quality") * 0.25).alias("score"),
    )


RATES_SQL = f"""round({_share_sql('tp + tn', 'tp + fp + tn + fn')}, 9) AS accuracy, {PRF_SQL},
  round({_share_sql('tn', 'tn + fp')}, 9) AS specificity, round({_share_sql('fn', 'fn + tp')}, 9) AS false_negative_rate,
  round({_share_sql('fp', 'fp + tn')}, 9) AS false_positive_rate"""
RATES = ["accuracy", "precision", "recall", "f1", "specificity", "false_negative_rate", "false_positive_rate"]


def _confusion(threshold: str) -> str:
    return f"""count(*) FILTER (WHERE score >= {threshold} AND label = 1) AS tp,
      count(*) FILTER (WHERE score >= {threshold} AND label = 0) AS fp,
      count(*) FILTER (WHERE score < {threshold} AND label = 0) AS tn,
      count(*) FILTER (WHERE score < {threshold} AND label = 1) AS fn"""


@query("q6_binary_metrics", with_sql(LABELS_SQL) + f"SELECT tp, fp, tn, fn, {RATES_SQL} FROM (SELECT {_confusion('0.5')} FROM scored)")
def binary(spark, sf):
    return rounded(q.binary_metrics(_scored(spark, sf), "label", "score", 0.5), *RATES)


@query(
    "q6_report_metrics",
    with_sql(REPORTS_SQL, "scored AS (SELECT sif_label AS label, sif_probability AS score FROM reports)")
    + f"SELECT tp, fp, tn, fn, {RATES_SQL} FROM (SELECT {_confusion('0.5')} FROM scored)",
)
def report_metrics(spark, sf):
    return rounded(q.binary_metrics(reports(spark, sf), "sif_label", "sif_probability", 0.5), *RATES)


AREAS_SQL = """curve AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score),
  cumulated AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
    (SELECT sum(label) FROM scored) AS p, (SELECT sum(1 - label) FROM scored) AS n FROM curve)"""
AREA_SELECT = """SELECT round(CAST(sum(neg * (tp - pos / 2.0)) AS DOUBLE) / CAST(max(p) * max(n) AS DOUBLE), 6) AS roc_auc,
  round(sum(pos * CAST(tp AS DOUBLE) / (tp + fp)) / max(p), 6) AS pr_auc FROM cumulated"""


@query("q7_q8_ranking_metrics", with_sql(LABELS_SQL, AREAS_SQL) + AREA_SELECT)
def ranking(spark, sf):
    return rounded(q.ranking_metrics(_scored(spark, sf), "label", "score"), "roc_auc", "pr_auc", digits=6)


@query(
    "q7_q8_report_ranking_metrics",
    with_sql(REPORTS_SQL, "scored AS (SELECT sif_label AS label, sif_probability AS score FROM reports)", AREAS_SQL)
    + AREA_SELECT,
)
def report_ranking(spark, sf):
    metrics = q.ranking_metrics(reports(spark, sf), "sif_label", "sif_probability")
    return rounded(metrics, "roc_auc", "pr_auc", digits=6)


@query(
    "q9_curve_points",
    with_sql(LABELS_SQL, AREAS_SQL)
    + f"""SELECT round(score, 9) AS threshold, round({_share_sql('fp', 'n')}, 9) AS false_positive_rate,
      round({_share_sql('tp', 'p')}, 9) AS true_positive_rate, round({_share_sql('tp', 'tp + fp')}, 9) AS precision,
      round({_share_sql('tp', 'p')}, 9) AS recall FROM cumulated""",
)
def points(spark, sf):
    found = q.curve_points(_scored(spark, sf), "label", "score")
    return rounded(found, *found.columns)


GRID_SQL = "(VALUES " + ", ".join(f"({t})" for t in fixed.SIF_THRESHOLD_GRID) + ") g(threshold)"
GRID_TABLE = f"""grid AS (SELECT CAST(threshold AS DOUBLE) AS threshold, {_confusion('CAST(threshold AS DOUBLE)')}
  FROM scored, {GRID_SQL} GROUP BY threshold)"""


@query("q10_threshold_grid", with_sql(LABELS_SQL, GRID_TABLE) + f"SELECT threshold, tp, fp, tn, fn, {RATES_SQL} FROM grid")
def grid(spark, sf):
    return rounded(q.threshold_metrics(_scored(spark, sf), "label", "score"), *RATES)


@query(
    "q10_chosen_threshold",
    with_sql(LABELS_SQL, GRID_TABLE, f"rated AS (SELECT threshold, {RATES_SQL} FROM grid)")
    + """SELECT coalesce((SELECT threshold FROM rated WHERE recall >= 0.85 ORDER BY f1 DESC, threshold LIMIT 1), 0.5) AS threshold,
      (SELECT max(f1) FROM rated WHERE recall >= 0.85) AS f1""",
)
def chosen(spark, sf):
    return rounded(q.choose_threshold(q.threshold_metrics(_scored(spark, sf), "label", "score")), "f1")


CLASSES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
MULTI_SQL = with_sql(
    REPORTS_SQL,
    dims_sql("predicted_lsr"),
    "p AS (SELECT report_id, value AS label FROM dims)",
    "t AS (SELECT report_id, location AS label FROM reports)",
    f"classes AS (SELECT unnest({CLASSES}) AS label)",
    """cells AS (SELECT r.report_id, c.label, p.label IS NOT NULL AS p, t.label IS NOT NULL AS t FROM reports r, classes c
      LEFT JOIN p ON p.report_id = r.report_id AND p.label = c.label
      LEFT JOIN t ON t.report_id = r.report_id AND t.label = c.label)""",
    """per AS (SELECT label, count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp,
      count(*) FILTER (WHERE t AND NOT p) AS fn FROM cells GROUP BY label)""",
)


@query(
    "q11_multilabel_metrics",
    MULTI_SQL
    + f"""SELECT round({_share_sql('sum(tp)', 'sum(tp + fp)')}, 9) AS micro_precision,
      round({_share_sql('sum(tp)', 'sum(tp + fn)')}, 9) AS micro_recall,
      round({_share_sql('2 * sum(tp)', 'sum(2 * tp + fp + fn)')}, 9) AS micro_f1,
      round(sum({_share_sql('tp', 'tp + fp')}) / 5, 9) AS macro_precision,
      round(sum({_share_sql('tp', 'tp + fn')}) / 5, 9) AS macro_recall,
      round(sum({_share_sql('2 * tp', '2 * tp + fp + fn')}) / 5, 9) AS macro_f1,
      round((SELECT CAST(count(*) FILTER (WHERE p != t) AS DOUBLE) / count(*) FROM cells), 9) AS hamming_loss,
      round((SELECT CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / count(*) FROM
        (SELECT report_id, bool_and(p = t) AS ok FROM cells GROUP BY report_id)), 9) AS exact_match_ratio FROM per""",
)
def multilabel(spark, sf):
    df = reports(spark, sf, "predicted_lsr").withColumn("truth", F.array("location"))
    found = q.multilabel_metrics(df, "truth", "predicted_lsr", CLASSES)
    return rounded(found, *found.columns)
