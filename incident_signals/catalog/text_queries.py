"""Cleaning, parsing and scalar functions over documents, events and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from incident_signals import fixed_values as fixed
from incident_signals.catalog.adapter import REPORTS_SQL, reports, table, with_sql
from incident_signals.catalog.registry import query
from incident_signals.functions import lists, numbers, text
from incident_signals.operators.patterns import pattern_id
from incident_signals.sources import reports as source


def _clean_sql(expression: str) -> str:
    out = f"lower(regexp_replace(strip_accents({expression}), '[^\\x00-\\x7F]', '', 'g'))"
    for short, full in fixed.pairs(fixed.ABBREVIATIONS):
        out = f"regexp_replace({out}, '\\b{short}\\b', '{full}', 'g')"
    return f"trim(regexp_replace(regexp_replace({out}, '[^\\w\\s.-]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    "c3_clean_documents",
    f"SELECT doc_id, length(c) AS length, md5(c) AS digest FROM (SELECT doc_id, {_clean_sql('text')} AS c FROM documents)",
)
def clean_documents(spark, sf):
    clean = table(spark, sf, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("c"))
    return clean.select("doc_id", F.length("c").cast("bigint").alias("length"), F.md5("c").alias("digest"))


@query(
    "c4_clean_reports",
    with_sql(REPORTS_SQL) + f"SELECT report_id, {_clean_sql('description')} AS description_clean FROM reports",
)
def clean_reports(spark, sf):
    return reports(spark, sf).select("report_id", text.normalize_text(F.col("description")).alias("description_clean"))


@query(
    "c2_intake_counts",
    """SELECT count(*) AS received, count(*) FILTER (WHERE regexp_full_match(coalesce(text, ''), '\\s*')) AS skipped,
      count(*) FILTER (WHERE NOT regexp_full_match(coalesce(text, ''), '\\s*')) AS valid FROM
      (SELECT CASE WHEN turn % 5 = 4 THEN '  ' WHEN turn % 7 = 6 THEN NULL ELSE text END AS text FROM conversations)""",
)
def intake(spark, sf):
    shown = F.when(F.col("turn") % 5 == 4, "  ").when(F.col("turn") % 7 == 6, None).otherwise(F.col("text"))
    return source.intake_counts(table(spark, sf, "conversations").select(shown.alias("description")))


@query(
    "c1_filled_defaults",
    """WITH raw AS (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN NULL WHEN doc_id % 4 = 3 THEN ' ' ELSE 'D' || doc_id END AS id,
        CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS site, source AS report_type FROM documents)
      SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN id ELSE printf('REP-%05d', row_number() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id)) END AS report_id,
        coalesce(site, 'General Site') AS site, 'Unspecified Location' AS location, coalesce(report_type, 'Incident') AS report_type
      FROM raw""",
)
def filled(spark, sf):
    d = F.col("doc_id")
    raw = table(spark, sf, "documents").select(
        "doc_id",
        F.when(d % 4 == 1, None).when(d % 4 == 3, " ").otherwise(F.concat(F.lit("D"), d)).alias("report_id"),
        F.when(d % 3 != 0, F.col("lang")).alias("site"),
        F.col("source").alias("report_type"),
    )
    return source.fill_defaults(raw, order=["doc_id"]).drop("date")


_CELL = """CASE event_id % 7 WHEN 0 THEN '["' || event_type || '", "x"]' WHEN 1 THEN event_type WHEN 2 THEN '"' || event_type || '"'
  WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN 'null' ELSE CAST(user_id AS VARCHAR) END"""


def _cells(spark, sf):
    kind = F.col("event_id") % 7
    cell = (
        F.when(kind == 0, F.concat(F.lit('["'), "event_type", F.lit('", "x"]')))
        .when(kind == 1, F.col("event_type"))
        .when(kind == 2, F.concat(F.lit('"'), "event_type", F.lit('"')))
        .when(kind == 3, "")
        .when(kind == 4, None)
        .when(kind == 5, "null")
        .otherwise(F.col("user_id").cast("string"))
    )
    return table(spark, sf, "events").select("event_id", "event_type", "user_id", cell.alias("cell"))


@query(
    "c5_parsed_lists",
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN event_type || ',x' WHEN 2 THEN event_type WHEN 6 THEN CAST(user_id AS VARCHAR)
      ELSE '' END AS items, event_id % 7 = 1 AS malformed FROM events""",
)
def parsed_lists(spark, sf):
    return _cells(spark, sf).select(
        "event_id", F.array_join(lists.parse_list(F.col("cell")), ",").alias("items"),
        lists.is_malformed_list(F.col("cell")).alias("malformed"),
    )


@query(
    "c5_parsed_props",
    "SELECT event_id, replace(props, ' ', '') AS items FROM events",
)
def parsed_props(spark, sf):
    items = lists.parse_list(F.col("props"))
    return table(spark, sf, "events").select("event_id", F.array_join(items, ",").alias("items"))


@query(
    "c6_distinct_items",
    """SELECT event_id, event_type || CASE WHEN event_type = 'click' THEN '' ELSE ',click' END || ',b' AS items FROM events""",
)
def distinct_items(spark, sf):
    raw = F.array(F.concat(F.lit(" "), "event_type"), F.lit("click"), F.lit("  "), F.col("event_type"), F.lit("b "))
    return table(spark, sf, "events").select("event_id", F.array_join(lists.distinct_items(raw), ",").alias("items"))


_RULES = "[" + ", ".join(f"'{r}'" for r in fixed.LIFE_SAVING_RULES) + "]"


@query(
    "c7_rule_tags",
    f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN a || ',' || b WHEN 1 THEN a WHEN 2 THEN a || ',' || b ELSE '' END AS tags
      FROM (SELECT event_id, ({_RULES})[user_id % 9 + 1] AS a, ({_RULES})[(user_id + 4) % 9 + 1] AS b FROM events)""",
)
def rule_tags(spark, sf):
    rules = F.array(*[F.lit(r) for r in fixed.LIFE_SAVING_RULES])
    named = table(spark, sf, "events").select(
        "event_id",
        F.element_at(rules, (F.col("user_id") % 9 + 1).cast("int")).alias("a"),
        F.element_at(rules, ((F.col("user_id") + 4) % 9 + 1).cast("int")).alias("b"),
    )
    kind = F.col("event_id") % 4
    cell = (
        F.when(kind == 0, F.concat_ws("|", "a", "b", F.lit("Other")))
        .when(kind == 1, F.concat(F.lit(" "), "a"))
        .when(kind == 2, F.format_string("['%s', 'Invalid Rule', '%s']", "a", "b"))
        .otherwise("None")
    )
    return named.select("event_id", F.array_join(lists.parse_rule_tags(cell), ",").alias("tags"))


@query(
    "c8_entity_names",
    "SELECT event_id, CASE WHEN event_id % 6 = 5 THEN 'Unknown' ELSE event_type END AS name FROM events",
)
def entity_names(spark, sf):
    kind, name = F.col("event_id") % 6, F.col("event_type")
    cell = (
        F.when(kind == 0, F.format_string("{'value': '%s', 'score': 0.5}", name))
        .when(kind == 1, F.format_string("{'rule': \"%s\"}", name))
        .when(kind == 2, F.format_string("['%s', 'other']", name))
        .when(kind == 3, F.format_string("{\"name\": \"%s\"}", name))
        .when(kind == 4, F.concat(F.lit("  "), name, F.lit(" ")))
        .otherwise(None)
    )
    return table(spark, sf, "events").select("event_id", text.clean_entity_name(cell).alias("name"))


@query(
    "c9_percent_change",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, round(CASE WHEN l_tax = 0 THEN NULL ELSE (l_discount - l_tax) / l_tax END, 4) AS change
      FROM lineitem""",
)
def percent_change(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
        numbers.percent_change(F.col("l_discount"), F.col("l_tax")).alias("change"),
    )


@query(
    "c10_scaled_prices",
    """SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 6) AS scaled, 0.5 AS flat
      FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)""",
)
def scaled(spark, sf):
    part = table(spark, sf, "part")
    bounds = part.agg(F.struct(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi")).alias("b")).scalar()
    return part.select(
        "p_partkey",
        F.round(numbers.min_max(F.col("p_retailprice"), bounds["lo"], bounds["hi"]), 6).alias("scaled"),
        numbers.min_max(F.col("p_retailprice"), F.lit(1.0), F.lit(1.0)).alias("flat"),
    )


@query(
    "c11_pattern_ids",
    "SELECT p_partkey, 'part_kind__' || replace(lower(p_brand), ' ', '_') || '__' || replace(lower(p_name), ' ', '_') AS id FROM part",
)
def pattern_ids(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", pattern_id(F.lit("part_kind"), F.array("p_brand", "p_name")).alias("id")
    )


@query(
    "c12_excerpts",
    """SELECT doc_id, md5(CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE coalesce(text, '') END) AS digest
      FROM documents""",
)
def excerpts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.excerpt(F.col("text"))).alias("digest"))


@query(
    "c17_sif_text",
    with_sql(REPORTS_SQL)
    + "SELECT report_id, CASE sif_prediction WHEN 1 THEN 'SIF-Potential' ELSE 'Non-SIF' END AS label FROM reports",
)
def labels(spark, sf):
    return reports(spark, sf).select("report_id", text.sif_text(F.col("sif_prediction")).alias("label"))


@query(
    "c18_features_without_truth",
    with_sql(REPORTS_SQL) + "SELECT report_id, location, sif_prediction FROM reports",
)
def no_truth(spark, sf):
    from incident_signals.models.features import assert_no_truth, drop_truth

    df = drop_truth(reports(spark, sf, truth=True))
    assert_no_truth(df.columns)
    return df.select("report_id", "location", "sif_prediction")


@query(
    "c19_clauses",
    """WITH parts AS (SELECT doc_id, regexp_replace(unnest(string_split_regex(text, '[.?!;]| but | and | so | while ')),
        '^\\s+|\\s+$', '', 'g') AS clause FROM documents)
      SELECT doc_id, count(*) AS clauses, CAST(sum(length(clause)) AS BIGINT) AS characters, max(md5(clause)) AS digest
      FROM parts WHERE length(clause) > 10 GROUP BY doc_id""",
)
def clauses(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode(text.split_clauses(F.col("text"))).alias("clause"))
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("clauses"), F.sum(F.length("clause")).alias("characters"), F.max(F.md5("clause")).alias("digest")
    )


@query(
    "s6_finite_values",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events""",
)
def finite(spark, sf):
    odd = (
        F.when(F.col("event_id") % 3 == 0, float("nan")).when(F.col("event_id") % 5 == 0, float("-inf")).otherwise(F.col("value"))
    )
    return numbers.finite_or_null(table(spark, sf, "events").select("event_id", odd.alias("value")))
