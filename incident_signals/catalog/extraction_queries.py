"""Extraction and normalization over report narratives and documents.

The SQL side states the same rules row by row: one select per pattern, windows
cut with string splitting instead of look-behind, and ranking by window function.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incident_signals import fixed_values as fixed
from incident_signals.catalog.adapter import REPORTS_SQL, reports, table, with_sql
from incident_signals.catalog.registry import query
from incident_signals.operators import extraction as x
from incident_signals.operators import normalization as n

EDGE = r"[^\p{L}\p{N}_]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hits_sql(rules: list[x.Rule], source: str = "reports", key: str = "report_id", text: str = "description") -> str:
    """Best evidence per report and value, as a parenthesised select."""
    selects = []
    for i, rule in enumerate(rules):
        pattern = f"(?:^|{EDGE})({rule.pattern})(?:$|{EDGE})" if rule.word else f"({rule.pattern})"
        level = 1 if rule.confidence == x.HIGH else 2
        selects.append(
            f"SELECT {key}, {quoted(rule.value)} AS value, {i} AS ordinal, {level} AS level, "
            f"regexp_extract({text}, {quoted('(?i)' + pattern)}, 1) AS evidence FROM {source}"
        )
    return f"""(SELECT {key}, value, evidence, CASE level WHEN 1 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM (
      SELECT *, row_number() OVER (PARTITION BY {key}, value ORDER BY level, ordinal) AS rank
      FROM ({' UNION ALL '.join(selects)}) WHERE evidence != '') WHERE rank = 1)"""


def items_of(df: DataFrame, rules: list[x.Rule]) -> DataFrame:
    found = x.match_rules(df, "description", rules, "found")
    return found.select("report_id", F.inline("found")).drop("match_method")


def _rules(name: str, rules: list[x.Rule]):
    query(name, with_sql(REPORTS_SQL) + f"SELECT * FROM {hits_sql(rules)}")(
        lambda spark, sf: items_of(reports(spark, sf), rules)
    )


_rules("x1_activities", x.ACTIVITY_RULES)
_rules("x2_unsafe_actions", x.ACTION_RULES)
_rules("x3_unsafe_conditions", x.CONDITION_RULES)
_rules("x4_barrier_failures", x.BARRIER_RULES)

# A caller's own rule table, used on the documents.
DOCUMENT_RULES = [
    x.Rule("contact", r"[a-z0-9._-]+@[a-z0-9-]+\.[a-z.]+"),
    x.Rule("license", "licen[cs]e"),
    x.Rule("license", "copyright", x.MEDIUM),
    x.Rule("network address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    x.Rule("link", r"https?:"),
]


@query(
    "x1_caller_rules_on_documents",
    f"SELECT * FROM {hits_sql(DOCUMENT_RULES, 'documents', 'doc_id', 'text')}",
)
def caller_rules(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("report_id"), F.col("text").alias("description"))
    return items_of(docs, DOCUMENT_RULES).withColumnRenamed("report_id", "doc_id")


def hazards_sql() -> str:
    """Non-negated hazard hits, best evidence per report and value."""
    guards = dict(fixed.table(fixed.HAZARD_GUARDS))
    negators = "|".join(fixed.NEGATORS).replace("'", "''")
    selects, ordinal = [], 0
    for category, phrases in fixed.table(fixed.HAZARD_PHRASES):
        for phrase in phrases:
            ordinal += 1
            p = quoted(phrase)
            tests = [f"NOT regexp_matches(before, '{EDGE[:1]}{EDGE[2:]}$')", f"NOT regexp_matches(after, '^{EDGE[:1]}{EDGE[2:]}')"]
            denied = f"regexp_matches(near, '\\b(?:{negators})\\b\\s*(?:[^\\s.,;]+)?\\s*$')"
            if category in fixed.ENERGY_CATEGORIES:
                denied += "".join(f" OR contains(near, {quoted(w)})" for w in fixed.ENERGY_CLEAR)
            if "depressurized" in phrase:
                denied = f"({denied}) AND NOT regexp_matches(near, '\\b(?:not|failed to)\\b')"
            if category == "Line-of-fire exposure":
                denied += "".join(f" OR contains(far, {quoted(w)})" for w in fixed.LINE_OF_FIRE_CLEAR)
                denied += " OR contains(near, 'nobody')"
            tests.append(f"NOT ({denied})")
            if category == "Fire/explosion" and "fire" in phrase:
                tests += [f"NOT contains(around, {quoted(w)})" for w in fixed.FIRE_EXCLUDED_CONTEXTS]
            if category in guards:
                tests.append("(" + " OR ".join(f"contains(low, {quoted(w)})" for w in guards[category]) + ")")
            selects.append(
                f"""SELECT report_id, {quoted(category)} AS value, {ordinal} AS ordinal, {1 if len(phrase) > 6 else 2} AS level,
                 length(before) AS place, substr(description, length(before) + 1, {len(phrase)}) AS evidence FROM (
                 SELECT *, trim(right(before, 30)) AS near, trim(right(before, 60)) AS far,
                   right(before, 30) || {p} || left(after, 30) AS around FROM (
                 SELECT report_id, description, low, array_to_string(parts[1:k], {p}) AS before,
                   array_to_string(parts[k + 1:], {p}) AS after
                 FROM (SELECT report_id, description, lower(description) AS low,
                         string_split(lower(description), {p}) AS parts,
                         unnest(range(1, len(string_split(lower(description), {p})))) AS k
                       FROM reports WHERE contains(lower(description), {p})))) WHERE {' AND '.join(tests)}"""
            )
    return f"""(SELECT report_id, value, evidence, CASE level WHEN 1 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM (
      SELECT *, row_number() OVER (PARTITION BY report_id, value ORDER BY level, ordinal, place) AS rank
      FROM ({' UNION ALL '.join(selects)})) WHERE rank = 1)"""


@query("x5_hazards", with_sql(REPORTS_SQL) + f"SELECT * FROM {hazards_sql()}")
def hazards(spark, sf):
    found = x.extract(reports(spark, sf), only=["hazards"])
    return x.long_entities(found, ["hazards"]).drop("category", "match_method")


def title_sql(text: str) -> str:
    """Upper case after every character that is no letter, lower case elsewhere."""
    pieces = rf"regexp_extract_all({text}, '\p{{L}}*[^\p{{L}}]|\p{{L}}+')"
    return f"array_to_string(list_transform({pieces}, lambda p: upper(p[1]) || lower(p[2:])), '')"


def equipment_sql() -> str:
    names = "|".join(fixed.TAGGED_EQUIPMENT)
    patterns = [rf"(?i)\b(?:{names})\s+[A-Z0-9-]+\b", rf"(?i)\b[A-Z0-9-]+\s+(?:{names})\b"]
    patterns += [rf"(?i)\b{word}\b" for word in fixed.EQUIPMENT_WORDS]
    mentions = " UNION ALL ".join(
        f"SELECT report_id, {i} AS ordinal, unnest(regexp_extract_all(description, {quoted(p)})) AS mention FROM reports"
        for i, p in enumerate(patterns)
    )
    kinds = " ".join(
        f"WHEN {' OR '.join(f'contains(low, {quoted(w)})' for w in words)} THEN {quoted(kind)}"
        for kind, words in fixed.table(fixed.EQUIPMENT_TYPES)
    )
    return f"""mentions AS (SELECT DISTINCT report_id, lower(mention) AS low FROM ({mentions})),
      maximal AS (SELECT * FROM mentions m WHERE NOT EXISTS (SELECT 1 FROM mentions o WHERE o.report_id = m.report_id
        AND length(o.low) > length(m.low) AND contains(o.low, m.low))),
      typed AS (SELECT report_id, {title_sql('low')} AS value, CASE {kinds} ELSE {title_sql('low')} END AS type FROM maximal)"""


@query("x7_equipment", with_sql(REPORTS_SQL, equipment_sql()) + "SELECT * FROM typed")
def equipment(spark, sf):
    found = x.extract(reports(spark, sf), only=["equipment"])
    return found.select("report_id", F.inline("equipment")).select("report_id", "value", "type")


def _values(block: str) -> str:
    rows = [f"({quoted(k.lower())}, {quoted(v)})" for k, values in fixed.table(block) for v in values]
    return "(VALUES " + ", ".join(rows) + ")"


CONSEQUENCES_SQL = with_sql(
    REPORTS_SQL,
    f"stated AS (SELECT * FROM {hits_sql(x.CONSEQUENCE_RULES)})",
    f"hazard_hits AS (SELECT * FROM {hazards_sql()})",
    f"""inferred AS (SELECT DISTINCT report_id, v.consequence AS value FROM hazard_hits
      JOIN {_values(fixed.HAZARD_CONSEQUENCES)} v(hazard, consequence) ON lower(hazard_hits.value) = v.hazard)""",
)


@query(
    "x8_consequences",
    CONSEQUENCES_SQL
    + """SELECT report_id, value, 'HIGH' AS confidence, 'regex' AS match_method FROM stated
      UNION ALL SELECT report_id, value, 'MEDIUM', 'synonym' FROM inferred i
      WHERE NOT EXISTS (SELECT 1 FROM stated s WHERE s.report_id = i.report_id AND s.value = i.value)""",
)
def consequences(spark, sf):
    found = x.long_entities(x.extract(reports(spark, sf), only=["potential_consequences"]), ["potential_consequences"])
    return found.select("report_id", "value", "confidence", "match_method")


def _tags_cte() -> str:
    return f"""tags AS (SELECT report_id, tag FROM hazard_hits JOIN {_values(fixed.HAZARD_TAGS)} v(part, tag) ON contains(lower(value), part)
      UNION SELECT report_id, tag FROM barrier_hits JOIN {_values(fixed.BARRIER_TAGS)} v(part, tag) ON lower(value) = part
      UNION SELECT report_id, tag FROM condition_hits JOIN {_values(fixed.CONDITION_TAGS)} v(part, tag) ON contains(lower(value), part))"""


TAGS_SQL = with_sql(
    REPORTS_SQL,
    f"hazard_hits AS (SELECT * FROM {hazards_sql()})",
    f"barrier_hits AS (SELECT * FROM {hits_sql(x.BARRIER_RULES)})",
    f"condition_hits AS (SELECT * FROM {hits_sql(x.CONDITION_RULES)})",
    _tags_cte(),
)


@query(
    "x9_precursor_tags",
    TAGS_SQL + "SELECT report_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM tags GROUP BY report_id",
)
def tags(spark, sf):
    found = x.extract(reports(spark, sf), only=["precursor_tags"])
    return found.where(F.size("precursor_tags") > 0).select("report_id", F.array_join("precursor_tags", ",").alias("tags"))


@query(
    "x15_entities_per_report",
    CONSEQUENCES_SQL.rstrip()
    + f""", activity_hits AS (SELECT * FROM {hits_sql(x.ACTIVITY_RULES)}), action_hits AS (SELECT * FROM {hits_sql(x.ACTION_RULES)}),
      barrier_hits AS (SELECT * FROM {hits_sql(x.BARRIER_RULES)}), condition_hits AS (SELECT * FROM {hits_sql(x.CONDITION_RULES)}),
      {equipment_sql()}, {_tags_cte()},
      every AS (SELECT report_id, 'activities' AS kind, value FROM activity_hits
        UNION ALL SELECT report_id, 'hazards', value FROM hazard_hits
        UNION ALL SELECT report_id, 'barrier_failures', value FROM barrier_hits
        UNION ALL SELECT report_id, 'unsafe_actions', value FROM action_hits
        UNION ALL SELECT report_id, 'unsafe_conditions', value FROM condition_hits
        UNION ALL SELECT report_id, 'equipment', value FROM typed
        UNION ALL SELECT report_id, 'potential_consequences', value
          FROM (SELECT report_id, value FROM stated UNION SELECT report_id, value FROM inferred)
        UNION ALL SELECT report_id, 'precursor_tags', tag FROM tags)
      SELECT reports.report_id, """
    + ", ".join(
        f"coalesce(string_agg(value, ';' ORDER BY value) FILTER (WHERE kind = '{c}'), '') AS {c}" for c in [*x.ENTITY_COLUMNS, "precursor_tags"]
    )
    + " FROM reports LEFT JOIN every ON every.report_id = reports.report_id GROUP BY reports.report_id",
)
def entities(spark, sf):
    """All seven entity arrays and the tags: their values in order of name."""
    found = x.extract(reports(spark, sf))
    values = [F.array_join(F.array_sort(F.col(f"{c}.value")), ";").alias(c) for c in x.ENTITY_COLUMNS]
    return found.select("report_id", *values, F.array_join(F.array_sort("precursor_tags"), ";").alias("precursor_tags"))


# --- normalization ------------------------------------------------------------------------

SENTENCES_SQL = r"""
sentences AS (SELECT report_id, trim(unnest(string_split(description, '.'))) AS sentence FROM reports),
phrases AS (SELECT DISTINCT sentence FROM sentences WHERE sentence != '')"""


def sentences(spark, sf) -> DataFrame:
    rows = reports(spark, sf).select("report_id", F.explode(F.split("description", r"\.")).alias("sentence"))
    trimmed = rows.select("report_id", F.btrim("sentence").alias("sentence"))
    return trimmed.where(F.col("sentence") != "")


def canonical_sql(block: str, fallback: str) -> str:
    """Scalar subquery: exact name, exact variant, longest contained variant, fallback."""
    rows, ordinal = [], 0
    for name, variants in fixed.table(block):
        rows.append(f"({quoted(name)}, {quoted(name.lower())}, -1)")
        for variant in variants:
            rows.append(f"({quoted(name)}, {quoted(variant.lower())}, {ordinal})")
            ordinal += 1
    return f"""coalesce((SELECT name FROM (VALUES {', '.join(rows)}) v(name, part, ordinal)
      WHERE lower(sentence) = part OR (ordinal >= 0 AND contains(lower(sentence), part))
      ORDER BY CASE WHEN lower(sentence) = part AND ordinal < 0 THEN 0 WHEN lower(sentence) = part THEN 1 ELSE 2 END,
        CASE WHEN lower(sentence) = part THEN 0 ELSE -length(part) END, ordinal LIMIT 1), {fallback})"""


NORMALIZERS = {
    "activity": (fixed.ACTIVITY_NAMES, n.activity),
    "barrier_failure": (fixed.BARRIER_NAMES, n.barrier_failure),
    "equipment": (fixed.EQUIPMENT_NAMES, n.equipment),
    "consequence": (fixed.CONSEQUENCE_NAMES, n.consequence),
}


@query(
    "x11_normalized_sentences",
    with_sql(REPORTS_SQL, SENTENCES_SQL)
    + "SELECT report_id, sentence, "
    + ", ".join(f"{name}" for name in NORMALIZERS)
    + " FROM sentences JOIN (SELECT sentence, "
    + ", ".join(f"{canonical_sql(block, title_sql('sentence'))} AS {name}" for name, (block, _) in NORMALIZERS.items())
    + " FROM phrases) USING (sentence)",
)
def normalized_sentences(spark, sf):
    names = {name: n.normalized("sentence", function) for name, (_, function) in NORMALIZERS.items()}
    return sentences(spark, sf).withColumns(names)


@query(
    "x12_normalized_hazards_and_tags",
    with_sql(REPORTS_SQL, SENTENCES_SQL)
    + f"""SELECT report_id, hazard, tag FROM sentences JOIN (SELECT sentence,
      CASE WHEN lower(sentence) IN ({', '.join(quoted(t) for t in fixed.CONSEQUENCES_AMONG_HAZARDS)})
        THEN '{fixed.IGNORE_TOKEN}' ELSE {canonical_sql(fixed.HAZARD_NAMES, title_sql('sentence'))} END AS hazard,
      replace(lower({canonical_sql(fixed.TAG_NAMES, title_sql('sentence'))}), ' ', '-') AS tag
      FROM phrases) USING (sentence)""",
)
def normalized_hazards(spark, sf):
    named = sentences(spark, sf).withColumns(
        {"hazard": n.normalized("sentence", n.hazard), "tag": n.normalized("sentence", n.precursor_tag)}
    )
    return named.select("report_id", "hazard", "tag")


@query(
    "x13_normalized_lists",
    with_sql(
        REPORTS_SQL,
        f"hits AS (SELECT * FROM {hits_sql(x.ACTIVITY_RULES)})",
        "phrases AS (SELECT DISTINCT value AS sentence FROM hits)",
        f"named AS (SELECT sentence, {canonical_sql(fixed.ACTIVITY_NAMES, 'sentence')} AS name FROM phrases)",
    )
    + """SELECT report_id, string_agg(DISTINCT name, ',' ORDER BY name) AS activities
      FROM hits JOIN named ON value = sentence GROUP BY report_id""",
)
def normalized_lists(spark, sf):
    found = x.match_rules(reports(spark, sf), "description", x.ACTIVITY_RULES, "found")
    names = found.withColumn("_values", F.col("found.value")).select(
        "report_id", n.normalize_list("_values", n.activity).alias("names")
    )
    return names.where(F.size("names") > 0).select(
        "report_id", F.array_join(F.array_sort("names"), ",").alias("activities")
    )


@query(
    "x14_barrier_of_phrase",
    with_sql(REPORTS_SQL, SENTENCES_SQL)
    + "SELECT report_id, category FROM sentences JOIN (SELECT sentence, CASE "
    + " ".join(
        f"WHEN {' OR '.join(f'contains(lower(sentence), {quoted(p)})' for p in phrases)} THEN {quoted(category)}"
        for category, phrases in fixed.table(fixed.BARRIER_PHRASES)
    )
    + " ELSE 'UNKNOWN_FAILURE' END AS category FROM phrases) USING (sentence)",
)
def barrier_phrases(spark, sf):
    return sentences(spark, sf).select("report_id", n.normalized("sentence", n.barrier_of_phrase).alias("category"))
