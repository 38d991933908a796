"""Sources, sinks, models and whole-table jobs over the derived reports."""

from __future__ import annotations

import functools
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incident_signals import fixed_values as fixed
from incident_signals.catalog import pattern_queries, quality_queries, temporal_queries  # noqa: F401  their SQL is used below
from incident_signals.catalog.adapter import REPORTS_SQL, TRUTH_SQL, dims_sql, reports, table, with_sql
from incident_signals.catalog.density_queries import DENSITY_SELECT, flat
from incident_signals.catalog.extraction_queries import canonical_sql, hazards_sql, hits_sql, quoted
from incident_signals.catalog.model_queries import cleaned_reports, fitted_models
from incident_signals.catalog.registry import CHECKS, query
from incident_signals.catalog.similarity_queries import LETTER_COUNTS, letter_model
from incident_signals.models import features as ft
from incident_signals.models.classifiers import SifClassifier
from incident_signals.models.inference import EMPTY_ERROR, enrich, predict_reports
from incident_signals.models.itemsets import DIMENSIONS, association_rules, frequent_itemsets
from incident_signals.models.semantic import add_semantic_hazards
from incident_signals.models.split import stratified_split
from incident_signals.operators import extraction as x
from incident_signals.operators import quality as q
from incident_signals.operators.reports import without_truth
from incident_signals.plans import analytics, refresh
from incident_signals.session import new_path
from incident_signals.sources import reports as source
from incident_signals.sources.vectors import build_vectors

PLAIN = "report_id, CAST(date AS VARCHAR) AS date, site, location, report_type, description"


def _plain(spark, sf) -> DataFrame:
    """Reports as text columns, with the literal None where a hazard is missing."""
    df = reports(spark, sf, "predicted_hazards", truth=True)
    return df.select(
        F.col("report_id").cast("string").alias("report_id"), F.col("date").cast("string").alias("date"), "site",
        "location", "report_type", "description", "sif_label",
        F.when(F.col("report_id") % 4 == 0, "None").otherwise(F.coalesce("hazard", F.lit("NA"))).alias("hazard"),
    )


@query(
    "s1_report_csv",
    with_sql(REPORTS_SQL, TRUTH_SQL)
    + """SELECT CAST(report_id AS VARCHAR) AS report_id, CAST(date AS VARCHAR) AS date, site,
      CASE WHEN report_id % 5 = 0 THEN description || chr(10) || chr(10) || '"A second, quoted paragraph."' ELSE description END AS description,
      sif_label, CASE WHEN report_id % 4 = 0 THEN NULL ELSE hazard END AS hazard FROM reports LEFT JOIN truths USING (report_id)""",
)
def csv_scan(spark, sf):
    """Every fifth text has line breaks and quotes."""
    path = new_path(spark, "reports-csv")
    longer = F.concat("description", F.lit('\n\n"A second, quoted paragraph."'))
    df = _plain(spark, sf).withColumn("description", F.when(F.col("report_id") % 5 == 0, longer).otherwise(F.col("description")))
    df.write.csv(path, header=True, quote='"', escape='"')
    found = source.read_reports_csv(spark, path, required=["report_id", "description"])
    return found.select("report_id", "date", "site", "description", "sif_label", "hazard")


@query(
    "s3_report_json",
    with_sql(REPORTS_SQL) + "SELECT CAST(report_id AS VARCHAR) AS report_id, site, report_type, description FROM reports",
)
def json_scan(spark, sf):
    path = new_path(spark, "reports-json")
    _plain(spark, sf).select("report_id", "site", "report_type", "description").write.json(path)
    schema = "report_id string, site string, report_type string, description string"
    return source.read_reports_json(spark, path, schema, lines=True)


@query(
    "s4_enriched_csv",
    with_sql(REPORTS_SQL, dims_sql("predicted_hazards"))
    + """SELECT CAST(r.report_id AS VARCHAR) AS report_id, (SELECT count(*) FROM dims d WHERE d.report_id = r.report_id) AS hazards
      FROM reports r""",
)
def enriched_csv(spark, sf):
    """Written with lists as JSON text, read and parsed again."""
    from incident_signals.functions.lists import parse_list

    path = new_path(spark, "enriched-csv")
    source.write_enriched(reports(spark, sf, "predicted_hazards"), path, "csv")
    found = source.read_reports_csv(spark, path, multi_line=False)
    return found.select("report_id", F.size(parse_list(F.col("predicted_hazards"))).cast("bigint").alias("hazards"))


@query(
    "s5_published_analytics",
    with_sql(REPORTS_SQL) + f"SELECT site AS name, {DENSITY_SELECT} FROM reports GROUP BY site",
)
def published(spark, sf):
    """All outputs are written; the site table is read back."""
    df = reports(spark, sf, *fixed.LIST_COLUMNS, truth=True)
    path = new_path(spark, "analytics")
    outputs = analytics.run_analytics(df)
    analytics.publish(outputs, analytics.metadata(df, "orders"), path)
    sites = analytics.read_output(spark, path, "site_analytics", outputs["site_analytics"].schema)
    return flat(sites.select("name", "total_reports", "sif_count", "non_sif_count", "sif_density", "avg_sif_probability",
                             "data_quality_warnings"))


# Each published output and the query whose SQL states its rows.
PUBLISHED = {
    "overall_summary": ["d14_overall_summary"], "site_analytics": ["d6_site_profile"], "activity_analytics": ["d8_activity_profile"],
    "lsr_analytics": ["d9_rule_profile"], "hazard_analytics": ["d10_hazard_profile"], "barrier_analytics": ["d10_barrier_profile"],
    "consequence_analytics": ["d11_consequence_profile"], "temporal_analytics": ["t7_all_periods"],
    "temporal_frequency": ["t5_monthly_frequency"], "recurring_patterns": ["p4_all_patterns"],
    "emerging_patterns": ["p6_emerging_by_quarter"], "cross_site_patterns": ["p5_cross_site_patterns"],
    "analytics_validation": ["q1_dimension_overlap", "q2_site_overlap"],
}


@query(
    "s5_published_outputs",
    " UNION ALL ".join(
        f"SELECT '{name}' AS output, {' + '.join(f'(SELECT count(*) FROM ({CHECKS[c]}))' for c in checks)} AS rows"
        for name, checks in PUBLISHED.items()
    ),
)
def published_outputs(spark, sf):
    """All thirteen outputs, each read back and counted after it was verified."""
    df = reports(spark, sf, *fixed.LIST_COLUMNS, truth=True)
    path = new_path(spark, "analytics")
    outputs = analytics.run_analytics(df)
    analytics.publish(outputs, analytics.metadata(df, "orders"), path)
    analytics.verify_outputs(spark, path, list(outputs))
    return analytics.output_counts(spark, path, list(outputs))


@query(
    "s7_vector_table",
    with_sql(REPORTS_SQL)
    + """SELECT row_number() OVER (ORDER BY report_id) - 1 AS vector_id, report_id, CAST(date AS VARCHAR) AS date, site, location,
      report_type, description, 384 AS dimension FROM reports""",
)
def vector_table(spark, sf):
    built = build_vectors(reports(spark, sf), ft.HashingEmbedder())
    return built.select(
        "vector_id", "report_id", "date", "site", "location", "report_type", "description",
        F.size("embedding").alias("dimension"),
    )


@query("s13_report_export", with_sql(REPORTS_SQL) + f"SELECT {PLAIN.replace('report_id,', 'CAST(report_id AS VARCHAR) AS report_id,', 1)} FROM reports WHERE sif_prediction = 1")
def export(spark, sf):
    path = new_path(spark, "export")
    source.export_reports_csv(reports(spark, sf, truth=True).where(F.col("sif_prediction") == 1), path)
    back = source.read_reports_csv(spark, path, multi_line=False)
    assert back.columns == without_truth(reports(spark, sf, truth=True)).columns
    return back.select("report_id", "date", "site", "location", "report_type", "description")


@query(
    "m8_split_sizes",
    with_sql(REPORTS_SQL)
    + """, n AS (SELECT sif_label, count(*) AS n FROM reports GROUP BY sif_label)
      SELECT sif_label, 'train' AS split, CAST(ceil(n * 0.7 - 1e-9) AS BIGINT) AS reports FROM n
      UNION ALL SELECT sif_label, 'validation', CAST(ceil(n * 0.85 - 1e-9) - ceil(n * 0.7 - 1e-9) AS BIGINT) FROM n
      UNION ALL SELECT sif_label, 'test', CAST(n - ceil(n * 0.85 - 1e-9) AS BIGINT) FROM n""",
)
def split_sizes(spark, sf):
    out = stratified_split(reports(spark, sf), "sif_label")
    return out.groupBy("sif_label", "split").agg(F.count(F.lit(1)).alias("reports"))


ACTIVITIES_SQL = with_sql(
    REPORTS_SQL,
    f"hits AS (SELECT * FROM {hits_sql(x.ACTIVITY_RULES)})",
    f"named AS (SELECT sentence, {canonical_sql(fixed.ACTIVITY_NAMES, 'sentence')} AS name FROM (SELECT DISTINCT value AS sentence FROM hits))",
    "stated AS (SELECT report_id, string_agg(DISTINCT name, ',' ORDER BY name) AS activities FROM hits JOIN named ON value = sentence GROUP BY report_id)",
)


@query(
    "m7_batch_inference",
    ACTIVITIES_SQL
    + f"""SELECT report_id, CASE WHEN report_id % 10 <> 0 THEN coalesce(activities, '') END AS activities, report_id % 10 <> 0 AS scored,
      CASE WHEN report_id % 10 = 0 THEN '{EMPTY_ERROR}' END AS error FROM reports LEFT JOIN stated USING (report_id)""",
)
def inference(spark, sf):
    """Normalized activities, a class that agrees with the probability and a known rule; or an error."""
    _, sif, rules, _ = fitted_models(spark, sf, ft.TfidfFeatures())
    agrees = (F.col("sif_prediction") == (F.col("sif_probability") >= F.round(F.lit(sif.threshold), 4)).cast("int")) & F.col(
        "primary_rule"
    ).isin(rules.rules)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("activities", lambda a: a["value"]))), ",")
    return _inferred(spark, sf).select(
        "report_id", names.alias("activities"), F.coalesce(agrees, F.lit(False)).alias("scored"), "error"
    )


def _inferred(spark, sf) -> DataFrame:
    """Predictions of all reports, of which every tenth has no text."""
    features, sif, rules, _ = fitted_models(spark, sf, ft.TfidfFeatures())
    df = reports(spark, sf)
    return predict_reports(df.withColumn("description", _some_blank()), features, sif, rules)


def _some_blank():
    return F.when(F.col("report_id") % 10 == 0, " ").otherwise(F.col("description"))


@query(
    "m7_inference_errors",
    with_sql(REPORTS_SQL)
    + f"""SELECT report_id, report_id % 10 <> 0 AS predicted, CASE WHEN report_id % 10 = 0 THEN '{EMPTY_ERROR}' END AS error
      FROM reports""",
)
def inference_errors(spark, sf):
    """Reports with text have a probability and a class that agrees with it; the others have an error."""
    inferred = _inferred(spark, sf)
    predicted = F.col("sif_probability").between(0, 1) & F.col("sif_prediction").isin(0, 1)
    return inferred.select("report_id", F.coalesce(predicted, F.lit(False)).alias("predicted"), "error")


@query("q12_model_comparison")
def comparison(spark, sf):
    results = []
    for mode, features in (("tfidf", ft.TfidfFeatures()), ("embedding", ft.EmbeddingFeatures(ft.HashingEmbedder()))):
        _, sif, _, vectors = fitted_models(spark, sf, features, with_rules=mode == "tfidf")
        for split in ("validation", "test"):
            scored = sif.predict(vectors.where(F.col("split") == split))
            results.append((mode, split, q.binary_metrics(scored, "sif_label", "sif_probability", sif.threshold)))
    return q.comparison_table(results, ["f1", "recall", "precision", "accuracy"])


class _WordModel:
    """A caller's sentence model: how often a text holds each word of the hazard descriptions."""

    def __init__(self, words: list[str]):
        self.words = words

    def encode(self, texts):
        held = [Counter(re.findall(r"\w+", t.lower(), re.ASCII)) for t in texts]
        return [[float(words[w]) for w in self.words] for words in held]


class _CallersEmbedder:
    def __init__(self, factory):
        self.factory = factory


MEANINGS = fixed.pairs(fixed.HAZARD_MEANINGS)
MEANING_WORDS = sorted({w for _, m in MEANINGS for w in re.findall(r"[a-z]+", m.lower())})
_WORD_COUNTS = "[" + ", ".join(f"CAST(len(regexp_extract_all(t, '\\b{w}\\b')) AS DOUBLE)" for w in MEANING_WORDS) + "]"


def _semantic_sql(rows: str, key: str, counts: str, threshold: float, known: str) -> str:
    """First clause of each row that is close to a meaning which ``known`` (key, value) does not hold already."""
    meanings = ", ".join(f"({i}, {quoted(value)}, {quoted(text)})" for i, (value, text) in enumerate(MEANINGS))
    limited = " AND ".join(
        f"(value <> {quoted(value)} OR {' OR '.join(f'contains(low, {quoted(w)})' for w in words)})"
        for value, words in fixed.table(fixed.MEANING_RESTRICTIONS)
    )
    return f"""parts AS (
        SELECT {key}, unnest(pieces) AS part, generate_subscripts(pieces, 1) AS place
        FROM (SELECT {key}, string_split_regex(text, '[.?!;]| but | and | so | while ') AS pieces FROM {rows})
      ), clauses AS (
        SELECT {key}, place, clause, lower(clause) AS low
        FROM (SELECT {key}, place, regexp_replace(part, '^\\s+|\\s+$', '', 'g') AS clause FROM parts)
        WHERE length(clause) > 10 AND NOT (regexp_matches(lower(clause), '\\b(?:no|not|without|failed to)\\b')
          AND NOT contains(lower(clause), 'depressurize'))
      ), coded AS (SELECT clause, {counts} AS e FROM (SELECT DISTINCT clause, low AS t FROM clauses)),
      meant AS (SELECT ord, value, {counts} AS e FROM (SELECT ord, value, lower(text) AS t FROM (VALUES {meanings}) v(ord, value, text))),
      near AS (
        SELECT clause, ord, value, round(list_dot_product(c.e, m.e) / nullif(sqrt(list_dot_product(c.e, c.e)) * sqrt(list_dot_product(m.e, m.e)), 0), 12) AS score
        FROM coded c, meant m
      ), hit AS (
        SELECT {key}, value, clause, score, row_number() OVER (PARTITION BY {key}, value ORDER BY place) AS nth
        FROM clauses JOIN near USING (clause) WHERE score >= {threshold} AND {limited}
      )
      SELECT {key}, value, clause AS evidence, 'LOW' AS confidence, round(score, 4) AS similarity_score FROM hit
      WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM {known} k WHERE k.{key} = hit.{key} AND k.value = hit.value)"""


def _semantic_rows(found: DataFrame, key: str) -> DataFrame:
    rows = found.select(key, F.inline("hazards")).where(F.col("match_method") == "semantic")
    return rows.select(key, "value", "evidence", "confidence", "similarity_score")


WORD_THRESHOLD = 0.3


@query(
    "x10_semantic_hazards",
    with_sql(
        REPORTS_SQL, f"known AS (SELECT * FROM {hazards_sql()})",
        "said AS (SELECT report_id, description || ' ' || (SELECT list(text ORDER BY ord) FROM (VALUES "
        + ", ".join(f"({i}, {quoted(m)})" for i, (_, m) in enumerate(MEANINGS))
        + f") v(ord, text))[report_id % {len(MEANINGS)} + 1] AS text FROM reports WHERE report_id % 3 = 0"
        " UNION ALL SELECT report_id, description FROM reports WHERE report_id % 3 <> 0)",
    ).rstrip()
    + ", " + _semantic_sql("said", "report_id", _WORD_COUNTS, WORD_THRESHOLD, "known"),
)
def semantic(spark, sf):
    """By a model that counts words; every third report also quotes a hazard's description, which is an exact match."""
    quotes = F.array(*[F.lit(text) for _, text in MEANINGS])
    quoted_one = F.concat_ws(" ", "description", F.get(quotes, (F.col("report_id") % len(MEANINGS)).cast("int")))
    found = x.extract(reports(spark, sf)).withColumn(
        "description", F.when(F.col("report_id") % 3 == 0, quoted_one).otherwise(F.col("description"))
    )
    embedder = _CallersEmbedder(functools.partial(_WordModel, MEANING_WORDS))
    return _semantic_rows(add_semantic_hazards(found, embedder, threshold=WORD_THRESHOLD), "report_id")


LETTER_THRESHOLD = 0.88


@query(
    "x10_semantic_hazards_in_conversations",
    "WITH said AS (SELECT conv_id || '/' || turn AS report_id, text FROM conversations), "
    "known AS (SELECT NULL AS report_id, NULL AS value WHERE false), "
    + _semantic_sql("said", "report_id", LETTER_COUNTS, LETTER_THRESHOLD, "known"),
)
def semantic_conversations(spark, sf):
    """All turns of all conversations, by a model that counts letters."""
    turns = table(spark, sf, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("report_id"), F.col("text").alias("description")
    )
    found = add_semantic_hazards(x.extract(turns), ft.ModelEmbedder(letter_model), threshold=LETTER_THRESHOLD)
    return _semantic_rows(found, "report_id")


@query(
    "x16_enriched_reports",
    ACTIVITIES_SQL + """SELECT report_id, site, coalesce(activities, '') AS activities, 7 AS lists, true AS scored
      FROM reports LEFT JOIN stated USING (report_id)""",
)
def enriched(spark, sf):
    features, sif, rules, _ = fitted_models(spark, sf, ft.TfidfFeatures())
    done = enrich(reports(spark, sf).drop("sif_prediction", "sif_probability"), features, sif, rules)
    lists = sum((F.col(c).isNotNull().cast("int") for c in fixed.LIST_COLUMNS), F.lit(0))
    scored = F.col("sif_prediction").isin(0, 1) & (F.get("predicted_lsr", F.lit(0)) == F.col("primary_lsr_predicted"))
    return done.select(
        "report_id", "site", F.array_join(F.array_sort("predicted_activity"), ",").alias("activities"), lists.alias("lists"),
        scored.alias("scored"),
    )


@query(
    "s10_s12_refresh_summary",
    with_sql(REPORTS_SQL)
    + f"""SELECT n AS records_received, n - blank AS records_indexed, blank AS records_skipped, n - blank AS records_processed,
      {fixed.EMBEDDING_DIMENSION} AS dimension, 'first' AS dataset_version, true AS density_agrees
      FROM (SELECT count(*) AS n, count(*) FILTER (WHERE report_id % 10 = 0) AS blank FROM reports)""",
)
def refreshed(spark, sf):
    """Every tenth report has no text."""
    features, sif, rules, _ = fitted_models(spark, sf, ft.TfidfFeatures())
    df = reports(spark, sf).select("report_id", "date", "site", "location", "report_type", _some_blank().alias("description"))
    root = new_path(spark, "refresh")
    row = refresh.refresh(df, root, features, sif, rules, ft.HashingEmbedder(), version="first")
    density = F.round(F.col("sif_reports") / F.col("records_processed"), 4)
    return row.withColumn("density_agrees", density == F.col("sif_density")).drop("sif_reports", "sif_density")


@query(
    "s10_s11_versions",
    with_sql(REPORTS_SQL, "n AS (SELECT count(*) AS n FROM reports)")
    + """SELECT place, version, source, status, n AS current_reports, n AS current_vectors
      FROM n, (VALUES (1, 'first', 'uploaded_reports.csv', 'good'), (2, 'second', 'uploaded_reports.csv', 'failed'),
                      (3, 'first', 'restored', 'good')) v(place, version, source, status)""",
)
def versions(spark, sf):
    """A refresh, a refresh that fails for want of text, and the first version restored: manifest and current tables."""
    features, sif, rules, _ = fitted_models(spark, sf, ft.TfidfFeatures())
    df = reports(spark, sf).select("report_id", "date", "site", "location", "report_type", "description")
    root, embedder = new_path(spark, "versions"), ft.HashingEmbedder()
    refresh.refresh(df, root, features, sif, rules, embedder, version="first")
    try:
        refresh.refresh(df.withColumn("description", F.lit(" ")), root, features, sif, rules, embedder, version="second")
    except ValueError:
        refresh.restore(spark, root, "first")
    current = refresh.version_path(root, refresh.current_version(spark, root))
    counts = [spark.read.parquet(f"{current}/{name}").agg(F.count(F.lit(1))).scalar() for name in ("enriched", "vectors")]
    return refresh.manifest(spark, root).select(F.col("number").cast("int").alias("place"), "version", "source", "status",
                                                counts[0].alias("current_reports"), counts[1].alias("current_vectors"))


ITEM_DIMS = list(DIMENSIONS)


def _itemsets_sql(sizes: int, share: float) -> str:
    """Level-wise joins of frequent itemsets."""
    ctes = [
        "items AS (SELECT report_id, replace(dim, 'predicted_', '') || '=' || value AS item FROM dims)",
        f"floor_ AS (SELECT ceil({share} * count(*)) AS least FROM reports)",
        "kept AS (SELECT report_id, item FROM items WHERE item IN (SELECT item FROM items GROUP BY item HAVING count(*) >= (SELECT least FROM floor_)))",
    ]
    selects = []
    for size in range(1, sizes + 1):
        names = ", '|', ".join(f"k{i}.item" for i in range(size))
        joins = "kept k0" + "".join(
            f" JOIN kept k{i} ON k{i}.report_id = k0.report_id AND k{i}.item > k{i - 1}.item" for i in range(1, size)
        )
        selects.append(f"SELECT concat({names}) AS items, count(*) AS reports FROM {joins} GROUP BY 1 HAVING count(*) >= (SELECT least FROM floor_)")
    return with_sql(REPORTS_SQL, dims_sql(*ITEM_DIMS), *ctes) + " UNION ALL ".join(selects)


@query("p12_frequent_itemsets", _itemsets_sql(4, 0.25))
def itemsets(spark, sf):
    found = frequent_itemsets(reports(spark, sf, *ITEM_DIMS), columns=ITEM_DIMS, min_support=0.25)
    return found.select(F.array_join("items", "|").alias("items"), "reports")


@query(
    "s2_required_columns",
    """SELECT name, name NOT IN ('doc_id', 'text', 'lang', 'source', 'n_chars') AS missing, n AS documents
      FROM (VALUES ('text'), ('lang'), ('severity')) v(name), (SELECT count(*) AS n FROM documents)""",
)
def required(spark, sf):
    from incident_signals.schema import missing_columns

    docs = table(spark, sf, "documents")
    wanted = ["text", "lang", "severity"]
    missing = missing_columns(docs, wanted)
    flags = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(n in missing).alias("missing")) for n in wanted])
    return docs.agg(F.count(F.lit(1)).alias("documents")).select(F.inline(flags), "documents")


@query(
    "p12_association_rules",
    f"WITH found AS ({_itemsets_sql(2, 0.25)}) "
    + """SELECT a.items AS antecedent, part AS consequent, round(CAST(pair.reports AS DOUBLE) / a.reports, 6) AS confidence
      FROM (SELECT items, reports, unnest(string_split(items, '|')) AS part FROM found WHERE items LIKE '%|%') pair
      JOIN found a ON a.items = replace(replace(pair.items, part || '|', ''), '|' || part, '')
      WHERE CAST(pair.reports AS DOUBLE) / a.reports >= 0.5""",
)
def rules_of_items(spark, sf):
    """Rules of one item each way."""
    found = association_rules(reports(spark, sf, *ITEM_DIMS), columns=ITEM_DIMS, min_support=0.25)
    return found.where(F.size("antecedent") == 1).select(
        F.col("antecedent")[0].alias("antecedent"), F.col("consequent")[0].alias("consequent"), F.round("confidence", 6).alias("confidence")
    )


@query("m9_saved_models", "SELECT CAST(0 AS BIGINT) AS different, count(*) AS reports FROM documents JOIN labels USING (doc_id)")
def saved_models(spark, sf):
    """Saved and loaded again, features and model give every labelled document the same probability."""
    features, sif, _, vectors = fitted_models(spark, sf, ft.TfidfFeatures())
    path = new_path(spark, "models")
    features.save(f"{path}/features")
    sif.save(f"{path}/sif", spark)
    data = cleaned_reports(spark, sf)
    loaded = SifClassifier.load(f"{path}/sif", spark).predict(ft.TfidfFeatures.load(f"{path}/features").transform(data))
    pairs = loaded.select("report_id", F.col("sif_probability").alias("again")).join(sif.predict(features.transform(data)), "report_id")
    return pairs.agg(
        F.count_if(F.abs(F.col("again") - F.col("sif_probability")) > 1e-12).alias("different"), F.count(F.lit(1)).alias("reports")
    )
