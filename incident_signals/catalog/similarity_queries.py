"""Vectors, retrieval and agreement of assessments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incident_signals.catalog.adapter import REPORTS_SQL, TRUTH_SQL, dims_sql, reports, table, with_sql
from incident_signals.catalog.registry import query
from incident_signals.models.features import ModelEmbedder
from incident_signals.operators import agreement as a
from incident_signals.operators import similarity as v

UNIT_SQL = """doubles AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
units AS (SELECT vec_id, label, list_transform(e, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END) AS e
  FROM (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM doubles))"""


def vectors(spark, sf) -> DataFrame:
    """Embeddings as a vector table of unit vectors."""
    unit = v.unit_vector(F.col("embedding").cast("array<double>"))
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("vector_id"), F.col("vec_id").alias("report_id"), unit.alias("embedding"), "label"
    )


@query(
    "v1_unit_vectors",
    with_sql(UNIT_SQL)
    + """SELECT vec_id AS vector_id, round(e[1], 9) AS first, round(list_sum(e), 9) AS total,
      round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 9) AS norm FROM units""",
)
def unit_vectors(spark, sf):
    e = F.col("embedding")
    return vectors(spark, sf).select(
        "vector_id", F.round(F.get(e, F.lit(0)), 9).alias("first"),
        F.round(F.aggregate(e, F.lit(0.0), lambda t, x: t + x), 9).alias("total"), F.round(v.norm(e), 9).alias("norm"),
    )


@query(
    "v2_inner_products",
    with_sql(UNIT_SQL)
    + """SELECT a.vec_id AS vector_id, round(list_dot_product(a.e, b.e), 6) AS product
      FROM units a JOIN units b ON b.vec_id = a.vec_id + 1""",
)
def products(spark, sf):
    left = vectors(spark, sf)
    right = left.select((F.col("vector_id") - 1).alias("vector_id"), F.col("embedding").alias("other"))
    return left.join(right, "vector_id").select(
        "vector_id", F.round(v.inner_product(F.col("embedding"), F.col("other")), 6).alias("product")
    )


CENTRES_SQL = """elements AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM units),
centres AS (SELECT CAST(label AS BIGINT) AS query_id, list(m ORDER BY i) AS e FROM (SELECT label, i, avg(x) AS m FROM elements GROUP BY label, i)
  GROUP BY label)"""


def centres(spark, sf) -> DataFrame:
    """One query per label: the mean of its vectors."""
    elements = vectors(spark, sf).select("label", F.posexplode("embedding").alias("i", "x"))
    means = elements.groupBy("label", "i").agg(F.avg("x").alias("m"))
    packed = means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p"))
    return packed.select("query_id", F.col("p.m").alias("embedding"))


def ranked_sql(queries: str, k: int, condition: str = "TRUE") -> str:
    return f"""ranked AS (SELECT q.query_id, u.vec_id AS vector_id, round(list_dot_product(q.e, u.e), 12) AS score,
      row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_dot_product(q.e, u.e), 12) DESC, u.vec_id) AS rank
      FROM {queries} q, units u WHERE {condition} QUALIFY rank <= {k})"""


def _scored(df: DataFrame) -> DataFrame:
    return df.select(
        "query_id", "vector_id", F.round("score", 4).alias("similarity_score"), F.col("rank").cast("bigint").alias("rank")
    )


SELECT_RANKED = "SELECT query_id, vector_id, rank, round(score, 4) AS similarity_score FROM ranked"


@query("v3_nearest_to_label_centres", with_sql(UNIT_SQL, CENTRES_SQL, ranked_sql("centres", 5)) + SELECT_RANKED)
def nearest_to_centres(spark, sf):
    return _scored(v.top_k(vectors(spark, sf), centres(spark, sf), 5))


SELF_SQL = "(SELECT vec_id AS query_id, e FROM units)"


@query("v4_nearest_without_itself", with_sql(UNIT_SQL, ranked_sql(SELF_SQL, 5, "q.query_id != u.vec_id")) + SELECT_RANKED)
def nearest_others(spark, sf):
    table_ = vectors(spark, sf)
    asked = table_.select(F.col("vector_id").alias("query_id"), "embedding", F.col("report_id").alias("exclude_id"))
    return _scored(v.top_k(table_, asked, 5))


@query("v6_many_queries_in_blocks", with_sql(UNIT_SQL, ranked_sql(SELF_SQL, 3)) + SELECT_RANKED)
def many_queries(spark, sf):
    table_ = vectors(spark, sf)
    asked = table_.select(F.col("vector_id").alias("query_id"), "embedding")
    return _scored(v.top_k(table_, asked, 3, batch_bytes=1 << 16))


@query(
    "s8_vector_checks",
    """SELECT count(*) AS rows, CAST(min(len(embedding)) AS INTEGER) AS min_dimension, CAST(max(len(embedding)) AS INTEGER) AS max_dimension,
      count(*) FILTER (WHERE list_bool_or(list_transform(embedding, lambda x: isnan(x) OR isinf(x)))) AS not_finite,
      count(*) FILTER (WHERE vec_id IS NULL) AS missing_report_ids, min(vec_id) AS first_id,
      max(vec_id) + 1 = count(*) AS ids_aligned FROM embeddings""",
)
def checks(spark, sf):
    return v.vector_checks(vectors(spark, sf))


@query(
    "s9_vector_info",
    "SELECT count(*) AS rows, CAST(max(len(embedding)) AS INTEGER) AS dimension, count(*) > 0 AS loaded FROM embeddings",
)
def info(spark, sf):
    return v.vector_info(vectors(spark, sf))


@query(
    "g1_assessment_agreement",
    with_sql(REPORTS_SQL, dims_sql("predicted_lsr"), TRUTH_SQL)
    + """, a AS (SELECT r.report_id, sif_prediction, (SELECT list(DISTINCT value ORDER BY value) FROM dims d
          WHERE d.report_id = r.report_id) AS rules FROM reports r),
      b AS (SELECT r.report_id, sif_label, [location] AS rules FROM reports r JOIN truths USING (report_id)),
      j AS (SELECT a.report_id, b.report_id IS NOT NULL AS present, sif_prediction AS p, sif_label AS l,
          coalesce(a.rules, []) AS x, b.rules AS y FROM a LEFT JOIN b USING (report_id))
      SELECT report_id, CASE WHEN present THEN CAST(p = l AS VARCHAR) ELSE 'missing' END AS sif_agreement,
        CASE WHEN present THEN CASE WHEN list_contains(x, y[1]) THEN y[1] ELSE '' END ELSE 'missing' END AS lsr_overlap,
        CASE WHEN NOT present THEN 'missing' ELSE
          CASE WHEN p != l THEN 'Legacy classifier predicted ' || CASE p WHEN 1 THEN 'SIF-Potential' ELSE 'Non-SIF' END ||
            ' while the RAG assessment identified ' || CASE l WHEN 1 THEN 'SIF-Potential' ELSE 'Non-SIF' END || '.' ELSE '' END ||
          CASE WHEN len(x) > 0 AND NOT list_contains(x, y[1]) THEN '#LSR mismatch: Legacy model identified [''' ||
            array_to_string(x, ''', ''') || '''] whereas RAG assessment identified [''' || y[1] || '''].' ELSE '' END
        END AS conflicts FROM j""",
)
def agreement(spark, sf):
    df = reports(spark, sf, "predicted_lsr", truth=True)
    model = df.select("report_id", "sif_prediction", F.col("predicted_lsr").alias("rules"))
    other = df.where(F.col("activity").isNotNull()).select(
        "report_id", F.col("sif_label").alias("sif_potential"), F.array("location").alias("rules")
    )
    found = a.consistency(model, other)
    rule_part = lambda c: F.when(F.startswith(c, F.lit("LSR")), F.concat(F.lit("#"), c)).otherwise(c)
    known = lambda c: F.coalesce(c, F.lit("missing"))
    return found.select(
        "report_id",
        known(F.col("sif_agreement").cast("string")).alias("sif_agreement"),
        known(F.array_join("lsr_overlap", ",")).alias("lsr_overlap"),
        known(F.array_join(F.transform("conflicts", rule_part), "")).alias("conflicts"),
    )


CITED_SQL = """cited AS (SELECT vec_id AS query_id, (vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS incident_id FROM embeddings
  UNION SELECT query_id, vector_id FROM ranked WHERE rank = 2)"""


def _citations(spark, sf):
    table_ = vectors(spark, sf)
    asked = table_.select(F.col("vector_id").alias("query_id"), "embedding")
    allowed = v.top_k(table_, asked, 3).select("query_id", F.col("vector_id").alias("incident_id"), "rank")
    total = table_.agg(F.count(F.lit(1))).scalar()
    stated = table_.select(F.col("vector_id").alias("query_id"), ((F.col("vector_id") * 7 + 3) % total).alias("incident_id"))
    second = allowed.where(F.col("rank") == 2).select("query_id", "incident_id")
    return a.check_citations(stated.union(second).distinct(), allowed.drop("rank"), ["query_id"])


@query(
    "g2_valid_citations",
    with_sql(UNIT_SQL, ranked_sql(SELF_SQL, 3), CITED_SQL)
    + "SELECT c.* FROM cited c JOIN ranked r ON r.query_id = c.query_id AND r.vector_id = c.incident_id",
)
def valid_citations(spark, sf):
    return _citations(spark, sf)[0]


@query(
    "g2_citation_warnings",
    with_sql(UNIT_SQL, ranked_sql(SELF_SQL, 3), CITED_SQL)
    + """SELECT c.*, 'LLM referenced historical incident ' || incident_id || ', which was not present in retrieved context.' AS warning
      FROM cited c WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.query_id = c.query_id AND r.vector_id = c.incident_id)""",
)
def citation_warnings(spark, sf):
    return _citations(spark, sf)[1]


def letter_model():
    """A caller's sentence model: counts of the letters a to z."""

    class Letters:
        def encode(self, texts):
            return [[float(t.lower().count(chr(97 + i))) for i in range(26)] for t in texts]

    return Letters()


LETTER_COUNTS = "[" + ", ".join(
    f"CAST(length(t) - length(replace(t, '{chr(97 + i)}', '')) AS DOUBLE)" for i in range(26)
) + "]"


@query(
    "m2_v5_retrieval_by_model",
    f"""
    WITH docs AS (SELECT doc_id, {LETTER_COUNTS} AS e FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)),
    asked AS (SELECT item_id, {LETTER_COUNTS} AS e FROM (SELECT item_id, strip_accents(lower(text)) AS t FROM benchmark)),
    scored AS (
      SELECT item_id AS query_id, doc_id, CASE WHEN list_sum(docs.e) > 0 THEN list_cosine_similarity(asked.e, docs.e) ELSE 0 END AS score FROM asked, docs
    )
    SELECT query_id, CAST(rank AS INT) AS rank, round(score, 4) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored
    ) WHERE rank <= 5
    """,
)
def retrieval_by_model(spark, sf):
    """Free-text queries, embedded by a caller's model, against the vectors of all documents; blank ones are zeros."""
    embedder = ModelEmbedder(letter_model, blank_as_zero=True)
    docs = table(spark, sf, "documents")
    numbered_docs = docs.select(F.col("doc_id").alias("vector_id"), F.col("doc_id").alias("report_id"), "text")
    vectors = embedder.embed(numbered_docs, "text").drop("text")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = v.retrieve(vectors, asked, embedder)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("similarity_score").alias("score"))
