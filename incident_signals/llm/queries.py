"""Named queries: each operator over its whole table, with the columns its contract asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incident_signals.llm import (
    backoff_lm,
    byte_bpe,
    decontaminate,
    license_scan,
    mixing,
    near_dedup,
    quality,
    sharding,
    stream_dedup,
    token_alignment,
    toxicity,
    url_rules,
    vector_codes,
)
from incident_signals.llm.registry import CHECKS, LOWER, QUERIES, query, table
from incident_signals.llm.text import plain_word_count

__all__ = ["CHECKS", "QUERIES"]

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query(
    "op1_url_filters",
    f"""
    WITH cut AS (
      SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
    ), parts AS (
      SELECT page_id, coalesce({LOWER.format("regexp_extract(rest, '^[^/?#]*')")}, '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
      FROM cut
    ), rules AS (
      SELECT * FROM (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}) AS r(rule_host, rule_path, verdict)
    ), ranked AS (
      SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
             row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST,
                                length(rule_host) DESC, verdict DESC) AS place
      FROM parts LEFT JOIN rules
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    )
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE place = 1
    """,
)
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def _license_check() -> str:
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in license_scan.TEMPLATES)
    words = "list_filter(regexp_split_to_array({}, '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: w <> '')"
    gram = "array_to_string(words[i : i + 4], ' ')"
    return f"""
    WITH listed AS (
      SELECT license, {words.format(LOWER.format("content"))} AS words FROM (VALUES {rows}) AS t(license, content)
    ), own AS (
      SELECT DISTINCT license, {gram} AS gram FROM (SELECT license, words, unnest(range(1, len(words) - 3)) AS i FROM listed)
    ), sized AS (
      SELECT license, count(*) AS whole, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS size FROM own GROUP BY license
    ), texts AS (
      SELECT doc_id, {words.format(LOWER.format("text"))} AS words FROM documents
    ), grams AS (
      SELECT doc_id, i - 1 AS pos, {gram} AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1))) AS i FROM texts)
    ), met AS (
      SELECT doc_id, license, pos, gram, size, whole FROM grams JOIN own USING (gram) JOIN sized USING (license)
    ), windows AS (
      SELECT doc_id, license, whole, gram, (pos // size) * size AS first_word FROM met
      UNION ALL
      SELECT doc_id, license, whole, gram, (pos // size - 1) * size FROM met WHERE size > 1 AND pos >= size
    ), counted AS (
      SELECT doc_id, license, whole, first_word, count(DISTINCT gram) AS shared FROM windows GROUP BY ALL
    ), best AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY shared DESC, first_word) AS place FROM counted
    )
    SELECT doc_id, license, CAST(whole AS INT) AS template_shingles, CAST(shared AS INT) AS shared_shingles,
           CAST(first_word AS INT) AS first_word
    FROM best WHERE place = 1 AND shared >= ceil({license_scan.CONTAINED} * whole)
    """


@query("op2_license_scans", _license_check())
def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _contamination_check() -> str:
    words = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH items AS (
      SELECT item_id, {words.format(LOWER.format("text"))} AS words FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
    ), wide AS (
      SELECT item_id, words, least(len(words), 13) AS width FROM items WHERE len(words) > 0
    ), phrases AS (
      SELECT DISTINCT item_id, width, array_to_string(words[i : i + width - 1], ' ') AS phrase
      FROM (SELECT *, unnest(range(1, len(words) - width + 2)) AS i FROM wide)
    ), texts AS (
      SELECT doc_id, {words.format(LOWER.format("coalesce(text, '')"))} AS words FROM documents
    ), runs AS (
      SELECT doc_id, i, width, array_to_string(words[i : i + width - 1], ' ') AS phrase
      FROM (SELECT doc_id, words, width, unnest(range(1, greatest(len(words) - width + 2, 1))) AS i
            FROM texts, (SELECT DISTINCT width FROM phrases))
    ), met AS (
      SELECT DISTINCT doc_id, i, width, item_id FROM runs JOIN phrases USING (width, phrase)
    ), hits AS (
      SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS word FROM met) GROUP BY doc_id
    ), found AS (
      SELECT doc_id, count(DISTINCT item_id) AS n_items,
             sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256
      FROM met GROUP BY doc_id
    )
    SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           coalesce(items_sha256, sha256('')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
    FROM texts LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)
    """


@query("op3_benchmark_decontamination", _contamination_check())
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select(
        "doc_id", "n_words", decontaminate.hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(quality.remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query(
    "op5_exact_dedup",
    f"""
    WITH texts AS (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS full_text FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(full_text) AS text_sha256
    FROM texts WINDOW w AS (PARTITION BY full_text)
    """,
)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


def _near_check() -> str:
    return f"""
    WITH RECURSIVE texts AS (
      SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents
    ), sets AS (
      SELECT DISTINCT doc_id, array_to_string(words[i : i + 2], ' ') AS gram
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, CAST(len(words) > 0 AS INT)) + 1)) AS i FROM texts)
    ), sizes AS (
      SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
    ), shared AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
      FROM sets a JOIN sets b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
    ), links AS (
      SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
      WHERE 100 * common >= 85 * (x.n + y.n - common)
    ), edges AS (
      SELECT a, b FROM links UNION ALL SELECT b, a FROM links
    ), reach AS (
      SELECT doc_id AS a, doc_id AS b FROM documents
      UNION
      SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b
    ), least_id AS (
      SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
    )
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM least_id LEFT JOIN sizes USING (doc_id)
    """


@query("op6_minhash_near_dedup", _near_check())
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, width=3, percent=85)


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(quality.remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs).drop("text")


@query("op10_source_mixing")
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"), "source", plain_word_count(F.col("text")).alias("size")
    )
    return mixing.plan(rows).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


@query(
    "op9_lm_scoring",
    f"""
    WITH texts AS (
      SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
    ), tokens AS (
      SELECT doc_id, words[i] AS w, CASE WHEN i > 1 THEN words[i - 1] END AS v, CASE WHEN i > 2 THEN words[i - 2] END AS u
      FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM texts)
    ), own1 AS (SELECT doc_id, w, count(*) AS n FROM tokens GROUP BY ALL
    ), own2 AS (SELECT doc_id, v, w, count(*) AS n FROM tokens WHERE v IS NOT NULL GROUP BY ALL
    ), own3 AS (SELECT doc_id, u, v, w, count(*) AS n FROM tokens WHERE u IS NOT NULL GROUP BY ALL
    ), all1 AS (SELECT w, sum(n) AS n FROM own1 GROUP BY ALL
    ), all2 AS (SELECT v, w, sum(n) AS n FROM own2 GROUP BY ALL
    ), all3 AS (SELECT u, v, w, sum(n) AS n FROM own3 GROUP BY ALL
    ), other1 AS (SELECT doc_id, w, a.n - o.n AS n FROM own1 o JOIN all1 a USING (w)
    ), other2 AS (SELECT doc_id, v, w, a.n - o.n AS n FROM own2 o JOIN all2 a USING (v, w)
    ), other3 AS (SELECT doc_id, u, v, w, a.n - o.n AS n FROM own3 o JOIN all3 a USING (u, v, w)
    ), lengths AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY ALL
    ), counts AS (
      SELECT t.doc_id, t.u, t.v, g3.n AS triple, c2.n AS triple_context, g2.n AS pair, c1.n AS pair_context,
             greatest(g1.n, 1) / greatest((SELECT count(*) FROM tokens) - l.n, 1) AS word
      FROM tokens t JOIN lengths l USING (doc_id)
      JOIN other1 g1 ON g1.doc_id = t.doc_id AND g1.w = t.w
      LEFT JOIN other1 c1 ON c1.doc_id = t.doc_id AND c1.w = t.v
      LEFT JOIN other2 g2 ON g2.doc_id = t.doc_id AND g2.v = t.v AND g2.w = t.w
      LEFT JOIN other2 c2 ON c2.doc_id = t.doc_id AND c2.v = t.u AND c2.w = t.v
      LEFT JOIN other3 g3 ON g3.doc_id = t.doc_id AND g3.u = t.u AND g3.v = t.v AND g3.w = t.w
    ), scored AS (
      SELECT *, CASE WHEN pair > 0 THEN pair / pair_context WHEN v IS NULL THEN word ELSE 0.4 * word END AS by_pair FROM counts
    )
    SELECT doc_id, count(*) AS n_words,
           round(avg(ln(CASE WHEN triple > 0 THEN triple / triple_context WHEN u IS NULL THEN by_pair ELSE 0.4 * by_pair END)), 6) AS log_score
    FROM scored GROUP BY doc_id
    """,
)
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return backoff_lm.score(docs).withColumn("log_score", F.round("log_score", 6))


@query("op13_byte_bpe_round_trip")
def op13_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = byte_bpe.Vocabulary.from_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    decoded = byte_bpe.decode(encoded.select("doc_id", "ids"), vocabulary)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op11_cross_tokenizer_alignment")
def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a = byte_bpe.Vocabulary.from_tokenizer_json(public_tokenizers.path("byte_bpe_50k.json"))
    b = token_alignment.Pieces.from_file(public_tokenizers.path("piece_bpe_32k.model"))
    found = token_alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), a, b, digest=True)
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256")
    )


def _codes_check() -> str:
    rounds = []
    for t in range(vector_codes.ROUNDS + 1):
        rounds.append(f"""a{t} AS MATERIALIZED (
      SELECT vec_id, label, p, x, min(16 * d + e) AS m FROM (
        SELECT vec_id, label, parts.p, x, e,
               CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
        FROM parts JOIN c{t} ON parts.p = c{t}.p)
      GROUP BY ALL
    )""")
        if t < vector_codes.ROUNDS:
            rounds.append(f"""c{t + 1} AS MATERIALIZED (
      SELECT p, e, coalesce(mean, c) AS c FROM c{t} LEFT JOIN (
        SELECT p, e, list(CAST(floor(CAST(total AS DOUBLE) / n) AS BIGINT) ORDER BY i) AS mean FROM (
          SELECT p, m % 16 AS e, i, sum(x[i]) AS total, count(*) AS n
          FROM (SELECT p, m, x, unnest(range(1, len(x) + 1)) AS i FROM a{t}) GROUP BY ALL)
        GROUP BY p, e) USING (p, e)
    )""")
    last = vector_codes.ROUNDS
    joined = ", ".join(rounds)
    return f"""
    WITH ints AS (
      SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), parts AS MATERIALIZED (
      SELECT vec_id, label, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS x
      FROM (SELECT *, unnest(range(8)) AS p FROM ints)
    ), c0 AS (
      SELECT p, e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 16
    ), {joined}, coded AS (
      SELECT vec_id, label, string_agg(printf('%02x', m % 16), '' ORDER BY p) AS code, CAST(sum(m // 16) AS BIGINT) AS error
      FROM a{last} GROUP BY vec_id, label
    )
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
           (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i))
            FROM (SELECT p, e, unnest(c) AS v, unnest(range(len(c))) AS i FROM c{last})) AS codebooks_sha256
    FROM coded
    """


@query("op12_vector_code_compression", _codes_check())
def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    digits = F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    return vector_codes.with_label_errors(coded).select(
        "vec_id", F.array_join(digits, "").alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )
