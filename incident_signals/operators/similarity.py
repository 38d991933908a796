"""Exact nearest reports by cosine similarity.

Vectors and queries are dealt into a grid: a cell is one slice of the vectors, of
bounded size, and one group of the queries.  A task holds the slice of its cell and
takes the queries block by block: score matrices of a block and a piece of the slice
are cut to the scores that reach the k-th best so far, and a piece too short to
reach it for a query is not multiplied.  Each vector goes to as many tasks as there
are groups, each query to as many as there are slices, and only the best k per query
and cell are shuffled again.  Exact, without emitting pairs; nothing passes the driver.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incident_signals import fixed_values as fixed

# The helpers below run inside tasks; they travel with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Queries that a task compares at once.
QUERY_BATCH_BYTES = 16 << 20
# Vectors that a task holds.
SLICE_BYTES = 16 << 20
# Vectors that a block of queries is compared with at once.
_ROWS = 4096
# Queries whose scores are held at once.
_COLUMNS = 512
# Scores closer than this count as equal, whatever order a processor adds them in.
SCORE_DIGITS = 12
METADATA = ["description", "site", "location", "date", "report_type"]


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def unit_vector(vector: Column) -> Column:
    """Scaled to length 1; a zero vector stays as it is."""
    scaled = F.transform(F.array(norm(vector)), lambda n: F.transform(vector, lambda x: F.when(n > 0, x / n).otherwise(x)))
    return F.element_at(scaled, 1)


def inner_product(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def _flat(lists: pa.Array) -> np.ndarray:
    """Vectors as one matrix."""
    values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return values.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


class _Best:
    """The k best vectors of a block of queries so far, ties by vector id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.norms = np.sqrt((queries * queries).sum(axis=1))
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids = np.zeros((len(queries), k), np.int64)

    def add(self, ids: np.ndarray, vectors: np.ndarray, longest: float, excluded: tuple[np.ndarray, np.ndarray]) -> None:
        """``excluded`` are the (query, vector) pairs that must not meet, by query."""
        # no score is above the product of the lengths
        within = np.flatnonzero(self.norms * longest * (1 + 1e-9) + 1e-9 >= self.scores[:, -1])
        rows, columns = excluded
        for at in range(0, len(within), _COLUMNS):
            part = within[at : at + _COLUMNS]
            scores = self.queries[part] @ vectors.T
            if len(rows):
                place = np.searchsorted(part, rows)
                met = np.flatnonzero(place < len(part))
                met = met[part[place[met]] == rows[met]]
                scores[place[met], columns[met]] = -np.inf
            self._merge(part, ids, scores)

    def _merge(self, part: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        k = self.k
        least = self.scores[part, -1]
        if scores.shape[1] > k and not np.isfinite(least).all():
            least = np.maximum(least, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
        # only scores that reach the k-th best are rounded; what rounding can lift is let through
        row, column = np.nonzero(scores >= (least - 10.0 ** (1 - SCORE_DIGITS) - 1e-15 * np.abs(least))[:, None])
        value = np.round(scores[row, column], SCORE_DIGITS)
        real = value > -np.inf
        row, value, name = row[real], value[real], ids[column[real]]
        changed = np.unique(row)
        old = np.repeat(changed, k)
        row = np.concatenate([old, row])
        value = np.concatenate([self.scores[part[changed]].ravel(), value])
        name = np.concatenate([self.ids[part[changed]].ravel(), name])
        order = np.lexsort((name, -value, row))
        row, value, name = row[order], value[order], name[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kept = rank < k
        self.scores[part[row[kept]], rank[kept]] = value[kept]
        self.ids[part[row[kept]], rank[kept]] = name[kept]


def _pairs(reports: list, barred: list) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs that must not meet, by query."""
    if all(e is None for e in barred):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, _ = pd.factorize(np.array([*reports, *barred], dtype=object))
    own, wanted = codes[: len(reports)], codes[len(reports) :]
    order = np.argsort(own, kind="stable")
    low, high = np.searchsorted(own[order], wanted), np.searchsorted(own[order], wanted, "right")
    count = np.where(wanted >= 0, high - low, 0)
    ends = np.cumsum(count)
    places = np.arange(ends[-1]) - np.repeat(ends - count - low, count)
    return np.repeat(np.arange(len(barred)), count), order[places]


class _Slice:
    """The vectors of a cell, compared with a block of queries in pieces that stay small."""

    def __init__(self, ids: np.ndarray, reports: list, vectors: np.ndarray):
        self.ids, self.reports, self.vectors = ids, reports, vectors
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        self.pieces = [
            (slice(at, at + _ROWS), lengths[at : at + _ROWS].max()) for at in range(0, len(ids), _ROWS)
        ]

    def nearest(self, queries: np.ndarray, barred: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best = _Best(queries, k)
        for piece, longest in self.pieces:
            best.add(self.ids[piece], self.vectors[piece], longest, _pairs(self.reports[piece], barred))
        row, place = np.nonzero(best.scores > -np.inf)
        return row, best.ids[row, place], best.scores[row, place]


def _cells(side: DataFrame, own: str, parts: int, other: int, by_row: bool) -> DataFrame:
    """Rows of one side of the grid, once for each part of the other side."""
    part = F.pmod(F.xxhash64(own), F.lit(parts))
    across = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
    placed = side.withColumn("_part", part).withColumn("_across", across)
    cell = F.col("_part") * other + F.col("_across") if by_row else F.col("_across") * parts + F.col("_part")
    return placed.withColumn("_cell", cell.cast("int")).drop("_part", "_across")


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = fixed.RETRIEVAL_TOP_K, batch_bytes: int = QUERY_BATCH_BYTES
) -> DataFrame:
    """(query_id, rank, vector_id, score) of the k nearest vectors per query.

    ``vectors`` has vector_id, report_id and embedding; ``queries`` has
    query_id, embedding and optionally exclude_id, a report that must not
    appear among the query's own results.  A task holds one slice of the
    vectors and takes its queries in blocks of ``batch_bytes``.
    """
    if not isinstance(k, int) or k < 1:
        raise ValueError(f"k is {k!r}, not a whole number from 1")
    spark = vectors.sparkSession
    searched = vectors.select(F.col("vector_id").cast("bigint").alias("vector_id"), "report_id", F.col("embedding").cast("array<double>"))
    skip = F.col("exclude_id") if "exclude_id" in queries.columns else F.lit(None).cast(searched.schema["report_id"].dataType)
    asked = queries.select("query_id", F.col("embedding").cast("array<double>"), skip.alias("exclude_id"))
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, vector_id bigint, score double"
    held = searched.agg(F.coalesce(F.sum(8 * F.size("embedding") + 64), F.lit(0))).first()[0]
    sent = asked.agg(F.coalesce(F.sum(8 * F.size("embedding") + 64), F.lit(0))).first()[0]
    slices = max(1, math.ceil(held / SLICE_BYTES))
    # as many cells as keep all cores busy, but none for less than a block of queries
    groups = max(1, min(math.ceil(2 * spark.sparkContext.defaultParallelism / slices), math.ceil(sent / batch_bytes)))
    both = (
        _cells(searched.withColumn("_asked", F.lit(False)), "vector_id", slices, groups, True)
        .unionByName(_cells(asked.withColumn("_asked", F.lit(True)), "query_id", groups, slices, False), allowMissingColumns=True)
        .repartitionById(slices * groups, "_cell")
        .sortWithinPartitions("_asked")
        .select("_asked", "vector_id", "report_id", "query_id", "exclude_id", "embedding")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, reports, parts, slice_ = [], [], [], None
        for batch in batches:
            asked_here = batch.column(0).to_numpy(zero_copy_only=False)
            own, others = batch.slice(0, int((~asked_here).sum())), batch.slice(int((~asked_here).sum()))
            if own.num_rows:
                ids.append(own.column(1).to_numpy())
                reports += own.column(2).to_pylist()
                parts.append(_flat(own.column(5)))
            if not others.num_rows or not ids:
                continue
            if slice_ is None:
                slice_ = _Slice(np.concatenate(ids), reports, np.concatenate(parts))
            step = max(1, batch_bytes // (8 * slice_.vectors.shape[1] + 64))
            for at in range(0, others.num_rows, step):
                block = others.slice(at, step)
                row, found, score = slice_.nearest(_flat(block.column(5)), block.column(4).to_pylist(), k)
                yield pa.RecordBatch.from_arrays(
                    [block.column(3).take(pa.array(row)), pa.array(found), pa.array(score)], names=["query_id", "vector_id", "score"]
                )

    found = both.mapInArrow(search, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vector_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_incidents(ranked: DataFrame, vectors: DataFrame) -> DataFrame:
    """Published result columns: rank, ids, rounded score and the report's metadata."""
    meta = [name for name in METADATA if name in vectors.columns]
    known = vectors.select("vector_id", F.col("report_id").alias("incident_id"), *meta)
    return ranked.join(known, "vector_id").select(
        "query_id", "rank", "vector_id", "incident_id", F.round("score", 4).alias("similarity_score"), *meta
    )


def retrieve(
    vectors: DataFrame, queries: DataFrame, embedder, k: int = fixed.RETRIEVAL_TOP_K, text: str = "query"
) -> DataFrame:
    """Nearest incidents of free-text queries (query_id, text[, exclude_id])."""
    from incident_signals.functions.text import is_blank, normalize_text

    if queries.where(is_blank(F.col(text))).limit(1).count():
        raise ValueError("a query without text has no neighbours")
    if vectors.limit(1).count() == 0:
        raise RuntimeError("there are no vectors to search")
    cleaned = queries.withColumn("_plain", normalize_text(F.col(text))).withColumn(
        "_clean", F.when(F.col("_plain") == "", F.col(text)).otherwise(F.col("_plain"))
    )
    embedded = embedder.embed(cleaned, "_clean", "embedding")
    return with_incidents(top_k(vectors, embedded, k), vectors)


# --- the vector table -------------------------------------------------------------------------


def vector_info(vectors: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return vectors.agg(
        n.alias("rows"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension"), (n > 0).alias("loaded")
    )


def vector_checks(vectors: DataFrame) -> DataFrame:
    """One row of facts a usable vector table must satisfy."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    n = F.count(F.lit(1))
    return vectors.agg(
        n.alias("rows"),
        F.coalesce(F.min(F.size("embedding")), F.lit(0)).alias("min_dimension"),
        F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("max_dimension"),
        F.count_if(F.col("embedding").isNull() | F.coalesce(bad, F.lit(False))).alias("not_finite"),
        F.count_if(F.col("report_id").isNull()).alias("missing_report_ids"),
        F.coalesce(F.min("vector_id"), F.lit(0)).alias("first_id"),
        (F.coalesce(F.max("vector_id"), F.lit(-1)) + 1 == n).alias("ids_aligned"),
    )


def assert_vectors(vectors: DataFrame, dimension: int | None = None) -> None:
    found = vector_checks(vectors).first()
    problems = []
    if found["rows"] == 0:
        problems.append("no rows")
    if found["min_dimension"] != found["max_dimension"] or found["max_dimension"] < 1:
        problems.append("vectors differ in dimension")
    if dimension is not None and found["max_dimension"] != dimension:
        problems.append(f"dimension is {found['max_dimension']}, expected {dimension}")
    if found["not_finite"]:
        problems.append(f"{found['not_finite']} vectors are not finite")
    if found["missing_report_ids"]:
        problems.append(f"{found['missing_report_ids']} rows have no report id")
    if found["rows"] and (found["first_id"] != 0 or not found["ids_aligned"]):
        problems.append("vector ids are not 0..n-1")
    if problems:
        raise ValueError("vectors cannot be searched: " + "; ".join(problems))
