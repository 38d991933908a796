"""Toxicity: a linear model over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incident_signals.llm import hashing
from incident_signals.llm.quality import training_rows

ORDERS = (3, 4, 5, 6)
BUCKET_BITS = 22
# N-grams of the model, those with the largest chi-square over the training texts.
FEATURES = 4096
SMOOTH = 1.0
LEAST_TEXTS = 3
PENALTY = 0.01
STEPS = 300
_SALTS = hashing.constants(8, 5) | np.uint64(1)
_BASE = np.uint64(0x100000001B3)


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts (A-Z lower-cased, other ASCII signs as blanks) and their offsets."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    plain = np.array([c if chr(c).isalnum() else 32 for c in range(128)], np.uint32)
    plain[65:91] += 32
    low = points < 128
    out = points.copy()
    out[low] = plain[points[low]]
    return out, before[offsets]


def grams(data: np.ndarray, offsets: np.ndarray):
    """(places, buckets) per order: n-grams inside one text, a text's start counting as a blank before it."""
    points, bounds = _characters(data, offsets)
    counts = np.diff(bounds)
    # one blank before each text, so that its first word is seen as a word's beginning
    text = np.repeat(np.arange(len(counts)), counts)
    padded = np.full(len(points) + len(counts), 32, np.uint64)
    padded[np.arange(len(points)) + text + 1] = points
    bounds = bounds + np.arange(len(bounds))
    sizes = counts + 1
    left = np.repeat(bounds[1:], sizes) - np.arange(len(padded))
    rolled = np.zeros(len(padded), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if n > len(padded):
            break
        rolled = rolled[: len(padded) - n + 1] * _BASE + padded[n - 1 :]
        if n in ORDERS:
            at = np.flatnonzero(left[: len(rolled)] >= n)
            yield at, (hashing.mix(rolled[at] * _SALTS[n]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), bounds


def _present(texts: pa.Array, slots: np.ndarray | None):
    """(first row, text, bucket) of the distinct n-grams of each text; with ``slots`` only those it has, as its numbers."""
    for first, last, data, offsets in hashing.text_chunks(texts, 500_000):
        keys = []
        for at, bucket, bounds in grams(data, offsets):
            if slots is not None:
                slot = slots[bucket]
                keep = slot >= 0
                at, bucket = at[keep], slot[keep].astype(np.int64)
            keys.append((np.searchsorted(bounds, at, "right") - 1 << BUCKET_BITS) | bucket)
        every = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
        yield first, every >> BUCKET_BITS, every & ((1 << BUCKET_BITS) - 1)


class Model:
    """Weight per n-gram bucket, already times its log-count ratio."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: float):
        self.buckets, self.weights, self.bias = buckets, weights, bias

    def slots(self) -> np.ndarray:
        out = np.full(1 << BUCKET_BITS, -1, np.int16)
        out[self.buckets] = np.arange(len(self.buckets))
        return out

    def score(self, texts: pa.Array, slots: np.ndarray) -> np.ndarray:
        margin = np.full(len(texts), self.bias)
        for first, text, slot in _present(texts, slots):
            np.add.at(margin, first + text, self.weights[slot])
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))


def _logistic(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the scaled features by accelerated gradient steps with a square penalty."""
    lengths = np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(rows)), lengths)
    column = np.concatenate(rows) if len(rows) else np.empty(0, np.int64)
    value = ratios[column]
    share = (y.sum() + 0.5) / (len(y) + 1)
    w, bias = np.zeros(len(ratios)), float(np.log(share / (1 - share)))
    # per-feature step from the diagonal of the curvature
    square = np.bincount(column, value * value, len(ratios)) / max(len(y), 1)
    lengths_mean = max(1.0, lengths.mean()) if len(rows) else 1.0
    step = 1.0 / (0.25 * square * lengths_mean + PENALTY)
    velocity, moved = np.zeros(len(ratios)), 0.0
    for i in range(STEPS):
        pace = i / (i + 3)
        ahead, ahead_bias = w + pace * velocity, bias + pace * moved
        margin = np.bincount(row, value * ahead[column], len(rows)) + ahead_bias
        wrong = 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35))) - y
        slope = np.bincount(column, value * wrong[row], len(ratios)) / len(y) + PENALTY * ahead / len(y)
        new = ahead - step * slope
        new_bias = ahead_bias - wrong.mean() / 0.25 / lengths_mean
        velocity, moved, w, bias = new - w, new_bias - bias, new, new_bias
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Model:
    """Fits on at most ``quality.TRAINING_ROWS`` labelled texts; the caller leaves out rows to hold back.

    N-gram counts are gathered as an aggregation over the training texts.
    Without labelled texts, or with one class only, every text gets the same score.
    """
    sample = training_rows(labels, label, key)
    joined = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(sample), "_key")
    texts = joined.select("_text", "_label")

    def counted(batches):
        seen = np.zeros((2, 1 << BUCKET_BITS), np.int32)
        totals = np.zeros(2, np.int64)
        for batch in batches:
            y = (batch.column(1).to_numpy(zero_copy_only=False) > 0.5).astype(np.int64)
            totals += np.bincount(y, minlength=2)
            for first, row, bucket in _present(batch.column(0), None):
                of = y[first + row]
                for c in (0, 1):
                    seen[c] += np.bincount(bucket[of == c], minlength=1 << BUCKET_BITS).astype(np.int32)
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(seen[0, at], totals[0]).astype(np.int64)),
             pa.array(np.append(seen[1, at], totals[1]).astype(np.int64))],
            names=["bucket", "without", "with_"],
        )

    counts = texts.mapInArrow(counted, "bucket long, without long, with_ long").groupBy("bucket").agg(
        F.sum("without").alias("a"), F.sum("with_").alias("b")
    )
    totals = texts.agg(F.count(F.when(F.col("_label") <= 0.5, 1)), F.count(F.when(F.col("_label") > 0.5, 1))).first()
    no, yes = totals[0], totals[1]
    if not no or not yes:
        share = (yes + 0.5) / (no + yes + 1)
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    seen = a + b
    chi = (no + yes) * F.pow(b * (F.lit(float(no)) - a) - a * (F.lit(float(yes)) - b), 2) / (
        seen * F.greatest(F.lit(float(no + yes)) - seen, F.lit(0.5)) * float(no) * float(yes)
    )
    chosen = (
        counts.where((F.col("bucket") >= 0) & (seen >= LEAST_TEXTS))
        .select("bucket", "a", "b", chi.alias("chi")).orderBy(F.desc("chi"), "bucket").limit(FEATURES).collect()
    )
    buckets = np.array([r.bucket for r in chosen], np.int64)
    with_, without = (np.array([r[c] for r in chosen], float) for c in ("b", "a"))
    ratios = np.log((with_ + SMOOTH) / (yes + 2 * SMOOTH)) - np.log((without + SMOOTH) / (no + 2 * SMOOTH))
    empty = Model(buckets, ratios, 0.0)

    def held(batches):
        slots = empty.slots()
        for batch in batches:
            rows: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for first, row, slot in _present(batch.column(0), slots):
                edges = np.searchsorted(row, np.arange(int(row.max()) + 2)) if len(row) else [0]
                for i in range(len(edges) - 1):
                    rows[first + i] = slot[edges[i] : edges[i + 1]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column(1)], names=["x", "y"])

    rows = texts.mapInArrow(held, "x array<int>, y double").collect()
    rows.sort(key=lambda r: (r.y, r.x))  # the same model whatever order the rows come in
    weights, bias = _logistic([np.array(r.x, np.int64) for r in rows], np.array([float(r.y > 0.5) for r in rows]), ratios)
    return Model(buckets, weights * ratios, bias)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from 0.5 on).

    Null counts as empty text.  Every row stays, repeated ones too; columns with
    the new names are replaced, others pass unread.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])

    def scored(batches):
        slots = model.slots()
        for batch in batches:
            got = model.score(batch.column(batch.schema.get_field_index(text)), slots)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(got), pa.array((got >= 0.5).astype(np.int32))],
                names=[*batch.schema.names, "score", "predicted"],
            )

    schema = T.StructType(rows.schema.fields + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(scored, schema)
