"""Quality classifier: an additive model over surface measures of a text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incident_signals.llm import gam, hashing

# Labelled rows used to fit at most; those with the smallest hash of their id are taken.
TRAINING_ROWS = 20_000
FEATURES = [
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "beyond_ascii", "blank", "symbol_runs",
    "distinct_words", "repeated_next", "one_byte_words", "words_per_line", "distinct_lines", "symbol_ended_words",
    "upper_words",
]
_LINES = np.ones(256, bool)
_LINES[10] = False
_KIND = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "symbol": np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)]),
    "beyond": np.arange(256) > 127,
    "blank": ~hashing.PLAIN_WORDS,
}


def measures(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; a text without words has zeros but for its length."""
    out = np.zeros((len(texts), len(FEATURES)))
    for first, last, data, offsets in hashing.text_chunks(texts):
        size = np.diff(offsets)

        def share(flags, over=size):
            sums = np.concatenate([[0], np.cumsum(flags)])
            return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(over, 1)

        kinds = {name: table[data] for name, table in _KIND.items()}
        runs = np.zeros(len(data), bool)
        runs[1:] = kinds["symbol"][1:] & kinds["symbol"][:-1]
        words, bounds, starts, ends = hashing.word_hashes(data, offsets, hashing.PLAIN_WORDS)
        n = np.diff(bounds)

        def per_word(flags):
            sums = np.concatenate([[0], np.cumsum(flags)])
            return (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n, 1)

        same = np.zeros(len(words), bool)
        same[1:] = words[1:] == words[:-1]
        same[bounds[:-1][bounds[:-1] < len(words)]] = False
        lines, line_bounds, _, _ = hashing.word_hashes(data, offsets, _LINES)
        n_lines = np.diff(line_bounds)
        shouted = kinds["upper"][starts] & kinds["upper"][np.minimum(starts + 1, ends - 1)] & (ends - starts > 1)
        out[first:last] = np.stack([
            np.log1p(size), np.log1p(n), per_word(ends - starts), share(kinds["upper"]), share(kinds["digit"]),
            share(kinds["symbol"]), share(kinds["beyond"]), share(kinds["blank"]), share(runs),
            np.diff(hashing.distinct(words, bounds)[1]) / np.maximum(n, 1), per_word(same),
            per_word(ends - starts == 1), n / np.maximum(n_lines, 1),
            np.diff(hashing.distinct(lines, line_bounds)[1]) / np.maximum(n_lines, 1),
            per_word(kinds["symbol"][ends - 1]), per_word(shouted),
        ], axis=1)
    return out


def training_rows(labels: DataFrame, label: str, key: str = "doc_id", most: int = TRAINING_ROWS) -> DataFrame:
    """At most ``most`` labelled rows, those with the smallest hash of the key; rows without key or label are left out."""
    return (
        labels.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{label}`").cast("double").alias("_label"))
        .where("_key IS NOT NULL AND _label IS NOT NULL")
        .orderBy(F.xxhash64("_key"), "_key", "_label")
        .limit(most)
    )


def remainder(key: Column, of: int) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(of))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> gam.Gam:
    """Fits on the texts of the labelled rows; the caller leaves out rows to hold back.

    Without labelled texts, or with one class only, every text gets the same score.
    """
    sample = training_rows(labels, label, key)
    joined = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).join(
        F.broadcast(sample), "_key"
    )

    def measured(batches):
        for batch in batches:
            x = measures(batch.column(0))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([flat, batch.column(1)], names=["x", "y"])

    rows = joined.select("_text", "_label").mapInArrow(measured, "x array<double>, y double").collect()
    rows.sort(key=lambda r: (r.y, r.x))  # the same model whatever order the rows come in
    x = np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES))
    return gam.fit(x, np.array([r.y for r in rows]))


def score(docs: DataFrame, model: gam.Gam, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from 0.5 on).

    Null counts as empty text.  Every row stays, repeated ones too; columns with
    the new names are replaced, others pass unread.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])

    def scored(batches):
        for batch in batches:
            got = model.score(measures(batch.column(batch.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(got), pa.array((got >= 0.5).astype(np.int32))],
                names=[*batch.schema.names, "score", "predicted"],
            )

    schema = T.StructType(rows.schema.fields + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(scored, schema)
