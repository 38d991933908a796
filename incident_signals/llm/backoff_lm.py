"""Stupid-backoff scores by joins with n-gram count tables.

Texts are dealt into blocks of bounded size by hash.  Each block explodes its
n-grams and counts them; the counts meet in tables partitioned by ranges of the
n-gram hash, where each is joined to its occurrences in all texts.  These return
to the blocks, where they are joined to the n-grams of each text, and the
logarithms are summed per text.  A text's own occurrences are taken off the
counts, so that a text is scored by the others and backing off really occurs.

A block sends an n-gram once however many of its texts hold it, and gets counts
back in the order it sent them: a frequent n-gram has as many entries as there
are blocks, no row per word leaves a block, and each text is shuffled once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incident_signals.llm import hashing

ORDER = 3
BACKOFF = 0.4
# Bytes of text that one task explodes at once.
BLOCK_BYTES = 12 << 20
# Count tables: so many, and one more for so many blocks.
TABLES, BLOCKS_PER_TABLE = 64, 4
# Stands for any word: its count is the number of words.
ANY_WORD = 0


def _ngrams(words: np.ndarray, bounds: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes of the n-grams of 1, 2 ... ``order`` words that end at each word, and whether the text reaches back so far."""
    place = np.arange(len(words)) - np.repeat(bounds[:-1], np.diff(bounds))
    grams, known = [words], [np.ones(len(words), bool)]
    for size in range(2, order + 1):
        longer = np.zeros(len(words), np.uint64)
        before = grams[-1][:-1] * np.uint64(0x9E3779B97F4A7C15)
        longer[1:] = hashing.mix(before + words[1:] * np.uint64(2 * size + 1))
        grams.append(longer)
        known.append(place >= size - 1)
    return grams, known


def _chunks(column: pa.Array, order: int):
    """(first text, words of each text, n-grams, known) of runs of texts."""
    for first, _, data, offsets in hashing.text_chunks(column):
        words, bounds, _, _ = hashing.word_hashes(data, offsets, hashing.LETTER_WORDS)
        yield first, np.diff(bounds), *_ngrams(words, bounds, order)


def _merged(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams and the sums of their counts."""
    gram, count = np.concatenate(grams), np.concatenate(counts)
    order = np.argsort(gram)
    gram, count = gram[order], count[order]
    starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    return gram[starts], np.add.reduceat(count, starts)


def _block_counts(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of a block, ``ANY_WORD`` first, and their occurrences in it."""
    grams, counts, n_words = [], [], 0
    for _, sizes, by_size, known in _chunks(column, order):
        gram, count = np.unique(np.concatenate([g[k] for g, k in zip(by_size, known)]), return_counts=True)
        grams.append(gram)
        counts.append(count)
        n_words += int(sizes.sum())
    return _merged([np.array([ANY_WORD], np.uint64), *grams], [np.array([n_words]), *counts])


def _own(grams: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How often each n-gram occurs in its own text."""
    order = np.lexsort((grams, text))
    g, t = grams[order], text[order]
    fresh = np.append(True, (g[1:] != g[:-1]) | (t[1:] != t[:-1]))[: len(g)]
    group = np.cumsum(fresh) - 1
    out = np.empty(len(g), np.int64)
    out[order] = np.bincount(group)[group] if len(g) else 0
    return out


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers with bytes of equal weight side by side, behind their number: zstd codes the uneven ones in part
    of a byte, which the compression of shuffles does not."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: pa.Scalar) -> np.ndarray:
    stored = data.as_buffer()
    n = int.from_bytes(stored[:8].to_pybytes(), "little")
    planes = np.frombuffer(pa.decompress(stored[8:], decompressed_size=8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def counted(texts: DataFrame, order: int, tables: int) -> DataFrame:
    """``table, block, grams, counts``: the distinct n-grams of each block (as steps from one to the next) and their
    occurrences in it, packed; a table is a range of hashes."""
    width = np.uint64((1 << 64) // tables + 1)

    def run(group: pa.Table) -> pa.Table:
        grams, counts = _block_counts(group.column("text"), order)
        bounds = np.searchsorted(grams // width, np.arange(tables + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(bounds))
        slices = [slice(bounds[t], bounds[t + 1]) for t in full]
        return pa.table({
            "table": pa.array(full, pa.int32()),
            "block": pa.array(np.full(len(full), group.column("block")[0].as_py()), pa.int32()),
            "grams": pa.array([_packed(np.diff(grams[s], prepend=np.uint64(0))) for s in slices], pa.binary()),
            "counts": pa.array([_packed(counts[s]) for s in slices], pa.binary()),
        })

    return texts.groupBy("block").applyInArrow(run, "table int, block int, grams binary, counts binary")


def totalled(rows: DataFrame) -> DataFrame:
    """``table, block, counts``: for the n-grams of each row of ``counted``, in their order, the occurrences in all texts."""

    def run(group: pa.Table) -> pa.Table:
        parts = [np.cumsum(_unpacked(g)) for g in group.column("grams")]
        grams = np.concatenate(parts)
        order = np.argsort(grams, kind="stable")  # merges the sorted parts
        grams = grams[order]
        starts = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
        del grams
        counts = np.concatenate([_unpacked(c) for c in group.column("counts")])
        sums = np.add.reduceat(counts[order], starts)
        counts[order] = np.repeat(sums, np.diff(np.append(starts, len(order))))
        ends = np.cumsum([len(p) for p in parts])[:-1]
        return pa.table({
            "table": group.column("table"),
            "block": group.column("block"),
            "counts": pa.array([_packed(c) for c in np.split(counts, ends)], pa.binary()),
        })

    return rows.groupBy("table").applyInArrow(run, "table int, block int, counts binary")


def _scored(texts: pa.Table, totals: pa.Table, order: int, backoff: float) -> pa.Table:
    """``row, n_words, log_sum`` of each text of a block that has words."""
    column = texts.column("text")
    grams, own = _block_counts(column, order)
    totals = totals.sort_by("table")
    counts = np.concatenate([_unpacked(c) for c in totals.column("counts")] or [np.empty(0, np.uint64)]).astype(np.int64)
    if len(counts) != len(own) or (counts < own).any():
        raise RuntimeError("a block of texts changed between counting and scoring")
    total = counts[0]
    del own
    rows, words, sums = [], [], []
    for first, sizes, by_size, known in _chunks(column, order):
        text = np.repeat(np.arange(len(sizes)), sizes)
        value, before = None, None
        for gram, there in zip(by_size, known):
            gram = np.where(there, gram, np.uint64(ANY_WORD))
            distinct, back = np.unique(gram, return_inverse=True)
            others = counts[np.searchsorted(grams, distinct)][back] - _own(gram, text)
            if value is None:
                value = np.maximum(others, 1) / np.maximum(total - sizes[text], 1)
            else:
                # the context of an n-gram is the shorter n-gram that ends one word earlier;
                # where the text does not reach back so far, nothing is given up
                context = np.append(1, before[:-1])[: len(before)]
                longer = np.where(others > 0, others / np.maximum(context, 1), backoff * value)
                value = np.where(there, longer, value)
            before = others
        full = np.flatnonzero(sizes)
        rows.append(first + full)
        words.append(sizes[full])
        sums.append(np.bincount(text, np.log(value), len(sizes))[full])
    return pa.table({
        "row": texts.column("row").take(pa.array(np.concatenate([np.empty(0, np.int64), *rows]))),
        "n_words": pa.array(np.concatenate([np.empty(0, np.int64), *words]), pa.int64()),
        "log_sum": pa.array(np.concatenate([np.empty(0), *sums])),
    })


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """``key``, ``n_words`` and ``log_score`` (mean natural logarithm per word) of each text with words.

    Words are runs of letters and digits, A-Z lower-cased.  A word's score is the
    count of the longest n-gram that other texts hold, over the count of its
    context, times ``backoff`` for each word given up; a single word that no other
    text holds counts as one occurrence.  Texts without words, and null texts,
    have no row.  Rows that repeat a key are scored as one text's parts: their
    words add up.  No texts, no rows; other columns are not read.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("row"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    blocks = size // BLOCK_BYTES + 1
    # rows equal in key and text part by where they are read
    block = F.pmod(F.xxhash64("row", "text", F.spark_partition_id()), F.lit(blocks)).cast("int")
    texts = rows.withColumn("block", block)
    totals = totalled(counted(texts, order, TABLES + blocks // BLOCKS_PER_TABLE))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _scored(left, right, order, backoff)

    scored = texts.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(run, "row long, n_words long, log_sum double")
    return scored.groupBy(F.col("row").alias(key)).agg(
        F.sum("n_words").alias("n_words"), (F.sum("log_sum") / F.sum("n_words")).alias("log_score")
    )
