"""Benchmark decontamination: one FM-index per shard of training texts.

A shard is a run of texts inside one Arrow batch.  Its words become numbers of
the benchmark's vocabulary, an FM-index is built over them, every benchmark
phrase is searched backward, and the occurrences are merged to word and byte
spans.  Texts are neither shuffled nor compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incident_signals.llm import hashing
from incident_signals.llm.components import settled
from incident_signals.llm.fm_index import FMIndex

WINDOW = 13
# Benchmark text held by a task at once; further text is searched in further passes over the same rows.
BLOCK_BYTES = 8_000_000
SHARD_BYTES = 1_500_000
# A text counts as contaminated if at least one word in this many is hit.
WORDS_PER_HIT = 20

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_FOUND = [("n_words", T.LongType()), ("word_spans", SPAN), ("byte_spans", SPAN), ("items", T.ArrayType(T.StringType()))]
_ARROW_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Phrases:
    """The distinct windows of one block of benchmark items, as numbers of its own vocabulary."""

    def __init__(self, items: list[tuple[str, str]], width: int = WINDOW):
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        column = pa.array([text for _, text in items], pa.string())
        owners: dict[tuple[int, ...], set[int]] = {}
        texts: list[np.ndarray] = []
        for first, last, data, offsets in hashing.text_chunks(column):
            words, bounds, _, _ = hashing.word_hashes(data, offsets, hashing.LETTER_WORDS)
            texts += [words[bounds[i] : bounds[i + 1]] for i in range(last - first)]
        self.vocabulary = np.unique(np.concatenate(texts)) if texts else np.empty(0, np.uint64)
        for (name, _), words in zip(items, texts):
            numbers = (np.searchsorted(self.vocabulary, words) + 1).tolist()
            size = min(width, len(numbers))
            for at in range(len(numbers) - size + 1 if size else 0):
                owners.setdefault(tuple(numbers[at : at + size]), set()).add(number[name])
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.patterns = np.zeros((len(owners), width), np.int64)
        for i, phrase in enumerate(owners):
            self.patterns[i, : len(phrase)] = phrase
        self.owner_ends = np.cumsum([len(o) for o in owners.values()]).astype(np.int64)
        self.owners = np.array([o for each in owners.values() for o in sorted(each)], np.int64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def numbers_of(self, words: np.ndarray) -> np.ndarray:
        """Vocabulary numbers from 1; 0 for any other word."""
        out = np.zeros(len(words), np.int64)
        at = np.flatnonzero(self.maybe[(words & np.uint64(0xFFFF)).astype(np.int64)])
        if len(at):
            found = np.searchsorted(self.vocabulary, words[at])
            found[found == len(self.vocabulary)] = 0
            same = self.vocabulary[found] == words[at]
            out[at[same]] = found[same] + 1
        return out

    def occurrences(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, length, phrase) of every occurrence in a shard of texts laid end to end."""
        nothing = np.empty(0, np.int64)
        if not len(words) or not len(self.lengths):
            return nothing, nothing, nothing
        numbers = self.numbers_of(words)
        ends = np.diff(bounds)
        text = np.repeat(np.arange(len(ends)), ends)
        # a 0 after every text; of several 0 in a row one is enough
        spread = np.zeros(len(words) + len(ends), np.int64)
        place = np.arange(len(words)) + text
        spread[place] = numbers
        word_at = np.zeros(len(spread), np.int64)
        word_at[place] = np.arange(len(words))
        keep = np.ones(len(spread), bool)
        keep[1:] = (spread[1:] > 0) | (spread[:-1] > 0)
        spread, word_at = spread[keep], word_at[keep]
        index = FMIndex(spread)
        patterns = np.minimum(self.patterns, (1 << index.wavelet.bits) - 1)
        known = (patterns == self.patterns).all(axis=1)
        low, high = index.search(patterns, self.lengths)
        counts = np.where(known, np.maximum(high - low, 0), 0)
        phrase = np.repeat(np.arange(len(counts)), counts)
        rows = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(len(phrase))
        return word_at[index.locate(rows)], self.lengths[phrase], phrase


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _search(phrases: Phrases, texts: pa.Array, earlier: dict | None) -> dict[str, pa.Array]:
    n = len(texts)
    n_words = np.zeros(n, np.int64)
    word_spans: list = [[] for _ in range(n)]
    byte_spans: list = [[] for _ in range(n)]
    items: list = [[] for _ in range(n)]
    for first, last, data, offsets in hashing.text_chunks(texts, SHARD_BYTES):
        words, bounds, starts, ends = hashing.word_hashes(data, offsets, hashing.LETTER_WORDS)
        n_words[first:last] = np.diff(bounds)
        at, length, phrase = phrases.occurrences(words, bounds)
        marks = np.zeros(len(words) + 1, np.int64)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + length, -1)
        text_of = np.searchsorted(bounds, at, "right") - 1
        if earlier:
            for i in range(first, last):
                for span in earlier["word_spans"][i].as_py() or ():
                    marks[bounds[i - first] + span["start"]] += 1
                    marks[bounds[i - first] + span["end"]] -= 1
                items[i] = earlier["items"][i].as_py() or []
        hit = np.cumsum(marks[:-1]) > 0
        for i in np.flatnonzero(np.add.reduceat(np.append(hit, False).astype(np.int64), np.minimum(bounds[:-1], len(hit))) > 0):
            a, b = bounds[i], bounds[i + 1]
            if a == b:
                continue
            opened, closed = _spans(hit[a:b])
            word_spans[first + i] = [{"start": int(s), "end": int(e)} for s, e in zip(opened, closed)]
            byte_spans[first + i] = [
                {"start": int(starts[a + s] - offsets[i]), "end": int(ends[a + e - 1] - offsets[i])}
                for s, e in zip(opened, closed)
            ]
        if len(at):
            begins = phrases.owner_ends[phrase] - np.diff(np.concatenate([[0], phrases.owner_ends]))[phrase]
            sizes = phrases.owner_ends[phrase] - begins
            owner = phrases.owners[np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            pairs = np.unique(np.repeat(text_of, sizes) * len(phrases.names) + owner)
            for pair in pairs:
                items[first + int(pair // len(phrases.names))].append(phrases.names[int(pair % len(phrases.names))])
    return {
        "n_words": pa.array(n_words, pa.int64()),
        "word_spans": pa.array(word_spans, _ARROW_SPAN),
        "byte_spans": pa.array(byte_spans, _ARROW_SPAN),
        "items": pa.array([sorted(set(i)) for i in items], pa.list_(pa.string())),
    }


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    rows = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").where("id IS NOT NULL AND text IS NOT NULL")
    block, size = [], 0
    for row in rows.toLocalIterator():
        if block and size + len(row.text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row.id, row.text))
        size += len(row.text)
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds what of ``benchmark`` (``item_id``, ``text``) occurs in each text.

    Words are runs of letters, digits and characters beyond ASCII, A-Z
    lower-cased.  A phrase is 13 consecutive words of an item; a shorter item is
    one phrase, an item without words none.  New columns: ``n_words``,
    ``word_spans`` and ``byte_spans`` (merged, end exclusive; bytes of the text in
    UTF-8) and ``items`` (ids with an occurring phrase, distinct, sorted as
    strings).  Null and empty texts have no words and no spans.  Benchmark rows
    with a null id or text are left out; repeated ids count once.  Rows are kept
    as they are, repeated ones too; columns with the new names are replaced.
    A benchmark of more than ``BLOCK_BYTES`` is searched in several passes, each
    written to the shared folder for the next.
    """
    names = [name for name, _ in _FOUND]
    kept = [c for c in docs.columns if c not in names]
    out = docs.select(*[F.col(f"`{c}`") for c in kept])
    for number, block in enumerate(_blocks(benchmark)):
        if number:
            # each pass is written before the next, so plan and driver hold the phrases of one block
            out = settled(out, "contamination")
        phrases = Phrases(block)
        fields = out.schema.fields if number else out.schema.fields + [T.StructField(n, t) for n, t in _FOUND]
        passed = [f.name for f in fields if f.name not in names]

        def searched(batches, phrases=phrases, number=number, fields=fields, passed=passed):
            for batch in batches:
                table = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                found = _search(phrases, table[text], table if number else None)
                yield pa.RecordBatch.from_arrays(
                    [table[f.name] if f.name in passed else found[f.name] for f in fields], names=[f.name for f in fields]
                )

        out = out.mapInArrow(searched, T.StructType(fields))
    return out if keep_text else out.drop(text)


def hit_words() -> Column:
    return F.aggregate("word_spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


def is_contaminated() -> Column:
    return (hit_words() > 0) & (hit_words() * WORDS_PER_HIT >= F.col("n_words"))


def without_spans(text: str = "text", spans: str = "byte_spans") -> Column:
    """The text with its spans cut out."""
    raw = F.encode(F.col(text), "UTF-8")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(text).cast("long")))
    pieces = F.zip_with(ends, starts, lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8"))
    return F.array_join(pieces, "")
