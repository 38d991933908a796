"""Alignment of two tokenizers' tokens over the same bytes, by merge-path partitioning.

A run of texts gives two ascending lists of byte offsets at which tokens of A
and of B end.  Merging them is cut into pieces of equal work: a binary search
along each diagonal of the grid of both lists finds where it crosses the merge
path, for all diagonals at once, and the pieces are then merged side by side.  A
piece emits its overlaps, the A and B tokens open at each step, and numbers the
cuts where both end; what the pieces before it have cut is added afterwards,
which stitches the groups that reach over pieces.

Each task writes one row per block of texts: its distinct linked id pairs with
the number of documents that hold them, and for each document which pairs it
holds and how often.  Only distinct pairs of blocks are counted, joined with the
totals and sent back, so a pair that every document holds has as many rows as
there are blocks, and no text leaves the task that read it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from incident_signals.llm import hashing
from incident_signals.llm.byte_bpe import Vocabulary
from incident_signals.llm.components import LARGE_ROWS, settled

# Ends that one piece of the merge passes.
WORK = 512
# Bytes of text whose distinct pairs make one row.
BLOCK_BYTES = 8 << 20
# Groups of up to so many links are written out link by link; of larger ones, each id counts once with its number.
SMALL_GROUP = 64
# An id takes so many bits of a pair.
ID_BITS = 22


class Pieces:
    """Tokenizer B: the pieces of a SentencePiece model and their bytes; a copy sent to a task loads the model there."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.proto = proto
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        whole = [
            bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode()
            for i, name in enumerate(names)
        ]
        self.bytes = pa.array(whole, pa.large_binary())
        self.lengths = np.array([len(b) for b in whole], np.int64)

    def __reduce__(self):
        return Pieces, (self.proto,)

    @classmethod
    def from_file(cls, path: str) -> Pieces:
        with open(path, "rb") as file:
            return cls(file.read())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, token offsets of the texts)."""
        lists = self.model.encode(texts, num_threads=1)
        bounds = np.append(0, np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists))))
        return np.fromiter(chain.from_iterable(lists), np.int32, bounds[-1]), bounds

    def decode(self, ids: np.ndarray) -> np.ndarray:
        data = pc.take(self.bytes, pa.array(ids)).buffers()[2]
        return np.frombuffer(data, np.uint8)[: self.lengths[ids].sum()] if data is not None else np.empty(0, np.uint8)


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of the first ends on the merge path, up to each diagonal, are of ``a``; of equal ends, that of ``a`` is first."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        further = open_ & (a[np.minimum(middle, len(a) - 1)] <= b[np.clip(diagonals - 1 - middle, 0, len(b) - 1)])
        low = np.where(further, middle + 1, low)
        high = np.where(open_ & ~further, middle, high)
    return low


def merge_path(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, int]:
    """(group of each end in ``a``, in ``b``, number of groups); a group ends where both lists have the same end.

    Both lists ascend strictly and have the same last end.
    """
    total = len(a) + len(b)
    lanes = max(-(-total // work), 1)
    diagonals = np.minimum(np.arange(lanes + 1, dtype=np.int64) * work, total)
    i = crossings(a, b, diagonals[:-1]) if total else np.zeros(1, np.int64)
    j = diagonals[:-1] - i
    last = np.iinfo(np.int64).max
    a_, b_ = np.append(a, last), np.append(b, last)
    is_a, cuts = np.zeros((work, lanes), bool), np.zeros((work, lanes), bool)
    for k in range(min(work, total)):
        ends_a, ends_b = a_[np.minimum(i, len(a))], b_[np.minimum(j, len(b))]
        takes_a = ends_a <= ends_b
        is_a[k] = takes_a
        # the end of A was passed just before, here or at the end of the piece before
        cuts[k] = ~takes_a & (i > 0) & (a_[i - 1] == ends_b)
        i = np.minimum(i + takes_a, len(a))
        j = np.minimum(j + ~takes_a, len(b))
    on = np.arange(work)[:, None] < np.diff(diagonals)
    cuts &= on
    within = np.cumsum(cuts, axis=0) - cuts
    ended = cuts.sum(axis=0)
    group = (within + (np.cumsum(ended) - ended)).T[on.T]
    takes_a = is_a.T[on.T]
    return group[takes_a], group[~takes_a], int(ended.sum())


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1 ...``, ``counts[i]`` of each."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def _links(ids_a, ids_b, n_a, n_b, doc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id pair, number of links), distinct and ascending; ``n_a`` and ``n_b`` count the tokens of each group."""
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    number = n_a * n_b
    small = np.flatnonzero(number <= SMALL_GROUP)
    size = number[small]
    place = _ragged(np.zeros(len(small), np.int64), size)
    group = np.repeat(small, size)
    across = n_b[group]
    pair = ids_a[first_a[group] + place // across].astype(np.int64) << ID_BITS | ids_b[first_b[group] + place % across]
    docs, pairs, times = [doc[group]], [pair], [np.ones(len(pair), np.int64)]
    for g in np.flatnonzero(number > SMALL_GROUP):
        own_a, times_a = np.unique(ids_a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        own_b, times_b = np.unique(ids_b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        pairs.append((own_a.astype(np.int64)[:, None] << ID_BITS | own_b[None, :]).ravel())
        times.append(np.outer(times_a, times_b).ravel())
        docs.append(np.full(len(pairs[-1]), doc[g]))
    d, p, t = np.concatenate(docs), np.concatenate(pairs), np.concatenate(times)
    order = np.lexsort((p, d))
    d, p, t = d[order], p[order], t[order]
    starts = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (p[1:] != p[:-1]))) if len(d) else np.empty(0, np.int64)
    return d[starts], p[starts], np.add.reduceat(t, starts) if len(d) else t


def _names(size: int) -> pa.Array:
    """Each id in decimal with the mark after it: a comma, a bar or a semicolon."""
    ids = pa.array(np.arange(size)).cast(pa.string())
    parts = [pc.binary_join_element_wise(ids, mark, "").cast(pa.large_string()) for mark in ",|;"]
    return pa.concat_arrays(parts)


def _group_texts(ids_a, ids_b, group_a, group_b, n_groups, bounds_a, bounds_b, names) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text."""
    size = len(names) // 3
    n_a, n_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    last_a = np.append(group_a[1:] != group_a[:-1], True)[: len(group_a)]
    last_b = np.append(group_b[1:] != group_b[:-1], True)[: len(group_b)]
    index = np.empty(len(ids_a) + len(ids_b), np.int64)
    index[np.arange(len(ids_a)) + (np.cumsum(n_b) - n_b)[group_a]] = ids_a + np.where(last_a, size, 0)
    index[np.arange(len(ids_b)) + np.cumsum(n_a)[group_b]] = ids_b + np.where(last_b, 2 * size, 0)
    taken = pc.take(names, pa.array(index))
    ends = np.frombuffer(taken.buffers()[1], np.int64)[bounds_a + bounds_b]
    data = memoryview(taken.buffers()[2]) if taken.buffers()[2] is not None else b""
    return [bytes(data[x : max(x, y - 1)]) for x, y in zip(ends[:-1], ends[1:])]


def _aligned(column: pa.Array, a: Vocabulary, b: Pieces, names: pa.Array, digest: bool):
    """(columns of each text, links) of a run of texts."""
    texts = column.fill_null("")
    full = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
    n = len(texts)
    some = texts.take(pa.array(full))
    data, offsets = hashing.column_bytes(pc.binary_join_element_wise("", some, " ") if len(some) else some)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    ids_b, bounds_b = b.encode(some.to_pylist())
    bytes_b = b.decode(ids_b)
    ends_b = np.append(0, np.cumsum(b.lengths[ids_b]))[bounds_b]
    # tokens of B that spell something else, and their texts, are left out
    same = np.diff(ends_b) == np.diff(offsets)
    for i in np.flatnonzero(same):
        same[i] = np.array_equal(bytes_b[ends_b[i] : ends_b[i + 1]], data[offsets[i] : offsets[i + 1]])
    data = data[np.repeat(same, np.diff(offsets))]
    ids_b = ids_b[np.repeat(same, np.diff(bounds_b))]
    bounds_b = np.append(0, np.cumsum(np.diff(bounds_b)[same]))
    full, offsets = full[same], np.append(0, np.cumsum(np.diff(offsets)[same]))
    ids_a, bounds_a, _ = a.encode(data, offsets)
    group_a, group_b, n_groups = merge_path(np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b]))
    n_a, n_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    doc = np.repeat(full, np.diff(bounds_a))[np.cumsum(n_a) - n_a]

    def spread(values) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[full] = values
        return out

    strings = _group_texts(ids_a, ids_b, group_a, group_b, n_groups, bounds_a, bounds_b, names)
    groups: list[str] = [""] * n
    for i, s in zip(full, strings):
        groups[i] = hashlib.sha256(s).hexdigest() if digest else s.decode()
    columns = {
        "n_a": spread(np.diff(bounds_a)),
        "n_b": spread(np.diff(bounds_b)),
        "n_groups": np.bincount(doc, minlength=n),
        "n_links": np.bincount(doc, n_a * n_b, n).astype(np.int64),
        "groups": groups,
    }
    return columns, _links(ids_a, ids_b, n_a, n_b, doc)


STATS = "n_a long, n_b long, n_groups long, n_links long, groups string"


def _block_row(block: int, keys: list[pa.Array], parts: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    """One row of ``kind`` for a block of texts: its documents, its pairs, and the pairs of each document."""
    names = [f.name for f in kind.field("texts").type.value_type][1:]
    key = pa.concat_arrays(keys)
    columns = [pa.concat_arrays([pa.array(c[name]) for c, _ in parts]) for name in names]
    first = np.cumsum([0] + [len(c["n_a"]) for c, _ in parts])
    doc = np.concatenate([links[0] + f for (_, links), f in zip(parts, first)])
    pair, place, held = np.unique(np.concatenate([links[1] for _, links in parts]), return_inverse=True, return_counts=True)
    order = np.argsort(-held, kind="stable")  # frequent pairs get small places
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    pair, held = pair[order], held[order]
    texts = pa.StructArray.from_arrays([key, *columns], fields=list(kind.field("texts").type.value_type))
    one = lambda array, kind: pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array, kind)
    times = np.concatenate([links[2] for _, links in parts])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block], pa.int64()),
            one(texts, kind.field("texts").type),
            one(pa.array(pair), pa.list_(pa.int64())),
            one(pa.array(held, pa.int64()), pa.list_(pa.int64())),
            one(pa.array(np.bincount(doc, minlength=len(key)), pa.int32()), pa.list_(pa.int32())),
            one(pa.array(rank[place], pa.int32()), pa.list_(pa.int32())),
            one(pa.array(times, pa.int64()), pa.list_(pa.int64())),
        ],
        schema=kind,
    )


def _arrow(field: T.StructField) -> pa.Field:
    return pa.field(field.name, to_arrow_type(field.dataType))


def blocks_of(docs: DataFrame, a: Vocabulary, b: Pieces, key: str, text: str, digest: bool) -> DataFrame:
    """A row per block of texts: ``texts`` and their counts, ``pairs`` with ``held``, and by text ``sizes``, ``places``, ``times``."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    texts = T.StructType([rows.schema["key"]] + T.StructType.fromDDL(STATS).fields)
    whole = lambda kind: T.ArrayType(kind, True)
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("texts", whole(texts)),
        T.StructField("pairs", whole(T.LongType())), T.StructField("held", whole(T.LongType())),
        T.StructField("sizes", whole(T.IntegerType())), T.StructField("places", whole(T.IntegerType())),
        T.StructField("times", whole(T.LongType())),
    ])
    struct = pa.struct([_arrow(f) for f in texts.fields])
    kind = pa.schema([
        pa.field("block", pa.int64()), pa.field("texts", pa.list_(struct)), pa.field("pairs", pa.list_(pa.int64())),
        pa.field("held", pa.list_(pa.int64())), pa.field("sizes", pa.list_(pa.int32())), pa.field("places", pa.list_(pa.int32())),
        pa.field("times", pa.list_(pa.int64())),
    ])
    context = docs.sparkSession.sparkContext
    shared_a, shared_b, most = context.broadcast(a), context.broadcast(b), BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = shared_a.value, shared_b.value
        names = _names(max(len(first.lengths), len(second.lengths)))
        block, size, keys, parts = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            for low, high, _, offsets in hashing.text_chunks(batch.column("text")):
                keys.append(batch.column("key").slice(low, high - low))
                parts.append(_aligned(batch.column("text").slice(low, high - low), first, second, names, digest))
                size += int(offsets[-1])
                if size >= most:
                    yield _block_row(block, keys, parts, kind)
                    block, size, keys, parts = block + 1, 0, [], []
        if parts:
            yield _block_row(block, keys, parts, kind)

    return rows.mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, count, best``: how many documents hold each linked id pair, and the highest such count of its A id."""
    held = blocks.select(F.inline(F.arrays_zip("pairs", "held"))).groupBy(F.col("pairs").alias("pair")).agg(
        F.sum("held").alias("count")
    )
    counts = settled(held.withColumn("a", F.shiftright("pair", ID_BITS)), "pair-counts")
    best = counts.groupBy("a").agg(F.max("count").alias("best"))
    return counts.join(best, "a").select("pair", "count", "best")


def align(docs: DataFrame, a: Vocabulary, b: Pieces, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``key, n_a, n_b, n_groups, n_links, groups, n_best, count_sum``.

    A encodes a blank and the text, B the text, before which it puts a blank
    itself.  ``groups`` lists the ids of each run of bytes between offsets where
    tokens of both end (``a1,a2|b1;a3|b2``), or with ``digest`` their SHA-256.
    Every A token of a group is linked with every B token of it; the count of an
    id pair is the number of rows that hold it linked.  ``n_best`` counts the
    links whose pair has the highest count of its A id (ties included), and
    ``count_sum`` adds the counts of all links.

    Null and empty texts, and those that B normalizes to other bytes, have no
    tokens: zeros and an empty ``groups``.  Rows that repeat a key count each for
    themselves; null keys stay.  No rows, no result; other columns are not read.
    """
    blocks = settled(blocks_of(docs, a, b, key, text, digest), "aligned-blocks", LARGE_ROWS)
    pairs = blocks.select(F.col("block").alias("home"), F.posexplode("pairs").alias("place", "pair"))
    marked = pairs.join(pair_counts(blocks), "pair").select("home", "place", "count", (F.col("count") == F.col("best")).alias("top"))
    texts = blocks.schema["texts"].dataType.elementType
    out = T.StructType(
        [T.StructField(key, texts[0].dataType)] + texts.fields[1:]
        + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]
    )
    names = out.fieldNames()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = [r for r in left.to_batches() if r.num_rows][0]
        flat = {n: rows.column(n).flatten() for n in ("texts", "sizes", "places", "times")}
        size = right.num_rows
        place = right.column("place").to_numpy()
        counts, tops = np.empty(size, np.int64), np.empty(size, np.int64)
        counts[place] = right.column("count").to_numpy()
        tops[place] = right.column("top").to_numpy().astype(np.int64)
        sizes, places, times = (flat[n].to_numpy() for n in ("sizes", "places", "times"))
        ends = np.append(0, np.cumsum(sizes))
        sums = []
        for value in (tops, counts):
            running = np.append(0, np.cumsum(value[places] * times))
            sums.append(pa.array(running[ends[1:]] - running[ends[:-1]], pa.int64()))
        return pa.table([*flat["texts"].flatten(), *sums], names=names)

    left = blocks.select("block", "texts", "sizes", "places", "times")
    return left.groupBy("block").cogroup(marked.groupBy("home")).applyInArrow(run, out)
