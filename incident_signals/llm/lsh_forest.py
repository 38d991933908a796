"""LSH forest: signatures, and candidates among neighbours in sorted signature orders.

Everything here runs inside tasks, over Arrow batches.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from incident_signals.llm import hashing

TREES = 24
MOST_TREES = 40
DEPTH = 8
LEAST_DEPTH = 4
SKETCH = 64
# Pairs at the limit that the trees miss, or the sketches, at most.
MISSED = 1e-6
# A region of more rows goes one level deeper; at full depth it is walked in overlapping blocks.
# Its other pairs are left for the second pass.
REGION = 256
OVERLAP = 32
# Rows held by a task while a region is read.
HELD = 65_536
# Rows and shingles of one block of the second pass.
BLOCK = 1_024
BLOCK_SHINGLES = 1_000_000
_COLUMNS = 2_048
_PIECE = 100_000


@dataclass(frozen=True)
class Plan:
    """Trees, shared values of neighbours and equal sketch bytes of candidates."""

    trees: int
    least_depth: int
    least_equal: int


def plan(percent: int) -> Plan:
    """Limits by which a pair of ``percent`` similarity is missed at most ``MISSED`` of the time.

    Less similar texts are neighbours by fewer values, and stand in more trees if one value is too many.
    """
    if not 0 < percent <= 100:
        raise ValueError(f"percent {percent} is not above 0 and up to 100")
    alike = percent / 100
    for depth in range(LEAST_DEPTH, 0, -1):
        trees = TREES if alike == 1 else max(TREES, math.ceil(math.log(MISSED) / math.log1p(-(alike**depth))))
        if trees <= MOST_TREES:
            break
    fewer, least = 0.0, 0
    while least < SKETCH:
        fewer += math.comb(SKETCH, least) * alike**least * (1 - alike) ** (SKETCH - least)
        if fewer > MISSED:
            break
        least += 1
    return Plan(trees, depth, least)


def signatures(sets: np.ndarray, offsets: np.ndarray, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """16 bits of ``trees * DEPTH`` and 8 bits of ``SKETCH`` MinHash values per row; zeros without shingles."""
    n = len(offsets) - 1
    values = trees * DEPTH
    steps, masks = hashing.constants(values, 3) | np.uint64(1), hashing.constants(values, 4)
    keys, sketch = np.zeros((n, values), ">u2"), np.zeros((n, SKETCH), np.uint8)
    full = np.flatnonzero(np.diff(offsets) > 0)
    first = 0
    while first < len(full):
        last = int(np.searchsorted(offsets[full + 1], offsets[full[first]] + _PIECE, "right"))
        last = min(max(last, first + 1), len(full))
        rows = full[first:last]
        part = sets[offsets[rows[0]] : offsets[rows[-1] + 1]]
        starts = offsets[rows] - offsets[rows[0]]
        work = np.empty(len(part), np.uint64)
        for k in range(values):
            np.bitwise_xor(part, masks[k], out=work)
            np.multiply(work, steps[k], out=work)
            least = hashing.mix(np.minimum.reduceat(work, starts)) >> np.uint64(48)
            keys[rows, k] = least.astype(">u2")
            if k < SKETCH:
                sketch[rows, k] = least.astype(np.uint8)
        first = last
    return keys, sketch


def sign(texts: pa.Array, width: int, trees: int) -> dict[str, pa.Array]:
    """Set size, digest of the set, signature and sketch of each text."""
    sizes, digests = [], []
    parts: dict[str, list[bytes]] = {"sign": [], "sketch": []}
    for first, last, data, offsets in hashing.text_chunks(texts):
        words, bounds, _, _ = hashing.word_hashes(data, offsets, hashing.PLAIN_WORDS)
        sets, ends = hashing.distinct(*hashing.shingles(words, bounds, width))
        sizes.append(np.diff(ends))
        raw = sets.tobytes()
        digests += [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(ends[:-1], ends[1:])]
        for name, values in zip(parts, signatures(sets, ends, trees)):
            parts[name] += [row.tobytes() for row in values]
    return {
        "n_shingles": pa.array(np.concatenate(sizes) if sizes else np.empty(0, np.int64), pa.int64()),
        "digest": pa.array(digests, pa.binary()),
        **{name: pa.array(values, pa.binary()) for name, values in parts.items()},
    }


def shingle_sets(texts: pa.Array, width: int) -> pa.Array:
    """Sorted distinct shingle hashes of each text."""
    parts, ends, total = [], [np.zeros(1, np.int64)], 0
    for _, _, data, offsets in hashing.text_chunks(texts):
        words, bounds, _, _ = hashing.word_hashes(data, offsets, hashing.PLAIN_WORDS)
        sets, stops = hashing.distinct(*hashing.shingles(words, bounds, width))
        parts.append(sets.view(np.int64))
        ends.append(stops[1:] + total)
        total += len(sets)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(flat))


def _fixed(column: pa.Array, size: int) -> np.ndarray:
    """Bytes of a binary column whose values all have ``size`` bytes."""
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    start = np.frombuffer(ends, np.int64)[column.offset]
    return np.frombuffer(data, np.uint8)[start : start + size * len(column)].reshape(len(column), size)


def _forest(left: np.ndarray, right: np.ndarray, n: int) -> list[int]:
    """Positions of links, earlier ones first, that span the same components of ``n`` nodes."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    chosen = []
    for at, (x, y) in enumerate(zip(left.tolist(), right.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            chosen.append(at)
    return chosen


class Region:
    """Pairs of one batch of rows in (tree, key) order."""

    def __init__(self, trees: np.ndarray, ids: np.ndarray, sketches: np.ndarray, limits: Plan):
        self.trees, self.ids, self.sketches, self.limits = trees, ids, sketches, limits
        self.pairs: list[np.ndarray] = []
        self.rest: list[np.ndarray] = []

    def leave(self, rows: np.ndarray) -> None:
        """Notes rows of which some pairs are not compared here."""
        self.rest.append(np.stack([self.trees[rows].astype(np.int64), self.ids[rows]], axis=1))

    def compare(self, a: int, b: int) -> None:
        """Pairs among rows a to b whose sketches agree.

        If they are many, a spanning forest of the best ones; then the rows are
        noted, and a later pass looks at their pairs between different components.
        """
        ids, sketch = self.ids[a:b], self.sketches[a:b]
        equal = np.empty((b - a, b - a), np.int16)
        for i in range(b - a):
            bits = np.packbits(sketch[i] == sketch, axis=1)
            equal[i] = np.bitwise_count(bits.view(np.uint64)).sum(axis=1)
        left, right = np.nonzero(np.triu(equal >= self.limits.least_equal, 1))
        apart = ids[left] != ids[right]
        left, right = left[apart], right[apart]
        if len(left) > 4 * (b - a):
            self.leave(a + np.unique(np.concatenate([left, right])))
            order = np.lexsort((ids[right], ids[left], -equal[left, right]))
            left, right = left[order], right[order]
            chosen = _forest(left, right, b - a)
            left, right = left[chosen], right[chosen]
        if len(left):
            self.pairs.append(np.stack([np.minimum(ids[left], ids[right]), np.maximum(ids[left], ids[right])], axis=1))

    def split(self, keys: np.ndarray, a: int, b: int, depth: int) -> None:
        """Rows a to b share ``depth`` levels; too many of them are noted and go deeper."""
        if b - a <= REGION:
            self.compare(a, b)
            return
        if depth == self.limits.least_depth:
            self.leave(np.arange(a, b))
        if depth < DEPTH:
            cuts = np.flatnonzero((keys[a + 1 : b, 2 * depth : 2 * depth + 2] != keys[a : b - 1, 2 * depth : 2 * depth + 2]).any(axis=1)) + a + 1
            edges = [a, *cuts.tolist(), b]
            for x, y in zip(edges[:-1], edges[1:]):
                if y - x > 1:
                    self.split(keys, x, y, depth + 1)
        else:
            # rows of one full key: blocks that overlap, so that few links are left for the second pass
            for x in range(a, b, REGION - OVERLAP):
                if min(x + REGION, b) - x > 1:
                    self.compare(x, min(x + REGION, b))
                if x + REGION >= b:
                    break


def candidates(batches, limits: Plan):
    """Rows ``a, b`` of candidate pairs, and rows ``a, null, tree`` of rows with pairs left for a later pass.

    Batches hold ``tree, key, id, sketch`` in sorted order.  The first and the
    last region of a task may go on in another task; their rows are noted.
    """
    goes_on = True

    def flush(table: pa.Table, last: bool):
        nonlocal goes_on
        table = table.combine_chunks()
        n = len(table)
        column = {c: (table.column(c).chunk(0) if table.column(c).num_chunks else None) for c in table.column_names}
        if not n:
            return None, n
        tree = column["tree"].to_numpy(zero_copy_only=False)
        keys = _fixed(column["key"], 2 * DEPTH)
        head = keys[:, : 2 * limits.least_depth]
        cuts = np.flatnonzero((tree[1:] != tree[:-1]) | (head[1:] != head[:-1]).any(axis=1)) + 1
        edges = np.concatenate([[0], cuts, [n]])
        full = n - edges[-2] >= HELD
        done = n if last or full else int(edges[-2])
        region = Region(tree, column["id"].to_numpy(zero_copy_only=False), _fixed(column["sketch"], SKETCH), limits)
        if done and goes_on:
            region.leave(np.arange(edges[0], edges[1]))
        if done == n:
            region.leave(np.arange(edges[-2], edges[-1]))
        if done:
            goes_on = done == n
        for at in np.flatnonzero(np.diff(edges) > 1):
            if edges[at + 1] <= done:
                region.split(keys, int(edges[at]), int(edges[at + 1]), limits.least_depth)
        pairs = np.unique(np.concatenate(region.pairs), axis=0) if region.pairs else np.empty((0, 2), np.int64)
        rest = np.unique(np.concatenate(region.rest), axis=0) if region.rest else np.empty((0, 2), np.int64)
        batch = pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([pairs[:, 0], rest[:, 1]])),
             pa.concat_arrays([pa.array(pairs[:, 1], pa.int64()), pa.nulls(len(rest), pa.int64())]),
             pa.concat_arrays([pa.nulls(len(pairs), pa.int32()), pa.array(rest[:, 0].astype(np.int32))])],
            names=["a", "b", "tree"],
        )
        return batch, done

    waiting = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        waiting = pa.concat_tables([waiting, table]) if waiting is not None and len(waiting) else table
        found, done = flush(waiting, False)
        if found is not None and len(found):
            yield found
        waiting = waiting.slice(done)
    if waiting is not None and len(waiting):
        found, _ = flush(waiting, True)
        if found is not None and len(found):
            yield found


def numbered(batches, task: int):
    """Adds ``block`` to rows ``tree, key, id, label, n`` in sorted order: one region, few rows, not too many shingles."""
    block, last, rows, shingles = task << 32, None, 0, 0
    for batch in batches:
        at = []
        for tree, key, n in zip(*(batch.column(c).to_pylist() for c in ("tree", "key", "n"))):
            if (tree, key) != last or rows >= BLOCK or shingles + n > BLOCK_SHINGLES:
                block, last, rows, shingles = block + 1, (tree, key), 0, 0
            rows, shingles = rows + 1, shingles + n
            at.append(block)
        columns = {c: batch.column(c) for c in ("tree", "key", "id", "label", "n")}
        yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(at, pa.int64())], names=[*columns, "block"])


def _shared(left: tuple, right: tuple) -> np.ndarray:
    """Exact counts of shared values of all pairs of sets."""
    if left is right:
        values, times = np.unique(left[0], return_counts=True)
        values = values[times > 1]
    else:
        values = np.intersect1d(np.unique(left[0]), np.unique(right[0]), assume_unique=True)
    placed = []
    for flat, ends in (left, right):
        at = np.searchsorted(values, flat)
        met = np.flatnonzero(at < len(values))
        met = met[values[at[met]] == flat[met]]
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[met]
        order = np.argsort(at[met], kind="stable")
        placed.append((at[met][order], row[order], len(ends) - 1))
    shared = np.zeros((placed[0][2], placed[1][2]), np.int64)
    for first in range(0, len(values), _COLUMNS):
        sides = []
        for at, row, n in placed:
            a, b = np.searchsorted(at, [first, first + _COLUMNS])
            side = np.zeros((n, min(_COLUMNS, len(values) - first)), np.float32)
            side[row[a:b], at[a:b] - first] = 1
            sides.append(side)
        shared += (sides[0] @ sides[1].T).astype(np.int64)
    return shared


def between(batches, percent: int):
    """Links ``a, b`` that join all different labels with a link in a pair of blocks.

    Batches hold ``pair_a, pair_b, block, id, label, set``, sorted by the first
    three.  Every pair of the two blocks is compared on its full sets.
    """

    def block(table: pa.Table):
        sets = table.column("set").combine_chunks()
        flat, ends = sets.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
        return table.column("id").to_numpy(), table.column("label").to_numpy(), (flat, ends)

    def links(parts: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(parts)
        blocks = table.column("block").to_numpy()
        at = int(np.searchsorted(blocks, blocks[0], "right"))
        left = block(table.slice(0, at))
        right = block(table.slice(at)) if at < len(blocks) else left
        shared = _shared(left[2], right[2])
        union = np.diff(left[2][1])[:, None] + np.diff(right[2][1])[None, :] - shared
        x, y = np.nonzero((shared * 100 >= union * percent) & (left[1][:, None] != right[1][None, :]))
        names, at = np.unique(np.concatenate([left[1][x], right[1][y]]), return_inverse=True)
        low, high = np.minimum(at[: len(x)], at[len(x) :]), np.maximum(at[: len(x)], at[len(x) :])
        _, first = np.unique(low * len(names) + high, return_index=True)
        kept = first[_forest(low[first], high[first], len(names))]
        a, b = left[0][x[kept]], right[0][y[kept]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    held, last = [], None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        pair = np.stack([table.column(c).to_numpy() for c in ("pair_a", "pair_b")], axis=1)
        cuts = [0, *(np.flatnonzero((pair[1:] != pair[:-1]).any(axis=1)) + 1).tolist(), len(table)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if held and tuple(pair[a]) != last:
                yield links(held)
                held = []
            held.append(table.slice(a, b - a))
            last = tuple(pair[a])
    if held:
        yield links(held)
