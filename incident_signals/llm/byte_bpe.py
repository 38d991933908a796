"""Byte-level BPE: pieces found by a scan of transition functions, merged by rank, and decoded again.

The pieces are those of the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

but no pattern is matched.  Each code point becomes a symbol: its class, with
what the pattern looks ahead at folded in.  A symbol is a function from the
states of a small automaton to its states; functions compose associatively, so
the state before every code point of many texts laid end to end comes from one
parallel scan: functions of equal blocks are composed side by side, the blocks'
functions are scanned by doubling, and each block is run again from its true
state.  A text's first symbol forgets the state before it.

Pieces are slices of the text's bytes.  The distinct ones of a run of texts are
merged once, and what they gave is remembered.  Tokens keep their byte offsets.
"""

from __future__ import annotations

import base64
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from incident_signals.llm import hashing

# Letters and numbers of Unicode 16.0 that 15.1 did not have, as first and last code point.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
]
WHITE_SPACE = [
    (0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
    (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
]
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]

# Symbols: the class of a code point and what follows it; FIRST is added to that of a text's first code point.
LETTER, NUMBER, OTHER, SPACE, BLANK_BEFORE, SPACE_BEFORE, SHORT, LONG, FIRST = range(9)
_SAME = 16  # stands in for no code point at all
# States: inside what the last code point left the automaton.
START, LETTERS, NUMBERS, OTHERS, SPACES, AFTER_BLANK, ONE_LEFT, TWO_LEFT = range(8)
# Length of the blocks that are scanned side by side.
BLOCK = 512
# After a run of texts, no more merged pieces than these are remembered.
REMEMBERED = 200_000
# Pieces of up to so many bytes are merged together, longer ones each for itself.
WIDTHS = (8, 16, 32)
NONE = np.iinfo(np.int32).max


def codepoint_classes() -> np.ndarray:
    """Class of every code point: LETTER, NUMBER, SPACE or OTHER, as Unicode 16.0 has them."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER), (WHITE_SPACE, SPACE)):
        for first, last in ranges:
            table[first : last + 1] = kind
    return table


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece begins) by symbol and state."""
    goes = np.empty((_SAME + 1, 8), np.uint8)
    begins = np.ones((_SAME + 1, 8), bool)
    runs = [(LETTER, LETTERS), (NUMBER, NUMBERS), (OTHER, OTHERS), (SPACE, SPACES)]
    for symbol, state in runs:
        goes[symbol] = state
        begins[symbol, state] = False
    goes[BLANK_BEFORE] = AFTER_BLANK
    goes[SPACE_BEFORE] = SPACES
    goes[SHORT], goes[LONG] = ONE_LEFT, TWO_LEFT
    for symbol in (LETTER, NUMBER, OTHER, SHORT, LONG):
        begins[symbol, AFTER_BLANK] = False
    for symbol in (SHORT, LONG):  # an apostrophe in a run, or after a blank, opens no contraction
        goes[symbol, [OTHERS, AFTER_BLANK]] = OTHERS
        begins[symbol, OTHERS] = False
    goes[LETTER, TWO_LEFT], goes[LETTER, ONE_LEFT] = ONE_LEFT, START
    begins[LETTER, [TWO_LEFT, ONE_LEFT]] = False
    goes[FIRST:_SAME] = goes[:FIRST, START][:, None]
    goes[_SAME] = np.arange(8)
    return goes, begins


_GOES, _BEGINS = _automaton()


def codepoints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, their first bytes) of UTF-8."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[starts].astype(np.int32)
    wide = np.flatnonzero(points >= 0x80)
    if len(wide):
        lead, at = points[wide], starts[wide]
        more = 1 + (lead >= 0xE0).astype(np.int32) + (lead >= 0xF0)
        value = lead & (0x3F >> more)
        for i in (1, 2, 3):
            on = more >= i
            value[on] = (value[on] << 6) | (data[at[on] + i] & 0x3F)
        points[wide] = value
    return points, starts


def symbols(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The symbol of each code point; ``first`` marks those that begin a text."""
    n = len(points)
    out = classes[points]
    ends = np.append(first[1:], True)
    solid = np.append(out[1:] != SPACE, False) & ~ends
    before = (out == SPACE) & solid
    out[before] = SPACE_BEFORE
    out[before & (points == 32)] = BLANK_BEFORE
    at = np.flatnonzero(points == 39)
    after = np.zeros((3, len(at)), np.int32)
    inside = np.ones(len(at), bool)
    for i in (1, 2):
        inside &= (at + i < n) & ~ends[np.minimum(at + i - 1, n - 1)]
        after[i][inside] = points[at[inside] + i]
    for text in CONTRACTIONS:
        meets = np.all([after[i] == ord(c) for i, c in enumerate(text) if i], axis=0)
        out[at[meets]] = SHORT if len(text) == 2 else LONG
    return out + FIRST * first.astype(np.uint8)


def states_before(symbol: np.ndarray) -> np.ndarray:
    """The automaton's state before each symbol, by a scan of transition functions."""
    blocks = -(-len(symbol) // BLOCK)
    padded = np.full(blocks * BLOCK, _SAME, np.uint8)
    padded[: len(symbol)] = symbol
    step = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T).astype(np.int16) * 8
    goes = _GOES.ravel()
    whole = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for row in step:  # the function of each block
        whole = goes[row[:, None] + whole]
    reach = 1
    while reach < blocks:  # of all blocks up to each
        whole[reach:] = np.take_along_axis(whole[reach:], whole[:-reach].copy(), 1)
        reach *= 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = whole[:-1, START]
    out = np.empty((BLOCK, blocks), np.uint8)
    for i, row in enumerate(step):
        out[i] = state
        state = goes[row + state]
    return out.T.ravel()[: len(symbol)]


def piece_offsets(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """First byte of each piece of texts laid end to end, and the end of the last."""
    if not len(data):
        return np.zeros(1, np.int64)
    points, starts = codepoints(data)
    first = np.zeros(len(points), bool)
    opens = offsets[:-1][np.diff(offsets) > 0]
    first[np.searchsorted(starts, opens)] = True
    symbol = symbols(points, first, classes)
    begins = _BEGINS[symbol, states_before(symbol)] | first
    return np.append(starts[begins], len(data))


class Vocabulary:
    """Tokens as bytes, the order in which merges make them, and their ids.

    ``whole``: a piece that is a token itself is not merged.  Every single byte
    must be a token.  A copy sent to a task remembers no merges.
    """

    def __init__(self, tokens: list[bytes], ids: list[int], whole: bool):
        self.tokens, self.ids, self.whole = tokens, ids, whole
        self.rank = {token: i for i, token in enumerate(tokens)}
        self.id = np.array(ids, np.int32)
        self.classes = codepoint_classes()
        self.known: dict[bytes, list[int]] = {}
        size = max(ids, default=-1) + 1
        by_id: list[bytes | None] = [None] * size
        for token, i in zip(tokens, ids):
            by_id[i] = token
        self.by_id = pa.array(by_id, pa.large_binary())
        self.lengths = np.array([-1 if t is None else len(t) for t in by_id], np.int64)
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.rank_of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        joins = sorted(
            (self.rank[t[:k]] << 32 | self.rank[t[k:]], i)
            for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank
        ) or [(-1, NONE)]
        self.pairs, self.joins = np.array([k for k, _ in joins], np.int64), np.array([i for _, i in joins], np.int32)
        self.joins_of_bytes = self._joined(self.rank_of_byte[:, None], self.rank_of_byte[None, :])

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    @classmethod
    def from_ranks(cls, path: str) -> Vocabulary:
        """From lines of a token in base 64 and its rank, which is its id."""
        with open(path, "rb") as file:
            ranks = sorted((int(r), base64.b64decode(t)) for t, r in (line.split() for line in file if line.strip()))
        return cls([t for _, t in ranks], [r for r, _ in ranks], whole=True)

    @classmethod
    def from_tokenizer_json(cls, path: str) -> Vocabulary:
        """From a byte-level tokenizer's file: single bytes, then the tokens its merges make, in their order."""
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        letter = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        names = [c for c in model["vocab"] if len(c) == 1 and c in letter]
        for pair in model["merges"]:
            names.append("".join(pair.split(" ") if isinstance(pair, str) else pair))
        names = list(dict.fromkeys(names))
        return cls([bytes(letter[c] for c in n) for n in names], [model["vocab"][n] for n in names], whole=False)

    def merged(self, piece: bytes) -> list[int]:
        """Ranks of the tokens of a piece: the neighbours whose join has the least rank are joined, the leftmost first."""
        rank = self.rank
        if self.whole and piece in rank:
            return [rank[piece]]
        n = len(piece)
        end = list(range(1, n + 1))  # of the part that begins here; 0: joined to one before
        before = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i:
                j = before[i]
                if (r := rank.get(piece[j:stop])) is not None:
                    heapq.heappush(heap, (r, j, stop))
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : end[i]]])
            i = end[i]
        return out

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the join of tokens side by side; NONE where it is no token."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.joins[at], NONE)

    def merged_together(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ranks of the tokens of each piece from the left, their number), for pieces of 2 to ``width`` bytes.

        Each round joins one pair in every piece that has one left.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        letters = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        part = self.rank_of_byte[letters]
        cells = np.arange(width)
        join = np.full((len(pieces), width), NONE, np.int32)
        join[:, :-1] = self.joins_of_bytes[letters[:, :-1], letters[:, 1:]]
        join[cells >= sizes[:, None] - 1] = NONE
        out, number = part.copy(), sizes.copy()
        row = np.arange(len(pieces))  # where the pieces that are still worked on come from
        while len(row):
            at = join.argmin(1)
            best = join[np.arange(len(row)), at]
            over = best == NONE
            if over.any():
                out[row[over]], number[row[over]] = part[over], sizes[over]
                on = ~over
                row, part, join, sizes, at, best = row[on], part[on], join[on], sizes[on], at[on], best[on]
                if not len(row):
                    break
            line = np.arange(len(row))
            moved = np.minimum(cells + (cells > at[:, None]), width - 1)
            part = np.take_along_axis(part, moved, 1)
            join = np.take_along_axis(join, moved, 1)
            sizes = sizes - 1
            part[line, at] = best
            more = at + 1 < sizes
            join[line, at] = np.where(more, self._joined(best, part[line, np.minimum(at + 1, width - 1)]), NONE)
            had = np.flatnonzero(at > 0)
            join[had, at[had] - 1] = self._joined(part[had, at[had] - 1], best[had])
            join[line, width - 1] = NONE
        return out, number

    def _learn(self, pieces: list[bytes]) -> None:
        """Adds what pieces merge to."""
        single = [p for p in pieces if len(p) == 1 or self.whole and p in self.rank]
        self.known.update((p, [self.rank[p]]) for p in single)
        rest = [p for p in pieces if p not in self.known]
        narrow = 1
        for width in WIDTHS:
            some = [p for p in rest if narrow < len(p) <= width]
            if some:
                ranks, number = self.merged_together(some, width)
                self.known.update((p, r[:n]) for p, r, n in zip(some, ranks.tolist(), number.tolist()))
            narrow = width
        self.known.update((p, self.merged(p)) for p in rest if len(p) > narrow)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, token offsets of the texts, first byte of each token) of texts laid end to end."""
        cuts = piece_offsets(data, offsets, self.classes)
        pieces = pa.Array.from_buffers(
            pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]
        ).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        self._learn([p for p in distinct if p not in self.known])
        merged = [self.known[p] for p in distinct]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        sizes = np.fromiter(map(len, merged), np.int64, len(merged))
        flat = np.fromiter((r for ranks in merged for r in ranks), np.int64, int(sizes.sum()))
        opens = np.cumsum(sizes) - sizes
        index = pieces.indices.to_numpy(zero_copy_only=False)
        count = sizes[index]
        ends = np.cumsum(count)
        places = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(opens[index], count)
        ids = self.id[flat[places]]
        lengths = self.lengths[ids]
        firsts = np.cumsum(lengths) - lengths
        return ids, np.searchsorted(firsts, offsets), firsts

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids laid end to end, offset of each id and the end)."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or (self.lengths[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        taken = pc.take(self.by_id, pa.array(ids))
        data = taken.buffers()[2]
        ends = np.append(0, np.cumsum(self.lengths[ids]))
        return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8))[: ends[-1]], ends


def _with(batch: pa.RecordBatch, columns: dict[str, pa.Array], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[n] if n in columns else batch.column(n) for n in names], names=names)


def _lists(flat: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, kind))


def _extended(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    new = {f.name for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name not in new] + fields)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """All columns, and ``ids`` (array of int) and ``offsets`` (first byte of each token in the text's UTF-8).

    Null and empty texts have empty arrays; rows that repeat are each encoded.
    No special token is looked for.  Columns named ``ids`` or ``offsets`` are
    replaced.  Nothing is shuffled; a task holds the tokens of about 1 MB of texts.
    """
    whole = T.ArrayType(T.IntegerType())
    schema = _extended(docs, [T.StructField("ids", whole), T.StructField("offsets", whole)])
    names = schema.fieldNames()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in hashing.text_chunks(batch.column(text)):
                ids, bounds, firsts = shared.value.encode(data, offsets)
                firsts = firsts - np.repeat(offsets[:-1], np.diff(bounds))
                own = {"ids": _lists(ids, bounds, pa.int32()), "offsets": _lists(firsts, bounds, pa.int32())}
                yield _with(batch.slice(first, last - first), own, names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """All columns, and ``decoded`` (binary): the bytes of each row's ids.

    Null and empty arrays decode to no bytes; an id that the vocabulary lacks, or
    a null one, is an error.  A column named ``decoded`` is replaced.
    """
    schema = _extended(encoded, [T.StructField("decoded", T.BinaryType())])
    names = schema.fieldNames()
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids)
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            data, ends = shared.value.decode(values)
            bounds = ends[np.append(0, np.cumsum(sizes))]
            decoded = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
            yield _with(batch, {"decoded": decoded.cast(pa.binary())}, names)

    return encoded.mapInArrow(run, schema)
