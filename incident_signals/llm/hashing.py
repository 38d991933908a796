"""Vectorized word and shingle hashes over the byte buffers of Arrow string columns.

Words are runs of the bytes a table allows; A-Z are lower-cased by the same
table, so no Python object is made per word.  All hashes are 64 bits wide and
equal on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
CHUNK_BYTES = 1_000_000

_lowered = np.arange(256)
_lowered[65:91] += 32
LOWERED = _lowered.astype(np.uint8)
# Words by whitespace: any byte but blank and \x09-\x0D.
PLAIN_WORDS = np.ones(256, bool)
PLAIN_WORDS[[9, 10, 11, 12, 13, 32]] = False
# Words of digits, letters and everything beyond ASCII.
LETTER_WORDS = np.zeros(256, bool)
LETTER_WORDS[48:58] = LETTER_WORDS[65:91] = LETTER_WORDS[97:123] = LETTER_WORDS[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) * _STEP)


_LETTERS = constants(256, 1)[LOWERED]


class _Powers:
    """Powers of the base and its inverse, as many as were needed so far; a copy sent to a task starts empty."""

    def __init__(self):
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __reduce__(self):
        return _Powers, ()

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) < n:
            for i, base in enumerate((_BASE, _INVERSE)):
                table = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
                table[0] = 1
                self.tables[i] = np.multiply.accumulate(table)
        return self.tables


_powers = _Powers()


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets from 0) of runs of rows of about ``most`` bytes; a longer row stands alone."""
    if not len(column):
        return
    data, offsets = column_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    pa.default_memory_pool().release_unused()  # workers live on between stages


def word_hashes(data: np.ndarray, offsets: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, word offsets of the rows, first bytes, ends) for rows laid end to end."""
    n = len(data)
    inside = allowed[data]
    opens = np.empty(n, bool)
    closes = np.empty(n, bool)
    if n:
        opens[0] = closes[-1] = True
        np.logical_not(inside[:-1], out=opens[1:])
        np.logical_not(inside[1:], out=closes[:-1])
        cuts = offsets[(offsets > 0) & (offsets < n)]
        opens[cuts] = True
        closes[cuts - 1] = True
        opens &= inside
        closes &= inside
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(closes) + 1
    power, inverse = _powers.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTERS[data] * power[:n], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets), starts, ends


_ROLES = constants(16, 2) | np.uint64(1)


def shingles(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, shingle offsets of the rows); a row of fewer words, but not none, is one shingle."""
    counts = np.diff(offsets)
    places = np.arange(len(words)) - np.repeat(offsets[:-1], counts)
    left = np.repeat(counts, counts) - places
    total = np.zeros(len(words), np.uint64)
    for i in range(min(width, len(words))):
        part = np.zeros(len(words), np.uint64)
        part[: len(words) - i] = words[i:] * _ROLES[i]
        total += part * (left > i)
    wide = np.minimum(left, width).astype(np.uint64)
    valid = (left >= width) | ((places == 0) & (left < width))
    numbers = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    return mix(total + wide)[valid], np.concatenate([[0], np.cumsum(numbers)]).astype(np.int64)


def distinct(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, and their offsets."""
    hashes = hashes.copy()
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a > 1:
            hashes[a:b].sort()
    keep = np.ones(len(hashes), bool)
    if len(hashes):
        keep[1:] = hashes[1:] != hashes[:-1]
        keep[offsets[:-1][offsets[:-1] < len(hashes)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return hashes[keep], kept[offsets]
