"""FM-index over the words of one shard of texts.

Words outside the searched vocabulary end a run; each run end is a sentinel of
its own, ordered by position, so suffixes compare within their run only and
backward search and position walks are exact.
"""

from __future__ import annotations

import numpy as np

SAMPLE_EVERY = 16


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions by suffix; symbol 0 ends a suffix, and equal suffixes go by position."""
    n = len(symbols)
    if not n:
        return np.empty(0, np.int64)
    bits = max(1, int(symbols.max()).bit_length())
    width = min(n, max(1, 63 // bits))
    key = np.zeros(n, np.int64)
    running = np.ones(n, bool)
    for i in range(width):
        part = np.zeros(n, np.int64)
        part[: n - i] = symbols[i:]
        part[~running] = 0
        running &= part > 0
        key = (key << bits) | part
    order = np.argsort(key, kind="stable")
    rank = _ranks(key, order, ~running)
    depth = width
    while True:
        size = np.bincount(rank, minlength=n + 1)
        tied = size[rank] > 1
        if not tied.any():
            break
        at = np.flatnonzero(tied)
        # a tied suffix runs on for at least ``depth`` words, so its continuation is in range
        after = np.zeros(len(at), np.int64)
        inside = at + depth < n
        after[inside] = rank[at[inside] + depth]
        key = rank[at].astype(np.int64) * (n + 1) + after
        by_key = np.argsort(key, kind="stable")
        sorted_at, sorted_key = at[by_key], key[by_key]
        fresh = np.ones(len(at), bool)
        fresh[1:] = sorted_key[1:] != sorted_key[:-1]
        group = np.ones(len(at), bool)
        group[1:] = rank[sorted_at[1:]] != rank[sorted_at[:-1]]
        place = np.arange(len(at))
        start_of_group = np.maximum.accumulate(np.where(group, place, 0))
        start_of_equal = np.maximum.accumulate(np.where(fresh, place, 0))
        rank = rank.copy()
        rank[sorted_at] = rank[sorted_at] + (start_of_equal - start_of_group)
        depth *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


def _ranks(key: np.ndarray, order: np.ndarray, ended: np.ndarray) -> np.ndarray:
    """Place of the first suffix with the same key; an ended suffix is equal to none."""
    sorted_key = key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (sorted_key[1:] != sorted_key[:-1]) | ended[order][1:]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
    return rank


class WaveletMatrix:
    """Rank and access over a sequence of small integers, one bit level at a time."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        first = np.zeros(len(symbols), np.int64)
        ends = ends.astype(np.int64)
        for i, ones in enumerate(self.ones):
            one = ((symbols >> (self.bits - 1 - i)) & 1).astype(bool)
            ones_first, ones_ends = ones[first], ones[ends]
            first = np.where(one, self.zeros[i] + ones_first, first - ones_first)
            ends = np.where(one, self.zeros[i] + ones_ends, ends - ones_ends)
        return ends - first

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, its rank) at each place."""
        value = np.zeros(len(at), np.int64)
        first = np.zeros(len(at), np.int64)
        at = at.astype(np.int64)
        for i, ones in enumerate(self.ones):
            one = ones[at + 1] > ones[at]
            ones_first, ones_at = ones[first], ones[at]
            value = (value << 1) | one
            first = np.where(one, self.zeros[i] + ones_first, first - ones_first)
            at = np.where(one, self.zeros[i] + ones_at, at - ones_at)
        return value, at - first


class FMIndex:
    def __init__(self, symbols: np.ndarray):
        """``symbols``: words as numbers from 1; 0 ends a run.  The last must be 0."""
        n = len(symbols)
        self.n = n
        order = suffix_order(symbols)
        bits = max(1, int(symbols.max()).bit_length()) if n else 1
        self.wavelet = WaveletMatrix(symbols[order - 1], bits)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << bits))])
        # sampled positions: every 16th word of a run, its first among them, so a walk never leaves its run
        place = np.arange(n)
        starts = np.zeros(n, bool)
        if n:
            starts[0] = True
            starts[1:] = symbols[:-1] == 0
        offset = place - np.maximum.accumulate(np.where(starts, place, 0))
        sampled = (offset % SAMPLE_EVERY == 0)[order]
        self.sampled = sampled
        self.sample_number = np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row interval of each pattern; ``patterns`` is padded behind with 0."""
        m = len(lengths)
        low = np.zeros(m, np.int64)
        high = np.full(m, self.n, np.int64)
        for step in range(int(lengths.max()) if m else 0):
            at = lengths - 1 - step
            going = np.flatnonzero((at >= 0) & (high > low))
            if not len(going):
                break
            symbol = patterns[going, at[going]]
            start = self.before[symbol]
            both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low[going], high[going]]))
            low[going] = start + both[: len(going)]
            high[going] = start + both[len(going) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: walk back to a sampled one."""
        out = np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        rows = rows.copy()
        steps = 0
        while len(todo):
            done = self.sampled[rows]
            out[todo[done]] = self.samples[self.sample_number[rows[done]]] + steps
            todo, rows = todo[~done], rows[~done]
            if len(todo):
                symbol, rank = self.wavelet.access(rows)
                rows = self.before[symbol] + rank
                steps += 1
        return out
