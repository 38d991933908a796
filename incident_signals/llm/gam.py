"""Additive model with pairwise terms, fitted by cyclic boosting of shallow trees over binned features."""

from __future__ import annotations

import itertools

import numpy as np

BINS = 32
PAIR_BINS = 8
ROUNDS = 200
PAIR_ROUNDS = 60
PAIRS = 6
RATE = 0.1
PENALTY = 2.0
LEAST_WEIGHT = 2.0


def _gain(g, h):
    return g * g / (h + PENALTY)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, bins on the left) of the best cut of a gradient histogram."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = _gain(left_g, left_h) + _gain(right_g, right_h) - _gain(g.sum(), h.sum())
    gain[(left_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT)] = 0.0
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Step for each bin from a tree of at most ``depth`` levels."""
    gain, cut = _best_cut(g, h) if depth else (0.0, 0)
    if gain <= 0:
        return np.full(len(g), g.sum() / (h.sum() + PENALTY))
    return np.concatenate([shallow_tree(g[:cut], h[:cut], depth - 1), shallow_tree(g[cut:], h[cut:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, step for each cell): one cut of one axis, then one cut of the other on each side."""
    best = (0.0, np.full(g.shape, g.sum() / (h.sum() + PENALTY)))
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for cut in range(1, a.shape[0]):
            step, total = np.empty(a.shape), -_gain(a.sum(), b.sum())
            for part in (slice(0, cut), slice(cut, None)):
                pg, ph = a[part].sum(axis=0), b[part].sum(axis=0)
                step[part] = shallow_tree(pg, ph, 1)
                gain, _ = _best_cut(pg, ph)
                total += _gain(pg.sum(), ph.sum()) + gain
            if total > best[0]:
                best = (total, step.T if flip else step)
    return best


class Gam:
    """``score`` adds one table entry per feature and pair."""

    def __init__(self, width: int):
        self.edges = [np.empty(0)] * width
        self.coarse = [np.empty(0)] * width
        self.tables = [np.zeros(1)] * width
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.bias = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.bias)
        for f, edges in enumerate(self.edges):
            margin += self.tables[f][np.searchsorted(edges, x[:, f], "right")]
        for a, b, table in self.pairs:
            margin += table[
                np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")
            ]
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.empty(0)


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Without rows, or with one class only, the model is a constant."""
    n, width = x.shape
    model = Gam(width)
    share = (y.sum() + 0.5) / (n + 1.0)
    model.bias = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return model
    model.edges = [_edges(x[:, f], BINS) for f in range(width)]
    model.coarse = [_edges(x[:, f], PAIR_BINS) for f in range(width)]
    bins = [np.searchsorted(model.edges[f], x[:, f], "right") for f in range(width)]
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    margin = np.full(n, model.bias)

    def slopes():
        p = 1.0 / (1.0 + np.exp(-margin))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for f in range(width):
            g, h = slopes()
            step = RATE * shallow_tree(np.bincount(bins[f], g, sizes[f]), np.bincount(bins[f], h, sizes[f]))
            model.tables[f] += step
            margin += step[bins[f]]
    # the pairs whose cells explain most of what the single features leave
    coarse = [np.searchsorted(model.coarse[f], x[:, f], "right") for f in range(width)]
    sizes = [len(e) + 1 for e in model.coarse]

    def grids(a, b, g, h):
        cell, shape = coarse[a] * sizes[b] + coarse[b], (sizes[a], sizes[b])
        return [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)]

    g, h = slopes()
    ranked = sorted(((-pair_tree(*grids(a, b, g, h))[0], a, b) for a, b in itertools.combinations(range(width), 2)))
    model.pairs = [(a, b, np.zeros((sizes[a], sizes[b]))) for _, a, b in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            step = RATE * pair_tree(*grids(a, b, *slopes()))[1]
            table += step
            margin += step[coarse[a], coarse[b]]
    return model
