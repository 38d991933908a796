"""Vector codes against plain rounds, and the bounds that skip distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from incident_signals.llm import vector_codes


def brute(rows):
    """(codes and errors by row, final codebooks) for (key, vector, label) rows that are kept."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[int(np.floor(4096 * np.float64(v))) for v in r[1]] for r in rows]).reshape(len(rows), 8, -1)
    books = x[:16].transpose(1, 0, 2).copy()
    for last in [False] * 6 + [True]:
        d = ((x[:, :, None] - books[None]) ** 2).sum(3)
        code = d.argmin(2)
        if not last:
            for p in range(8):
                for e in range(books.shape[1]):
                    own = x[code[:, p] == e, p]
                    if len(own):
                        books[p, e] = [int(s) // len(own) for s in own.sum(0)]
    return [(r[0], r[2], c.tolist(), int(m.min(1).sum())) for r, c, m in zip(rows, code, d)], books


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def vectors(n, size, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, size))
    return np.round(centres[rng.integers(0, 30, n)] + 0.3 * rng.normal(size=(n, size)), 3).astype(np.float32)


SCHEMA = "vec_id long, embedding array<float>, label int, code string"


@pytest.mark.parametrize("block", [7, 4096])
def test_codes_like_plain_rounds(spark, monkeypatch, block):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rows = [(i * 3, v.tolist(), i % 3 or None) for i, v in enumerate(vectors(400, 24, 1))]
    rows += [(5, rows[5][1], 1), (5, rows[6][1], 1), (None, rows[7][1], None), (9_999, [0.0] * 24, 2), (10_000, [0.5 / 4096] * 24, 2)]
    odd = [(1, None, 1), (2, [], 1), (3, [1.0] * 23, 1), (4, [float("nan")] + [0.0] * 23, 1), (6, [float("-inf")] + [0.0] * 23, 1),
           (7, [None] + [0.0] * 23, 1), (8, [1.0] * 16, 1), (None, None, None)]
    frame = spark.createDataFrame([(*r, "mine") for r in rows + odd], SCHEMA).repartition(3)
    got, books = vector_codes.compress(frame)
    want, final = brute(rows)
    assert got.columns == ["vec_id", "label", "code", "error"]
    assert order(got.collect()) == order(want)
    assert np.array_equal(books.final, final) and len(books.history) == 7
    summed = vector_codes.with_label_errors(got)
    totals = {}
    for _, label, _, error in want:
        totals[label] = totals.get(label, 0) + error
    assert all(r.label_error == totals[r.label] for r in summed.collect()) and summed.count() == len(want)


def test_few_or_no_vectors(spark):
    frame = spark.createDataFrame([(1, [1.0] * 8, 1, ""), (2, [1.0] * 8, 1, ""), (3, [-2.0] * 8, None, ""), (4, None, 1, "")], SCHEMA)
    got, books = vector_codes.compress(frame)
    assert order(got.collect()) == [(1, 1, [0] * 8, 0), (2, 1, [0] * 8, 0), (3, None, [2] * 8, 0)]
    assert books.final.shape == (8, 3, 1)
    for empty in (frame.limit(0), frame.where("vec_id = 4")):
        got, books = vector_codes.compress(empty)
        assert got.count() == 0 and vector_codes.with_label_errors(got).count() == 0 and books.final.size == 0
    with pytest.raises(Exception, match="64 bits"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 8, 1, "")], SCHEMA))[0].collect()


def test_bounds_hold_and_net_displacement_is_tighter():
    """Entries that move to and fro keep their bounds; the sum of their steps' norms would give most of them up."""
    rng = np.random.default_rng(3)
    parts = (4096 * vectors(3_000, 64, 2)).astype(np.int64).reshape(-1, 8, 8)
    start = parts[:16].transpose(1, 0, 2).copy()
    history, state = [start], None
    step = rng.integers(-400, 400, start.shape)
    state, counts = vector_codes.assign(parts, None, history)
    assert counts.tolist() == [0, 0, 8 * len(parts)]
    skipped = []
    for t in range(1, 7):
        history.append(start + (step if t % 2 else 0))
        state, counts = vector_codes.assign(parts, state, history)
        squared = ((parts[:, :, None] - history[-1][None]) ** 2).sum(3)
        assert np.array_equal(state["entry"], squared.argmin(2)) and counts.sum() == 8 * len(parts)
        moved, others = vector_codes._displacements(history)
        place = np.arange(8)
        assert (state["upper"] * (1 + 1e-6) + moved[state["upper_round"], place, state["entry"]] >= np.sqrt(squared.min(2))).all()
        squared[np.arange(len(parts))[:, None], place, state["entry"]] = 1 << 60
        assert (state["lower"] * (1 - 1e-6) - others[state["lower_round"], place, state["entry"]] <= np.sqrt(squared.min(2))).all()
        skipped.append(counts[0] / counts.sum())
    # back where the first bounds were taken, displacement is nothing, though the steps add up
    assert skipped[1] > 0.5 and skipped[5] > 0.5
    accumulated = sum(np.sqrt(((b - a).astype(float) ** 2).sum(2)) for a, b in zip(history[:-1], history[1:]))
    assert (moved[0] <= 1e-9).all() and accumulated.min() > 100


def test_later_rounds_are_settled_by_bounds(spark):
    rows = [(i, v.tolist(), 0, "") for i, v in enumerate(vectors(2_000, 64, 5))]
    seen = []
    original = vector_codes._removed
    try:
        def counted(session, path):
            settled = session.read.parquet(path).select(F.posexplode("settled"))
            seen.append(settled.groupBy("pos").agg(F.sum("col")).collect())
            original(session, path)

        vector_codes._removed = counted
        vector_codes.compress(spark.createDataFrame(rows, SCHEMA))[0].collect()
    finally:
        vector_codes._removed = original
    counts = [{r[0]: r[1] for r in rows} for rows in seen]
    assert len(counts) == 6 and all(sum(c.values()) == 16_000 for c in counts)
    assert counts[0][2] == 16_000 and counts[-1][2] < 8_000
