"""Vector code compression: product codes whose rounds skip most distances by norm-of-sum bounds.

Vectors become whole numbers and are cut into equal parts; each part position
has a codebook that a few rounds of nearest entry and mean refine.  A part keeps
its entry, an upper bound of the distance to it, a lower bound of the distance to
every other entry, and for each bound the round it was taken in.  The codebooks
of all rounds are kept, so in a later round a bound is moved by how far entries
really are from where they stood when it was taken, the norm of the sum of their
steps, and not by the sum of the steps' norms, which is never less.  A part
whose bounds do not settle its entry gets the exact distance to that entry, and
if that does not either, exact distances to all.

Blocks of vectors and their bounds are rows of one table, read and written once
a round without a shuffle; only sums by entry, of fixed size, reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incident_signals.session import new_path

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
# Vectors of one block.
BLOCK = 4096
# Bounds are held in 32 bits; what rounding may have taken from them.
SLACK = 1e-6

_STATE = np.dtype([("entry", "u1"), ("upper_round", "u1"), ("lower_round", "u1"), ("upper", "<f4"), ("lower", "<f4")])


@dataclass
class Codebooks:
    """``history[t][part][entry]``: the integer vectors that round ``t`` assigned to; the last are final."""

    history: list[np.ndarray]

    @property
    def final(self) -> np.ndarray:
        return self.history[-1]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.final.ravel().tolist())).encode()).hexdigest()


def _displacements(history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(how far each entry is from where it stood in each round, the farthest of all other entries), by round and part."""
    now = history[-1]
    moved = np.array([np.sqrt(((now - then).astype(float) ** 2).sum(2)) for then in history])
    others = np.zeros_like(moved)
    for entry in range(moved.shape[2]):
        rest = np.delete(moved, entry, axis=2)
        others[:, :, entry] = rest.max(2) if rest.shape[2] else 0
    return moved, others


def _exact(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to their own entry, or with one more axis to several."""
    gap = parts - entries
    return (gap * gap).sum(-1)


def assign(parts: np.ndarray, state: np.ndarray | None, history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(state after the round of the last codebooks, how many parts were settled by bounds, by one distance, by all).

    ``parts`` has a row per vector and part position; without a state all distances are taken.
    """
    now, rounds = history[-1], len(history) - 1
    n = len(parts)
    position = np.broadcast_to(np.arange(PARTS), (n, PARTS))
    if state is None:
        state = np.zeros((n, PARTS), _STATE)
        open_ = np.ones((n, PARTS), bool)
        counts = [0, 0, n * PARTS]
    else:
        state = state.copy()
        moved, others = _displacements(history)
        entry = state["entry"]
        lower = state["lower"].astype(float)
        # what is left of the lower bound after the other entries' net displacement
        left = lower * (1 - SLACK) - others[state["lower_round"], position, entry]
        upper = state["upper"] * (1 + SLACK) + moved[state["upper_round"], position, entry]
        unsure = ~(upper < left)
        row, part = np.nonzero(unsure)
        near = np.sqrt(_exact(parts[row, part], now[part, entry[row, part]]))
        state["upper"][row, part], state["upper_round"][row, part] = near, rounds
        open_ = np.zeros((n, PARTS), bool)
        open_[row, part] = ~(near * (1 + SLACK) < left[row, part])
        counts = [n * PARTS - len(row), int(len(row) - open_.sum()), int(open_.sum())]
    for p in range(PARTS):
        row = np.flatnonzero(open_[:, p])
        if not len(row):
            continue
        squared = _exact(parts[row, p][:, None, :], now[p][None])
        nearest = squared.argmin(1)  # of equal ones the first
        state["entry"][row, p] = nearest
        state["upper"][row, p] = np.sqrt(squared[np.arange(len(row)), nearest])
        squared[np.arange(len(row)), nearest] = np.iinfo(np.int64).max
        state["lower"][row, p] = np.sqrt(squared.min(1)) if squared.shape[1] > 1 else np.inf
        state["upper_round"][row, p] = state["lower_round"][row, p] = rounds
    return state, np.array(counts)


def _sums(parts: np.ndarray, entry: np.ndarray, entries: int) -> np.ndarray:
    """By part position and entry: the sum of the parts assigned to it, and their number last."""
    out = np.zeros((PARTS, entries, parts.shape[2] + 1), np.int64)
    for p in range(PARTS):
        held = (entry[:, p][None] == np.arange(entries)[:, None]).astype(np.int64)
        out[p, :, :-1] = held @ parts[:, p]
        out[p, :, -1] = held.sum(1)
    return out


def _integers(column: pa.Array, size: int) -> np.ndarray:
    """Whole numbers of vectors of ``size`` components, cut into parts."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    scaled = np.floor(flat * SCALE)
    # squared distances of whole vectors must fit 63 bits
    limit = math.isqrt((1 << 62) // size) // 2
    if len(scaled) and np.abs(scaled).max() > limit:
        raise ValueError(f"a component is beyond {limit / SCALE:g}: squared distances would not fit 64 bits")
    return scaled.astype(np.int64).reshape(len(column), PARTS, -1)


def kept(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is whole: not null, without null or non-finite components, and of a length that parts divide."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(whole, F.lit(False)) & (F.size(vector) > 0) & (F.size(vector) % PARTS == 0))


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows written to the shared folder and read again, and where they are."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _removed(spark: SparkSession, path: str) -> None:
    """Deletes the table of a round that a later one has taken over from."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


_BLOCK = [
    T.StructField("parts", T.BinaryType()), T.StructField("state", T.BinaryType()),
    T.StructField("sums", T.ArrayType(T.LongType())), T.StructField("settled", T.ArrayType(T.LongType())),
]


def _block(parts: np.ndarray, state: np.ndarray | None, history: list[np.ndarray]) -> dict[str, pa.Array]:
    state, counts = assign(parts, state, history)
    sums = _sums(parts, state["entry"], history[0].shape[1])
    small = np.abs(parts).max(initial=0) < 1 << 15
    return {
        "parts": pa.array([parts.astype("<i2" if small else "<i8").tobytes()], pa.binary()),
        "state": pa.array([state.tobytes()], pa.binary()),
        "sums": pa.array([sums.ravel()], pa.list_(pa.int64())),
        "settled": pa.array([counts], pa.list_(pa.int64())),
    }


def _unpacked(batch: pa.RecordBatch, row: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    state = np.frombuffer(batch.column("state")[row].as_buffer(), _STATE).reshape(-1, PARTS)
    data = batch.column("parts")[row].as_buffer()
    kind = "<i2" if data.size == 2 * len(state) * size else "<i8"
    return np.frombuffer(data, kind).astype(np.int64).reshape(len(state), PARTS, -1), state


def _first_blocks(rows: DataFrame, history: list[np.ndarray], size: int) -> DataFrame:
    """Blocks of ``key``, ``label`` and vectors after the first round."""
    listed = [T.StructField(n, T.ArrayType(rows.schema[n].dataType)) for n in ("key", "label")]
    schema = T.StructType(listed + _BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                whole = _block(_integers(piece.column("vector"), size), None, history)
                ends = pa.array([0, piece.num_rows], pa.int32())
                own = {n: pa.ListArray.from_arrays(ends, piece.column(n)) for n in ("key", "label")}
                yield pa.RecordBatch.from_pydict({**own, **whole})

    return rows.mapInArrow(run, schema)


def _next_blocks(blocks: DataFrame, history: list[np.ndarray], size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = {n: batch.column(n).slice(row, 1) for n in ("key", "label")}
                yield pa.RecordBatch.from_pydict({**own, **_block(*_unpacked(batch, row, size), history)})

    return blocks.mapInArrow(run, blocks.schema)


def _improved(blocks: DataFrame, book: np.ndarray) -> np.ndarray:
    """Entries moved to the mean of their parts, rounded down; unused ones stay."""
    totals = blocks.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect()
    parts, entries, width = book.shape
    sums = np.zeros(parts * entries * (width + 1), np.int64)
    for row in totals:
        sums[row["at"]] = row["value"]
    sums = sums.reshape(parts, entries, width + 1)
    number = sums[:, :, -1:]
    return np.where(number > 0, sums[:, :, :-1] // np.maximum(number, 1), book)


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> tuple[DataFrame, Codebooks]:
    """(``key``, ``label``, ``code`` and ``error`` of each kept vector; the codebooks).

    Components become ``floor(4096 * x)``.  The codebooks start as the parts of
    the 16 smallest keys (null keys last, equal keys by vector) and take six
    rounds; ``code`` lists each part's nearest final entry, the first of equal
    ones, and ``error`` is the squared distance over all parts.

    Vectors that are null, hold null or non-finite components, or whose length is
    not that of the smallest key's vector or no multiple of 8, are dropped.  Null
    keys and labels stay.  With fewer than 16 vectors there are as many entries;
    without any, no rows and no entries.  Components so large that squared
    distances leave 64 bits are an error.  Rows that repeat are rows.  Other
    columns are not read.
    """
    spark = vectors.sparkSession
    rows = kept(
        vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector")),
        "vector",
    )
    order = [F.col("key").asc_nulls_last(), "vector"]
    first = rows.orderBy(*order).select(F.size("vector")).limit(1).collect()
    size = first[0][0] if first else PARTS
    rows = rows.where(F.size("vector") == size)
    seeds = [r.vector for r in rows.orderBy(*order).select("vector").limit(ENTRIES).collect()]
    own = [T.StructField(key, rows.schema["key"].dataType), T.StructField(label, rows.schema["label"].dataType)]
    out = T.StructType(own + [T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    if not seeds:
        return spark.createDataFrame([], out), Codebooks([np.zeros((PARTS, 0, size // PARTS), np.int64)])
    start = _integers(pa.array(seeds, pa.list_(pa.float64())), size).transpose(1, 0, 2)
    history = [np.ascontiguousarray(start)]
    blocks, path = _written(_first_blocks(rows, history, size), "vector-blocks")
    for t in range(ROUNDS):
        history = [*history, _improved(blocks, history[-1])]
        if t + 1 < ROUNDS:
            blocks, later = _written(_next_blocks(blocks, history, size), "vector-blocks")
            _removed(spark, path)
            path = later
    names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                parts, state = _unpacked(batch, row, size)
                entry = assign(parts, state, history)[0]["entry"]
                error = _exact(parts, history[-1][np.arange(PARTS), entry]).sum(1)
                codes = pa.array(entry.astype(np.int32).ravel())
                ends = pa.array(np.arange(len(entry) + 1) * PARTS, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(row, 1).flatten(), batch.column("label").slice(row, 1).flatten(),
                     pa.ListArray.from_arrays(ends, codes), pa.array(error)],
                    names=names,
                )

    coded, _ = _written(blocks.mapInArrow(run, out), "vector-codes")
    _removed(spark, path)
    return coded, Codebooks(history)


def with_label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``label_error``: the sum of ``error`` over rows of an equal label; null labels are one."""
    sums = coded.groupBy(F.col(f"`{label}`").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col(f"`{label}`").eqNullSafe(F.col("_label"))).drop("_label")
