"""CSV records with quoted line breaks, read from splits of files side by side.

Whether a line begins a record depends on all quotes before it in its file, so
usually one task reads a whole file.  Here each split first counts its quotes; a
prefix sum over a file's splits, one small row each, tells whether a split begins
inside quotes.  Knowing that, each split joins its own lines to records.  A record
that reaches over splits leaves a fragment in each; only fragments are shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incident_signals.session import MAX_BROADCAST_BYTES

# The joining of lines runs inside tasks; it travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A split's row with the name of its file, about.
_SPLIT_BYTES = 512
WHOLE, HEAD, MIDDLE, TAIL = 0, 1, 2, 3


def _lines(spark: SparkSession, path: str) -> DataFrame:
    value = F.col("value")
    return spark.read.text(path, lineSep="\n").select(
        value, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        (F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))).alias("quotes"),
    )


def splits_inside_quotes(lines: DataFrame) -> DataFrame:
    """``file, block`` of the splits that begin inside quotes."""
    odd = lines.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return odd.withColumn("before", F.sum("odd").over(before)).where("before % 2 = 1").select("file", "block")


class _Joiner:
    """Lines of one split, in order, to records and the fragments at its ends."""

    def __init__(self, file: str, block: int, inside: bool):
        self.file, self.block, self.inside, self.at_start = file, block, inside, inside
        self.open: list[str] | None = [] if inside else None
        self.first = block == 0

    def add(self, lines: pa.Array, quotes: np.ndarray) -> Iterator[tuple[pa.Array, int, bool]]:
        """(texts, kind, whether the first of them begins the file)."""
        parity = (int(self.inside) + np.cumsum(quotes)) % 2
        starts = np.flatnonzero(np.append(int(self.inside), parity[:-1]) == 0)
        self.inside = bool(parity[-1])
        cut = int(starts[0]) if len(starts) else len(lines)
        if self.open is not None:
            self.open.extend(lines.slice(0, cut).to_pylist())
            if len(starts) or not self.inside:
                yield pa.array(["\n".join(self.open)]), HEAD if self.at_start else WHOLE, self._is_first()
                self.open, self.at_start = None, False
        if len(starts):
            ends = np.append(starts[1:], len(lines)).astype(np.int32)
            if self.inside:
                self.open = lines.slice(int(starts[-1])).to_pylist()
                starts, ends = starts[:-1], ends[:-1]
            if len(starts):
                bounds = np.append(starts, ends[-1]).astype(np.int32)
                records = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), lines), "\n")
                yield records, WHOLE, self._is_first()

    def _is_first(self) -> bool:
        first, self.first = self.first, False
        return first

    def rest(self) -> Iterator[tuple[pa.Array, int, bool]]:
        if self.open is not None:
            yield pa.array(["\n".join(self.open)]), MIDDLE if self.at_start else TAIL, self._is_first()


def _batch(joiner: _Joiner, texts: pa.Array, kind: int, first: bool) -> pa.RecordBatch:
    n = len(texts)
    return pa.RecordBatch.from_pydict({
        "file": pa.array([joiner.file] * n, pa.string()), "block": pa.array(np.full(n, joiner.block), pa.int64()),
        "kind": pa.array(np.full(n, kind), pa.int32()), "first": pa.array((np.arange(n) == 0) & first), "record": texts,
    })


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    joiner = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        file, block = batch.column("file"), batch.column("block").to_numpy()
        codes = file.dictionary_encode().indices.to_numpy()
        new = np.flatnonzero((codes[1:] != codes[:-1]) | (block[1:] != block[:-1])) + 1
        quotes = batch.column("quotes").to_numpy()
        for low, high in zip([0, *new], [*new, n]):
            key = file[int(low)].as_py(), int(block[low])
            if joiner is None or (joiner.file, joiner.block) != key:
                if joiner is not None:
                    yield from (_batch(joiner, *found) for found in joiner.rest())
                joiner = _Joiner(*key, bool(batch.column("inside")[int(low)].as_py()))
            found = joiner.add(batch.column("value").slice(low, high - low), quotes[low:high])
            yield from (_batch(joiner, *f) for f in found)
    if joiner is not None:
        yield from (_batch(joiner, *found) for found in joiner.rest())


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``record, first``: the text of each record, and whether it is the first of its file; blank ones are left out.

    Quotes inside quotes are doubled.  A quote that is never closed takes the rest of its file.
    """
    lines = _lines(spark, path)
    inside = splits_inside_quotes(lines).withColumn("inside", F.lit(True))
    few = inside.count() * _SPLIT_BYTES <= MAX_BROADCAST_BYTES
    numbered = lines if few else lines.withColumn("line", F.monotonically_increasing_id())
    marked = numbered.join(F.broadcast(inside) if few else inside, ["file", "block"], "left")
    if not few:  # as they are in the files again
        marked = marked.sortWithinPartitions("file", "block", "line").drop("line")
    found = marked.select("value", "file", "block", "quotes", F.coalesce("inside", F.lit(False)).alias("inside")).mapInArrow(
        _joined, "file string, block long, kind int, first boolean, record string"
    )
    so_far = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.last(F.when(F.col("kind") == TAIL, F.col("block")), ignorenulls=True).over(so_far)
    pieces = found.where(F.col("kind") != WHOLE).withColumn("begun", begun)
    stitched = pieces.groupBy("file", "begun").agg(
        F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", "record"))).alias("parts")
    )
    texts = stitched.select(F.array_join(F.col("parts.record"), "\n").alias("record"), "first")
    whole = found.where(F.col("kind") == WHOLE).select("record", "first")
    records = whole.unionByName(texts).withColumn("record", F.regexp_replace("record", "\r$", ""))
    return records.where("record <> ''")
