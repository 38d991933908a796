"""Shards of nearly equal bytes by sampled splitters.

Splitters are quantiles of a size-weighted sample of keys.  They cut the rows
into many more ranges than shards; a range that turned out too full is
subdivided by hash.  Exact bytes before each range then fix every row's place
in the total order, and with it its shard, without a global sort.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 8
ROWS_PER_RANGE = 5_000
MAX_RANGES = 50_000
SAMPLES_PER_RANGE = 16
# A range of more than this many times its share is subdivided.
OVERFULL = 2


def text_size(text: str = "text"):
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + 1).cast("long")


def text_crc32(text: str = "text"):
    return F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``size``, ``text_crc32``, ``law`` ('bytes'), ``shard``, ``slot`` and ``grown_shard`` (null) to every row.

    Shards are runs of one order of the rows, cut where the bytes so far pass
    equal parts of the total: no shard is off by more than one row's size.  The
    order is that of key ranges (null keys first; equal keys by a hash of the
    row's size and text); inside a range it is by key, or, in an overfull one, by
    hash part and then by key.  Rows equal in key, size and text share a part.
    Keys are whole numbers, or text that spells them; other keys end in an error.
    Slots count from 0 without gaps inside a shard.  Rows that repeat another are placed one
    by one; null and empty texts have size 1; no rows in, no rows out.  Columns
    with the new names are replaced.
    """
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = [c for c in docs.columns if c not in new]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], text_size(text).alias("size"), text_crc32(text).alias("text_crc32"))
    rows = rows.withColumn("_key", F.col(f"`{key}`").cast("long")).withColumn(
        "_spread", F.xxhash64("_key", "size", "text_crc32")
    )
    narrow = rows.select("_key", "_spread", "size")
    n, total = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(1, min(-(-n // ROWS_PER_RANGE), MAX_RANGES))
    # a row enters the sample with a probability in proportion to its size
    chance = F.col("size") * F.lit(ranges * SAMPLES_PER_RANGE / max(total, 1))
    drawn = F.pmod(F.xxhash64("_spread"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = sorted(
        (r[0] is not None, r[0] or 0, r[1])
        for r in narrow.where(drawn < chance).select("_key", "_spread").distinct().collect()
    )
    points = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []

    @F.pandas_udf("int")
    def range_of(keys: pd.Series, spread: pd.Series) -> pd.Series:
        known = keys.notna()
        places = zip(known.tolist(), keys.where(known, 0).astype("int64").tolist(), spread.tolist())
        return pd.Series([bisect.bisect_right(points, at) for at in places], dtype="int32")

    placed = rows.withColumn("_range", range_of("_key", "_spread"))
    # at most MAX_RANGES rows
    filled = placed.groupBy("_range").agg(F.sum("size").alias("_bytes"))
    target = max(1, total // ranges)
    split = filled.where(F.col("_bytes") > OVERFULL * target).select(
        "_range", F.ceil(F.col("_bytes") / target).cast("long").alias("_parts")
    )
    placed = placed.join(F.broadcast(split), "_range", "left").withColumn(
        "_part", F.pmod(F.xxhash64("_spread"), F.coalesce("_parts", F.lit(1).cast("long")))
    )
    parts = placed.groupBy("_range", "_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(
        "_range", "_part", F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
    )
    inside = Window.partitionBy("_range", "_part").orderBy(F.col("_key").asc_nulls_first(), "_spread")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = (
        placed.withColumn("_upto", F.sum("size").over(upto)).withColumn("_place", F.row_number().over(inside))
        .join(F.broadcast(before), ["_range", "_part"])
        .withColumn("_middle", 2 * (F.col("_bytes_before") + F.col("_upto")) - F.col("size"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("_middle") * shards / F.lit(2 * max(total, 1))).cast("int")))
        .withColumn("_place", F.col("_rows_before") + F.col("_place"))
    )
    first = ordered.groupBy("shard").agg(F.min("_place").alias("_first"))
    return ordered.join(F.broadcast(first), "shard").select(
        *[F.col(f"`{c}`") for c in kept], "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_place") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
