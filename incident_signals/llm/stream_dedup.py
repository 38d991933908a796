"""Exact deduplication as a stateful stream.

The stream's state is keyed by the digest of the normalized text, lives on disk
(RocksDB) and never expires.  Per digest it keeps the stable identifier (the
largest row id seen), the locator of that row's content and the number of rows.
Partial aggregation before the shuffle keeps a hot text from reaching one task
row by row.  Digests seen more than once are hits: their rows are grouped by
their full bytes, so two texts that only share a digest stay apart; rows find
their group again by the digest and a second hash, and a pair of texts that
shares both ends the run with an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incident_signals.llm.text import ascii_lower
from incident_signals.session import new_path

BYTES_PER_BATCH = 64 << 30
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_SCHEMA = "digest string, n long, keeper struct<id:bigint,file:string,row:bigint,mark:bigint>"


def normalized(text: Column) -> Column:
    """A-Z lower-cased; null counts as empty."""
    return F.coalesce(ascii_lower(text), F.lit(""))


def digest(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def mark(text: Column) -> Column:
    """A second hash, to tell rows apart whose texts share a digest."""
    return F.xxhash64(normalized(text))


def _pattern(path: str) -> str:
    """The path as a pattern, which a stream also takes for one file; paths that Spark reads as patterns are left alone."""
    path = path.rstrip("/")
    return path if set(path) & set("{}[]*?\\") else f"{path[:-1]}[{path[-1]}]"


def run_stream(spark: SparkSession, path: str, state_dir: str, out_dir: str, key: str, text: str,
               bytes_per_batch: int = BYTES_PER_BATCH) -> None:
    """Reads what is new at ``path`` and adds the changed state entries to ``out_dir``.

    ``state_dir`` holds offsets and state: a run that was cut off, or new files,
    go on where the last run ended.  A batch writes its own folder anew, so a
    repeated batch changes nothing.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # else each of many small stores sets megabytes of disk aside
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    rows = (
        session.readStream.schema(spark.read.parquet(path).schema)
        .option("maxBytesPerTrigger", bytes_per_batch)
        .parquet(_pattern(path))
        .select(
            digest(F.col(f"`{text}`")).alias("digest"), F.col(f"`{key}`").cast("long").alias("id"),
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
            mark(F.col(f"`{text}`")).alias("mark"),
        )
    )
    state = rows.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "file", "row", "mark")).alias("keeper")
    )

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    started = (
        state.writeStream.outputMode("update")
        .option("checkpointLocation", state_dir)
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    started.awaitTermination()


def latest_state(spark: SparkSession, out_dir: str) -> DataFrame:
    """One row per digest; count and keeper only grow, so the largest are the latest."""
    rows = spark.read.schema(STATE_SCHEMA).option("recursiveFileLookup", "true").parquet(out_dir)
    return rows.groupBy("digest").agg(F.max("n").alias("n"), F.max("keeper").alias("keeper"))


def deduplicate(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text",
                state_dir: str | None = None, bytes_per_batch: int = BYTES_PER_BATCH) -> DataFrame:
    """One row per row of the parquet table at ``path``: ``key``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal if identical after lower-casing A-Z; null counts as empty.
    The largest key of a group stays; a null key is smaller than any other, and
    a group of null keys only has a null ``keep_id`` and keeps none.  Rows that
    repeat the kept key with the same text are all ``kept``.  An empty table
    gives no rows; columns other than the two named are not read.
    ``state_dir`` must be a folder that all executors see; without one a new
    folder below ``spark.checkpoint.dir`` is taken.  ``path`` is read as Spark's
    own readers do: brackets, braces and stars in it are a pattern unless escaped.
    """
    folder = state_dir or new_path(spark, "dedup")
    run_stream(spark, path, f"{folder}/state", f"{folder}/seen", key, text, bytes_per_batch)
    seen = latest_state(spark, f"{folder}/seen")
    content = F.col(f"`{text}`")
    docs = spark.read.parquet(path).select(F.col(f"`{key}`").alias("_key"), content.alias("_text"), digest(content).alias("digest"))
    # full bytes, compared as the key of an aggregation: one copy per task and text is shuffled
    hits = docs.join(seen.where("n > 1").select("digest"), "digest", "left_semi")
    by_text = hits.groupBy("digest", normalized(F.col("_text")).alias("_full")).agg(
        F.max("_key").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    copied = by_text.groupBy("digest", F.xxhash64("_full").alias("_mark")).agg(
        F.count(F.lit(1)).alias("_texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
    )
    copied = copied.withColumn(
        "keep_id", F.when(F.col("_texts") == 1, F.col("keep_id")).otherwise(F.raise_error(F.lit("two texts share both hashes")))
    )
    single = seen.where("n = 1").select(
        "digest", F.col("keeper.mark").alias("_mark"), F.col("keeper.id").alias("keep_id"), F.col("n").alias("group_size")
    )
    classes = single.unionByName(copied.drop("_texts"))
    rows = docs.select("_key", "digest", mark(F.col("_text")).alias("_mark")).join(classes, ["digest", "_mark"])
    return rows.select(
        F.col("_key").alias(key), "keep_id", "group_size",
        F.coalesce(F.col("_key") == F.col("keep_id"), F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256"),
    )
