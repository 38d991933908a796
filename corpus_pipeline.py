"""From raw documents to shards: quality, near-duplicates, contamination, mixture, shards.

Each stage takes ``(spark, docs, sf_dir)`` and returns the rows it keeps with
all columns they came with; the last adds its own.  ``run`` writes each stage's
result to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incident_signals.llm import decontaminate, mixing, near_dedup, quality, sharding
from incident_signals.llm.components import settled

# SQL cannot fit the classifier or draw the mixture; tests hold the stages against brute force instead.
ORACLE_SQL = None
# As the contract of the operator has it.
SHINGLE, SIMILAR_PERCENT = 3, 85


# Texts that a Python worker holds at once; workers of all stages share an executor with its heap.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def _small_batches(spark: SparkSession) -> None:
    """A stage's result is lazy, so its settings stay until it is written; ``run`` puts the earlier ones back."""
    for name, value in BATCHES.items():
        spark.conf.set(name, value)


def _apart(docs: DataFrame, names: list[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` with columns of ``docs`` that would clash with its own set aside under other names."""
    aside = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c in names}
    out = run(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier fitted on ``labels.quality`` rejects; null texts count as empty."""
    _small_batches(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _apart(docs, ["score", "predicted"], lambda d: quality.score(d, model).where("predicted = 1"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group; texts of a repeated doc_id are judged each for itself, repeated rows stay once."""
    _small_batches(spark)
    return near_dedup.without_near_duplicates(docs, width=SHINGLE, percent=SIMILAR_PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which at least one word in twenty lies in benchmark passages; leaves the rest as they are."""
    _small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _apart(
        docs, ["n_words", "word_spans", "byte_spans", "items"],
        lambda d: decontaminate.find_contamination(d, benchmark).where(~decontaminate.is_contaminated()),
    )


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    _small_batches(spark)
    return mixing.mix(docs)


def sharding_by_size(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot; sizes of the shards are nearly equal."""
    _small_batches(spark)
    return sharding.shard(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding_by_size),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {name: spark.conf.get(name, None) for name in BATCHES}
    try:
        for name, stage in STAGES:
            docs = settled(stage(spark, docs, sf_dir), name)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return docs
