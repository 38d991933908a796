"""Versioned refresh of vectors, enriched reports and analytics.

A refresh writes everything below ``version=<id>`` and, once the tables are
verified, adds the next entry to the manifest.  An entry is a file whose name is
its number and which is created only if it is absent, so every number has one
writer.  A refresh whose predecessor is no longer the last good entry has lost
against another one and is not promoted.  Readers follow the good entry of the
highest number, so a failed refresh changes nothing for them and nothing is
copied back.
"""

from __future__ import annotations

import datetime
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incident_signals.functions.numbers import share
from incident_signals.models.inference import enrich
from incident_signals.operators.similarity import assert_vectors
from incident_signals.plans.analytics import REQUIRED_OUTPUTS, metadata, publish, run_analytics, verify_outputs
from incident_signals.sources.reports import drop_blank, fill_defaults, intake_counts
from incident_signals.sources.vectors import build_vectors

MANIFEST = "number long, version string, created_at string, source string, status string, message string"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{root}/manifest")


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _last(spark: SparkSession, root: str) -> tuple[int, int]:
    """(highest number taken, number of the last good entry); 0 where there is none."""
    folder, files = _files(spark, f"{root}/manifest")
    if not files.exists(folder):
        return 0, 0
    taken = max((int(f.getPath().getName().split(".")[0]) for f in files.listStatus(folder) if f.getPath().getName()[0].isdigit()), default=0)
    good = manifest(spark, root).where(F.col("status") == "good").agg(F.coalesce(F.max("number"), F.lit(0)).alias("n")).first()["n"]
    return taken, good


def _created(spark: SparkSession, path: str, text: str) -> bool:
    """Whether a file of this name was absent and now holds the text."""
    target, files = _files(spark, path)
    try:
        out = files.create(target, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName() or files.exists(target):
            return False
        raise
    out.write(text.encode())
    out.close()
    return True


class LostRefresh(RuntimeError):
    """Another version was promoted since this refresh began."""


def _append(spark: SparkSession, root: str, version: str, source: str, status: str, message: str = "", base: int | None = None) -> None:
    """Adds the next entry; with ``base`` only while that is the number of the last good one."""
    while True:
        taken, good = _last(spark, root)
        if base is not None and good != base:
            raise LostRefresh(f"entry {good} was promoted first")
        now = datetime.datetime.now(datetime.UTC).isoformat()
        row = {"number": taken + 1, "version": version, "created_at": now, "source": source, "status": status, "message": message}
        if _created(spark, f"{root}/manifest/{taken + 1:012d}.json", json.dumps(row) + "\n"):
            return


def current_version(spark: SparkSession, root: str) -> str | None:
    """Version of the good entry of the highest number."""
    good = manifest(spark, root).where(F.col("status") == "good")
    return good.agg(F.max_by("version", "number").alias("v")).first()["v"]


def version_path(root: str, version: str) -> str:
    return f"{root}/version={version}"


def summary(received: DataFrame, enriched: DataFrame, vectors: DataFrame, version: str) -> DataFrame:
    """One row about a refresh."""
    processed = enriched.agg(
        F.count(F.lit(1)).alias("records_processed"),
        F.coalesce(F.sum("sif_prediction"), F.lit(0)).cast("bigint").alias("sif_reports"),
    )
    indexed = vectors.agg(F.struct(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).alias("i")).scalar()
    intake = intake_counts(received).select(F.struct("received", "skipped").alias("i")).scalar()
    return processed.select(
        intake["received"].alias("records_received"),
        indexed["n"].alias("records_indexed"),
        intake["skipped"].alias("records_skipped"),
        "records_processed",
        "sif_reports",
        F.round(share(F.col("sif_reports"), F.col("records_processed")), 4).alias("sif_density"),
        indexed["d"].alias("dimension"),
        F.lit(version).alias("dataset_version"),
    )


def refresh(
    df: DataFrame, root: str, features, sif, rules, embedder, source: str = "uploaded_reports.csv",
    semantic: bool = False, version: str | None = None,
) -> DataFrame:
    """Builds, verifies and promotes a version; returns its summary row."""
    spark = df.sparkSession
    version = version or uuid.uuid4().hex
    path = version_path(root, version)
    base = _last(spark, root)[1]
    try:
        completed = fill_defaults(drop_blank(df))
        completed.write.parquet(f"{path}/reports")
        reports = spark.read.parquet(f"{path}/reports")
        build_vectors(reports, embedder).write.parquet(f"{path}/vectors")
        enrich(reports, features, sif, rules, embedder if semantic else None).write.parquet(f"{path}/enriched")
        enriched, vectors = spark.read.parquet(f"{path}/enriched"), spark.read.parquet(f"{path}/vectors")
        outputs = run_analytics(enriched)
        published = publish(outputs, metadata(enriched, source), f"{path}/analytics")
        _verify(reports, enriched, vectors, published)
        verify_outputs(spark, f"{path}/analytics", list(outputs))
        _append(spark, root, version, source, "good", base=base)
    except Exception as error:
        _append(spark, root, version, source, "failed", str(error))
        raise
    return summary(df, enriched, vectors, version)


def _verify(reports: DataFrame, enriched: DataFrame, vectors: DataFrame, published: list[str]) -> None:
    expected = reports.count()
    if expected == 0:
        raise ValueError("no report has text")
    assert_vectors(vectors)
    for name, table in (("vectors", vectors), ("enriched", enriched)):
        found = table.count()
        if found != expected:
            raise RuntimeError(f"{name} has {found} rows, expected {expected}")
    missing = [name for name in REQUIRED_OUTPUTS if name not in published]
    if missing:
        raise RuntimeError(f"analytics outputs are missing: {missing}")


def restore(spark: SparkSession, root: str, baseline: str) -> None:
    """Points readers at an earlier good version again."""
    known = manifest(spark, root).where((F.col("version") == baseline) & (F.col("status") == "good"))
    if known.limit(1).count() == 0:
        raise ValueError(f"no good version {baseline}")
    _append(spark, root, baseline, "restored", "good")
