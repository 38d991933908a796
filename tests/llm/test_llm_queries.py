"""Registered queries against their SQL, and the pipeline's stages on a small corpus."""

import os

import pytest
from compare import compare, duck
from pyspark.sql import functions as F

import corpus_pipeline
from incident_signals.llm import decontaminate
from incident_signals.llm.queries import CHECKS, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, name):
    ok, message = compare(spark, sf_dir, name, QUERIES, CHECKS, duck(sf_dir))
    assert ok, message


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name, label, most", [("op4_quality_classifier", "quality", 0.05), ("op7_toxicity", "toxic", 0.08)])
def test_held_out_accuracy(spark, name, label, most):
    folder = os.environ.get("ACCURACY_DIR", "/root/testdata/sf0.01")
    scored = QUERIES[name](spark, folder).where("held_out")
    joined = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    wrong, n = joined.agg(F.avg((F.col("predicted") != F.col(label)).cast("double")), F.count("*")).first()
    assert n > 50 and wrong <= most


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("score", F.lit("clash"))
    docs = docs.unionByName(docs.limit(3)).cache()
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf_dir).cache()
        if name != "sharding":
            assert after.columns == docs.columns
        if name == "minhash_near_dedup":
            assert after.count() == after.select("doc_id").distinct().count()
        if name == "benchmark_decontamination":
            bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            assert decontaminate.find_contamination(after, bench).where(decontaminate.is_contaminated()).count() == 0
        assert after.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        before = after
    assert before.where("score <> 'clash'").count() == 0
    assert before.select("shard").distinct().count() == 8


def test_pipeline_on_odd_and_empty_documents(spark, sf_dir, docs):
    odd = docs([(None, None, None), (1, ""), (2, "a b c d e f", None), (2, "a b c d e f", None), (3, "x " * 40_000)])
    for frame in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf_dir)
            assert out.count() >= 0 and set(frame.columns) <= set(out.columns)
