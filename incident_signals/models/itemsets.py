"""Frequent combinations of dimension values of any size."""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incident_signals.schema import short_name, values_of
from incident_signals.session import cut_lineage

# Counting runs inside tasks; it travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMENSIONS = ["predicted_activity", "predicted_hazards", "predicted_barrier_failures", "predicted_lsr",
              "predicted_precursor_tags"]
_COUNTS = "candidate int, n long"


def transactions(df: DataFrame, columns: list[str] = DIMENSIONS) -> DataFrame:
    """Items are ``dimension=value``; a report is one transaction."""
    present = [c for c in columns if c in df.columns]
    return df.select(F.concat(*[_items(df, c) for c in present]).alias("items"))


def _items(df: DataFrame, column: str):
    prefix = F.lit(f"{short_name(column)}=")
    return F.transform(values_of(df, column), lambda v: F.concat(prefix, v))


def _bit_rows(batches: Iterator[pa.RecordBatch], known: list[str]) -> Iterator[pa.RecordBatch]:
    """Per batch one row: for each item the bits of the transactions that hold it."""
    places = pa.array(known, pa.string())
    for batch in batches:
        lists = batch.column(0)
        found = pc.index_in(lists.flatten(), places)
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        there = found.is_valid().to_numpy(zero_copy_only=False)
        held = np.zeros((len(known), len(lists)), bool)
        held[found.drop_null().to_numpy(zero_copy_only=False), owner[there]] = True
        bits = [row.tobytes() for row in np.packbits(held, axis=1)]
        yield pa.RecordBatch.from_arrays([pa.array([bits], pa.list_(pa.binary()))], ["bits"])


def _candidates(frequent: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Sets one item larger whose every part is frequent."""
    known = set(frequent)
    joined = []
    for _, group in itertools.groupby(sorted(frequent), key=lambda s: s[:-1]):
        joined += [(*a, b[-1]) for a, b in itertools.combinations(list(group), 2)]
    return [s for s in joined if all(s[:i] + s[i + 1 :] in known for i in range(len(s) - 2))]


def _supports(batches: Iterator[pa.RecordBatch], candidates: list[tuple[int, ...]]) -> Iterator[pa.RecordBatch]:
    """How many of a task's transactions hold each candidate."""
    counts = np.zeros(len(candidates), np.int64)
    for batch in batches:
        for row in batch.column(0):
            items = [np.frombuffer(bits.as_py(), np.uint8) for bits in row.values]
            prefix, common = None, None
            for place, wanted in enumerate(candidates):
                if wanted[:-1] != prefix:
                    prefix = wanted[:-1]
                    common = np.bitwise_and.reduce([items[i] for i in prefix])
                counts[place] += int(np.bitwise_count(common & items[wanted[-1]]).sum())
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(candidates)), pa.int32()), pa.array(counts, pa.int64())], ["candidate", "n"]
    )


def _levels(df: DataFrame, columns: list[str], min_support: float) -> tuple[list[tuple[tuple[str, ...], int]], int]:
    """Frequent itemsets, level by level, and the number of reports.

    Transactions become bits once: one bit per report and frequent item.  A level
    is one pass over them that counts its candidates in every task.  The driver
    holds the frequent sets, never transactions.
    """
    rows = transactions(df, columns)
    total = rows.count()
    least = max(1, math.ceil(min_support * total))
    items = rows.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    single = {r["item"]: r["n"] for r in items.where(F.col("n") >= least).collect()}
    known = sorted(single)
    found = [((item,), single[item]) for item in known]
    if len(known) < 2:
        return found, total
    bits = cut_lineage(rows.mapInArrow(lambda batches: _bit_rows(batches, known), "bits array<binary>"))
    frequent = [(i,) for i in range(len(known))]
    while candidates := _candidates(frequent):
        counted = bits.mapInArrow(lambda batches, wanted=candidates: _supports(batches, wanted), _COUNTS)
        sums = counted.groupBy("candidate").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        kept = sorted((candidates[r["candidate"]], r["n"]) for r in sums.collect())
        found += [(tuple(known[i] for i in s), n) for s, n in kept]
        frequent = [s for s, _ in kept]
    return found, total


def _table(spark, found: list[tuple[tuple[str, ...], int]]) -> DataFrame:
    return spark.createDataFrame([(list(items), n) for items, n in found], "items array<string>, reports long")


def association_rules(
    df: DataFrame, columns: list[str] = DIMENSIONS, min_support: float = 0.1, min_confidence: float = 0.5
) -> DataFrame:
    """Rules ``antecedent`` => ``consequent`` with the number of reports' share (``support``), ``confidence`` and ``lift``."""
    found, total = _levels(df, columns, min_support)
    sets = _table(df.sparkSession, found)
    parts = sets.where(F.size("items") > 1).select("items", F.col("reports").alias("both"), F.explode("items").alias("part"))
    parts = parts.select(F.array_except("items", F.array("part")).alias("antecedent"), F.array("part").alias("consequent"), "both")
    given = sets.select(F.col("items").alias("antecedent"), F.col("reports").alias("given"))
    alone = sets.select(F.col("items").alias("consequent"), F.col("reports").alias("alone"))
    confidence = F.col("both") / F.col("given")
    rules = parts.join(given, "antecedent").join(alone, "consequent").where(confidence >= min_confidence)
    return rules.select(
        "antecedent", "consequent", confidence.alias("confidence"), (confidence / (F.col("alone") / total)).alias("lift"),
        (F.col("both") / total).alias("support"),
    )


def frequent_itemsets(
    df: DataFrame, columns: list[str] = DIMENSIONS, min_support: float = 0.1, min_confidence: float = 0.5
) -> DataFrame:
    """Itemsets in sorted order with the number of reports holding them."""
    return _table(df.sparkSession, _levels(df, columns, min_support)[0])
