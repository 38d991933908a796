"""Copies of documents for a mixture of sources, by pivotal rounding.

Every document of a source starts with the same fractional number of copies.
In blocks of one source and similar sizes, two documents at a time pass their
fractions to one another until one of them is whole; the one left over in each
block goes up a reduction tree, where the same is done again, until a source
has a single one left.

Sizes of sources, their targets and the numbers of their blocks are tables, so
neither the driver nor a broadcast grows with the number of sources.  Copies of
a source add up to the expected number but for the last document.  Its words
follow as closely as the sizes of documents that trade are equal: neighbours in
order of size trade, so a source's words are off by about its largest document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incident_signals.llm.components import settled
from incident_signals.llm.text import plain_word_count
from incident_signals.operators.numbering import numbered

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2.0
# Documents of a block, and left-over documents of a tree node, at most.
BLOCK_ROWS = 5_000
FAN = 64
_NEAR = 1e-9
_ALL = (1 << 64) - 1


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share=SHARE, most=MOST_COPIES) -> dict[str | None, float]:
    """Words wanted of each source: ``share`` of all words by weight, none above ``most`` times its own."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not full:
            out.update({s: unit * weight[s] for s in open_})
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
        left = max(left, 0.0)
    return out


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_COPIES) -> DataFrame:
    """The same for a table ``source, source_size``: adds ``target``.

    Sources are numbered by range in code-point order, null last.  The share of
    a unit of weight only rises as sources reach their most, so each round is one
    sum over the sources that are full at the unit of the round before.
    """
    named = numbered(sizes.where(F.col("source").isNotNull()), ["source"], "_n")
    known = named.count()
    both = named.unionByName(sizes.where(F.col("source").isNull()).withColumn("_n", F.lit(known).cast("long")))
    weight = F.array(*[F.lit(float(w)) for w in weights])
    ranked = settled(both.withColumn("_weight", F.get(weight, F.pmod("_n", F.lit(len(weights))).cast("int"))), "mix-sources")
    limit, size = most * F.col("source_size"), F.col("source_size")
    unit, full = 0.0, -1
    while True:
        over = F.col("_weight") * unit > limit
        row = ranked.agg(
            F.sum(size).alias("all"), F.count_if(over).alias("full"), F.sum(F.when(over, limit)).alias("taken"),
            F.sum(F.when(~over, F.col("_weight"))).alias("weight"),
        ).first()
        if row["full"] == full or not row["weight"]:
            break
        full, unit = row["full"], max(share * row["all"] - (row["taken"] or 0.0), 0.0) / row["weight"]
    target = F.least(F.col("_weight") * unit, limit) if row["weight"] else limit
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def _chance(a: int, b: int) -> float:
    """A number from 0 to 1 that two row hashes fix."""
    x = (a * 0x9E3779B97F4A7C15 + (b ^ 0xD6E8FEB86659FD93) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ (x >> 31)) * 0x94D049BB133111EB) & _ALL
    return ((x ^ (x >> 29)) >> 11) / (1 << 53)


def pivot(fractions: list[float], marks: list[int]) -> tuple[list[float], int]:
    """Fractions after pairing one by one; all are 0 or 1 but at most one, whose place is returned (or -1)."""
    out = [0.0 if f < _NEAR else 1.0 if f > 1 - _NEAR else f for f in fractions]
    open_ = -1
    for j, b in enumerate(out):
        if b in (0.0, 1.0):
            continue
        if open_ < 0:
            open_ = j
            continue
        a, luck = out[open_], _chance(marks[open_], marks[j])
        total = a + b
        if abs(total - 1) < _NEAR:
            out[open_], out[j] = (1.0, 0.0) if luck < a else (0.0, 1.0)
            open_ = -1
        elif total < 1:
            if luck < b / total:
                out[open_], out[j], open_ = 0.0, total, j
            else:
                out[open_], out[j] = total, 0.0
        elif luck < (1 - b) / (2 - total):
            out[open_], out[j], open_ = 1.0, total - 1, j
        else:
            out[open_], out[j] = total - 1, 1.0
    return out, open_


def _rounded(rows: DataFrame, groups: list[str]) -> DataFrame:
    """``fraction`` after pivoting inside each group, from the largest document down, so that a small one is left over."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "mark"], ascending=False, kind="stable")
        out, _ = pivot(pdf["fraction"].tolist(), [m & _ALL for m in pdf["mark"].tolist()])
        return pdf.assign(fraction=out)

    return rows.groupBy(*groups).applyInPandas(run, rows.schema)


def plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """One row per row of ``rows`` (``key``, ``source``, ``size``): adds ``source_size``, ``target``, ``copies``, ``taken``.

    Sources in code-point order, null last, take the weights in turn.  Expected
    copies of a document are its source's target over its source's size; a
    document gets the whole number below or above.  Rows of size 0 take part and
    take nothing.  The draw depends on keys and sizes only, so reruns agree; rows
    that repeat another draw by themselves.  No rows in, no rows out.
    """
    level = F.floor(4 * F.log2(F.col("size") + 1)).cast("int")
    rows = rows.select("key", "source", "size", level.alias("level"))
    cells = settled(rows.groupBy("source", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), "mix-cells")
    wanted = source_targets(cells.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    # blocks from the largest documents down; a cell's documents are dealt by hash over the blocks that it reaches into
    down = Window.partitionBy("source").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(down), F.lit(0))
    first, last = F.floor(F.col("before") / BLOCK_ROWS), F.floor((F.col("before") + F.col("n") - 1) / BLOCK_ROWS)
    placed = cells.withColumn("before", before).select(
        F.col("source").alias("_source"), F.col("level").alias("_level"), first.alias("first"), (last - first + 1).alias("blocks")
    )
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(expected + _NEAR)
    numbers = wanted.select(
        F.col("source").alias("_name"), "source_size", "target", whole.cast("int").alias("whole"),
        F.greatest(F.lit(0.0), expected - whole).alias("fraction"),
    )
    cell = settled(
        placed.join(numbers, F.col("_source").eqNullSafe(F.col("_name"))).drop("_name"), "mix-blocks"
    )
    height = cell.agg(F.coalesce(F.max(F.col("first") + F.col("blocks")), F.lit(0)).alias("h")).first()["h"]
    spread = rows.withColumn("mark", F.xxhash64("key", "size", F.lit(7))).join(
        cell, F.col("source").eqNullSafe(F.col("_source")) & (F.col("level") == F.col("_level"))
    )
    current = spread.select(
        "key", "source", "size", "mark", (F.col("first") + F.pmod(F.xxhash64("mark"), F.col("blocks"))).cast("int").alias("node"),
        "whole", "fraction", "source_size", "target",
    )
    open_ = (F.col("fraction") > 0) & (F.col("fraction") < 1)
    done = settled(_rounded(current, ["source", "node"]), "mix")
    decided, current = [done.where(~open_)], done.where(open_)
    while height > 1:
        # a parent takes the left-over documents of 64 neighbouring nodes
        raised = current.withColumn("parent", F.floor(F.col("node") / FAN).cast("int"))
        done = settled(_rounded(raised, ["source", "parent"]).withColumn("node", F.col("parent")).drop("parent"), "mix")
        decided.append(done.where(~open_))
        current = done.where(open_)
        height = -(-height // FAN)
    last = current.withColumn(
        "fraction",
        F.when(F.pmod(F.xxhash64("mark", F.lit(11)), F.lit(1 << 30)) / float(1 << 30) < F.col("fraction"), 1.0).otherwise(0.0),
    )
    every = last
    for part in decided:
        every = every.unionByName(part)
    copies = (F.col("whole") + F.col("fraction")).cast("int")
    return every.select(
        "key", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken")
    )


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the same columns.

    Size is the number of words by whitespace.  Rows that repeat a key are told
    apart by source, size and a hash of the text; full repeats are interchangeable.
    """
    marked = docs.withColumn("_size", plain_word_count(F.col(f"`{text}`"))).withColumn("_hash", F.xxhash64(F.col(f"`{text}`")))
    # null keys too are dealt by what else tells rows apart
    alike = [F.col(f"`{key}`"), F.col(f"`{source}`"), F.col("_size"), F.col("_hash")]
    marked = marked.withColumn("_nth", F.row_number().over(Window.partitionBy(*alike).orderBy(F.lit(0))))
    rows = marked.select(
        F.struct(F.col(f"`{key}`").alias("id"), F.col(f"`{source}`").cast("string").alias("source"), F.col("_size").alias("size"),
                 F.col("_hash").alias("hash"), F.col("_nth").alias("nth")).alias("key"),
        F.col(f"`{source}`").cast("string").alias("source"), F.col("_size").alias("size"),
    )
    taken = plan(rows, **options).where("copies > 0").select(
        F.col("key.id").alias("_id"), F.col("key.source").alias("_from"), F.col("key.size").alias("_words"), F.col("key.hash").alias("_of"),
        F.col("key.nth").alias("_at"), "copies",
    )
    same = (
        F.col(f"`{key}`").eqNullSafe(F.col("_id")) & F.col(f"`{source}`").cast("string").eqNullSafe(F.col("_from"))
        & (F.col("_size") == F.col("_words")) & (F.col("_hash") == F.col("_of")) & (F.col("_nth") == F.col("_at"))
    )
    joined = marked.join(taken.hint("merge"), same)
    return joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
