"""Near-duplicate groups by an LSH forest and exact set similarity.

Texts with the same shingle set are one representative from the start, whichever
keys they have; it is numbered, and keys come back in at the end.  The
representatives stand in 24 or more sorted signature orders, dealt out by range, so a
hot region is shared by several tasks; neighbours with a long common prefix
are candidates, and regions of many rows are compared at a deeper prefix.
How many orders, and how long a prefix, follows from the similarity asked for.
Candidates are confirmed on the full shingle sets.  Where a region holds too
many rows or pairs, or goes on in another task, a spanning forest of candidates
is confirmed first.  A second pass then cuts these regions into blocks and
compares the full sets of all pairs that still lie between different components.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incident_signals.llm import lsh_forest as forest
from incident_signals.llm.components import components, settled

SHINGLE = 5
SIMILAR_PERCENT = 80


def signed(docs: DataFrame, key: str, text: str, width: int, trees: int) -> DataFrame:
    """``id``, ``mark`` (hash of the text), set size, digest of the set, signature and sketch of each row."""

    def run(batches):
        for batch in batches:
            found = forest.sign(batch.column(2), width, trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found.values()], names=["id", "mark", *found])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("mark"), F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(run, "id long, mark long, n_shingles long, digest binary, sign binary, sketch binary")


def _candidates(chosen: DataFrame, limits: forest.Plan) -> DataFrame:
    """Pairs of neighbours in the trees' orders, and rows with pairs left; ``chosen`` has ``id, sign, sketch``."""
    size = 2 * forest.DEPTH
    rows = chosen.select(
        F.explode(F.sequence(F.lit(0), F.lit(limits.trees - 1))).alias("tree"), "id", "sign", "sketch"
    ).select("tree", F.substr("sign", F.col("tree") * size + 1, F.lit(size)).alias("key"), "id", "sketch")
    # rows of one key stand in another order in each tree
    order = ["tree", "key", F.xxhash64("tree", "id")]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_.mapInArrow(lambda batches: forest.candidates(batches, limits), "a long, b long, tree int")


def _sets(docs: DataFrame, nodes: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``id`` and full shingle set of the representatives ``id, rep, mark``, read from a text of their own."""
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("rep"), F.col(f"`{text}`").alias("_text"))
    marked = texts.withColumn("mark", F.xxhash64("_text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), forest.shingle_sets(batch.column(1), width)], names=["id", "set"])

    # the representatives grow with the texts: never a broadcast
    found = marked.join(nodes.hint("merge"), ["rep", "mark"]).dropDuplicates(["rep", "mark"])
    return found.select("id", "_text").mapInArrow(run, "id long, set array<long>")


def _rest(left: DataFrame, chosen: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, limits: forest.Plan) -> DataFrame:
    """Links between different components in the regions of the rows ``tree, id`` of ``left``.

    All pairs of a region are compared on full sets, but those of two blocks
    whose rows all belong to one component, or whose sizes are too far apart.
    """
    size = 2 * forest.DEPTH
    rows = (
        left.join(chosen.select("id", "sign", "n_shingles"), "id").join(labels, "id", "left")
        .select("tree", F.substr("sign", F.col("tree") * size + 1, F.lit(2 * limits.least_depth)).alias("key"), "id",
                F.coalesce("label", "id").alias("label"), F.col("n_shingles").alias("n"))
    )
    rows = settled(rows, "left")
    mixed = rows.groupBy("tree", "key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high")
    mixed = settled(mixed, "mixed")  # so that both sides of the join below are dealt by its key, and a hot region is split
    order = ["tree", "key", "label", "n", "id"]
    sorted_ = rows.join(mixed, ["tree", "key"], "left_semi").repartitionByRange(*order).sortWithinPartitions(*order)
    members = settled(
        sorted_.mapInArrow(
            lambda batches: forest.numbered(batches, TaskContext.get().partitionId()),
            "tree int, key binary, id long, label long, n long, block long",
        ),
        "blocks",
    )
    blocks = members.groupBy("tree", "key", "block").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    other = blocks.select("tree", "key", *[F.col(c).alias(f"_{c}") for c in ("block", "low", "high", "least", "most")])
    # no set is more alike another than their sizes are
    alike = f"100 * most >= {percent} * _least AND 100 * _most >= {percent} * least"
    pairs = (
        blocks.join(other, ["tree", "key"])
        .where(f"block <= _block AND NOT (low = high AND _low = _high AND low = _low) AND {alike}")
        .select(F.col("block").alias("pair_a"), F.col("_block").alias("pair_b"))
    )
    pairs = settled(pairs, "pairs")
    sides = pairs.select("pair_a", "pair_b", F.explode(F.array_distinct(F.array("pair_a", "pair_b"))).alias("block"))
    both = sides.join(members.select("block", "id", "label"), "block").join(sets.hint("merge"), "id")
    at = ["pair_a", "pair_b"]
    dealt = both.select(*at, "block", "id", "label", "set").repartition(*at).sortWithinPartitions(*at, "block")
    return dealt.mapInArrow(lambda batches: forest.between(batches, percent), "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    shared = F.size(F.array_intersect("_left", "_right"))
    return (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("_left")).hint("merge"), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("set").alias("_right")).hint("merge"), "b")
        .select("a", "b", shared.alias("_shared"), F.size("_left").alias("_n"), F.size("_right").alias("_m"))
        .where(F.col("_shared").cast("long") * 100 >= (F.col("_n") + F.col("_m") - F.col("_shared")).cast("long") * percent)
        .select("a", "b")
    )


def _classes(docs: DataFrame, key: str, text: str, width: int, percent: int, one_per_key: bool) -> tuple[DataFrame, DataFrame]:
    """(marks of all rows, ``id, mark, first_id, first_mark`` of each distinct text with words and a key).

    The last two name the first text, by key, of its component; with
    ``one_per_key`` the texts of one key belong to one component.
    """
    limits = forest.plan(percent)
    marks = settled(signed(docs, key, text, width, limits.trees), "signs")
    sets = marks.where("id IS NOT NULL AND n_shingles > 0")
    same = sets.groupBy("digest", "n_shingles").agg(F.min(F.struct("id", "mark")).alias("first"))
    # a number of its own for each representative, fixed by writing it
    same = settled(
        same.select("digest", "first.*", F.monotonically_increasing_id().alias("node")).withColumnRenamed("id", "rep"), "sets"
    )
    own = same.select("node", F.col("rep").alias("id"), "mark", F.col("digest").alias("_digest"))
    chosen = (
        sets.join(own, ["id", "mark"]).where("digest = _digest").dropDuplicates(["id", "mark"])
        .select(F.col("node").alias("id"), "n_shingles", "sign", "sketch")
    )
    chosen = settled(chosen, "chosen")
    found = settled(_candidates(chosen, limits).distinct(), "pairs")
    pairs = found.where("b IS NOT NULL").select("a", "b")
    ends = found.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id")
    nodes = ends.join(same.select(F.col("node").alias("id"), "rep", "mark").hint("merge"), "id")
    held = settled(_sets(docs, nodes, key, text, width), "sets")
    links = settled(_confirmed(pairs, held, percent), "links")
    labels = components(links)
    left = found.where("b IS NULL").select(F.col("a").alias("id"), "tree")
    more = settled(_rest(left, chosen, labels, held, percent, limits), "more")
    texts = sets.select("id", "mark", "digest").distinct().join(same.select("digest", "node", "rep", F.col("mark").alias("rep_mark")), "digest")
    if one_per_key:
        repeated = sets.groupBy("id").agg(F.min("mark").alias("_low"), F.max("mark").alias("_high")).where("_low < _high")
        held_by = texts.join(repeated.select("id").hint("merge"), "id", "left_semi").select("id", "node")
        first = held_by.groupBy("id").agg(F.min("node").alias("_node"))
        more = settled(more.union(held_by.join(first, "id").where("node <> _node").select("_node", "node")), "more")
    if not more.isEmpty():
        labels = components(links.union(more))
    labelled = same.select("node", F.col("rep").alias("id"), "mark").join(
        labels.select(F.col("id").alias("node"), "label"), "node", "left"
    ).withColumn("label", F.coalesce("label", "node"))
    first = labelled.groupBy("label").agg(F.min(F.struct("id", "mark")).alias("first"))
    by_node = settled(labelled.join(first, "label").select("node", F.col("first.id").alias("first_id"), F.col("first.mark").alias("first_mark")), "first")
    return marks, texts.join(by_node, "node").select("id", "mark", "first_id", "first_mark")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE,
                    percent: int = SIMILAR_PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_shingles``, ``component_id``, ``kept``.

    Words are runs free of blanks, A-Z lower-cased; a set holds the distinct
    runs of ``width`` words, or the whole sequence of fewer.  Texts are linked if
    100 * shared >= ``percent`` * union; ``component_id`` is the smallest key
    reachable, and its rows are ``kept``.  Texts without words, and null texts,
    are linked with nothing.  Rows with a null key are linked with nothing,
    have a null ``component_id`` and are not ``kept``.  Rows that repeat a key
    with different texts count as linked (they are one document), and each of
    the texts is compared with all others.  No rows in, no rows out; other
    columns are not read.
    """
    marks, classes = _classes(docs, key, text, width, percent, one_per_key=True)
    # all texts of a key have one class
    by_key = classes.groupBy("id").agg(F.min("first_id").alias("component_id"))
    out = marks.select("id", "n_shingles").join(by_key, "id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(key), "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE,
                            percent: int = SIMILAR_PERCENT) -> DataFrame:
    """The rows of ``docs`` of which one of each group of near-duplicate texts is left, with all columns.

    The row with the smallest key of a group stays; rows that repeat a key with
    different texts are judged each by its own text.  Rows that repeat key and
    text stay once.  Rows without words or with a null key belong to no group.
    """
    _, classes = _classes(docs, key, text, width, percent, one_per_key=False)
    dropped = classes.where("id <> first_id OR mark <> first_mark").select(F.col("id").alias("_id"), F.col("mark").alias("_mark"))
    whole = docs.withColumn("_id", F.col(f"`{key}`").cast("long")).withColumn("_mark", F.xxhash64(F.col(f"`{text}`")))
    left = whole.where("_id IS NOT NULL").join(dropped.hint("merge"), ["_id", "_mark"], "left_anti")
    one = Window.partitionBy("_id", "_mark").orderBy(F.lit(0))
    first = left.withColumn("_nth", F.row_number().over(one)).where("_nth = 1")
    return first.select(*docs.columns).unionByName(docs.where(F.col(f"`{key}`").isNull()))
