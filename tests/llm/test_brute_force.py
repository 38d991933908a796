"""Registered queries without SQL, and what each stage of the pipeline keeps, against plain Python on a small corpus."""

import os
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from incident_signals.llm.queries import QUERIES


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def letter_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def test_shards_of_the_query(spark, sf_dir, documents):
    got = {r.doc_id: r for r in QUERIES["op8_sharding"](spark, sf_dir).collect()}
    assert len(got) == len(documents)
    totals, slots = Counter(), defaultdict(list)
    for key, text, _ in documents:
        data, row = (text or "").encode(), got[key]
        assert (row["size"], row.text_crc32, row.law, row.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        totals[row.shard] += row["size"]
        slots[row.shard].append(row.slot)
    largest = max(len((t or "").encode()) + 1 for _, t, _ in documents)
    assert sorted(totals) == list(range(8)) and max(totals.values()) - min(totals.values()) <= 2 * largest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def wanted_words(size):
    """Exact targets: 150 % of all words by weights 3, 1, 2, none above twice its own, the rest shared again."""
    names = sorted(s for s in size if s is not None) + [s for s in size if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = Fraction(3, 2) * sum(size.values()), list(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > 2 * size[s]]
        for s in full or open_:
            out[s] = Fraction(2 * size[s]) if full else unit * weight[s]
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def near_target(rows, taken, wanted):
    """Each source is off by no more than its two largest documents."""
    largest = defaultdict(list)
    for source, size in rows:
        largest[source].append(size)
    for source, words in wanted.items():
        assert abs(taken[source] - words) <= sum(sorted(largest[source])[-2:]) + 1, (source, taken[source], float(words))


def test_mixture_of_the_query(spark, sf_dir, documents):
    got = {r.doc_id: r for r in QUERIES["op10_source_mixing"](spark, sf_dir).collect()}
    size = {key: len(plain_words(text)) for key, text, _ in documents}
    by_source = Counter()
    for key, _, source in documents:
        by_source[source] += size[key]
    wanted, taken = wanted_words(by_source), Counter()
    assert len(got) == len(documents)
    for key, _, source in documents:
        row = got[key]
        assert (row["size"], row.source_size) == (size[key], by_source[source])
        assert row.target == pytest.approx(float(wanted[source])) and row.taken <= 2 * size[key]
        assert row.taken == 0 or row.taken % size[key] == 0
        taken[source] += row.taken
    near_target([(s, size[k]) for k, _, s in documents], taken, wanted)
    again = {r.doc_id: r.taken for r in QUERIES["op10_source_mixing"](spark, sf_dir).collect()}
    assert again == {k: r.taken for k, r in got.items()}


def test_language_of_labels_in_the_classifier_queries(spark, sf_dir, documents):
    """Held-out rows and predictions follow their definitions for every document."""
    for name, modulus, rest in (("op4_quality_classifier", 3, 1), ("op7_toxicity", 5, 0)):
        rows = {r.doc_id: r for r in QUERIES[name](spark, sf_dir).collect()}
        assert set(rows) == {k for k, _, _ in documents}
        for key, row in rows.items():
            assert row.held_out == (zlib.crc32(str(key).encode()) % modulus == rest)
            assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.5)


def near_groups(rows):
    """Smallest row of each group of near-duplicate texts, by all pairs of shingle sets."""
    texts = {}
    for key, text in rows:
        words = plain_words(lowered(text))
        if key is not None and words:
            texts[key, text] = {tuple(words[i : i + 3]) for i in range(max(len(words) - 2, 1))}
    names = list(texts)
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = defaultdict(list)
    for name, grams in texts.items():
        for other in {o for g in grams for o in held[g]}:
            shared = len(grams & texts[other])
            if 100 * shared >= 85 * (len(grams) + len(texts[other]) - shared):
                root[find(name)] = find(other)
        for g in grams:
            held[g].append(name)
    groups = defaultdict(list)
    for name in names:
        groups[find(name)].append(name)
    return list(groups.values())


def contaminated(text, windows):
    words = letter_words(text)
    hit = set()
    for width, held in windows.items():
        for i in range(len(words) - width + 1):
            if tuple(words[i : i + width]) in held:
                hit.update(range(i, i + width))
    return len(hit) > 0 and 20 * len(hit) >= len(words)


def test_pipeline_stage_by_stage(spark, sf_dir, tables):
    """Every stage on what its predecessor kept, with repeated ids and planted copies and passages."""
    folder = os.environ.get("SF_DIR", sf_dir)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.text]
    base = max((r for r in docs.collect() if r.text and r.lang == "en"), key=lambda r: len(r.text))
    long_text = " ".join(base.text.split()[:400])
    extra = spark.createDataFrame(
        [(10_000_001, long_text, "en", "src1", 1), (10_000_002, long_text.replace(long_text.split()[200], "changed", 1), "en", "src2", 1),
         (10_000_003, " ".join([long_text[: 40], max(bench, key=len)]), "en", "src1", 1)], docs.schema,
    )
    kept = docs.unionByName(extra)
    sources = defaultdict(int)
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = stage(spark, before, folder).cache()
        old, new = [[(r.doc_id, r.text, r.source) for r in frame.collect()] for frame in (before, kept)]
        if name == "quality_classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
            good = [r for r in old if labels.get(r[0]) == 1]
            assert not Counter(new) - Counter(old)
            assert len([r for r in good if r in set(new)]) >= 0.95 * len(good)
            assert len([r for r in new if labels.get(r[0]) == 0]) <= 0.1 * len([r for r in old if labels.get(r[0]) == 0]) + 1
            # all later stages see the planted rows
            kept = kept.unionByName(extra.join(kept.select("doc_id"), "doc_id", "left_anti")).cache()
        elif name == "minhash_near_dedup":
            groups = near_groups([(k, t) for k, t, _ in old])
            want = {min(g, key=lambda m: m[0]) for g in groups} | {(k, t) for k, t, _ in old if not plain_words(t)}
            assert Counter((k, t) for k, t, _ in new) == Counter(want)
        elif name == "benchmark_decontamination":
            windows = defaultdict(set)
            for text in bench:
                words = letter_words(text)
                width = min(13, len(words))
                for i in range(len(words) - width + 1 if width else 0):
                    windows[width].add(tuple(words[i : i + width]))
            assert Counter(new) == Counter(r for r in old if not contaminated(r[1], windows))
            assert 10_000_003 in {r[0] for r in old} - {r[0] for r in new}
        elif name == "source_mixing":
            for _, text, source in old:
                sources[source] += len(plain_words(text))
            taken, copies, times = Counter(), Counter(new), Counter(old)
            for row, n in copies.items():
                assert n <= 2 * times[row]
                taken[row[2]] += n * len(plain_words(row[1]))
            near_target([(s, len(plain_words(t))) for _, t, s in old], taken, wanted_words(dict(sources)))
        else:
            assert Counter(new) == Counter(old)
            total = Counter()
            for r in kept.select("shard", F.octet_length(F.coalesce("text", F.lit(""))).alias("n")).collect():
                total[r.shard] += r.n + 1
            assert len(total) == 8 and max(total.values()) - min(total.values()) <= 2 * max(len((t or "").encode()) + 1 for _, t, _ in old)


@pytest.mark.parametrize("sizes", [
    {}, {None: 7}, {"a": 0}, {"a": 10, "b": 10, None: 10}, {"a": 1, "b": 1_000, "c": 2, "ä": 30, "z": 0, None: 5},
    {f"s{i:03}": (i * 7919) % 1_000 for i in range(200)},
])
def test_targets_of_a_table_of_sources(spark, sizes):
    from incident_signals.llm import mixing

    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(table).collect()}
    assert got == pytest.approx({s: float(v) for s, v in wanted_words(sizes).items()})


def test_mixture_of_very_many_sources(spark):
    """Thousands of sources of a few documents each."""
    from incident_signals.llm import mixing

    rows = spark.range(9_000).select(
        F.col("id").alias("key"), F.concat(F.lit("host"), F.col("id") % 3_000).alias("source"), (F.col("id") % 50 + 1).alias("size")
    )
    out = mixing.plan(rows)
    assert out.count() == 9_000 and out.where("taken > 2 * size OR taken % size <> 0").count() == 0
    total, wanted = out.agg(F.sum("taken"), F.sum(F.col("target") * F.col("size") / F.col("source_size"))).first()
    assert abs(total - wanted) < 0.02 * wanted
