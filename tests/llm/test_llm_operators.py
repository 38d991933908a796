"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from incident_signals.llm import (
    backoff_lm,
    decontaminate,
    fm_index,
    gam,
    hashing,
    license_scan,
    license_texts,
    lsh_forest,
    mixing,
    near_dedup,
    quality,
    sharding,
    stream_dedup,
    toxicity,
    url_rules,
)
from incident_signals.llm.components import components


def words_of(n, seed):
    rng = np.random.default_rng(seed)
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(n)]


# 1 url rules

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow")]


def judged(url, default="allow"):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.encode().lower().decode()
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.org/es/1", "http://a.example.org/en/12?x=1", "http://notexample.org/es/",
    "https://x.com/fr/a#b", "https://x.com/fr", "http://com/fr/", "a://b://c/d", "http://example.org/en/1", "http://org", "http://É.org/x",
    "http://example.org/" + "x" * 50_000,
]


def test_url_rules_like_brute_force_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "URLS_PER_RANGE", 4)
    rows = [(i, u, "mine") for i, u in enumerate(URLS * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES + [(None, "/", "block"), ("x", None, "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, rules).collect()}
    assert got == {i: judged(u) for i, u, _ in rows}


def test_url_rules_on_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_rules.judge(pages, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    row = url_rules.judge(one, rules.limit(0), default="block").first()
    assert (row.rule, row.verdict) == (None, "block")


# 2 license scan

def test_license_scan_finds_whole_and_nearly_whole_notices(spark, docs):
    notice = license_scan.TEMPLATES[2][1]
    filler = " ".join(words_of(300, 1))
    rows = [
        (1, f"{filler} {notice} {filler}"), (2, filler), (3, None), (4, ""), (5, "mit license"),
        (6, filler + " Released under the MIT License. " + filler), (6, "Released under the MIT License."),
        (None, "LICENSED UNDER CC BY-NC 4.0!"), (8, notice.replace("General", "Common")), (9, "x " * 50_000 + notice),
    ]
    found = license_scan.scan(docs(rows).withColumn("license", F.lit("clash")))
    got = sorted((r.doc_id or 0, r.license, r.shared_shingles) for r in found.collect())
    assert got == [(0, "cc-by-nc-4.0", 3), (1, "gpl-3.0", 8), (6, "mit", 1), (6, "mit", 1), (9, "gpl-3.0", 8)]
    assert "clash" not in [r.license for r in found.collect()]
    assert license_scan.scan(docs(rows).limit(0)).count() == 0
    assert license_scan.scan(docs(rows), templates=[]).count() == 0


def test_license_scan_finds_whole_licenses_and_long_templates(spark, docs):
    """Texts of hundreds of words and one of 1,500: whole, with one word changed, and, which is not found, half of it."""
    long = " ".join(f"clause{i} of part{i % 7}" for i in range(500))
    templates = [*license_scan.TEMPLATES, ("long", long)]
    whole = [*license_texts.WHOLE, *license_texts.HEADERS, ("long", long)]
    filler = " ".join(f"word{i}" for i in range(700))
    rows, expected = [], set()
    for i, (name, text) in enumerate(whole):
        words = text.split()
        changed = words[:]
        changed[len(words) // 2] = "elsewhere"
        half = words[: len(words) // 2]
        rows += [(3 * i, f"{filler} {text} {filler}"), (3 * i + 1, " ".join(changed)), (3 * i + 2, " ".join(half))]
        expected |= {(3 * i, name), (3 * i + 1, name)}
    found = {(r.doc_id, r.license) for r in license_scan.scan(docs(rows), templates=templates).collect()}
    names = {name for name, _ in whole}
    assert {at for at in found if at[1] in names} == expected
    assert {(i, "mit-grant") for i in (0, 1, 2)} <= found


def test_license_scan_plan_does_not_grow_with_templates(spark, docs):
    """Hundreds of templates stay a few values of the plan."""
    many = [(f"t{i}", " ".join(f"w{i}x{j}" for j in range(40))) for i in range(300)]
    rows = docs([(1, many[7][1]), (2, f"a b {many[299][1]} c"), (3, "a b c d e")])
    found = license_scan.scan(rows, templates=many)
    assert {(r.doc_id, r.license) for r in found.collect()} == {(1, "t7"), (2, "t299")}
    few = license_scan.scan(rows, templates=many[:2])
    intersections = [df._jdf.queryExecution().analyzed().toString().count("array_intersect(") for df in (few, found)]
    assert intersections[0] == intersections[1] > 0


def test_license_scan_stays_native(spark, docs):
    plan = license_scan.scan(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_bands_guarantee_retrieval():
    for shingles in range(1, 200):
        window, shared = 2 * license_scan.block_size(shingles), license_scan.least_shared(shingles)
        miss = (1 - shared / (window + shingles - shared)) ** license_scan.bands_for(shingles)
        assert miss <= 1 - license_scan.GUARANTEE + 1e-12


# 3 decontamination

def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(0)
    for trial in range(60):
        symbols = rng.integers(0, rng.integers(2, 8), rng.integers(1, 200)).astype(np.int64)
        if trial % 3 == 0 and len(symbols) > 60:
            symbols[30:50] = symbols[5:25]
        symbols[-1] = 0
        index = fm_index.FMIndex(symbols)
        for _ in range(10):
            at, size = rng.integers(0, len(symbols)), rng.integers(1, 14)
            phrase = symbols[at : at + size]
            if (phrase == 0).any():
                continue
            low, high = index.search(phrase[None, :], np.array([len(phrase)]))
            expected = [i for i in range(len(symbols) - len(phrase) + 1) if (symbols[i : i + len(phrase)] == phrase).all()]
            assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == expected


def test_contamination_like_brute_force(spark, docs, monkeypatch):
    item, short = words_of(30, 3), words_of(4, 4)
    filler = words_of(400, 5)
    bench = spark.createDataFrame(
        [(1, " ".join(item)), (22, " ".join(short)), (1, " ".join(item)), (3, ""), (4, None), (None, "x y"), (5, "...")],
        "item_id long, text string",
    )
    rows = [
        (1, " ".join(filler[:50] + item[3:20] + filler[50:90])), (2, " ".join(filler)), (3, None), (4, ""),
        (5, " ".join(item).upper() + "! " + "-".join(short)), (5, " ".join(short)), (None, " ".join(short + short)),
        (7, " ".join(item[:12])), (8, " ".join(filler * 200 + item)),
    ]
    texts = docs(rows).withColumn("items", F.lit("clash"))
    for block in (8_000_000, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        found = decontaminate.find_contamination(texts, bench).withColumn("hit", decontaminate.hit_words())
        got = [(r.n_words, r.hit, r["items"]) for r in found.orderBy("doc_id", "n_words").collect()]
        expected = [(8, 8, ["22"]), (107, 17, ["1"]), (400, 0, []), (0, 0, []), (0, 0, []), (4, 4, ["22"]), (34, 34, ["1", "22"]),
                    (12, 0, []), (80_030, 30, ["1"])]
        assert got == expected
    cut = found.select("doc_id", decontaminate.without_spans().alias("left")).where("doc_id = 1").first().left
    assert cut.split() == filler[:90]
    assert decontaminate.find_contamination(texts.limit(0), bench).count() == 0
    assert decontaminate.find_contamination(texts, bench.limit(0)).where(F.size("items") > 0).count() == 0


# 4 quality

def labelled(spark, docs, bad, good, n=120):
    rows = [(i, (bad if i % 3 == 0 else good)(i)) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")
    return docs(rows), labels


def test_quality_learns_and_keeps_every_row(spark, docs):
    texts, labels = labelled(
        spark, docs, lambda i: " ".join([words_of(1, i)[0] + "***"] * 40), lambda i: " ".join(words_of(40, i)) + ".\n"
    )
    held = quality.remainder(F.col("doc_id"), 3) == 1
    model = quality.fit(texts, labels.where(~held))
    odd = docs([(1, None), (1, ""), (None, "a"), (2, "x y. " * 30_000)])
    scored = quality.score(texts.union(odd).withColumn("score", F.lit("clash")), model)
    joined = scored.join(labels, "doc_id").where(held & (F.length("text") > 50) & (F.length("text") < 10_000))
    assert joined.where("predicted <> quality").count() == 0 and joined.count() > 20
    assert scored.count() == 124
    assert scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0


def test_quality_without_labels_is_constant(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs([(1, "a b")]), labels)
    assert quality.score(docs([(1, "a b"), (2, None)]), model).select("score").distinct().count() == 1
    assert quality.score(docs([(1, "a")]).limit(0), model).count() == 0


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


# 5 exact dedup

def test_streaming_dedup_like_brute_force_and_goes_on(spark, docs, tmp_path):
    rows = [(1, "A b"), (5, "a B"), (3, "É"), (4, "é"), (6, None), (7, ""), (5, "a b"), (None, "A b"), (9, "x" * 100_000), (None, "alone")]
    path, state = f"{tmp_path}/d", f"{tmp_path}/s"
    docs(rows).repartition(3).write.parquet(path)

    def expected(rows):
        groups = defaultdict(list)
        for key, text in rows:
            groups[(text or "").encode().lower()].append(key)
        return sorted(
            (str(key), str(max((k for k in groups[t] if k is not None), default=None)), len(groups[t]),
             key is not None and key == max(k for k in groups[t] if k is not None), hashlib.sha256(t).hexdigest())
            for t, keys in groups.items() for key in keys
        )

    def got(df):
        return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in df.collect())

    assert got(stream_dedup.deduplicate(spark, path, state_dir=state, bytes_per_batch=1)) == expected(rows)
    more = [(10, "a b"), (11, "new")]
    docs(more).write.mode("append").parquet(path)
    assert got(stream_dedup.deduplicate(spark, path, state_dir=state)) == expected(rows + more)


@pytest.mark.parametrize("pattern", ["part?1?/d", r"part\[1\]/d", "*/d"])
def test_streaming_dedup_of_a_path_pattern(spark, docs, tmp_path, pattern):
    docs([(1, "Same"), (2, "same"), (3, "other")]).write.parquet(f"{tmp_path}/part[1]/d")
    found = stream_dedup.deduplicate(spark, f"{tmp_path}/{pattern}").collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in found) == [(1, 2, 2), (2, 2, 2), (3, 3, 1)]


def test_streaming_dedup_of_nothing(spark, docs, tmp_path):
    docs([(1, "a")]).limit(0).write.parquet(f"{tmp_path}/d")
    assert stream_dedup.deduplicate(spark, f"{tmp_path}/d").count() == 0


# 6 near dedup

def near_brute(rows, width, percent):
    sets = {}
    for key, text in rows:
        w = (text or "").encode().lower().split()
        sets[key] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize("region", [4, 256])
def test_near_duplicates_like_brute_force(spark, docs, monkeypatch, region):
    monkeypatch.setattr(lsh_forest, "REGION", region)
    monkeypatch.setattr(lsh_forest, "OVERLAP", 2)
    rng = np.random.default_rng(2)
    rows, key = [], 0
    for base in range(12):
        words = words_of(80, 100 + base)
        for _ in range(8):
            copy = list(words)
            for at in rng.integers(0, 80, rng.integers(0, 5)):
                copy[at] = words_of(1, int(rng.integers(10**6)))[0]
            rows.append((key, " ".join(copy)))
            key += 1
    rows += [(200, ""), (201, None), (202, "one"), (203, "ONE"), (204, "a b"), (205, rows[0][1].upper()), (206, "w " * 60_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs(rows), width=3, percent=85).collect()}
    assert got == near_brute(rows, 3, 85)


def test_near_duplicates_in_a_dense_region_like_brute_force(spark, docs):
    rng = np.random.default_rng(5)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 8))
    template, rows, key = [word() for _ in range(180)], [], 0

    # rows 0.84 alike to one another, but for pairs 0.86 alike
    for at in range(3_000):
        text = [word() for _ in range(15)] + template[15:]
        rows.append((key, " ".join(text)))
        key += 1
        if at % 10 == 0:
            rows.append((key, " ".join(text[:4] + [word() for _ in range(11)] + template[15:])))
            key += 1
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs(rows), width=3, percent=85).collect()}
    names = {}
    grams = [[names.setdefault(g, len(names)) for g in {tuple(w[i : i + 3]) for i in range(len(w) - 2)}] for w in (t.split() for _, t in rows)]
    often = np.bincount(np.concatenate(grams)) > 1
    column = np.cumsum(often) - 1
    met = np.zeros((len(rows), int(often.sum())), np.float32)
    for i, g in enumerate(grams):
        met[i, column[[x for x in g if often[x]]]] = 1
    shared, sizes = met @ met.T, np.array([len(g) for g in grams])
    x, y = np.nonzero(np.triu(shared * 100 >= (sizes[:, None] + sizes - shared) * 85, 1))
    assert len(x) >= 300
    want = list(range(len(rows)))
    for a, b in zip(x.tolist(), y.tolist()):
        low, high = sorted((want[a], want[b]))
        want = [low if v == high else v for v in want] if low != high else want
    assert got == {i: (int(n), c) for i, (n, c) in enumerate(zip(sizes, want))}


def test_near_duplicates_limits_follow_the_percent():
    assert lsh_forest.plan(85) == lsh_forest.Plan(24, 4, 39)
    rng = np.random.default_rng(1)
    for percent in (1, 10, 30, 50, 70, 75, 80, 90, 99, 100):
        limits = lsh_forest.plan(percent)
        assert (1 - (percent / 100) ** limits.least_depth) ** limits.trees <= 1e-6
        assert (rng.binomial(64, percent / 100, 100_000) >= limits.least_equal).mean() > 0.9999


@pytest.mark.parametrize("percent", [80, 50])
def test_near_duplicates_of_other_percents_like_brute_force(spark, docs, monkeypatch, percent):
    monkeypatch.setattr(lsh_forest, "REGION", 16)
    monkeypatch.setattr(lsh_forest, "OVERLAP", 2)
    rng = np.random.default_rng(6)
    rows = []
    for base in range(3):
        words = words_of(105, 300 + base)
        own = 11 if percent == 80 else 34
        # nearly at the limit: some pairs share a few words of their own
        for at in range(60):
            mine = words_of(own, int(rng.integers(10**6)))
            rows.append((len(rows), " ".join(mine + words[own:])))
            if at % 6 == 0:
                rows.append((len(rows), " ".join(mine[:7] + words_of(own - 7, int(rng.integers(10**6))) + words[own:])))
    found = near_dedup.near_duplicates(docs(rows), **({} if percent == 80 else {"percent": percent})).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == near_brute(rows, 5, percent)


def test_near_duplicates_nulls_repeats_and_nothing(spark, docs):
    got = near_dedup.near_duplicates(docs([(None, "a b c"), (2, "a b c"), (2, "a b c"), (1, "a  B c")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [
        ("1", "1", True), ("2", "1", False), ("2", "1", False), ("None", "None", False)]
    assert near_dedup.near_duplicates(docs([(1, "a")]).limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, None)], "a long, b long")
    labels = {r.id: r.label for r in components(links).collect()}
    assert labels == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# 7 toxicity

def test_toxicity_learns_stems(spark, docs):
    def bad(i):
        w = words_of(30, i)
        return " ".join(w[:15] + ["grumf" + w[0][:2]] + w[15:])

    texts, labels = labelled(spark, docs, bad, lambda i: " ".join(words_of(30, i)), 240)
    model = toxicity.fit(texts, labels.where(quality.remainder(F.col("doc_id"), 5) != 0))
    odd = docs([(1, None), (1, ""), (None, "grumfzz " + "ab " * 40_000)])
    scored = toxicity.score(texts.union(odd).withColumn("predicted", F.lit("clash")), model)
    joined = scored.join(labels, "doc_id").where((quality.remainder(F.col("doc_id"), 5) == 0) & (F.length("text") > 0))
    assert joined.where("predicted <> toxic").count() == 0 and joined.count() > 30
    assert scored.count() == 243
    assert toxicity.score(texts.limit(0), model).count() == 0
    constant = toxicity.fit(texts, labels.limit(0))
    assert toxicity.score(texts, constant).select("score").distinct().count() == 1


# 8 sharding

def test_shards_are_even_whole_and_gapless(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", 20)
    rng = np.random.default_rng(3)
    rows = [(int(i), "é" * int(rng.integers(0, 60))) for i in range(400)]
    rows += [(7, "same")] * 150 + [(None, None), (None, ""), (900, "x" * 2_000)]
    got = sharding.shard(docs(rows).withColumn("slot", F.lit("clash"))).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    size = lambda t: len((t or "").encode()) + 1
    totals, slots = Counter(), defaultdict(list)
    for r in got:
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (size(r.text), zlib.crc32((r.text or "").encode()), "bytes", None)
        totals[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert sorted(totals) == list(range(8))
    assert max(totals.values()) - min(totals.values()) <= 2 * 2_001
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(docs(rows).limit(0)).count() == 0
    assert [r.shard for r in sharding.shard(docs([(1, None)])).collect()] == [4]


# 9 language model

@pytest.mark.parametrize("block_bytes", [16 << 20, 200, 1])
def test_backoff_scores_like_brute_force(spark, docs, monkeypatch, block_bytes):
    monkeypatch.setattr(backoff_lm, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(backoff_lm, "TABLES", 3)
    texts = {1: "a b c a b", 2: "A b d", 3: "z", 4: "", 5: None, 6: "b c b c"}
    tokens = {k: re.findall(r"[a-z]+", (t or "").lower()) for k, t in texts.items()}

    def grams(k, n):
        return Counter(tuple(tokens[k][i : i + n]) for i in range(len(tokens[k]) - n + 1))

    for order in (1, 2, 3):
        everything = {n: sum((grams(k, n) for k in tokens), Counter()) for n in range(1, order + 1)}
        total = sum(len(t) for t in tokens.values())

        def others(k, gram):
            return everything[len(gram)][gram] - grams(k, len(gram))[gram]

        def word(k, i, n):
            gram = tuple(tokens[k][i - n + 1 : i + 1])
            if n == 1:
                return max(others(k, gram), 1) / max(total - len(tokens[k]), 1)
            return others(k, gram) / others(k, gram[:-1]) if others(k, gram) > 0 else 0.4 * word(k, i, n - 1)

        expected = {
            k: sum(np.log(word(k, i, min(order, i + 1))) for i in range(len(t))) / len(t) for k, t in tokens.items() if t
        }
        got = {r.doc_id: r.log_score for r in backoff_lm.score(docs(list(texts.items())), order=order).collect()}
        assert got == pytest.approx(expected)
    assert backoff_lm.score(docs([(1, "a")]).limit(0)).count() == 0


# 10 mixing

def test_pivot_keeps_sums_and_leaves_one_open():
    rng = np.random.default_rng(4)
    kept = []
    for _ in range(300):
        f = rng.random(7).tolist()
        out, _ = mixing.pivot(f, rng.integers(0, 2**63, 7).tolist())
        assert sum(out) == pytest.approx(sum(f)) and sum(0 < x < 1 for x in out) <= 1
        kept.append(np.array(out) - np.array(f))
    assert np.abs(np.mean(kept, axis=0)).max() < 0.1


def test_mixture_is_near_its_targets(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 20)
    monkeypatch.setattr(mixing, "FAN", 3)
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), [None, "a", "b", "ä", "c"][i % 5 if i % 3 else 1]) for i in range(900)]
    rows += [(5, "w w", "a"), (5, "w w", "a"), (None, "w", None), (901, None, "b")]
    frame = docs(rows)
    first = sorted(map(str, mixing.mix(frame).collect()))
    assert first == sorted(map(str, mixing.mix(frame.repartition(7)).collect()))
    size = Counter()
    for _, text, source in rows:
        size[source] += len((text or "").split())
    wanted = mixing.targets(dict(size))
    assert sum(wanted.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(wanted[s] <= 2 * size[s] + 1e-6 for s in size)
    taken, times = Counter(), Counter()
    for r in mixing.mix(frame).collect():
        taken[r.source] += len((r.text or "").split())
        times[(r.doc_id, r.text, r.source)] += 1
    assert all(abs(taken[s] - wanted[s]) <= 60 for s in size), (taken, wanted)
    assert all(n <= 2 * Counter(map(tuple, rows))[k] for k, n in times.items())
    assert mixing.mix(frame.limit(0)).count() == 0


# helpers

def test_word_hashes_equal_words_equal_hashes():
    texts = ["One two  one", "", None, "ONE\tÉé two", "x" * 70_000 + " one"]
    data, offsets = hashing.column_bytes(pa.array(texts))
    hashes, bounds, starts, ends = hashing.word_hashes(data[: offsets[-1]], offsets, hashing.PLAIN_WORDS)
    words = [w for t in texts for w in (t or "").encode().lower().split()]
    assert len(hashes) == len(words) and np.diff(bounds).tolist() == [3, 0, 0, 3, 2]
    assert len({(w, h) for w, h in zip(words, hashes.tolist())}) == len(set(words)) == len(set(hashes.tolist()))


def near_groups(rows, width, percent):
    """Component of each distinct (key, text) by all pairs; texts of one key linked on request of the caller."""
    texts = sorted({(k, t) for k, t in rows if k is not None and t and t.split()}, key=repr)
    sets = [{tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} for w in (t.lower().split() for _, t in texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return texts, find, root


def repeated_key_rows():
    base = [words_of(120, seed) for seed in range(40)]
    changed = lambda w, at: " ".join([*w[:at], "zzzzz", *w[at + 1 :]])
    rows = [(1, " ".join(base[0])), (1, " ".join(base[1])), (2, changed(base[0], 60)), (3, changed(base[1], 50)),
            (4, changed(base[0], 20)), (5, changed(base[1], 20)), (5, changed(base[1], 20)), (6, ""), (6, ""), (7, None), (None, "a b")]
    for i in range(2, 40):
        rows += [(10 + i % 7, " ".join(base[i])), (100 + i, changed(base[i], 10))]
    return rows


def test_every_text_of_a_repeated_key_is_compared(spark, docs):
    rows = repeated_key_rows()
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(rows), width=3, percent=85).collect()}
    texts, find, root = near_groups(rows, 3, 85)
    first = {}
    for i, (k, _) in enumerate(texts):
        if k in first:
            root[find(i)] = find(first[k])
        first.setdefault(k, i)
    least = {}
    for i, (k, _) in enumerate(texts):
        least[find(i)] = min(least.get(find(i), k), k)
    want = {k: least[find(i)] for i, (k, _) in enumerate(texts)}
    assert got == {**want, 6: 6, 7: 7, None: None} and got[3] == got[5] == 1


def test_one_row_of_each_group_stays(spark, docs):
    rows = repeated_key_rows()
    kept = near_dedup.without_near_duplicates(docs(rows), width=3, percent=85)
    assert kept.columns == docs(rows).columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    texts, find, _ = near_groups(rows, 3, 85)
    groups = defaultdict(list)
    for i, text in enumerate(texts):
        groups[find(i)].append(text)
    chosen = {t for t in got if t[1] and t[1].split() and t[0] is not None}
    assert len(chosen) == len(groups) and max(got.values()) == 1
    for members in groups.values():
        (one,) = [m for m in members if m in chosen]
        assert one[0] == min(k for k, _ in members)
    assert {(6, ""), (7, None), (None, "a b")} == set(got) - chosen
    assert near_dedup.without_near_duplicates(docs(rows).limit(0)).count() == 0
