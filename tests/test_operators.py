"""Operators on small hand-checked tables and against brute force."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from incident_signals import fixed_values as fixed
from incident_signals.functions import lists, numbers, text
from incident_signals.operators import density as d
from incident_signals.operators import emerging as e
from incident_signals.operators import normalization as n
from incident_signals.operators import patterns as p
from incident_signals.operators import profiles, quality, reports, scoring, similarity, summary, temporal
from incident_signals.operators.numbering import numbered
from incident_signals.schema import require
from incident_signals.session import new_path
from incident_signals.sources import reports as source

SCHEMA = ("report_id string, date string, site string, location string, sif_prediction int, sif_probability double, "
          "predicted_activity array<string>, predicted_hazards array<string>, predicted_barrier_failures array<string>, "
          "predicted_lsr array<string>, predicted_precursor_tags array<string>, description string")


def enriched(spark, count=30):
    rows = [
        (f"REP-{i:04d}", f"2024-{i % 12 + 1:02d}-15", f"Site {i % 3}", f"Area {i % 3}", int(i % 4 == 0),
         0.8 if i % 4 == 0 else 0.3, [["Maintenance"], ["Hot Work"], ["Drilling"]][i % 3],
         [["Fire"], ["Fire", "Gas"], [], ["Gas"], ["Fire"]][i % 5], [["ISO"], [], ["PPE"], ["ISO"]][i % 4],
         [["Driving"], ["Hot Work", "Driving"], ["Hot Work"], ["Driving"]][i % 4], ["tag"], "text " * 40)
        for i in range(count)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def col(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def results(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


# --- functions --------------------------------------------------------------------------------


def test_text_cleaning(spark):
    cases = {
        "Señor Müller": "senor muller",
        "Oil\t was \n\n seen   here": "oil was seen here",
        "SIMOPS went on; the IP skipped LOTO.": "simultaneous operations went on the injured person skipped lockout tagout.",
        "Nobody tested. Nothing moved.": "nobody tested. nothing moved.",
        "Hoist-7 jammed? Brake, B-12 held.": "hoist-7 jammed brake b-12 held.",
        "No LOTO?": "no lockout tagout",
        "½ ﬁre №5 \U0001d400 toolbox talk": "12 fire no5 a tbt",
        "": "",
    }
    df = col(spark, [*cases, None])
    assert results(df, text.normalize_text(F.col("v"))) == [*cases.values(), ""]


def test_ascii_folding_follows_unicode(spark):
    import unicodedata

    chars = [chr(c) for c in list(range(0xA0, 0x250)) + list(range(0x2000, 0x2200)) + list(range(0xFB00, 0xFB07))]
    expected = [unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in chars]
    assert results(col(spark, chars), text.fold_to_ascii(F.col("v"))) == expected
    assert results(col(spark, ["".join(chars * 3)]), text.fold_to_ascii(F.col("v"))) == ["".join(expected * 3)]


def test_clauses_titles_excerpts(spark):
    df = col(spark, ["First clause here. short; a second one and a third clause"])
    assert results(df, text.split_clauses(F.col("v")))[0] == ["First clause here", "a second one", "a third clause"]
    words = ["didn't stop", "P-204 pump", "aB cD"]
    assert results(col(spark, words), text.title_case(F.col("v"))) == [w.title() for w in words]
    assert results(col(spark, words), F.expr(text.title_case_sql("v"))) == [w.title() for w in words]
    assert results(col(spark, ["x" * 121, "x" * 120, None]), text.excerpt(F.col("v"))) == ["x" * 120 + "...", "x" * 120, ""]


def test_lists(spark):
    cells = ['["a", "b"]', "", None, "null", "[broken", "5", '"a"', "[]"]
    assert results(col(spark, cells), lists.parse_list(F.col("v"))) == [["a", "b"], [], [], [], [], ["5"], ["a"], []]
    assert results(col(spark, cells), lists.is_malformed_list(F.col("v"))) == [c == "[broken" for c in cells]
    tags = ["Energy Isolation|Line of Fire", "['Hot Work', 'Invalid Rule']", "None", None, '["Driving"]', "Nonsense"]
    assert results(col(spark, tags), lists.parse_rule_tags(F.col("v"))) == [
        ["Energy Isolation", "Line of Fire"], ["Hot Work"], [], [], ["Driving"], []]
    assert results(col(spark, [[" a", "b", "a", " ", None]], "array<string>"), lists.distinct_items(F.col("v"))) == [["a", "b"]]


def test_entity_names(spark):
    cells = ["{'value': 'Hot Work', 'score': 1}", '{"rule": "a b"}', "['x', 'y']", None, " plain ", "{'name': \"O'Neil\"}"]
    assert results(col(spark, cells), text.clean_entity_name(F.col("v"))) == ["Hot Work", "a b", "x", "Unknown", "plain", "O'Neil"]


def test_numbers(spark):
    df = spark.createDataFrame([(0, 5.0, 0.0), (1, 10.0, 5.0)], "i int, a double, b double")
    assert results(df, numbers.percent_change(F.col("a"), F.col("b"))) == [None, 1.0]
    assert results(df, numbers.min_max(F.col("a"), F.lit(5.0), F.lit(5.0))) == [0.5, 0.5]
    odd = col(spark, [float("nan"), float("inf"), 1.0], "double")
    assert results(numbers.finite_or_null(odd), "v") == [None, None, 1.0]


def test_normalization(spark):
    values = ["Welding", "pump overhaul", "hot work near the roof", "Something-else 2b", "hot WORK"]
    out = results(col(spark, values), n.normalized("v", n.activity))
    assert out == ["Hot Work", "Maintenance", "Hot Work", "Something-Else 2B", "Hot Work"]
    assert results(col(spark, ["Electrocution", "acid"]), n.normalized("v", n.hazard)) == [fixed.IGNORE_TOKEN, "Chemical Exposure"]
    assert results(col(spark, ["Gas Test", "new Tag"]), n.normalized("v", n.precursor_tag)) == ["gas-test-failure", "new-tag"]
    assert results(col(spark, ["the LOTO missing today", "?"]), n.normalized("v", n.barrier_of_phrase)) == [
        "ENERGY_ISOLATION_FAILURE", "UNKNOWN_FAILURE"]
    hazards = col(spark, [["fire", "explosion", "electrocution", "crane"]], "array<string>")
    assert results(hazards, n.normalize_list("v", n.hazard)) == [["Fire/Explosion", "Suspended Load"]]


def test_longest_variant_wins_in_every_table(spark):
    """Each table against a direct search."""
    rng = random.Random(7)
    for block, function in ((fixed.ACTIVITY_NAMES, n.activity), (fixed.HAZARD_NAMES, n.hazard), (fixed.EQUIPMENT_NAMES, n.equipment)):
        names = fixed.table(block)
        variants = [(v, name) for name, vs in names for v in vs]
        values = [f"x {a} {b}" for a, b in ((rng.choice(variants)[0], rng.choice(variants)[0]) for _ in range(40))]
        ordered = sorted(variants, key=lambda item: -len(item[0]))
        expected = [next(name for v, name in ordered if v in value) for value in values]
        assert results(col(spark, values), n.normalized("v", function)) == expected


# --- density, profiles, summary -----------------------------------------------------------------


def test_density_counts_and_warnings(spark):
    rows = {r["name"]: r for r in d.density(enriched(spark, 15), "site").collect()}
    assert rows["Site 0"]["total_reports"] == 5 and rows["Site 0"]["data_quality_warnings"] == ["LOW_SAMPLE_SIZE"]
    large = d.density(enriched(spark, 60), "site").collect()
    assert all(r["data_quality_warnings"] == [] for r in large)
    assert d.density(enriched(spark, 5).limit(0), "site").count() == 0


def test_repeated_values_and_ids_count_once(spark):
    row = ("a", "2024-01-01", "S", "L", 1, 0.5, ["x", "x", ""], [], [], ["r", "q"], [], "t")
    df = spark.createDataFrame([row, row], SCHEMA)
    once = d.density(df, "predicted_activity", unique_ids=False).collect()
    assert [(r["name"], r["total_reports"]) for r in once] == [("x", 1)]
    both = d.density(df.limit(1), "predicted_lsr").collect()
    assert sorted((r["name"], r["total_reports"]) for r in both) == [("q", 1), ("r", 1)]


def test_profile_lists(spark):
    df = enriched(spark, 30)
    rows = {r["name"]: r for r in profiles.hazard_profile(df).collect()}
    fire = rows["Fire"]
    reports_with = [r for r in df.collect() if "Fire" in r["predicted_hazards"]]
    assert fire["total_reports"] == len(reports_with)
    assert fire["associated_sites"] == sorted({r["site"] for r in reports_with})
    assert fire["associated_site_count"] == len(fire["associated_sites"])
    counted = {a: sum(a in r["predicted_activity"] for r in reports_with) for a in ("Maintenance", "Hot Work", "Drilling")}
    listed = [(x["name"], x["total_reports"]) for x in fire["associated_activities"]]
    assert listed == sorted(((a, c) for a, c in counted.items() if c), key=lambda t: (-t[1], t[0]))
    assert profiles.consequence_profile(df) is None


def test_shared_profiles_equal_the_single_ones(spark):
    df = enriched(spark, 30).withColumn("predicted_potential_consequences", F.col("predicted_hazards"))
    shared = profiles.all_profiles(df)
    single = {
        "site_analytics": profiles.site_profile(df), "activity_analytics": profiles.activity_profile(df),
        "lsr_analytics": profiles.rule_profile(df), "hazard_analytics": profiles.hazard_profile(df),
        "barrier_analytics": profiles.barrier_profile(df), "consequence_analytics": profiles.consequence_profile(df),
    }
    assert list(shared) == list(single)
    for name, expected in single.items():
        assert shared[name].columns == expected.columns
        assert sorted(map(str, shared[name].collect())) == sorted(map(str, expected.collect()))
    assert "consequence_analytics" not in profiles.all_profiles(enriched(spark, 3))
    twice = profiles.all_profiles(df.unionByName(df), unique_ids=False)["hazard_analytics"]
    assert sorted(map(str, twice.collect())) == sorted(map(str, single["hazard_analytics"].collect()))
    counts = profiles.shared_pair_counts(df, {"site": ["predicted_hazards", "predicted_lsr"], "predicted_hazards": ["site"]})
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Union" not in plan


def test_rewritten_tables_are_read_anew(spark, tmp_path):
    from incident_signals.catalog.adapter import read_table

    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    assert read_table(spark, path).columns == ["id"]
    spark.range(5).selectExpr("id", "id AS more").write.mode("overwrite").parquet(path)
    assert read_table(spark, path).columns == ["id", "more"] and read_table(spark, path).count() == 5


def test_summary_of_nothing_and_missing_columns(spark):
    row = summary.overall_summary(enriched(spark, 3).limit(0)).first()
    assert row["total_reports"] == 0 and row["highest_volume_site"] is None and row["overall_sif_density"] == 0.0
    with pytest.raises(ValueError, match="predicted_lsr"):
        require(enriched(spark, 3).drop("predicted_lsr"))


def test_audit_raises(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None)], "report_id string, description string")
    row = summary.audit(df, ["report_id", "description"]).first()
    assert tuple(row) == (2, 1, 1)
    with pytest.raises(ValueError, match="missing descriptions"):
        summary.assert_audit(df, ["report_id"])


# --- patterns -----------------------------------------------------------------------------------


def brute_patterns(rows, minimum):
    counts = {}
    for kind, columns in p.ALL_PATTERNS:
        for r in rows:
            sides = [r[c] if isinstance(r[c], list) else [r[c]] for c in columns]
            seen = {(a, b, *c) for a in sides[0] for b in sides[1] for c in ([(x,) for x in sides[2]] if len(sides) > 2 else [()])}
            for values in seen:
                counts.setdefault((kind, values), []).append(r)
    return {k: v for k, v in counts.items() if len(v) >= minimum}


def test_patterns_against_brute_force(spark):
    df = enriched(spark, 40)
    expected = brute_patterns(df.collect(), 5)
    found = p.count_patterns(df).collect()
    assert len(found) == len(expected)
    for r in found:
        values = tuple(v for v in (r["a"], r["b"], r["c"]) if v is not None)
        hits = expected[(r["pattern_type"], values)]
        assert r["occurrences"] == len(hits) and r["sif_count"] == sum(h["sif_prediction"] for h in hits)
        assert r["affected_sites"] == sorted({h["site"] for h in hits})
        assert r["date_range"]["min"] == min(h["date"] for h in hits)
        assert r["data_quality_warnings"] == (["LOW_PATTERN_SUPPORT"] if len(hits) < 10 else [])
    ids = [r["pattern_id"] for r in found]
    assert len(set(ids)) == len(ids) and "site_hazard__fire__site_0" in ids


def test_pattern_examples_and_pruned_definitions(spark):
    df = enriched(spark, 40)
    with_ids = {r["pattern_id"]: r for r in p.with_examples(p.mine_pairs(df), df, fixed.PAIR_PATTERNS).collect()}
    expected = brute_patterns(df.collect(), 5)
    hits = expected[("activity_hazard", ("Maintenance", "Fire"))]
    row = with_ids["activity_hazard__maintenance__fire"]
    ids = sorted(h["report_id"] for h in hits)
    assert row["example_report_ids"] == ids[:5]
    assert [x["report_id"] for x in row["example_reports"]] == ids[:3]
    assert row["example_reports"][0]["description_excerpt"].endswith("...")
    assert {k for k, _ in p.available(df.drop("location", "predicted_lsr"), p.ALL_PATTERNS)}.isdisjoint(
        {"location_precursor", "site_lsr", "lsr_barrier", "activity_lsr"})


def test_scores(spark):
    one = spark.createDataFrame([("i", "t", 10, 8, 0.8, 0.5, 2)],
                                "pattern_id string, pattern_type string, occurrences int, sif_count int, sif_density double, avg_sif_probability double, affected_site_count int")
    row = scoring.score_patterns(one).first()
    assert row["priority_components"]["frequency"] == 0.5 and row["priority_components"]["cross_site"] == 0.5
    assert row["priority_score"] == round(100 * (0.2 * 0.5 + 0.35 * 0.8 + 0.25 * 0.5 + 0.2 * 0.5), 1)
    with pytest.raises(ValueError):
        scoring.score_patterns(one, {"frequency": 0.5, "sif_density": 0.1, "avg_sif_probability": 0.1, "cross_site": 0.1})


def test_emerging_windows_clamp_month_ends(spark):
    days = ["2023-05-31"] * 6 + ["2023-02-28"] * 5 + ["2023-02-27"] * 3 + ["2022-11-28"] * 1 + ["2022-11-27"] * 9
    rows = [(str(i), day, "S", "L", 0, 0.1, ["a"], ["h"], ["b"], ["r"], ["t"], "x") for i, day in enumerate(days)]
    found = {r["pattern_id"]: r for r in e.detect_emerging(spark.createDataFrame(rows, SCHEMA)).collect()}
    row = found["activity_hazard__a__h"]
    assert (row["current_count"], row["previous_count"], row["status"]) == (11, 4, "EMERGING")
    assert row["current_period"] == "2023-02-28 to 2023-05-31"
    assert row["previous_period"] == "2022-11-28 to 2023-02-28"


def test_one_period_is_new(spark):
    rows = [(str(i), "2024-01-01", "S", "L", 0, 0.1, ["a"], ["h"], ["b"], ["r"], ["t"], "x") for i in range(10)]
    assert {r["status"] for r in e.detect_emerging(spark.createDataFrame(rows, SCHEMA)).collect()} == {"NEW_PATTERN"}


# --- temporal, reports --------------------------------------------------------------------------


def test_periods_and_trends(spark):
    df = enriched(spark, 24).withColumn("date", F.when(F.col("report_id") == "REP-0001", "no date").otherwise(F.col("date")))
    months = temporal.with_trends(temporal.summary_by(df, "month")).orderBy("period").collect()
    assert [m["period"] for m in months] == [f"2024-{i:02d}" for i in range(1, 13)]
    assert months[0]["trends"] is None and months[1]["report_volume"] == 1
    assert months[1]["trends"]["report_volume"]["absolute_change"] == -1
    assert months[1]["trends"]["sif_count"]["percentage_change"] == -1.0
    assert months[2]["trends"]["sif_count"]["percentage_change"] is None
    assert [r["period"] for r in temporal.summary_by(df, "quarter").orderBy("period").collect()][:2] == ["2024Q1", "2024Q2"]
    assert temporal.date_warnings(df.withColumn("date", F.lit("bad"))).first()[0] == ["MISSING_DATE_DATA"]


def test_pages(spark):
    df = spark.range(1000).select(F.col("id").alias("report_id"))
    assert [r[0] for r in reports.page(df, 3, 10).collect()] == list(range(20, 30))
    assert tuple(reports.page_totals(df, 30).first()) == (1000, 34)
    with pytest.raises(ValueError):
        reports.sites_by(df, "name")


def test_numbering(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("k")).repartition(9)
    rows = numbered(df, ["k"], "n").collect()
    assert all(r["k"] == r["n"] for r in rows) and len(rows) == 500
    assert sorted(r["n"] for r in numbered(df, None, "n", start=1).collect()) == list(range(1, 501))


def test_csv_reading(spark):
    path = new_path(spark, "csv")
    content = ['report_id,description,sif_label,hazard,extra', 'A,"line one\nline ""two""",1,None,NA', 'B,plain,x,Fire,', 'C,n/a,0,null,z']
    spark.createDataFrame([("\n".join(content),)], "t string").coalesce(1).write.text(path)
    rows = {r["report_id"]: r for r in source.read_reports_csv(spark, path).collect()}
    assert rows["A"]["description"] == 'line one\nline "two"' and rows["A"]["sif_label"] == 1
    assert rows["A"]["hazard"] is None and rows["A"]["extra"] is None
    assert rows["B"]["sif_label"] is None and rows["B"]["hazard"] == "Fire"
    assert rows["C"]["description"] is None
    with pytest.raises(ValueError, match="severity"):
        source.read_reports_csv(spark, path, required=["severity"])


def test_defaults(spark):
    df = spark.createDataFrame([(None, "a", " "), ("X", "b", "S"), ("", "c", None)], "report_id string, description string, site string")
    rows = {r["description"]: r for r in source.fill_defaults(df, order=["description"]).collect()}
    assert [rows[k]["report_id"] for k in "abc"] == ["REP-00001", "X", "REP-00002"]
    assert [rows[k]["site"] for k in "abc"] == ["General Site", "S", "General Site"]
    assert rows["a"]["date"] == datetime.date.today().isoformat() or rows["a"]["date"]
    upload = source.fill_defaults(df.drop("report_id"), fixed.UPLOAD_DEFAULTS, id_prefix="UPLOAD_", blanks=False)
    assert sorted(r["report_id"] for r in upload.collect()) == ["UPLOAD_00001", "UPLOAD_00002", "UPLOAD_00003"]
    assert [r["site"] for r in upload.where("description = 'c'").collect()] == [None]


# --- quality ------------------------------------------------------------------------------------


def test_ranking_metrics_against_pairs(spark):
    rng = random.Random(3)
    data = [(rng.choice([0, 1, 1]), round(rng.random(), 2)) for _ in range(300)]
    row = quality.ranking_metrics(spark.createDataFrame(data, "y int, s double"), "y", "s").first()
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    average, recall = 0.0, 0.0
    for t in sorted({s for _, s in data}, reverse=True):
        hit = [y for y, s in data if s >= t]
        average += (sum(hit) / len(pos) - recall) * sum(hit) / len(hit)
        recall = sum(hit) / len(pos)
    assert row["roc_auc"] == pytest.approx(auc) and row["pr_auc"] == pytest.approx(average)


def test_one_score_for_a_third_of_rows(spark):
    """A heavy tie is one row of the curve, whatever the buckets."""
    data = [(i % 2, 0.5 if i % 3 == 0 else i / 900) for i in range(900)]
    df = spark.createDataFrame(data, "y int, s double")
    a = quality.ranking_metrics(df, "y", "s").first()
    curve = quality.score_curve(df, "y", "s", buckets=3)
    assert curve.count() == len({s for _, s in data})
    assert curve.agg(F.max("tp"), F.max("fp")).first()[:] == (450, 450) and 0 < a["roc_auc"] < 1


def test_threshold_default_when_recall_is_low(spark):
    df = spark.createDataFrame([(1, 0.05), (0, 0.9), (1, 0.02)], "y int, s double")
    assert quality.choose_threshold(quality.threshold_metrics(df, "y", "s")).first()["threshold"] == 0.5


def test_labels_and_readiness(spark):
    df = spark.createDataFrame([("1", ["a", "b"], ["a"]), ("2", [], ["c"]), ("3", ["a"], ["a"])],
                               "report_id string, t array<string>, p array<string>")
    outcomes = quality.label_outcomes(df, "t", "p")
    rows = {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in quality.label_metrics(outcomes).collect()}
    assert rows == {"a": (2, 0, 0), "b": (0, 0, 1), "c": (0, 1, 0)}
    multi = quality.multilabel_metrics(df, "t", "p", ["a", "b", "c"]).first()
    assert multi["hamming_loss"] == pytest.approx(2 / 9) and multi["exact_match_ratio"] == pytest.approx(1 / 3)
    assert multi["macro_f1"] == pytest.approx(1 / 3)
    gate = spark.createDataFrame([("hazard", 0.6)], "dimension string, f1 double")
    assert quality.readiness(gate, {"hazard": 0.6}).first()[0] is True
    assert quality.readiness(gate).first()[0] is False


# --- similarity ---------------------------------------------------------------------------------


def vectors(spark, count=200, dimension=8):
    rng = random.Random(5)
    rows = [(i, f"R{i}", [rng.gauss(0, 1) for _ in range(dimension)]) for i in range(count)]
    rows[7] = (7, "R7", rows[3][2])
    df = spark.createDataFrame(rows, "vector_id bigint, report_id string, embedding array<double>")
    return df.withColumn("embedding", similarity.unit_vector(F.col("embedding"))).repartition(6)


def brute_nearest(df, k, exclude=False):
    rows = df.collect()
    out = {}
    for q in rows:
        scored = [(-round(sum(a * b for a, b in zip(q["embedding"], v["embedding"])), 12), v["vector_id"]) for v in rows
                  if not (exclude and v["report_id"] == q["report_id"])]
        out[q["vector_id"]] = [i for _, i in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("limit", [1_000_000, 20_000])
def test_nearest_in_one_or_several_batches(spark, limit, monkeypatch):
    monkeypatch.setattr(similarity, "_COLUMNS", 7)
    df = vectors(spark)
    asked = df.select(F.col("vector_id").alias("query_id"), "embedding", F.col("report_id").alias("exclude_id"))
    found = {}
    for r in similarity.top_k(df, asked, 4, batch_bytes=limit).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vector_id"])
    assert found == brute_nearest(df, 4, exclude=True)


def test_nearest_over_slices_and_blocks(spark, monkeypatch):
    """Many slices, pieces and blocks give the same, and blocks of queries are no jobs of their own."""
    monkeypatch.setattr(similarity, "SLICE_BYTES", 2_000)
    monkeypatch.setattr(similarity, "_ROWS", 5)
    df = vectors(spark)
    asked = df.select(F.col("vector_id").alias("query_id"), "embedding")
    spark.sparkContext.setJobGroup("blocks", "blocks of one query")
    found = {}
    for r in similarity.top_k(df, asked, 4, batch_bytes=1).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vector_id"])
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("blocks")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == brute_nearest(df, 4)
    assert len(found) > 20 and 0 < len(jobs) < 20


def test_retrieval_checks(spark):
    from incident_signals.models.features import HashingEmbedder

    df = spark.createDataFrame([("1", "pump leaked oil"), ("2", "crane load fell"), ("3", " ")], "report_id string, description string")
    from incident_signals.sources.vectors import build_vectors

    table = build_vectors(df, HashingEmbedder(32))
    similarity.assert_vectors(table, 32)
    query = spark.createDataFrame([("q", "Oil leaked from the pump")], "query_id string, query string")
    best = similarity.retrieve(table, query, HashingEmbedder(32), 5).orderBy("rank").collect()
    assert len(best) == 2 and best[0]["incident_id"] == "1" and best[0]["rank"] == 1
    with pytest.raises(ValueError):
        similarity.retrieve(table, query.withColumn("query", F.lit("  ")), HashingEmbedder(32))
    with pytest.raises(ValueError):
        similarity.top_k(table, query, 0)
    with pytest.raises(ValueError, match="not 0..n-1"):
        similarity.assert_vectors(table.withColumn("vector_id", F.col("vector_id") + 1))


# --- plans --------------------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_limits_apply_before_the_shuffle(spark):
    df = enriched(spark, 20)
    assert plan_of(p.with_examples(p.mine_pairs(df), df, fixed.PAIR_PATTERNS)).count("WindowGroupLimit") >= 2
    outcomes = quality.label_outcomes(df, "predicted_hazards", "predicted_barrier_failures")
    assert plan_of(quality.error_samples(outcomes)).count("WindowGroupLimit") >= 2


def test_no_cartesian_products(spark):
    df = enriched(spark, 20)
    for frame in (summary.overall_summary(df), profiles.site_profile(df), e.detect_emerging(df), p.count_patterns(df)):
        plan = plan_of(frame)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scans_read_only_needed_columns(spark):
    path = new_path(spark, "columns")
    enriched(spark, 20).write.parquet(path)
    plan = plan_of(d.density(spark.read.parquet(path), "predicted_hazards"))
    schema = plan.split("ReadSchema: ")[1]
    assert "description" not in schema and "predicted_lsr" not in schema


@pytest.mark.parametrize("order, rows_in_range", [("report_id", 10), ("site", 7), (["kind", "site"], 25), ("site", 100_000)])
def test_pages_of_a_narrowed_range(spark, monkeypatch, order, rows_in_range):
    monkeypatch.setattr(reports, "RANGE_ROWS", rows_in_range)
    monkeypatch.setattr(reports, "SPLITTERS", 3)
    monkeypatch.setattr(reports, "SAMPLE", 50)
    rows = [(i, None if i % 9 == 0 else f"S{i % 4 if i % 2 else 1}", i % 3, "x") for i in range(500)] + [(7, "S3", 1, "x")] * 40
    df = spark.createDataFrame(rows, "report_id int, site string, kind int, `odd.name` string").repartition(5)
    names = [order] if isinstance(order, str) else order
    names = names + ["report_id"] * ("report_id" not in names)
    at = {"report_id": 0, "site": 1, "kind": 2}
    want = sorted(rows, key=lambda r: tuple((r[at[n]] is not None, r[at[n]]) for n in names))
    for number in (1, 2, 7, 13, 18, 19):
        got = [tuple(r) for r in reports.page(df, number, 30, order).collect()]
        assert got == want[(number - 1) * 30 : number * 30], number


def _rows_scanned(df):
    """(rows that came out of the scan, files it opened) of a query that is run here."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    scan = plan.collectLeaves().head()
    metrics = {m._1(): m._2().value() for m in (scan.metrics().toSeq().apply(i) for i in range(scan.metrics().size()))}
    return metrics["numOutputRows"], metrics["numFiles"]


def test_layout_skips_years_sites_and_row_groups(spark):
    rows = spark.range(40_000).select(
        F.col("id").alias("report_id"), F.concat(F.lit("S"), F.col("id") % 40).alias("site"),
        F.when(F.col("id") % 400 > 0, F.expr("date_add(date'2020-01-01', cast(id % 4 as int) * 366)")).alias("date"), F.sha2(F.col("id").cast("string"), 256).alias("text"),
    )
    path = new_path(spark, "layout")
    source.write_report_layout(rows, path, row_group_bytes=64 * 1024)
    table = source.read_report_layout(spark, path)
    assert table.count() == 40_000 and table.where("period IS NULL").count() == 100
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found, every = _rows_scanned(table.where("report_id = 12345"))
        assert found < 4_000
        assert table.where("report_id = 12345").count() == 1
        some, files = _rows_scanned(table.where("site = 'S7'"))
        assert some < 20_000 and table.where("site = 'S7'").count() == 1_000
        _, files = _rows_scanned(source.read_report_layout(spark, path, [2021]))
        assert files < every
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_examples_are_found_below_a_bound(spark):
    """Of patterns counted with bounds, only rows that can be examples reach the sort; the examples stay the same."""
    from incident_signals.session import cut_lineage

    df = spark.range(3000).select(
        ((F.col("id") * 7919) % 3000).alias("report_id"), F.concat(F.lit("s"), F.col("id") % 9).alias("site"),
        F.lit("2024-01-01").cast("date").alias("date"), F.lit(1).alias("sif_prediction"), F.lit(0.5).alias("sif_probability"),
        F.array(F.concat(F.lit("h"), F.floor(F.sqrt("id")) % 40)).alias("predicted_hazards"),
        F.array(F.when(F.col("id") % 9 == 0, "only here").otherwise("any")).alias("predicted_barrier_failures"),
    )
    plain = p.with_examples(p.mine_pairs(df), df, fixed.PAIR_PATTERNS)
    counted = cut_lineage(p.mine_pairs(df, bounds=True))
    bounds = {r["_upto"] is None for r in counted.collect()}
    assert bounds == {True, False}
    bounded = p.with_examples(counted, df, fixed.PAIR_PATTERNS)
    assert bounded.columns == plain.columns
    assert sorted(bounded.collect(), key=str) == sorted(plain.collect(), key=str)
    rows = p.pattern_rows(df, p.available(df, fixed.PAIR_PATTERNS), []).select(
        *p.KEY[:3], F.coalesce("c", F.lit("")).alias("c"), F.col("_id").alias("report_id"))
    kept = p._up_to(rows, counted.where(F.col("_upto").isNotNull()).withColumn("c", F.coalesce("c", F.lit("")))).count()
    assert kept < rows.count() / 2


def test_examples_of_reports_with_text_ids(spark):
    """Least ids are found while hashing, not by sorting all combinations, and the examples are those of the whole sort."""
    from incident_signals.session import cut_lineage

    rows = [(f"REP-{i * 7919 % 100003:06d}é", f"s{i % 7}", ["a", "b"][: i % 2 + 1], [f"h{i % 3}"]) for i in range(900)] + [
        (None, "s1", ["a"], ["h1"])
    ]
    df = spark.createDataFrame(rows, "report_id string, site string, predicted_activity array<string>, predicted_hazards array<string>")
    df = cut_lineage(
        df.selectExpr("*", "DATE'2024-01-01' AS date", "1 AS sif_prediction", "0.5D AS sif_probability", "report_id AS description")
    )
    counted = p.mine_pairs(df, bounds=True)
    assert "SortAggregate" not in plan_of(counted).split("Subquery")[0]
    counted = cut_lineage(counted)
    assert any(r["_upto"] is not None for r in counted.collect())
    ends = spark.createDataFrame([("REP-9",), ("REP-10",), ("REP-",), ("REP-1",), ("REP-é12345678",)], "report_id string")
    ordered = [r["code"] for r in ends.select("report_id", p._order_code(ends).alias("code")).orderBy("report_id").collect()]
    assert ordered == sorted(ordered) and len(set(ordered)) == 5

    def examples(patterns):
        found = p.with_examples(patterns, df, fixed.PAIR_PATTERNS)
        return {r["pattern_id"]: r["example_report_ids"] for r in found.collect()}

    assert examples(counted) == examples(p.mine_pairs(df))


def test_texts_are_cleaned_after_rows_are_numbered(spark, monkeypatch):
    """The sort by id and its sample of ids read plain texts; cleaning before it was done twice."""
    from incident_signals.models.features import HashingEmbedder
    from incident_signals.sources import vectors

    seen, plain = [], vectors.numbered
    monkeypatch.setattr(vectors, "numbered", lambda df, *rest: seen.append(df) or plain(df, *rest))
    df = spark.createDataFrame([("b", "  Pump LEAK "), ("a", "Fire"), ("c", " ")], "report_id string, description string")
    rows = {r["report_id"]: r for r in vectors.build_vectors(df, HashingEmbedder()).collect()}
    assert {k: (r["vector_id"], r["description"], r["clean_description"]) for k, r in rows.items()} == {
        "a": (0, "Fire", "fire"), "b": (1, "Pump LEAK", "pump leak")}
    assert "clean" not in str(seen[0].columns) and "translate" not in plan_of(seen[0])


def test_emerging_patterns_share_the_count_of_patterns(spark, monkeypatch):
    """All combinations of all reports are counted once for the recurring and the emerging patterns."""
    from incident_signals.plans import analytics

    rows = [(i, f"s{i % 7}", ["a", "b"][: i % 2 + 1], [f"h{i % 3}"], f"2024-{i % 12 + 1:02d}-15") for i in range(400)]
    df = spark.createDataFrame(
        rows, "report_id long, site string, predicted_activity array<string>, predicted_hazards array<string>, date string"
    ).selectExpr("*", "1 AS sif_prediction", "0.5D AS sif_probability", "'text' AS description", "'here' AS location", "'x' AS report_type")
    df = df.withColumns({c: F.array(F.lit("one")) for c in fixed.LIST_COLUMNS if c not in df.columns})
    seen, plain = [], p.count_patterns
    counting = lambda *args, **options: seen.append(args) or plain(*args, **options)
    monkeypatch.setattr(p, "count_patterns", counting)
    monkeypatch.setattr(e, "count_patterns", counting)
    outputs = analytics.run_analytics(df)
    assert len(seen) == 1
    found = sorted(map(str, outputs["emerging_patterns"].collect()))
    assert found and found == sorted(map(str, e.detect_emerging(df).collect()))
    assert not {"current_count", "_upto"} & set(outputs["recurring_patterns"].columns)
