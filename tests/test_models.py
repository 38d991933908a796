"""Features, classifiers, split, semantic hazards, inference, refresh."""

import math

import pytest
from pyspark.sql import functions as F

from incident_signals import fixed_values as fixed
from incident_signals.models import features as ft
from incident_signals.models.classifiers import RuleClassifier, SifClassifier
from incident_signals.models.inference import enrich, predict_reports
from incident_signals.models.itemsets import frequent_itemsets
from incident_signals.models.semantic import add_semantic_hazards
from incident_signals.models.split import stratified_split
from incident_signals.operators import extraction as x
from incident_signals.session import new_path

TEXTS = [
    ("The pressurized line ruptured near the crane and the worker fell", 1, "Energy Isolation"),
    ("Suspended load dropped from the crane above the crew", 1, "Safe Mechanical Lifting"),
    ("Crane sling failed and load dropped on the deck", 1, "Safe Mechanical Lifting|Line of Fire"),
    ("Worker stood in the line of fire during pressure test", 1, "Line of Fire"),
    ("Small paint damage noticed on parked truck", 0, "Driving"),
    ("Truck driver wore seatbelt and drove slowly", 0, "Driving"),
    ("Office light was broken and replaced", 0, "None"),
    ("Housekeeping was poor in the office area", 0, "None"),
]


@pytest.fixture(scope="module")
def reports(spark):
    rows = [
        (f"R{i:03d}", "2024-%02d-15" % (i % 12 + 1), f"Site {i % 3}", f"Area {i % 2}", "Incident", text, label, tags)
        for i, (text, label, tags) in enumerate(TEXTS * 4)
    ]
    return spark.createDataFrame(
        rows,
        "report_id string, date string, site string, location string, report_type string, description string, "
        "sif_label int, lsr_tags string",
    )


@pytest.fixture(scope="module")
def trained(reports):
    from incident_signals.functions.lists import parse_rule_tags
    from incident_signals.functions.text import normalize_text

    clean = reports.withColumn("description_clean", normalize_text(F.col("description")))
    tfidf = ft.TfidfFeatures().fit(clean)
    data = tfidf.transform(clean.withColumn("labels", parse_rule_tags(F.col("lsr_tags"))))
    return tfidf, SifClassifier().fit(data, vocabulary=tfidf.vocabulary), RuleClassifier().fit(data, "labels"), data


def test_tfidf_matches_hand_computation(spark):
    df = spark.createDataFrame([(0, "pump leak"), (1, "pump pump fire"), (2, "leak fire a")], "id int, description_clean string")
    tfidf = ft.TfidfFeatures().fit(df, min_df=1, max_df=1.0)
    assert set(tfidf.vocabulary) == {"pump", "leak", "fire", "pump leak", "pump pump", "pump fire", "leak fire"}
    row = tfidf.transform(df).where("id = 0").first()["features"]
    idf = lambda n: math.log(4 / (1 + n)) + 1
    raw = {"pump": idf(2), "leak": idf(2), "pump leak": idf(1)}
    length = math.sqrt(sum(v * v for v in raw.values()))
    got = {tfidf.vocabulary[i]: v for i, v in zip(row.indices, row.values)}
    assert got == pytest.approx({k: v / length for k, v in raw.items()})


def test_unfitted_and_leaking_features_raise(spark):
    with pytest.raises(ValueError):
        ft.TfidfFeatures().transform(spark.range(1))
    with pytest.raises(ValueError):
        ft.assert_no_truth(["description", "severity"])
    assert ft.drop_truth(spark.createDataFrame([(1, 2)], "a int, severity int")).columns == ["a"]


def test_classifier_separates_and_survives_saving(spark, trained):
    tfidf, sif, rules, data = trained
    predicted = sif.predict(data)
    wrong = predicted.where("sif_prediction != sif_label").count()
    assert wrong == 0
    path = new_path(spark, "models")
    sif.threshold = 0.4
    sif.save(f"{path}/sif", spark)
    rules.save(f"{path}/rules", spark)
    tfidf.save(f"{path}/tfidf")
    again = SifClassifier.load(f"{path}/sif", spark)
    assert again.threshold == 0.4 and again.vocabulary == tfidf.vocabulary
    features = ft.TfidfFeatures.load(f"{path}/tfidf").transform(data.drop("features"))
    a = [r[0] for r in again.predict(features).orderBy("report_id").select("sif_probability").collect()]
    b = [r[0] for r in predicted.orderBy("report_id").select("sif_probability").collect()]
    assert a == pytest.approx(b, abs=1e-12)
    loaded = RuleClassifier.load(f"{path}/rules", spark)
    assert loaded.rules == fixed.LIFE_SAVING_RULES
    sif.threshold = 0.5


def test_balanced_logistic_optimum(spark, trained):
    """The gradient of C * weighted loss + |w|^2 / 2 vanishes at the fitted weights."""
    import numpy as np

    _, sif, _, data = trained
    rows = data.select("features", "sif_label").collect()
    x_ = np.array([r["features"].toArray() for r in rows])
    y = np.array([r["sif_label"] for r in rows])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    beta, b = sif.model.coefficients.toArray(), sif.model.intercept
    p = 1 / (1 + np.exp(-(x_ @ beta + b)))
    assert np.abs((w * (p - y)) @ x_ + beta).max() < 1e-3
    assert abs((w * (p - y)).sum()) < 1e-3


def test_explain_and_false_negatives(trained):
    tfidf, sif, _, data = trained
    top = sif.explain(data.where("report_id = 'R001'"), 3).orderBy("rank").collect()
    assert len(top) == 3 and abs(top[0]["contribution"]) >= abs(top[2]["contribution"])
    before, sif.threshold = sif.threshold, 0.99
    missed = sif.false_negatives(data).collect()
    sif.threshold = before
    assert len(missed) == 3 and all(r["terms"] for r in missed)


def test_rules_threshold_and_fallback(trained):
    _, _, rules, data = trained
    for row in rules.predict(data, threshold=0.01).collect():
        scores = [r["score"] for r in row["rules"]]
        assert scores == sorted(scores, reverse=True) and row["primary_rule"] == row["rules"][0]["rule"]
    assert all(len(r["rules"]) == 1 for r in rules.predict(data, threshold=1.1).collect())


def test_split_is_exact_per_class(spark):
    df = spark.range(4000).select(F.col("id").alias("report_id"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    out = stratified_split(df, "label", buckets=16)
    counts = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert counts == {(1, "train"): 700, (1, "validation"): 150, (1, "test"): 150,
                      (0, "train"): 2100, (0, "validation"): 450, (0, "test"): 450}
    assert out.select("report_id").distinct().count() == 4000


def test_model_embedder_batches_to_unit_vectors(spark):
    class Words:
        """Stand-in model: letters counted, enough to tell texts apart."""

        def encode(self, texts):
            import numpy as np

            return np.array([[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], dtype="float32")

    df = spark.createDataFrame([(i, f"text {'ab' * i} x") for i in range(150)], "id int, t string")
    out = ft.ModelEmbedder(Words, 64).embed(df, "t").collect()
    assert len(out) == 150 and all(abs(sum(v * v for v in r["embedding"]) - 1) < 1e-5 for r in out)


def test_semantic_fallback(spark):
    text = ("Heavy object being lifted or hoisted by a crane, placing personnel at risk of crushing. "
            "Not a problem with pressure trapped in a hose here at all.")
    df = x.extract(spark.createDataFrame([("a", text), ("b", "Nothing")], "report_id string, description string"))
    rows = {r["report_id"]: r for r in add_semantic_hazards(df, ft.HashingEmbedder()).collect()}
    found = {h["value"]: h for h in rows["a"]["hazards"]}
    assert found["Suspended load"]["match_method"] == "semantic" and found["Suspended load"]["confidence"] == "LOW"
    assert "Pressurized equipment" not in found
    assert "Crushing Injury" in [c["value"] for c in rows["a"]["potential_consequences"]]
    assert rows["a"]["precursor_tags"] == ["suspended-load"] and rows["b"]["hazards"] == []


def test_inference_keeps_every_report(spark, trained):
    tfidf, sif, rules, _ = trained
    df = spark.createDataFrame(
        [("1", "The worker stood under the suspended load."), ("2", "   "), ("3", None)], "report_id string, description string"
    )
    out = {r["report_id"]: r for r in predict_reports(df, tfidf, sif, rules).collect()}
    assert set(out) == {"1", "2", "3"}
    assert out["2"]["error"] == out["3"]["error"] == "Empty or whitespace-only description"
    assert out["2"]["sif_probability"] is None
    assert out["1"]["error"] is None and 0 <= out["1"]["sif_probability"] <= 1
    assert "Suspended Load" in [h["value"] for h in out["1"]["hazards"]]
    assert out["1"]["sif_label_text"] in ("SIF-Potential", "Non-SIF")


def test_enriched_columns(reports, trained):
    tfidf, sif, rules, _ = trained
    out = enrich(reports, tfidf, sif, rules)
    assert set(fixed.LIST_COLUMNS) | {"sif_prediction", "primary_lsr_predicted"} <= set(out.columns)
    assert out.count() == reports.count()


def test_itemsets_against_counting(spark):
    rows = [(["a", "b"], ["x"]), (["a"], ["x"]), (["a", "b"], []), (["b"], ["y"])]
    df = spark.createDataFrame(rows, "predicted_activity array<string>, predicted_hazards array<string>")
    found = {tuple(r["items"]): r["reports"] for r in frequent_itemsets(df, min_support=0.5).collect()}
    assert found == {("activity=a",): 3, ("activity=b",): 3, ("hazards=x",): 2, ("activity=a", "activity=b"): 2,
                     ("activity=a", "hazards=x"): 2}


def test_itemset_levels_and_rules_against_every_combination(spark):
    import itertools
    from collections import Counter

    from incident_signals.models.itemsets import association_rules

    rows = [([v for j, v in enumerate("abcdef") if (i * 7 + j * j) % (j + 3) < 2] or None, ["x"] if i % 3 else []) for i in range(200)]
    df = spark.createDataFrame(rows, "predicted_activity array<string>, predicted_hazards array<string>").repartition(3)
    held = [sorted([f"activity={v}" for v in a or []] + [f"hazards={v}" for v in h]) for a, h in rows]
    counts = Counter(s for items in held for k in range(1, 8) for s in itertools.combinations(items, k))
    wanted = {s: n for s, n in counts.items() if n >= 0.05 * len(rows)}
    assert max(map(len, wanted)) > 3
    found = frequent_itemsets(df, min_support=0.05).collect()
    assert len(found) == len(wanted) and {tuple(r["items"]): r["reports"] for r in found} == wanted
    rules = {(tuple(r["antecedent"]), r["consequent"][0]): r for r in association_rules(df, min_support=0.05).collect()}
    parts = {(tuple(x for x in s if x != c), c): n for s, n in wanted.items() if len(s) > 1 for c in s}
    assert set(rules) == {r for r, n in parts.items() if n / wanted[r[0]] >= 0.5}
    for (left, right), rule in rules.items():
        share = parts[left, right] / wanted[left]
        assert rule["confidence"] == pytest.approx(share) and rule["lift"] == pytest.approx(share / (wanted[right,] / len(rows)))
        assert rule["support"] == pytest.approx(parts[left, right] / len(rows))
    assert frequent_itemsets(df.limit(0)).collect() == []


def test_refresh_promotes_fails_and_restores(spark, reports, trained):
    from incident_signals.plans import refresh as rf

    tfidf, sif, rules, _ = trained
    root = new_path(spark, "refresh")
    received = reports.select("report_id", "date", "site", "location", "report_type", "description").union(
        spark.createDataFrame([("x", None, None, None, None, " ")], "a string, b string, c string, d string, e string, f string")
    )
    embedder = ft.HashingEmbedder(16)
    row = rf.refresh(received, root, tfidf, sif, rules, embedder, version="one").first()
    assert (row["records_received"], row["records_indexed"], row["records_skipped"]) == (33, 32, 1)
    assert row["records_processed"] == 32 and row["dimension"] == 16 and row["dataset_version"] == "one"
    assert rf.current_version(spark, root) == "one"
    with pytest.raises(Exception):
        rf.refresh(received.where("report_id = 'x'"), root, tfidf, sif, rules, embedder, version="two")
    assert rf.current_version(spark, root) == "one"
    rf.refresh(received, root, tfidf, sif, rules, embedder, version="three")
    assert rf.current_version(spark, root) == "three"
    rf.restore(spark, root, "one")
    assert rf.current_version(spark, root) == "one"
    vectors = spark.read.parquet(f"{rf.version_path(root, 'one')}/vectors")
    assert [r[0] for r in vectors.orderBy("report_id").select("vector_id").collect()] == list(range(32))
    patterns = spark.read.json(f"{rf.version_path(root, 'one')}/analytics/recurring_patterns")
    assert "priority_score" in patterns.columns


def test_two_refreshes_cannot_both_win(spark, reports, trained, monkeypatch):
    from incident_signals.plans import refresh as rf

    tfidf, sif, rules, _ = trained
    received = reports.select("report_id", "date", "site", "location", "report_type", "description")
    root, embedder = new_path(spark, "race"), ft.HashingEmbedder(16)
    verify = rf._verify

    def other_wins_meanwhile(*args):
        verify(*args)
        monkeypatch.setattr(rf, "_verify", verify)
        rf._append(spark, root, "quicker", "somewhere", "good", base=0)

    monkeypatch.setattr(rf, "_verify", other_wins_meanwhile)
    with pytest.raises(rf.LostRefresh):
        rf.refresh(received, root, tfidf, sif, rules, embedder, version="slower")
    assert rf.current_version(spark, root) == "quicker"
    rows = {(r.number, r.version, r.status) for r in rf.manifest(spark, root).collect()}
    assert rows == {(1, "quicker", "good"), (2, "slower", "failed")}
    assert not rf._created(spark, f"{root}/manifest/{1:012d}.json", "again")
    rf.refresh(received, root, tfidf, sif, rules, embedder, version="next")
    assert rf.current_version(spark, root) == "next"


def test_exported_models_score_alike(spark, trained):
    from incident_signals.models.tables import LinearTables

    tfidf, sif, rules, data = trained
    tables = LinearTables.exported(spark, tfidf, {"risk": sif.model})
    own = {r.report_id: r.sif_probability for r in sif.predict(data).collect()}
    got = {r.report_id: r.score for r in tables.scores(data).collect()}
    assert got == pytest.approx(own, abs=1e-9)
    assert tables.gradient(data, "sif_label", "risk").agg(F.max(F.abs("slope"))).first()[0] < 1e-4
    path = new_path(spark, "tables")
    tables.save(path, spark)
    again = LinearTables.load(path, spark).explain(data, "risk", 2)
    want = {(r.report_id, r["rank"]): r.contribution for r in sif.explain(data, 2).collect()}
    assert {(r.report_id, r["rank"]): abs(r.contribution) for r in again.collect()} == pytest.approx({k: abs(v) for k, v in want.items()})
    all_rules = LinearTables.exported(spark, tfidf, dict(zip(rules.rules, rules.models)))
    chosen = {r.report_id: (r.primary_rule, len(r.rules)) for r in all_rules.rules(data).collect()}
    assert chosen == {r.report_id: (r.primary_rule, len(r.rules)) for r in rules.predict(data).collect()}
    rules.save(f"{path}/rules", spark)
    loaded = RuleClassifier.load(f"{path}/rules", spark)
    assert {r.report_id: r.primary_rule for r in loaded.predict(data).collect()} == {k: v[0] for k, v in chosen.items()}


def test_a_class_is_not_one_partition(spark):
    """Most reports are of one class; its texts must not end in one task."""
    out = stratified_split(spark.range(20_000).select(F.col("id").alias("report_id"), (F.col("id") % 50 == 0).alias("label")), "label")
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) < 15_000, sizes


def test_semantic_hazards_are_worked_out_once(spark):
    """A generator over the hazards brings a filter on them, which must not copy what makes them."""
    df = x.extract(spark.createDataFrame([(1, "the load hung over the crew")], "report_id int, description string"))
    rows = add_semantic_hazards(df, ft.HashingEmbedder()).select("report_id", F.inline("hazards"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("while ") == 1 and plan.count("arrays_zip(") == 1


def test_steps_of_a_fit_are_few_tasks(spark, trained, monkeypatch):
    """A step costs as many tasks as the rows ask for, not as many as there are partitions of vectors."""
    from incident_signals.models import classifiers

    *_, data = trained
    seen = []
    plain = classifiers.fit_logistic
    monkeypatch.setattr(classifiers, "fit_logistic", lambda df, *rest: seen.append(df.rdd.getNumPartitions()) or plain(df, *rest))
    scattered = data.repartition(40)
    classifiers.SifClassifier().fit(scattered)
    classifiers.RuleClassifier(fixed.LIFE_SAVING_RULES[:2]).fit(scattered, "labels")
    assert len(seen) == 3 and max(seen) <= classifiers.LEAST_TASKS


def test_features_of_every_term_from_texts_cleaned_once(spark, sf_dir, monkeypatch):
    """Passes read cleaned texts at rest, no term is cut off, and what is stored of a vector is read as it is."""
    from incident_signals.catalog import model_queries

    seen, plain = [], ft.TfidfFeatures.fit
    monkeypatch.setattr(ft.TfidfFeatures, "fit", lambda self, df, **options: seen.append((df, options)) or plain(self, df, **options))
    found = model_queries.tfidf_features(spark, sf_dir)
    (df, options), = seen
    assert "documents" not in df._jdf.queryExecution().toString()
    assert options["max_features"] >= 1 << 30
    assert "vector_to_array" not in model_queries.tfidf_features.__code__.co_names
    assert found.count() == model_queries.training_reports(spark, sf_dir).count()


def test_saved_models_read_texts_cleaned_once():
    """Both models score the same cleaned texts at rest."""
    from incident_signals.catalog import source_queries

    names = source_queries.saved_models.__code__.co_names
    assert "cleaned_reports" in names and "training_reports" not in names
