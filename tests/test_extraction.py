"""Extraction on contrast sentences: presence, negation, guards, equipment and derived entities."""

import pytest
from pyspark.sql import functions as F

from incident_signals.operators import extraction as x

# (sentence, column, expected present, expected absent)
CASES = [
    ("At shift start the header was not depressurized.", "hazards", ["Pressurized equipment"], []),
    ("The spool was not pressurized when bolts came off.", "hazards", [], ["Pressurized equipment"]),
    ("Morning readings showed no h2s detected inside the drum.", "hazards", [], ["H2S exposure"]),
    ("Morning readings showed h2s detected inside the drum.", "hazards", ["H2S exposure"], []),
    ("The banksman saw no suspended load above the path.", "hazards", [], ["Suspended load"]),
    ("Two riggers stood under a suspended load.", "hazards", ["Suspended load"], []),
    ("Two riggers stood under a suspended load.", "unsafe_actions", ["Entering danger zone"], []),
    ("By noon the gasket kept weeping into a tray.", "hazards", ["Loss of containment"], []),
    ("All hands kept out of the line of fire.", "hazards", [], ["Fire/explosion", "Line-of-fire exposure"]),
    ("His arm reached into the line of fire.", "hazards", ["Line-of-fire exposure"], ["Fire/explosion"]),
    (
        "At full load the jack's hose snapped. The crew kept out of the line of fire and nobody got hurt.",
        "hazards",
        ["Pressurized equipment", "Loss of containment"],
        ["Fire/explosion", "Line-of-fire exposure"],
    ),
    ("Gauge showed the drum was pressurized.", "hazards", ["Pressurized equipment"], []),
    ("Everyone kept away from the suspended load.", "hazards", [], ["Line-of-fire exposure"]),
    ("Some hydrocarbon leaked at the sample point.", "hazards", ["Hydrocarbon release"], []),
    ("No hydrocarbon leaked at the sample point.", "hazards", [], ["Hydrocarbon release"]),
    ("An electrician found the line remained live at noon.", "hazards", ["Stored energy"], []),
    ("Zero energy proven before the job began.", "hazards", [], ["Stored energy"]),
    ("No H2S detected by the cellar.", "hazards", [], ["H2S exposure"]),
    ("H2S detected by the cellar.", "hazards", ["H2S exposure"], []),
    ("No reading was taken. Hours later a fire broke out, no one hurt.", "hazards", ["Fire/explosion"], []),
    ("no fire at dawn, but a fire broke out at dusk", "hazards", ["Fire/explosion"], []),
    ("Fitters opened Pump P-204 for repair.", "equipment", ["Pump P-204"], ["Pump"]),
    ("Entry went on without a valid gas permit.", "barrier_failures", ["WORK_AUTHORIZATION_FAILURE"], []),
    ("Behind the door hung an exposed and old electrical box", "unsafe_conditions", ["Exposed electrical conductor"], []),
]


@pytest.fixture(scope="module")
def extracted(spark):
    rows = [(i, case[0]) for i, case in enumerate(CASES)]
    df = x.extract(spark.createDataFrame(rows, "report_id int, description string"))
    return {r["report_id"]: r for r in df.collect()}


@pytest.mark.parametrize("index", range(len(CASES)))
def test_contrast(extracted, index):
    _, column, present, absent = CASES[index]
    values = [item["value"] for item in extracted[index][column]]
    assert all(v in values for v in present), values
    assert not any(v in values for v in absent), values


def test_confidence_evidence_and_order(spark):
    text = "Repair and MAINTENANCE near a crane; H2S Detected; fall injury"
    row = x.extract(spark.createDataFrame([(1, text)], "report_id int, description string")).first()
    activities = [(i["value"], i["evidence"], i["confidence"]) for i in row["activities"]]
    assert activities == [("Maintenance", "MAINTENANCE", "HIGH"), ("Crane Operation", "crane", "MEDIUM")]
    h2s = [(i["evidence"], i["confidence"]) for i in row["hazards"]]
    assert h2s == [("H2S Detected", "HIGH")]
    consequences = {i["value"]: (i["confidence"], i["match_method"]) for i in row["potential_consequences"]}
    assert consequences == {
        "Fall Injury": ("HIGH", "regex"),
        "Toxic Exposure": ("MEDIUM", "synonym"),
        "Loss of Consciousness": ("MEDIUM", "synonym"),
        "Fatal Exposure": ("MEDIUM", "synonym"),
    }


def test_equipment_keeps_longest_mentions(spark):
    text = "Pump P-204 and the pressure hose; the hose and a valve V-9 near Mcc Panel"
    row = x.extract(spark.createDataFrame([(1, text)], "report_id int, description string")).first()
    found = {i["value"]: i["type"] for i in row["equipment"]}
    assert found["Pump P-204"] == "Pump"
    assert found["Pressure Hose"] == "Hose"
    assert "Hose" not in found and "Pump" not in found
    assert any(kind == "Electrical Panel" for kind in found.values())


def test_tags(spark):
    text = "Residual pressure remained on the pressurized line. LOTO was not applied. Attendant absent."
    row = x.extract(spark.createDataFrame([(1, text)], "report_id int, description string")).first()
    assert row["precursor_tags"] == ["communication-failure", "missing-loto", "pressurized-system", "stored-energy"]


def test_missing_text_yields_nothing(spark):
    row = x.extract(spark.createDataFrame([(1, None)], "report_id int, description string")).first()
    assert all(row[c] == [] for c in x.ENTITY_COLUMNS) and row["precursor_tags"] == []


def test_needles_occur_in_their_rules():
    rules = x.ACTIVITY_RULES + x.ACTION_RULES + x.CONDITION_RULES + x.BARRIER_RULES + x.CONSEQUENCE_RULES
    assert all(len(rule.needle) >= 4 for rule in rules), [r for r in rules if len(r.needle) < 4]
    assert x.Rule("v", r"enter(?:ing|ed)?.*vessel").needle == "vessel"
    assert x.Rule("v", r"hot\s*work").needle == "work"
    assert x.Rule("v", "colou?r shade").needle == "r shade"


def test_no_shuffle_in_extraction(spark):
    df = x.extract(spark.createDataFrame([(1, "a")], "report_id int, description string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_rule_match_agrees_with_plain_search(spark):
    """Every rule set against a direct search over sentences built from its own phrases."""
    import re

    sentences = [f"At night {r.pattern} happened." for r in x.BARRIER_RULES if re.fullmatch(r"[a-z' -]+", r.pattern)]
    df = spark.createDataFrame(list(enumerate(sentences)), "report_id int, description string")
    got = {
        r["report_id"]: {i["value"]: i["evidence"] for i in r["found"]}
        for r in x.match_rules(df, "description", x.BARRIER_RULES, "found").select("report_id", "found").collect()
    }
    for i, sentence in enumerate(sentences):
        expected = {}
        for rule in x.BARRIER_RULES:
            hit = re.search(rule.pattern, sentence.lower())
            if hit and rule.value not in expected:
                expected[rule.value] = sentence[hit.start():hit.end()]
        assert got[i] == expected, sentence


def test_long_entities(spark):
    df = x.extract(spark.createDataFrame([(1, "Repair of the crane")], "report_id int, description string"))
    rows = x.long_entities(df).where(F.col("category") == "activities").collect()
    assert {r["value"] for r in rows} == {"Maintenance", "Crane Operation"}


def test_filters_on_other_columns_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "en", "a")], "report_id long, site string, description string").write.parquet(f"{tmp_path}/r")
    reports = spark.read.parquet(f"{tmp_path}/r")
    for found in (x.extract(reports), x.match_rules(reports, "description", x.ACTIVITY_RULES, "activities")):
        plan = found.where("site = 'en' AND size(activities) > 0")._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(site,en)" in plan


def test_only_patterns_whose_literal_is_there_are_tried(spark):
    """One search with the pattern of a place, not one per rule; literal rules are not searched again at all."""
    plan = x.extract(spark.createDataFrame([(1, "a")], "report_id int, description string"))._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("regexp_extract(") < 5


def test_whole_words_at_letters_of_every_plane(spark):
    """A letter beyond the first plane is a letter; upper case is that of ASCII."""
    texts = ["\U0001d400crane operation", "a crane operation", "bécrane operation", "crane operation2", "broKen barricade",
             "Brokeshaft BROKEN barricade"]
    rules = [x.Rule("crane", "crane operation", x.MEDIUM, True), x.Rule("broken", "broken barricade")]
    df = spark.createDataFrame(list(enumerate(texts)), "report_id int, description string")
    found = x.match_rules(df, "description", rules, "found").orderBy("report_id").collect()
    assert [[i["evidence"] for i in r["found"]] for r in found] == [[], ["crane operation"], [], [], [], ["BROKEN barricade"]]


def test_equipment_beyond_ascii(spark):
    texts = ["Pump P-204 by the crane, Crane", "é Pump P-204 by the crane, Crane", "aépump and T-1  valve K"]
    df = spark.createDataFrame(list(enumerate(texts)), "report_id int, description string")
    rows = x.extract(df, only=["equipment"]).orderBy("report_id").collect()
    assert [[i["evidence"] for i in r["equipment"]] for r in rows] == [["Pump P-204", "the crane"], ["Pump P-204", "the crane"], ["T-1  valve"]]
