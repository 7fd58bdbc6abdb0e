import pytest
from pyspark.sql import functions as F

from piiloom.operators import risk

# (entities as (type, confidence), score, band)
GOLDENS = [
    ([], 0.0, "LOW"),
    ([("PHONE", 0.75)], 3.75, "LOW"),
    ([("EMAIL", 1.0)], 5.0, "MEDIUM"),
    ([("PERSON", 0.85)] * 3, 5.1, "MEDIUM"),
    ([("FOO", 0.9)], 0.9, "LOW"),
    ([("EMAIL", 1.0)] * 2 + [("PHONE", 0.75)], 15.177256, "HIGH"),
    ([("PAN", 0.6)], 15.0, "HIGH"),
    ([("PAN", 0.85)], 17.0, "HIGH"),
    ([("PAN", 0.85), ("EMAIL", 1.0)], 28.6, "HIGH"),
    ([("AADHAAR", 0.6)], 30.0, "CRITICAL"),
    ([("AADHAAR", 0.85)], 31.875, "CRITICAL"),
    ([("AADHAAR", 0.85)] * 3, 63.75, "CRITICAL"),
    ([("AADHAAR", 0.85), ("PAN", 0.85)], 86.5875, "CRITICAL"),
]


@pytest.fixture(scope="module")
def golden_docs(spanned):
    return spanned(*[("z" * 100, [(t, 10 * i, 10 * i + 5, c) for i, (t, c) in enumerate(spans)])
                     for spans, _, _ in GOLDENS])


def test_goldens_row_local(golden_docs):
    rows = {int(r.doc_id): r for r in risk.score_documents(golden_docs).collect()}
    for i, (_, score, band) in enumerate(GOLDENS):
        assert rows[i].risk_score == pytest.approx(score, abs=1e-5)
        assert rows[i].risk_band == band


def test_goldens_from_entity_table(golden_docs):
    entities = golden_docs.select("doc_id", F.inline("spans"))
    rows = {int(r.doc_id): r for r in risk.risk_from_entities(entities, golden_docs).collect()}
    for i, (_, score, band) in enumerate(GOLDENS):
        assert rows[i].risk_score == pytest.approx(score, abs=1e-5)
        assert rows[i].risk_band == band
    alone = risk.risk_from_entities(entities)
    assert alone.count() == sum(1 for spans, _, _ in GOLDENS if spans)


def test_all_three_ids_collect_every_combination(spark):
    by_type = spark.createDataFrame(
        [("1", t, 1, 0.1, 1.0) for t in ("AADHAAR", "PAN", "DRIVING_LICENSE")],
        "doc_id string, entity_type string, n long, mean_confidence double, type_score double")
    row = risk.risk_combinations(risk.risk_critical_boost(
        risk.risk_diversity(risk.risk_base(by_type)))).collect()[0]
    assert row.combination_points == 40.0
    assert row.score == pytest.approx(3 * 1.6 * 1.5 + 40)


def test_more_entities_score_higher_and_cap_at_100(spanned):
    docs = spanned(*[("a" * 400, [("AADHAAR", 13 * i, 13 * i + 12, 0.95) for i in range(n)])
                     for n in (1, 3, 9, 30)])
    scores = [r.risk_score for r in risk.score_documents(docs).orderBy("doc_id").collect()]
    assert scores == sorted(scores) and scores[-1] == 100.0


def test_callers_weights_and_combinations(spanned):
    docs = spanned(("a" * 40, [("FOO", 0, 5, 1.0), ("BAR", 6, 9, 1.0)]))
    row = risk.score_documents(docs, {"FOO": 7.0}, ((("FOO", "BAR"), 11.0),)).collect()[0]
    assert row.risk_score == pytest.approx((7 + 1) * 1.3 + 11)


def test_explanation(spanned):
    docs = spanned(
        ("a" * 60, []),
        ("a" * 60, [("PHONE", 0, 5), ("EMAIL", 6, 9), ("EMAIL", 10, 12), ("PAN", 20, 30)]),
        ("a" * 60, [("FOO", 0, 5)]))
    explained = risk.risk_explain(risk.score_documents(docs))
    rows = {r.doc_id: r for r in explained.collect()}
    assert rows["0"].summary == "No PII detected." and rows["0"].diversity_note is None
    assert rows["1"].summary == ("Score driven primarily by PAN (Very High sensitivity)"
                                 " combined with 2 other type(s)")
    assert rows["1"].diversity_note == ("3 different PII types detected — diversity multiplier"
                                        " ×1.6 applied")
    assert rows["2"].summary == "Score driven primarily by FOO (Low sensitivity)"
    order = [(r.entity_type, r.n, r.sensitivity) for r in
             risk.contributor_rows(explained).filter("doc_id = '1'").orderBy("position").collect()]
    assert order == [("PAN", 1, "Very High"), ("PHONE", 1, "Medium"), ("EMAIL", 2, "Medium")]


def test_gate_is_inclusive(spark):
    df = spark.createDataFrame([("1", 50.9), ("2", 51.0)], "doc_id string, risk_score double")
    assert [r.doc_id for r in risk.high_risk(df).collect()] == ["2"]
