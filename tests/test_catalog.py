import pytest
from pyspark.sql import functions as F

from piiloom.operators import catalog

JOBS = [
    # doc, status, score, band, minutes
    ("a", "COMPLETED", 80.0, "CRITICAL", 1), ("b", "PII_DETECTED", 80.0, "CRITICAL", 2),
    ("c", "FAILED", None, None, 3), ("d", "PENDING", None, "CRITICAL", 4),
    ("e", "REDACTING", 10.0, "MEDIUM", 9000), ("f", "COMPLETED", 20.0, "HIGH", 20000)]
ENTITIES = [("a", "AADHAAR", 10, 20, 0.95), ("a", "PAN", 0, 5, 0.8512), ("a", "PAN", 30, 35, 0.6),
            ("b", "EMAIL", 3, 9, 1.0), ("e", "AADHAAR", 0, 3, 0.9)]


@pytest.fixture(scope="module")
def tables(spark):
    jobs = spark.createDataFrame(
        [(d, f"{d}.pdf", s, r, b, f"svc.{d}", None, None, m) for d, s, r, b, m in JOBS],
        "doc_id string, filename string, status string, risk_score double, risk_band string,"
        "entity_fqn string, redacted_fqn string, error string, m int"
    ).withColumn("created_at", F.expr(
        "timestampadd(MINUTE, m, timestamp_ntz '2024-01-01 00:00:00')")
    ).withColumn("updated_at", F.col("created_at")).drop("m")
    entities = spark.createDataFrame(
        [(d, t, None, s, e, c) for d, t, s, e, c in ENTITIES],
        "doc_id string, entity_type string, subtype string, start_offset int, end_offset int,"
        "confidence double")
    return jobs, entities


def test_status_keeps_documents_without_entities(tables):
    rows = catalog.document_status(*tables).collect()
    assert len(rows) == len(ENTITIES) + 3
    assert {(r.entity_type, r.n) for r in rows if r.doc_id == "a"} == {("AADHAAR", 1), ("PAN", 2)}
    assert [r.entity_type for r in rows if r.doc_id == "c"] == [None]
    assert len(catalog.document_status(*tables, doc_id="b").collect()) == 1


def test_breakdown_and_lookup(tables):
    rows = {r.entity_type: r for r in catalog.risk_breakdown(tables[1], "a").collect()}
    assert (rows["PAN"].n, rows["PAN"].avg_confidence, rows["PAN"].total_entities) == (2, 0.726, 3)
    looked = catalog.risk_lookup(*tables).collect()
    assert [(r.entity_type, r.n) for r in looked if r.doc_id == "a"] == [("PAN", 2), ("AADHAAR", 1)]
    assert [r.risk_score for r in looked if r.doc_id == "c"] == [0.0]


def test_entities_in_order(tables):
    rows = catalog.list_entities(tables[1], "a").collect()
    assert [r.start_offset for r in rows] == [0, 10, 30] and rows[0].confidence == 0.851


def test_band_top_k_puts_null_scores_first(tables):
    rows = catalog.docs_by_band(tables[0], "CRITICAL").collect()
    assert [(r.doc_id, r.risk_score) for r in rows] == [("d", 0.0), ("b", 80.0), ("a", 80.0)]
    assert [r.doc_id for r in catalog.docs_by_band(tables[0], "CRITICAL", 1).collect()] == ["d"]
    with pytest.raises(ValueError):
        catalog.docs_by_band(tables[0], "CRITICAL", 101)
    assert catalog.docs_by_band(tables[0], "CRITICAL", 500, max_limit=None).count() == len(rows)


def test_filters(tables):
    jobs, entities = tables
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(catalog.docs_with_type(jobs, entities, "AADHAAR")) == ["a", "e"]
    assert ids(catalog.docs_with_type(jobs, entities, "AADHAAR", "CRITICAL")) == ["a"]
    now = F.expr("timestamp_ntz '2024-01-08 06:00:00'")
    assert ids(catalog.recent_docs(jobs, "MEDIUM", now)) == ["e"]
    assert ids(catalog.recent_docs(jobs, "CRITICAL", now)) == []
    assert ids(catalog.redactable_docs(jobs)) == ["a", "b", "f"]
    assert ids(catalog.scored_docs(jobs)) == ["a", "b", "e", "f"]
    assert ids(catalog.pending_docs(jobs)) == ["b", "d", "e"]
    assert ids(catalog.sample_docs(jobs, 2)) == ["a", "b"]
    assert {r.risk_band: r.n for r in catalog.band_distribution(jobs).collect()} == {
        "CRITICAL": 3, None: 1, "MEDIUM": 1, "HIGH": 1}


def test_shares_types_and_steps(tables):
    jobs, entities = tables
    shares = {(r.doc_id, r.entity_type): r.share
              for r in catalog.type_share_of_max(entities).collect()}
    assert shares[("a", "AADHAAR")] == 50.0 and shares[("a", "PAN")] == 100.0
    assert {r.doc_id: r.types for r in catalog.distinct_types(entities).collect()}["a"] == [
        "AADHAAR", "PAN"]
    assert {r.doc_id: r.step for r in catalog.progress_step(jobs).collect()} == {
        "a": 5, "b": 2, "c": -1, "d": 0, "e": 3, "f": 5}


def test_audit_trail_in_time_order(spark):
    df = spark.createDataFrame([(2, "x", 5), (1, "x", 5), (3, "x", 1), (4, "w", 9)],
                               "event_id int, doc_id string, ts int")
    assert [r.event_id for r in catalog.audit_trail(df).collect()] == [4, 3, 1, 2]
    assert [r.event_id for r in catalog.audit_trail(df, "x").collect()] == [3, 1, 2]


def reference_segments(text, spans):
    if not spans:
        return [(None, text)]
    out, cursor = [], 0
    for kind, start, end in sorted(spans, key=lambda s: s[1]):
        if start > cursor:
            out.append((None, text[cursor:start]))
        out.append((kind, text[start:end]))
        cursor = end
    if cursor < len(text):
        out.append((None, text[cursor:]))
    return out


def test_segments(spanned):
    docs = [("", []), ("plain", []), ("ab cd ef", [("X", 0, 2), ("Y", 3, 5)]),
            ("ab cd", [("X", 3, 5)]), ("0123456789", [("X", 0, 8), ("Y", 4, 6)]), ("é😀z", [("X", 1, 2)])]
    rows = catalog.text_segments(spanned(*docs)).orderBy("doc_id", "segment_no").collect()
    for i, (text, spans) in enumerate(docs):
        got = [(r.entity_type, r.segment) for r in rows if r.doc_id == str(i)]
        assert got == reference_segments(text, spans)
