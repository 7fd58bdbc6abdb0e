import json

import pytest
from pyspark.sql import functions as F

from piiloom.operators import lifecycle, quality


def test_audit_rows_and_task_events(spark, tmp_path):
    docs = spark.createDataFrame([("1",)], "doc_id string")
    at = F.expr("timestamp_ntz '2024-01-01 00:00:00'")
    plain = lifecycle.audit_rows(docs, "UPLOAD", ts=at)
    row = plain.collect()[0]
    assert (row.actor, row.details, row.ip_address) == ("anonymous", {}, None)
    failed = lifecycle.task_events(
        docs, "task_failure", "detect", at, F.lit("boom"),
        F.create_map(F.lit("task_name"), F.lit("other"), F.lit("x"), F.lit("1"))).collect()[0]
    assert (failed.action, failed.actor) == ("PROCESS", "system")
    assert failed.details == {"event": "task_failure", "task_name": "other", "error": "boom", "x": "1"}
    for _ in range(2):
        lifecycle.write_audit(plain, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_current_status_takes_the_latest(spark):
    df = spark.createDataFrame([("1", "PENDING", 1, 1), ("1", "COMPLETED", 5, 2), ("1", "REDACTING", 5, 1),
                                ("2", "FAILED", 1, 9)], "doc_id string, status string, ts int, seq int")
    got = {r.doc_id: (r.status, r.updated_at, r.changes)
           for r in lifecycle.current_status(df).collect()}
    assert got == {"1": ("COMPLETED", 5, 3), "2": ("FAILED", 1, 1)}


def test_failure_keeps_other_details(spark):
    jobs = spark.createDataFrame([("1", "EXTRACTING", {"a": "1", "error": "old"}), ("2", "PENDING", None)],
                                 "doc_id string, status string, details map<string,string>")
    marked = lifecycle.mark_failed(jobs, F.lit("new"), F.col("doc_id") == "1")
    rows = {r.doc_id: r for r in marked.collect()}
    assert rows["1"].details == {"a": "1", "error": "new"} and rows["1"].status == "FAILED"
    assert rows["2"].details is None and rows["2"].status == "PENDING"
    assert [(r.doc_id, r.error, r.n_details) for r in lifecycle.failed_docs(marked).collect()] == [
        ("1", "new", 2)]


def test_cascade_and_orphans(spark):
    children = spark.createDataFrame([("1", 1), ("1", 2), ("2", 3), ("9", 4)], "doc_id string, x int")
    gone = spark.createDataFrame([("1",), ("1",)], "doc_id string")
    assert sorted(r.x for r in lifecycle.cascade_delete(children, gone).collect()) == [3, 4]
    jobs = spark.createDataFrame([("1",), ("2",)], "doc_id string")
    assert [r.x for r in quality.orphan_rows(children, jobs).collect()] == [4]


def test_violations_let_nulls_pass(spark):
    jobs = spark.createDataFrame([(None,), (0.0,), (100.0,), (100.1,), (-1.0,)], "risk_score double")
    ents = spark.createDataFrame([(0.5, 0, 1), (1.1, -1, 5), (None, 5, 5), (0.1, 7, 3)],
                                 "confidence double, start_offset int, end_offset int")
    reports = spark.createDataFrame([(1.0, 0.0, -1), (101.0, 0.0, None)],
                                    "risk_score_before double, risk_score_after double,"
                                    "total_entities_redacted int")
    got = {(r.table_name, r.rule): r.violations
           for r in quality.constraint_violations(jobs, ents, reports).collect()}
    assert got == {("document_jobs", "risk_score_range"): 2,
                   ("pii_entities", "confidence_range"): 1,
                   ("pii_entities", "start_offset_positive"): 1,
                   ("pii_entities", "end_after_start"): 2,
                   ("redaction_reports", "risk_score_before_range"): 1,
                   ("redaction_reports", "risk_score_after_range"): 0,
                   ("redaction_reports", "total_entities_positive"): 1}


def test_span_validity(spark):
    df = spark.createDataFrame([(0, 5, 0.5, 5), (0, 6, 0.5, 5), (3, 3, 0.5, 9), (0, 1, None, 9)],
                               "start_offset int, end_offset int, confidence double, char_count int")
    assert [r.valid for r in quality.span_validity(df).collect()] == [True, False, False, False]


def test_repeated_hashes(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "file_hash string")
    assert [(r.file_hash, r.n) for r in quality.repeated_hashes(df).collect()] == [("a", 2)]


GOOD = {
    "document_id": "550e8400-e29b-41d4-a716-446655440000", "filename": "a \"b\".pdf",
    "redaction_level": "FULL", "timestamp": "2024-01-15T10:40:00",
    "pii_instances": [{"entity_type": "PAN", "original_value": "x", "redacted_value": "[REDACTED]",
                       "start_offset": 1, "end_offset": 11, "confidence": 0.85}],
    "total_entities_redacted": 4, "risk_score_before": 88.5, "risk_score_after": 0.0}


@pytest.mark.parametrize("change,reason", [
    ({}, None), ({"pii_instances": []}, None), ({"extra": 1}, None),
    ({"filename": None}, "missing field"), ({"redaction_level": "NONE"}, "out of range"),
    ({"risk_score_after": 100.5}, "out of range"), ({"risk_score_before": -0.1}, "out of range"),
    ({"total_entities_redacted": -1}, "out of range"), ({"timestamp": "soon"}, "out of range"),
    ({"risk_score_after": "low"}, "malformed"), ({"pii_instances": "none"}, "malformed"),
    ({"pii_instances": [{"entity_type": "PAN"}]}, "missing field")])
def test_metadata(spark, change, reason):
    text = json.dumps({k: v for k, v in (GOOD | change).items() if v is not None})
    row = quality.parse_metadata(spark.createDataFrame([(text,)], "json string")).collect()[0]
    assert row.reject_reason == reason and row.ok == (reason is None)


def test_broken_json(spark):
    df = spark.createDataFrame([("{",), ("",), (None,), ("[1]",), ("not json",)], "json string")
    assert {r.reject_reason for r in quality.parse_metadata(df).collect()} <= {
        "malformed", "missing field"}


def test_canonical_form_and_round_trip(spark):
    parsed = quality.parse_metadata(spark.createDataFrame([(json.dumps(GOOD),)], "json string"))
    text = parsed.select(quality.canonical_json(F.col("metadata")).alias("j")).collect()[0].j
    assert text == json.dumps(GOOD, sort_keys=True, separators=(",", ":"))
    row = quality.json_round_trip(parsed).collect()[0]
    assert (row.records, row.mismatches) == (1, 0)


def test_text_fields_that_hold_something_else_are_named(spark):
    good = {"document_id": "d", "filename": "f", "redaction_level": "FULL", "timestamp": "2024-01-01T00:00:00",
            "pii_instances": [{"entity_type": "PAN", "original_value": None, "redacted_value": "x", "start_offset": 0,
                               "end_offset": 1, "confidence": 0.5}],
            "total_entities_redacted": 1, "risk_score_before": 1.0, "risk_score_after": 0.0}
    inner = {**good["pii_instances"][0], "redacted_value": {"a": 1}, "entity_type": 7}
    cases = [(good, []), ({**good, "filename": 5}, ["filename"]), ({**good, "timestamp": True, "document_id": []},
             ["document_id", "timestamp"]), ({**good, "pii_instances": [good["pii_instances"][0], inner]},
             ["pii_instances.entity_type", "pii_instances.redacted_value"])]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(9, "{"), (10, None)],
                               "i int, json string")
    rows = {r.i: r for r in quality.parse_metadata(df).collect()}
    for i, (_, names) in enumerate(cases):
        assert rows[i].ill_typed == names and rows[i].ok == (not names)
        assert rows[i].reject_reason == ("malformed" if names else None)
    assert rows[9].reject_reason == rows[10].reject_reason == "malformed" and rows[9].ill_typed == []
