import json
import os

import pytest
from pyspark.sql import functions as F

from piiloom.operators import lifecycle
from piiloom.plans import pipeline
from piiloom.sources import documents, versions

ROW = "doc_id string, value string"


def visible(spark, path):
    found = versions.read(spark, path, "t")
    return None if found is None else sorted((r.doc_id, r.value) for r in found.collect())


def put(spark, path, run, rows, keys=None):
    df = spark.createDataFrame(rows, ROW)
    ids = df.select("doc_id") if keys is None else spark.createDataFrame([(k,) for k in keys], "doc_id string")
    return versions.commit(path, run, {"t": df}, ids)


def test_runs_add_and_replace(spark, tmp_path):
    path = str(tmp_path / "table")
    assert visible(spark, path) is None
    assert put(spark, path, "one", [("a", "1"), ("a", "2"), ("b", "3")])
    assert put(spark, path, "two", [("c", "4")])
    # pure additions need no join
    plan = versions.read(spark, path, "t")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert put(spark, path, "three", [("a", "5")], ["a", "c", None])  # c has no rows any more
    want = [("a", "5"), ("b", "3")]
    assert visible(spark, path) == want
    assert not put(spark, path, "three", [("b", "lost")]) and visible(spark, path) == want
    versions.compact(spark, path, ["t"])
    assert visible(spark, path) == want and len(versions.entries(spark, path)) == 1
    assert put(spark, path, "four", [("b", "6")]) and visible(spark, path) == [("a", "5"), ("b", "6")]
    assert not put(spark, path, "one", [("z", "late")])  # names stay known after compaction


def test_a_run_writes_only_what_it_carries(spark, tmp_path):
    path = str(tmp_path / "table")
    put(spark, path, "one", [(str(i), "x" * 100) for i in range(2000)])

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names}

    before = files()
    put(spark, path, "two", [("7", "y")])
    after = files()
    assert all(after[f] == t for f, t in before.items())
    new = [f for f in after if f not in before and f.endswith(".parquet")]
    assert sum(os.path.getsize(f) for f in new) < 4000


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", range(4))
def test_a_crash_at_any_step_loses_nothing(spark, tmp_path, monkeypatch, step):
    """Writers fail at their n-th write; readers see the version before, and the run can be repeated."""
    from pyspark.sql.readwriter import DataFrameWriter

    path = str(tmp_path / "table")
    put(spark, path, "one", [("a", "1"), ("b", "2")])
    done = []

    def failing(method):
        def call(self, *a, **b):
            if len(done) == step:
                raise Crash
            done.append(1)
            return method(self, *a, **b)
        return call

    with monkeypatch.context() as m:
        for name in ("parquet", "json"):
            m.setattr(DataFrameWriter, name, failing(getattr(DataFrameWriter, name)))
        try:
            put(spark, path, "two", [("b", "3"), ("c", "4")])
        except Crash:
            assert visible(spark, path) == [("a", "1"), ("b", "2")]
        else:
            assert step == 3
    if step == 2:  # the entry's folder is there, its file is not
        os.makedirs(f"{path}/_log/0000000002/_temporary")
    put(spark, path, "two", [("b", "3"), ("c", "4")])
    assert visible(spark, path) == [("a", "1"), ("b", "3"), ("c", "4")]


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    put(spark, path, "one", [("a", "1")])
    seen = versions.entries(spark, path)
    put(spark, path, "two", [("b", "2")])
    real, calls = versions.entries, []

    def stale(*a):
        calls.append(1)
        return seen if len(calls) == 1 else real(*a)

    monkeypatch.setattr(versions, "entries", stale)
    with pytest.raises(RuntimeError):
        put(spark, path, "three", [("c", "3")])
    assert visible(spark, path) == [("a", "1"), ("b", "2")]


def test_audit_log_takes_a_run_once(spark, tmp_path):
    path = str(tmp_path / "log")
    assert lifecycle.read_audit(spark, path) is None
    at = F.expr("timestamp_ntz '2024-01-01 00:00:00'")
    rows = lifecycle.audit_rows(spark.createDataFrame([("1",), ("2",)], "doc_id string"), "UPLOAD", ts=at)
    assert lifecycle.log_audit(rows, path, "r1") and not lifecycle.log_audit(rows, path, "r1")
    assert lifecycle.log_audit(rows, path, "r2")
    assert lifecycle.read_audit(spark, path).groupBy("doc_id").count().collect()[0]["count"] == 2


def documents_of(spark, ids, suffix=""):
    return spark.createDataFrame(
        [(f"d{i}", f"mail u{i}{suffix}@x.org Aadhaar 2345 6789 012{i % 10}", f"f{i}.csv",
          ["COMPLETED", "PENDING", "FAILED"][i % 3]) for i in ids],
        "doc_id string, text string, filename string, status string").withColumn(
        "created_at", F.expr("timestamp_ntz '2024-01-01 00:00:00'"))


def test_catalog_in_two_runs_equals_one(spark, tmp_path):
    at = F.expr("timestamp_ntz '2024-02-01 00:00:00'")
    one = pipeline.write_catalog(documents_of(spark, range(20)), str(tmp_path / "one"), timestamp=at)
    path = str(tmp_path / "two")
    pipeline.write_catalog(documents_of(spark, range(12), "old"), path, timestamp=at, run="a")
    two = pipeline.write_catalog(documents_of(spark, range(20)), path, timestamp=at, run="b")
    again = pipeline.write_catalog(documents_of(spark, range(20), "lost"), path, timestamp=at, run="b")
    for name in pipeline.TABLES:
        def rows(table):
            return sorted(json.dumps(r.asDict(True), sort_keys=True, default=str) for r in getattr(table, name).collect())
        assert rows(one) == rows(two) == rows(again), name
    actions = {(r.doc_id, r.action) for r in two.audit.collect()}
    assert ("d0", "REDACT") in actions and ("d1", "REDACT") not in actions and ("d1", "UPLOAD") in actions


def test_tags_wait_for_the_scan(spark, tmp_path):
    tables = pipeline.write_catalog(documents_of(spark, range(3)), str(tmp_path / "c"))
    assert {r.doc_id: r.tags is not None for r in tables.jobs.collect()} == {"d0": True, "d1": False, "d2": False}


def test_redacted_texts_of_several_runs(spark, tmp_path):
    row = "doc_id string, storage_key string, redacted_text string, entities_redacted int, redaction_level string"
    path = str(tmp_path / "out")
    for run, rows in (("r1", [("a", "FULL", "1"), ("b", "FULL", "2"), ("b", "LIGHT", "3")]),
                      ("r2", [("b", "FULL", "4"), ("c", "FULL", "5")]), ("r2", [("a", "FULL", "lost")])):
        df = spark.createDataFrame([(i, f"k/{i}", t, 1, level) for i, level, t in rows], row)
        out = documents.write_redacted(df, path, run=run)
    assert out.columns == ["doc_id", "redacted_key", "redaction_level", "entities_redacted"] and out.count() == 4
    assert {(r.doc_id, r.redaction_level, r.redacted_text) for r in documents.read_redacted(spark, path).collect()} == {
        ("a", "FULL", "1"), ("b", "FULL", "4"), ("b", "LIGHT", "3"), ("c", "FULL", "5")}
