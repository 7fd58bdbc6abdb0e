"""Plans and work that must not grow faster than the input; each test builds its own rows."""

import time

import pytest
from pyspark.sql import functions as F

from piiloom import rules as R
from piiloom.functions.spans import letter_first
from piiloom.operators import catalog, detect, names, quality
from piiloom.plans import pipeline
from piiloom.sources import derived, documents, versions


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_and_rules_look_at_the_letter_first():
    assert names.letter_first(["Asha Rao", "Ravi"]).startswith("(?=[AR])")
    assert letter_first(r"\b[2-9][0-9]{11}\b") == r"(?=[2-9])\b[2-9][0-9]{11}\b"
    for kept in (r"\b[\w.]+@", r"\b[0-9]{4}|x", "[0-9]"):
        assert letter_first(kept) == kept


def test_names_of_other_letters_are_found(spark, texts):
    rows = spark.createDataFrame([("Éva", 0.9), ("Ñu-x", 0.9), ("ß a", 0.9)], "name string, score double")
    docs = texts("éva Éva xÉva", "ñU-X a Ñu-x", "ß  a")
    for ignore_case, want in ((False, [("0", 4), ("1", 7), ("2", 0)]),
                              (True, [("0", 0), ("0", 4), ("1", 0), ("1", 7), ("2", 0)])):
        for found in (detect.detect_person(docs, rows, 0.7, ignore_case), detect.join_names(docs, rows, 0.7, ignore_case)):
            assert sorted((r.doc_id, r.start_offset) for r in found.collect()) == want


def test_joined_names_carry_no_whole_text_per_token(spark, texts):
    rows = spark.createDataFrame([("a b c", 0.9), ("z", 0.8)], "name string, score double")
    docs = texts("z " + "a b " * 60_000 + "c")
    began = time.time()
    found = detect.join_names(docs, rows, ignore_case=False).orderBy("start_offset").collect()
    assert [(r.start_offset, r.end_offset) for r in found] == [(0, 1), (239_998, 240_003)]
    assert time.time() - began < 60
    assert "BroadcastHashJoin" in plan_of(detect.join_names(docs, rows))


def test_status_reads_entities_once(spark):
    jobs = spark.createDataFrame([(d, d, "COMPLETED", 1.0, "LOW", None, None, None, None, None) for d in ("a", "b", "b", None)],
                                 "doc_id string, filename string, status string, risk_score double, risk_band string,"
                                 " entity_fqn string, redacted_fqn string, error string, created_at timestamp_ntz,"
                                 " updated_at timestamp_ntz")
    entities = spark.createDataFrame([("b", "PAN", None, 0, 1, 0.9), ("b", "PAN", None, 2, 3, 0.9), ("b", "EMAIL", None, 4, 5, 0.9),
                                      ("x", "PAN", None, 0, 1, 0.9), (None, "PAN", None, 0, 1, 0.9)],
                                     "doc_id string, entity_type string, subtype string, start_offset int, end_offset int,"
                                     " confidence double")
    out = catalog.document_status(jobs, entities)
    moved = [line for line in plan_of(out).splitlines() if "Exchange hashpartitioning" in line]
    found = sorted((r.doc_id or "", r.entity_type or "", r.start_offset or 0, r.n or 0) for r in out.collect())
    assert found == [("", "", 0, 0), ("a", "", 0, 0)] + [("b", "EMAIL", 4, 1)] * 2 + [("b", "PAN", 0, 2)] * 2 + [("b", "PAN", 2, 2)] * 2
    assert 1 <= len(moved) <= 2 and not any("entity_type" in line for line in moved)


def test_reports_are_read_without_hashes(spark, tmp_path):
    rows = spark.sql("select 'a' doc_id, 'f' filename, 'FULL' redaction_level, timestamp_ntz '2024-01-01 00:00:00' timestamp,"
                     " array(named_struct('entity_type', 'PAN', 'start_offset', 0, 'end_offset', 1, 'confidence', 0.5D,"
                     " 'redacted_value', 'r', 'value_hash', 'h')) pii_instances, 1 total_entities_redacted,"
                     " 1.0D risk_score_before, 0.0D risk_score_after union all select 'b', null, 'FULL', null, null, 0, 0.0D, 0.0D")
    rows.write.parquet(f"{tmp_path}/r")
    reports = spark.read.parquet(f"{tmp_path}/r")
    assert "value_hash" not in plan_of(quality.report_metadata(reports))
    got = {r.doc_id: r.metadata.pii_instances for r in quality.report_metadata(reports).collect()}
    assert got["b"] is None and [(p.entity_type, p.original_value, p.redacted_value) for p in got["a"]] == [("PAN", None, "r")]


def test_rows_of_the_last_run_take_no_join(spark, tmp_path):
    path = str(tmp_path / "v")
    for run, rows in (("1", [("a", 1), ("b", 1), (None, 1)]), ("2", [("b", 2), (None, 2)]), ("3", [("c", 3)])):
        df = spark.createDataFrame(rows, "doc_id string, x int")
        versions.commit(path, run, {"t": df}, df.select("doc_id"))
    out = versions.read(spark, path, "t")
    assert sorted((r.doc_id or "", r.x) for r in out.collect()) == [("", 2), ("a", 1), ("b", 2), ("c", 3)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and plan.count("Join LeftAnti") == 1


@pytest.fixture
def some(spark):
    return spark.createDataFrame([(f"d{i}", "PAN ABCPE1234F and a@b.com", "f.pdf", "COMPLETED") for i in range(20)],
                                 "doc_id string, text string, filename string, status string").withColumn(
        "created_at", F.expr("timestamp_ntz '2024-01-01 00:00:00'"))


def test_redacted_texts_are_made_once(spark, tmp_path, some):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    rows = some.select("doc_id", F.lit("k").alias("storage_key"), F.lit("FULL").alias("redaction_level"),
                       F.lit(1).alias("entities_redacted"), counted.asNondeterministic()("text").alias("redacted_text"))
    assert documents.write_redacted(rows, str(tmp_path / "r"), run="one").count() == 20 and seen.value == 20


def test_catalog_tables_are_written_where_their_rows_are(spark, tmp_path, some, monkeypatch):
    plans = []
    monkeypatch.setattr(versions, "commit", lambda path, run, tables, *rest: plans.extend(map(plan_of, tables.values())))
    monkeypatch.setattr(pipeline, "read_catalog", lambda *a: None)
    pipeline.write_catalog(some, str(tmp_path / "c"), run="one", rules=R.DEFAULT_RULES)
    assert len(plans) == 5 and not any("Exchange" in p for p in plans)


def test_the_dictionary_holds_all_capitalised_words_of_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, "an ox Saw. Then Éa\n" + "x " * 500 + "Zeno"), (2, None)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    names = {r.name for r in derived.person_dictionary(spark, str(tmp_path)).collect()}
    assert names == {"Saw", "Then", "Éa", "Zeno"} | {r.name for r in derived.name_dictionary(spark).collect()}


def test_names_of_repeated_ids_are_found_as_of_others(spark):
    rows = [(f"n{i}", 0.85) for i in range(detect.PATTERN_NAMES)] + [("Asha Rao", 0.85), ("Asha", 0.75), ("Rao", 0.85)]
    listed = spark.createDataFrame(rows, "name string, score double")
    docs = spark.createDataFrame([("a", "Asha Rao, Rao")] * 3 + [(None, "asha rao"), ("b", None)], "doc_id string, text string")
    found = detect.detect_person(docs, listed)
    assert "Join" in plan_of(found)
    got = sorted((r.doc_id or "", r.start_offset, r.end_offset) for r in found.collect())
    assert got == [("", 0, 8)] + [("a", 0, 8)] * 3 + [("a", 10, 13)] * 3
