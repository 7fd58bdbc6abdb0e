import pytest
from pyspark.sql import functions as F

from piiloom import rules as R
from piiloom.operators import govern


@pytest.fixture(scope="module")
def tags(spark):
    entities = spark.createDataFrame(
        [("1", "AADHAAR"), ("1", "AADHAAR"), ("1", "EMAIL"), ("1", "EMAIL_ADDRESS"), ("2", "PAN"),
         ("2", "FOO"), ("3", "FOO"), ("4", "PERSON")], "doc_id string, entity_type string")
    return govern.tags_of_entities(entities)


@pytest.fixture(scope="module")
def tagged(spark):
    rows = [("1", ["AADHAAR", "EMAIL", "EMAIL_ADDRESS"]), ("2", ["PAN", "FOO"]), ("3", ["FOO"]),
            ("4", ["PERSON"]), ("5", [])]
    return spark.createDataFrame(rows, "doc_id string, types array<string>").withColumn(
        "tags", govern.tag_array(F.col("types")))


def test_both_ways_to_tags_agree(tags, tagged):
    assert sorted(govern.doc_tags(tagged).collect()) == sorted(tags.collect())


def test_tags_and_new_tags(spark, tags):
    got = {(r.doc_id, r.tag_fqn) for r in tags.collect()}
    assert got == {("1", "PII.Sensitive.IndianGovtID.Aadhaar"),
                   ("1", "PII.Sensitive.ContactInfo.Email"),
                   ("2", "PII.Sensitive.IndianGovtID.PAN"), ("4", "PII.Sensitive")}
    held = spark.createDataFrame([("2", "PII.Sensitive.IndianGovtID.PAN"), ("1", "other")],
                                 "doc_id string, tag_fqn string")
    assert {r.doc_id for r in govern.new_tags(tags, held).collect()} == {"1", "4"}


def test_hierarchy(tagged):
    rows = {r.tag_fqn: r for r in govern.tag_hierarchy(tagged).collect()}
    assert {k: r.n_docs for k, r in rows.items()} == {
        "PII": 3, "PII.Sensitive": 3, "PII.Sensitive.IndianGovtID": 2,
        "PII.Sensitive.ContactInfo": 1, "PII.Sensitive.ContactInfo.Email": 1,
        "PII.Sensitive.IndianGovtID.Aadhaar": 1, "PII.Sensitive.IndianGovtID.PAN": 1}
    assert rows["PII"].parent_fqn is None
    assert rows["PII.Sensitive.IndianGovtID"].display_name == "Indian Government ID"


def test_own_root(spark):
    jobs = spark.createDataFrame([("1", ["PAN"])], "doc_id string, types array<string>").withColumn(
        "tags", govern.tag_array(F.col("types"), R.tag_map("Corp")))
    levels = govern.tag_hierarchy(jobs, "Corp").collect()
    assert {r.tag_fqn for r in levels} == {"Corp", "Corp.Sensitive", "Corp.Sensitive.IndianGovtID",
                                           "Corp.Sensitive.IndianGovtID.PAN"}
    assert all(r.display_name for r in levels)


@pytest.fixture(scope="module")
def jobs(spark):
    return spark.createDataFrame(
        [("1", "a.CSV", 10, "k/1", "k/1.red", 60.5, "CRITICAL", ["AADHAAR", "PAN"], "s.a.CSV"),
         ("2", "b", 0, "k/2", None, None, None, None, None),
         ("3", "c.pdf", 5, "k/3", "k/3.red", 61.5, "CRITICAL", [], "s.c.pdf")],
        "doc_id string, filename string, file_size long, storage_key string, redacted_key string,"
        "risk_score double, risk_band string, types array<string>, entity_fqn string")


def test_containers_and_properties(jobs):
    every = govern.all_containers(jobs, service="s", managed_by="us")
    rows = {(r.doc_id, r.is_redacted): r for r in every.collect()}
    assert len(rows) == 5
    assert rows[("1", False)].description == (
        "Risk: CRITICAL (60.5/100) | PII detected: AADHAAR, PAN | Managed by us | Job: 1")
    assert rows[("1", True)].description == (
        "[REDACTED VERSION] Risk: LOW (0.0/100) | PII detected: AADHAAR, PAN"
        " | Managed by us | Job: 1")
    assert rows[("1", True)].fqn == "s.a.CSV.redacted" and rows[("1", True)].size is None
    assert rows[("1", False)].file_formats == ["csv"] and rows[("2", False)].file_formats == []
    assert rows[("2", False)].size is None and rows[("2", False)].risk_band == "LOW"
    props = {r.fqn: r for r in govern.risk_properties(every).collect()}
    assert (props["s.a.CSV"].risk_score, props["s.c.pdf"].risk_score) == (60, 62)
    assert props["s.c.pdf"].detected_pii_types == "none"
    assert props["s.a.CSV.redacted"].redaction_level == "redacted"


def test_lineage_needs_both_sides(spark, jobs):
    reports = spark.createDataFrame([("1", "LIGHT"), ("2", "FULL")],
                                    "doc_id string, redaction_level string").withColumn(
        "timestamp", F.expr("timestamp_ntz '2024-03-01 10:20:30'"))
    rows = govern.lineage_edges(govern.all_containers(jobs), reports, "us").collect()
    assert [(r.doc_id, r.description) for r in rows] == [
        ("1", "Redacted using LIGHT strategy at 2024-03-01T10:20:30 by us")]


def test_runs(spark):
    runs = spark.createDataFrame([("r", "success", 1), ("r", "failed", 2), ("r", "odd", 3)],
                                 "run_id string, status string, started_at int")
    row = govern.run_metrics(runs).collect()[0]
    assert (row.records, row.failures, row.started_at, row.ended_at) == (1, 2, 1, 3)
    states = runs.select(govern.run_state(F.col("status")).alias("s")).collect()
    assert [r.s for r in states] == ["success", "failed", "partialSuccess"]


def test_policy(jobs):
    jobs = jobs.withColumn("tags", F.coalesce(govern.tag_array(F.col("types")),
                                              F.array().cast("array<string>")))
    assert [r.doc_id for r in govern.policy_match(jobs).collect()] == ["1"]
    assert govern.policy_match(jobs, ["other"]).count() == 0
    rows = govern.policy_audit(jobs, F.lit("2024-01-01")).collect()
    got = {r.doc_id: (r.policy_will_apply, r.matching_tags, r.risk_score) for r in rows}
    assert got["3"] == (False, "", 61.5) and got["1"][0] and set(got) == {"1", "3"}


def test_masked_view(spark):
    df = spark.createDataFrame(
        [("1", "secret", "[REDACTED]", [("IndianGovtID",)]), ("2", "open", "x", [(None,)]),
         ("3", "plain", "plain", [])],
        "doc_id string, text string, redacted_text string, spans array<struct<subtype:string>>")
    assert {r.doc_id: (r.masked, r.visible_text)
            for r in govern.policy_masked_view(df).collect()} == {
        "1": (True, "[REDACTED]"), "2": (False, "open"), "3": (False, "plain")}
