"""The shape of physical plans: passes over the text, shuffles, pushed filters."""

import re

import pytest
from pyspark.sql import functions as F

from piiloom import rules as R
from piiloom.operators import catalog, detect, ingest, redact, risk
from piiloom.plans import pipeline
from piiloom.session import broadcast_if_small
from piiloom.sources.documents import spread, write_bucketed


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "t")
    spark.range(50).select(
        F.concat(F.lit("d"), F.col("id")).alias("doc_id"), F.lit("f.pdf").alias("filename"),
        F.concat(F.lit("Aadhaar 2345 6789 "), F.lpad(F.col("id").cast("string"), 4, "0"))
        .alias("text"), F.lit("unused").alias("other"), F.lit("COMPLETED").alias("status"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00'").alias("created_at")).write.parquet(path)
    return spark.read.parquet(path)


def passes(plan):
    """Regex passes that make spans: one ``split`` and one extraction per rule."""
    n_split = len(re.findall(r"\bsplit\(", plan))
    n_extract = len(re.findall(r"regexp_extract_all\(text#\d+, \(\?U\)", plan))
    return n_split, n_extract


def test_each_rule_reads_the_text_once_and_nothing_moves(docs):
    rules = len(R.DEFAULT_RULES)
    for df in (detect.detect_all(docs), pipeline.scan(docs).select("doc_id", "risk_score"),
               risk.high_risk(pipeline.scan(docs)).select("doc_id"),
               risk.risk_explain(pipeline.scan(docs)).select("doc_id", "summary"),
               pipeline.redact_corpus(docs, "SYNTHETIC").select("doc_id", "redacted_text"),
               redact.leak_check(pipeline.redact_corpus(docs, "FULL")).filter("leaked > 0"),
               redact.audit_mapping(pipeline.redact_corpus(docs, "LIGHT")),
               detect.counts_in_row(pipeline.scan(docs)),
               pipeline.process(docs)):
        plan = physical(df)
        assert passes(plan) == (rules, rules)
        assert "Exchange" not in plan and "Python" not in plan


def test_only_needed_columns_are_read(docs):
    plan = physical(detect.detect_all(docs))
    assert "ReadSchema: struct<doc_id:string,text:string>" in plan


def test_entity_counts_shuffle_once_after_a_partial_count(docs):
    plan = physical(detect.entity_counts(detect.detect_all(docs)))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_count" in plan


def test_catalog_filters_reach_the_scan(spark, docs, tmp_path):
    tables = pipeline.write_catalog(docs, str(tmp_path / "catalog"))
    assert tables.jobs.count() == 50 and tables.entities.count() == 50
    assert tables.reports.count() == 50 and "text" not in tables.processed.columns
    plan = physical(catalog.docs_by_band(tables.jobs, "CRITICAL"))
    assert "EqualTo(risk_band,CRITICAL)" in plan and "TakeOrderedAndProject" in plan
    plan = physical(catalog.list_entities(tables.entities, "d7"))
    assert "EqualTo(doc_id,d7)" in plan
    assert [r.doc_id for r in catalog.list_entities(tables.entities, "d7").collect()] == ["d7"]


def test_raw_values_are_not_stored(docs, tmp_path):
    tables = pipeline.write_catalog(docs, str(tmp_path / "catalog"))
    for table in (tables.processed, tables.jobs, tables.entities, tables.reports):
        assert "2345 6789" not in str(table.limit(5).collect())


def test_dedup_salts_the_join_back(spark):
    files = spark.createDataFrame([("a", "h", 1), ("b", "h", 2)],
                                  "file_id string, file_hash string, created_at int")
    plan = physical(ingest.dedup_by_hash(files))
    assert "partial_min_by" in plan and "_salt" in plan


def test_broadcast_only_below_the_limit(spark):
    small = spark.range(10)
    assert "broadcast" in broadcast_if_small(small)._jdf.queryExecution().logical().toString().lower()
    assert broadcast_if_small(small, rows=9) is small


def test_stored_spans_come_to_bucketed_texts(spark, docs, tmp_path):
    tables = pipeline.write_catalog(docs, str(tmp_path / "catalog"))
    texts = write_bucketed(docs.select("doc_id", "text"), "bucketed_texts", str(tmp_path / "texts"), 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for key, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
            spark.conf.set(key, value)
        df = pipeline.redact_stored(texts, tables, "FULL").select("doc_id", "redacted_text")
        lines = physical(df).splitlines()
        at = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
        above, level = [], len(lines[at]) + 1
        for line in reversed(lines[:at + 1]):
            indent = len(re.match(r"[ :+\-]*", line).group())
            if indent < level:
                above.append(line)
                level = indent
        assert "SortMergeJoin" in "".join(above) and "Exchange" not in "".join(above)
        assert {r["redacted_text"] for r in df.collect()} == {"Aadhaar [REDACTED]"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sql("DROP TABLE bucketed_texts")


def test_spread_moves_only_coarse_scans(spark, docs):
    wanted = 2 * spark.sparkContext.defaultParallelism
    assert spread(docs.coalesce(1), "doc_id").rdd.getNumPartitions() == wanted
    fine = spark.range(0, 100, 1, wanted)
    assert spread(fine, "id") is fine
