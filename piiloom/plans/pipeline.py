"""The whole-document pipeline and the tables it leaves behind.

``process`` detects, scores and redacts in one narrow pass over the text, with
no shuffle.  ``write_catalog`` stores its rows once and derives the narrow
tables (jobs, entities, reports) from the stored columns, so that catalog,
governance and quality queries never read a text again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from piiloom import rules as R
from piiloom.functions.columns import with_computed
from piiloom.functions.masking import DEFAULT_SALT
from piiloom.operators import lifecycle
from piiloom.operators.catalog import redactable_docs
from piiloom.operators.detect import hashed_spans, with_spans
from piiloom.operators.govern import tag_array
from piiloom.operators.ingest import storage_keys
from piiloom.operators.redact import redact, redaction_reports
from piiloom.operators.risk import score_documents
from piiloom.sources import versions

_SCORED = ("PII_DETECTED", "REDACTING", "COMPLETED")


@dataclass(frozen=True)
class Catalog:
    """The stored tables of one run."""

    processed: DataFrame
    jobs: DataFrame
    entities: DataFrame
    reports: DataFrame
    audit: DataFrame


def scan(docs: DataFrame, **detection) -> DataFrame:
    """Documents with ``spans``, ``type_totals``, ``risk_score`` and ``risk_band``."""
    return score_documents(with_spans(docs, **detection))


def redact_corpus(docs: DataFrame, level: str, salt: str = DEFAULT_SALT,
                  overlap: str = "splice", **detection) -> DataFrame:
    """Scan and redact in the same pass."""
    return redact(scan(docs, **detection), level, salt, overlap)


def process(docs: DataFrame, level: str = "FULL", salt: str = DEFAULT_SALT,
            overlap: str = "splice", **detection) -> DataFrame:
    """One row per document with everything but its raw text.

    Spans carry hashes of their values; the values themselves are not kept.
    """
    redacted = redact_corpus(docs, level, salt, overlap, **detection)
    measured = with_computed(
        redacted, spans=hashed_spans(), file_hash=F.sha2("text", 256),
        file_size=F.octet_length("text").cast("long"),
        char_count=F.char_length("text").cast("long"))
    return storage_keys(measured.drop("text", "chunks"))


def job_table(processed: DataFrame, service: str = R.SERVICE_NAME) -> DataFrame:
    """The job row of each processed document; its input carried a ``status``.

    Scores appear from detection on, the redacted key once completed.
    """
    scored = F.col("status").isin(list(_SCORED))
    done = F.col("status") == "COMPLETED"
    named = F.coalesce("filename", F.lit("unknown"))
    error = F.when(F.col("status") == "FAILED", F.concat(
        F.lit("extraction failed: "), F.col("char_count").cast("string"), F.lit(" characters")))
    types = F.array_sort(F.transform(F.col("type_totals"), lambda t: t["entity_type"]))
    return processed.select(
        "doc_id", named.alias("filename"), "file_hash", "file_size", "char_count",
        "storage_key", "status",
        F.when(scored, F.col("risk_score")).alias("risk_score"),
        F.when(scored, F.col("risk_band")).alias("risk_band"),
        F.when(scored, F.concat(F.lit(service + "."), named)).alias("entity_fqn"),
        F.when(done, F.concat("storage_key", F.lit(".redacted.txt"))).alias("redacted_key"),
        F.when(done, F.concat(F.lit(service + "."), named, F.lit(".redacted")))
        .alias("redacted_fqn"),
        error.alias("error"), F.when(scored, types).alias("types"),
        F.when(scored, tag_array(types)).alias("tags"), "created_at",
        F.col("created_at").alias("updated_at"))


def entity_table(processed: DataFrame) -> DataFrame:
    return processed.select("doc_id", F.inline("spans"))


TABLES = ("processed", "jobs", "entities", "reports", "audit")


def write_catalog(docs: DataFrame, folder: str, level: str = "FULL",
                  timestamp: Column | None = None, run: str | None = None, **options) -> Catalog:
    """Run the pipeline over ``docs`` into ``folder``: one pass over the text, then four over its result.

    The four read only the narrow columns they need.  A run adds its documents to those of earlier runs
    and replaces documents that come again; all its tables become visible at once, and a ``run`` by
    the same name is written once (:mod:`piiloom.sources.versions`).
    """
    spark = docs.sparkSession
    run = run or f"run-{uuid.uuid4().hex}"
    if not versions.has_run(spark, folder, run):
        place = versions.new_folder()
        process(docs, level, **options).write.parquet(f"{folder}/{place}/processed")
        processed = spark.read.parquet(f"{folder}/{place}/processed")
        tables = {"processed": processed}
        for name, table in (("jobs", job_table(processed)), ("entities", entity_table(processed)),
                            ("reports", redaction_reports(processed, timestamp)),
                            ("audit", audit_table(processed, level))):
            # A document is one row of ``processed``, so its rows are together as they come: nothing is
            # exchanged.  Sorted, so that row groups cover short id ranges.
            tables[name] = table.sortWithinPartitions("doc_id")
        versions.commit(folder, run, tables, processed.select("doc_id"), place)
    return read_catalog(spark, folder)


def audit_table(processed: DataFrame, level: str) -> DataFrame:
    """What a run did to its documents: each received, and each redacted where its status allows it."""
    at = F.col("created_at")
    received = lifecycle.audit_rows(processed, "UPLOAD", details=F.create_map(
        F.lit("file_hash"), F.col("file_hash")), ts=at)
    redacted = lifecycle.audit_rows(redactable_docs(processed), "REDACT", "system", F.create_map(
        F.lit("redaction_level"), F.lit(level),
        F.lit("entities_redacted"), F.col("entities_redacted").cast("string")), ts=at)
    return lifecycle.append_audit(received, redacted)


def read_catalog(spark: SparkSession, folder: str) -> Catalog:
    return Catalog(*[versions.read(spark, folder, name) for name in TABLES])


def redact_stored(docs: DataFrame, tables: Catalog, level: str, salt: str = DEFAULT_SALT,
                  overlap: str = "splice") -> DataFrame:
    """Redact documents with the spans of an earlier run, where their status allows it.

    The spans come as one array per document, so texts meet them in a one-to-one
    join.  With ``docs`` stored by :func:`piiloom.sources.documents.write_bucketed` the spans are
    brought to the buckets and no text is shuffled; without, detecting again with
    :func:`redact_corpus` is the cheaper way.
    """
    allowed = redactable_docs(tables.jobs).select("doc_id")
    found = tables.processed.select("doc_id", "spans", "risk_score").join(
        allowed, "doc_id", "left_semi")
    return redact(docs.join(found, "doc_id"), level, salt, overlap)


def residual_risk(redacted: DataFrame, **detection) -> DataFrame:
    """Score before, the fixed 0.0 reports carry after, and the score found again
    in the redacted text."""
    before = redacted.select("doc_id", F.col("risk_score").alias("risk_score_before"),
                             F.col("redacted_text").alias("text"))
    again = scan(before, **detection)
    return again.select("doc_id", "risk_score_before", F.lit(0.0).alias("risk_score_after"),
                        F.col("risk_score").alias("risk_score_residual"))
