"""Constraint reports and JSON records.

Parquet enforces nothing, so table constraints become counts of violations and
quarantine predicates.  As with SQL CHECK, a null passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piiloom import rules as R

INSTANCE_TYPE = ("struct<entity_type:string,original_value:string,redacted_value:string,"
                 "start_offset:int,end_offset:int,confidence:double>")
METADATA_TYPE = ("struct<document_id:string,filename:string,redaction_level:string,"
                 f"timestamp:string,pii_instances:array<{INSTANCE_TYPE}>,"
                 "total_entities_redacted:int,risk_score_before:double,risk_score_after:double>")


def _violations(df: DataFrame, table: str, checks: dict[str, Column]) -> DataFrame:
    """One pass over ``df``: a conditional count per check, then one row each."""
    counts = [F.count(F.when(~F.coalesce(check, F.lit(True)), 1)).alias(f"c{i}")
              for i, check in enumerate(checks.values())]
    rows = F.array(*[F.struct(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
                              F.col(f"c{i}").alias("violations"))
                     for i, rule in enumerate(checks)])
    return df.agg(*counts).select(F.inline(rows))


def constraint_violations(jobs: DataFrame, entities: DataFrame, reports: DataFrame) -> DataFrame:
    """Violations per table and rule, zeros included."""
    between = lambda name: F.col(name).between(0, 100)
    parts = [
        _violations(jobs, "document_jobs", {"risk_score_range": between("risk_score")}),
        _violations(entities, "pii_entities", {
            "confidence_range": F.col("confidence").between(0, 1),
            "start_offset_positive": F.col("start_offset") >= 0,
            "end_after_start": F.col("end_offset") > F.col("start_offset")}),
        _violations(reports, "redaction_reports", {
            "risk_score_before_range": between("risk_score_before"),
            "risk_score_after_range": between("risk_score_after"),
            "total_entities_positive": F.col("total_entities_redacted") >= 0}),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def span_validity(entities: DataFrame) -> DataFrame:
    """Add ``valid``; ``entities`` carry ``char_count``, the length of their text."""
    valid = ((F.col("start_offset") >= 0) & (F.col("end_offset") > F.col("start_offset"))
             & F.col("confidence").between(0, 1)
             & (F.col("end_offset") <= F.col("char_count")))
    return entities.withColumn("valid", F.coalesce(valid, F.lit(False)))


_TEXT_FIELDS = ("document_id", "filename", "redaction_level", "timestamp")
_INSTANCE_TEXTS = ("entity_type", "original_value", "redacted_value")


def _not_text(value: Column, field: str) -> Column:
    """Whether a field of a VARIANT object is there and neither a string nor null."""
    kind = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
    return F.coalesce(~kind.isin("STRING", "VOID"), F.lit(False))


def ill_typed(json: Column) -> Column:
    """Names of the text fields that hold something else, sorted; those of instances as ``pii_instances.<name>``.

    A parser that is told to expect a string takes numbers, objects and lists for one; the record's own
    types tell them apart.
    """
    value = F.try_parse_json(json)
    own = [F.when(_not_text(value, name), F.lit(name)) for name in _TEXT_FIELDS]
    instances = F.try_variant_get(value, "$.pii_instances", "array<variant>")

    def in_some(name: str) -> Column:
        return F.exists(instances, lambda p: _not_text(p, name))

    inner = [F.when(in_some(name), F.lit(f"pii_instances.{name}")) for name in _INSTANCE_TEXTS]
    return F.array_sort(F.array_compact(F.array(*own, *inner)))


def parse_metadata(records: DataFrame, column: str = "json") -> DataFrame:
    """Parse redaction records; add ``metadata``, ``ok``, ``reject_reason`` and ``ill_typed`` (text fields that
    hold something else).

    Rejected are texts that are no JSON object or have an ill-typed field,
    records lacking a required field, and values outside their bounds.  The
    hash-only report form, without original values, is accepted.
    """
    parsed = F.from_json(F.col(column), METADATA_TYPE[:-1] + ",_corrupt:string>", {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    df = records.withColumn("_parsed", parsed).withColumn("ill_typed", ill_typed(F.col(column)))
    m = F.col("_parsed")
    required = ("document_id", "filename", "redaction_level", "timestamp", "pii_instances",
                "total_entities_redacted", "risk_score_before", "risk_score_after")
    missing = reduce(lambda a, b: a | b, [m[name].isNull() for name in required])
    lacking = F.exists(m["pii_instances"], lambda p: (
        p["entity_type"].isNull() | p["redacted_value"].isNull() | p["start_offset"].isNull()
        | p["end_offset"].isNull() | p["confidence"].isNull()))
    bounded = (m["redaction_level"].isin(list(R.REDACTION_LEVELS))
               & (m["total_entities_redacted"] >= 0) & m["risk_score_before"].between(0, 100)
               & m["risk_score_after"].between(0, 100)
               & F.try_to_timestamp(m["timestamp"]).isNotNull())
    reason = (F.when(m.isNull() | m["_corrupt"].isNotNull() | (F.size("ill_typed") > 0), F.lit("malformed"))
              .when(missing | F.coalesce(lacking, F.lit(False)), F.lit("missing field"))
              .when(~bounded, F.lit("out of range")))
    return (df.withColumn("reject_reason", reason)
            .withColumn("ok", F.col("reject_reason").isNull())
            .withColumn("metadata", m.dropFields("_corrupt")).drop("_parsed"))


def canonical_json(metadata: Column) -> Column:
    """Compact JSON with keys in alphabetical order at both levels."""
    instances = F.transform(metadata["pii_instances"], lambda p: F.struct(
        p["confidence"].alias("confidence"), p["end_offset"].alias("end_offset"),
        p["entity_type"].alias("entity_type"), p["original_value"].alias("original_value"),
        p["redacted_value"].alias("redacted_value"), p["start_offset"].alias("start_offset")))
    return F.to_json(F.struct(
        metadata["document_id"].alias("document_id"), metadata["filename"].alias("filename"),
        instances.alias("pii_instances"), metadata["redaction_level"].alias("redaction_level"),
        metadata["risk_score_after"].alias("risk_score_after"),
        metadata["risk_score_before"].alias("risk_score_before"),
        metadata["timestamp"].alias("timestamp"),
        metadata["total_entities_redacted"].alias("total_entities_redacted")))


def report_metadata(reports: DataFrame) -> DataFrame:
    """Reports in the record form that :func:`parse_metadata` reads; no original values."""
    # Field by field, so that hashes of values are neither read nor exchanged.
    fields = ("entity_type", "redacted_value", "start_offset", "end_offset", "confidence")
    instances = F.transform(F.arrays_zip(*[F.col("pii_instances")[f].alias(f) for f in fields]), lambda p: F.struct(
        p["entity_type"].alias("entity_type"),
        F.lit(None).cast("string").alias("original_value"),
        p["redacted_value"].alias("redacted_value"), p["start_offset"].alias("start_offset"),
        p["end_offset"].alias("end_offset"), p["confidence"].alias("confidence")))
    return reports.select("doc_id", F.struct(
        F.col("doc_id").alias("document_id"), F.coalesce("filename", F.lit("unknown"))
        .alias("filename"), F.col("redaction_level"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        instances.alias("pii_instances"),
        F.col("total_entities_redacted"), F.col("risk_score_before"),
        F.col("risk_score_after")).cast(METADATA_TYPE).alias("metadata"))


def json_round_trip(records: DataFrame) -> DataFrame:
    """Mismatches after printing ``metadata`` and parsing it again, one row."""
    printed = records.select("metadata", canonical_json(F.col("metadata")).alias("json"))
    again = parse_metadata(printed.withColumnRenamed("metadata", "first"))
    same = canonical_json(F.col("metadata")).eqNullSafe(F.col("json")) & F.col("ok")
    return again.agg(F.count("*").alias("records"),
                     F.count(F.when(~same, 1)).alias("mismatches"))


def orphan_rows(children: DataFrame, jobs: DataFrame) -> DataFrame:
    """Children whose document has no job."""
    return children.join(jobs.select("doc_id"), "doc_id", "left_anti")


def repeated_hashes(jobs: DataFrame) -> DataFrame:
    """Content hashes that break uniqueness."""
    return (jobs.groupBy("file_hash").agg(F.count("*").alias("n")).filter("n > 1"))
