"""Lookups and reports over the stored tables.

Every function covers all documents; ``doc_id`` or ``risk_band`` narrows it to
one, as a filter the Parquet scan receives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from piiloom import rules as R
from piiloom.functions.chunks import chunks_where, cut_sql
from piiloom.functions.columns import with_computed
from piiloom.functions.text import lookup


def _only(df: DataFrame, doc_id: str | None) -> DataFrame:
    return df if doc_id is None else df.filter(F.col("doc_id") == doc_id)


def document_status(jobs: DataFrame, entities: DataFrame, doc_id: str | None = None) -> DataFrame:
    """Job row with one row per entity and the document's count of that type.

    Entities are counted beside their own rows, so they are read and exchanged once; the window's
    rows spill, none is collected.  Documents without entities keep one row.
    """
    jobs, entities = _only(jobs, doc_id), _only(entities, doc_id)
    head = jobs.select("doc_id", "filename", "status", "risk_score", "risk_band",
                       "entity_fqn", "redacted_fqn", "error", "created_at", "updated_at")
    spans = entities.select("doc_id", "entity_type", "subtype", "start_offset", "end_offset", "confidence")
    # by document first: one exchange serves the counts and the join
    same_type = W.partitionBy("doc_id", "entity_type")
    counted = spans.repartition("doc_id").withColumn("n", F.count(F.lit(1)).over(same_type))
    return head.join(counted, "doc_id", "left").select(*spans.columns, *head.columns[1:], "n")


def pii_summary(entities: DataFrame, doc_id: str | None = None) -> DataFrame:
    """Entities per document and type."""
    return (_only(entities, doc_id).groupBy("doc_id", "entity_type")
            .agg(F.count("*").alias("n")))


def risk_breakdown(entities: DataFrame, doc_id: str | None = None) -> DataFrame:
    """Count and mean confidence per type, and the document's total."""
    by_type = (_only(entities, doc_id).groupBy("doc_id", "entity_type")
               .agg(F.count("*").alias("n"), F.avg("confidence").alias("mean")))
    # The window holds one row per type of a document, not its entities.
    total = F.sum("n").over(W.partitionBy("doc_id"))
    return by_type.select("doc_id", "entity_type", "n",
                          F.round("mean", 3).alias("avg_confidence"),
                          total.alias("total_entities"))


def risk_lookup(jobs: DataFrame, entities: DataFrame, doc_id: str | None = None) -> DataFrame:
    """Score (null as 0), band, status and the breakdown by type, largest count first."""
    by_type = risk_breakdown(entities, doc_id).drop("total_entities")
    head = _only(jobs, doc_id).select(
        "doc_id", "filename", F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
        "risk_band", "status")
    return (head.join(by_type, "doc_id", "left")
            .orderBy("doc_id", F.desc("n"), "entity_type"))


def list_entities(entities: DataFrame, doc_id: str | None = None) -> DataFrame:
    """Spans in document order: all of one document, or of each partition of the table, which is
    stored in ranges of documents; nothing is moved to sort the whole."""
    spans = _only(entities, doc_id).select(
        "doc_id", "entity_type", "start_offset", "end_offset",
        F.round("confidence", 3).alias("confidence"), "subtype")
    order = ["doc_id", "start_offset", "end_offset", "entity_type"]
    return spans.sortWithinPartitions(*order) if doc_id is None else spans.orderBy(*order)


def docs_by_band(jobs: DataFrame, risk_band: str, limit: int = 10,
                 max_limit: int | None = 100) -> DataFrame:
    """The riskiest documents of a band, newest first among equals.

    More than ``max_limit`` (``None``: no bound) is refused, not cut.
    """
    if max_limit is not None and limit > max_limit:
        raise ValueError(f"limit {limit} is over max_limit {max_limit}")
    return (jobs.filter(F.col("risk_band") == risk_band)
            .select("doc_id", "filename", F.coalesce("risk_score", F.lit(0.0)).alias("score"),
                    "risk_score", "risk_band", "status", "entity_fqn", "created_at")
            .orderBy(F.desc_nulls_first("risk_score"), F.desc_nulls_first("created_at"), "doc_id")
            .limit(limit)
            .drop("risk_score").withColumnRenamed("score", "risk_score"))


def band_distribution(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("risk_band").agg(F.count("*").alias("n"))


def audit_trail(audit: DataFrame, doc_id: str | None = None) -> DataFrame:
    """Events oldest first.  The sort key ends in the time and id, so a document
    with very many events is cut over several ranges."""
    return _only(audit, doc_id).orderBy("doc_id", "ts", "event_id")


def docs_with_type(jobs: DataFrame, entities: DataFrame, entity_type: str,
                   risk_band: str | None = None) -> DataFrame:
    """Documents holding at least one entity of a type."""
    if risk_band is not None:
        jobs = jobs.filter(F.col("risk_band") == risk_band)
    holders = entities.filter(F.col("entity_type") == entity_type).select("doc_id").distinct()
    return jobs.join(holders, "doc_id", "left_semi")


def recent_docs(jobs: DataFrame, risk_band: str, now, days: int = 7) -> DataFrame:
    """Documents of a band created within the last ``days``."""
    since = now - F.expr(f"interval {int(days)} days")
    return jobs.filter((F.col("risk_band") == risk_band) & (F.col("created_at") >= since))


def text_segments(scanned: DataFrame) -> DataFrame:
    """Alternating plain and entity segments of each text, from its ``spans`` array."""
    text, spans = F.col("text"), F.col("spans")

    def segment(start, end, entity_type):
        return F.struct(start.alias("start_offset"), end.alias("end_offset"),
                        entity_type.alias("entity_type"))

    def pieces(span, i):
        cursor = F.coalesce(F.get(spans, i - 1)["end_offset"], F.lit(0))
        own = segment(span["start_offset"], span["end_offset"], span["entity_type"])
        gap = segment(cursor, span["start_offset"], F.lit(None).cast("string"))
        return F.when(span["start_offset"] > cursor, F.array(gap, own)).otherwise(F.array(own))

    cursor = F.coalesce(F.get(spans, F.size(spans) - 1)["end_offset"], F.lit(0))
    # A text without any span is one segment, even when it is empty.
    rest = (cursor < F.char_length(text)) | (F.size(spans) == 0)
    tail = F.when(rest, F.array(segment(cursor, F.char_length(text),
                                        F.lit(None).cast("string")))).otherwise(
        F.array().cast("array<struct<start_offset:int,end_offset:int,entity_type:string>>"))
    df = with_computed(scanned.select("doc_id", "text", "spans"),
                       pieces=F.concat(F.flatten(F.transform(spans, pieces)), tail),
                       chunks=chunks_where("true"))
    segment = cut_sql("chunks", "p.start_offset", "p.end_offset - p.start_offset")
    cut = F.expr("transform(pieces, p -> named_struct('entity_type', p.entity_type,"
                 f" 'segment', {segment}))")
    return df.select("doc_id", F.posexplode(cut).alias("segment_no", "s")).select(
        "doc_id", "segment_no", "s.entity_type", "s.segment")


def type_share_of_max(entities: DataFrame) -> DataFrame:
    """Each type's count as a percentage of the document's largest count."""
    counts = pii_summary(entities)
    most = F.greatest(F.max("n").over(W.partitionBy("doc_id")), F.lit(1))
    return counts.select("doc_id", "entity_type", "n", (F.col("n") / most * 100).alias("share"))


def progress_step(jobs: DataFrame) -> DataFrame:
    """Position of the status in the progress display; unknown statuses count as 0."""
    return jobs.select("doc_id", "status",
                       lookup(R.PROGRESS_STEPS, F.col("status"), 0).alias("step"))


def distinct_types(entities: DataFrame) -> DataFrame:
    """The types of each document, sorted; at most one entry per known type."""
    return entities.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("entity_type")).alias("types"))


def sample_docs(jobs: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` documents by id."""
    return (jobs.select("doc_id", "filename", "status", "risk_score", "risk_band")
            .orderBy("doc_id").limit(n))


def redactable_docs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status").isin(list(R.REDACTABLE_STATUSES)))


def scored_docs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("risk_score").isNotNull())


def pending_docs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(~F.col("status").isin(list(R.TERMINAL_STATUSES)))
