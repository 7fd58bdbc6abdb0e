"""Continuous versions of ingestion, detection, status and rate reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piiloom import rules as R
from piiloom.operators.detect import detect_all
from piiloom.operators.ingest import content_hash, split_valid, upload_records, validate_files
from piiloom.plans.pipeline import scan

_HASH_PARTS = 16


def valid_uploads(files: DataFrame, limits: dict | None = None, id: str = "file_id") -> DataFrame:
    """PENDING rows of the files that pass the checks, without their contents."""
    accepted, _ = split_valid(validate_files(files, limits))
    return upload_records(content_hash(accepted), id)


def ingest(files: DataFrame, limits: dict | None = None, watermark: str | None = None,
           id: str = "file_id") -> DataFrame:
    """PENDING rows of valid files, each content once.

    Copies of one content are first thinned out in several parts, so that a
    content uploaded over and over does not end in a single state partition.

    Without ``watermark`` the duplicate check is exact and its state holds
    every hash seen.  With one, state is bounded and a copy arriving later than
    the watermark passes as new.
    """
    # Contents stay behind: only narrow job rows travel to the state.
    rows = valid_uploads(files, limits, id).withColumn(
        "_part", F.pmod(F.xxhash64("doc_id"), F.lit(_HASH_PARTS)))
    if watermark is None:
        once = rows.dropDuplicates(["file_hash", "_part"]).dropDuplicates(["file_hash"])
    else:
        once = (rows.withColumn("created_at", F.col("created_at").cast("timestamp"))
                .withWatermark("created_at", watermark)
                .dropDuplicatesWithinWatermark(["file_hash", "_part"])
                .dropDuplicatesWithinWatermark(["file_hash"])
                .withColumn("created_at", F.col("created_at").cast("timestamp_ntz")))
    return once.drop("_part")


def detect(docs: DataFrame, **detection) -> DataFrame:
    """Score and band of each arriving document; stateless."""
    return scan(docs, **detection).select(
        "doc_id", F.size("spans").alias("n_entities"), "risk_score", "risk_band")


def entities(docs: DataFrame, **detection) -> DataFrame:
    """Entities of each arriving document, for an upsert sink."""
    return detect_all(docs, **detection)


def status(transitions: DataFrame) -> DataFrame:
    """Latest status per document so far; run in update mode."""
    latest = F.max(F.struct("ts", "seq", "status")).alias("latest")
    return transitions.groupBy("doc_id").agg(latest)


def latest_status(updates: DataFrame) -> DataFrame:
    """The newest update of each document from an update-mode sink."""
    return (updates.groupBy("doc_id").agg(F.max("latest").alias("latest"))
            .select("doc_id", "latest.status", F.col("latest.ts").alias("updated_at")))


def request_counts(audit: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Requests per minute and address; run in update mode."""
    timed = audit.withColumn("ts", F.col("ts").cast("timestamp"))
    return (timed.withWatermark("ts", watermark)
            .groupBy(F.window("ts", "1 minute"), "ip_address")
            .agg(F.count("*").alias("n"))
            .select(F.col("window.start").alias("minute"), "ip_address", "n"))


def rate_breaches(counts: DataFrame, limit: int = R.UPLOADS_PER_MINUTE) -> DataFrame:
    """Minutes in which an address went over the limit; ``counts`` may hold updates."""
    return (counts.groupBy("minute", "ip_address").agg(F.max("n").alias("n"))
            .filter(F.col("n") > limit)
            .select(F.col("minute").cast("timestamp_ntz").alias("minute"), "ip_address", "n"))


def request_limits(spark: SparkSession, limits: dict[str, int] | None = None) -> DataFrame:
    """Requests allowed per minute and address: ``action, limit``."""
    return spark.createDataFrame(list((limits or R.REQUESTS_PER_MINUTE).items()), "action string, limit long")


def breaches(requests: DataFrame, limits: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Minutes in which an address made more requests of a kind than allowed; run in append mode.

    ``requests``: ``ts, ip_address, action``; ``limits`` as :func:`request_limits`, a static table.  Kinds
    without a limit are not counted.  A minute is reported once, when the watermark has passed
    its end; requests that come later than that are not counted.
    """
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return (timed.join(F.broadcast(limits), "action")  # a row for each kind of request
            .groupBy(F.window("ts", "1 minute"), "ip_address", "action", "limit").agg(F.count("*").alias("n"))
            .where(F.col("n") > F.col("limit"))
            .select(F.col("window.start").cast("timestamp_ntz").alias("minute"), "ip_address", "action", "n", "limit"))
