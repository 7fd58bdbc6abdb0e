"""Audit events, status changes and details of document jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from piiloom.functions.columns import utc_now
from piiloom.sources import versions

ANONYMOUS = "anonymous"
_DETAILS = "map<string,string>"


def audit_rows(df: DataFrame, action, actor=None, details: Column | None = None,
               ip_address: Column | None = None, ts: Column | None = None) -> DataFrame:
    """Audit rows for every row of ``df`` (which has ``doc_id``); missing details are empty."""
    action = F.lit(action) if isinstance(action, str) else action
    actor = F.lit(ANONYMOUS) if actor is None else F.lit(actor) if isinstance(actor, str) else actor
    empty = F.create_map().cast(_DETAILS)
    return df.select(
        "doc_id", action.alias("action"), actor.alias("actor"),
        (empty if details is None else F.coalesce(details.cast(_DETAILS), empty)).alias("details"),
        (F.lit(None) if ip_address is None else ip_address).cast("string").alias("ip_address"),
        (utc_now() if ts is None else ts.cast("timestamp_ntz")).alias("ts"))


def append_audit(*parts: DataFrame) -> DataFrame:
    """All audit rows together."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def write_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows to a plain folder."""
    rows.write.mode("append").parquet(path)


def log_audit(rows: DataFrame, path: str, run: str) -> bool:
    """Append a run's audit rows to a log, once for each run name; False if the log has the run."""
    return versions.commit(path, run, {"audit": rows})


def read_audit(spark: SparkSession, path: str) -> DataFrame | None:
    return versions.read(spark, path, "audit")


def merge_details(left: Column, right: Column) -> Column:
    """Right-biased merge of two maps, keys of ``left`` first."""
    empty = F.create_map().cast(_DETAILS)
    left, right = F.coalesce(left, empty), F.coalesce(right, empty)
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def task_events(df: DataFrame, event: str, task_name: str, ts: Column,
                error: Column | None = None, details: Column | None = None) -> DataFrame:
    """``task_start``, ``task_complete`` or ``task_failure`` as PROCESS rows by ``system``."""
    pairs = [F.lit("event"), F.lit(event), F.lit("task_name"), F.lit(task_name)]
    if event == "task_failure":
        pairs += [F.lit("error"), F.lit(None).cast("string") if error is None else error]
    own = F.create_map(*pairs).cast(_DETAILS)
    merged = own if details is None else merge_details(own, details.cast(_DETAILS))
    return audit_rows(df, "PROCESS", "system", merged, ts=ts)


def current_status(transitions: DataFrame) -> DataFrame:
    """Latest status per document; one partial aggregate, no sort."""
    latest = F.struct("ts", "seq")
    return transitions.groupBy("doc_id").agg(
        F.max_by("status", latest).alias("status"), F.max("ts").alias("updated_at"),
        F.count("*").alias("changes"))


def mark_failed(jobs: DataFrame, error: Column, failed: Column) -> DataFrame:
    """Set FAILED and ``details.error`` where ``failed``; other details stay."""
    note = F.create_map(F.lit("error"), error).cast(_DETAILS)
    return (jobs.withColumn("details", F.when(failed, merge_details(F.col("details"), note))
                            .otherwise(F.col("details")))
            .withColumn("status", F.when(failed, F.lit("FAILED")).otherwise(F.col("status"))))


def failed_docs(jobs: DataFrame) -> DataFrame:
    """Failed jobs with the error from their details."""
    return (jobs.filter(F.col("status") == "FAILED")
            .select("doc_id", "status", F.col("details")["error"].alias("error"),
                    F.size("details").alias("n_details")))


def cascade_delete(children: DataFrame, deleted: DataFrame) -> DataFrame:
    """``children`` without those of deleted documents."""
    return children.join(deleted.select("doc_id").distinct(), "doc_id", "left_anti")


def cascade_delete_all(children: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """Every table that refers to jobs, without the rows of deleted ones."""
    return {name: cascade_delete(df, deleted) for name, df in children.items()}


def pipeline_details(redacted: DataFrame) -> Column:
    """The details a finished job accumulates over its stages, merged stage by stage."""
    extract = F.create_map(F.lit("char_count"), F.char_length("text").cast("string"),
                           F.lit("stage"), F.lit("extract"))
    detect = F.create_map(F.lit("total_entities"), F.size("spans").cast("string"),
                          F.lit("stage"), F.lit("detect"))
    done = F.create_map(F.lit("entities_redacted"), F.col("entities_redacted").cast("string"),
                        F.lit("stage"), F.lit("redact"))
    return merge_details(merge_details(extract.cast(_DETAILS), detect.cast(_DETAILS)),
                         done.cast(_DETAILS))


