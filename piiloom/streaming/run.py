"""Running a stream to the end of its present input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piiloom.operators.states import check_transitions, last_accepted
from piiloom.session import shared_folder, stored_copy
from piiloom.sources import versions
from piiloom.streaming.jobs import entities, valid_uploads


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet folder (or file) as a stream, with the schema it has now.

    The last character is written as a set, since a stream takes a single file
    only through a pattern.
    """
    pattern = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern)


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Start an append-mode Parquet sink that handles what is there and stops."""
    return (stream.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path))


def upsert_to(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Start a sink that owns one ``batch_id`` partition per micro-batch.

    A batch replayed after a failure replaces its own partition, so delivery at
    least once still leaves each row once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))

    return (stream.writeStream.foreachBatch(write).outputMode(mode)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _newest(batch: DataFrame, key: str, order: list[str], newest: bool = True) -> DataFrame:
    """One row per key, the last in ``order`` (or the first); rows meet as partial aggregates."""
    pick = F.max_by if newest else F.min_by
    return batch.groupBy(key).agg(pick(F.struct("*"), F.struct(*order)).alias("_row")).select("_row.*")


def upsert_documents(docs: DataFrame, path: str, checkpoint: str, name: str = "stream",
                     order: list[str] | None = None, **detection):
    """Start a sink that keeps the entities of the last version of each arriving document.

    A batch replaces exactly its documents in the table at ``path`` (:func:`read_entities`), also those that
    have no entities any more.  Of versions within one batch the last in ``order`` (columns of
    ``docs``) stays.  ``name`` and the number of the batch name its run, so a batch
    delivered twice is written once; streams into one table need names of their own.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        latest = _newest(batch, "doc_id", order) if order else batch
        versions.commit(path, f"{name}-{batch_id}", {"entities": entities(latest, **detection)},
                        batch.select("doc_id"))

    return (docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_entities(spark: SparkSession, path: str) -> DataFrame | None:
    return versions.read(spark, path, "entities")


def ingest_once(files: DataFrame, path: str, checkpoint: str, limits: dict | None = None,
                name: str = "stream", id: str = "file_id"):
    """Start a sink of PENDING rows, one per content: the earliest upload, ties to the smaller id.

    The table at ``path`` is its own index of hashes.  A batch is first brought down to one row per hash
    (partial aggregation, contents stay behind), then meets the hashes that the index has of it; new
    ones, and those uploaded earlier than the one that is there, are written.  No state is kept in
    memory, and the result is that of :func:`piiloom.operators.ingest.dedup_by_hash` over all batches.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = _newest(valid_uploads(batch, limits, id), "file_hash", ["created_at", "doc_id"], newest=False)
        there = versions.read(spark, path, "uploads")
        if there is not None:
            known = there.select("file_hash", F.struct("created_at", "doc_id").alias("known"))
            own = F.struct("created_at", "doc_id")
            columns = first.columns
            first = (first.join(known, "file_hash", "left")
                     .where(F.col("known").isNull() | (own < F.col("known"))).select(*columns))
        # written before the keys are taken from it: what is there changes with the commit
        folder = versions.new_folder()
        first.write.parquet(f"{path}/{folder}/uploads")
        first = spark.read.parquet(f"{path}/{folder}/uploads")
        versions.commit(path, f"{name}-{batch_id}", {"uploads": first}, first.select("file_hash"), folder)

    return (files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_uploads(spark: SparkSession, path: str) -> DataFrame | None:
    return versions.read(spark, path, "uploads")


def track_statuses(transitions: DataFrame, path: str, checkpoint: str, legal=None, name: str = "stream"):
    """Start a sink that accepts legal status changes only; rejects stay in the table, marked as such.

    A batch meets the states that earlier batches left (:func:`read_states`), so no state is kept in memory,
    and its changes are added to those there (:func:`read_changes`).  The changes are committed
    first and the states after them, both by the batch's name: a batch that failed between the two
    finds the states it began with and leaves its changes once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, run_name = batch.sparkSession, f"{name}-{batch_id}"
        if versions.has_run(spark, f"{path}/states", run_name):
            return
        checked = stored_copy(check_transitions(batch, legal, read_states(spark, path)), "checked")
        versions.commit(f"{path}/changes", run_name, {"changes": checked})
        states = last_accepted(checked)
        versions.commit(f"{path}/states", run_name, {"states": states}, states.select("doc_id"))

    return (transitions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_states(spark: SparkSession, path: str) -> DataFrame | None:
    """The last accepted status of each document: ``doc_id, status``."""
    return versions.read(spark, f"{path}/states", "states")


def read_changes(spark: SparkSession, path: str) -> DataFrame | None:
    """Every change with the state it met and whether it was accepted."""
    return versions.read(spark, f"{path}/changes", "changes")


def run(stream: DataFrame, mode: str = "append", upsert: bool = False) -> DataFrame:
    """Run ``stream`` over its present input in a fresh shared folder; read the result."""
    spark = stream.sparkSession
    root = shared_folder(spark, "stream")
    start = upsert_to if upsert or mode != "append" else append_to
    extra = {"mode": mode} if start is upsert_to else {}
    query = start(stream, f"{root}/out", f"{root}/checkpoint", **extra)
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out")
