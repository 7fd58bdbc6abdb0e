"""Exact de-duplication by a stateful stream.

The state is keyed by digest, lives on disk in the RocksDB store of Structured
Streaming and never expires.  Per digest it retains the stable identifier (the
largest id so far), the content locator (the row of the stored arrivals that
holds those bytes) and a count.  A stream that goes on in the same folder meets
all that came before.  Rows are counted in each task before they move, so one text
with a third of all rows sends a row per task.  A hit is believed only after the
full bytes are compared with those at the locator; rows that share a digest but
not the bytes are grouped by the bytes.

Defined results: a null text counts as empty, and all empty texts are one group.
Of equal texts the row with the largest id stays, a null id being the smallest;
of rows with that same id and text one stays, and each is returned and counted.
An empty table gives no rows.  Other columns are passed over, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from piiloom.llm.common import BLOOM, lower_ascii, settings, stored, work_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of the state store for the time the stream runs.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: Arrivals for one partition of the state; every partition costs its store's fixed files.
ROWS_PER_STATE = 1_000_000


def digest_of(text: Column) -> Column:
    """SHA-256 of the normalised text, in hex."""
    return F.sha2(lower_ascii(text), 256)


def arrivals(docs: DataFrame, folder: str,
             digest: Callable[[Column], Column] = digest_of) -> DataFrame:
    """The rows of ``docs`` stored narrow, with a row number and digests: what the stream reads.

    The number is taken once and then read from the table, so it names a row
    whatever happens to the tasks that made it.
    """
    return stored(docs.select(
        F.col("doc_id"), F.monotonically_increasing_id().alias("row"),
        digest(F.col("text")).alias("digest"),
        digest_of(F.col("text")).alias("text_sha256")), folder)


def stream_state(spark: SparkSession, source: str, folder: str,
                 files_per_batch: int = 10_000) -> DataFrame:
    """Run the stream over all arrivals in ``source`` that it has not seen, and return the state.

    ``digest, keep_id, locator, group_size``.  Every micro-batch writes the keys
    it changed; a repeated batch overwrites its own folder, and of several
    versions of a key the last counts.  The state has a partition per ``ROWS_PER_STATE``
    arrivals of the first run, at least one per core, and keeps that number in its checkpoint.
    """
    narrow = spark.read.parquet(source).select("doc_id", "row", "digest")
    parts = max(spark.sparkContext.defaultParallelism, -(-narrow.count() // ROWS_PER_STATE))
    with settings(spark, {**STORE, "spark.sql.streaming.internal.stateStore.partitions": str(parts)}):
        held = (spark.readStream.schema(narrow.schema)
                .option("maxFilesPerTrigger", files_per_batch).parquet(source)
                .groupBy("digest")
                .agg(F.max(F.struct("doc_id", "row")).alias("first"),
                     F.count(F.lit(1)).alias("group_size")))

        def put(changed: DataFrame, batch: int) -> None:
            (changed.select("digest", F.col("first.doc_id").alias("keep_id"),
                            F.col("first.row").alias("locator"), "group_size")
             .write.mode("overwrite").parquet(f"{folder}/state/batch={batch}"))

        query = (held.writeStream.outputMode("update").foreachBatch(put)
                 .option("checkpointLocation", f"{folder}/checkpoint")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    versions = spark.read.schema(
        f"digest string, keep_id {id_type}, locator bigint, group_size bigint, batch bigint"
    ).parquet(f"{folder}/state")
    return versions.groupBy("digest").agg(
        F.max_by(F.struct("keep_id", "locator", "group_size"), "batch").alias("s")
    ).select("digest", "s.*")


def unlike_bytes(docs: DataFrame, state: DataFrame, folder: str,
                 digest: Callable[[Column], Column] = digest_of) -> DataFrame:
    """The hits whose full bytes are not those held for their digest: ``digest, doc_id, bytes``.

    Only texts whose digest occurs more than once are moved: a Bloom filter of
    those digests, which Spark makes of the join, thins the scan.
    """
    spark = docs.sparkSession
    several = state.where("group_size > 1").select("digest", "keep_id")
    texts = docs.select("doc_id", lower_ascii(F.col("text")).alias("bytes"),
                        digest(F.col("text")).alias("digest"))
    with settings(spark, BLOOM):
        hits = stored(texts.join(several, "digest"), f"{folder}/hits")
    held = (hits.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
            .groupBy("digest").agg(F.min("bytes").alias("held")))
    held = stored(held, f"{folder}/held")  # a join of two stored sides may be split where a digest is hot
    return stored(hits.select("digest", "doc_id", "bytes").join(held, "digest")
                  .where("bytes <> held").select("digest", "doc_id", "bytes"), f"{folder}/unlike")


def find_copies(docs: DataFrame, digest: Callable[[Column], Column] = digest_of,
                folder: str | None = None) -> DataFrame:
    """Every row: ``doc_id, row, digest, text_sha256, keep_id, locator, group_size, kept``."""
    spark = docs.sparkSession
    folder = folder or work_folder(spark, "dedup")
    found = arrivals(docs, f"{folder}/arrivals", digest)
    state = stored(stream_state(spark, f"{folder}/arrivals", folder), f"{folder}/groups")
    unlike = unlike_bytes(docs, state, folder, digest)
    if unlike.isEmpty():
        return found.join(state, "digest").withColumn("kept", F.col("row") == F.col("locator"))
    # several texts under one digest: those unlike the held one are groups by their bytes
    unlike = unlike.withColumn("text_sha256", digest_of(F.col("bytes")))
    fewer = unlike.groupBy("digest").agg(F.count(F.lit(1)).alias("less"))
    key = unlike.select("digest", "text_sha256", F.struct("doc_id").alias("id"), "bytes").distinct()
    marked = found.withColumn("id", F.struct("doc_id"))
    on = ["digest", "text_sha256", "id"]
    like = marked.join(key, on, "left_anti").drop("id")
    first = like.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("first"))
    like = (like.join(state.select("digest", "group_size"), "digest").join(fewer, "digest", "left")
            .join(first, "digest")
            .withColumn("group_size", F.col("group_size") - F.coalesce("less", F.lit(0))))
    apart = marked.join(key, on).drop("id")
    split = apart.groupBy("bytes").agg(F.max(F.struct("doc_id", "row")).alias("first"),
                                       F.count(F.lit(1)).alias("group_size"))
    columns = ["doc_id", "row", "digest", "text_sha256", F.col("first.doc_id").alias("keep_id"),
               F.col("first.row").alias("locator"), "group_size"]
    return (like.select(*columns).unionByName(apart.join(split, "bytes").select(*columns))
            .withColumn("kept", F.col("row") == F.col("locator")))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another row, with a larger id, has as well.

    Rows are found by digest and id together, so a text with very many copies
    is no hot key; of rows repeated with one id, one is returned.
    """
    folder = work_folder(docs.sparkSession, "dedup")
    kept = find_copies(docs, folder=folder).where("kept").select(
        F.struct(F.col("text_sha256").alias("digest"), F.col("doc_id").alias("id")).alias("_kept"))
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    rows = docs.select(F.struct(digest_of(F.col("text")).alias("digest"),
                                F.col("doc_id").alias("id")).alias("_kept"),
                       *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    return (rows.join(stored(kept, f"{folder}/kept"), "_kept", "left_semi")
            .dropDuplicates(["_kept"])
            .select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)]))
