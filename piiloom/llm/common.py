"""What several operators share: work folders, learning samples, text batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A-Z to a-z on UTF-8 bytes; no other byte changes.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())

#: Spark makes Bloom filters of joins for inputs of any size, not of 10 GB and more only.
BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
}

#: Shuffle files go when the query that wrote them ends, not when the driver collects its garbage: for
#: chains of stored steps, none of which is run twice.
CLEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, the folder that all executors share.

    Where the setting is absent, a local session gets a folder of this machine
    and any other session an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "piiloom-work")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written to ``folder`` and read again: computed once, kept if executors are lost."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample_ids(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """At most ``per_label`` ids of each label: a bounded learning sample.

    ``rows`` has ``doc_id`` and ``label``.  The rows first by a hash of the id
    are taken, so the sample does not follow the order or layout of the table.
    Rows are first counted by label and size class of the hash (sixteen a power of
    two), so only those up to the class in which the sample ends are ranked: few more
    than the sample, however many rows a label has.  The classes in which samples end
    are one row a label and broadcast, less than the samples that callers hold anyway.
    """
    value = F.xxhash64("doc_id")
    # the order of signed hashes, as a number from 0 to 2^63
    place = F.shiftrightunsigned(value.bitwiseXOR(F.lit(-(1 << 63))), 1)
    rows = rows.select("doc_id", label).where(
        F.col("doc_id").isNotNull() & F.col(label).isNotNull()
    ).withColumn("_class", F.floor(16 * F.log2(place + F.lit(1.0))))
    ahead = Window.partitionBy(label).orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    last = (rows.groupBy(label, "_class").agg(F.count(F.lit(1)).alias("_rows"))
            .withColumn("_before", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)))
            .where(F.col("_before") < per_label)
            .groupBy(label).agg(F.max("_class").alias("_last")))
    order = Window.partitionBy(label).orderBy(value, "doc_id")
    return (rows.join(F.broadcast(last), label).where(F.col("_class") <= F.col("_last"))
            .withColumn("_rank", F.row_number().over(order))
            .where(F.col("_rank") <= per_label).select("doc_id", label))


def blocks(values: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``values`` of about ``limit`` bytes each; a longer value is alone."""
    start, size = 0, 0
    for i, value in enumerate(values):
        if i > start and size + len(value) > limit:
            yield start, i
            start, size = i, 0
        size += len(value)
    if start < len(values):
        yield start, len(values)
