"""Readers and writers for document tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piiloom.functions.columns import with_computed
from piiloom.functions.text import escape_markup, strip_space
from piiloom.sources import versions


def load_documents(spark: SparkSession, path: str, format: str = "parquet",
                   columns=None) -> DataFrame:
    """Documents from a folder.

    ``parquet``, ``json``, ``orc`` and ``csv`` give their own columns; ``text`` gives
    ``path, text`` (one file, one document) and ``binary`` ``path, content,
    file_size, modified_at``.
    """
    if format == "text":
        df = (spark.read.text(path, wholetext=True)
              .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))
    elif format == "binary":
        df = spark.read.format("binaryFile").load(path).select(
            "path", "content", F.col("length").alias("file_size"),
            F.col("modificationTime").alias("modified_at"))
    elif format in ("parquet", "json", "orc", "csv"):
        df = spark.read.format(format).load(path)
    else:
        raise ValueError(f"unknown document format {format!r}")
    return df.select(*columns) if columns else df


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Deal a coarse file scan over all cores; leave a fine one alone.

    Text work is bound by CPU, and a source of fewer splits than cores (one
    large row group, say) would keep most of them idle.  At scale a source has
    far more splits than cores, and no row moves.  ``scan`` must be a plain
    file scan: its splits are known without running a job.
    """
    wanted = 2 * scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(wanted, key) if scan.rdd.getNumPartitions() < wanted else scan


def write_bucketed(docs: DataFrame, table: str, path: str, buckets: int, key: str = "doc_id") -> DataFrame:
    """Store ``docs`` as a catalog table of ``buckets`` by ``key``, one sorted file each; returns the table.

    Texts move once, here.  Joins on ``key`` then bring the other side to the buckets and leave the texts where
    they are (see :func:`piiloom.plans.pipeline.redact_stored`).  Choose ``buckets`` so that one fits a task, some
    hundred megabytes; rows of one key share a bucket, and rows without a key join nothing.
    """
    (docs.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(table))
    return docs.sparkSession.table(table)


def write_redacted(redacted: DataFrame, path: str, suffix: str = ".redacted.txt",
                   run: str | None = None) -> DataFrame:
    """Add one redacted text per document and level to ``path``; returns the records of all in it.

    The run replaces exactly the documents and levels it carries and writes nothing else; see
    :mod:`piiloom.sources.versions`.  A ``run`` by the same name is written once.
    """
    rows = redacted.select(
        "doc_id", F.concat("storage_key", F.lit(suffix)).alias("redacted_key"), "redaction_level",
        "entities_redacted", "redacted_text")
    spark, run = redacted.sparkSession, run or f"run-{uuid.uuid4().hex}"
    if not versions.has_run(spark, path, run):
        # the keys are read back: taking them from ``rows`` would detect and redact once more
        place = versions.new_folder()
        rows.write.parquet(f"{path}/{place}/texts")
        texts = spark.read.schema(rows.schema).parquet(f"{path}/{place}/texts")
        versions.commit(path, run, {"texts": texts}, texts.select("doc_id", "redaction_level"), place)
    return read_redacted(spark, path).drop("redacted_text")


def read_redacted(spark: SparkSession, path: str) -> DataFrame | None:
    """The redacted texts in ``path``, one per document and level; None before the first run."""
    return versions.read(spark, path, "texts")


def redacted_lines(redacted: DataFrame) -> DataFrame:
    """Lines of the redacted text: ``blank``, ``redacted`` or ``body``, markup-escaped.

    A line break at the very end of a text starts no further line.
    """
    breaks = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
    parts = F.split("redacted_text", breaks, -1)
    lines = with_computed(redacted.select("doc_id", "redacted_text"), lines=parts)
    lines = lines.select("doc_id", F.posexplode("lines").alias("line_no", "line"),
                         F.size("lines").alias("n_lines"))
    lines = lines.filter(~((F.col("line_no") == F.col("n_lines") - 1) & (F.col("line") == "")))
    kind = (F.when(strip_space(F.col("line")) == "", F.lit("blank"))
            .when(F.col("line").contains("[REDACTED]") | F.col("line").contains("****"),
                  F.lit("redacted")).otherwise(F.lit("body")))
    return lines.select("doc_id", "line_no", kind.alias("kind"),
                        escape_markup(F.col("line")).alias("safe_text"))
