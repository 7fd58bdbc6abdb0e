"""The corpus pipeline: documents of known language and good quality, without copies, packed.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it
kept.  Stages but the last return the columns of ``documents``; the last returns the
places of the pieces in their bins.  Empty inputs give empty outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from piiloom.llm import dedup, langid, neardup, packing, quality
from piiloom.llm.common import read_table, work_folder

QUALITY_THRESHOLD = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose language cannot be told: no text, or not a letter in it."""
    found = langid.identify(docs, langid.learn(docs))
    return found.where(found["lang_pred"] != langid.UNDETERMINED).select(*docs.columns)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that the neighbours of the labelled sample vote to be of low quality."""
    voter = quality.learn(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.classify(docs, voter)
    return scored.where(scored["score"] >= QUALITY_THRESHOLD).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    return dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share four fifths of their five-word shingles, and of those linked by such, one row."""
    return neardup.keep_one(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of every piece of every document."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", filter_quality),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("best-fit packing", pack_documents),
]

#: Learned models and bin packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each stored and read again for the next."""
    docs = read_table(spark, sf_dir, "documents")
    folder = work_folder(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/stage{n}")
        docs = spark.read.parquet(f"{folder}/stage{n}")
    return docs
