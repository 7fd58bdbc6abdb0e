"""The learning sample against a plain rank by hash, with a hot label, nulls and no rows."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from piiloom.llm.common import sample_ids


@pytest.mark.parametrize("per_label", [1, 7, 100, 10_000])
def test_sample_equals_the_first_by_hash(spark, per_label):
    rows = (spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, "b")
                                     .otherwise("a").alias("lang"))
            .unionByName(spark.createDataFrame([(None, "a"), (3, None)], "doc_id long, lang string")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    want = (rows.dropna().withColumn("r", F.row_number().over(order))
            .where(F.col("r") <= per_label).select("doc_id", "lang"))
    got = sample_ids(rows, "lang", per_label)
    assert got.columns == ["doc_id", "lang"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_no_rows_no_sample(spark):
    assert sample_ids(spark.createDataFrame([], "doc_id long, lang string"), "lang", 5).count() == 0
