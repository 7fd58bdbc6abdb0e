"""Connected components of links by alternating large and small stars, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piiloom.llm.common import stored


def are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs (``u``) on one node (``v``) at most and such a node on none."""
    sides = edges.select(F.col("u").alias("node"), F.lit(1).alias("ends")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("ends")))
    mixed = (sides.groupBy("node").agg(F.sum("ends").alias("hangs"), F.min("ends").alias("least"))
             .where("hangs > 1 OR hangs = 1 AND least = 0"))
    return mixed.agg(F.count(F.lit(1))).first()[0] == 0


def components(links: DataFrame, folder: str) -> DataFrame:
    """``node, component`` (the least node reachable) of every node that ``links`` (a, b) touches.

    Each round hangs the larger neighbours, then the smaller, of every node on the
    least one, until only stars are left; the rounds grow with the logarithm of
    the longest path.  Least neighbours are partial aggregates and the joins back
    may be split by adaptive execution, so a node of very many links is no hot task.
    """
    edges = stored(links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{folder}/cc0")
    n = 0
    while True:
        n += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = stored(large, f"{folder}/cc{n}large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(),
                       f"{folder}/cc{n}")
        if are_stars(edges):
            break
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
