"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Each source has a weight.  All words together are dealt to the sources in proportion
to their weights; a source whose share would be more than ``epochs`` times its size
is clamped there, and what it leaves is dealt to the others by weight, round by
round, until none is above its cap.  A round is one sum over the stored source table and
a single number: the level, in words for each unit of weight.  Levels only rise, so a
clamped source stays clamped and rounds end, usually after three or four.

A source is then taken in whole repetitions and a fractional one.  For the fractional one
its documents stand in the order of a seeded digest and are taken up to the words
that remain.  Digests are cut into ``BINS`` bins, whose words are summed first, so only the
documents of the one bin in which the words run out are put in order, however many a
source has.  What is taken differs from the target by at most half of one document.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is
a source of its own, the last in order; a null id counts as an empty one.  Rows that
repeat stand beside each other and are taken as often as they come, the last
perhaps without its equal.  An empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piiloom.llm.common import stored, work_folder

WORD = r"[^\x20\x09-\x0D]+"
#: Parts of the range of digests; and hexadecimal digits that number them, and those that order documents.
BINS, BIN_DIGITS, PLACE_DIGITS = 4096, 3, 15


def word_count(text: Column) -> Column:
    """Number of runs without white space: each is replaced by one mark, and marks are counted."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    spaced = F.trim(marks)
    return F.when(spaced == "", 0).otherwise(
        F.length(spaced) - F.length(F.replace(spaced, F.lit(" "))) + 1).cast("long")


def digest(seed: str) -> Column:
    """A digest of seed, id and text; equal rows have equal ones."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                          F.lit(":"), F.coalesce("text", F.lit(""))))


def measure(docs: DataFrame, seed: str, folder: str) -> DataFrame:
    """``doc_id, source, size, bin, place`` of every document, stored."""
    marked = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                         digest(seed).alias("mark"))
    number = lambda digits: F.conv(F.substring("mark", 1, digits), 16, 10).cast("long")
    return stored(marked.select("doc_id", "source", "size", number(BIN_DIGITS).cast("int").alias("bin"),
                                number(PLACE_DIGITS).alias("place")), folder)


def source_sizes(measured: DataFrame) -> DataFrame:
    return measured.groupBy("source").agg(F.sum("size").alias("source_size"))


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...], folder: str) -> DataFrame:
    """Weights dealt in turn to sources by code point, null last.

    The order is found without one task for all sources: sources are range-partitioned, numbered
    in their partition, and shifted by the rows of the partitions before (one row each).
    """
    parts = sources.sparkSession.conf.get("spark.sql.shuffle.partitions")
    order = F.asc_nulls_last("source")
    placed = stored(sources.repartitionByRange(int(parts), order)
                    .withColumn("_part", F.spark_partition_id()), folder)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    turn = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    numbered = placed.withColumn("_turn", turn).join(shifts, "_part")
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    return numbered.select("source", "source_size", F.element_at(
        cycle, (F.pmod(F.col("_turn") + F.col("_shift"), F.lit(len(weights))) + 1).cast("int")).alias("weight"))


def water_level(sources: DataFrame, epochs: int) -> Fraction:
    """Words for each unit of weight among the sources below their caps; exact.

    ``sources``: ``source_size`` and whole, positive ``weight``.  Where every source is clamped, the
    level of the last round is still at or above each one's cap.
    """
    size, weight = F.col("source_size").cast("decimal(19,0)"), F.col("weight").cast("decimal(19,0)")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = Fraction(-1)
    while True:
        # a source is clamped if epochs * size <= level * weight
        clamped = (size * F.lit(epochs * level.denominator).cast("decimal(19,0)")
                   <= weight * F.lit(level.numerator).cast("decimal(19,0)"))
        taken, left = sources.agg(
            F.sum(F.when(clamped, size * epochs)), F.sum(F.when(~clamped, weight))).first()
        if not left:
            return max(level, Fraction(0))
        risen = Fraction(int(total) - int(taken or 0), int(left))
        if risen == level:
            return level
        level = risen


def with_targets(sources: DataFrame, level: Fraction, epochs: int) -> DataFrame:
    """Add ``target``: the level times the weight, or the cap where that is less.

    The product is a whole number and is divided once, so the result does not depend on the order of sums.
    """
    share = (F.col("weight") * F.lit(level.numerator)).cast("double") / F.lit(float(level.denominator))
    return sources.withColumn("target", F.least(share, (F.col("source_size") * epochs).cast("double")))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def with_ends(measured: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources with ``whole`` repetitions, ``rest`` (words of the fractional one), ``last_bin`` in which these
    run out, and ``before``, the words of the bins before that."""
    plan = sources.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(0).cast("long").alias("whole"))
    plan = plan.withColumn("rest", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double"))
    rising = Window.partitionBy("source").orderBy("bin")
    bins = (measured.groupBy("source", "bin").agg(F.sum("size").alias("words"))
            .withColumn("upto", F.sum("words").over(rising)))
    reached = bins.join(plan.select("source", "rest"), _same(bins, plan)).where(F.col("upto") > F.col("rest"))
    last = reached.groupBy(bins["source"]).agg(
        F.min_by(F.struct("bin", (F.col("upto") - F.col("words")).alias("before")), "bin").alias("end"))
    return plan.join(last, _same(plan, last), "left").select(
        plan["source"], "source_size", "target", "whole", "rest",
        F.coalesce("end.bin", F.lit(BINS)).alias("last_bin"), F.coalesce("end.before", F.lit(0)).alias("before"))


def repetitions(measured: DataFrame, plan: DataFrame) -> DataFrame:
    """Documents with ``taken``: words in whole repetitions, and in the fractional one if it reaches the document.

    ``plan`` is a stored table, so Spark knows its size and broadcasts it only if that is small.  Beyond that,
    documents of last bins meet it by source and bin, and only they are moved by source for the running
    sum; the join of all others ends its stage, so adaptive execution may split a large source.
    """
    columns = ["doc_id", measured["source"], "size", "source_size", "target", "whole"]
    others = (measured.join(plan, _same(measured, plan)).where(F.col("bin") != F.col("last_bin"))
              .select(*columns, (F.col("bin") < F.col("last_bin")).cast("long").alias("more")))
    inside = Window.partitionBy("source").orderBy("place", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ending = measured.join(plan, _same(measured, plan) & (F.col("bin") == F.col("last_bin"))).select(
        *columns, "place", "rest", "before").withColumn("upto", F.col("before") + F.sum("size").over(inside))
    # half of a document may be over what remains, not more
    more = (F.col("upto") - F.col("size") / 2.0 <= F.col("rest")).cast("long")
    names = ["doc_id", "source", "size", "source_size", "target", "whole"]
    return (others.unionByName(ending.select(*names, more.alias("more")))
            .withColumn("taken", F.col("size") * (F.col("whole") + F.col("more"))))


def mix(docs: DataFrame, weights: DataFrame | None = None, cycle: tuple[int, ...] = (1, 2, 3),
        epochs: int = 3, seed: str = "mix") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, whole, more`` for every document.

    ``weights``: rows of ``source, weight`` with whole positive weights, one for each source; without it
    the weights of ``cycle`` are dealt in turn.  All sources together are given as many words as ``docs`` has.
    """
    folder = work_folder(docs.sparkSession, "mixing")
    measured = measure(docs, seed, f"{folder}/measured")
    sources = source_sizes(measured)
    if weights is None:
        sources = cyclic_weights(sources, cycle, f"{folder}/placed")
    else:
        named = weights.select(F.col("source").alias("_source"), F.col("weight").cast("long").alias("weight"))
        sources = sources.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    sources = stored(sources, f"{folder}/sources")
    targets = with_targets(sources, water_level(sources, epochs), epochs)
    return repetitions(measured, stored(with_ends(measured, targets), f"{folder}/plan"))
