"""Status changes checked against a table of legal steps.

Whether a change is accepted depends on the last accepted one before it, so a document's changes have to be
taken in order.  A change is a function from state to state, though, and functions compose: changes are
dealt by ranges of (document, time, number), cut into blocks of ``BLOCK``, and each block becomes the state
in which it ends for every state in which it may begin.  These small rows, a few per document, give the
state at the start of each block, and then every block is walked on its own.  A document with
a third of all changes is spread over as many tasks as its changes fill.

Defined results: a null or unknown status is rejected; changes at the same time are taken by ``seq``, nulls
first; a null ``doc_id`` is a document like another; repeated rows are changes like others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piiloom import rules as R
from piiloom.session import stored_copy

BLOCK = 500
#: Before the first accepted change.
NEW = ""


def _step(legal: Mapping[str, Sequence[str]]):
    steps = F.array(*[F.lit(f"{a}>{b}") for a, after in legal.items() for b in after])
    return lambda state, status: F.coalesce(F.array_contains(steps, F.concat(state, F.lit(">"), status)), F.lit(False))


def check_transitions(transitions: DataFrame, legal: Mapping[str, Sequence[str]] | None = None,
                      states: DataFrame | None = None) -> DataFrame:
    """``doc_id, ts, seq, status, from_status, accepted`` of every change.

    ``legal`` gives the statuses that may follow each status, with ``NEW`` for a document without any; ``states``
    (``doc_id, status``, one row each) the states in which documents are before the first change.
    """
    legal = R.NEXT_STATUSES if legal is None else legal
    is_legal = _step(legal)
    known = sorted({NEW, *legal, *(s for after in legal.values() for s in after)})
    begin = F.array(*[F.lit(s) for s in known])

    # stored, so that a lost executor does not deal the changes anew
    ranged = stored_copy(transitions.select("doc_id", "ts", "seq", "status")
                         .repartitionByRange("doc_id", "ts", "seq")
                         .withColumn("part", F.spark_partition_id()), "changes")
    order = Window.partitionBy("part", "doc_id").orderBy("ts", "seq", "status")
    change = F.struct("ts", "seq", "status")
    blocks = (ranged.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK))
              .groupBy("doc_id", "part", "block").agg(F.array_sort(F.collect_list(change)).alias("changes")))
    ends = F.aggregate("changes", begin, lambda ends, c: F.transform(
        ends, lambda s: F.when(is_legal(s, c["status"]), c["status"]).otherwise(s)))
    blocks = stored_copy(blocks.withColumn("ends", ends), "blocks")

    chains = blocks.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("part", "block", "ends"))).alias("chain"))
    if states is None:
        chains = chains.withColumn("state", F.lit(NEW))
    else:
        before = states.select(F.col("doc_id").alias("_id"), F.col("status").alias("state"))
        chains = (chains.join(before, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
                  .withColumn("state", F.coalesce("state", F.lit(NEW))))
    # the state at the start of each block, as a running list
    ended = lambda s, b: F.coalesce(F.get(b["ends"], F.array_position(begin, s).cast("int") - 1), s)
    starts = F.aggregate("chain", F.array("state"),
                         lambda acc, b: F.concat(acc, F.array(ended(F.element_at(acc, -1), b))))
    starts = (chains.withColumn("starts", starts)
              .select(F.col("doc_id").alias("_id"), F.inline(F.arrays_zip("chain", "starts")))
              .where(F.col("chain").isNotNull())
              .select("_id", F.col("chain.part").alias("_part"), F.col("chain.block").alias("_block"),
                      F.col("starts").alias("state")))
    own = blocks.join(starts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_part"))
                      & (F.col("block") == F.col("_block")))
    return own.select("doc_id", F.inline(_walk(is_legal)))


def _walk(is_legal) -> Column:
    """The changes of a block with the state before each and whether it is accepted."""
    row = "ts timestamp_ntz, seq bigint, status string, from_status string, accepted boolean"
    begin = F.struct(F.col("state").alias("state"), F.from_json(F.lit("[]"), f"array<struct<{row}>>").alias("rows"))

    def step(acc, c):
        good = is_legal(acc["state"], c["status"])
        line = F.struct(c["ts"].cast("timestamp_ntz").alias("ts"), c["seq"].cast("long").alias("seq"),
                        c["status"].alias("status"), acc["state"].alias("from_status"), good.alias("accepted"))
        return F.struct(F.when(good, c["status"]).otherwise(acc["state"]).alias("state"),
                        F.concat(acc["rows"], F.array(line)).alias("rows"))

    return F.aggregate("changes", begin, step, lambda acc: acc["rows"])


def last_accepted(checked: DataFrame) -> DataFrame:
    """``doc_id, status`` after the accepted changes; documents without any have no row."""
    return (checked.where("accepted").groupBy("doc_id")
            .agg(F.max_by("status", F.struct("ts", "seq")).alias("status")))
