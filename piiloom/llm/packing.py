"""Best-fit packing into bins of several permitted sequence lengths.

Documents longer than the largest capacity are cut into pieces of that length.
Pieces of a shard are taken longest first; each goes into the open bin with the
least room that holds it.  If none does, a bin is opened whose capacity costs
least per position that can be filled: the piece itself and, up to the room left,
pieces still to come that are short enough.  At the end each bin is downsized to
the least permitted length that holds its contents.  Shards are dealt by a hash of
document and piece and hold at most about ``pieces_per_shard`` pieces, so no task grows
with the input and equal ids do not meet in one.

Defined results: a null or empty text has length 0 and takes a place of length 0 in
no bin (bin null, capacity 0).  Ties go to the bin opened first and the piece
with the smaller id.  Repeated rows are packed as often as they come.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piiloom.llm.common import stored, work_folder

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Cost of a bin: its positions and a fixed share for one more sequence in a batch.
FIXED_COST = 16


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES,
             fixed_cost: float = FIXED_COST) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece (in the given order, longest first), and final capacities."""
    sizes = sorted(capacities)
    down = np.asarray(lengths, dtype=np.int64)
    rest = np.concatenate([np.cumsum(down[::-1])[::-1], [0]]).tolist()
    rising = (-down).tolist()  # ascending, for bisection
    open_rooms: list[tuple[int, int]] = []  # (room, bin), ascending
    size_of: list[int] = []
    used: list[int] = []
    bin_of, offset = [], []
    for i, n in enumerate(down.tolist()):
        at = bisect.bisect_left(open_rooms, (n, -1))
        if at < len(open_rooms):
            room, b = open_rooms.pop(at)
        else:
            best = None
            for c in sizes:
                if c >= n:
                    room = c - n
                    later = max(i + 1, bisect.bisect_left(rising, -room))
                    price = (c + fixed_cost) / (n + min(room, rest[later]))
                    if best is None or price < best[0]:
                        best = (price, c)
            b, room = len(size_of), best[1]  # type: ignore[index]
            size_of.append(room)
            used.append(0)
        bin_of.append(b)
        offset.append(used[b])
        used[b] += n
        if room > n:
            bisect.insort(open_rooms, (room - n, b))
    final = [sizes[bisect.bisect_left(sizes, u)] for u in used]
    return bin_of, offset, final


def words_and_end(text: Column) -> Column:
    """Words of white space and one end mark; 0 for null and blank texts.

    Words are counted as the places where a word begins, by lengths of the text with
    and without them, so no list of words is made.
    """
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    words = F.length(spaced) - F.length(F.translate(spaced, " ", "")) + 1
    return F.when(spaced == "", 0).otherwise(words + 1).cast("bigint")


def pack(docs: DataFrame, length: Column | None = None, capacities: Sequence[int] = CAPACITIES,
         pieces_per_shard: int = 50_000, fixed_cost: float = FIXED_COST) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, shard, bin, offset, capacity, bin_used``.

    ``length``: positions of a document (a column over ``docs``), words and an end mark unless given.
    """
    top = max(capacities)
    measured = docs.select(
        "doc_id", F.coalesce(length if length is not None else words_and_end(F.col("text")),
                             F.lit(0)).cast("bigint").alias("n"))


    measured = stored(measured, work_folder(docs.sparkSession, "lengths"))
    total = measured.agg(F.sum(F.ceil(F.col("n") / top))).first()[0] or 0
    shards = max(1, -(-int(total) // pieces_per_shard))
    pieces = (measured.where("n > 0")
              .withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / top).cast("int") - 1)))
              .withColumn("start", F.col("piece").cast("bigint") * top)
              .withColumn("length", F.least(F.lit(top).cast("bigint"), F.col("n") - F.col("start")))
              .withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(shards)).cast("int"))
              .drop("n"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {id_type}, piece int, start bigint, length bigint, shard int, "
              "bin int, offset bigint, capacity int, bin_used bigint")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True])
        bin_of, offset, final = best_fit(group["length"].to_numpy(), capacities, fixed_cost)
        used = np.bincount(bin_of, weights=group["length"], minlength=len(final)).astype(np.int64)
        return group.assign(bin=bin_of, offset=offset, capacity=np.array(final)[bin_of],
                            bin_used=used[bin_of])

    packed = pieces.groupBy("shard").applyInPandas(run, schema)
    empty = measured.where("n = 0").select(
        "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"),
        F.lit(0).cast("bigint").alias("length"), F.lit(None).cast("int").alias("shard"),
        F.lit(None).cast("int").alias("bin"), F.lit(None).cast("bigint").alias("offset"),
        F.lit(0).alias("capacity"), F.lit(0).cast("bigint").alias("bin_used"))
    return packed.unionByName(empty)
