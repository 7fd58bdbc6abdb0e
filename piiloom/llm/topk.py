"""Exact top-k by inner product over KD-trees, one per shard of rows.

Every vector component becomes ``floor(1024 * x)``.  A shard is split at the median of
its widest side down to leaves, and each node keeps the tight bounding box of its
points.  A query goes through the nodes best first, by the largest product that a
point of the box could have; it ends when the best bound left is under its k-th score.
The k-th score is handed on from shard to shard of a task, and starts, for all
tasks, from scores against the first block of queries themselves, which are rows as well.
Queries come in blocks of bounded size, each a broadcast; every block meets every
shard, and of each the k best go on to a partial ranking.

Defined results: rows whose vector is null, empty or holds a null or non-finite
component take no part, nor do rows with a null id as queries; a query is compared with
the rows of its own length only.  Ties go to the smaller id.  Fewer rows than k
give fewer results.  A row repeated under one id is not its own result but each
other row is one.  Scores are exact as long as they fit a long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piiloom.llm.common import stored, work_folder

SCALE = 1024
LEAF = 128
SHARD_ROWS = 8192
QUERY_BLOCK = 1024


def whole_parts(vector: Column) -> Column:
    """``floor(SCALE * x)`` of each component; null where a vector takes no part."""
    wide = vector.cast("array<double>")
    usable = (F.size(wide) > 0) & F.forall(
        wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(wide, lambda x: F.floor(SCALE * x)))


class KdTree:
    """Median splits of the widest side, boxes drawn tight around the points of each node."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        self.low, self.high, self.child, self.span = [], [], [], []

        def grow(first: int, last: int) -> int:
            at = order[first:last]
            box = points[at]
            node = len(self.span)
            self.low.append(box.min(axis=0))
            self.high.append(box.max(axis=0))
            self.span.append((first, last))
            self.child.append(None)
            if last - first > leaf:
                side = int((self.high[node] - self.low[node]).argmax())
                half = (last - first) // 2
                order[first:last] = at[np.argpartition(box[:, side], half)]
                left = grow(first, first + half)
                self.child[node] = (left, grow(first + half, last))
            return node

        grow(0, len(points))
        self.points, self.ids = points[order], ids[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest product each query could have in each box, as (queries, nodes)."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return up @ self.high.T + down @ self.low.T

    def search(self, query: np.ndarray, query_id: int, bound: np.ndarray,
               best: list[tuple[int, int]], k: int) -> None:
        """Improve ``best``, a heap of (score, -id), by the points of this tree."""
        heap = [(-bound[0], 0)]
        while heap:
            most, node = heapq.heappop(heap)
            if len(best) == k and -most < best[0][0]:
                return
            if self.child[node] is None:
                first, last = self.span[node]
                scores = self.points[first:last] @ query
                if len(best) == k:
                    near = np.flatnonzero(scores >= best[0][0])
                else:
                    near = np.arange(last - first)
                for i in near.tolist():
                    vec_id = int(self.ids[first + i])
                    if vec_id == query_id:
                        continue
                    entry = (int(scores[i]), -vec_id)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            else:
                for c in self.child[node]:
                    if len(best) < k or bound[c] >= best[0][0]:
                        heapq.heappush(heap, (-bound[c], c))


def _numbers(points: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles where every product and sum of them is exact, else long integers."""
    most = max(float(np.abs(points).max(initial=0)), float(np.abs(queries).max(initial=0)))
    if most * most * points.shape[1] < 2.0 ** 52:
        return points.astype(np.float64), queries.astype(np.float64)
    return points, queries


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id",
           vector: str = "embedding", shard_rows: int = SHARD_ROWS,
           query_block: int = QUERY_BLOCK, among: bool = True) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for each row of ``queries``.

    ``among``: the queries are rows of ``vectors`` themselves, so their scores against each
    other bound the k-th score from below.
    """
    spark = vectors.sparkSession
    folder = work_folder(spark, "topk")
    shaped = [F.col(key).cast("bigint").alias("id"), whole_parts(F.col(vector)).alias("v")]
    rows = stored(vectors.select(*shaped).where("id IS NOT NULL AND v IS NOT NULL"), f"{folder}/rows")
    asked = queries.select(*shaped).where("id IS NOT NULL AND v IS NOT NULL")
    # blocks of about query_block queries, by hash; each block is read by itself and broadcast
    total = asked.count()
    blocks = max(1, -(-total // query_block))
    asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")),
                   f"{folder}/queries")
    out = None
    for block in range(blocks):
        table = asked.where(F.col("block") == block).select("id", "v").toArrow()
        by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        ids = np.array(table["id"].to_pylist(), dtype=np.int64)
        size = np.array([len(x) for x in table["v"].to_pylist()], dtype=np.int64)
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            part = np.array(table["v"].take(pa.array(at)).to_pylist(), dtype=np.int64).reshape(-1, n)
            by_size[n] = (ids[at], part)
        sent = spark.sparkContext.broadcast({n: (i, q, _floor(i, q, k, among)) for n, (i, q) in by_size.items()})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best = {n: [[] for _ in i] for n, (i, _, _) in sent.value.items()}
            for part in _shards(batches, shard_rows):
                for n, (points, point_ids) in part.items():
                    if n not in sent.value:
                        continue
                    query_ids, wanted, floor = sent.value[n]
                    points, wanted = _numbers(points, wanted)
                    tree = KdTree(points, point_ids)
                    bound = tree.bounds(wanted)
                    for q in range(len(wanted)):
                        heap = best[n][q]
                        if len(heap) < k and bound[q, 0] < floor[q]:
                            continue
                        # boxes under the floor cannot hold any of the k best of all rows
                        row = np.where(bound[q] < floor[q], -np.inf, bound[q])
                        tree.search(wanted[q], int(query_ids[q]), row, heap, k)
            found = [(int(sent.value[n][0][q]), -i, s) for n, heaps in best.items()
                     for q, heap in enumerate(heaps) for s, i in heap]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[c] for f in found], pa.int64()) for c in range(3)],
                ["query_id", "vec_id", "score"])

        part = rows.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _floor(ids: np.ndarray, queries: np.ndarray, k: int, among: bool) -> np.ndarray:
    """A lower bound of each query's k-th score, from the other queries of its block."""
    _, wide = _numbers(queries, queries)
    scores = (wide @ wide.T).astype(np.float64)
    scores[ids[:, None] == ids[None, :]] = -np.inf
    if len(ids) <= k or not among:
        return np.full(len(ids), -np.inf)
    # one unit lower where doubles may have rounded a larger score
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    return np.where(np.abs(kth) < 2.0 ** 52, kth, kth - np.abs(kth) * 2.0 ** -50)


def _shards(batches: Iterator[pa.RecordBatch],
            rows: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Rows by vector length, in shards of at most ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        for s in range(0, batch.num_rows, rows):
            part = batch.slice(s, rows)
            if count + part.num_rows > rows:
                yield _by_size(held)
                held, count = [], 0
            held.append(part)
            count += part.num_rows
    if held:
        yield _by_size(held)


def _by_size(held: list[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    table = pa.Table.from_batches(held)
    ids = table["id"].to_numpy()
    lists = table["v"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy()
    size = np.diff(lists.offsets.to_numpy())
    start = np.cumsum(size) - size
    out = {}
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        out[n] = (flat[start[at][:, None] + np.arange(n)].astype(np.int64), ids[at])
    return out
