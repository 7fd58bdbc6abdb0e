"""Quality classifier: neighbours vote in a latent-semantic space.

A text is counts of hashed three-byte grams and of hashed four-grams of its
character kinds (letter, digit, space, line break, mark, other).  Damped,
idf-weighted counts of a bounded labelled sample give a truncated singular value
decomposition; a text's vector is its projection.  Cosines with all labelled
vectors, which are broadcast, are one exact matrix product per block of
documents, and the nearest vote, weighted by similarity.

Defined results: null and empty texts have no grams and score the share of label 1
in the (balanced) sample's vote, 0.5; without labels of both kinds everything
scores 0.5 or the one label known.  Ties between neighbours go to the one first in
the order of the sample's id hash.  Texts are counted whole, in pieces of bounded
size.  Rows with null ids or labels teach nothing; of contradicting labels of one
id the larger counts.  Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from piiloom.llm.common import LOWER_BYTES, blocks, fold, sample_ids

GRAMS = 1536
SHAPES = 512
SIZE = GRAMS + SHAPES
_PIECE = 4_000_000


def _kinds() -> np.ndarray:
    kind = np.full(256, 5, dtype=np.uint32)  # marks
    for b in range(256):
        c = chr(b)
        if b >= 128:
            kind[b] = 1  # bytes of other letters
        elif c.isalpha():
            kind[b] = 1 if c.islower() else 2
        elif c.isdigit():
            kind[b] = 3
        elif c in " \t":
            kind[b] = 4
        elif c in "\n\r":
            kind[b] = 6
        elif c in ".,;:!?'\"-()":
            kind[b] = 7
    kind[0] = 0
    return kind


KIND = _kinds()
_LOWER = np.frombuffer(LOWER_BYTES, dtype=np.uint8)


def counts(texts: list[bytes]) -> np.ndarray:
    """Gram counts of each text, one row each."""
    out = np.zeros((len(texts), SIZE), dtype=np.float32)
    for first, last in blocks(texts, 400_000):
        joined = b"\0\0\0".join(texts[first:last]) + b"\0\0\0"
        size = np.fromiter(map(len, texts[first:last]), dtype=np.int64, count=last - first) + 3
        if len(joined) > _PIECE:  # one very long text
            for s in range(0, len(joined), _PIECE):
                out[first] += _count(joined[s:s + _PIECE + 3], np.zeros(1, np.int64),
                                     np.array([min(_PIECE, len(joined) - s)]))[0]
            continue
        out[first:last] = _count(joined, np.arange(last - first), size)
    return out


def _count(data: bytes, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Grams that start within the first ``sum(size)`` bytes."""
    raw = np.frombuffer(data, dtype=np.uint8)
    n = len(rows)
    owner = np.repeat(rows * SIZE, size)[:max(len(raw) - 3, 0)]
    low = _LOWER[raw].astype(np.uint32)
    kind = KIND[raw]
    m = len(owner)
    gram = (low[:m] << 16) | (low[1:m + 1] << 8) | low[2:m + 2]
    gram = (gram * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(GRAMS)
    shape = (kind[:m] << 9) | (kind[1:m + 1] << 6) | (kind[2:m + 2] << 3) | kind[3:m + 3]
    shape = (shape * np.uint32(2246822519) >> np.uint32(8)) % np.uint32(SHAPES)
    real = raw[:m] != 0
    total = np.bincount((owner + gram)[real], minlength=n * SIZE)
    total += np.bincount((owner + GRAMS + shape)[real], minlength=n * SIZE)
    return total.reshape(n, SIZE).astype(np.float32)


@dataclass
class Voter:
    """``weight``: idf; ``axes``: projection; ``vectors`` and ``labels``: the labelled sample."""

    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    @staticmethod
    def weighted(count: np.ndarray, weight: np.ndarray) -> np.ndarray:
        x = np.log1p(count) * weight
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(length > 0, length, 1)

    @classmethod
    def fit(cls, count: np.ndarray, labels: np.ndarray, dims: int, neighbours: int) -> Voter:
        if not len(labels):
            none = np.zeros((0, dims), np.float32)
            return cls(np.ones(SIZE, np.float32), np.zeros((SIZE, dims), np.float32), none,
                       np.zeros(0, np.float32), neighbours)
        weight = np.log((1 + len(count)) / (1 + (count > 0).sum(axis=0))).astype(np.float32) + 0.1
        x = cls.weighted(count, weight)
        _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        axes = vectors[:, ::-1][:, :dims].astype(np.float32)
        return cls(weight, axes, cls.unit(x @ axes), labels.astype(np.float32), neighbours)

    @staticmethod
    def unit(v: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(v, axis=1, keepdims=True)
        return (v / np.where(length > 0, length, 1)).astype(np.float32)

    def score(self, count: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among the nearest, drawn a little towards one half."""
        k = min(self.neighbours, len(self.labels))
        if not k:
            return np.full(len(count), 0.5)
        cosine = self.unit(self.weighted(count, self.weight) @ self.axes) @ self.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < cosine.shape[1] else (
            np.broadcast_to(np.arange(k), (len(count), k)))
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** 4
        votes = (weight * self.labels[near]).sum(axis=1)
        return np.clip((votes + 0.005) / (weight.sum(axis=1) + 0.01), 0.0, 1.0)


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0,
          per_label: int = 1000, dims: int = 64, neighbours: int = 15) -> Voter:
    """Fit on at most ``per_label`` texts of each label outside the held-out fold."""
    rows = (labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
            .where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
            .groupBy("doc_id").agg(F.max("quality").alias("quality")))
    ids = sample_ids(rows, "quality", per_label)
    texts = (docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
             .where(F.col("text").isNotNull())
             .join(F.broadcast(ids), "doc_id").select("doc_id", "quality", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = counts(batch.column(2).to_pylist()).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([x.tobytes() for x in found], pa.binary())], ["id", "quality", "count"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(run, f"id {kind}, quality int, count binary").toPandas()
    found = found.drop_duplicates("id").sort_values("id")
    count = (np.stack([np.frombuffer(x, np.float32) for x in found["count"]]) if len(found)
             else np.zeros((0, SIZE), np.float32))
    return Voter.fit(count, found["quality"].to_numpy(), dims, neighbours)


def classify(docs: DataFrame, voter: Voter, block: int = 256) -> DataFrame:
    """``docs`` with ``score`` appended; only ``text`` is read for it."""
    held = docs.sparkSession.sparkContext.broadcast(voter)
    plain = [c for c in docs.columns if c != "score"]
    source = docs.select(*plain)
    schema = T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType())])
    at = plain.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for s in range(0, batch.num_rows, block):
                part = batch.slice(s, block)
                texts = [x or b"" for x in part.column(at).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(model.score(counts(texts)), pa.float64())],
                    [*part.schema.names, "score"])

    return source.mapInArrow(run, schema)
