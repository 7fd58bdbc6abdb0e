"""Token counts of sections by offsets: each document is encoded once, as a whole.

A record is the named fields, joined by line breaks; its sections are the fields, or
the lines of each field, with the break that ends them, so the sections tile the record.
Every token has a span of characters: those any of its bytes belongs to.  Spans are
joined with the sections' intervals by binary search, and a token that reaches over a
boundary is allocated by ``RULES``: to the section with ``most`` of its characters (the
earlier of equals), or to the ``first`` or ``last`` it touches.  Every token is counted once,
so a record's counts add up to its length in tokens.

Defined results: a null field counts as empty; an empty record is one section of no
tokens.  Bytes that belong to one character and several tokens put that character into
the span of each.  Texts are encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("most", "first", "last")


def encoding(path: str, pattern: str):
    """The encoder of a rank file: ``token in base64, rank`` a line."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Attributor:
    def __init__(self, path: str, pattern: str):
        self.code = encoding(path, pattern)
        tokens = self.code.token_byte_values()
        self.size = np.zeros(self.code.n_vocab, dtype=np.int64)
        for t in tokens:
            self.size[self.code.encode_single_token(t)] = len(t)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and last character of each token of a text."""
        ids = np.array(self.code.encode_ordinary(text), dtype=np.int64)
        end = np.cumsum(self.size[ids])
        start = end - self.size[ids]
        if text.isascii():
            return start, end - 1
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        return char[start], char[end - 1]


def allocate(first: np.ndarray, last: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether the token crosses a boundary."""
    low = np.searchsorted(starts, first, side="right") - 1
    high = np.searchsorted(starts, last, side="right") - 1
    cross = low != high
    if rule == "last":
        return high, cross
    to = low.copy()
    if rule == "most":
        for i in np.flatnonzero(cross).tolist():
            edges = np.concatenate([[first[i]], starts[low[i] + 1:high[i] + 1], [last[i] + 1]])
            to[i] = low[i] + int(np.diff(edges).argmax())
    return to, cross


def sections(fields: Sequence[str | None], by_line: bool) -> tuple[str, list[int], list[int], list[int]]:
    """The record, and of each section its field, its number in the field and its start."""
    field, number, start = [], [], []
    parts = [x or "" for x in fields]
    at = 0
    for f, text in enumerate(parts):
        lines = text.split("\n") if by_line else [text]
        for n, line in enumerate(lines):
            # an empty rest after the last line break is no section of its own
            if n == 0 or line or n < len(lines) - 1:
                field.append(f)
                number.append(n)
                start.append(at)
            at += len(line) + 1
    return "\n".join(parts), field, number, start


def count_tokens(docs: DataFrame, path: str, pattern: str, fields: Sequence[str] = ("text",),
                 by_line: bool = True, rule: str = "most") -> DataFrame:
    """``doc_id, field, section, start, n_chars, n_tokens, n_crossing`` of every section.

    ``n_crossing``: of the tokens counted here, those that reach into another section.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = list(fields)
    source = docs.select(F.col("doc_id").alias("id"),
                         *[F.col(f"`{c}`").cast("string").alias(f"f{i}") for i, c in enumerate(names)])
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attributor = Attributor(path, pattern)
        for batch in batches:
            for s in range(0, batch.num_rows, 200):
                part = batch.slice(s, 200)
                columns = [part.column(i + 1).to_pylist() for i in range(len(names))]
                rows, cells = [], []
                for i, values in enumerate(zip(*columns, strict=True)):
                    text, field, number, start = sections(values, by_line)
                    starts = np.array(start, dtype=np.int64)
                    to, cross = allocate(*attributor.spans(text), starts, rule)
                    n = len(starts)
                    rows.append(np.full(n, i))
                    cells.append((field, number, starts, np.diff(np.append(starts, len(text))),
                                  np.bincount(to, minlength=n), np.bincount(to[cross], minlength=n)))
                column = [np.concatenate([np.asarray(c[k], dtype=np.int64) for c in cells])
                          for k in range(6)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.concatenate(rows))),
                     pa.array(np.array(names, dtype=object)[column[0]], pa.string()),
                     pa.array(column[1].astype(np.int32)), *map(pa.array, column[2:])],
                    ["id", "field", "section", "start", "n_chars", "n_tokens", "n_crossing"])

    return source.mapInArrow(run, f"id {kind}, field string, section int, start bigint, "
                             "n_chars bigint, n_tokens bigint, n_crossing bigint"
                             ).withColumnRenamed("id", "doc_id")
