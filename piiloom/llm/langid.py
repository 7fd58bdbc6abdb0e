"""Language identification by cross-parsing entropy.

Each language gets the suffix automaton of a bounded sample of its labelled
text, lower-cased, with every run of other characters than letters as one.  Every
letter of a sample is a symbol of its own, whatever the script and however many there
are.  A document is cut into phrases, each the longest piece that occurs in
that sample; the language that needs the fewest phrases per character wins.
The cut is a walk: from state to state while the automaton has a transition,
else one phrase more and again from the start.  The walk is a table look-up, so
numpy takes many texts at once through each language; the transitions of letters beyond
the 63 commonest of a sample are looked up in a sorted list.

Defined results: a null text, or one without a letter (empty texts among them),
is ``und`` with score 0.  Ties go to the language first in order.  With one
language only, it wins with score 1; with none learned all is ``und``.  A text
is read whole; every ``LANE`` characters the walk starts a new phrase, which
bounds the steps of a very long text.  Rows with a null id or label teach
nothing; repeated rows are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piiloom.llm.common import fold, sample_ids

LANE = 2048
#: Columns of a table; letters from there on have their transitions in a list.
DENSE = 64
UNDETERMINED = "und"


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
        last = new
    return moves


class CrossParser:
    """Walk tables of all languages; ``samples`` maps a language to its bounded text."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        lowered = {k: v.lower() for k, v in samples.items()}
        letters = sorted({c for v in lowered.values() for c in v if c.isalpha()})
        # class 0: letters that no automaton knows; 1: all that is no letter; from 2 on: a letter each
        self.classes = np.fromiter((not chr(c).isalpha() for c in range(0x110000)), dtype=np.int32,
                                   count=0x110000)
        for i, c in enumerate(letters):
            self.classes[ord(c)] = i + 2
        self.walks = [self.walk_of(self.code([lowered[lang]])[0]) for lang in self.languages]

    def walk_of(self, coded: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of a coded sample: the column of each class; the table; keys and targets of rarer
        letters' transitions, and where these letters go from the start.

        Column 0 is of classes that the sample does not hold.  A state is named by the place
        where its row begins.
        """
        count = np.bincount(coded, minlength=int(self.classes.max()) + 1)
        own = np.argsort(-count, kind="stable")[:np.count_nonzero(count)]
        column = np.zeros(len(count), dtype=np.int32)
        column[own] = np.arange(1, len(own) + 1)
        moves = suffix_automaton(column[coded].tolist())
        table = np.full((len(moves), DENSE), -1, dtype=np.int64)
        rare = []
        for state, row in enumerate(moves):
            for c, to in row.items():
                if c < DENSE:
                    table[state, c] = to
                else:
                    rare.append(((state * DENSE << 32) + c, to * DENSE))
        keys, to = np.array(sorted(rare), dtype=np.int64).reshape(-1, 2).T
        start = np.zeros(len(own) + 1, dtype=np.int32)
        for c, first in moves[0].items():
            start[c] = first * DENSE
        # no transition: the phrase ends before this character, and the next begins with it
        fresh = np.where(table[0] >= 0, table[0], 0)
        # a character that not even the start goes on with is a phrase by itself
        ends = (table < 0) * (1 + (table[0] < 0)[None, :].astype(np.int64))
        ends[0] = table[0] < 0
        table = np.where(table < 0, fresh[None, :], table)
        return (column, (((table * DENSE) << 2) | ends).reshape(-1).astype(np.int32), keys.copy(),
                to.astype(np.int32), start)

    def code(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Classes of all characters, and how many each text has; of a run of non-letters one stays."""
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        raw = "".join(texts).encode("utf-32-le", "surrogatepass")
        codes = self.classes[np.frombuffer(raw, dtype=np.uint32)]
        other = codes == 1
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = ~(other[1:] & other[:-1])
        first = (np.cumsum(size) - size)[size > 0]
        keep[first] = True
        owner = np.repeat(np.arange(len(texts)), size)
        return codes[keep], np.bincount(owner[keep], minlength=len(texts))

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each lower-cased text under each language."""
        codes, size = self.code(texts)
        lanes = -(-size // LANE)
        owner = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = np.repeat(np.cumsum(size) - size, lanes) + nth * LANE
        length = np.minimum(np.repeat(size, lanes) - nth * LANE, LANE)
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        steps = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(1, steps + 1), side="right")
        out = np.zeros((len(self.languages), len(texts)), dtype=np.int64)
        for i, (column, table, keys, to, first) in enumerate(self.walks):
            own = column.take(codes)
            rare = own >= DENSE
            some = bool(rare.any())
            state = np.zeros(len(owner), dtype=np.int32)
            count = np.zeros(len(owner), dtype=np.int32)
            for t in range(steps):
                k = active[t]
                at = begin[:k] + t
                c = own[at]
                if some:
                    far = np.flatnonzero(rare[at])
                    key = (state[far].astype(np.int64) << 32) + c[far]
                    place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    goes = keys[place] == key
                    onward = np.where(goes, to[place], first[c[far]])
                    c[far] = 0
                walked = table.take(state[:k] + c)
                if some:
                    walked[far] = (onward << 2) | ~goes
                count[:k] += walked & 3
                state[:k] = walked >> 2
            # the phrase still open at the end of a lane counts as well
            count += state != 0
            out[i] = np.bincount(owner, weights=count, minlength=len(texts))
        return out.T

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [t is not None and any(map(str.isalpha, t)) for t in texts]
        lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        at = [i for i, ok in enumerate(known) if ok]
        if not at or not self.languages:
            return lang, score
        need = self.phrases([texts[i].lower() for i in at])  # type: ignore[union-attr]
        best = need.argmin(axis=1)
        if len(self.languages) == 1:
            sure = np.ones(len(at))
        else:
            two = np.partition(need, 1, axis=1)
            sure = 1.0 - two[:, 0] / np.maximum(two[:, 1], 1)
        for i, b, s in zip(at, best.tolist(), sure.tolist(), strict=True):
            lang[i], score[i] = self.languages[b], s
        return lang, score


def learn(docs: DataFrame, folds: int = 4, held_out: int = 2, docs_per_language: int = 64,
          chars_per_language: int = 24_000) -> CrossParser:
    """Automata from a bounded sample of the labelled rows outside the held-out fold.

    Of each language at most ``docs_per_language`` rows are looked at, in the order of
    a hash of their id; whole texts are taken while they fit ``chars_per_language``, and
    what is left is filled from the middles of texts that are longer than that.  So every
    language with a row to learn from is learned, however long its texts are.
    """
    rows = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
        & (fold(F.col("doc_id"), folds) != held_out))
    ids = sample_ids(rows, "lang", docs_per_language)
    size = F.length("text")
    middle = F.when(size > chars_per_language, F.substring(
        F.col("text"), F.floor((size - chars_per_language) / 2).cast("int") + 1,
        F.lit(chars_per_language))).otherwise(F.col("text"))
    picked = (rows.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")
              .groupBy("lang").agg(F.sort_array(F.collect_set(
                  F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", (size > chars_per_language).alias("cut"),
                           middle.alias("text")))).alias("docs")))
    samples = {}
    for row in picked.toLocalIterator():
        text = ""
        for d in sorted(row["docs"], key=lambda d: d["cut"]):
            left = max(0, chars_per_language - len(text))
            if d["cut"] and left:
                half = (len(d["text"]) - left) // 2
                text += d["text"][half:half + left] + "\n"
            elif len(d["text"]) <= left:
                text += d["text"] + "\n"
        samples[row["lang"]] = text
    return CrossParser(samples)


def identify(docs: DataFrame, parser: CrossParser, block_chars: int = 500_000) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` appended; needs columns ``doc_id, text`` only.

    The automata go to the executors as one broadcast of known size:
    languages x about 2 x ``chars_per_language`` states x 256 bytes, and at most 3 x
    ``chars_per_language`` listed transitions of 12 bytes.
    """
    held = docs.sparkSession.sparkContext.broadcast(parser)
    plain = [c for c in docs.columns if c not in ("lang_pred", "score")]
    source = docs.select(*plain)
    from pyspark.sql import types as T

    schema = T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    text_at = plain.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cross = held.value
        for batch in batches:
            at, texts = 0, batch.column(text_at)
            while at < batch.num_rows:
                block, size = [], 0
                while at + len(block) < batch.num_rows and (not block or size < block_chars):
                    block.append(texts[at + len(block)].as_py())
                    size += len(block[-1] or "")
                lang, score = cross.predict(block)
                part = batch.slice(at, len(block))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    [*part.schema.names, "lang_pred", "score"])
                at += len(block)

    return source.mapInArrow(run, schema)
