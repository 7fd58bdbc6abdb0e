"""Language-model scores from a gated recurrent network, in numpy.

Words are counted over all training rows.  The most frequent get outputs of their own, in
classes of like frequency; each other word belongs to the class of its last bytes and has
there its smoothed share of the counts.  The network gives the class and, for frequent
words, the word in its class, so a step costs a few hundred products and not the
vocabulary.  It starts as the unigram model and is trained by backpropagation through
windows, the state carried over from one to the next, on all training rows: each belongs to
one round, in which tasks train from the same weights, which are averaged.  Rounds grow with
the square root of the tokens, so that more rows give more steps as well as more tasks.
In scoring, documents are laid end to end in lanes, the state starting anew with each, so
the log-likelihood is of the whole document however long.

Counts of the head of the vocabulary are a broadcast of bounded size; a word outside it
meets its count in a join, where by construction no training word is frequent.

Defined results: null and empty texts are the end token alone.  A null id belongs to no
held-out fold and is learned from.  Without training rows all words are unseen and
base scores are 0.  Repeated rows are scored, and learned from, as often as they come.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piiloom.llm.common import LOWER_BYTES, fold, stored, work_folder

END = b""  # no word is empty
HEAD = 131_072
OUTPUTS = 3_000
CLASSES = 32
TAILS = 16
HIDDEN = 16
WINDOW = 24
LANES = 256
#: Lanes and steps of an update in training, and its rate.
TRAIN_LANES = 256
TRAIN_WINDOW = 16
RATE = 0.03
#: A longer text is learned from in pieces.
PIECE = 1_024
#: A task holds about so many tokens at a time.
TASK_TOKENS = 400_000
#: Bytes of text, and tokens, that are coded at a time.
CODED_BYTES = 4_000_000
BLOCK_TOKENS = 800_000
#: Sums of exponentials of logits below this size, up or down, are in range.
SAFE = 80
#: Weights that are averaged in one row.
PART = 25_000
_FLUSH = 200_000
_SUFFIX = 3
#: The table of crc32 by letters.
_CRC = np.array([zlib.crc32(bytes([255 - i])) ^ 0xFF000000 for i in range(256)], np.uint32)


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").translate(LOWER_BYTES).split(), END]


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-_SUFFIX:]) % TAILS


def tail_class_of(token: Column) -> Column:
    short = F.length(token) <= _SUFFIX
    return F.pmod(F.crc32(F.when(short, token).otherwise(
        F.substring(token, -_SUFFIX, _SUFFIX))), F.lit(TAILS)).cast("int")


def count_words(docs: DataFrame) -> DataFrame:
    """``token, c`` over whole texts; each task sends a word once for many of its occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                held.update(tokens(text.as_py()))
                if len(held) > _FLUSH:
                    yield _counts(held)
                    held = Counter()
        yield _counts(held)

    return (docs.select(F.col("text").cast("string").cast("binary").alias("text"))
            .mapInArrow(run, "token binary, c bigint")
            .groupBy("token").agg(F.sum("c").alias("c")))


def _counts(held: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["token", "c"])


@dataclass
class Vocabulary:
    """Counts of the head; outputs, their classes, and the mass of each tail class."""

    total: int
    distinct: int
    count: dict[bytes, int]
    output: dict[bytes, int]
    starts: np.ndarray  # of each class among the outputs, with the end
    class_mass: np.ndarray
    output_mass: np.ndarray
    tail_log: np.ndarray  # log10 of the mass of each tail class, with unseen words as one

    @property
    def classes(self) -> int:
        return len(self.starts) - 1

    @property
    def outputs(self) -> int:
        return int(self.starts[-1])

    def index(self, word: bytes) -> int:
        found = self.output.get(word, -1)
        return found if found >= 0 else self.outputs + tail_class(word)


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # the head: the highest bins of the logarithm of the count that hold at most HEAD words
    binned = counts.withColumn("bin", F.floor(F.log2("c") * 64))
    size = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()  # 64 a doubling
    lowest, held = None, 0
    for row in sorted(size, key=lambda r: -r["bin"]):
        held += row["n"]
        if held > HEAD:
            break
        lowest = row["bin"]
    head = [] if lowest is None else [
        (r["token"], r["c"]) for r in binned.where(F.col("bin") >= lowest).select("token", "c").toLocalIterator()]
    head.sort(key=lambda r: (-r[1], r[0]))
    words, count = [bytes(w) for w, _ in head], [c for _, c in head]
    first = words[:OUTPUTS]
    weight = np.sqrt(np.array(count[:OUTPUTS], dtype=np.float64))
    part = (np.floor((np.cumsum(weight) - weight) / weight.sum() * CLASSES).astype(int)
            if len(first) else np.zeros(0, int))
    starts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(first)]]) if len(first) else np.zeros(1, int)
    spark = counts.sparkSession
    outputs = spark.createDataFrame(pa.table({"token": pa.array(first, pa.binary())}))
    tail = np.zeros((TAILS, 2))
    rest = (counts.join(F.broadcast(outputs), "token", "left_anti")
            .groupBy(tail_class_of(F.col("token")).alias("tail"))
            .agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")))
    for row in rest.collect():  # TAILS rows at most
        tail[row["tail"]] = row["c"], row["n"]
    mass = np.array(count[:OUTPUTS], dtype=np.float64)
    by_class = np.add.reduceat(mass, starts[:-1]) if len(first) else np.zeros(0)
    return Vocabulary(
        int(total), int(distinct), dict(zip(words, count, strict=True)),
        {w: i for i, w in enumerate(first)}, starts, np.concatenate([by_class, tail[:, 0]]) + 1, mass,
        np.log10(tail.sum(axis=1) + 1))


def text_blocks(texts: pa.Array) -> list[tuple[int, int]]:
    """Ranges of texts of about ``CODED_BYTES`` each; a longer text is alone."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    return [*ranges(size, CODED_BYTES)]


def ranges(size: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of as many items as reach ``limit`` in ``size`` at most; a larger item is alone."""
    total, start = np.concatenate([[0], np.cumsum(size)]), 0
    while start < len(size):
        end = max(start + 1, int(np.searchsorted(total, total[start] + limit, side="right")) - 1)
        yield start, end
        start = end


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of binary texts as `tokens` has them, text after text, and how many each text has."""
    plain = pc.fill_null(texts, b"").view(pa.string())
    # a blank behind each text leaves an empty word there, which is the end token
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(pc.binary_join_element_wise(plain, "", " ")))
    words, edge = pieces.flatten().view(pa.binary()), pieces.value_lengths().to_numpy().cumsum()
    keep = pc.binary_length(words).to_numpy() > 0
    keep[edge - 1] = True
    if not keep.all():  # blanks before the first word
        words = words.filter(pa.array(keep))
        edge = np.cumsum(keep)[edge - 1]
    return words, np.diff(edge, prepend=0)


def tail_classes(words: pa.Array) -> np.ndarray:
    """`tail_class` of each word."""
    _, at, data = words.buffers()
    edge = np.frombuffer(at, np.int32)[words.offset:words.offset + len(words) + 1]
    end, size = edge[1:], np.minimum(np.diff(edge), _SUFFIX)
    letters = np.frombuffer(data, np.uint8) if edge[-1] > edge[0] else np.zeros(1, np.uint8)
    crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for k in range(_SUFFIX, 0, -1):
        letter = letters[np.where(size >= k, end - k, 0)]
        crc = np.where(size >= k, _CRC[(crc ^ letter) & np.uint32(255)] ^ (crc >> np.uint32(8)), crc)
    return ((crc ^ np.uint32(0xFFFFFFFF)) % np.uint32(TAILS)).astype(np.int16)


def codes_of(words: pa.Array, outputs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """`Vocabulary.index` of each word, and the places of the words that have no output of their own."""
    found = pc.fill_null(pc.index_in(words, value_set=outputs), -1).to_numpy().astype(np.int16)
    other = np.flatnonzero(found < 0)
    if len(other):
        found[other] = len(outputs) + tail_classes(words.take(pa.array(other)))
    return found, other


class Network:
    """Weights in one flat array, so that models can be averaged."""

    def __init__(self, starts: np.ndarray, flat: np.ndarray | None = None):
        self.starts = starts
        self.classes, self.outputs = len(starts) - 1, int(starts[-1])
        self.class_of = np.concatenate([
            np.repeat(np.arange(self.classes), np.diff(starts)), self.classes + np.arange(TAILS)]).astype(np.int16)
        inputs = self.outputs + TAILS
        # of c and w the last row or column is for an input that is always one
        shapes = {"x": (inputs, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "c": (HIDDEN + 1, self.classes + TAILS),
                  "w": (self.outputs, HIDDEN + 1)}
        size = sum(int(np.prod(s)) for s in shapes.values())
        self.flat = np.zeros(size, dtype=np.float32) if flat is None else flat
        at = 0
        self.at = {}
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            self.at[name] = (at, n, shape)
            setattr(self, name, self.flat[at:at + n].reshape(shape))
            at += n
        self.cb, self.wb = self.c[HIDDEN], self.w[:, HIDDEN]

    @classmethod
    def unigram(cls, words: Vocabulary) -> Network:
        """The start: a random recurrent part, outputs that give the unigram shares."""
        net = cls(words.starts)
        rng = np.random.default_rng(7)
        net.x[:] = rng.normal(0, 0.1, net.x.shape)
        net.u[:] = rng.normal(0, 1 / np.sqrt(HIDDEN), net.u.shape)
        net.cb[:] = np.log(words.class_mass / words.class_mass.sum())
        net.wb[:] = np.log(np.maximum(words.output_mass, 1))
        return net

    def given(self, x: np.ndarray) -> np.ndarray:
        """What the inputs ``x`` give, a column for each."""
        return np.ascontiguousarray(self.x.take(x, axis=0).T)

    def step(self, a: np.ndarray, h: np.ndarray):
        """The next state for what the inputs give, ``a``, and the state before; with the gates' values.

        States, gates and ``a`` have a column for each lane, so that their parts are whole rows.
        """
        b = self.u.T @ h
        gate = a[:2 * HIDDEN] + b[:2 * HIDDEN]
        np.negative(gate, out=gate)
        np.exp(gate, out=gate)
        gate += 1
        np.divide(1, gate, out=gate)
        z, r, un = gate[:HIDDEN], gate[HIDDEN:], b[2 * HIDDEN:]
        new = r * un
        new += a[2 * HIDDEN:]
        np.tanh(new, out=new)
        after = h - new
        after *= z
        after += new
        return after, gate, new, un

    def bounded(self) -> bool:
        """Whether no logit can pass ``SAFE``, as no state passes one."""
        return bool(np.abs(self.c).sum(axis=0).max() < SAFE
                    and np.abs(self.w).sum(axis=1).max(initial=0) < SAFE)

    def log_likelihood(self, h: np.ndarray, y: np.ndarray, grad: Network | None = None):
        """Natural logarithm of P(y) for each column of states; with ``grad``, the gradients as well.

        The logits of the words in a class stand in one array, class after class, so that
        exponentials and choices are taken for all classes at once.
        """
        n, starts, safe = len(y), self.starts, self.bounded()
        at = np.arange(n)
        kind = self.class_of[y]
        order = np.argsort(kind, kind="stable")
        y, kind = y[order], kind[order]
        one = np.ones((HIDDEN + 1, n), dtype=h.dtype)
        one[:HIDDEN] = h.take(order, axis=1)
        share = self.c.T @ one
        if not safe:
            share -= share.max(axis=0)
        out = share[kind, at]
        np.exp(share, out=share)
        whole = share.sum(axis=0)
        out -= np.log(whole)
        edge = np.searchsorted(kind, np.arange(self.classes + 1))
        inside, members, width = int(edge[-1]), np.diff(edge), np.diff(starts)
        begin = np.concatenate([[0], np.cumsum(members * width)])
        logits = np.empty(int(begin[-1]), dtype=h.dtype)
        used = []
        for k in np.flatnonzero(members).tolist():
            a, b, s, e = int(edge[k]), int(edge[k + 1]), int(starts[k]), int(starts[k + 1])
            part = logits[begin[k]:begin[k + 1]].reshape(e - s, b - a)
            np.matmul(self.w[s:e], one[:, a:b], out=part)
            if not safe:
                part -= part.max(axis=0)
            used.append((a, b, s, e, part))
        own = kind[:inside]
        chosen = begin[own] + (y[:inside] - starts[own]) * members[own] + at[:inside] - edge[own]
        out[:inside] += logits[chosen]
        np.exp(logits, out=logits)
        in_class = np.empty(inside, dtype=h.dtype)
        for a, b, _, _, part in used:
            part.sum(axis=0, out=in_class[a:b])
        out[:inside] -= np.log(in_class)
        back = np.empty(n, np.int64)
        back[order] = at
        if grad is None:
            return out[back], None
        share /= whole
        share[kind, at] -= 1
        grad.c += one @ share.T
        dh = self.c[:HIDDEN] @ share
        for a, b, _, _, part in used:
            part /= in_class[a:b]
        logits[chosen] -= 1
        for a, b, s, e, part in used:
            grad.w[s:e] += part @ one[:, a:b].T
            dh[:, a:b] += self.w[s:e, :HIDDEN].T @ part
        return out[back], dh.take(back, axis=1)


def lanes_of(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents dealt over lanes, longest first, each to the shortest lane; longest lane first."""
    import heapq

    heap = [(0, i) for i in range(min(lanes, len(lengths)))]
    out: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-lengths, kind="stable").tolist():
        size, lane = heapq.heappop(heap)
        out[lane].append(d)
        heapq.heappush(heap, (size + int(lengths[d]), lane))
    return sorted(out, key=lambda ds: -sum(int(lengths[d]) for d in ds))


@dataclass
class Lanes:
    """Tokens of documents laid end to end in lanes, step by step: memory goes with the tokens.

    ``edge`` has the first place of each step; of a step, the lanes stand in order, the longest first.
    """

    y: np.ndarray
    x: np.ndarray  # the token before; the end token at a start
    doc: np.ndarray
    keep: np.ndarray  # 0 at a start, where the state begins anew, else 1
    edge: np.ndarray

    @classmethod
    def of(cls, coded: list[np.ndarray], lanes: int, end: int) -> Lanes:
        lengths = np.array([len(c) for c in coded])
        placed = lanes_of(lengths, lanes)
        docs = np.concatenate(placed)
        y = np.concatenate([coded[d] for d in docs])
        doc = np.repeat(docs, lengths[docs])
        size = np.array([lengths[ds].sum() for ds in placed])
        start = np.cumsum(lengths[docs]) - lengths[docs]
        x = np.concatenate([y[:1], y[:-1]])
        x[start] = end
        keep = np.ones(len(y), np.float32)
        keep[start] = 0
        place = np.arange(len(y)) - np.repeat(np.cumsum(size) - size, size)
        order = np.argsort(place, kind="stable")
        active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
        return cls(y[order], x[order], doc[order], keep[order, None], np.concatenate([[0], np.cumsum(active)]))

    @property
    def steps(self) -> int:
        return len(self.edge) - 1

    @property
    def width(self) -> int:
        return int(self.edge[1])


def score_documents(net: Network, coded: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log-likelihood of each coded document."""
    laid = Lanes.of(coded, LANES, end)
    edge = laid.edge.tolist()
    out = np.zeros(len(coded))
    h = np.zeros((HIDDEN, laid.width), dtype=net.flat.dtype)
    s = 0
    while s < laid.steps:
        e = s + 1
        while e < laid.steps and edge[e] - edge[s] < LANES * WINDOW:
            e += 1
        first, last = edge[s], edge[e]
        states = np.empty((HIDDEN, last - first), dtype=h.dtype)
        for t in range(s, e):
            i, j = edge[t], edge[t + 1]
            h = net.step(net.given(laid.x[i:j]), h[:, :j - i] * laid.keep[i:j, 0])[0]
            states[:, i - first:j - first] = h
        found, _ = net.log_likelihood(states, laid.y[first:last])
        out += np.bincount(laid.doc[first:last], weights=found, minlength=len(coded))
        s = e
    return out


def window_gradient(net: Network, laid: Lanes, s: int, e: int, h: np.ndarray, grad: Network):
    """Backpropagation through the steps from ``s`` to ``e``, from the states ``h``.

    Adds to all of ``grad`` but ``x``; returns the sum of log-likelihoods, the states after, the inputs that
    occur, and the gradients of their rows of ``x``.
    """
    edge, first = laid.edge.tolist(), int(laid.edge[s])
    last, kind = edge[e], net.flat.dtype
    n, keep = last - first, laid.keep[first:last, 0]
    x = laid.x[first:last]
    states = np.empty((HIDDEN, n), dtype=kind)
    h = np.ascontiguousarray(h.T)
    steps = []
    for t in range(s, e):
        at = slice(edge[t] - first, edge[t + 1] - first)
        before = h[:, :at.stop - at.start] * keep[at]
        h, gate, new, un = net.step(net.given(x[at]), before)
        states[:, at] = h
        steps.append((at, before, gate, new, un))
    found, dh = net.log_likelihood(states, laid.y[first:last], grad)
    da = np.empty((n, 3 * HIDDEN), dtype=kind)
    later = np.zeros((HIDDEN, 0), dtype=kind)
    for at, before, gate, new, un in reversed(steps):
        z, r = gate[:HIDDEN], gate[HIDDEN:]
        d = dh[:, at]
        d[:, :later.shape[1]] += later
        now = np.empty((3 * HIDDEN, d.shape[1]), dtype=kind)
        by_z, by_r, by_new = now[:HIDDEN], now[HIDDEN:2 * HIDDEN], now[2 * HIDDEN:]
        rest = 1 - z
        np.multiply(new, new, out=by_new)
        np.subtract(1, by_new, out=by_new)
        by_new *= rest
        by_new *= d
        np.subtract(before, new, out=by_z)
        by_z *= rest
        later = d * z
        by_z *= later
        np.subtract(1, r, out=by_r)
        by_r *= r
        by_r *= un
        by_r *= by_new
        da[at] = now.T
        by_new *= r
        grad.u += before @ now.T
        later += net.u @ now
        later *= keep[at]
    order = np.argsort(x, kind="stable")
    found_at = np.flatnonzero(np.diff(x[order], prepend=-1))
    return found.sum(), h.T, x[order[found_at]], np.add.reduceat(da[order], found_at, axis=0)


class Adam:
    """Moments of some weights; of inputs, only the rows that occur move."""

    def __init__(self, like: np.ndarray, rate: float):
        self.first, self.second = np.zeros_like(like), np.zeros_like(like)
        self.rate = rate

    def move(self, weights: np.ndarray, rows, g: np.ndarray, update: int) -> None:
        """``g`` is used up."""
        kind = weights.dtype.type
        first, second = self.first[rows], self.second[rows]  # copies, unless all rows move
        first *= kind(0.9)
        first += kind(0.1) * g
        second *= kind(0.999)
        g *= g
        g *= kind(0.001)
        second += g
        if not isinstance(rows, slice):
            self.first[rows], self.second[rows] = first, second
        size = np.sqrt(second / kind(1 - 0.999 ** update))
        size += kind(1e-8)
        np.divide(first, size, out=size)
        size *= kind(self.rate / (1 - 0.9 ** update))
        weights[rows] -= size


def train(net: Network, coded: list[np.ndarray], end: int, rate: float = RATE,
          lanes: int = TRAIN_LANES, window: int = TRAIN_WINDOW) -> Network:
    """One pass of truncated backpropagation with Adam; the state is carried over windows.

    Every token is learned from; a text of more than ``PIECE`` tokens fills several lanes, piece by piece.
    """
    coded = [c[i:i + PIECE] for c in coded for i in range(0, len(c), PIECE)]
    if not coded:
        return net
    laid = Lanes.of(coded, lanes, end)
    inputs, rest = net.x.size, net.flat[net.x.size:]
    by_input, others = Adam(net.x, rate), Adam(rest, rate)
    grad = Network(net.starts)
    h = np.zeros((laid.width, HIDDEN), dtype=net.flat.dtype)
    for update, s in enumerate(range(0, laid.steps, window), 1):
        e = min(s + window, laid.steps)
        grad.flat[inputs:] = 0
        _, h, rows, g = window_gradient(net, laid, s, e, h, grad)
        n = net.flat.dtype.type(laid.edge[e] - laid.edge[s])
        by_input.move(net.x, rows, g / n, update)
        others.move(rest, slice(None), grad.flat[inputs:] / n, update)
    return net


def training_rounds(docs: DataFrame, total: int, folder: str) -> tuple[DataFrame, int]:
    """``text, round`` of all rows, stored by round, and how many rounds there are.

    Rows are dealt by their number and not by their text, so copies spread over rounds and tasks.
    """
    parts = max(1, math.ceil(total / TASK_TOKENS))
    rounds = math.ceil(math.sqrt(parts))
    tasks = math.ceil(parts / rounds)
    dealt = (docs.select(F.col("text").cast("string").cast("binary").alias("text"),
                         F.xxhash64(F.monotonically_increasing_id()).alias("place"))
             .withColumn("round", F.pmod("place", F.lit(rounds)).cast("int"))
             .withColumn("task", F.pmod(F.xxhash64("place"), F.lit(tasks)).cast("int"))
             .repartition(parts, "round", "task").select("text", "round"))
    dealt.write.partitionBy("round").parquet(folder)
    return docs.sparkSession.read.schema("text binary, round int").parquet(folder), rounds


def learn(docs: DataFrame, words: Vocabulary) -> Network:
    """Train on all rows of ``docs``, round by round; the tasks' weights are averaged by their tokens."""
    net = Network.unigram(words)
    if not words.outputs:
        return net
    spark = docs.sparkSession
    dealt, rounds = training_rounds(docs, words.total, work_folder(spark, "lm-training"))
    end = words.index(END)
    given = spark.sparkContext.broadcast(words)
    size = len(net.flat)
    for n in range(rounds):
        sent = spark.sparkContext.broadcast(net.flat)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            v = given.value
            outputs, own, coded, held, seen = pa.array(list(v.output), pa.binary()), Network(v.starts, sent.value.copy()), [], 0, 0
            for batch in batches:
                for first, last in text_blocks(batch.column(0)):
                    found, lengths = words_of(batch.column(0).slice(first, last - first))
                    for codes in np.split(codes_of(found, outputs)[0], np.cumsum(lengths)[:-1]):
                        coded.append(codes)
                        held += len(codes)
                        if held >= TASK_TOKENS:
                            own, seen = train(own, coded, end), seen + held
                            coded, held = [], 0
            own, seen = train(own, coded, end), seen + held
            if seen:
                for s in range(0, size, PART):
                    yield _part(s, own.flat[s:s + PART], seen)

        mean = (dealt.where(F.col("round") == n).select("text")
                .mapInArrow(run, "at int, w binary, n bigint")
                .repartition(math.ceil(size / PART), "at")
                .mapInArrow(_mean, "at int, w binary, n bigint").toArrow())
        sent.unpersist()
        if mean.num_rows:
            flat = np.zeros(size, dtype=np.float32)
            for at, w in zip(mean["at"].to_pylist(), mean["w"].to_pylist(), strict=True):
                flat[at:at + PART] = np.frombuffer(w, np.float32)
            net = Network(words.starts, flat)
    given.unpersist()
    return net


def _part(at: int, weights: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([at], pa.int32()), pa.array([weights.astype(np.float32).tobytes()], pa.binary()),
         pa.array([n], pa.int64())], ["at", "w", "n"])


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of each part over the tasks by their tokens, summed row by row: memory for the parts alone."""
    total: dict[int, tuple[np.ndarray, int]] = {}
    for batch in batches:
        for at, w, n in zip(*(batch.column(i) for i in range(3)), strict=True):
            at, n = at.as_py(), n.as_py()
            own = np.frombuffer(w.as_py(), np.float32).astype(np.float64) * n
            held, seen = total.get(at, (0.0, 0))
            total[at] = held + own, seen + n
    for at, (held, seen) in total.items():
        yield _part(at, held / seen, seen)


def score(docs: DataFrame, counts: DataFrame, words: Vocabulary, net: Network, folder: str,
          block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    spark = docs.sparkSession
    given, sent = spark.sparkContext.broadcast(words), spark.sparkContext.broadcast(net.flat)
    source = docs.select(F.col("doc_id").alias("id"),
                         F.col("text").cast("string").cast("binary").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = (f"id {kind}, n_tokens bigint, n_known bigint, base double, score double, "
              "rare array<binary>, times array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = given.value
        model = Network(v.starts, sent.value)
        end, outputs, head = v.index(END), pa.array(list(v.output), pa.binary()), list(v.count)
        others = pa.array(head[v.outputs:], pa.binary())
        # what each output, and each other word of the head, gives; words outside the head are looked up later
        log = np.log10(np.array([*v.count.values()], dtype=np.float64) + 1)
        log, other_log = log[:v.outputs], np.append(log[v.outputs:], 0)
        for batch in batches:
            for first, last in text_blocks(batch.column(1)):
                words, size = words_of(batch.column(1).slice(first, last - first))
                index, other = codes_of(words, outputs)
                place = pc.fill_null(pc.index_in(words.take(pa.array(other)), value_set=others), len(others)).to_numpy()
                logs = np.zeros(len(words))
                mine = index < v.outputs
                logs[mine] = log[index[mine]]
                logs[other] = other_log[place]
                local = np.zeros(len(words))
                local[other] = logs[other] - v.tail_log[index[other] - v.outputs]
                late = other[place == len(others)]
                edge = np.cumsum(size)
                start = edge - size
                rare = words.take(pa.array(late)).to_pylist()
                late_edge = np.searchsorted(late, np.concatenate([[0], edge])).tolist()
                counted = [Counter(rare[a:b]) for a, b in zip(late_edge[:-1], late_edge[1:], strict=True)]
                coded = np.split(index, edge[:-1])
                likely = np.concatenate([score_documents(model, coded[a:b], end)
                                         for a, b in ranges(size, block_tokens)]) / np.log(10)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(size, pa.int64()),
                     pa.array(size - np.diff(late_edge), pa.int64()), pa.array(np.add.reduceat(logs, start)),
                     pa.array(np.add.reduceat(local, start) + likely),
                     pa.array([list(c) for c in counted], pa.list_(pa.binary())),
                     pa.array([list(c.values()) for c in counted], pa.list_(pa.int32()))],
                    ["id", "n_tokens", "n_known", "base", "score", "rare", "times"])

    rows = stored(source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()),
                  f"{folder}/rows")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "row", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    late = (rare.join(counts, "token")
            .groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("late"),
                                F.sum("times").alias("late_known")))
    none = float(np.log10(words.total + words.distinct + 1))
    late_sum = F.coalesce("late", F.lit(0.0))
    return (rows.drop("rare", "times").join(late, "row", "left")
            .select(F.col("id").alias("doc_id"), "n_tokens",
                    (F.col("n_known") + F.coalesce("late_known", F.lit(0))).alias("n_known"),
                    F.lit(words.total).cast("bigint").alias("train_tokens"),
                    (F.col("base") + late_sum - F.col("n_tokens") * none).alias("base_score"),
                    (F.col("score") + late_sum).alias("score")))


def score_texts(docs: DataFrame, training: DataFrame) -> DataFrame:
    """Learn from ``training`` (columns ``doc_id, text``) and score every row of ``docs``."""
    folder = work_folder(docs.sparkSession, "lm")
    counts = stored(count_words(training), f"{folder}/counts")
    words = vocabulary(counts)
    return score(docs, counts, words, learn(training, words), folder)


def held_out(doc_id: Column, folds: int = 7, rest: int = 2) -> Column:
    return F.coalesce(fold(doc_id, folds) == rest, F.lit(False))
