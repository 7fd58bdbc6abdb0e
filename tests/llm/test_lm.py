"""The language model learns from every training row, and copies spread over its tasks."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa

from piiloom.llm import lm


def test_all_rows_are_in_a_round_and_copies_spread(spark, tmp_path):
    texts = [f"w{i} x" for i in range(600)] + ["the same text"] * 600
    docs = spark.createDataFrame([(None if i % 5 == 0 else i, t) for i, t in enumerate(texts)],
                                 "doc_id long, text string")
    dealt, rounds = lm.training_rounds(docs, 16 * lm.TASK_TOKENS, str(tmp_path / "rounds"))
    rows = dealt.collect()
    assert rounds == 4
    assert Counter(bytes(r["text"]).decode() for r in rows) == Counter(texts)
    copies = Counter(r["round"] for r in rows if bytes(r["text"]) == b"the same text")
    assert len(copies) == rounds and max(copies.values()) < 300
    assert lm.training_rounds(docs, 100 * lm.TASK_TOKENS, str(tmp_path / "more"))[1] == 10


def small_model(seed: int = 3) -> tuple[lm.Network, np.ndarray]:
    starts = np.array([0, 1, 4, 9])
    net = lm.Network(starts)
    rng = np.random.default_rng(seed)
    net = lm.Network(starts, rng.normal(0, 0.4, net.flat.size))
    return net, rng


def plain_score(net: lm.Network, codes, end: int) -> float:
    """One token after the other, all sums written out."""
    def sigmoid(v):
        return 1 / (1 + math.exp(-v))

    n, h, before, total = lm.HIDDEN, [0.0] * lm.HIDDEN, end, 0.0
    for y in codes:
        a = net.x[before]
        b = [sum(h[i] * net.u[i, j] for i in range(n)) for j in range(3 * n)]
        z = [sigmoid(a[j] + b[j]) for j in range(n)]
        r = [sigmoid(a[n + j] + b[n + j]) for j in range(n)]
        new = [math.tanh(a[2 * n + j] + r[j] * b[2 * n + j]) for j in range(n)]
        h = [z[j] * h[j] + (1 - z[j]) * new[j] for j in range(n)]
        kinds = [math.exp(sum(h[i] * net.c[i, k] for i in range(n)) + net.cb[k]) for k in range(len(net.cb))]
        kind = int(net.class_of[y])
        total += math.log(kinds[kind] / sum(kinds))
        if kind < net.classes:
            s, e = net.starts[kind], net.starts[kind + 1]
            words = [math.exp(sum(h[i] * net.w[k, i] for i in range(n)) + net.wb[k]) for k in range(s, e)]
            total += math.log(words[y - s] / sum(words))
        before = y
    return total


def test_score_equals_a_plain_loop_over_whole_texts():
    net, rng = small_model()
    known = net.outputs + lm.TAILS
    texts = [rng.integers(0, known, n) for n in (1, 2, 40, 7, 1, 130)]
    got = lm.score_documents(net, texts, 5)
    assert np.allclose(got, [plain_score(net, t, 5) for t in texts], atol=1e-8)


def test_gradients_equal_differences():
    net, rng = small_model()
    texts = [rng.integers(0, net.outputs + lm.TAILS, n) for n in (9, 3, 4, 6)]
    laid = lm.Lanes.of(texts, 2, 5)

    def likelihood(flat: np.ndarray) -> float:
        h = np.zeros((laid.width, lm.HIDDEN))
        other = lm.Network(net.starts, flat)
        return lm.window_gradient(other, laid, 0, laid.steps, h, lm.Network(net.starts, np.zeros_like(flat)))[0]

    grad = lm.Network(net.starts, np.zeros_like(net.flat))
    _, _, rows, g = lm.window_gradient(net, laid, 0, laid.steps, np.zeros((laid.width, lm.HIDDEN)), grad)
    grad.x[rows] = g
    for i in rng.choice(net.flat.size, 400, replace=False).tolist():
        up, down = net.flat.copy(), net.flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert abs(-(likelihood(up) - likelihood(down)) / 2e-5 - grad.flat[i]) < 1e-6


def test_lanes_hold_each_token_once_and_a_long_text_needs_no_table_of_its_length():
    texts = [np.arange(50_000) % 7, np.array([3]), np.array([1, 2, 3])]
    laid = lm.Lanes.of(texts, 256, 9)
    assert len(laid.y) == len(laid.x) == len(laid.doc) == 50_004
    for d, t in enumerate(texts):
        assert laid.y[laid.doc == d].tolist() == t.tolist()
        assert laid.x[laid.doc == d].tolist() == [9, *t[:-1]]
    assert (laid.keep == 0).sum() == 3


def test_training_learns_from_all_pieces_of_a_long_text(monkeypatch):
    seen = []
    of = lm.Lanes.of.__func__
    monkeypatch.setattr(lm.Lanes, "of", classmethod(lambda cls, c, *rest: seen.extend(map(len, c)) or of(cls, c, *rest)))
    net, rng = small_model()
    net = lm.Network(net.starts, net.flat.astype(np.float32))
    lm.train(net, [rng.integers(0, net.outputs, n) for n in (lm.PIECE * 3 + 5, 1)], 5)
    assert sorted(seen) == [1, 5, lm.PIECE, lm.PIECE, lm.PIECE]
    assert np.isfinite(net.flat).all()


def test_means_of_weights_are_by_tokens():
    rows = [lm._part(0, np.array([1.0, 2.0]), 1), lm._part(7, np.array([5.0]), 2), lm._part(0, np.array([4.0, 8.0]), 3)]
    got = {b.column(0)[0].as_py(): np.frombuffer(b.column(1)[0].as_py(), np.float32).tolist()
           for b in lm._mean(iter(rows))}
    assert got == {0: [3.25, 6.5], 7: [5.0]}


def test_empty_tables_long_texts_repeated_rows_and_other_columns(spark):
    kind = "doc_id long, text string, token string, c long, row long, round int"
    none = spark.createDataFrame([], kind)
    assert lm.score_texts(none, none).count() == 0
    long = "aa bb " * 30_000
    docs = spark.createDataFrame([(1, long, "t", 1, 1, 1), (2, "aa bb", "t", 1, 1, 1), (2, "aa bb", "t", 1, 1, 1),
                                  (None, None, None, None, None, None), (4, "", "t", 1, 1, 1)], kind)
    got = lm.score_texts(docs, docs).collect()
    assert len(got) == 5
    one = {r["doc_id"]: r for r in got}
    assert one[1]["n_tokens"] == 60_001 and one[None]["n_tokens"] == one[4]["n_tokens"] == 1
    assert len({r["score"] for r in got if r["doc_id"] == 2}) == 1
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    unseen = lm.score_texts(docs, none).collect()
    assert all(r["base_score"] == 0 and r["train_tokens"] == 0 for r in unseen)


def test_words_are_coded_in_columns_as_one_by_one():
    texts = [b" \t lead B\x0b\x0cc\r\n", b"", None, b"one", b"   ", b"\xff\xfeA \xc3\x84b x\x1cy\xc2\xa0z xyz", b"B one wxyz " * 9]
    outputs = [b"b", b"one", lm.END]
    starts = np.array([0, 1, 3])
    words = lm.Vocabulary(9, 4, {w: 1 for w in outputs}, {w: i for i, w in enumerate(outputs)}, starts,
                          np.ones(2 + lm.TAILS), np.ones(3), np.zeros(lm.TAILS))
    column = pa.array([b"cut", *texts], pa.binary()).slice(1)
    found, size = lm.words_of(column)
    plain = [lm.tokens(t) for t in texts]
    assert size.tolist() == [len(t) for t in plain] and found.to_pylist() == [w for t in plain for w in t]
    codes, other = lm.codes_of(found, pa.array(outputs, pa.binary()))
    assert codes.tolist() == [words.index(w) for t in plain for w in t]
    assert other.tolist() == np.flatnonzero(codes >= len(outputs)).tolist()
    assert lm.codes_of(found, pa.array([], pa.binary()))[0].tolist() == [lm.tail_class(w) for t in plain for w in t]


def test_blocks_of_texts_hold_each_once_and_long_ones_alone():
    size = np.array([3, 3, 50, 1, 0, 9, 2])
    found = [*lm.ranges(size, 10)]
    assert [i for a, b in found for i in range(a, b)] == [*range(7)]
    assert all(b == a + 1 or size[a:b].sum() <= 10 for a, b in found) and [*lm.ranges(size[:0], 10)] == []


def test_large_logits_are_scored_without_overflow():
    net, rng = small_model()
    net.wb[:] += 400
    net.cb[:] -= 900
    text = rng.integers(0, net.outputs + lm.TAILS, 40)
    assert not net.bounded() and np.allclose(lm.score_documents(net, [text], 5), plain_score_shifted(net, text), atol=1e-8)


def plain_score_shifted(net: lm.Network, text) -> float:
    """The same shares, as a constant added to all logits changes none."""
    other = lm.Network(net.starts, net.flat.copy())
    other.wb[:] -= 400
    other.cb[:] += 900
    return plain_score(other, text, 5)
