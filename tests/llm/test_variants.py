"""Spelling variants against plain edit distances over all pairs."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from piiloom.llm import variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def some_words(n, seed, alphabet="abé", low=5, high=8):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(low, high))) for _ in range(n)})


@pytest.mark.parametrize("length", [1, 2, 5, 9])
def test_bitsets_equal_edit_distance(length):
    words = some_words(150, length, low=length, high=length + 1)
    q, v = variants.near_pairs(words, length)
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words)
            if len(a) == length and one_edit(a, b)}
    assert set(zip(q.tolist(), v.tolist())) == want and len(q) == len(want)


def test_bitsets_of_one_word_and_of_longer_words_only():
    assert len(variants.near_pairs(["abcde"], 5)[0]) == 0
    assert len(variants.near_pairs(["abcdef", "abcdeg"], 5)[0]) == 0


def brute(rows, min_length=5, min_count=3, times=2, one_in=None):
    import re

    counts = Counter()
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    out, form_of = {}, {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x)) if near else None
        if best is not None and words[best] >= times * n:
            form_of[w] = best
        out[w] = (n, len(near))

    def root(w):
        while w in form_of:
            w = form_of[w]
        return w

    return {(w, form_of.get(w), root(w), n, near, words.get(form_of.get(w)))
            for w, (n, near) in out.items()}


def rows_of(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def noisy_texts(seed, docs=60):
    rng = random.Random(seed)
    stems = some_words(40, seed, "abcdeÉéX×", 4, 9)
    weights = [1 / (1 + i) for i in range(len(stems))]
    out = []
    for i in range(docs):
        words = rng.choices(stems, weights, k=rng.randint(1, 60))
        words = [w if rng.random() < 0.8 else w[:2] + rng.choice("abc") + w[3:] for w in words]
        out.append((i, rng.choice([" ", "-", "\n1 "]).join(words)))
    return out


@pytest.mark.parametrize(("seed", "one_in", "block"), [(1, None, 2048), (2, 5, 2048), (3, 3, 64), (4, 97, 64)])
def test_groups_equal_brute_force(spark, seed, one_in, block, monkeypatch):
    # a small bound on letters makes blocks of 64 words, so tiles are made as well
    rows = noisy_texts(seed) + [(None, "ababa ababa ababa"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = variants.group_variants(docs, one_in=one_in, block=block)
    assert rows_of(got) == brute(rows, one_in=one_in)


def test_keys_with_many_words_meet_in_tiles(spark):
    """All words share their prefix: some 300 words under one key, in slices of 64."""
    rng = random.Random(5)
    words = sorted({"a" * 8 + "".join(rng.choice("xyz") for _ in range(rng.randint(4, 5))) + "bbbb" for _ in range(2000)})
    counts = {w: 3 + rng.randrange(50) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    blocks = variants.into_blocks(frame, 5, 64)
    assert blocks.where("i <> j").count() > 0 and blocks.groupBy("length", "suffix", "whole", "i", "j").count().agg(
        {"count": "max"}).first()[0] < 300
    got = {r["word"]: (r["n_near"], r["best"], r["best_n"]) for r in variants.near_words(frame, 5, 64).collect()}
    want = {}
    for w in words:
        near = [x for x in words if one_edit(w, x)]
        if near:
            best = min(near, key=lambda x: (-counts[x], x))
            want[w] = (len(near), best, counts[best])
    assert got == want


def test_chains_end_at_their_root(spark, tmp_path):
    links = [(f"w{i}", f"w{i + 1}") for i in range(21)] + [("x", "w3")]
    found = variants.roots(spark.createDataFrame(links, "word string, form string"), str(tmp_path / "roots"))
    assert {r["word"]: r["root"] for r in found.collect()} == {w: "w21" for w, _ in links}


def test_edges(spark):
    schema = "doc_id long, text string, word string, n long, key string, form string"
    assert variants.group_variants(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "hello " * 30_000, "c", 1, "k", "f"), (1, "hello " * 30_000, "c", 1, "k", "f"),
            (2, "hallo hallo HALLO", "c", 1, "k", "f"), (3, "z" * 20_000 + " " + "z" * 20_001, "c", 1, "k", "f"),
            (3, "z" * 20_000, "c", 1, "k", "f"), (4, None, None, None, None, None), (None, "hallo", "c", 1, "k", "f")]
    docs = spark.createDataFrame(rows, schema)
    got = {r["word"][:9]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"])
           for r in variants.group_variants(docs).collect()}
    assert got == {"hello": (None, "hello", 60_000, 1, None), "hallo": ("hello", "hello", 4, 1, 60_000)}
    # one word of 20,000 letters twice and one of 20,001 once: near, where the bound on counts allows them
    got = {len(r["word"]): (r["n"], r["n_near"]) for r in variants.group_variants(docs, min_count=1).collect()}
    assert got[20_000] == (2, 1) and got[20_001] == (1, 1)


def test_letters_are_code_points():
    assert variants.letters_of(["aé", "×"], 2).tolist() == [[97, 233], [215, 0]]
    assert variants.letters_of(["𝒳a"], 3).dtype == np.uint32
