"""Each operator against a brute-force version, on edge cases and small tables."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from piiloom.llm import bpe, dedup, langid, lm, neardup, packing, quality, tokens, topk, urls

EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a B"), (5, "a B"), (6, "x" * 50_000),
         (None, "a b"), (7, "É!! 123"), (8, "word " * 30_000)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(
        [(i, t, "en", "s", "clash", 1.0) for i, t in EDGES],
        "doc_id long, text string, lang string, row string, digest string, score double")


def texts_of(n, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    out = []
    for _ in range(n):
        base = rng.choice(out) if out and rng.random() < 0.5 else None
        own = base.split() if base else [rng.choice(words) for _ in range(rng.randint(1, 80))]
        if base:
            for _ in range(rng.randint(0, max(1, len(own) // 15))):
                own[rng.randrange(len(own))] = rng.choice(words)
        out.append(" ".join(own))
    return out


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_bpe_equals_library(spark, edges):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = ["Σς İ ß ﬁ é", "it's we'll 12 34", "a<|endoftext|>B", "\x1c\x85 x y", "一二 👍🏽!!"]
    docs = edges.select("doc_id", "text").unionByName(table(spark, odd + texts_of(20)))
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
                  for r in bpe.encode_texts(docs, path).collect())
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        plain = library.decode(ids, skip_special_tokens=False)
        want[(r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
              hashlib.sha256(plain.encode()).hexdigest())] += 1
    assert got == want


def test_exact_copies(spark, edges):
    found = {(r["doc_id"], r["row"]): r for r in dedup.find_copies(edges).collect()}
    assert len(found) == len(EDGES)
    by = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found.values())
    assert by[(1, 2, 2, False)] == by[(2, 2, 2, True)] == 1
    assert by[(4, 5, 4, False)] == by[(None, 5, 4, False)] == 1
    assert by[(5, 5, 4, True)] == by[(5, 5, 4, False)] == 1
    kept = dedup.keep_first(edges)
    assert kept.columns == edges.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5, 6, 7, 8]
    assert dedup.find_copies(edges.limit(0)).count() == 0


def test_copies_under_one_digest_are_told_apart_by_bytes(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a"), (2, "A"), (2, "a"), (3, "b"), (None, "b"), (4, "c")],
                                 "doc_id long, text string")
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"])
           for r in dedup.find_copies(docs, digest=lambda c: F.lit("same")).collect()}
    assert got == {(1, 2, 3, False), (2, 2, 3, True), (2, 2, 3, False), (3, 3, 2, True),
                   (None, 3, 2, False), (4, 4, 1, True)}


def test_near_copies_equal_brute_force(spark):
    texts = texts_of(60) + ["", "one", "ONE"]
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i:i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    want = {(i, len(s), root(i)) for i, s in enumerate(sets)}
    got = {(r["doc_id"], r["n_shingles"], r["component_id"])
           for r in neardup.find_near_copies(table(spark, texts), words=2).collect()}
    assert got == want


def test_registers_bands_and_estimate():
    rng = np.random.default_rng(1)
    missed = 0
    for n in (3, 8, 20, 60, 150, 400, 1500):
        for _ in range(20):
            u = rng.integers(0, 2**63, n, dtype=np.uint64)
            d = n // 5
            a, b = np.unique(u[:n - d // 2]), np.unique(u[d - d // 2:])
            if len(np.intersect1d(a, b)) * 100 < 80 * len(np.union1d(a, b)):
                continue
            missed += not set(neardup.band_keys(a).tolist()) & set(neardup.band_keys(b).tolist())
            x, y = neardup.registers(a, 256), neardup.registers(b, 256)
            used = ((x != neardup.EMPTY) | (y != neardup.EMPTY)).sum()
            same = ((x == y) & (x != neardup.EMPTY)).sum()
            assert neardup.possible(same, used, len(a) + len(b), 80)[1]
    assert missed == 0


def test_near_copy_edges(edges):
    found = neardup.find_near_copies(edges, words=5)
    assert found.count() == len(EDGES)
    kept = neardup.keep_one(edges)
    assert kept.columns == edges.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 8]


def test_packing_holds_every_position(spark, edges):
    rows = packing.pack(edges, capacities=(8, 16, 64)).collect()
    by_bin = Counter()
    for r in rows:
        if r["length"]:
            by_bin[(r["shard"], r["bin"], r["capacity"], r["bin_used"])] += r["length"]
    assert all(size == used <= cap for (_, _, cap, used), size in by_bin.items())
    assert sum(r["length"] for r in rows if r["doc_id"] == 8) == 30_001
    assert {r["bin"] for r in rows if r["doc_id"] in (1, 2, 3)} == {None}


def test_best_fit_takes_least_room_and_downsizes():
    bins, offsets, final = packing.best_fit([10, 6, 6, 4, 2], (8, 16), fixed_cost=0)
    assert sorted(Counter(bins).values()) and sum(final) <= 32
    assert all(o >= 0 for o in offsets)
    assert packing.best_fit([3], (8, 16))[2] == [8]


def test_phrases_equal_a_walk_by_substrings():
    parser = langid.CrossParser({"x": "abracadabra abc", "y": "hello yellow"})
    for text in ["abra", "hellow abc", "zzz", "a1b", "yell abr!!"]:
        classes, _ = parser.code([text])
        want = []
        for lang in parser.languages:
            sample = parser.code([{"x": "abracadabra abc", "y": "hello yellow"}[lang]])[0].tolist()
            known = {tuple(sample[i:j]) for i in range(len(sample)) for j in range(i + 1, len(sample) + 1)}
            n, i, c = 0, 0, classes.tolist()
            while i < len(c):
                j = i
                while j < len(c) and c[j] != 0 and tuple(c[i:j + 1]) in known:
                    j += 1
                n, i = n + 1, max(j, i + 1)
            want.append(n)
        assert parser.phrases([text])[0].tolist() == want, text


def test_language_held_out_and_edges(spark, edges):
    rng = random.Random(5)
    parts = {"en": ["th", "ing", "er", "and"], "de": ["sch", "ung", "ich", "ein"]}
    rows = [(i, " ".join("".join(rng.choices(parts[k], k=3)) for _ in range(20)), k)
            for i in range(80) for k in (rng.choice(["en", "de"]),)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parser = langid.learn(docs)
    got = langid.identify(docs, parser).collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.identify(edges, parser).collect()}
    assert odd[1] == odd[2] == odd[3] == "und" and odd[8] != "und"
    assert langid.identify(edges, langid.learn(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_quality_held_out_and_edges(spark, edges):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["good", "clean", "prose", "words"], k=30)) if i % 2 else
             " | ".join(rng.choices(["nav", "menu", "click", "home"], k=30))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)] + [(None, 1, 0), (3, None, 0)],
                                   "doc_id long, quality int, toxic int")
    voter = quality.learn(docs, labels)
    got = quality.classify(docs, voter).collect()
    assert all((r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in got)
    odd = quality.classify(edges, voter)
    assert odd.columns == edges.columns and odd.where("score NOT BETWEEN 0 AND 1").count() == 0
    none = quality.learn(docs, labels.limit(0))
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    rows += [(500, None), (600, []), (700, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (301, rows[5][1]), (302, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id % 100 = 0")
    got = [tuple(r) for r in topk.search(vectors, queries, k=4, shard_rows=64).orderBy("query_id", "rank").collect()]
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows if v and not any(map(math.isnan, v))}
    want = []
    for q in sorted(i for i in whole if i % 100 == 0):
        s = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i)
                   for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:4]
        want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    assert got == want


def test_token_counts_add_up(spark, edges):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    code = tokens.encoding(path, pattern)
    docs = table(spark, ["", "a\n\n\nb", "éé\n一二三\n", "x" * 300 + "\n" + "y"])
    for rule in tokens.RULES:
        total = Counter()
        for r in tokens.count_tokens(docs, path, pattern, rule=rule).collect():
            total[r["doc_id"]] += r["n_tokens"]
        assert total == {r["doc_id"]: len(code.encode_ordinary(r["text"])) for r in docs.collect()} | {0: 0}
    assert tokens.count_tokens(edges, path, pattern, fields=("text", "row"), by_line=False).count() == 2 * len(EDGES)
    starts = np.array([0, 3, 5])
    assert tokens.allocate(np.array([2, 1]), np.array([4, 5]), starts, "most")[0].tolist() == [1, 0]


def test_language_model_counts_and_gain(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        kind = rng.random() < 0.5
        rows.append((i, " ".join(rng.choice(("ab", "cd") if kind else ("xy", "zw")) for _ in range(40))))
    rows += [(1000, None), (1001, "unseen words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    training = docs.where("doc_id % 7 <> 2 AND doc_id < 1000")
    got = {r["doc_id"]: r for r in lm.score_texts(docs, training).collect()}
    count = Counter()
    for i, t in rows:
        if i % 7 != 2 and i < 1000:
            count.update([*t.split(), ""])
    total, distinct = sum(count.values()), len(count)
    for i, t in rows:
        own = [*(t or "").split(), ""]
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in own)
        assert got[i]["n_tokens"] == len(own) and got[i]["train_tokens"] == total
        assert got[i]["n_known"] == sum(count[w] > 0 for w in own)
        assert abs(got[i]["base_score"] - base) < 1e-6
    held = [i for i in range(300) if i % 7 == 2]
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)


def test_url_rules_and_edges(spark):
    rows = [(1, None), (2, "abc"), (3, "http://WWW.Example.com/en/1?x"), (4, "http://example.com/en/a"),
            (5, "ftp://a.net/es/x#y"), (6, "http://a.net?/es/"), (7, "://"), (8, "http://xexample.com/en/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect()}
    assert got[1] == got[2] == got[7] == ("", "", None, "allow")
    assert got[3] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[4] == ("example.com", "/en/a", "example.com/en/", "block")
    assert got[5] == ("a.net", "/es/x", "net/es/", "block")
    assert got[6][:3] == ("a.net", "", None)
    assert got[8] == ("xexample.com", "/en/", "com/", "allow")
    assert urls.judge(pages.limit(0)).count() == 0
