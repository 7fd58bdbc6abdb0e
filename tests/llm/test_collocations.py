"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from piiloom.llm import collocations

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, max_words=3, min_count=10, percent=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for size in range(1, max_words + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i:i + size])] += 1
    found = {}
    for (lang, words), a in f.items():
        if len(words) > 1 and a >= min_count:
            cuts = []
            for k in range(1, len(words)):
                left, right = f[lang, words[:k]], f[lang, words[k:]]
                cuts.append((1_000_000 * a * a // (left * right), k, left, right))
            found[lang, words] = (a, *min(cuts))
    out = []
    for lang in n:
        kept = []
        for (own, words), (a, score, _, left, right) in found.items():
            inside = any(own == other and len(longer) > len(words) and 100 * b[0] >= percent * a
                         and any(longer[i:i + len(words)] == words for i in range(len(longer)))
                         for (other, longer), b in found.items())
            if own == lang and not inside:
                kept.append((-score, -a, " ".join(words).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def texts(seed, n=80):
    rng = random.Random(seed)
    words = ["der", "Big", "apple", "é", "É", "new", "york", "city", "a", "b-c", "to", "be"]
    fixed = ["new york city", "big apple", "to be a", "Éé a a a a"]
    out = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(0, 30))]
        text = "".join(p + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "! ", " "]) for p in parts)
        out.append((text, rng.choice(["en", "de", None, "und"])))
    return out


@pytest.mark.parametrize(("seed", "settings"), [
    (1, {}), (2, {"max_words": 2}), (3, {"max_words": 4, "min_count": 3, "inside_percent": 30}),
    (4, {"top": 5, "parts": 3}), (5, {"rounds": 1, "min_count": 2})])
def test_phrases_equal_brute_force(spark, seed, settings):
    rows = texts(seed) + [(None, "en"), ("", None), ("x " * 500, "xx")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    names = {"max_words": "max_words", "min_count": "min_count", "inside_percent": "percent", "top": "top"}
    want = brute(rows, **{names[k]: v for k, v in settings.items() if k in names})
    assert rows_of(collocations.mine(docs, **settings)) == want and want


def test_products_beyond_64_bits_are_exact(spark):
    values = [(10**12 + 7, 10**12 + 11, 10**12 + 9), (3 * 10**14, 3 * 10**14 + 1, 3 * 10**14), (10, 3_000_000_019, 11)]
    df = spark.createDataFrame(values, "a long, l long, r long")
    got = [r[0] for r in df.select(collocations.score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [1_000_000 * a * a // (x * y) for a, x, y in values]


def test_edges(spark):
    schema = "doc_id long, text string, lang string, phrase string, f long, n long, level int, w string, size int"
    assert collocations.mine(spark.createDataFrame([], schema)).count() == 0
    row = ("long tail " * 20_000, "en", "p", 1, 1, 1, "w", 1)
    docs = spark.createDataFrame([(1, *row), (1, *row), (None, None, None, None, None, None, None, None, None)], schema)
    got = rows_of(collocations.mine(docs))
    assert got == brute([("long tail " * 20_000, "en")] * 2 + [(None, None)]) and len(got) == 2


def test_one_exchange_counts_all_orders(spark):
    """The counts of all orders come from one Generate of windows and one aggregation over their prefixes."""
    docs = spark.createDataFrame([("a b", "en")], "text string, lang string")
    found = collocations.rolled_up(collocations.windows(docs, 3), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Expand") == 1
    assert plan.count("Generate") == 2 and plan.count("Window") == 0
