"""Source mixing against a plain water-filling."""

import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from piiloom.llm import mixing


def brute_targets(sizes, weights, epochs=3):
    """Shares by weight, clamped and dealt again until none is above its cap."""
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        room = sum(weights[s] for s in free)
        if not free:
            return fixed
        level = Fraction(total - sum(fixed.values()), room)
        over = [s for s in free if level * weights[s] > epochs * sizes[s]]
        if not over:
            return {**fixed, **{s: level * weights[s] for s in free}}
        fixed.update({s: epochs * sizes[s] for s in over})


def cyclic(sources, cycle=(1, 2, 3)):
    return {s: cycle[i % len(cycle)] for i, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}


def documents(seed, n=300, sources=9):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(sources - 2)] + ["É", None]
    out = []
    for i in range(n):
        source = names[0] if rng.random() < 0.5 else rng.choice(names)
        words = rng.choice([0, 1, 5, 20, 200]) if rng.random() < 0.97 else 3000
        out.append((i, None if rng.random() < 0.02 else rng.choice([" ", "\n", " \t"]).join(["wörd"] * words), source))
    return out


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, got, weights, epochs):
    sizes, longest = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size_of(text)
        longest[source] = max(longest[source], size_of(text))
    want = brute_targets(sizes, weights, epochs)
    taken = defaultdict(int)
    assert sorted((str(r["doc_id"]), r["size"], str(r["source"])) for r in got) == sorted(
        (str(i), size_of(t), str(s)) for i, t, s in rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(want[r["source"]]), rel=1e-12)
        assert r["taken"] in (r["size"] * r["whole"], r["size"] * (r["whole"] + 1))
        assert r["taken"] <= epochs * r["size"]
        taken[r["source"]] += r["taken"]
    for source, target in want.items():
        assert abs(taken[source] - target) <= longest[source] / 2 + 1e-6
    return want


@pytest.mark.parametrize("seed", range(4))
def test_mix_equals_plain_water_filling(spark, seed):
    rows = documents(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    want = check(rows, got, cyclic({s for *_, s in rows}), 3)
    assert any(w == 3 * sum(size_of(t) for _, t, s in rows if s == source) for source, w in want.items()) or seed
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r["doc_id"], r["taken"], r["target"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    other = mixing.mix(docs, seed="other").collect()
    assert sorted(map(key, got)) != sorted(map(key, other))


def test_clamped_in_several_rounds(spark, tmp_path):
    sizes = {"a": 1, "b": 4, "c": 20, "d": 90, "e": 1000}
    weights = dict.fromkeys(sizes, 1)
    frame = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, weight long")
    level = mixing.water_level(frame, 3)
    want = brute_targets(sizes, weights)
    got = {r["source"]: r["target"] for r in mixing.with_targets(frame, level, 3).collect()}
    assert got == {s: float(w) for s, w in want.items()} and level == Fraction(1115 - 3 * 115)


def test_given_weights_and_epochs(spark):
    rows = documents(9, sources=4)
    weights = {s: w for w, s in enumerate(sorted({s for *_, s in rows}, key=str), 2)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    table = spark.createDataFrame(list(weights.items()), "source string, weight int")
    check(rows, mixing.mix(docs, table, epochs=2).collect(), weights, 2)


def test_order_of_many_sources(spark, tmp_path):
    names = [f"{i:04d}" for i in range(500)] + ["É", "z", None]
    random.Random(1).shuffle(names)
    frame = spark.createDataFrame([(s, 1) for s in names], "source string, source_size long")
    got = mixing.cyclic_weights(frame, (1, 2, 3), str(tmp_path / "placed"))
    assert {r["source"]: r["weight"] for r in got.collect()} == cyclic(names)


def test_edges(spark):
    schema = "doc_id long, text string, source string, size long, bin int, place long, target double, weight long, whole long"
    clash = (1, 1, 1, 1.0, 1, 1)
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    blank = spark.createDataFrame([(1, None, "a", *clash), (2, " ", None, *clash)], schema)
    assert {(r["doc_id"], r["size"], r["target"], r["taken"]) for r in mixing.mix(blank).collect()} == {
        (1, 0, 0.0, 0), (2, 0, 0.0, 0)}
    rows = [(1, "a b", "x"), (1, "a b", "x"), (1, "a b", "x"), (None, "w " * 50_000, "y"), (None, None, None), (4, "", "y")]
    got = mixing.mix(spark.createDataFrame([(*r, *clash) for r in rows], schema)).collect()
    check(rows, got, cyclic({"x", "y", None}), 3)


def test_no_python_on_the_path(spark):
    docs = spark.createDataFrame(documents(2), "doc_id long, text string, source string")
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "ExternalRDD"))
