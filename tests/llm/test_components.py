"""Components of links against a plain walk: paths, stars, cycles, repeated and empty links."""

from __future__ import annotations

import random

import pytest

from piiloom.llm.graph import are_stars, components


def brute(links):
    root = {x: x for e in links for x in e}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


PATH = list(range(40))
random.Random(4).shuffle(PATH)
CASES = {
    "none": [],
    "star": [(1, k) for k in range(2, 30)],
    "path": list(zip(PATH, PATH[1:], strict=False)),
    "mixed": [(5, 9), (9, 5), (5, 9), (9, 2), (20, 21), (21, 22), (22, 20), (30, 30), (31, 40), (-7, 40)],
}


@pytest.mark.parametrize("name", CASES)
def test_components_equal_a_walk(spark, tmp_path, name):
    links = spark.createDataFrame(CASES[name], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links, str(tmp_path)).collect()}
    assert got == brute([e for e in CASES[name] if e[0] != e[1]])


def test_stars_are_told_from_chains_and_forks(spark):
    def frame(rows):
        return spark.createDataFrame(rows, "u long, v long")

    assert are_stars(frame([])) and are_stars(frame([(2, 1), (3, 1), (5, 4)]))
    assert not are_stars(frame([(2, 1), (3, 2)]))
    assert not are_stars(frame([(3, 1), (3, 2)]))
