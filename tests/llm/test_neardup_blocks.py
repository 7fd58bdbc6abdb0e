"""Counts of shared values in blocks, and the bound that fine registers give, against plain sets."""

from __future__ import annotations

import numpy as np
import pytest

from piiloom.llm import neardup


@pytest.mark.parametrize("cells", [1 << 20, 64])
def test_shared_counts_equal_intersections(monkeypatch, cells):
    monkeypatch.setattr(neardup, "_CELLS", cells)
    rng = np.random.default_rng(1)
    for _ in range(20):
        sets = [np.unique(rng.integers(0, 400, rng.integers(1, 80)).astype(np.uint32) * 65537)
                for _ in range(rng.integers(2, 40))]
        rows = np.flatnonzero(rng.random(len(sets)) < 0.7)
        size = np.array([len(s) for s in sets])
        seen = []
        for part, same in neardup.shared_counts(np.concatenate(sets), size, rows):
            for k, x in enumerate(part.tolist()):
                seen.append(x)
                assert all(same[k, y] == len(np.intersect1d(sets[x], sets[y]))
                           for y in range(len(sets)) if y != x)
        assert seen == rows.tolist()


@pytest.mark.parametrize("n", [1, 150, 20_000])
def test_lost_shingles_bound_what_is_shared(n):
    rng = np.random.default_rng(n)
    shared = rng.integers(0, 2**64, n, dtype=np.uint64)
    a, b = (np.unique(np.concatenate([shared, rng.integers(0, 2**64, n // 5, dtype=np.uint64)]))
            for _ in range(2))
    fine_a, fine_b = neardup.fine_registers(a), neardup.fine_registers(b)
    same = len(np.intersect1d(fine_a, fine_b, assume_unique=True))
    lost = len(a) - len(fine_a) + len(b) - len(fine_b)
    assert same + lost >= len(np.intersect1d(a, b, assume_unique=True))


@pytest.mark.parametrize("n", [*range(1, 42)])
def test_small_similar_sets_share_a_key(n):
    rng = np.random.default_rng(n)
    for d in range(n // 4 + 1):
        for _ in range(200 // n + 5):
            u = rng.integers(0, 2**64, n + d, dtype=np.uint64)
            for cut in range(d + 1):  # what the smaller set has for itself
                a, b = np.unique(u[:n]), np.unique(u[cut:])
                if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
                    assert set(neardup.band_keys(a).tolist()) & set(neardup.band_keys(b).tolist())


def test_sets_come_to_blocks_once_and_no_link_is_lost(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 256)  # several blocks a bucket
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[k % 3 * 100:][:90 + k % 7], rng.integers(0, 2**64, k % 5, dtype=np.uint64)]))
            for k in range(60)]
    component = [k if k % 4 else 0 for k in range(60)]
    members = spark.createDataFrame([(key, k, component[k], len(s)) for key in (1, 2) for k, s in enumerate(sets)],
                                    "key long, node long, component long, n long")
    fine = spark.createDataFrame([(k, neardup.fine_registers(s).tobytes()) for k, s in enumerate(sets)],
                                 "node long, set binary")
    dealt = neardup.stored(neardup.deal_blocks(members), str(tmp_path / "dealt"))
    assert dealt.columns == ["key", "i", "j", "mains", "own", "node", "component", "n"]
    assert dealt.select("i", "j").distinct().count() > 3
    got = {(r["a"], r["b"]) for r in neardup.matches_in_blocks(dealt, fine, str(tmp_path), 80).collect()}
    for a in range(60):
        for b in range(a + 1, 60):
            shared = len(np.intersect1d(sets[a], sets[b]))
            if component[a] != component[b] and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                assert (a, b) in got


def test_registers_and_keys_are_stored_once(spark, monkeypatch):
    seen = {}
    plain = neardup.stored

    def watch(df, folder):
        seen[folder.rsplit("/", 1)[1]] = set(df.columns)
        return plain(df, folder)

    monkeypatch.setattr(neardup, "stored", watch)
    docs = spark.createDataFrame([(k, f"aa bb cc {k % 3} dd ee ff gg hh ii jj kk") for k in range(9)],
                                 "doc_id long, text string")
    rows = neardup.find_near_copies(docs, words=2).collect()
    assert len({r["class_id"] for r in rows}) == 3
    assert {"regs", "keys"} <= seen["signatures"] and not {"regs", "keys"} & seen["classes"]
