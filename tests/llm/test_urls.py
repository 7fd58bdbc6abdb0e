"""The tree of path templates against a brute-force tree in plain Python."""

import math
import random
import re
from collections import defaultdict

import pytest

from piiloom.llm import urls

COUNTRIES = (("allow", "a.net", "/ok/"), ("block", "net", "/bad/"), ("block", "b.net", "/mix/deep/er/"))


def plain_tree(rows, rules):
    """``page_id -> (verdict, template)`` by walks from the root, place by place."""
    pages = []
    for page, url in rows:
        rest = (url or "").partition("://")[2] if url and "://" in url else ""
        rest = re.split(r"[?#]", rest)[0]
        host, slash, path = rest.partition("/")
        host, path = host.lower(), slash + path
        fits = [(len(own + prefix), verdict) for verdict, own, prefix in rules
                if (host == own or host.endswith("." + own)) and path.startswith(prefix)]
        inner = re.sub(r"^/|/$", "", path)
        names = []
        for part in inner.split("/") if inner else []:
            stem = re.sub(r"\.[A-Za-z]{1,5}$", "", part)
            names.append("*" + part[len(stem):] if re.search("[0-9]", stem) or len(stem) > 32 else part)
        pages.append((page, host, max(fits)[1] if fits else None, names))

    def widen(group, depth):
        """Pages of one place, whose names at ``depth`` are made alike if they are too many."""
        here = {p[3][depth] for p in group if len(p[3]) > depth}
        if len(here) > urls.MANY:
            for p in group:
                p[3][depth:depth + 1] = ["**"] if len(p[3]) > depth else []
        below = defaultdict(list)
        for p in group:
            if len(p[3]) > depth:
                below[p[3][depth]].append(p)
        for own in below.values():
            widen(own, depth + 1)

    by_host = defaultdict(list)
    for p in pages:
        by_host[p[1]].append(p)
    for group in by_host.values():
        widen(group, 0)
    blocked, labels = defaultdict(int), defaultdict(int)
    for _, host, verdict, names in pages:
        for d in range(len(names) + 1):
            key = (host, *names[:d])
            labels[key] += verdict is not None
            blocked[key] += verdict == "block"
    every = sum(n for k, n in labels.items() if len(k) == 1)
    overall = sum(b for k, b in blocked.items() if len(k) == 1) / every if every else 0.0

    def far(key):
        n, p = labels[key], blocked[key[:-1]] / labels[key[:-1]] if labels[key[:-1]] else 0
        return n > 0 and abs(blocked[key] / n - p) > urls.ALIKE * math.sqrt(p * (1 - p) / n)

    keys = list(labels)
    out = {}
    for page, host, verdict, names in pages:
        share = (blocked[host,] + urls.PRIOR * overall) / (labels[host,] + urls.PRIOR)
        for d in range(1, len(names) + 1):
            key = (host, *names[:d])
            group = [k for k in keys if len(k) == len(key) and k[:-1] == key[:-1]]
            if far(key):
                b, n = blocked[key], labels[key]
            elif any(far(k) for k in group):
                b, n = (sum(t[k] for k in group if not far(k)) for t in (blocked, labels))
            else:
                continue
            share = (b + urls.PRIOR * share) / (n + urls.PRIOR)
        judged = "block" if labels[host,] and share >= urls.REJECT else "allow"
        out[page] = verdict or judged, "/" + "/".join(names)
    return out


def random_rows(seed):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcd") for _ in range(4)) for _ in range(60)]
    rows = []
    for i in range(400):
        host = rng.choice(["x.a.net", "A.net", "b.net", "c.net", "d.net", "free.org"])
        first = rng.choice({"x.a.net": ["ok"] * 9 + ["new", "bad"], "A.net": ["ok", "ok", "bad", "new"],
                            "b.net": ["mix"], "c.net": ["bad", "u"], "d.net": ["bad", "bad", "new"]}
                           .get(host, ["ok", "bad"]))
        rest = [rng.choice(names) if first == "u" else rng.choice(["deep", "other"]), rng.choice(["er", "7", "8.html"]),
                rng.choice(["x", "y", ""]), rng.choice(names[:30])][:rng.randint(0, 4)]
        rows.append((i, f"https://{host}/" + "/".join([first, *rest]) + rng.choice(["", "/", "?q=1", "#t"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_equals_brute_force(spark, seed):
    rows = random_rows(seed)
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["template"]) for r in urls.judge(pages, COUNTRIES).collect()}
    assert got == plain_tree(rows, COUNTRIES)


def test_tree_decides_unruled_pages_both_ways(spark):
    pages = spark.createDataFrame(random_rows(1), "page_id long, url string")
    found = urls.judge(pages, COUNTRIES).where("rule IS NULL AND share IS NOT NULL")
    assert {r["verdict"] for r in found.select("verdict").distinct().collect()} == {"allow", "block"}


def test_one_branch_apart_leaves_the_others_merged(spark):
    rows = [(i, "https://a.net/ok/1") for i in range(40)] + [(100 + i, "https://a.net/bad/1") for i in range(3)] + [
        (200, "https://a.net/new/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(pages, COUNTRIES).collect()}
    share = (3 + 8 * 3 / 43) / (43 + 8)
    merged = (0 + urls.PRIOR * share) / (40 + urls.PRIOR)
    assert got[200]["share"] == pytest.approx(merged) and got[0]["share"] == pytest.approx(merged)
    # alone at its place, and its page's name adds nothing
    assert got[100]["share"] == pytest.approx((3 + urls.PRIOR * share) / (3 + urls.PRIOR))


def test_odd_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "http://d.net//"), (5, "http://d.net//"),
            (6, "http://d.net///"), (7, "http://d.net/bad/" + "x/" * 300), (None, "http://d.net/bad/a"),
            (8, "http://d.net/" + "y" * 200_000), (9, "http://É.net/bad/%20.html")]
    pages = spark.createDataFrame(
        [(*r, "host", "path", 1, 2.0) for r in rows],
        "page_id long, url string, host string, names string, n int, share double")
    got = urls.judge(pages, COUNTRIES).collect()
    assert sorted(map(str, (r["page_id"] for r in got))) == sorted(str(r[0]) for r in rows)
    want = plain_tree([(i, u) for i, (_, u) in enumerate(rows)], COUNTRIES)
    assert sorted((r["verdict"], r["template"]) for r in got) == sorted(want.values())
