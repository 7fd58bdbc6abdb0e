"""URL filter by a tree of path templates per host, in DataFrame functions only.

Rules come first: the longest that fits decides.  For the others, each host's paths form a
tree as deep as its deepest path.  A segment with a digit or of more than 32 characters is
``*`` (its extension stays), and where a place takes more than ``MANY`` different
names its names are all ``**``.  Labels are the verdicts of the rules, as block or allow, counted
per node.  A branch whose share of blocked pages lies within ``ALIKE`` standard errors
of its parent's is merged with the other such branches there; each branch further off stays
by itself.  A page's share starts from that of all labelled pages and goes down its path: a
branch by itself counts its own labels, a merged one those of its group, smoothed by
``PRIOR`` pages of the share above; if no branch of a place is by itself, the place's
share holds below it.  A branch without labels belongs to the merged ones, so it takes the
share of the branches it is merged with and of its nearest labelled place.  A template is
rejected where its share reaches ``REJECT``; on a host without any labelled page nothing speaks
against a page and it is allowed.

Pages are first counted by host and path; tree, merging and shares work on these counts, exploded
once per segment, and pages meet them by one join that adaptive execution may split, so a host
with a third of all pages is no hot task.  Names that are made ``**`` bring branches together, so that
more names may meet at the places below: this goes on until no place is too wide, which takes a round
for each wide place above another.  The work for one path grows with the square of its segments.

Defined results: a null url or one without ``://`` has an empty host and path, fits no
rule, and is judged as a page of the host ''.  Without any rule verdict among the
pages everything else is allowed.  Repeated rows are counted and judged as often as they come.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piiloom.llm.common import LOWER, UPPER, stored, work_folder

#: Verdict, host and path prefix of each rule.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"),
         ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
MANY = 20
PRIOR = 8.0
ALIKE = 2.0
REJECT = 0.5
_ANY = "**"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host up to ``/``, ``?``, ``#`` or end, lower-cased in A-Z; path up to ``?``, ``#`` or end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    before = F.split_part(F.split_part(rest, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    host = F.split_part(before, F.lit("/"), F.lit(1))
    return F.translate(host, UPPER, LOWER), F.substring(before, F.length(host) + 1, F.length(before))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The verdict and text of the longest rule that fits, or null."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, own, prefix in reversed(longest):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"),
                                      F.lit(own + prefix).alias("rule"))).otherwise(found)
    return found


def segment_template(segment: Column) -> Column:
    """A variable-looking segment as ``*`` (its extension stays), any other as it is."""
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    tail = F.substring(segment, F.length(stem) + 1, F.length(segment))
    variable = stem.rlike(r"[0-9]") | (F.length(stem) > 32)
    return F.when(variable, F.concat(F.lit("*"), tail)).otherwise(segment)


def segments(path: Column) -> Column:
    """The template segments of a path, empty for the host's root."""
    inner = F.regexp_replace(path, "^/|/$", "")
    parts = F.when(inner == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(inner, "/"))
    return F.transform(parts, segment_template)


def prefix_key(names: Column, depth: Column) -> Column:
    """A key of the first ``depth`` names of a path; hashed, so that long paths stay narrow."""
    return F.md5(F.array_join(F.slice(names, F.lit(1), depth), "/").cast("binary"))


def generalised(paths: DataFrame) -> DataFrame:
    """``paths`` (host, raw, names) with ``**`` for all names at places that take more than ``MANY``."""
    spark = paths.sparkSession
    while True:
        at = F.explode(F.sequence(F.lit(1), F.size("names"))).alias("d")
        steps = paths.where(F.size("names") > 0).select("host", "raw", "names", at).select(
            "host", "raw", "d", prefix_key(F.col("names"), F.col("d") - 1).alias("place"),
            F.get("names", F.col("d") - 1).alias("name"))
        wide = (steps.groupBy("host", "d", "place", "name").agg(F.lit(1).alias("one"))
                .groupBy("host", "d", "place")
                .agg(F.count("one").alias("names"), F.max(F.col("name") == _ANY).alias("any"))
                .where((F.col("names") > MANY) | (F.col("any") & (F.col("names") > 1)))
                .select("host", "d", "place"))
        wide = stored(wide, work_folder(spark, "url-wide"))
        if wide.isEmpty():
            return paths
        # a row per path with the depths at which it has such a place: no more than its segments
        found = (steps.join(wide, ["host", "d", "place"]).groupBy("host", "raw")
                 .agg(F.collect_set("d").alias("at")))
        named = F.transform("names", lambda x, i: F.when(F.array_contains("at", i + 1), _ANY).otherwise(x))
        paths = stored(paths.join(found, ["host", "raw"], "left").select(
            "host", "raw", F.when(F.col("at").isNull(), F.col("names")).otherwise(named).alias("names"),
            "b", "n"), work_folder(spark, "url-paths"))


def shares(paths: DataFrame) -> DataFrame:
    """``host, raw, template, share`` of ``paths`` (host, raw, names, b blocked of n labelled pages)."""
    total = paths.agg(F.sum("b").cast("double"), F.sum("n").cast("double")).first()
    overall = total[0] / total[1] if total[1] else 0.0
    merged = paths.groupBy("host", "names").agg(F.sum("b").cast("double").alias("b"),
                                                F.sum("n").cast("double").alias("n"))
    steps = merged.select("host", "names", "b", "n", F.explode(F.sequence(F.lit(0), F.size("names"))).alias("d"))
    steps = steps.select("host", "names", "d", "b", "n", prefix_key(F.col("names"), F.col("d")).alias("k"),
                         F.when(F.col("d") > 0, prefix_key(F.col("names"), F.col("d") - 1)).alias("up"))
    nodes = stored(steps.groupBy("host", "d", "k", "up").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
                   .where("n > 0"), work_folder(paths.sparkSession, "url-nodes"))
    above = nodes.select("host", (F.col("d") + 1).alias("d"), F.col("k").alias("up"),
                         (F.col("b") / F.col("n")).alias("p"))
    error = F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    far = F.abs(F.col("b") / F.col("n") - F.col("p")) > ALIKE * error
    branches = nodes.join(above, ["host", "d", "up"]).withColumn("far", far)
    # places at which a branch is by itself, with the labels of the merged others
    groups = (branches.groupBy("host", "d", "up").agg(
        F.sum(F.when(~F.col("far"), F.col("b")).otherwise(0.0)).alias("mb"),
        F.sum(F.when(~F.col("far"), F.col("n")).otherwise(0.0)).alias("mn"), F.max("far").alias("split"))
        .where("split").drop("split"))
    alone = branches.where("far").select("host", "d", "k", F.col("b").alias("ob"), F.col("n").alias("on"))
    roots = nodes.where("d = 0").select("host", "d", "k", F.col("b").alias("ob"), F.col("n").alias("on"))
    evidence = F.struct("d", F.coalesce("ob", "mb", F.lit(0.0)).alias("b"), F.coalesce("on", "mn", F.lit(0.0)).alias("n"))
    # one element per segment of a path
    chains = (steps.select("host", "names", "d", "k", "up").join(alone.unionByName(roots), ["host", "d", "k"], "left")
              .join(groups, ["host", "d", "up"], "left").groupBy("host", "names")
              .agg(F.array_sort(F.collect_list(evidence)).alias("chain")))
    share = F.aggregate("chain", F.lit(overall), lambda acc, x: (x["b"] + PRIOR * acc) / (x["n"] + PRIOR))
    known = chains.select("host", "names", F.when(F.get("chain", F.lit(0))["n"] > 0, share).alias("share"))
    return paths.join(known, ["host", "names"]).select(
        "host", "raw", F.concat(F.lit("/"), F.array_join("names", "/")).alias("template"), "share")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, share`` of every page."""
    host, path = host_and_path(F.col("url").cast("string"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    named = named.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    names = segments(F.col("path"))
    # size and names make the key of a path exact: the root and an empty first segment differ
    named = named.withColumn("raw", F.concat_ws("/", F.size(names).cast("string"), names))
    placed = stored(named, work_folder(pages.sparkSession, "url-pages"))
    paths = placed.groupBy("host", "raw").agg(
        F.sum((F.col("found.verdict") == "block").cast("int")).alias("b"), F.count("found").alias("n"))
    paths = paths.select("host", "raw", F.slice(F.split("raw", "/"), F.lit(2), F.length("raw")).alias("names"),
                         F.coalesce("b", F.lit(0)).alias("b"), "n")
    paths = generalised(stored(paths, work_folder(pages.sparkSession, "url-paths")))
    judged = placed.join(shares(paths), ["host", "raw"], "left")
    by_template = F.when(F.col("share") >= REJECT, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), by_template).alias("verdict"), "template", "share")
