"""Phrase collocations by marginalising the longest windows.

Every word of a piece begins one window: the word and, in lead columns, the words
after it, padded with null where the piece ends.  Only these longest windows are
counted.  Spark's ROLLUP sums them over ever shorter prefixes, and since each
position begins exactly one window, the sum of a prefix is the number of
occurrences of that phrase: one explosion gives the counts of all orders.  The lead
columns are made by shifting the word array in its row, which needs no sort.

Windows are counted in ``rounds`` slices by a hash of their first word.  All prefixes of
a window begin with that word, so slices are independent and the shuffle files of one
are gone before the next begins.  Each slice leaves only phrases that occur
``min_count`` times; parts of such phrases occur as often, so the joins that score
and drop candidates run on that small table.

Defined results: a null or empty text has no words, a null language is ``und``, a null
id changes nothing (ids are not read).  Repeated rows count as often as they come.  An
empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piiloom.functions.text import lookup
from piiloom.llm.common import CLEAN, LOWER, UPPER, settings, stored, work_folder
from piiloom.llm.langid import UNDETERMINED

BREAKS = r"[.,;:!?\x0A-\x0D]"
MILLION = 1_000_000
ROUND = {
    **CLEAN,
    # a first map of 65,536 keys in front of the hash table is no help where keys hardly repeat
    "spark.sql.codegen.aggregate.map.twolevel.enabled": "false",
}


def lowered(text: Column) -> Column:
    """A-Z lower-cased; plain ASCII by the quicker way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def windows(docs: DataFrame, max_words: int) -> DataFrame:
    """One row per word: ``lang, w1 .. w<max_words>``, null beyond the end of the piece."""
    pieces = docs.select(F.coalesce("lang", F.lit(UNDETERMINED)).alias("lang"),
                         F.explode(F.split("text", BREAKS)).alias("piece"))
    # split at one blank: Spark needs no pattern for that, and runs of blanks leave empty words only
    blanks = F.replace(lowered(F.col("piece")), F.lit("\t"), F.lit(" "))
    words = pieces.select("lang", F.array_remove(F.split(blanks, " "), "").alias("w"))
    leads = [F.get("w", F.col("i") + k).alias(f"w{k + 1}") for k in range(1, max_words)]
    return (words.where(F.size("w") > 0).select("lang", "w", F.posexplode("w").alias("i", "w1"))
            .select("lang", "w1", *leads))


def rolled_up(found: DataFrame, max_words: int) -> DataFrame:
    """Windows summed over their prefixes: ``lang, phrase, size, f``; each position of a text is in one window."""
    names = [f"w{k + 1}" for k in range(max_words)]
    later = ", ".join(names[1:])
    rows = found.sparkSession.sql(
        f"SELECT lang, w1, {later}, grouping_id() AS level, count(*) AS f FROM {{found}}"
        f" GROUP BY lang, w1, ROLLUP ({later})", found=found)
    # level 2^k - 1 leaves out the last k columns
    sizes = {(1 << (max_words - size)) - 1: size for size in range(1, max_words + 1)}
    size = lookup(sizes, F.col("level"))
    # a prefix that ends in padding is not a phrase
    padded = reduce(lambda a, b: a | b, [
        (F.col("size") == k + 1) & F.col(w).isNull() for k, w in enumerate(names)])
    return (rows.withColumn("size", size).where(~padded)
            .select("lang", F.concat_ws(" ", *names).alias("phrase"), "size", "f"))


def phrase_counts(docs: DataFrame, folder: str, max_words: int, min_count: int,
                  rounds: int) -> tuple[DataFrame, DataFrame]:
    """Words of each language ``lang, n``, and phrases ``lang, phrase, size, f`` of ``min_count`` or more."""
    parts = []
    for number in range(rounds):
        found = windows(docs, max_words).where(F.pmod(F.xxhash64("w1"), F.lit(rounds)) == number)
        with settings(docs.sparkSession, ROUND):
            parts.append(stored(rolled_up(found, max_words).where((F.col("size") == 1) | (F.col("f") >= min_count)),
                                f"{folder}/slice{number}"))
    every = reduce(lambda a, b: a.unionByName(b), parts)
    totals = every.where("size = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    return totals, every.where(F.col("f") >= min_count)


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (l r)), exactly: products in decimals of 38 digits."""
    wide = [c.cast("decimal(16,0)") for c in (a, left, right)]
    return F.call_function("div", F.lit(MILLION).cast("decimal(7,0)") * (wide[0] * wide[0]), wide[1] * wide[2])


def cut_scores(phrases: DataFrame, max_words: int) -> DataFrame:
    """Each phrase of two words or more with its lowest-scoring cut: ``lang, phrase, size, a, l, r, score``."""
    part = phrases.select("lang", "phrase", "f")
    first = part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rest = part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cut = F.expr("substring_index(phrase, ' ', k)")
    cuts = (phrases.where("size > 1").withColumnRenamed("f", "a")
            .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
            .withColumn("first", cut)
            .withColumn("rest", F.expr("substring(phrase, char_length(first) + 2)")))
    scored = (cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"])
              .withColumn("score", score(F.col("a"), F.col("l"), F.col("r"))))
    if max_words == 2:
        return scored.select("lang", "phrase", "size", "a", "l", "r", "score")
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return (scored.groupBy("lang", "phrase", "size", "a").agg(lowest)
            .select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score"))


def covered_counts(phrases: DataFrame, max_words: int) -> DataFrame:
    """For phrases inside longer ones, the count of the most frequent: ``lang, phrase, longer``."""
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    return (phrases.where("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f")
            .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))


def top_of_each(rows: DataFrame, key: str, order: list[Column], k: int, parts: int) -> DataFrame:
    """The first ``k`` rows of each key with their rank; large keys are first thinned in ``parts`` parts."""
    within = Window.partitionBy(key, "_part").orderBy(*order)
    whole = Window.partitionBy(key).orderBy(*order)
    return (rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
            .withColumn("_place", F.row_number().over(within)).where(F.col("_place") <= k)
            .withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
            .drop("_part", "_place"))


def mine(docs: DataFrame, max_words: int = 3, min_count: int = 10, inside_percent: int = 50,
         top: int = 2000, rounds: int = 3, parts: int = 16) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase inside a longer candidate with at least ``inside_percent`` per cent of
    its count is dropped, whether or not the longer one is dropped itself.
    """
    if max_words < 2:
        raise ValueError("a phrase has two words at least")
    folder = work_folder(docs.sparkSession, "collocations")
    totals, phrases = phrase_counts(docs, folder, max_words, min_count, rounds)
    scored = cut_scores(phrases, max_words)
    if max_words > 2:
        scored = (scored.join(covered_counts(phrases, max_words), ["lang", "phrase"], "left")
                  .where(F.coalesce(100 * F.col("longer") < inside_percent * F.col("a"), F.lit(True)))
                  .drop("longer"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = top_of_each(scored, "lang", order, top, parts)
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
