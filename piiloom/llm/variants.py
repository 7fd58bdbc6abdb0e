"""Grouping spelling variants: words one inserted, deleted or replaced letter apart.

Candidates meet in blocks.  If two words are one edit apart and the shorter has b letters,
they share the first b // 2 letters or the last b - b // 2 (the edit is behind the
former or before the latter), so each word goes under four keys: its prefix and its suffix,
as the shorter word and as the longer one.  Keys are counted, small ones are dealt
together into blocks of about ``block`` words, and a key with more words is cut into slices
of which every two meet in a tile of their own: no task grows with a key, and no pair is left out.

A block is compared by a bit-sliced index: for each position and letter a bitset of the
words that have the letter there.  A query keeps three bitsets: words equal to it so far
(no error), words with one letter replaced, and words with one letter inserted (one error).
One position of all queries is a few word-parallel operations: equal words go on where the
letter fits, words with an error go on where the letter at the same, or at the shifted position
fits, and equal words that do not fit turn into words with an error.  Deletions are the insertions
seen from the longer word.

Forms point from a word to its most frequent near word and at least double the count, so chains
are short; they are followed by doubling the pointers until none moves.

Defined results: null and empty texts have no words; a null id counts as an empty one.  Repeated rows
count as often as they come.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piiloom.llm.common import LOWER, UPPER, stored, work_folder

RUN = r"[A-Za-z\u00C0-\u00FF]+"
#: Letters of a block's longest side: long words come in smaller blocks.
LETTERS = 2_000_000
_KEY = ["length", "suffix", "key"]


def noisy_words(docs: DataFrame, one_in: int | None) -> DataFrame:
    """One row per run of letters: ``word``, A-Z lower-cased.

    With ``one_in``, a run loses one letter where that number divides the crc32 of id and run.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    # most runs are lower case already
    low = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER))
    runs = runs.select("id", low.alias("run"))
    if one_in is None:
        return runs.select(F.col("run").alias("word"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at),
                   F.substring(F.col("run"), at + 2, F.char_length("run")))
    return runs.select(F.when(h % one_in == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_length: int, min_count: int) -> DataFrame:
    """Distinct words of ``min_length`` letters that occur ``min_count`` times: ``word, n``."""
    return (words.where(F.char_length("word") >= min_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def _keys(words: DataFrame, min_length: int) -> DataFrame:
    """``words`` under each of their keys: ``length`` (of the shorter word), ``suffix``, ``key``."""
    size = F.char_length("word")
    half = F.floor(F.col("length") / 2).cast("int")
    places = (words.withColumn("length", F.explode(F.array(size, size - 1)))
              .where(F.col("length") >= min_length)
              .withColumn("suffix", F.explode(F.array(F.lit(False), F.lit(True)))))
    return places.withColumn("key", F.when(F.col("suffix"), F.right("word", F.col("length") - half))
                             .otherwise(F.substring(F.col("word"), F.lit(1), half)))


def _block_size(block: int) -> Column:
    return F.greatest(F.lit(64), F.least(F.lit(block), F.floor(F.lit(LETTERS) / (F.col("length") + 1))))


def into_blocks(words: DataFrame, min_length: int, block: int) -> DataFrame:
    """``words`` in every block they meet others in: ``length, suffix, whole, i, j, key, part, word, n``.

    ``whole``: the key, if it has tiles of its own.
    """
    keyed = _keys(words, min_length)
    counted = keyed.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("rows")).withColumn("limit", _block_size(block))
    small = counted.where(F.col("rows") <= F.col("limit")).groupBy("length", "suffix").agg(
        F.ceil(F.sum("rows") / F.first("limit")).alias("blocks"))
    planned = counted.join(small, ["length", "suffix"], "left").select(
        *_KEY, F.when(F.col("rows") > F.col("limit"), F.ceil(F.col("rows") / F.col("limit"))).alias("slices"),
        "blocks")
    rows = keyed.join(planned, _KEY)
    alone = F.pmod(F.xxhash64(*_KEY), F.col("blocks"))
    part = F.pmod(F.xxhash64("word"), F.col("slices"))
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), lambda other: F.struct(
        F.least("part", other).alias("i"), F.greatest("part", other).alias("j")))
    rows = rows.withColumn("part", F.when(F.col("slices").isNull(), alone).otherwise(part))
    own = F.array(F.struct(F.col("part").alias("i"), F.col("part").alias("j")))
    whole = F.when(F.col("slices").isNotNull(), F.col("key"))
    return rows.withColumn("whole", whole).select(
        "length", "suffix", "whole", "key", "part", "word", "n",
        F.inline(F.when(F.col("slices").isNull(), own).otherwise(tiles)))


def letters_of(words: Sequence[str], width: int) -> np.ndarray:
    """Code points of words of at most ``width`` letters, one row each, 0 behind the end."""
    text = "".join(w.ljust(width, "\0") for w in words)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), width)


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words."""
    packed = np.packbits(flags, axis=-1, bitorder="little")
    wide = np.zeros((*flags.shape[:-1], -(-flags.shape[-1] // 64) * 8), np.uint8)
    wide[..., :packed.shape[-1]] = packed
    return wide.view(np.uint64)


def near_pairs(words: Sequence[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(q, v)`` of words one edit apart, q of ``length`` letters, v of as many or one more.

    All ``words`` are distinct for the pairs to be right, and of either length.
    """
    letters = letters_of(words, length + 1)
    longer = letters[:, length] != 0
    asked = np.flatnonzero(~longer)
    queries = letters[asked]
    none = np.zeros(-(-len(words) // 64), np.uint64)
    equal = np.broadcast_to(_bits(np.ones(len(words), bool)), (len(asked), len(none))).copy()
    replaced, inserted = np.zeros_like(equal), np.zeros_like(equal)
    for i in range(length + 1):
        found, row = np.unique(letters[:, i], return_inverse=True)
        # one bitset for each letter at this position, and an empty one for the others
        index = np.vstack([_bits(np.arange(len(found))[:, None] == row.reshape(1, -1)), none])

        def at(wanted: np.ndarray) -> np.ndarray:
            place = np.searchsorted(found, wanted)
            known = found[np.minimum(place, len(found) - 1)] == wanted
            return index[np.where(known, place, len(found))]

        shifted = inserted & at(queries[:, i - 1]) if i else inserted
        inserted = shifted | equal
        if i < length:
            fits = at(queries[:, i])
            replaced = (replaced & fits) | (equal & ~fits)
            equal = equal & fits
    long_bits = _bits(longer)
    hits = (replaced & ~long_bits) | (inserted & long_bits)
    q, word = np.nonzero(hits)
    ones = np.unpackbits(hits[q, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    r, bit = np.nonzero(ones)
    return asked[q[r]], word[r] * 64 + bit


def _near_of_block(block: pd.DataFrame) -> pd.DataFrame:
    """For each word of a block that has near words: how many, and the one of largest n."""
    length, suffix = int(block["length"].iloc[0]), bool(block["suffix"].iloc[0])
    tile = block["i"].iloc[0] != block["j"].iloc[0]
    words, n = block["word"].to_numpy(object), block["n"].to_numpy(np.int64)
    # a word is in a block under several keys only if they were dealt together: one row each
    key, part = pd.factorize(block["key"])[0], block["part"].to_numpy()
    q, v = near_pairs(words, length)
    keep = key[q] == key[v]
    if tile:
        keep &= part[q] != part[v]
    q, v = q[keep], v[keep]
    if suffix:  # pairs that share their beginning met under that
        half = length // 2
        heads = pd.factorize(np.array([w[:half] for w in words], object))[0]
        apart = heads[q] != heads[v]
        q, v = q[apart], v[apart]
    back = np.fromiter((len(words[x]) > length for x in v), bool, len(v))
    q, v = np.concatenate([q, v[back]]), np.concatenate([v, q[back]])
    order = np.empty(len(words), np.int64)
    order[sorted(range(len(words)), key=lambda x: (-n[x], words[x]))] = np.arange(len(words))
    pairs = pd.DataFrame({"q": q, "v": v, "order": order[v]}).sort_values(["q", "order"], kind="stable")
    first = pairs.drop_duplicates("q")
    counts = pairs.groupby("q").size()
    return pd.DataFrame({"word": words[first["q"]], "near": counts.loc[first["q"]].to_numpy(np.int64),
                         "best": words[first["v"]], "best_n": n[first["v"]]})


def near_words(words: DataFrame, min_length: int, block: int = 2048) -> DataFrame:
    """``word, n_near, best, best_n`` of words with near words; ties of n to the smallest word."""
    found = into_blocks(words, min_length, block).groupBy("length", "suffix", "whole", "i", "j").applyInPandas(
        _near_of_block, "word string, near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return (found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n")))


def roots(links: DataFrame, folder: str) -> DataFrame:
    """``word, root`` for every ``word, form``: the last word of its chain, by pointer doubling."""
    reach = links.select("word", F.col("form").alias("root"))
    step = 0
    while True:
        reach = stored(reach, f"{folder}/step{step}")
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = reach.join(onward, "root", "left")
        if moved.where(F.col("next").isNotNull()).isEmpty():
            return reach
        reach = moved.select("word", F.coalesce("next", "root").alias("root"))
        step += 1


def group_variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, times: int = 2,
                   one_in: int | None = None, block: int = 2048) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary of ``docs``.

    ``form``: the near word of largest n, if that is at least ``times`` the word's own.  ``one_in``
    deletes letters from some runs first (see :func:`noisy_words`).
    """
    if min_length < 1:
        raise ValueError("words have one letter at least")
    folder = work_folder(docs.sparkSession, "variants")
    words = stored(vocabulary(noisy_words(docs, one_in), min_length, min_count), f"{folder}/words")
    taken = F.col("best_n") >= times * F.col("n")
    formed = stored(words.join(near_words(words, min_length, block), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n")),
        f"{folder}/formed")
    last = roots(formed.where(F.col("form").isNotNull()), f"{folder}/roots")
    return formed.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
