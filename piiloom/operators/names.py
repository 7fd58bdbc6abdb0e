"""Person names from a caller's dictionary, as detection rules.

A dictionary becomes a trie written as one pattern for each score, so names are found in the same
pass over the text as all other types, with hashes, threshold and suppression, and without a join:
nothing is exchanged for a token.  A pattern is part of the plan, so the dictionary must be small.
Large ones are first cut down to the names whose tokens occur in the documents (distinct tokens leave
each task, not occurrences); what remains is measured in bytes before it is collected.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piiloom import rules as R

#: Names in a pattern, in bytes; a larger dictionary is matched by a join instead.
NAME_BYTES = 200_000
TOKEN = r"[\p{L}\p{M}\p{N}]+"
_INSIDE = r"[\p{L}\p{M}\p{N}]"
_END = ""


class DictionaryTooLarge(ValueError):
    """The names that occur take more bytes than a pattern may have."""


def _escaped(letter: str) -> str:
    if letter == " ":
        return r"[ \t]+"
    return letter if letter.isalnum() or ord(letter) > 127 else "\\" + letter


def _branch(node: dict) -> str:
    ways = [_escaped(c) + _branch(node[c]) for c in sorted(node) if c != _END]
    if not ways:
        return ""
    body = ways[0] if len(ways) == 1 and _END not in node else f"(?:{'|'.join(ways)})"
    # greedy: where a name ends and others go on, the longer ones are tried first
    return body + "?" if _END in node else body


def trie_pattern(names: Iterable[str], ignore_case: bool = False) -> str:
    """A pattern of all ``names`` as whole tokens, longest first; runs of blanks match any such run."""
    root: dict = {}
    for name in names:
        words = name.split()
        if not words:
            raise ValueError("a name may not be empty")
        node = root
        for letter in " ".join(words):
            node = node.setdefault(letter, {})
        node[_END] = {}
    return f"{'(?iu)' if ignore_case else ''}(?<!{_INSIDE}){_branch(root)}(?!{_INSIDE})"


def letter_first(names: Iterable[str], ignore_case: bool = False) -> str:
    """:func:`trie_pattern` that looks at the letter of a place first; most fail there, before the costlier look behind."""
    names = list(names)
    letters = "".join(_escaped(c) for c in sorted({name.split()[0][0] for name in names}))
    return f"{'(?iu)' if ignore_case else ''}(?=[{letters}]){trie_pattern(names, ignore_case)}"


def folded(text: Column, ignore_case: bool) -> Column:
    return F.lower(text) if ignore_case else text


def tidy_names(names: DataFrame, ignore_case: bool) -> DataFrame:
    """Distinct names from their first to their last token, with single blanks, and their highest score."""
    inner = F.regexp_replace("name", r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$", "")
    name = folded(F.regexp_replace(inner, r"(?U)\s+", " "), ignore_case)
    return (names.select(name.alias("name"), F.col("score").cast("double").alias("score"))
            .where("name <> ''").groupBy("name").agg(F.max("score").alias("score")))


def occurring_names(names: DataFrame, docs: DataFrame, ignore_case: bool = False) -> DataFrame:
    """The names all of whose tokens occur somewhere in ``docs``."""
    tokens = F.array_distinct(F.regexp_extract_all("name", F.lit(TOKEN), F.lit(0)))
    wanted = names.select("name", "score", tokens.alias("tokens")).select(
        "name", "score", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    seen = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(
        folded(F.col("text"), ignore_case), F.lit(TOKEN), F.lit(0)))).alias("token")).distinct()
    return (wanted.join(seen, "token", "left_semi").groupBy("name", "score", "n")
            .agg(F.count(F.lit(1)).alias("found")).where("found = n").select("name", "score"))


def name_rules(names: DataFrame, docs: DataFrame | None = None, limit: int = NAME_BYTES,
               ignore_case: bool = False) -> tuple[R.Rule, ...]:
    """PERSON rules for ``names(name, score)``, one for each score (at two places).

    With ``docs`` only names that can occur there are kept.  Names match whole tokens only, as they
    are written unless ``ignore_case``.  Raises :class:`DictionaryTooLarge` beyond ``limit`` bytes, before anything is collected.
    """
    kept = tidy_names(names, ignore_case)
    if docs is not None:
        kept = occurring_names(kept, docs, ignore_case)
    # Stops after the rows that would be over the limit: each name has a byte at least.
    few = kept.limit(limit + 1).persist()
    try:
        size = few.agg(F.sum(F.octet_length("name"))).first()[0] or 0
        if size > limit:
            raise DictionaryTooLarge(f"names of more than {limit} bytes")
        by_score: dict[float, list[str]] = {}
        for row in few.collect():
            by_score.setdefault(round(row["score"], 2), []).append(row["name"])
    finally:
        few.unpersist()
    return tuple(R.Rule(f"person_{round(100 * score):02d}", "PERSON", letter_first(found, ignore_case), score)
                 for score, found in sorted(by_score.items(), reverse=True))
