"""Context words before a match raise its score.

These builders return Spark SQL text rather than columns: a detection
expression has several thousand nodes, and parsing one string is about twenty
times faster than making the same nodes call by call from Python.
"""

from __future__ import annotations

from piiloom import rules as R
from piiloom.functions.chunks import CHUNK, cut_sql
from piiloom.functions.sqltext import string

_WORD = r"\p{L}\p{M}\p{N}"
_TOKEN = string(rf"[{_WORD}]+")
_NEAR = (200, 4000)
# Of longer tokens only the end is carried: no context word is as long.
_LONG = 256


def _tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), {_TOKEN}, 0)"


def tails_sql(chunks: str, window: int = R.CONTEXT_WINDOW, longest: int = _LONG) -> str:
    """For each chunk the last ``window + 1`` tokens before it, so that no prefix is tokenised per match.

    Empty unless a chunk other than the last is poor in tokens, which is told by a look at the
    chunks' beginnings: only then can a match have too few tokens near it.  One walk over the text.
    """
    many = string(rf"(?<![{_WORD}])(?:[{_WORD}]++[^{_WORD}]++){{{window + 1}}}")
    ends = string(rf"[{_WORD}]\z")
    tokens = f"regexp_extract_all(x, {_TOKEN}, 0)"
    kept = (f"transform(array({tokens}), t -> transform(slice(t, greatest(size(t) - {window}, 1), {window + 1}),"
            f" w -> right(w, {longest})))")
    # x: what is carried and the chunk, in which a token may go on
    carry = f"transform(array(concat(acc.carry, c)), x -> concat(array_join(flatten({kept}), ' '), if(x rlike {ends}, '', ' ')))"
    step = (f"get(transform({carry}, n -> named_struct('tails', concat(acc.tails, array(n)), 'carry', n)), 0)")
    before = f"slice({chunks}, 1, size({chunks}) - 1)"
    return (f"if(size({chunks}) > {_NEAR[-1] // CHUNK} and exists({before}, c -> not c rlike {many}),"
            f" aggregate({before}, named_struct('tails', array(''), 'carry', ''), (acc, c) -> {step}, acc -> acc.tails),"
            " cast(array() as array<string>))")


def preceding_words_sql(chunks: str, start: str, window: int = R.CONTEXT_WINDOW, tails: str | None = None) -> str:
    """The last ``window`` lower-cased tokens before ``start``, space-joined and padded.

    ``chunks`` is the text cut by :func:`piiloom.functions.chunks.chunks_sql`.
    Looks at the 200 characters before the match, then at 4000.  If those hold
    too few tokens to be sure (the first may be cut), the tokens before the match's chunk (``tails``, see
    :func:`tails_sql`) and those in it are taken, or without tails those of the whole prefix, so
    the answer never depends on the shortcut.
    """
    words = _tokens(cut_sql(chunks, "0", start))
    if tails:
        # a start at the very end of a text of whole chunks lies in no chunk
        at = f"least(({start}) div {CHUNK}, size({tails}) - 1)"
        rest = f"concat(get({tails}, {at}), substring(get({chunks}, {at}), 1, ({start}) - {at} * {CHUNK}))"
        words = f"if(size({tails}) > 0, {_tokens(rest)}, {words})"
    for size in reversed(_NEAR):
        near = _tokens(cut_sql(chunks, f"greatest({start} - {size}, 0)", f"least({start}, {size})"))
        words = (f"get(transform(array({near}), w{size} -> if({start} <= {size}"
                 f" or size(w{size}) > {window}, w{size}, {words})), 0)")
    last = (f"transform(array({words}), w ->"
            f" slice(w, greatest(size(w) - {window - 1}, 1), {window}))")
    return f"concat(' ', array_join(flatten({last}), ' '), ' ')"


def near_words_sql(chunks: str, start: str, context: str, word_lists,
                   window: int = R.CONTEXT_WINDOW, tails: str | None = None) -> str:
    """Whether a word of list number ``context`` is among the tokens before ``start``."""
    cases = []
    for i, words in enumerate(word_lists):
        hits = " or ".join(f"contains(p, {string(' ' + w.lower() + ' ')})" for w in words)
        cases.append(f"when {i} then {hits}")
    before = preceding_words_sql(chunks, start, window, tails)
    return f"exists(array({before}), p -> case {context} {' '.join(cases)} else false end)"


def longest_word(word_lists) -> int:
    """Characters of a token that are worth keeping: more than any context word has."""
    return max([_LONG, *(len(w) + 1 for words in word_lists for w in words)])


def raised_score(score: float, boost: float = R.CONTEXT_BOOST,
                 floor: float = R.CONTEXT_FLOOR) -> float:
    """A rule's score when one of its context words precedes the match."""
    return min(1.0, max(score + boost, floor))
