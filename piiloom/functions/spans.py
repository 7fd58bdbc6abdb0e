"""Span expressions: all matches of a pattern with their code-point offsets.

A span is ``struct<entity_type, subtype, start_offset, end_offset, confidence,
rule>``; offsets are 0-based and end-exclusive.  Everything here is a JVM-side
column expression on one row, so a document's spans never need a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from piiloom import rules as R
from piiloom.functions.chunks import chunks_sql, cut_sql
from piiloom.functions.context import longest_word, near_words_sql, raised_score, tails_sql
from piiloom.functions.sqltext import name, number, string

SPAN_TYPE = ("array<struct<entity_type:string,subtype:string,start_offset:int,"
             "end_offset:int,confidence:double,rule:string>>")
_BLOCK = 256
_GROW = "named_struct('open', part.open, 'kept', concat(total.kept, part.kept))"
_HIT_TYPE = ("array<struct<entity_type:string,subtype:string,start_offset:int,end_offset:int,"
             "confidence:double,raised:double,context:int,rule:string>>")
_NO_HITS = f"cast(array() as {_HIT_TYPE})"
_NO_SPANS = f"cast(array() as {SPAN_TYPE})"


def unicode_pattern(pattern: str) -> str:
    """``pattern`` with Unicode word and space classes on every Java version."""
    return "(?U)" + pattern


def letter_first(pattern: str) -> str:
    """``pattern`` with the plain class that follows its first word bound looked at before the bound.

    A bound asks for the kinds of two characters, a class of ASCII ranges is one table look-up; most places fail there.
    """
    plain = re.match(r"\\b(\[[0-9A-Za-z-]+\])", pattern)
    return f"(?={plain.group(1)}){pattern}" if plain and "|" not in pattern else pattern


def _bind(value: str, variable: str, use: str) -> str:
    """``use`` with ``variable`` standing for ``value``, which is evaluated once."""
    return f"get(transform(array({value}), {variable} -> {use}), 0)"


def _blocks(values: str) -> str:
    """An array cut in blocks.  A fold that appends to its result copies it at
    every step; folding block by block keeps that copying to the block."""
    return _bind(values, "all", f"transform(sequence(0, size(all) div {_BLOCK}),"
                                f" i -> slice(all, i * {_BLOCK} + 1, {_BLOCK}))")


def offsets_sql(text: str, pattern: str) -> str:
    """Every match of ``pattern`` as ``array<struct<start_offset, end_offset>>``.

    ``split`` yields the gaps and ``regexp_extract_all`` the matches; a running
    sum of both lengths gives the offsets.  Both arrays are bound once, so each
    regex pass runs once per row and not once per match; folding block by block
    keeps array growth cheap on texts with very many matches.
    """
    regex = string(pattern)
    gaps, hits = f"split({text}, {regex}, -1)", f"regexp_extract_all({text}, {regex}, 0)"
    # The gap after the last match has no match beside it and drops out.
    steps = ("slice(zip_with(gaps, hits, (gap, hit) -> char_length(gap) + char_length(hit)),"
             " 1, size(hits))")
    within = ("aggregate(block, array(element_at(ends, -1)), (part, step) ->"
              " concat(part, array(element_at(part, -1) + step)))")
    ends = (f"aggregate({_blocks(steps)}, array(0),"
            f" (ends, block) -> concat(ends, slice({within}, 2, size(block))))")
    spans = (f"zip_with(hits, slice({ends}, 2, size(hits)), (hit, e) -> named_struct("
             "'start_offset', e - char_length(hit), 'end_offset', e))")
    return _bind(hits, "hits", _bind(gaps, "gaps", spans))


def _rule_hits_sql(text: str, rule: R.Rule, context: int | None) -> str:
    """Matches of one rule with both its scores and the number of its word list."""
    pattern = unicode_pattern(letter_first(rule.pattern))
    raised = rule.score if context is None else raised_score(rule.score)
    hit = (f"named_struct('entity_type',"
           f" {string(R.NORMALISED_TYPES.get(rule.entity_type, rule.entity_type))},"
           f" 'subtype', {string(rule.subtype)}, 'start_offset', m.start_offset,"
           f" 'end_offset', m.end_offset, 'confidence', {number(rule.score)},"
           f" 'raised', {number(raised)}, 'context', {-1 if context is None else context},"
           f" 'rule', {string(rule.name)})")
    hits = f"transform({offsets_sql(text, pattern)}, m -> {hit})"
    return f"if({text} rlike {string(pattern)}, {hits}, {_NO_HITS})"


def _scored(text: str, word_lists, threshold: float) -> str:
    """The spans of the array ``hits`` that reach ``threshold``, scores raised by context."""
    score = "h.confidence"
    if word_lists:
        near = near_words_sql("chunks", "h.start_offset", "h.context", word_lists, tails="tails")
        score = f"if(h.raised > h.confidence and {near}, h.raised, h.confidence)"
    spans = (f"transform(hits, h -> named_struct('entity_type', h.entity_type,"
             f" 'subtype', h.subtype, 'start_offset', h.start_offset, 'end_offset', h.end_offset,"
             f" 'confidence', {score}, 'rule', h.rule))")
    kept = f"filter({spans}, s -> s.confidence >= {number(threshold)})"
    if word_lists:
        tails = tails_sql("chunks", longest=longest_word(word_lists))
        kept = _bind(chunks_sql(text), "chunks", _bind(tails, "tails", kept))
    return f"if(size(hits) > 0, {kept}, {_NO_SPANS})"


def _needs_sql(text: str, needs: str) -> str:
    literal = needs.isalnum() or needs == "@"
    return f"contains({text}, {string(needs)})" if literal else f"{text} rlike {string(needs)}"


def _compare(*keys: tuple[str, bool]) -> str:
    """Comparator body over ``(field, ascending)`` keys."""
    cases = []
    for field, ascending in keys:
        low, high = (-1, 1) if ascending else (1, -1)
        cases.append(f"when a.{field} < b.{field} then {low} when a.{field} > b.{field} then {high}")
    return f"case {' '.join(cases)} else 0 end"


def _ordered(spans: str) -> str:
    """Spans by start, longer first, then rule."""
    order = _compare(("start_offset", True), ("end_offset", False), ("rule", True))
    return f"array_sort({spans}, (a, b) -> {order})"


def _suppressed(spans: str) -> str:
    """Drop a span lying inside a same-type span of equal or higher score.

    Sorted by start, only spans still open at the current start can contain
    the next one; a rule's own matches never overlap, so that open list is at
    most as long as the rule table and the fold makes no pairs.
    """
    order = _compare(("entity_type", True), ("start_offset", True), ("end_offset", False),
                     ("confidence", False), ("rule", True))
    same_type = "o.entity_type = s.entity_type"
    covered = (f"exists(acc.open, o -> {same_type} and o.end_offset >= s.end_offset"
               " and o.confidence >= s.confidence)")
    still_open = f"filter(acc.open, o -> {same_type} and o.end_offset > s.start_offset)"
    within = (f"aggregate(block, named_struct('open', total.open, 'kept', {_NO_SPANS}),"
              f" (acc, s) -> if({covered}, acc, named_struct("
              f"'open', concat({still_open}, array(s)), 'kept', concat(acc.kept, array(s)))))")
    kept = (f"aggregate({_blocks(f'array_sort({spans}, (a, b) -> {order})')},"
            f" named_struct('open', {_NO_SPANS}, 'kept', {_NO_SPANS}),"
            f" (total, block) -> {_bind(within, 'part', _GROW)}, total -> total.kept)")
    alone = f"size(array_distinct(transform({spans}, s -> s.entity_type))) = size({spans})"
    return (f"case when size({spans}) <= 1 then {spans} when {alone} then {_ordered(spans)}"
            f" else {_ordered(kept)} end")


def _merged(spans: str) -> str:
    joined = ("named_struct('entity_type', acc.last.entity_type, 'subtype', acc.last.subtype,"
              " 'start_offset', acc.last.start_offset,"
              " 'end_offset', greatest(acc.last.end_offset, s.end_offset),"
              " 'confidence', greatest(acc.last.confidence, s.confidence),"
              " 'rule', acc.last.rule)")
    done = "if(acc.last is null, acc.kept, concat(acc.kept, array(acc.last)))"
    step = (f"if(coalesce(acc.last.end_offset > s.start_offset, false),"
            f" named_struct('last', {joined}, 'kept', acc.kept),"
            f" named_struct('last', s, 'kept', {done}))")
    within = (f"aggregate(block, named_struct('last', total.last, 'kept', {_NO_SPANS}),"
              f" (acc, s) -> {step})")
    grow = "named_struct('last', part.last, 'kept', concat(total.kept, part.kept))"
    fold = (f"aggregate({_blocks(_ordered(spans))},"
            f" named_struct('last', get({_NO_SPANS}, 0), 'kept', {_NO_SPANS}),"
            f" (total, block) -> {_bind(within, 'part', grow)},"
            f" acc -> {done})")
    return f"if(size({spans}) > 1, {fold}, {spans})"


def find_spans(text: str = "text", rules=R.DEFAULT_RULES,
               threshold: float = R.CONFIDENCE_THRESHOLD, entity_types=None,
               boost: bool = True, suppress: bool = True) -> Column:
    """All spans of all rules over the column named ``text``, in one expression.

    Rules sharing a ``needs`` condition sit behind one cheap test, so a text
    without digits or ``@`` costs two short scans however many rules there are.
    A null text has no spans.
    """
    column = name(text)
    chosen = R.select_rules(rules, entity_types, threshold)
    word_lists = list(dict.fromkeys(r.context for r in chosen if r.context)) if boost else []
    groups: dict[str | None, list[str]] = {}
    for rule in chosen:
        context = word_lists.index(rule.context) if boost and rule.context else None
        groups.setdefault(rule.needs, []).append(_rule_hits_sql(column, rule, context))
    parts = []
    for needs, expressions in groups.items():
        found = f"concat({', '.join(expressions)})"
        parts.append(found if needs is None
                     else f"if({_needs_sql(column, needs)}, {found}, {_NO_HITS})")
    if not parts:
        return F.expr(_NO_SPANS)
    scored = _bind(f"concat({', '.join(parts)})", "hits", _scored(column, word_lists, threshold))
    return F.expr(_bind(scored, "found", _suppressed("found") if suppress else _ordered("found")))


def suppress_contained(spans: str = "spans") -> Column:
    """The spans of a column without contained same-type spans of no higher score."""
    return F.expr(_suppressed(name(spans)))


def merge_overlaps(spans: str = "spans") -> Column:
    """Overlapping spans joined into one; the earliest, longest span names it."""
    return F.expr(_merged(name(spans)))


def splice_sql(edits: str, chunks: str, size: str) -> str:
    """A text of ``size`` characters after all ``edits``, last start first.

    Read from the left, an edit removes its own characters and whatever later
    edits put there: ``carry`` counts what an overlapping edit still has to
    remove beyond the next start.  So one walk writes the result, and only the
    pieces between edits are copied from the text.
    """
    order = "case when a.start_offset > b.start_offset then -1 " \
            "when a.start_offset < b.start_offset then 1 else 0 end"
    listed = f"reverse(array_sort({edits}, (a, b) -> {order}))"
    following = f"concat(slice(transform(todo, t -> t.start_offset), 2, size(todo)), array({size}))"
    steps = _bind(listed, "todo", f"zip_with(todo, {following}, (t, n) -> named_struct("
                  "'at', t.start_offset, 'take', t.end_offset - t.start_offset,"
                  " 'next', n, 'put', t.replacement))")
    taken = "(x.take + greatest(acc.carry - char_length(x.put), 0))"
    rest = cut_sql(chunks, f"x.at + {taken}", f"x.next - x.at - {taken}")
    piece = (f"concat(substring(x.put, acc.carry + 1, char_length(x.put)),"
             f" if({taken} < x.next - x.at, {rest}, ''))")
    none = "cast(array() as array<string>)"
    within = (f"aggregate(block, named_struct('carry', total.carry, 'out', {none}), (acc, x) ->"
              f" named_struct('carry', greatest({taken} - (x.next - x.at), 0),"
              f" 'out', concat(acc.out, array({piece}))))")
    grow = "named_struct('carry', part.carry, 'out', concat(total.out, part.out))"
    fold = (f"aggregate({_blocks(steps)}, named_struct('carry', 0, 'out', {none}),"
            f" (total, block) -> {_bind(within, 'part', grow)}, total -> array_join(total.out, ''))")
    head = cut_sql(chunks, "0", f"array_min(transform({edits}, t -> t.start_offset))")
    return f"concat({head}, {fold})"
