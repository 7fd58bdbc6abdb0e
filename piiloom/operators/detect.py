"""Detection over tables of documents (``doc_id, text, ...``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piiloom import rules as R
from piiloom.functions.chunks import chunks_where, cut_sql
from piiloom.functions.columns import with_computed
from piiloom.functions.spans import find_spans, offsets_sql, suppress_contained
from piiloom.functions.sqltext import name, string
from piiloom.operators.names import TOKEN as _TOKEN
from piiloom.operators.names import DictionaryTooLarge, folded, name_rules, tidy_names
from piiloom.session import broadcast_if_small


#: Names of a dictionary that is matched in the row.
PATTERN_NAMES = 256


def with_spans(docs: DataFrame, rules=R.DEFAULT_RULES,
               threshold: float = R.CONFIDENCE_THRESHOLD, entity_types=None,
               boost: bool = True, suppress: bool = True) -> DataFrame:
    """``docs`` with the array column ``spans``: one narrow pass, no shuffle."""
    return with_computed(docs, spans=find_spans(
        "text", rules, threshold, entity_types, boost, suppress))


def with_chunks(scanned: DataFrame) -> DataFrame:
    """Add ``chunks``, the text cut for cheap access, on rows that have spans."""
    return with_computed(scanned, chunks=chunks_where("size(spans) > 0"))


def hashed_spans(spans: str = "spans", chunks: str = "chunks") -> Column:
    """The spans with the SHA-256 of each value added; reads :func:`with_chunks`."""
    value = cut_sql(name(chunks), "s.start_offset", "s.end_offset - s.start_offset")
    return F.expr(
        f"transform({name(spans)}, s -> named_struct('entity_type', s.entity_type,"
        " 'subtype', s.subtype, 'start_offset', s.start_offset, 'end_offset', s.end_offset,"
        f" 'confidence', s.confidence, 'rule', s.rule, 'value_hash', sha2({value}, 256)))")


def entity_rows(scanned: DataFrame) -> DataFrame:
    """One row per span of :func:`with_spans` output, with the value's hash only.

    Hashes are taken inside the array, so the text is not copied per span.
    """
    return with_chunks(scanned).select("doc_id", F.inline(hashed_spans()))


def detect_all(docs: DataFrame, rules=R.DEFAULT_RULES,
               threshold: float = R.CONFIDENCE_THRESHOLD, entity_types=None,
               boost: bool = True, suppress: bool = True) -> DataFrame:
    """All entities of all documents, one row each."""
    return entity_rows(with_spans(docs, rules, threshold, entity_types, boost, suppress))


def rule_matches(docs: DataFrame, rule_name: str, rules=R.DEFAULT_RULES) -> DataFrame:
    """Raw matches of one rule: no context, threshold or suppression."""
    chosen = tuple(rule for rule in rules if rule.name == rule_name)
    if not chosen:
        raise ValueError(f"no rule named {rule_name!r}")
    return detect_all(docs, chosen, threshold=0.0, boost=False, suppress=False)


def threshold_filter(entities: DataFrame,
                     threshold: float = R.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Entities with ``confidence >= threshold``."""
    return entities.filter(F.col("confidence") >= F.lit(float(threshold)))


def normalise_types(entities: DataFrame, names: dict | None = None) -> DataFrame:
    """Replace library spellings of entity types; others stay."""
    table = R.NORMALISED_TYPES if names is None else names
    return entities.replace(table, subset=["entity_type"]) if table else entities


def subtype_tag(entities: DataFrame, rules=R.DEFAULT_RULES) -> DataFrame:
    """Set ``subtype`` from the rule table by entity type."""
    types = sorted({R.NORMALISED_TYPES.get(r.entity_type, r.entity_type)
                    for r in rules if r.subtype == R.GOVT_ID})
    return entities.withColumn(
        "subtype", F.when(F.col("entity_type").isin(types), F.lit(R.GOVT_ID)))


def suppress_contained_spans(scanned: DataFrame) -> DataFrame:
    """Apply containment suppression to an unsuppressed ``spans`` column."""
    return with_computed(scanned, spans=suppress_contained("spans"))


def entity_counts(entities: DataFrame) -> DataFrame:
    """Entities per document and type."""
    return entities.groupBy("doc_id", "entity_type").agg(F.count("*").alias("n"))


def counts_in_row(scored: DataFrame) -> DataFrame:
    """The same rows from the ``type_totals`` of scored documents, without a shuffle."""
    return scored.select("doc_id", F.inline("type_totals")).select("doc_id", "entity_type", "n")


def detect_person(docs: DataFrame, names: DataFrame, threshold: float = R.CONFIDENCE_THRESHOLD,
                  ignore_case: bool = True) -> DataFrame:
    """Person names of a caller's dictionary ``names(name, score)``, as rows of :func:`detect_all`.

    Names that occur are matched in the row, as rules.  A pattern tries its names one after the other, so of
    more than ``PATTERN_NAMES``, or beyond the size that a pattern may have, tokens meet the dictionary in a
    join (:func:`join_names`).
    """
    if names.limit(PATTERN_NAMES + 1).count() > PATTERN_NAMES:
        return join_names(docs, names, threshold, ignore_case)
    try:
        return detect_all(docs, name_rules(names, docs, ignore_case=ignore_case), threshold)
    except DictionaryTooLarge:
        return join_names(docs, names, threshold, ignore_case)


def join_names(docs: DataFrame, names: DataFrame, threshold: float = R.CONFIDENCE_THRESHOLD,
               ignore_case: bool = True) -> DataFrame:
    """The same for a dictionary of any size, by a join on the first token of a name.

    Only tokens that begin some name leave the join; then the tokens behind it, carried along up to the
    longest name, are compared with the names that begin so.
    """
    tokens_of = lambda c: F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0))
    inner = F.expr(f"slice(split(name, {string(_TOKEN)}, -1), 2, size(parts) - 1)")
    listed = (tidy_names(names.where(F.col("score") >= threshold), ignore_case)
              .withColumn("parts", tokens_of("name"))
              .select("parts", inner.alias("inner"), F.col("score").alias("confidence")))
    longest = listed.agg(F.max(F.size("parts"))).first()[0] or 1
    listed = listed.select("parts", "inner", "confidence", F.get("parts", F.lit(0)).alias("token"))
    # ``row`` tells rows of one id apart, so that the names of one do not stand between those of the other
    tokens = with_computed(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"), word=tokens_of("text"),
                           at=F.expr(offsets_sql(name("text"), _TOKEN)))
    gaps = F.expr(f"slice(split(text, {string(_TOKEN)}, -1), 2, size(word))")
    # Each token with those behind it: the arrays beside themselves, shifted by one to ``longest`` places, so that
    # no token carries or walks all tokens of its text.
    shifted = [F.slice(c, F.lit(k + 1), F.greatest(F.size("word") - k, F.lit(0))).alias(f"{c}{k}")
               for k in range(longest) for c in ("word", "at", "gaps")]
    beside = lambda c, n: F.array(*[F.col(f"{c}{k}") for k in range(n)])
    rows = with_computed(tokens, gaps=gaps).select("doc_id", "row", F.inline(F.arrays_zip(*shifted))).select(
        "doc_id", "row", folded(F.col("word0"), ignore_case).alias("token"),
        F.array_compact(beside("word", longest)).alias("words"),
        beside("at", longest).alias("places"), beside("gaps", longest).alias("between"))
    size = F.size("parts")
    # what stands between two tokens of a name stands there in the text, runs of blanks as one
    between = F.transform(F.slice("between", F.lit(1), size - 1), lambda g: F.regexp_replace(g, r"[ \t]+", " "))
    same = F.transform(F.slice("words", F.lit(1), size), lambda w: folded(w, ignore_case)) == F.col("parts")
    found = rows.join(broadcast_if_small(listed), "token").where((size == 1) | (same & (between == F.col("inner"))))
    # of a name of one token, all is known from the join
    value = F.when(size == 1, F.get("words", F.lit(0))).otherwise(F.array_join(F.transform(F.slice("words", F.lit(1), size), lambda w, i: F.concat(
        w, F.when(i < size - 1, F.get("between", i)).otherwise(""))), ""))
    spans = found.select(
        "doc_id", "row", F.struct(
            F.lit("PERSON").alias("entity_type"), F.lit(None).cast("string").alias("subtype"),
            F.get("places", F.lit(0))["start_offset"].alias("start_offset"),
            F.get("places", size - 1)["end_offset"].alias("end_offset"), "confidence",
            F.concat(F.lit("person_"), F.lpad(F.round(F.col("confidence") * 100).cast("int").cast("string"), 2, "0"))
            .alias("rule"), F.sha2(value, 256).alias("value_hash")).alias("s"))
    # a name inside a longer one goes, as in the row
    near = Window.partitionBy("doc_id", "row").orderBy("s.start_offset", F.desc("s.end_offset")).rowsBetween(-longest, longest)
    inside = F.exists(F.collect_list("s").over(near), lambda o: (
        (o["start_offset"] <= F.col("s.start_offset")) & (o["end_offset"] >= F.col("s.end_offset"))
        & (o["confidence"] >= F.col("s.confidence"))
        & (o["end_offset"] - o["start_offset"] > F.col("s.end_offset") - F.col("s.start_offset"))))
    return spans.withColumn("inside", inside).where(~F.col("inside")).select("doc_id", "s.*")
