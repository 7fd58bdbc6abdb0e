"""Redaction of documents that carry a ``spans`` array; row-local throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piiloom.functions import masking as M
from piiloom.functions.chunks import CHUNK, cut_sql
from piiloom.functions.columns import utc_now, with_computed
from piiloom.functions.spans import merge_overlaps, splice_sql
from piiloom.functions.sqltext import name
from piiloom.operators.detect import with_chunks


def with_redactions(scanned: DataFrame, level: str, salt: str = M.DEFAULT_SALT,
                    overlap: str = "splice") -> DataFrame:
    """Add ``redactions``: each span with its value hash and replacement.

    ``overlap="merge"`` first joins overlapping spans; ``"splice"`` keeps them,
    so that edits of overlapping spans follow one another on the edited text.
    """
    if overlap not in ("splice", "merge"):
        raise ValueError(f"overlap must be 'splice' or 'merge', not {overlap!r}")
    if overlap == "merge":
        scanned = with_computed(scanned, spans=merge_overlaps("spans"))
    cut = with_computed(with_chunks(scanned), values=span_values())

    def edit(span, i):
        value = F.get("values", i)
        return F.struct(
            span["entity_type"].alias("entity_type"), span["start_offset"].alias("start_offset"),
            span["end_offset"].alias("end_offset"), span["confidence"].alias("confidence"),
            F.sha2(value, 256).alias("value_hash"),
            M.replacement(value, span["entity_type"], level, salt).alias("replacement"))

    return with_computed(cut, redactions=F.transform(F.col("spans"), edit)).drop("values")


def span_values(spans: str = "spans", chunks: str = "chunks") -> Column:
    """The text each span covers, in the order of the spans."""
    value = cut_sql(name(chunks), "s.start_offset", "s.end_offset - s.start_offset")
    return F.expr(f"transform({name(spans)}, s -> {value})")


def redact(scanned: DataFrame, level: str, salt: str = M.DEFAULT_SALT,
           overlap: str = "splice") -> DataFrame:
    """Add ``redactions``, ``redacted_text``, ``entities_redacted`` and ``redaction_level``.

    The result is that of making the edits one after the other from the last
    start to the first, at their original offsets.
    """
    edits = with_redactions(scanned, level, salt, overlap)
    spliced = splice_sql("redactions", "chunks", "char_length(text)")
    return with_computed(
        edits, redacted_text=F.expr(f"if(size(redactions) > 0, {spliced}, text)"),
        entities_redacted=F.size("redactions"), redaction_level=F.lit(level))


def span_hash_rows(redacted: DataFrame) -> DataFrame:
    """``"start:end"`` -> hash of the value, one row per distinct span."""
    edits = F.col("redactions")
    distinct = F.filter(edits, lambda r, i: (i == 0)
                        | (F.get(edits, i - 1)["start_offset"] != r["start_offset"])
                        | (F.get(edits, i - 1)["end_offset"] != r["end_offset"]))
    return redacted.select("doc_id", F.inline(F.transform(distinct, lambda r: F.struct(
        F.concat_ws(":", r["start_offset"], r["end_offset"]).alias("span"),
        r["value_hash"].alias("value_hash")))))


def _first_per_value(redacted: DataFrame) -> DataFrame:
    """Add ``first``: one entry per distinct value, that of its leftmost occurrence."""
    ranked = F.array_sort(F.transform(F.col("redactions"), lambda r: F.struct(
        r["value_hash"].alias("value_hash"), r["start_offset"], r["end_offset"],
        r["replacement"].alias("replacement"))))
    df = with_computed(redacted, ranked=ranked)
    first = F.filter(F.col("ranked"), lambda r, i: (i == 0)
                     | (F.get(F.col("ranked"), i - 1)["value_hash"] != r["value_hash"]))
    return with_computed(df, first=F.transform(first, lambda r: F.struct(
        r["value_hash"].alias("value_hash"), r["replacement"].alias("replacement")))).drop("ranked")


def audit_mapping(redacted: DataFrame) -> DataFrame:
    """Hash -> replacement, one row per document and distinct value.

    On repeats the leftmost occurrence wins.  A document's values are in its
    row, so this needs no shuffle.
    """
    return _first_per_value(redacted).select("doc_id", F.inline("first"))


def with_audit_map(redacted: DataFrame) -> DataFrame:
    """The same mapping as a map column, kept in the row."""
    df = _first_per_value(redacted)
    return df.withColumn("audit_mapping", F.map_from_entries("first")).drop("first")


def redaction_reports(redacted: DataFrame, timestamp=None) -> DataFrame:
    """One report per document, with its instances as an array.

    ``risk_score_after`` is the fixed 0.0 the report format records; see
    ``plans.pipeline.residual_risk`` for the score of the redacted text.
    """
    instances = F.transform(F.col("redactions"), lambda r: F.struct(
        r["entity_type"].alias("entity_type"), r["start_offset"].alias("start_offset"),
        r["end_offset"].alias("end_offset"), r["confidence"].alias("confidence"),
        r["replacement"].alias("redacted_value"), r["value_hash"].alias("value_hash")))
    distinct = F.size(F.array_distinct(F.transform(
        F.col("redactions"), lambda r: r["value_hash"])))
    stamp = utc_now() if timestamp is None else timestamp
    return redacted.select(
        "doc_id", "filename", "redaction_level",
        stamp.cast("timestamp_ntz").alias("timestamp"),
        instances.alias("pii_instances"),
        F.col("entities_redacted").alias("total_entities_redacted"),
        F.coalesce("risk_score", F.lit(0.0)).alias("risk_score_before"),
        F.lit(0.0).alias("risk_score_after"),
        distinct.alias("audit_mapping_count"))


_GRAM = 8


def _beginnings(length: int) -> Column:
    """The beginnings of that many characters: of shorter values the values themselves."""
    size = F.char_length
    chosen = F.filter("values", lambda v: F.least(size(v), F.lit(_GRAM)) == length)
    return F.array_distinct(F.transform(chosen, lambda v: F.substring(v, 1, length)))


def _grams_found(length: int) -> Column:
    """Which beginnings of ``length`` characters the pieces of the redacted text hold.

    Every window of a piece is taken in one pass by a look-ahead; only those that are beginnings stay.
    """
    windows = lambda p: F.regexp_extract_all(p, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1))
    begin = F.col("begins")[length - 1]
    return F.when(F.size(begin) == 0, begin).otherwise(F.aggregate(
        "pieces", F.expr("cast(array() as array<string>)"),
        lambda found, p: F.array_union(found, F.array_intersect(begin, windows(p)))))


def leak_check(redacted: DataFrame) -> DataFrame:
    """Per document, how many distinct original values still occur in the redacted text.

    The redacted text is cut into pieces that overlap by a window.  The windows of each piece meet the first
    ``_GRAM`` characters of the values through hash sets, so a text is walked once for each length of
    a beginning (eight at most), however many values there are.  Only values whose beginning
    occurs are looked for as a whole; of values of ``_GRAM`` characters or less that is the answer.
    """
    df = with_computed(redacted, values=F.array_distinct(span_values()))
    pieces = F.expr(f"if(size(values) = 0, cast(array() as array<string>), regexp_extract_all("
                    f"redacted_text, r'(?s)(?=(.{{1,{CHUNK + _GRAM - 1}}})).{{1,{CHUNK}}}', 1))")
    df = with_computed(df, pieces=pieces,
                       begins=F.array(*[_beginnings(n) for n in range(1, _GRAM + 1)]))
    df = with_computed(df, found=F.array_distinct(F.flatten(F.array(
        *[_grams_found(n) for n in range(1, _GRAM + 1)]))))
    begun = F.filter("values", lambda v: F.array_contains("found", F.substring(v, 1, _GRAM)))
    leaks = F.filter(begun, lambda v: (F.char_length(v) <= _GRAM) | F.col("redacted_text").contains(v))
    return df.select("doc_id", "entities_redacted", F.size(leaks).alias("leaked"))
