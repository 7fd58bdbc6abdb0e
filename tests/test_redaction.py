import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from piiloom import rules as R
from piiloom.functions import masking as M
from piiloom.operators import redact
from piiloom.plans import pipeline


def texts_of(df):
    return [r.redacted_text for r in df.orderBy(F.col("doc_id").cast("int")).collect()]


def test_light_cases(spanned):
    docs = spanned(("ID: ABCDE1234F end", [("PAN", 4, 14)]), ("val: 1234 end", [("X", 5, 9)]),
                   ("val: 12345 end", [("X", 5, 10)]), ("plain", []))
    assert texts_of(redact.redact(docs, "LIGHT")) == [
        "ID: AB******4F end", "val: [REDACTED] end", "val: 12*45 end", "plain"]


def test_full_and_overlap(spanned):
    docs = spanned(
        ("Aadhaar: 234567890123 PAN: ABCDE1234F", [("AADHAAR", 9, 21), ("PAN", 27, 37)]),
        ("1234567890", [("A", 0, 8), ("B", 4, 10)]),
        ("no entities", []))
    out = redact.redact(docs, "FULL")
    assert texts_of(out) == ["Aadhaar: [REDACTED] PAN: [REDACTED]", "[REDACTED]ACTED]",
                             "no entities"]
    assert [r.entities_redacted for r in out.orderBy("doc_id").collect()] == [2, 2, 0]
    merged = redact.redact(docs, "FULL", overlap="merge")
    assert texts_of(merged) == ["Aadhaar: [REDACTED] PAN: [REDACTED]", "[REDACTED]", "no entities"]


def test_splice_equals_sequential_editing(spanned):
    import random
    rng = random.Random(3)
    docs = []
    for _ in range(40):
        text = "".join(rng.choice("abcdé😀 ") for _ in range(30))
        spans = []
        for _ in range(rng.randrange(5)):
            s = rng.randrange(0, 28)
            spans.append(("T", s, min(30, s + rng.randrange(1, 8))))
        docs.append((text, spans))
    got = texts_of(redact.redact(spanned(*docs), "LIGHT"))
    for (text, spans), result in zip(docs, got):
        edited = text
        for _, s, e in sorted(spans, key=lambda x: x[1], reverse=True):
            v = text[s:e]
            r = "[REDACTED]" if len(v) < 5 else v[:2] + "*" * (len(v) - 4) + v[-2:]
            edited = edited[:s] + r + edited[e:]
        assert result == edited


def test_unknown_level_and_overlap_raise(spanned):
    docs = spanned(("a", []))
    with pytest.raises(ValueError):
        redact.redact(docs, "NONE")
    with pytest.raises(ValueError):
        redact.redact(docs, "FULL", overlap="drop")


def test_synthetic_shapes_and_determinism(spark):
    rows = [("AADHAAR", f"2345 6789 {i:04d}") for i in range(100)]
    rows += [("AADHAAR", f"2345-6789-{i:04d}") for i in range(100)]
    rows += [("AADHAAR", f"23456789{i:04d}") for i in range(100)]
    rows += [("PAN", f"ABCDE{i:04d}F") for i in range(100)]
    rows += [("DRIVING_LICENSE", f"MH02 2019 {i:07d}") for i in range(200)]
    rows += [(t, f"v{i}@x.org") for t in ("EMAIL", "EMAIL_ADDRESS") for i in range(50)]
    rows += [("PHONE", f"98765{i:05d}") for i in range(50)]
    rows += [("PERSON", "Some Name"), ("OTHER", "UNKNOWN_VALUE")]
    df = spark.createDataFrame(rows, "t string, v string").select(
        "t", "v", M.synthetic(F.col("v"), F.col("t")).alias("r"),
        M.synthetic(F.col("v"), F.col("t"), "salt2").alias("other"))
    shapes = {
        "PAN": r"[A-Z]{5}[0-9]{4}[A-Z]", "PERSON": r"[A-Z][a-z]+ [A-Z][a-z]+",
        "EMAIL": r"[a-z]+\.[a-z]+[0-9]{4}@example\.com", "PHONE": r"\+91 [6-9][0-9]{4} [0-9]{5}",
        "OTHER": r"\[REDACTED\]",
        "DRIVING_LICENSE": r"(%s)(0[1-9]|[1-9][0-9])( ?)(20[0-1][0-9]|202[0-6])\3[0-9]{7}"
                           % "|".join(R.STATE_CODES)}
    changed = 0
    for r in df.collect():
        shape = shapes.get(r.t.replace("_ADDRESS", ""))
        if r.t == "AADHAAR":
            sep = "-" if "-" in r.v else " " if " " in r.v else ""
            shape = rf"[2-9][0-9]{{3}}{sep}[0-9]{{4}}{sep}[0-9]{{4}}"
        assert re.fullmatch(shape, r.r), r
        changed += r.r != r.other
    assert changed > 500
    spaced = df.filter("t = 'DRIVING_LICENSE'").select(F.col("r").contains(" ").alias("s"))
    assert {r.s for r in spaced.distinct().collect()} == {True, False}


def test_audit_mapping_and_hashes(spanned):
    text = "a ABCDE1234F b ABCDE1234F c 99999"
    docs = spanned((text, [("PAN", 2, 12), ("PAN", 15, 25), ("X", 28, 33)]))
    out = redact.redact(docs, "LIGHT")
    digest = hashlib.sha256(b"ABCDE1234F").hexdigest()
    rows = {r.value_hash: r.replacement for r in redact.audit_mapping(out).collect()}
    assert len(rows) == 2 and rows[digest] == "AB******4F"
    assert redact.with_audit_map(out).collect()[0].audit_mapping == rows
    spans = {(r.span, r.value_hash) for r in redact.span_hash_rows(out).collect()}
    assert ("2:12", digest) in spans and ("15:25", digest) in spans and len(spans) == 3


def test_leftmost_replacement_wins(spanned):
    # The same characters under two types get different stand-ins.
    docs = spanned(("234567890123 234567890123", [("AADHAAR", 0, 12), ("PHONE", 13, 25)]))
    out = redact.redact(docs, "SYNTHETIC")
    first = out.collect()[0].redactions[0].replacement
    assert [r.replacement for r in redact.audit_mapping(out).collect()] == [first]
    assert list(redact.with_audit_map(out).collect()[0].audit_mapping.values()) == [first]


def test_report(spanned):
    docs = spanned(("ABCDE1234F ABCDE1234F", [("PAN", 0, 10), ("PAN", 11, 21)]))
    scored = docs.withColumn("risk_score", F.lit(40.0))
    row = redact.redaction_reports(redact.redact(scored, "FULL"), F.lit("2024-01-01")).collect()[0]
    assert (row.total_entities_redacted, row.audit_mapping_count) == (2, 1)
    assert (row.risk_score_before, row.risk_score_after) == (40.0, 0.0)
    assert row.pii_instances[1].redacted_value == "[REDACTED]"
    assert "ABCDE1234F" not in str(row)


_DIGITS = st.text("0123456789", min_size=4, max_size=4)
_IDS = st.one_of(
    st.builds(lambda h, a, b, c, s: ("AADHAAR", f"{h}{a[1:]}{s}{b}{s}{c}"), st.sampled_from("23456789"),
              _DIGITS, _DIGITS, _DIGITS, st.sampled_from([" ", "-"])),
    st.builds(lambda a, d, z: ("PAN", f"{a}{d}{z}"), st.text("ABCDEFGHIJKLMNOPQRSTUVWXYZ", min_size=5,
              max_size=5), _DIGITS, st.sampled_from("ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    st.builds(lambda y, d, e: ("DRIVING_LICENSE", f"MH12 {2000 + y} {d}{e[1:]}"),
              st.integers(0, 26), _DIGITS, _DIGITS))
_PLAIN = st.text("abcdefgh é.,\n", min_size=10, max_size=60)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(_PLAIN, _IDS, _PLAIN), min_size=40, max_size=80))
def test_properties_of_redaction(texts, cases):
    docs = texts(*[f"{a} Aadhaar PAN DL {v} {b}" for a, (_, v), b in cases])
    docs = docs.withColumn("filename", F.lit("f"))
    fulls = pipeline.redact_corpus(docs, "FULL").collect()
    lights = {r.doc_id: r for r in pipeline.redact_corpus(docs, "LIGHT").collect()}
    for row in fulls:
        a, (kind, value), b = cases[int(row.doc_id)]
        assert any(s.entity_type == kind and row.text[s.start_offset:s.end_offset] == value
                   for s in row.spans)
        assert value not in row.redacted_text
        lit = lights[row.doc_id]
        assert len(lit.redacted_text) == len(row.text)
        for r in lit.redactions:
            old = row.text[r.start_offset:r.end_offset]
            assert r.replacement[:2] == old[:2] and r.replacement[-2:] == old[-2:]
            assert set(r.replacement[2:-2]) == {"*"}
    leaks = redact.leak_check(pipeline.redact_corpus(docs, "FULL"))
    assert leaks.filter("leaked > 0").count() == 0


def test_leaks_of_all_lengths_are_found_across_pieces(spark, spanned):
    from pyspark.sql import functions as F

    from piiloom.functions.chunks import CHUNK

    values = ["a", "bc", "defg", "hijklmn", "opqrstuv", "wxyzwxyzw", "long value with spaces \n and é👍 more"]
    text = "#".join(values)
    starts = [text.index(v) for v in values]
    scanned = spanned((text, [("PAN", s, s + len(v)) for s, v in zip(starts, values)]), ("", []), ("x1", []))
    redacted = redact.redact(scanned, "FULL")
    clean = {r["doc_id"]: r["leaked"] for r in redact.leak_check(redacted).collect()}
    assert clean == {"0": 0, "1": 0, "2": 0}
    planted = {f"{n}-{at}": "." * at + v + "." * 700 for n, v in enumerate(values)
               for at in (0, CHUNK - len(v) // 2 - 1, CHUNK - 1, CHUNK, 2 * CHUNK - 3)}
    planted["near"] = "WXYZwxyzwxyz-0 long v"
    texts = F.explode(F.array(*[F.struct(F.lit(k).alias("id"), F.lit(t).alias("t")) for k, t in planted.items()]))
    tried = (redacted.where("doc_id = '0'").withColumn("x", texts)
             .withColumn("redacted_text", F.col("x.t")).withColumn("doc_id", F.col("x.id")))
    got = {r["doc_id"]: r["leaked"] for r in redact.leak_check(tried).collect()}
    assert got == {k: sum(v in t for v in values) for k, t in planted.items()} and got["near"] == 0
