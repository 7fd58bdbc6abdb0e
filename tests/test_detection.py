import re

import pytest
from pyspark.sql import functions as F

from piiloom import rules as R
from piiloom.functions.chunks import chunks_sql, cut_sql
from piiloom.functions.context import preceding_words_sql, tails_sql
from piiloom.functions.spans import offsets_sql
from piiloom.operators import detect


def found(df):
    rows = df.collect()
    return sorted((r.doc_id, r.entity_type, r.start_offset, r.end_offset, round(r.confidence, 6))
                  for r in rows)


def test_sentences_of_each_kind(texts):
    docs = texts(
        "My Aadhaar number is 234567890123 for verification.",
        "My Aadhaar is 2345 6789 0123 please verify.",
        "My PAN card number is ABCDE1234F for tax purposes.",
        "My DL number is MH01 2023 1234567 for identification.",
        "", None, "Nothing to see in this sentence.")
    rows = detect.detect_all(docs).collect()
    assert {(r.doc_id, r.entity_type, r.subtype) for r in rows} == {
        ("0", "AADHAAR", R.GOVT_ID), ("1", "AADHAAR", R.GOVT_ID),
        ("2", "PAN", R.GOVT_ID), ("3", "DRIVING_LICENSE", R.GOVT_ID)}


def test_every_rule_matches_its_own_form(texts):
    samples = {
        "aadhaar_spaced": "2345 6789 0123", "aadhaar_hyphen": "2345-6789-0123",
        "aadhaar_plain": "234567890123", "pan_holder_letter": "ABCPE1234F",
        "pan_shape": "ABCDE1234F", "dl_spaced_initials": "MH02 AB 2019 1234567",
        "dl_spaced": "MH02 2019 1234567", "dl_hyphen4_initials": "MH-02-AB-2019-1234567",
        "dl_hyphen4": "MH-02-2019-1234567", "dl_hyphen3": "MH-02-20191234567",
        "dl_plain": "MH02AB20191234567", "email": "first.last+tag@mail.example.co.in",
        "phone_in": "+91 98765 43210", "phone_us": "+1 (743) 555-3824"}
    assert set(samples) == {r.name for r in R.DEFAULT_RULES}
    docs = texts(*[f"before {v} after" for v in samples.values()])
    for i, (rule, value) in enumerate(samples.items()):
        rows = detect.rule_matches(docs.filter(F.col("doc_id") == str(i)), rule).collect()
        assert [(r.start_offset, r.end_offset) for r in rows] == [(7, 7 + len(value))], rule


def test_offsets_agree_with_python_on_awkward_texts(spark, texts):
    values = ["", "x", "12ab34", "ab12", "12", "a😀12é34\n56", "１２ 34", " 7 ", "1" * 5 + "a1" * 700]
    docs = texts(*values)
    got = docs.select("doc_id", F.expr(offsets_sql("text", "[0-9]+")).alias("o")).collect()
    for row in got:
        text = values[int(row.doc_id)]
        assert [(o.start_offset, o.end_offset) for o in row.o] == [
            m.span() for m in re.finditer("[0-9]+", text)]


def test_cutting_chunks_equals_slicing(spark):
    text = "".join(chr(97 + i % 26) if i % 7 else "😀é"[i % 2] for i in range(3500))
    points = [0, 1, 1023, 1024, 1025, 2047, 2048, 3000, 3071, 3072, 3499, 3500]
    rows = [(text, a, b - a) for a in points for b in points if a <= b] + [("", 0, 0)]
    df = spark.createDataFrame(rows, "text string, a int, n int")
    for r in df.select("*", F.expr(cut_sql(chunks_sql("text"), "a", "n")).alias("c")).collect():
        assert r.c == r.text[r.a:r.a + r.n]


def test_unicode_spaces_and_letters_count_as_in_python(texts):
    docs = texts("Aadhaar 2345 6789 0123.", "é2345 6789 0123", "Aadhaar: réen.19@mail.fr")
    rows = {(r.doc_id, r.rule, r.start_offset) for r in detect.detect_all(docs).collect()}
    assert rows == {("0", "aadhaar_spaced", 8), ("2", "email", 9)}


def test_email_rule_is_quick_on_long_runs(texts):
    docs = texts("@" + "a-" * 50000, "a." * 50000 + "@", "x@" + "b." * 20000 + "com")
    rows = detect.rule_matches(docs, "email").collect()
    assert [(r.doc_id, r.end_offset) for r in rows] == [("2", 2 + 40000 + 3)]


def test_context_raises_and_threshold_is_inclusive(texts):
    docs = texts("Aadhaar 234567890123", "number 234567890123", "MH-02-20191234567",
                 "one two three four five Aadhaar a b c d 234567890123",
                 "Aadhaar a b c d e 234567890123", "Government of India 234567890123",
                 "भारत सरकार 234567890123")
    assert found(detect.detect_all(docs)) == [
        ("0", "AADHAAR", 8, 20, 0.95), ("2", "DRIVING_LICENSE", 0, 17, 0.7),
        ("3", "AADHAAR", 40, 52, 0.95), ("5", "AADHAAR", 20, 32, 0.95),
        ("6", "AADHAAR", 11, 23, 0.95)]


def test_context_shortcut_equals_the_whole_prefix(spark):
    words = ["w" * n for n in (1, 3, 60, 90, 150, 220)]
    rows = []
    for a in words:
        for b in words:
            text = f"start Aadhaar {a} -- {b}   {a} X"
            rows.append((text, len(text) - 1))
    df = spark.createDataFrame(rows, "text string, at int")
    got = df.select("text", "at", F.expr(preceding_words_sql(chunks_sql("text"), "at")).alias("w")).collect()
    for r in got:
        tokens = re.findall(r"[^\W_]+", r.text[:r.at].lower())[-5:]
        assert r.w == " " + " ".join(tokens) + " "


def test_context_in_texts_poor_in_tokens_equals_the_whole_prefix(spark):
    import random

    rng = random.Random(5)
    rows = []
    for n in range(30):
        parts = []
        while sum(map(len, parts)) < 9000:
            parts.append(rng.choice(["Aadhaar", "É1", "Σς", "b", "y" * 300, "z" * 2500, "👍", "े"]))
            parts.append(rng.choice([" ", "-", "\n"]) * rng.choice([1, 1, 400, 1023, 3000]))
        text = "".join(parts)
        rows += [(text, at) for at in (0, 1024, 4096, 8192, len(text) // 2, len(text) - 1, len(text))]
    rows += [("x " * 2048, 4096), ("-" * 5120, 5120), ("-" * 5120, 5119), ("y" * 5120, 5120)]
    df = spark.createDataFrame(rows, "text string, at int")
    plain = F.expr(preceding_words_sql("chunks", "at")).alias("plain")
    by_tails = F.expr(preceding_words_sql("chunks", "at", tails="tails")).alias("by_tails")
    cut = df.select("at", F.expr(chunks_sql("text")).alias("chunks"))
    got = cut.withColumn("tails", F.expr(tails_sql("chunks"))).select("at", F.size("tails").alias("n"), plain, by_tails).collect()
    short = lambda words: [w[-256:] for w in words.split(" ")]
    assert sum(r["n"] > 0 for r in got) > 150
    assert [short(r["by_tails"]) for r in got] == [short(r["plain"]) for r in got]


def test_far_context_in_long_texts_poor_in_tokens(spark):
    """3 MB with a match every 5,000 characters: the prefix of each would be 1,000 times as much."""
    text = "Aadhaar a b c" + ("-" * 5000 + "234567890123") * 600
    docs = spark.createDataFrame([("1", text)], "doc_id string, text string")
    got = detect.detect_all(docs).where("entity_type = 'AADHAAR'").collect()
    assert [(r["start_offset"], r["confidence"]) for r in got] == [(5013, 0.95), (10025, 0.95)]


def test_higher_threshold_never_finds_more(texts):
    docs = texts("Aadhaar 234567890123 PAN ABCDE1234F mail a@b.co phone 9876543210 MH0220191234567")
    counts = [detect.detect_all(docs, threshold=t).count() for t in (0.0, 0.5, 0.7, 0.9, 1.0)]
    assert counts == sorted(counts, reverse=True)
    same = detect.threshold_filter(detect.detect_all(docs, threshold=0.0), 0.9)
    assert found(same) == found(detect.detect_all(docs, threshold=0.9))


def test_allow_list_takes_both_spellings(texts):
    docs = texts("a@b.co and ABCPE1234F")
    for name in ("EMAIL", "EMAIL_ADDRESS"):
        assert [r[1] for r in found(detect.detect_all(docs, entity_types=[name]))] == ["EMAIL"]
    assert detect.detect_all(docs, entity_types=[]).count() == 0


def test_contained_same_type_spans_go_and_other_types_stay(spanned):
    df = spanned(("x" * 60, [
        ("A", 0, 10, 0.9), ("A", 2, 5, 0.8), ("B", 2, 5, 0.5),          # lower, contained: out
        ("A", 20, 30, 0.7), ("A", 22, 25, 0.9),                          # higher, contained: stays
        ("A", 40, 50, 0.8), ("A", 40, 50, 0.8), ("A", 45, 55, 0.1)]))    # twin out, overlap stays
    out = detect.suppress_contained_spans(df).collect()[0].spans
    assert [(s.entity_type, s.start_offset, s.end_offset, s.rule) for s in out] == [
        ("A", 0, 10, "r0"), ("B", 2, 5, "r2"), ("A", 20, 30, "r3"), ("A", 22, 25, "r4"),
        ("A", 40, 50, "r5"), ("A", 45, 55, "r7")]


def test_suppression_equals_pairwise_definition(spanned):
    import random
    rng = random.Random(7)
    docs = []
    for _ in range(60):
        spans = []
        for _ in range(rng.randrange(0, 14)):
            start = rng.randrange(0, 20)
            spans.append((rng.choice("AB"), start, start + rng.randrange(1, 9),
                          rng.choice((0.5, 0.7, 0.9))))
        docs.append(("y" * 40, spans))
    rows = detect.suppress_contained_spans(spanned(*docs)).collect()
    for row in rows:
        spans = [(s[0], s[1], s[2], s[3], f"r{j}") for j, s in enumerate(docs[int(row.doc_id)][1])]

        def beats(o, s):
            inside = o[0] == s[0] and o[1] <= s[1] and o[2] >= s[2] and o[3] >= s[3]
            return inside and (o[1] < s[1] or o[2] > s[2] or o[3] > s[3] or o[4] < s[4])

        want = {s for s in spans if not any(beats(o, s) for o in spans)}
        assert {(s.entity_type, s.start_offset, s.end_offset, s.confidence, s.rule)
                for s in row.spans} == want


def test_a_callers_rule_table(texts):
    rules = (R.Rule("ticket", "TICKET", r"\bT'[0-9]{3}\b", 0.9),
             R.Rule("both", "TICKET", r"\b\"'[0-9]{3}\b", 0.9))
    assert found(detect.detect_all(texts("see T'123 and T'45"), rules)) == [
        ("0", "TICKET", 4, 9, 0.9)]
    with pytest.raises(ValueError):
        R.Rule("empty", "X", "a*", 0.5)
    with pytest.raises(ValueError):
        R.Rule("score", "X", "a", 1.5)


def test_values_are_kept_as_hashes_only(texts):
    import hashlib
    row = detect.detect_all(texts("mail a.b@c.org now")).collect()[0]
    assert row.value_hash == hashlib.sha256(b"a.b@c.org").hexdigest()
    assert "a.b@c.org" not in str(row)


def test_person_dictionary(spark, texts):
    names = spark.createDataFrame([("Asha Rao", 0.9), ("ravi", 0.8), ("Ravi", 0.6)],
                                  "name string, score double")
    docs = texts("Dear ASHA  Rao, ask Ravi. Asha", "ravine", "")
    assert found(detect.detect_person(docs, names)) == [
        ("0", "PERSON", 5, 14, 0.9), ("0", "PERSON", 20, 24, 0.8)]


def test_type_spelling_subtype_and_counts(spark):
    df = spark.createDataFrame([("1", "EMAIL_ADDRESS"), ("1", "PAN"), ("1", "PAN"), ("2", "FOO")],
                               "doc_id string, entity_type string")
    rows = detect.subtype_tag(detect.normalise_types(df)).collect()
    assert [(r.entity_type, r.subtype) for r in rows] == [
        ("EMAIL", None), ("PAN", R.GOVT_ID), ("PAN", R.GOVT_ID), ("FOO", None)]
    assert {(r.doc_id, r.entity_type, r.n) for r in detect.entity_counts(df).collect()} == {
        ("1", "EMAIL_ADDRESS", 1), ("1", "PAN", 2), ("2", "FOO", 1)}
