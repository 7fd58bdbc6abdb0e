import re

import pytest

from piiloom import rules as R
from piiloom.operators import detect
from piiloom.operators.names import DictionaryTooLarge, name_rules, occurring_names, trie_pattern
from piiloom.operators.redact import redact
from piiloom.plans import pipeline

NAMES = [("Asha Rao", 0.85), ("Asha", 0.75), ("Asha Rao Sen", 0.85), ("Ravi", 0.75), ("O'Neil", 0.85),
         ("Zoë Ng", 0.85), ("", 0.9), ("  ", 0.9), (None, 0.9), ("Low", 0.3)]
TEXTS = ["Asha Rao Sen met Asha, Asha  Rao and Ashab.", "ravi Ravi xRavi Raví", "call O'Neil or Zoë\tNg; Zoë\nNg",
         "", None, "Asha Rao Senior", "Low Ravi,Asha"]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(NAMES, "name string, score double")


def plain(text, ignore_case=False):
    """Longest name at each place, left to right for each score; then without names inside others."""
    found = []
    for score in (0.85, 0.75):
        listed = sorted((n for n, s in NAMES if s == score and n and n.strip()), key=len, reverse=True)
        ways = "|".join(re.escape(n).replace(r"\ ", r"[ \t]+") for n in listed)
        for m in re.finditer(rf"(?<!\w)(?:{ways})(?!\w)", text or "", re.I if ignore_case else 0):
            found.append((m.start(), m.end(), score))
    return sorted(f for f in found if not any(
        o != f and o[0] <= f[0] and o[1] >= f[1] and o[2] >= f[2] for o in found))


def spans_of(df):
    rows = {}
    for r in df.collect():
        assert r.entity_type == "PERSON" and r.subtype is None and len(r.value_hash) == 64
        rows.setdefault(int(r.doc_id), []).append((r.start_offset, r.end_offset, r.confidence))
    return {k: sorted(v) for k, v in rows.items()}


@pytest.mark.parametrize("ignore_case", [False, True])
def test_pattern_and_join_equal_a_plain_search(spark, texts, names, ignore_case):
    docs = texts(*TEXTS)
    want = {i: f for i, t in enumerate(TEXTS) if (f := plain(t, ignore_case))}
    assert spans_of(detect.detect_person(docs, names, ignore_case=ignore_case)) == want
    assert spans_of(detect.join_names(docs, names, ignore_case=ignore_case)) == want


def test_a_dictionary_over_the_limit_is_joined(spark, texts, names, monkeypatch):
    with pytest.raises(DictionaryTooLarge):
        name_rules(names, limit=10)
    monkeypatch.setattr(detect, "name_rules", lambda *a, **b: name_rules(*a, **b, limit=3))
    docs = texts(*TEXTS)
    assert spans_of(detect.detect_person(docs, names, ignore_case=False)) == {
        i: f for i, t in enumerate(TEXTS) if (f := plain(t))}


def test_only_names_that_occur_make_the_pattern(spark, texts, names):
    kept = occurring_names(names.where("name <> ''"), texts("Asha x", "Ravi", "Rao"))
    assert {r.name for r in kept.collect()} == {"Asha", "Asha Rao", "Ravi"}
    assert name_rules(names, texts("nobody")) == ()
    assert name_rules(names.limit(0)) == ()


def test_trie_shares_beginnings_and_escapes():
    assert trie_pattern(["ab", "abc d", "x.y"]).count("a") == 1
    with pytest.raises(ValueError):
        trie_pattern([" "])


def test_persons_are_scored_and_redacted_in_the_same_pass(spark, texts, names):
    rules = R.DEFAULT_RULES + name_rules(names)
    docs = texts("Aadhaar 2345 6789 0123 of Asha Rao", "Ravi wrote", "nothing")
    scanned = pipeline.scan(docs, rules=rules)
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    rows = {r.doc_id: r for r in redact(scanned, "FULL").collect()}
    assert rows["0"].redacted_text == "Aadhaar [REDACTED] of [REDACTED]"
    assert rows["1"].redacted_text == "[REDACTED] wrote" and rows["2"].redacted_text == "nothing"
    assert rows["1"].risk_score == pytest.approx(R.WEIGHTS["PERSON"] * 0.75)
    assert [t.entity_type for t in rows["0"].type_totals] == ["AADHAAR", "PERSON"]


@pytest.mark.parametrize("level", R.REDACTION_LEVELS)
def test_no_name_is_left_after_redaction(spark, texts, names, level):
    rules = R.DEFAULT_RULES + name_rules(names)
    redacted = redact(pipeline.scan(texts(*[t for t in TEXTS if t]), rules=rules), level)
    for r in redacted.collect():
        for start, end, _ in plain(r.text):
            assert r.text[start:end] not in r.redacted_text or level == "SYNTHETIC" or plain(r.text[start:end]) != [
                (0, end - start, s) for s in (0.85, 0.75)]
    assert redacted.where("entities_redacted = 0").count() == 0
