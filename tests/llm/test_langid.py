"""Language ID with several scripts, large alphabets and long texts."""

from __future__ import annotations

import random

from piiloom.llm import langid


def test_every_letter_of_a_sample_is_a_symbol_of_its_own():
    rng = random.Random(4)
    # more letters than a table has columns, in two languages that share all of them
    letters = [chr(0x4E00 + i) for i in range(300)]
    words = {k: ["".join(rng.choices(letters, k=3)) for _ in range(60)] for k in "xy"}
    samples = {k: " ".join(rng.choices(w, k=500)) for k, w in words.items()} | {"z": "plain letters"}
    parser = langid.CrossParser(samples)
    for text in [" ".join(rng.choices(words[k], k=8)) + extra for k in "xy" for extra in ("", " abc \u0436", "\u4e00!")]:
        want = []
        for lang in parser.languages:
            n, i = 0, 0
            while i < len(text):  # the longest piece that occurs in the sample; runs of non-letters are one
                j = i + 1
                flat = "".join(c if c.isalpha() else " " for c in samples[lang])
                t = "".join(c if c.isalpha() else " " for c in text)
                while j < len(t) and t[i:j] in flat and t[i:j + 1] in flat:
                    j += 1
                n, i = n + 1, j
            want.append(n)
        assert parser.phrases([text])[0].tolist() == want
    found, _ = parser.predict([" ".join(rng.choices(words[k], k=10)) for k in "xyxy"])
    assert found == list("xyxy")


def test_languages_of_long_texts_only_are_learned(spark):
    rows = [(i, ("der die das und nicht " if i % 2 else "the and that with ") * 12_000, "de" if i % 2 else "en")
            for i in range(16)]
    rows += [(100 + i, "", "en") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parser = langid.learn(docs)
    assert parser.languages == ["de", "en"]
    got = langid.identify(docs.where("text <> ''"), parser).collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)
