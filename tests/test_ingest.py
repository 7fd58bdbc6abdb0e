import hashlib

from pyspark.sql import functions as F

from piiloom.functions.text import extension, percent_encode, strip_space
from piiloom.operators import ingest
from piiloom.sources import documents

PDF, PNG, DOCX, JPG = b"%PDF", b"\x89PNG\r\n\x1a\n", b"PK\x03\x04", b"\xff\xd8\xff"


def test_file_checks_in_order(spark):
    cases = [
        ("a.pdf", PDF + b"x", None), ("b.PNG", PNG, None), ("c.v2.docx", DOCX, None),
        ("d.jpeg", JPG + b"1", None), ("e.jpg", JPG, None),
        ("f.exe", b"", 415), ("noext", PDF, 415), (None, PDF, 415), ("g.", PDF, 415),
        ("h.pdf", b"", 400), ("i.png", PNG + b"x" * 50, 413), ("j.pdf", b"x" * 200, 413),
        ("k.pdf", PNG, 400), ("l.docx", b"PK\x03", 400), ("m.pdf", None, 400)]
    df = spark.createDataFrame([(i, n, c) for i, (n, c, _) in enumerate(cases)],
                               "file_id int, filename string, content binary")
    out = ingest.validate_files(df, {"pdf": 100, "png": 40, "jpg": 40, "jpeg": 40, "docx": 100})
    rows = {r.file_id: r for r in out.collect()}
    for i, (name, _, code) in enumerate(cases):
        assert rows[i].reject_code == code and rows[i].ok == (code is None), name
    good, bad = ingest.split_valid(out)
    assert (good.count(), bad.count()) == (5, len(cases) - 5)


def test_hash_and_dedup_with_a_hot_hash(spark):
    rows = [(f"f{i}", "same" if i % 3 == 0 else f"text {i}", 1000 - i) for i in range(300)]
    rows += [("g1", "tie", 5), ("g0", "tie", 5)]
    files = ingest.content_hash(spark.createDataFrame(
        rows, "file_id string, content string, created_at int"))
    out = {r.file_id: r for r in ingest.dedup_by_hash(files).collect()}
    assert len(out) == 302
    assert out["f0"].canonical_id == "f297" and out["f0"].is_duplicate
    assert out["f297"].canonical_id == "f297" and not out["f297"].is_duplicate
    assert out["f1"].canonical_id == "f1" and not out["f1"].is_duplicate
    assert out["g1"].canonical_id == "g0"
    assert out["f1"].file_hash == hashlib.sha256(b"text 1").hexdigest()


def test_storage_keys_and_records(spark):
    df = spark.createDataFrame(
        [("1", "my file (1)*~.pdf", None, b"ab"), ("2", None, "", b""), ("3", "ä/b+c", "x/y", None)],
        "doc_id string, filename string, content_type string, content binary"
    ).withColumn("created_at", F.expr("timestamp_ntz '2024-01-01 00:00:00'"))
    rows = {r.doc_id: r for r in ingest.upload_records(df).collect()}
    assert rows["1"].storage_key == "documents/1/my%20file%20%281%29%2A~.pdf"
    assert rows["2"].storage_key == "documents/2/document" and rows["2"].filename == "unknown"
    assert rows["3"].storage_key == "documents/3/%C3%A4%2Fb%2Bc"
    assert rows["2"].content_type == "application/octet-stream" and rows["3"].content_type == "x/y"
    assert rows["1"].file_size == 2 and rows["1"].status == "PENDING"


def test_scan_types(spark):
    pages = spark.createDataFrame(
        [("text", 0, "a" * 150), ("text", 1, "b" * 60), ("mixed", 0, "a" * 120), ("mixed", 1, " "),
         ("scan", 0, " " * 500), ("scan", 1, " \n" + "x" * 99)],
        "doc_id string, page_no int, text string")
    docs = spark.createDataFrame([("text",), ("mixed",), ("scan",), ("none",)], "doc_id string")
    out = {r.doc_id: r.scan_type for r in ingest.scan_types(pages, docs).collect()}
    assert out == {"text": "TEXT", "mixed": "MIXED", "scan": "SCANNED", "none": "SCANNED"}


def test_pages_join_in_order_over_blocks(spark):
    pages = spark.createDataFrame([("a", i, f"p{i}") for i in reversed(range(700))]
                                  + [("b", 5, "x"), ("b", 2, "")],
                                  "doc_id string, page_no int, text string")
    out = {r.doc_id: r for r in ingest.join_pages(pages).collect()}
    assert out["a"].text == "\n\n".join(f"p{i}" for i in range(700))
    assert out["a"].page_count == 700 and out["b"].text == "\n\nx"


def test_counts(spark):
    df = spark.createDataFrame([("1", "a.docx", "x" * 2999 + "\n" + "y" * 3001),
                                ("2", "b.PNG", "z" * 9000), ("3", None, "😀é")],
                               "doc_id string, filename string, text string")
    out = {r.doc_id: (r.char_count, r.page_count)
           for r in ingest.page_and_char_counts(df).collect()}
    assert out == {"1": (6001, 2), "2": (9000, 1), "3": (2, 1)}


def test_unseen_documents(spark):
    files = spark.createDataFrame([("1", "h1"), ("2", "h2"), ("3", "h3")],
                                  "doc_id string, file_hash string")
    at = "timestamp_ntz '2024-01-01 {}'"
    seen = spark.sql(f"""select 'h1' file_hash, {at.format('11:00:00')} extracted_at
        union all select 'h1', {at.format('11:30:00')}
        union all select 'h2', {at.format('10:59:59')}""")
    out = ingest.unseen_documents(files, seen, F.expr(at.format("12:00:00")))
    assert sorted(r.doc_id for r in out.collect()) == ["2", "3"]


def test_lines(spark):
    text = "Top <a> & b\r\n\n  \t\nid [REDACTED]\nx **** last\n"
    df = spark.createDataFrame([("1", text), ("2", "")], "doc_id string, redacted_text string")
    out = documents.redacted_lines(df).orderBy("line_no").collect()
    assert [(r.line_no, r.kind, r.safe_text) for r in out] == [
        (0, "body", "Top &lt;a&gt; &amp; b"), (1, "blank", ""), (2, "blank", "  \t"),
        (3, "redacted", "id [REDACTED]"), (4, "redacted", "x ****"), (5, "body", "last")]
    assert [r.safe_text for r in out] == [
        t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        for t in text.splitlines()]


def test_reading_and_writing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("line one\nline two\n")
    text = documents.load_documents(spark, str(tmp_path / "in"), "text").collect()
    assert [r.text for r in text] == ["line one\nline two\n"]
    raw = documents.load_documents(spark, str(tmp_path / "in"), "binary").collect()
    assert bytes(raw[0].content) == b"line one\nline two\n" and raw[0].file_size == 18
    row = "doc_id string, storage_key string, redacted_text string, entities_redacted int, " \
          "redaction_level string"
    for level, body in (("FULL", "x"), ("LIGHT", "y"), ("FULL", "z")):
        df = spark.createDataFrame([("1", "k/1", body, 2, level)], row)
        out = documents.write_redacted(df, str(tmp_path / "out"))
    assert {(r.redaction_level, r.redacted_key) for r in out.collect()} == {
        ("FULL", "k/1.redacted.txt"), ("LIGHT", "k/1.redacted.txt")}
    stored = documents.read_redacted(spark, str(tmp_path / "out"))
    assert {r.redacted_text for r in stored.collect()} == {"y", "z"}


def test_write_redacted_replaces_only_the_documents_of_the_run(spark, tmp_path):
    row = "doc_id string, storage_key string, redacted_text string, entities_redacted int, redaction_level string"
    path = str(tmp_path / "out")
    for docs in ([("a", "1"), ("b", "2")], [("c", "3"), ("b", "4")]):
        df = spark.createDataFrame([(i, f"k/{i}", t, 1, "FULL") for i, t in docs], row)
        documents.write_redacted(df, path)
    stored = {(r.doc_id, r.redacted_text) for r in documents.read_redacted(spark, path).collect()}
    assert stored == {("a", "1"), ("b", "4"), ("c", "3")}


def test_text_helpers(spark):
    df = spark.createDataFrame([(" \t a b \n　", "A.B.PdF"), ("", "none")], "t string, f string")
    rows = df.select(strip_space(F.col("t")).alias("t"), extension(F.col("f")).alias("e"),
                     percent_encode(F.col("f")).alias("p")).collect()
    assert [(r.t, r.e, r.p) for r in rows] == [("a b", "pdf", "A.B.PdF"), ("", None, "none")]
