from pyspark.sql import functions as F

from piiloom.operators import detect, ingest
from piiloom.plans import pipeline
from piiloom.streaming import jobs
from piiloom.streaming.run import (append_to, ingest_once, read_entities, read_stream, read_uploads, run,
                                   upsert_documents, upsert_to)


def test_detection_equals_batch_over_several_arrivals(spark, tmp_path):
    path = str(tmp_path / "docs")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    total = 0
    for arrival in range(3):
        batch = spark.range(arrival * 10, arrival * 10 + 10).select(
            F.col("id").cast("string").alias("doc_id"),
            F.concat(F.lit("mail u"), "id", F.lit("@x.org Aadhaar 2345 6789 0123")).alias("text"))
        batch.coalesce(1).write.mode("append").parquet(path)
        total += 10
        query = upsert_to(jobs.entities(read_stream(spark, path)), out, checkpoint)
        query.awaitTermination()
        assert spark.read.parquet(out).count() == 2 * total
    columns = ["doc_id", "entity_type", "start_offset", "end_offset", "confidence", "value_hash"]
    streamed = spark.read.parquet(out).select(columns)
    batch = detect.detect_all(spark.read.parquet(path)).select(columns)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    scores = run(jobs.detect(read_stream(spark, path)))
    want = pipeline.scan(spark.read.parquet(path)).select("doc_id", "risk_score")
    assert scores.select("doc_id", "risk_score").exceptAll(want).count() == 0
    assert scores.count() == 30


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    path, out = str(tmp_path / "docs"), str(tmp_path / "out")
    spark.createDataFrame([("1", "a@b.co")], "doc_id string, text string").write.parquet(path)
    for attempt in range(2):  # a new checkpoint makes the same batch run again
        upsert_to(jobs.entities(read_stream(spark, path)), out,
                  str(tmp_path / f"c{attempt}")).awaitTermination()
    assert spark.read.parquet(out).count() == 1


def test_ingest_keeps_each_content_once(spark, tmp_path):
    path = str(tmp_path / "files")
    rows = [(f"f{i}", f"n{i}.pdf", b"%PDF" + (b"same" if i % 3 else str(i).encode()), None)
            for i in range(60)] + [("x", "x.exe", b"%PDF", None), ("y", "y.pdf", b"no", None)]
    at = F.expr("timestamp_ntz '2024-01-01 00:00:00'")
    files = spark.createDataFrame(rows, "file_id string, filename string, content binary,"
                                        "content_type string").withColumn("created_at", at)
    files.repartition(4).write.parquet(path)
    want = ingest.content_hash(files.filter("file_id like 'f%'")).select("file_hash").distinct()
    for watermark in (None, "1 hour"):
        out = run(jobs.ingest(read_stream(spark, path), watermark=watermark))
        assert out.count() == 21 == want.count()
        assert out.select("file_hash").exceptAll(want).count() == 0
        assert {r.status for r in out.collect()} == {"PENDING"}


def test_status_and_rates(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = [("d", "PENDING", 0, 1, "ip1"), ("d", "COMPLETED", 50, 2, "ip1"), ("d", "FAILED", 20, 3, "ip1"),
            ("e", "PENDING", 61, 4, "ip1"), ("e", "PENDING", 10, 5, "ip2")]
    spark.createDataFrame(rows, "doc_id string, status string, at int, seq long, ip_address string"
                          ).withColumn("ts", F.expr(
        "timestampadd(SECOND, at, timestamp_ntz '2024-01-01 00:00:00')")).write.parquet(path)
    latest = jobs.latest_status(run(jobs.status(read_stream(spark, path)), mode="update"))
    assert {r.doc_id: r.status for r in latest.collect()} == {"d": "COMPLETED", "e": "PENDING"}
    counts = run(jobs.request_counts(read_stream(spark, path)), mode="update")
    over = jobs.rate_breaches(counts, limit=2).collect()
    assert [(str(r.minute), r.ip_address, r.n) for r in over] == [
        ("2024-01-01 00:00:00", "ip1", 3)]
    assert jobs.rate_breaches(counts, limit=3).count() == 0


def test_a_document_sent_again_replaces_its_entities(spark, tmp_path):
    path, out = str(tmp_path / "docs"), str(tmp_path / "table")
    sent = [[("1", "a@b.co c@d.co", 1), ("2", "e@f.co", 1)], [("1", "g@h.co", 2), ("2", "none", 3), ("2", "x@y.co", 2)]]
    for batch, rows in enumerate(sent):
        spark.createDataFrame(rows, "doc_id string, text string, version int").coalesce(1).write.mode("append").parquet(path)
        for attempt in range(2):  # the second delivery, with a checkpoint of its own, finds the run in the log
            upsert_documents(read_stream(spark, path).where(F.col("version") > batch), out, str(tmp_path / f"c{batch}{attempt}"),
                             f"s{batch}", ["version"]).awaitTermination()
    assert {(r.doc_id, r.start_offset, r.end_offset) for r in read_entities(spark, out).collect()} == {("1", 0, 6)}


def test_ingest_keeps_the_earliest_upload_over_batches(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / n) for n in ("files", "table", "checkpoint"))
    uploads = [("a", "same", 5), ("b", "other", 5)], [("c", "same", 3), ("d", "same", 9)], [("e", "same", 3), ("f", "new", 1)]
    for rows in uploads:
        spark.createDataFrame([(i, f"{i}.pdf", b"%PDF" + c.encode(), None, m) for i, c, m in rows],
                              "file_id string, filename string, content binary, content_type string, m int").withColumn(
            "created_at", F.expr("timestampadd(MINUTE, m, timestamp_ntz '2024-01-01 00:00:00')")).drop("m").coalesce(
            1).write.mode("append").parquet(path)
        ingest_once(read_stream(spark, path), out, checkpoint).awaitTermination()
    files = spark.read.parquet(path)
    first = ingest.dedup_by_hash(ingest.content_hash(files).withColumnRenamed("file_id", "doc_id"), id="doc_id")
    want = {r.canonical_id for r in first.collect()}
    assert {r.doc_id for r in read_uploads(spark, out).collect()} == want == {"b", "c", "f"}


def test_breaches_of_limits_by_kind_and_late_requests(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / n) for n in ("requests", "out", "checkpoint"))
    batches = [[("UPLOAD", "ip1", 1)] * 3 + [("UPLOAD", "ip2", 1)] * 2 + [("REDACT", "ip1", 1)] * 3 + [("PAY", "ip1", 1)] * 9,
               [("STATUS", "ip1", 3600)], [("UPLOAD", "ip2", 2)] * 5 + [("STATUS", "ip1", 9000)]]
    limits = jobs.request_limits(spark, {"UPLOAD": 2, "REDACT": 5, "STATUS": 1})
    for rows in batches:
        spark.createDataFrame(rows, "action string, ip_address string, at int").select("action", "ip_address", F.expr(
            "timestampadd(SECOND, at, timestamp_ntz '2024-01-01 00:00:00')").alias("ts")).coalesce(
            1).write.mode("append").parquet(path)
        append_to(jobs.breaches(read_stream(spark, path), limits), out, checkpoint).awaitTermination()
    # the requests of ip2 that come after the minute is closed are not counted
    assert [(r.ip_address, r.action, r.n, r.limit) for r in spark.read.parquet(out).collect()] == [("ip1", "UPLOAD", 3, 2)]
