"""The registered queries: every operator over whole tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from piiloom import rules as R
from piiloom.operators import (catalog, detect, govern, ingest, lifecycle, quality,
                               redact, risk, states)
from piiloom.operators.names import name_rules
from piiloom.plans import pipeline
from piiloom.session import shared_folder, stored_copy
from piiloom.sources import derived, documents
from piiloom.streaming import jobs as streams
from piiloom.streaming.run import (ingest_once, read_changes, read_entities, read_stream, read_uploads,
                                    run, track_statuses, upsert_documents)

# Size limits at which the test pages fall on both sides.
PAGE_LIMITS = {"pdf": 1500, "png": 800, "jpg": 2000, "jpeg": 1200, "docx": 1800}
# Page length at which the test pages give all three scan types.
PAGE_CHARS = 400
REPORT_TIME = "timestamp_ntz '2024-02-01 00:00:00'"


def tidy(df: DataFrame) -> DataFrame:
    """Columns in comparable types: long integers, doubles at six places, joined arrays."""
    columns = []
    for field in df.schema.fields:
        column, kind = F.col(field.name), field.dataType
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("long")
        elif isinstance(kind, T.DoubleType):
            column = F.round(column, 6)
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(column, ",")
        columns.append(column.alias(field.name))
    return df.select(*columns)


# --- shared inputs -----------------------------------------------------------

def _corpus(spark, sf):
    return derived.job_statuses(derived.corpus(spark, sf))


def _rules(spark):
    """The default rules and the names of the dictionary."""
    return R.DEFAULT_RULES + name_rules(derived.name_dictionary(spark))


def _scanned(spark, sf):
    return pipeline.scan(_corpus(spark, sf), rules=_rules(spark))


def _entities(spark, sf):
    return detect.detect_all(derived.corpus(spark, sf), _rules(spark))


def _redacted(spark, sf, level="FULL", overlap="splice"):
    return redact.redact(_scanned(spark, sf), level, overlap=overlap)


_CATALOGS: dict[tuple[str, str], str] = {}


def stored(spark, sf) -> pipeline.Catalog:
    """The catalog tables of a data folder, written once per application."""
    key = spark.sparkContext.applicationId, sf
    if key not in _CATALOGS:
        folder = shared_folder(spark, "catalog")
        docs, forms = _corpus(spark, sf), F.col("doc_id").startswith("k")
        # in three runs: all documents, the forms once more (they replace themselves), and that run repeated
        for run_name, rows in (("all", docs), ("forms", docs.where(forms)), ("forms", docs)):
            pipeline.write_catalog(rows, folder, timestamp=F.expr(REPORT_TIME), run=run_name, rules=_rules(spark))
        _CATALOGS[key] = folder
    return pipeline.read_catalog(spark, _CATALOGS[key])


def _containers(spark, sf):
    return govern.all_containers(stored(spark, sf).jobs)


def _tags(spark, sf):
    return govern.doc_tags(stored(spark, sf).jobs)


def _existing_tags(tags):
    return tags.filter(F.substring(F.sha2(F.concat("doc_id", "tag_fqn"), 256), 1, 1) < "8")


def _base(spark, sf):
    return risk.risk_base(risk.risk_by_type(_entities(spark, sf)))


def _now(text):
    return F.expr(f"timestamp_ntz '{text}'")


# --- sources, sinks, ingest ------------------------------------------------------

def load_documents(spark, sf):
    return documents.load_documents(spark, f"{sf}/documents.parquet", "parquet",
                                    ["doc_id", "text", "lang", "source"])


def validate_files(spark, sf):
    return ingest.validate_files(derived.files(spark, sf), PAGE_LIMITS).select(
        "file_id", "filename", "ok", "reject_code", "reject_reason")


def content_hash(spark, sf):
    return ingest.content_hash(derived.files(spark, sf)).select("file_id", "file_hash")


def dedup_by_hash(spark, sf):
    hashed = ingest.content_hash(derived.corpus(spark, sf), "text").select(
        "doc_id", "file_hash", "created_at")
    return ingest.dedup_by_hash(stored_copy(hashed, "hashes"), id="doc_id")


def storage_keys(spark, sf):
    return ingest.storage_keys(derived.corpus(spark, sf)).select("doc_id", "storage_key")


def upload_records(spark, sf):
    return ingest.upload_records(derived.files(spark, sf), id="file_id")


def scan_type(spark, sf):
    return ingest.scan_types(derived.page_texts(spark, sf), derived.paged_documents(spark, sf),
                             PAGE_CHARS)


def join_pages(spark, sf):
    return ingest.join_pages(derived.page_texts(spark, sf))


def page_and_char_counts(spark, sf):
    return ingest.page_and_char_counts(derived.corpus(spark, sf))


def unseen_documents(spark, sf):
    hashed = stored_copy(ingest.content_hash(derived.files(spark, sf)).select(
        "file_id", "n", "file_hash"), "hashes")
    return ingest.unseen_documents(
        hashed, derived.extracted_texts(hashed), _now("2024-01-01 02:00:00")
    ).select("file_id", "file_hash")


def write_redacted(spark, sf):
    """All documents at FULL, then every second one at LIGHT and every third again, at FULL with other stand-ins."""
    path = shared_folder(spark, "redacted")
    scanned = _scanned(spark, sf)
    documents.write_redacted(ingest.storage_keys(redact.redact(scanned, "FULL")), path, run="all")
    some = redact.redact(scanned.where("n % 2 = 0"), "LIGHT")
    others = redact.redact(scanned.where("n % 3 = 0"), "SYNTHETIC").withColumn("redaction_level", F.lit("FULL"))
    for name, rows in (("light", some), ("again", others), ("again", some)):
        documents.write_redacted(ingest.storage_keys(rows), path, run=name)
    return documents.read_redacted(spark, path).select(
        "doc_id", "redacted_key", "redaction_level", "entities_redacted", F.sha2("redacted_text", 256).alias("text_hash"))


def redacted_lines(spark, sf):
    return documents.redacted_lines(_redacted(spark, sf))


# --- detection ---------------------------------------------------------------------

_SPAN_COLUMNS = ("doc_id", "entity_type", "subtype", "start_offset", "end_offset", "confidence")


def _rule_query(*names):
    def query(spark, sf):
        rules = tuple(r for r in R.DEFAULT_RULES if r.name in names)
        return detect.detect_all(derived.corpus(spark, sf), rules, threshold=0.0,
                                 boost=False).select(*_SPAN_COLUMNS, "value_hash")
    return query


def detect_person(spark, sf):
    """The names and the capitalised words of the benchmark texts, however they are written."""
    return detect.detect_person(derived.corpus(spark, sf), derived.person_dictionary(spark, sf)).select(
        *_SPAN_COLUMNS, "value_hash")


def detect_person_joined(spark, sf):
    """The names, as written, by the join that dictionaries of any size use."""
    return detect.join_names(derived.corpus(spark, sf), derived.name_dictionary(spark), ignore_case=False).select(
        *_SPAN_COLUMNS, "value_hash")


def spans(spark, sf):
    docs = derived.corpus(spark, sf)
    parts = detect.with_chunks(detect.with_spans(docs, _rules(spark), threshold=0.0, boost=False,
                                                 suppress=False))
    values = F.transform(F.arrays_zip("spans", redact.span_values().alias("value")), lambda z: F.struct(
        z["spans"]["rule"].alias("rule"), z["spans"]["start_offset"].alias("start_offset"),
        z["spans"]["end_offset"].alias("end_offset"), z["value"].alias("value")))
    return parts.select("doc_id", F.inline(values))


def context_boost(spark, sf):
    return detect.detect_all(derived.corpus(spark, sf), _rules(spark), threshold=0.0, suppress=False).select(
        "doc_id", "rule", "start_offset", "confidence")


def threshold_filter(spark, sf):
    found = detect.detect_all(derived.corpus(spark, sf), _rules(spark), threshold=0.0)
    return detect.threshold_filter(found, 0.8).select(*_SPAN_COLUMNS)


def normalise_types(spark, sf):
    raw = [r for r in R.DEFAULT_RULES if r.entity_type in R.NORMALISED_TYPES]
    back = {v: k for k, v in R.NORMALISED_TYPES.items()}
    library = detect.normalise_types(
        detect.detect_all(derived.corpus(spark, sf), tuple(raw)), back)
    return detect.normalise_types(library).groupBy("entity_type").agg(F.count("*").alias("n"))


def subtype_tag(spark, sf):
    return detect.subtype_tag(_entities(spark, sf).drop("subtype")).groupBy(
        "entity_type", "subtype").agg(F.count("*").alias("n"))


def entity_allow_list(spark, sf):
    return detect.detect_all(derived.corpus(spark, sf), _rules(spark),
                             entity_types=("PAN", "EMAIL", "PERSON")).select(*_SPAN_COLUMNS)


def suppress_contained(spark, sf):
    every = detect.with_spans(derived.corpus(spark, sf), _rules(spark), threshold=0.0, suppress=False)
    return detect.entity_rows(detect.suppress_contained_spans(every)).select(
        *_SPAN_COLUMNS, "rule")


def detect_all(spark, sf):
    return _entities(spark, sf)


def entity_counts(spark, sf):
    return detect.counts_in_row(_scanned(spark, sf))


# --- risk ------------------------------------------------------------------------------

def risk_by_type(spark, sf):
    return risk.risk_by_type(_entities(spark, sf))


def risk_diversity(spark, sf):
    return risk.risk_diversity(_base(spark, sf)).select("doc_id", "base", "n_types", "score")


def risk_critical_boost(spark, sf):
    return risk.risk_critical_boost(risk.risk_diversity(_base(spark, sf))).select("doc_id", "score")


def _combined(spark, sf):
    return risk.risk_combinations(risk.risk_critical_boost(
        risk.risk_diversity(_base(spark, sf))))


def risk_combinations(spark, sf):
    return _combined(spark, sf).select("doc_id", "combination_points", "score")


def risk_floor_cap(spark, sf):
    return risk.risk_floor_cap(_combined(spark, sf)).select("doc_id", "score")


def risk_band(spark, sf):
    scored = risk.risk_band(risk.risk_floor_cap(_combined(spark, sf)))
    return scored.groupBy("risk_band").agg(F.count("*").alias("n"), F.min("score").alias("lowest"),
                                           F.max("score").alias("highest"))


def risk_score(spark, sf):
    return _scanned(spark, sf).select("doc_id", "risk_score", "risk_band")


def risk_from_entities(spark, sf):
    return risk.risk_from_entities(_entities(spark, sf), derived.corpus(spark, sf))


def risk_explain(spark, sf):
    return risk.risk_explain(_scanned(spark, sf)).select(
        "doc_id", "summary", "diversity_note", "unique_types")


def risk_contributors(spark, sf):
    return risk.contributor_rows(risk.risk_explain(_scanned(spark, sf)))


def high_risk_docs(spark, sf):
    return risk.high_risk(_scanned(spark, sf)).select("doc_id", "risk_score")


def residual_risk(spark, sf):
    """At LIGHT, which leaves the ends of values and so parts of names, and at SYNTHETIC, whose
    stand-ins are found again."""
    found = [pipeline.residual_risk(_redacted(spark, sf, level), rules=_rules(spark)).withColumn(
        "redaction_level", F.lit(level)) for level in ("LIGHT", "FULL", "SYNTHETIC")]
    return found[0].unionByName(found[1]).unionByName(found[2])


# --- redaction ---------------------------------------------------------------------------

def _replacements(level, *types):
    def query(spark, sf):
        edits = redact.with_redactions(_scanned(spark, sf), level)
        rows = edits.select("doc_id", F.inline("redactions")).select(
            "doc_id", "entity_type", "start_offset", "end_offset", "replacement")
        return rows.filter(F.col("entity_type").isin(list(types))) if types else rows
    return query


def _redacted_texts(level, overlap="splice"):
    def query(spark, sf):
        return _redacted(spark, sf, level, overlap).select(
            "doc_id", "redacted_text", "entities_redacted")
    return query


def redact_stored(spark, sf):
    """Redaction asked for later, at another level, from the stored spans."""
    redacted = pipeline.redact_stored(derived.corpus(spark, sf), stored(spark, sf), "LIGHT")
    return redacted.select("doc_id", "redacted_text", "entities_redacted")


def redact_bucketed(spark, sf):
    """The same from texts stored in buckets, so that the spans come to the texts."""
    buckets = max(8, spark.sparkContext.defaultParallelism)
    folder = shared_folder(spark, "texts")
    docs = documents.write_bucketed(derived.corpus(spark, sf), "texts_" + folder[-32:], folder, buckets)
    redacted = pipeline.redact_stored(docs, stored(spark, sf), "LIGHT")
    return redacted.select("doc_id", "redacted_text", "entities_redacted")


def audit_mapping(spark, sf):
    return redact.audit_mapping(_redacted(spark, sf, "LIGHT"))


def span_hashes(spark, sf):
    return redact.span_hash_rows(_redacted(spark, sf))


def _reports(spark, sf):
    return redact.redaction_reports(_redacted(spark, sf), F.expr(REPORT_TIME))


def redaction_report(spark, sf):
    return _reports(spark, sf).select(
        "doc_id", "filename", "redaction_level", "timestamp", "total_entities_redacted",
        "risk_score_before", "risk_score_after", "audit_mapping_count")


def redaction_instances(spark, sf):
    return _reports(spark, sf).select("doc_id", F.inline("pii_instances"))


def redaction_leak_check(spark, sf):
    return redact.leak_check(_redacted(spark, sf))


# --- catalog --------------------------------------------------------------------------------

def document_status(spark, sf):
    return catalog.document_status(stored(spark, sf).jobs, stored(spark, sf).entities)


def pii_summary(spark, sf):
    return catalog.pii_summary(stored(spark, sf).entities)


def risk_breakdown(spark, sf):
    return catalog.risk_breakdown(stored(spark, sf).entities)


def risk_lookup(spark, sf):
    return catalog.risk_lookup(stored(spark, sf).jobs, stored(spark, sf).entities)


def list_entities(spark, sf):
    return catalog.list_entities(stored(spark, sf).entities)


def docs_by_band_topk(spark, sf):
    return catalog.docs_by_band(stored(spark, sf).jobs, "CRITICAL", 50)


def band_distribution(spark, sf):
    return catalog.band_distribution(stored(spark, sf).jobs)


def audit_trail(spark, sf):
    return catalog.audit_trail(derived.audit_logs(spark, sf))


def docs_with_type(spark, sf):
    return catalog.docs_with_type(stored(spark, sf).jobs, stored(spark, sf).entities, "AADHAAR",
                                  "CRITICAL").select("doc_id", "filename", "risk_score")


def recent_docs_by_band(spark, sf):
    return catalog.recent_docs(stored(spark, sf).jobs, "HIGH", _now("2024-01-08 00:00:00")).select(
        "doc_id", "filename", "risk_score", "created_at")


def text_segments(spark, sf):
    return catalog.text_segments(_scanned(spark, sf))


def type_share_of_max(spark, sf):
    return catalog.type_share_of_max(stored(spark, sf).entities)


def progress_step(spark, sf):
    return catalog.progress_step(stored(spark, sf).jobs)


def distinct_types(spark, sf):
    return catalog.distinct_types(stored(spark, sf).entities)


def sample_docs(spark, sf):
    return catalog.sample_docs(stored(spark, sf).jobs)


def redactable_docs(spark, sf):
    return catalog.redactable_docs(stored(spark, sf).jobs).select("doc_id", "status")


def scored_docs(spark, sf):
    return catalog.scored_docs(stored(spark, sf).jobs).select("doc_id", "risk_score", "risk_band")


def pending_docs(spark, sf):
    return catalog.pending_docs(stored(spark, sf).jobs).select("doc_id", "status")


# --- governance --------------------------------------------------------------------------------

def doc_tags(spark, sf):
    return _tags(spark, sf)


def new_tags(spark, sf):
    tags = _tags(spark, sf)
    return govern.new_tags(tags, _existing_tags(tags))


def tag_hierarchy(spark, sf):
    return govern.tag_hierarchy(stored(spark, sf).jobs)


def containers(spark, sf):
    return _containers(spark, sf).drop("types")


def file_formats(spark, sf):
    return derived.corpus(spark, sf).select(
        "doc_id", "filename", F.coalesce(govern.file_formats(F.col("filename")),
                                         F.array().cast("array<string>")).alias("file_formats"))


def risk_properties(spark, sf):
    return govern.risk_properties(_containers(spark, sf))


def lineage_edges(spark, sf):
    return govern.lineage_edges(_containers(spark, sf), stored(spark, sf).reports)


def run_metrics(spark, sf):
    runs = _corpus(spark, sf).select(
        F.concat(F.lit("run-"), F.floor(F.col("n") / 50).cast("string")).alias("run_id"),
        F.when(F.col("status") == "COMPLETED", F.lit("success"))
        .when(F.col("status") == "FAILED", F.lit("failed")).otherwise(F.lit("partial"))
        .alias("status"), F.col("created_at").alias("started_at"))
    return govern.run_metrics(runs)


def policy_match(spark, sf):
    gov = [t for t in R.tag_map().values() if "IndianGovtID" in t]
    return govern.policy_match(stored(spark, sf).jobs, gov)


def policy_audit(spark, sf):
    return govern.policy_audit(stored(spark, sf).jobs, F.expr(REPORT_TIME))


def policy_masked_view(spark, sf):
    return govern.policy_masked_view(_redacted(spark, sf))


# --- lifecycle ------------------------------------------------------------------------------------

def append_audit(spark, sf):
    docs = _corpus(spark, sf)
    uploads = lifecycle.audit_rows(
        docs, "UPLOAD", details=F.create_map(F.lit("file_hash"), F.sha2("text", 256)),
        ts=F.col("created_at"))
    asked = lifecycle.audit_rows(
        catalog.redactable_docs(docs), "REDACT", "user1",
        F.create_map(F.lit("redaction_level"), F.lit("FULL")), F.lit("10.0.0.1"),
        F.col("created_at"))
    # two runs into one log, the second delivered twice
    path = shared_folder(spark, "audit")
    for run_name, rows in (("uploads", uploads), ("asked", asked), ("asked", asked)):
        lifecycle.log_audit(rows, path, run_name)
    return lifecycle.read_audit(spark, path).withColumn("details", F.to_json("details"))


def pipeline_audit(spark, sf):
    """The audit rows that the pipeline itself left in the catalog."""
    return stored(spark, sf).audit.withColumn("details", F.to_json("details"))


def task_events(spark, sf):
    docs = _corpus(spark, sf)
    at = F.col("created_at")
    size = F.create_map(F.lit("chars"), F.char_length("text").cast("string"),
                        F.lit("task_name"), F.lit("detect_text"))
    rows = lifecycle.append_audit(
        lifecycle.task_events(docs, "task_start", "detect", at),
        lifecycle.task_events(docs.filter("status = 'COMPLETED'"), "task_complete", "detect", at,
                              details=size),
        lifecycle.task_events(docs.filter("status = 'FAILED'"), "task_failure", "detect", at,
                              error=F.concat(F.lit("failed "), F.col("doc_id"))))
    d = F.col("details")
    return rows.select("doc_id", "action", "actor", "ts", d["event"].alias("event"),
                       d["task_name"].alias("task_name"), d["error"].alias("error"),
                       d["chars"].alias("chars"))


def current_status(spark, sf):
    return lifecycle.current_status(derived.transitions(derived.audit_logs(spark, sf)))


def failed_docs(spark, sf):
    docs = _corpus(spark, sf).withColumn("details", F.create_map(
        F.lit("char_count"), F.char_length("text").cast("string")))
    marked = lifecycle.mark_failed(docs, F.concat(F.lit("no text for "), F.col("doc_id")),
                                   F.char_length("text") < 40)
    return lifecycle.failed_docs(marked)


def merge_details(spark, sf):
    done = _redacted(spark, sf)
    return done.select("doc_id", lifecycle.pipeline_details(done).alias("details")).select(
        "doc_id", F.explode("details").alias("name", "value"))


def cascade_delete(spark, sf):
    jobs = stored(spark, sf).jobs
    failed = jobs.filter("status = 'FAILED'")
    return lifecycle.cascade_delete(stored(spark, sf).entities, failed).select(*_SPAN_COLUMNS)


def cascade_delete_all(spark, sf):
    """What is left of every table that refers to a job, counted by document."""
    tables = stored(spark, sf)
    failed = tables.jobs.filter("status = 'FAILED'")
    parts = lifecycle.cascade_delete_all({
        "entities": tables.entities, "reports": tables.reports, "audit": tables.audit}, failed)
    counts = [df.groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("table_name", F.lit(name))
              for name, df in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# --- validation and JSON -----------------------------------------------------------------------------

def _flawed_entities(spark, sf):
    """Entities with some offsets and scores put wrong, to have violations to find."""
    size = F.char_length("value_hash")
    picked = F.conv(F.substring("value_hash", size, 1), 16, 10).cast("int")
    return stored(spark, sf).entities.select(
        "doc_id", "entity_type",
        F.when(picked == 1, -F.col("start_offset") - 1).otherwise(F.col("start_offset"))
        .alias("start_offset"),
        F.when(picked == 2, F.col("start_offset"))
        .when(picked == 3, F.col("end_offset") + 100000).otherwise(F.col("end_offset"))
        .alias("end_offset"),
        F.when(picked == 4, F.col("confidence") + 1).when(picked == 5, F.lit(None))
        .otherwise(F.col("confidence")).alias("confidence"))


def constraint_violations(spark, sf):
    jobs = stored(spark, sf).jobs.withColumn(
        "risk_score", F.when(F.col("file_size") % 11 == 0, F.col("risk_score") + 95)
        .otherwise(F.col("risk_score")))
    return quality.constraint_violations(jobs, _flawed_entities(spark, sf), stored(spark, sf).reports)


def span_validity(spark, sf):
    sizes = stored(spark, sf).jobs.select("doc_id", "char_count")
    checked = quality.span_validity(_flawed_entities(spark, sf).join(sizes, "doc_id"))
    return checked.groupBy("entity_type", "valid").agg(F.count("*").alias("n"))


def _records(spark, sf):
    """Canonical JSON of every report; some cut short, some out of bounds or incomplete."""
    records = quality.report_metadata(stored(spark, sf).reports).select(
        "doc_id", quality.canonical_json(F.col("metadata")).alias("json"))
    kind = F.conv(F.substring(F.sha2("doc_id", 256), 1, 1), 16, 10).cast("int")
    broken = (F.when(kind == 0, F.substring("json", F.lit(1), F.char_length("json") - 5))
              .when(kind == 1, F.replace("json", F.lit('"risk_score_after":0.0'),
                                         F.lit('"risk_score_after":100.5')))
              .when(kind == 2, F.replace("json", F.lit('"redaction_level":"FULL",'), F.lit("")))
              .when(kind == 3, F.replace("json", F.lit('"redaction_level":"FULL"'),
                                         F.lit('"redaction_level":"NONE"')))
              .when(kind == 4, F.replace("json", F.lit('"risk_score_after":0.0'),
                                         F.lit('"risk_score_after":"low"')))
              .when(kind == 5, F.regexp_replace("json", '"filename":"[^"]*"', '"filename":5'))
              .when(kind == 6, F.regexp_replace("json", '"redacted_value":"[^"]*"', '"redacted_value":["x"]'))
              .otherwise(F.col("json")))
    return records.select("doc_id", broken.alias("json"))


def parse_metadata(spark, sf):
    m = F.col("metadata")
    return quality.parse_metadata(_records(spark, sf)).select(
        "doc_id", "ok", "reject_reason", "ill_typed",
        F.when(F.col("ok"), m["filename"]).alias("filename"),
        F.when(F.col("ok"), m["total_entities_redacted"]).alias("total_entities_redacted"),
        F.when(F.col("ok"), F.size(m["pii_instances"])).alias("n_instances"))


def canonical_json(spark, sf):
    """Each record's canonical form, whole, with numbers at six places."""
    m = F.col("metadata")
    instances = F.transform(m["pii_instances"], lambda p: p.withField("confidence", F.round(p["confidence"], 6)))
    whole = m.withField("pii_instances", instances).withField(
        "risk_score_before", F.round(m["risk_score_before"], 6))
    records = quality.report_metadata(stored(spark, sf).reports).select("doc_id", whole.alias("metadata"))
    return records.select("doc_id", quality.canonical_json(m).alias("json"))


def json_round_trip(spark, sf):
    """Every report, some with a score out of bounds, which comes back as a reject."""
    records = quality.report_metadata(stored(spark, sf).reports)
    wrong = F.substring(F.sha2("doc_id", 256), 1, 1) == "7"
    m = F.col("metadata")
    return quality.json_round_trip(records.withColumn("metadata", m.withField(
        "risk_score_after", F.when(wrong, F.lit(100.5)).otherwise(m["risk_score_after"]))))


def orphan_rows(spark, sf):
    return quality.orphan_rows(derived.audit_logs(spark, sf), stored(spark, sf).jobs).select(
        "event_id", "doc_id", "action")


def unique_hash_check(spark, sf):
    return quality.repeated_hashes(stored(spark, sf).jobs)


# --- streaming ------------------------------------------------------------

def _stream_corpus(spark, sf):
    prose = read_stream(spark, f"{sf}/documents.parquet").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    forms = read_stream(spark, f"{sf}/customer.parquet").select(F.col("c_custkey").alias("k"))
    forms = forms.select(F.concat(F.lit("k"), F.col("k").cast("string")).alias("doc_id"),
                         F.expr(derived.KYC_TEXT).alias("text"))
    return forms.unionByName(prose)


def stream_ingest(spark, sf):
    root = shared_folder(spark, "uploads")
    files = derived.files_from_pages(read_stream(spark, f"{sf}/pages.parquet"))
    ingest_once(files, f"{root}/table", f"{root}/checkpoint", PAGE_LIMITS).awaitTermination()
    # the same uploads again, a day earlier for some and later for the others: the earliest of all stay
    again = files.withColumn("created_at", F.when(F.col("file_id") % 5 == 0, F.col("created_at") - F.expr(
        "interval 1 day")).otherwise(F.col("created_at") + F.expr("interval 1 day"))).withColumn(
        "file_id", F.col("file_id") + 1_000_000)
    ingest_once(again, f"{root}/table", f"{root}/checkpoint2", PAGE_LIMITS, "again").awaitTermination()
    return read_uploads(spark, f"{root}/table")


def stream_detect(spark, sf):
    return run(streams.detect(_stream_corpus(spark, sf), rules=_rules(spark)))


def stream_upsert(spark, sf):
    """All documents, then every third form again with another text."""
    root, rules = shared_folder(spark, "upsert"), _rules(spark)
    upsert_documents(_stream_corpus(spark, sf), f"{root}/table", f"{root}/checkpoint", rules=rules).awaitTermination()
    forms = read_stream(spark, f"{sf}/customer.parquet").select(F.col("c_custkey").alias("k"))
    again = derived.resent_forms(forms).select(F.concat(F.lit("k"), F.col("k").cast("string")).alias("doc_id"), "text")
    upsert_documents(again, f"{root}/table", f"{root}/checkpoint2", "again", rules=rules).awaitTermination()
    return read_entities(spark, f"{root}/table").select(*_SPAN_COLUMNS, "value_hash")


def stream_status(spark, sf):
    audit = derived.audit_from_events(read_stream(spark, f"{sf}/events.parquet"))
    return streams.latest_status(run(streams.status(derived.transitions(audit)), mode="update"))


# The steps between the statuses that audit events give.
AUDIT_STEPS = {"": ("PENDING",), "PENDING": ("PII_DETECTING", "FAILED"), "PII_DETECTING": ("REDACTING", "FAILED"),
               "REDACTING": ("COMPLETED", "FAILED"), "COMPLETED": ("REDACTING",), "FAILED": ("PENDING",)}


def legal_transitions(spark, sf):
    return states.check_transitions(derived.transitions(derived.audit_logs(spark, sf)), AUDIT_STEPS)


def stream_transitions(spark, sf):
    """Status changes of the first half of the time, then those of the second."""
    root = shared_folder(spark, "transitions")
    for name, when in (("first", "ts < timestamp_ntz '2024-01-15 00:00:00'"),
                       ("second", "not (ts < timestamp_ntz '2024-01-15 00:00:00')")):
        audit = derived.audit_from_events(read_stream(spark, f"{sf}/events.parquet"))
        track_statuses(derived.transitions(audit).where(when), f"{root}/table", f"{root}/checkpoint-{name}",
                       AUDIT_STEPS, name).awaitTermination()
    return read_changes(spark, f"{root}/table")


def upload_rate_breaches(spark, sf):
    requests = derived.requests_from_events(read_stream(spark, f"{sf}/events.parquet"))
    return run(streams.breaches(requests, streams.request_limits(spark)))


def _registry():
    named = {
        # sources, sinks, ingest
        "load_documents": load_documents, "validate_files": validate_files,
        "content_hash": content_hash, "dedup_by_hash": dedup_by_hash,
        "storage_keys": storage_keys, "upload_records": upload_records, "scan_type": scan_type,
        "join_pages": join_pages, "page_and_char_counts": page_and_char_counts,
        "unseen_documents": unseen_documents, "write_redacted": write_redacted,
        "redacted_lines": redacted_lines,
        # detection
        "detect_aadhaar_spaced": _rule_query("aadhaar_spaced"),
        "detect_aadhaar_hyphen": _rule_query("aadhaar_hyphen"),
        "detect_aadhaar_plain": _rule_query("aadhaar_plain"),
        "detect_pan": _rule_query("pan_holder_letter", "pan_shape"),
        "detect_dl_spaced_initials": _rule_query("dl_spaced_initials"),
        "detect_dl_spaced": _rule_query("dl_spaced"),
        "detect_dl_hyphen4_initials": _rule_query("dl_hyphen4_initials"),
        "detect_dl_hyphen4": _rule_query("dl_hyphen4"),
        "detect_dl_hyphen3": _rule_query("dl_hyphen3"),
        "detect_dl_plain": _rule_query("dl_plain"),
        "detect_email": _rule_query("email"),
        "detect_phone": _rule_query("phone_in", "phone_us"),
        "detect_person": detect_person, "detect_person_joined": detect_person_joined, "spans": spans, "context_boost": context_boost,
        "threshold_filter": threshold_filter, "normalise_types": normalise_types,
        "subtype_tag": subtype_tag, "entity_allow_list": entity_allow_list,
        "suppress_contained": suppress_contained, "detect_all": detect_all,
        "entity_counts": entity_counts,
        # risk
        "risk_by_type": risk_by_type, "risk_diversity": risk_diversity,
        "risk_critical_boost": risk_critical_boost, "risk_combinations": risk_combinations,
        "risk_floor_cap": risk_floor_cap, "risk_band": risk_band, "risk_score": risk_score,
        "risk_from_entities": risk_from_entities, "risk_explain": risk_explain,
        "risk_contributors": risk_contributors, "high_risk_docs": high_risk_docs,
        "residual_risk": residual_risk,
        # redaction
        "redact_light": _replacements("LIGHT"), "redact_full": _replacements("FULL"),
        "redact_synthetic": _replacements("SYNTHETIC"),
        "synthetic_aadhaar": _replacements("SYNTHETIC", "AADHAAR"),
        "synthetic_pan": _replacements("SYNTHETIC", "PAN"),
        "synthetic_dl": _replacements("SYNTHETIC", "DRIVING_LICENSE"),
        "synthetic_contact": _replacements("SYNTHETIC", "EMAIL", "PHONE", "PERSON"),
        "redact_documents": _redacted_texts("FULL"),
        "redact_documents_light": _redacted_texts("LIGHT"),
        "redact_documents_synthetic": _redacted_texts("SYNTHETIC"),
        "redact_documents_merged": _redacted_texts("FULL", "merge"),
        "redact_stored": redact_stored, "redact_bucketed": redact_bucketed,
        "audit_mapping": audit_mapping, "span_hashes": span_hashes,
        "redaction_report": redaction_report, "redaction_instances": redaction_instances,
        "redaction_leak_check": redaction_leak_check,
        # catalog
        "document_status": document_status, "pii_summary": pii_summary,
        "risk_breakdown": risk_breakdown, "risk_lookup": risk_lookup,
        "list_entities": list_entities, "docs_by_band_topk": docs_by_band_topk,
        "band_distribution": band_distribution, "audit_trail": audit_trail,
        "docs_with_type": docs_with_type, "recent_docs_by_band": recent_docs_by_band,
        "text_segments": text_segments, "type_share_of_max": type_share_of_max,
        "progress_step": progress_step, "distinct_types": distinct_types,
        "sample_docs": sample_docs, "redactable_docs": redactable_docs,
        "scored_docs": scored_docs, "pending_docs": pending_docs,
        # governance
        "doc_tags": doc_tags, "new_tags": new_tags, "tag_hierarchy": tag_hierarchy,
        "containers": containers, "file_formats": file_formats,
        "risk_properties": risk_properties, "lineage_edges": lineage_edges,
        "run_metrics": run_metrics, "policy_match": policy_match,
        "policy_audit": policy_audit, "policy_masked_view": policy_masked_view,
        # lifecycle
        "append_audit": append_audit, "task_events": task_events,
        "current_status": current_status, "failed_docs": failed_docs,
        "merge_details": merge_details, "cascade_delete": cascade_delete,
        "cascade_delete_all": cascade_delete_all, "pipeline_audit": pipeline_audit,
        # validation and JSON
        "constraint_violations": constraint_violations, "parse_metadata": parse_metadata,
        "canonical_json": canonical_json, "json_round_trip": json_round_trip,
        "span_validity": span_validity, "orphan_rows": orphan_rows,
        "unique_hash_check": unique_hash_check,
        # streaming
        "stream_ingest": stream_ingest, "stream_detect": stream_detect,
        "stream_upsert": stream_upsert, "stream_status": stream_status,
        "legal_transitions": legal_transitions, "stream_transitions": stream_transitions,
        "upload_rate_breaches": upload_rate_breaches,
    }

    def tidied(query):
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(query(spark, sf_dir))
        return call

    return {name: tidied(query) for name, query in named.items()}


QUERIES = _registry()
