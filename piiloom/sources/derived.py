"""Document tables derived from the benchmark tables.

The driver's tables hold no Indian identity numbers, so form texts are made
from ``customer`` by arithmetic; the other inputs of the registered queries are
projections of ``documents``, ``pages``, ``conversations`` and ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piiloom import rules as R
from piiloom.functions.text import lookup
from piiloom.operators.names import TOKEN
from piiloom.sources.documents import spread

_STATE = "substr('MHKADLTN', cast(1 + 2 * (k % 4) as int), 2)"
_OFFICE = "lpad(cast(1 + k % 99 as string), 2, '0')"
_YEAR = "cast(2000 + k % 27 as string)"
_SERIAL = "lpad(cast((k * 7907) % 10000000 as string), 7, '0')"
_FIRST = f"split_part('{','.join(R.FIRST_NAMES)}', ',', cast(1 + k % 8 as int))"
_LAST = f"split_part('{','.join(R.LAST_NAMES)}', ',', cast(1 + (k * 5) % 8 as int))"
#: Of a first name that stands alone.
FIRST_NAME_SCORE = 0.75
_SEPARATOR = "case k % 3 when 0 then ' ' when 1 then '-' else '' end"

# Runs unchanged in Spark SQL and in other ANSI engines; k is the customer key.  Some addresses hold a
# name, so spans overlap; some names are only the beginning of a longer word.
KYC_TEXT = f"""concat('Form ', cast(k as string), ' ',
 case when k % 4 = 3 then '' else concat(
   case when k % 2 = 0 then 'Aadhaar Number: ' else 'Ref: ' end,
   cast(2000 + k % 8000 as string), {_SEPARATOR},
   lpad(cast((k * 7919) % 10000 as string), 4, '0'), {_SEPARATOR},
   lpad(cast((k * 104729) % 10000 as string), 4, '0')) end,
 case when k % 3 = 0 then concat(' PAN: ',
   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(1 + k % 26 as int), 1), 'BCPE',
   lpad(cast(k % 10000 as string), 4, '0'), 'F') else '' end,
 case k % 7
   when 0 then concat(' DL: ', {_STATE}, {_OFFICE}, ' AB ', {_YEAR}, ' ', {_SERIAL})
   when 1 then concat(' DL: ', {_STATE}, {_OFFICE}, ' ', {_YEAR}, ' ', {_SERIAL})
   when 2 then concat(' DL: ', {_STATE}, '-', {_OFFICE}, '-AB-', {_YEAR}, '-', {_SERIAL})
   when 3 then concat(' DL: ', {_STATE}, '-', {_OFFICE}, '-', {_YEAR}, '-', {_SERIAL})
   when 4 then concat(' DL: ', {_STATE}, '-', {_OFFICE}, '-', {_YEAR}, {_SERIAL})
   when 5 then concat(' DL: ', {_STATE}, {_OFFICE}, {_YEAR}, {_SERIAL})
   else '' end,
 case k % 6 when 1 then concat(' Name: ', {_FIRST}, ' ', {_LAST}) when 2 then concat(' Attn ', {_FIRST}, '.')
   when 5 then concat(' Signed ', upper({_LAST}), ', ', {_FIRST}, ' ', {_LAST}, 'son') else '' end,
 case when k % 5 = 0 then concat(' Email: ', case k % 20 when 5 then concat({_FIRST}, '.u')
   when 15 then concat('m.', {_FIRST}, '.u') else 'user' end, cast(k as string), '@example.com') else '' end,
 case when k % 50 = 0 then concat(' Phone: +91', cast(9000000000 + k as string))
      when k % 5 = 1 then concat(' Phone: +91-98765-', lpad(cast(k % 100000 as string), 5, '0'))
      else '' end)"""

FILENAME = """case n % 6
   when 0 then concat('Form ', cast(n as string), '.pdf')
   when 1 then concat('report_', cast(n as string), '.docx')
   when 2 then concat('Scan (', cast(n as string), ').PNG')
   when 3 then concat('data-', cast(n as string), '.v2.csv')
   when 4 then null
   else concat('~page*', cast(n as string), '&x') end"""

CONTENT_TYPE = """case n % 6 when 0 then 'application/pdf' when 2 then 'image/png'
   when 3 then 'text/csv' when 5 then '' else null end"""

ACTIONS = {"signup": "UPLOAD", "view": "PROCESS", "click": "REDACT",
           "purchase": "APPLY_POLICY", "error": "FAILED"}
TRANSITIONS = {"UPLOAD": "PENDING", "PROCESS": "PII_DETECTING", "REDACT": "REDACTING",
               "APPLY_POLICY": "COMPLETED", "FAILED": "FAILED"}
REQUESTS = {"signup": "UPLOAD", "click": "REDACT", "view": "STATUS"}
EPOCH = "timestamp_ntz '2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minutes_after_epoch(minutes: str):
    return F.expr(f"timestampadd(MINUTE, {minutes}, {EPOCH})")


def kyc_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")
    return keys.select(F.concat(F.lit("k"), F.col("k").cast("string")).alias("doc_id"),
                       F.col("k").alias("n"), F.expr(KYC_TEXT).alias("text"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and prose together: ``doc_id, n, text, filename, content_type, created_at``."""
    prose = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"),
        F.col("doc_id").alias("n"), "text")
    return kyc_docs(spark, sf_dir).unionByName(prose).select(
        "doc_id", "n", "text", F.expr(FILENAME).alias("filename"),
        F.expr(CONTENT_TYPE).alias("content_type"),
        minutes_after_epoch("n").alias("created_at"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_from_pages(table(spark, sf_dir, "pages"))


def files_from_pages(pages: DataFrame) -> DataFrame:
    """Uploads made from ``pages``: every extension, and every reason to reject."""
    head = """case page_id % 8 when 0 then X'25504446' when 1 then X'89504E470D0A1A0A'
        when 2 then X'FFD8FF' when 3 then X'504B0304' else X'' end"""
    filename = """case page_id % 8
        when 0 then concat('page', cast(page_id as string), '.pdf')
        when 1 then concat('page', cast(page_id as string), '.png')
        when 2 then concat('page', cast(page_id as string), '.JPG')
        when 3 then concat('page.', cast(page_id as string), '.docx')
        when 4 then concat('page', cast(page_id as string), '.exe')
        when 5 then null
        when 6 then concat('empty', cast(page_id as string), '.pdf')
        else concat('page', cast(page_id as string), '.jpeg') end"""
    # Some contents are only the end of the address, so that they repeat.
    body = """case when page_id % 8 = 6 then X'' when page_id % 16 < 4
        then cast(substr(url, length(url), 1) as binary) else cast(html as binary) end"""
    return pages.select(
        F.col("page_id").alias("file_id"), F.col("page_id").alias("n"),
        F.expr(filename).alias("filename"),
        F.expr(f"concat({head}, {body})").alias("content"),
        F.expr("case when page_id % 3 = 0 then 'text/html' end").alias("content_type"),
        minutes_after_epoch("page_id").alias("created_at"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of text: the turns of ``conversations``, every third padded with white space."""
    text = "case when turn % 3 = 1 then concat('  ', text, chr(10)) else text end"
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("doc_id"),
        F.col("turn").alias("page_no"), F.expr(text).alias("text"))


def paged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of ``page_texts``, and labelled ones that may have no page."""
    talks = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("doc_id"))
    labelled = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("doc_id"))
    return talks.union(labelled).distinct()


def extracted_texts(hashed_files: DataFrame) -> DataFrame:
    """A text cache: part of the hashes, extracted at different times."""
    return hashed_files.filter("length(file_hash) = 64 and substr(file_hash, 1, 1) < '8'").select(
        "file_hash", minutes_after_epoch("n % 120").alias("extracted_at"))


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit events from ``events``: ``event_id, doc_id, action, actor, details, ip_address, ts``."""
    return audit_from_events(table(spark, sf_dir, "events"))


def audit_from_events(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        F.concat(F.lit("d"), (F.col("user_id") * 10).cast("string")).alias("doc_id"),
        lookup(ACTIONS, F.col("event_type")).alias("action"),
        F.concat(F.lit("user"), (F.col("user_id") % 7).cast("string")).alias("actor"),
        F.col("props").alias("details"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 50).cast("string")).alias("ip_address"),
        F.col("ts").cast("timestamp_ntz").alias("ts"))


def requests_from_events(events: DataFrame) -> DataFrame:
    """Requests of two addresses, with time run 400 times as fast so that some minutes are over the limits."""
    at = f"timestampadd(MICROSECOND, timestampdiff(MICROSECOND, {EPOCH}, cast(ts as timestamp_ntz)) div 400, {EPOCH})"
    return events.select(
        lookup(REQUESTS, F.col("event_type")).alias("action"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 2).cast("string")).alias("ip_address"),
        F.expr(at).alias("ts"))


def resent_forms(forms: DataFrame) -> DataFrame:
    """Every third form again, with the text of the form after it: ``k, text``."""
    return forms.where("k % 3 = 0").select((F.col("k") + 1).alias("k")).select(
        (F.col("k") - 1).alias("k"), F.expr(KYC_TEXT).alias("text"))


def transitions(audit: DataFrame) -> DataFrame:
    """Status changes read off the audit log."""
    return audit.select("doc_id", lookup(TRANSITIONS, F.col("action")).alias("status"),
                        "ts", F.col("event_id").alias("seq"))


def name_dictionary(spark: SparkSession) -> DataFrame:
    """Full names, and first names alone with a lower score: ``name, score``."""
    rows = [(f"{a} {b}", R.PERSON_SCORE) for a in R.FIRST_NAMES for b in R.LAST_NAMES]
    return spark.createDataFrame(rows + [(a, FIRST_NAME_SCORE) for a in R.FIRST_NAMES], "name string, score double")


def person_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`name_dictionary` and every capitalised word of the whole ``benchmark`` texts: ``name, score``."""
    words = F.filter(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), lambda w: w.rlike(r"^\p{Lu}"))
    found = table(spark, sf_dir, "benchmark").select(F.explode(words).alias("name")).distinct()
    return name_dictionary(spark).unionByName(found.select("name", F.lit(R.PERSON_SCORE).alias("score")))


def job_statuses(docs: DataFrame) -> DataFrame:
    """``docs`` with a lifecycle status spread over all of them."""
    states = F.array(*[F.lit(s) for s in R.STATUSES])
    return docs.withColumn("status", F.element_at(states, (F.col("n") % 7 + 1).cast("int")))
