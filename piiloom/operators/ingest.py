"""Validation, hashing, de-duplication and text assembly for incoming files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piiloom import rules as R
from piiloom.functions.text import extension, lookup, percent_encode, strip_space

# Pages of one document are first joined in blocks of this many pages.
PAGE_BLOCK = 256


def validate_files(files: DataFrame, limits: dict | None = None,
                   magic: dict | None = None) -> DataFrame:
    """Add ``ok, reject_code, reject_reason``; the first failing check decides.

    Extension (415), empty content (400), size limit (413), leading bytes (400).
    """
    limits = R.SIZE_LIMITS if limits is None else limits
    magic = R.MAGIC_BYTES if magic is None else magic
    ext = extension(F.coalesce("filename", F.lit("unknown")))
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    matches = F.lit(False)
    for kind, head in magic.items():
        signed = F.hex(F.substring("content", 1, len(head) // 2)) == head
        matches = matches | ((F.col("_ext") == kind) & signed)
    checked = files.withColumn("_ext", ext)
    allowed = F.coalesce(F.col("_ext").isin(list(magic)), F.lit(False))
    checks = (
        (~allowed, 415, "unsupported file type"),
        (size == 0, 400, "empty file"),
        (size > lookup(limits, F.col("_ext")), 413, "file too large"),
        (~matches, 400, "content does not match extension"),
    )
    code = F.coalesce(*[F.when(failed, F.lit(number)) for failed, number, _ in checks])
    reason = F.coalesce(*[F.when(failed, F.lit(text)) for failed, _, text in checks])
    return (checked.withColumn("reject_code", code).withColumn("reject_reason", reason)
            .withColumn("ok", F.col("reject_code").isNull()).drop("_ext"))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted files and the quarantine."""
    accepted = validated.filter("ok").drop("ok", "reject_code", "reject_reason")
    return accepted, validated.filter(~F.col("ok")).drop("ok")


def content_hash(df: DataFrame, column: str = "content", name: str = "file_hash") -> DataFrame:
    """SHA-256 of the content, in hexadecimal."""
    return df.withColumn(name, F.sha2(F.col(column), 256))


def dedup_by_hash(files: DataFrame, id: str = "file_id", hash: str = "file_hash",
                  time: str = "created_at") -> DataFrame:
    """``id, hash, canonical_id, is_duplicate``: the earliest upload of a hash wins.

    The earliest id per hash is a partial aggregation, so a hash shared by a
    third of all files costs one row per task.  Joining it back needs only the
    hashes that occur more than once; the rest answer for themselves.  ``files``
    is read twice, so pass a stored table of hashes rather than one that still
    has to read the contents.
    """
    keyed = files.select(id, hash, time)
    first = keyed.groupBy(hash).agg(
        F.min_by(id, F.struct(time, id)).alias("canonical_id"), F.count("*").alias("_n"))
    repeated = first.filter("_n > 1").drop("_n")
    return (salted_join(keyed, repeated, hash, id)
            .select(id, hash, F.coalesce("canonical_id", F.col(id)).alias("canonical_id"),
                    F.coalesce(F.col("canonical_id") != F.col(id), F.lit(False))
                    .alias("is_duplicate")))


def salted_join(facts: DataFrame, unique: DataFrame, key: str, spread: str,
                salts: int = 16) -> DataFrame:
    """Left join of ``facts`` to one row per ``key``, with every key cut in ``salts`` parts.

    ``spread`` is a column that differs between facts of one key.  ``unique``
    is repeated once per part, so use it where that side is the small one.
    """
    left = facts.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    right = unique.withColumn("_salt", F.explode(F.sequence(
        F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def storage_keys(files: DataFrame, id: str = "doc_id", prefix: str = "documents") -> DataFrame:
    """``documents/<id>/<percent-encoded filename>``."""
    named = F.when(F.coalesce("filename", F.lit("")) == "", F.lit("document")
                   ).otherwise(F.col("filename"))
    return files.withColumn("storage_key", F.concat(
        F.lit(prefix + "/"), F.col(id).cast("string"), F.lit("/"), percent_encode(named)))


def upload_records(files: DataFrame, id: str = "doc_id") -> DataFrame:
    """The PENDING job row of each new file."""
    named = F.when(F.coalesce("filename", F.lit("")) == "", F.lit("unknown")
                   ).otherwise(F.col("filename"))
    typed = F.when(F.coalesce("content_type", F.lit("")) == "",
                   F.lit("application/octet-stream")).otherwise(F.col("content_type"))
    hashed = storage_keys(files if "file_hash" in files.columns else content_hash(files), id)
    return hashed.select(
        F.col(id).alias("doc_id"), named.alias("filename"), "file_hash",
        F.octet_length("content").cast("long").alias("file_size"), typed.alias("content_type"),
        "storage_key", F.lit("PENDING").alias("status"),
        "created_at", F.col("created_at").alias("updated_at"))


def scan_types(pages: DataFrame, documents: DataFrame, threshold: int = R.SCAN_CHARS) -> DataFrame:
    """TEXT, SCANNED or MIXED per document from the stripped length of its pages."""
    chars = F.char_length(strip_space(F.col("text")))
    per_doc = (pages.select("doc_id", chars.alias("n")).groupBy("doc_id")
               .agg(F.avg("n").alias("mean"), F.max("n").alias("longest")))
    kind = (F.when(F.col("mean").isNull(), F.lit("SCANNED"))
            .when(F.col("mean") >= threshold, F.lit("TEXT"))
            .when(F.col("longest") < threshold, F.lit("SCANNED")).otherwise(F.lit("MIXED")))
    return documents.select("doc_id").join(per_doc, "doc_id", "left").select(
        "doc_id", kind.alias("scan_type"))


def join_pages(pages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """One text per document from its pages in order.

    Blocks of consecutive pages are joined first, on as many tasks as there
    are blocks; a very long document is then put together from few strings.
    """
    block = F.floor(F.col("page_no") / PAGE_BLOCK).alias("block")

    def joined(order):
        return F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), separator)

    blocks = (pages.groupBy("doc_id", block).agg(
        joined("page_no").alias("text"), F.count("*").alias("n")))
    return blocks.groupBy("doc_id").agg(joined("block").alias("text"),
                                        F.sum("n").alias("page_count"))


def page_and_char_counts(docs: DataFrame, chars_per_page: int = R.CHARS_PER_PAGE) -> DataFrame:
    """Characters, and pages estimated from paragraph characters (images: one page)."""
    chars = F.char_length("text")
    body = F.char_length(F.replace("text", F.lit("\n"), F.lit("")))
    image = F.coalesce(extension(F.col("filename")).isin("png", "jpg", "jpeg"), F.lit(False))
    pages = F.when(image, F.lit(1).cast("long")).otherwise(
        F.greatest(F.lit(1).cast("long"), F.floor(body / chars_per_page)))
    return docs.select("doc_id", chars.cast("long").alias("char_count"),
                       pages.alias("page_count"))


def unseen_documents(files: DataFrame, extracted: DataFrame, now,
                     ttl: int = R.TEXT_CACHE_SECONDS) -> DataFrame:
    """Files with no text extracted for the same content within ``ttl`` seconds.

    Only recent extractions are kept on the build side, and each hash once.
    """
    since = now - F.expr(f"interval {int(ttl)} seconds")
    fresh = extracted.filter(F.col("extracted_at") >= since).select("file_hash").distinct()
    return files.join(fresh, "file_hash", "left_anti")
