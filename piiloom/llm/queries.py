"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piiloom.llm import (bpe, collocations, dedup, langid, lm, mixing, neardup, packing, quality, tokens,
                         topk, urls, variants)
from piiloom.llm.common import fold, read_table

BYTE_BPE = "byte_bpe_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"
QUALITY_THRESHOLD = 0.3


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages")).select(
        "page_id", "host", "path", "rule", "verdict", "template")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    voter = quality.learn(docs, read_table(spark, sf_dir, "labels"))
    return quality.classify(docs, voter).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= QUALITY_THRESHOLD, 1).otherwise(0).alias("predicted"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.find_copies(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lm.score_texts(docs, docs.where(~lm.held_out(F.col("doc_id"))))
    return found.select("doc_id", lm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
                        "train_tokens", "base_score", "score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    parser = langid.learn(docs)
    return langid.identify(docs.select("doc_id", "text"), parser).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.find_near_copies(read_table(spark, sf_dir, "documents"), words=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id",
                        (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read_table(spark, sf_dir, "documents"),
                               public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(read_table(spark, sf_dir, "documents"),
                            public_tokenizers.path(WORD_BPE))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants.group_variants(docs, one_in=97)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read_table(spark, sf_dir, "documents").select("text", "lang"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "whole")


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_url_filters, op3_quality_classifier, op4_exact_topk, op5_exact_dedup,
    op6_lm_scoring, op7_language_id, op8_minhash_near_dedup, op9_token_counts, op10_bpe,
    op11_spelling_variants, op12_collocations, op13_source_mixing)}
