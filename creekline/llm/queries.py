"""One query per operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creekline.llm import (
    filter_audit, mixing, nearest, packing, personal_data, quality_classifier, quality_rules, simhash, substring_dedup,
    token_counts, toxicity, url_filters, whitening,
)
from creekline.llm.common import read_columns

TOKENIZER = "word_bpe_49k.json"
RULES = [
    url_filters.Rule("net/", "block"), url_filters.Rule("example.net/en/", "allow"),
    url_filters.Rule("example.com/de/", "block"), url_filters.Rule("org/fr/", "allow"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(read_columns(spark, sf_dir, "pages", ["page_id", "url"]), "page_id", "url", RULES)


def held_out(key: str):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_columns(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = read_columns(spark, sf_dir, "labels", ["doc_id", "toxic"]).filter(~held_out("doc_id"))
    machine = toxicity.fit_machine(documents, labels, "doc_id", "text", "toxic")
    scored = toxicity.with_scores(documents, "text", machine)
    return scored.select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_columns(spark, sf_dir, "documents", ["doc_id", "text"])
    return token_counts.count_tokens(documents, "doc_id", "text", public_tokenizers.path(TOKENIZER), 2048)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(read_columns(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_columns(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_columns(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    return mixing.mix_sources(documents, "doc_id", "text", "source")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_columns(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return nearest.nearest(vectors, "vec_id", "embedding", lambda id_: F.pmod(id_, F.lit(50)) == 0, 5)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.linked_documents(read_columns(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_columns(spark, sf_dir, "documents", ["doc_id", "text"])
    return packing.pack_documents(documents, "doc_id", "text", public_tokenizers.path(TOKENIZER))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(read_columns(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_columns(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    labels = read_columns(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    return filter_audit.audit_filters(documents, labels, "doc_id", "text", "source", "quality", "toxic")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_columns(spark, sf_dir, "documents", ["doc_id", "text"])
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    trusted = read_columns(spark, sf_dir, "labels", ["doc_id", "quality"]).filter((F.col("quality") == 1) & ~held)
    scorer = quality_classifier.fit_scorer(documents, trusted, "doc_id", "text")
    return quality_classifier.with_quality(documents, "text", scorer).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_columns(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), "vec_id", "embedding")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_quality_rules": op4_quality_rules,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_mixing": op6_mixing,
    "op7_nearest": op7_nearest,
    "op8_simhash": op8_simhash,
    "op9_packing": op9_packing,
    "op10_personal_data": op10_personal_data,
    "op11_filter_audit": op11_filter_audit,
    "op12_quality": op12_quality,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {"op11_filter_audit": filter_audit.audit_sql()}
