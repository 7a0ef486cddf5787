"""Stages of the corpus pipeline; each takes (spark, docs, sf_dir).

Every stage works on all rows it is given and keeps the columns of ``documents``, but for the
last, which returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creekline.llm import mixing, packing, personal_data, simhash, toxicity
from creekline.llm.common import read_columns, shielded

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity under a half; the labels of ``sf_dir`` teach the machine.

    Null and empty texts score the base rate and so stay unless most labels are toxic. Rows that repeat share their
    fate, long texts are read whole, columns keep their names whatever these are, and an empty table stays empty.
    """
    labels = read_columns(spark, sf_dir, "labels", ["doc_id", "toxic"])
    machine = toxicity.fit_machine(docs.select("doc_id", "text"), labels, "doc_id", "text", "toxic")

    def kept(rows: DataFrame, of: dict[str, str]) -> DataFrame:
        return toxicity.with_scores(rows, of["text"], machine, "toxicity").filter(F.col("toxicity") < 0.5).select(*rows.columns)

    return shielded(docs, kept)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8. Null and empty texts are
    copies of each other; of rows equal in key and text one stays; names of columns do not matter."""
    return simhash.without_near_copies(docs, "doc_id", "text")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the text."""
    clean = personal_data.redact(docs, "text")
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return clean.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A null source is a source, a null or empty text has no words and is
    taken with the rest of its source; of equal rows at the cutoff as many are taken as fit."""
    return mixing.mixed_documents(docs, "doc_id", "text", "source")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents: null and empty texts are their end id alone, repeated rows are packed each."""
    return packing.pack_documents(docs, "doc_id", "text", public_tokenizers.path(TOKENIZER))
