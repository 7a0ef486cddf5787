"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from creekline.llm import pipeline
from creekline.session import scratch_dir

STAGES = [
    ("toxicity", pipeline.drop_toxic),
    ("simhash_dedup", pipeline.drop_near_copies),
    ("personal_data", pipeline.redact),
    ("mixing", pipeline.mix),
    ("packing", pipeline.pack),
]

#: Fitted models and a tokenizer decide the rows; SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
