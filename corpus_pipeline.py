"""A corpus pipeline: language ID, near-duplicates, benchmark decontamination, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seekframe.llm import decontam, language_id, near_duplicates, packing, pii
from seekframe.llm.common import scratch, staged

STAGES = [
    ("language_id", language_id.keep_identified),
    ("near_duplicates", near_duplicates.keep_one),
    ("decontamination", decontam.decontaminate),
    ("pii", pii.redact_stage),
    ("packing", packing.pack_stage),
]

#: Learnt models and a tokenizer's ids can't be written in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row over ``documents``, each written as Parquet and read again; what a stage has staged for itself goes with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
