"""The corpus pipeline: stages that each read what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import common, mixing, packing, pii, quality_rules, simhash_dedup

STAGES = [
    ("quality rules", quality_rules.stage),
    ("SimHash near-dedup", simhash_dedup.stage),
    ("PII", pii.stage),
    ("mixing to target weights", mixing.stage),
    ("packing", packing.stage),
]
#: Near-duplicates, keyed pseudonyms, sampling and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
