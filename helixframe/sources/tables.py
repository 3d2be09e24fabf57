"""The tables of a scale factor's folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """spread: for work that costs much more than reading. Splits follow row groups, of which a small table has fewer than
    there are cores, so its rows are dealt over them; a table of more splits than cores is read as it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() <= cores else df
