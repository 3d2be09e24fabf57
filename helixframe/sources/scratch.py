"""Tables that a dataflow writes once and reads several times."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names; on a single machine that names none, a temporary one; else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='helixframe-')}"
    return _LOCAL[app]


def remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone: its owner clears the folder  # noqa: BLE001
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet; what comes to be there goes when the driver ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that it is computed once and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
