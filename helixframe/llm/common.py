"""Helpers shared by the training-data operators: words, shared scratch tables, joins that survive hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACES_RE = "[\\x20\\x09-\\x0D]+"
WORD_RE = "[^\\x20\\x09-\\x0D]+"
#: A key is hot when it holds over one in HOT_SHARE of all rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Array of the words of a text that isn't null; empty for a text without words."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES_RE))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; where none is named, a temporary one on a single machine, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='helixframe-')}"
    return _LOCAL[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone: its owner clears the folder  # noqa: BLE001
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Left join on key (null joins null); right has one row per key, in `n` the left rows that have it (at least).

    Keys with over total / HOT_SHARE rows (at most HOT_SHARE of them) are broadcast, whatever their rows look like; the others
    go through a shuffle in which no key is large. Columns of any type and name may be on the left.
    """
    kept = [c for c in right.columns if c not in (key, n)]
    at = fresh(left.columns, "_key")
    named = {c: fresh([*left.columns, at], f"_right_{i}") for i, c in enumerate(kept)}
    over = F.col(n) > max(1, total // HOT_SHARE)
    side = lambda rows: rows.select(F.col(key).alias(at), *[F.col(c).alias(x) for c, x in named.items()])
    hot, cold = side(right.where(over)), side(right.where(~over))
    same = left[key].eqNullSafe(F.col(at))
    out = [*[left[c] for c in left.columns], *[F.col(x).alias(c) for c, x in named.items()]]
    met = left.join(F.broadcast(hot), same).select(*out)
    rest = left.join(F.broadcast(hot.select(at)), same, "left_anti")
    same, out = rest[key].eqNullSafe(F.col(at)), [*[rest[c] for c in rest.columns], *out[len(left.columns) :]]
    return met.unionByName(rest.join(cold, same, "left").select(*out))


def hot_join(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join on a key that is never null; right has one row per key, and in `n` the left rows that have it.

    Keys with over total / HOT_SHARE rows (at most HOT_SHARE of them, whatever the input) are broadcast,
    the rest goes through a shuffle in which no key is large.
    """
    over = F.col(n) > max(1, total // HOT_SHARE)
    hot, cold = right.where(over).drop(n), right.where(~over).drop(n)
    return left.join(F.broadcast(hot), key).unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def fresh(columns: list[str], name: str) -> str:
    """A column name like `name` that isn't among `columns` (Spark compares them without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a bigint column `name` of 1, 2, 3... over all its rows in the given order; what is equal in it gets numbers in any order.

    Rows are dealt in ranges and sorted there, and written with their places, so no task holds more than its range. A row's
    number is its place plus the sizes of the ranges before its own: a table of one row a partition, hence broadcast.
    """
    at, part, before = (fresh(df.columns, f"_{name}_{x}") for x in ("at", "part", "before"))
    places = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    places = materialise(places, "numbered").withColumn(part, F.shiftright(at, 33))
    sizes = places.groupBy(part).agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias(before))
    within = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return places.join(F.broadcast(starts), part).select(*df.columns, (F.col(before) + within + 1).alias(name))


#: Rows of an Arrow batch, so that a Python worker holds few texts at a time.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
