"""Sharding along a Hilbert curve over several metadata dimensions.

Language, source and size are quantised to BITS bits each: values of language and source by their rank in lexical order (beyond
2**BITS values neighbours share a cell), sizes by their logarithm; a text's copies take the
cell of the copy with the least doc_id, so equal texts have one index. Rows are sorted by (index, text hash, doc_id) and
the order is cut into runs of near equal bytes. One rule holds for all groups of copies: a cut that falls within a group moves to
the nearer end of the group if that is at most MOVE of a shard away, otherwise it stays, since no shard could be near its share.
The law is `bytes`: sizes are near equal.

The sort is a range partitioning by the full key, so a text that is a third of all rows is spread as well. The driver
gets a row of totals per range (at most MAX_RANGES) and a row per shard.
Edge cases: a null text has no bytes and equals the empty text; null language and source are values of their own;
repeated rows are rows of their own, of any number; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

BITS = 5
SHARDS = 24
#: A cut moves by at most this share of a shard to keep the copies of a text together.
MOVE = 0.02
ROWS_A_RANGE, MAX_RANGES = 20_000, 4096


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of each row of `cells` (rows x dimensions, each below 2**bits)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):  # undo excess work from the top bit down
        high, low = 1 << b, (1 << b) - 1
        for d in range(dims):
            up = (x[d] & high) > 0
            swap = np.where(up, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, dims):  # to Gray code
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where(x[dims - 1] & (1 << b), flip ^ ((1 << b) - 1), flip)
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | ((x[d] >> b) & 1)
    return out


def _curve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"g": pdf["g"], "n": pdf["n"], "curve": hilbert_index(pdf[["a", "b", "c"]].to_numpy())})


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Position, bytes before, and bytes before the text's first copy, within the sorted range; -1: it may begin before."""
    i = at = 0
    last, begun = None, -1
    for pdf in batches:
        if pdf.empty:
            continue
        size, key = pdf["size"].to_numpy(), pdf["g"].to_numpy()
        before = at + np.cumsum(size) - size
        new = np.concatenate([[last is not None and key[0] != last], key[1:] != key[:-1]])
        starts = np.where(new, before, -1)
        starts[0] = starts[0] if new[0] else begun
        pdf["start"] = np.maximum.accumulate(starts)
        pdf["i"], pdf["at"] = i + np.arange(len(pdf)), before
        last, begun = key[-1], int(pdf["start"].iat[-1])
        i, at = i + len(pdf), int(before[-1] + size[-1])
        yield pdf


def shard_of(at: Column, start: Column, end: Column, total_bytes: int, shards: int) -> Column:
    """Shard of a row by the bytes before it and before and up to the end of its text's copies."""
    number = lambda x: F.floor(x * F.lit(shards) / F.lit(max(total_bytes, 1)))
    share = total_bytes / shards
    low, high, own = number(start), number(end - 1), number(at)
    before, behind = (low + 1) * share - start, end - high * share  # how far the first cut within lies from the start, the last from the end
    move = F.lit(MOVE * share)
    up = (high > low) & (own == low) & (before <= move) & ((high > low + 1) | (before <= behind))
    down = (high > low) & (own == high) & (behind <= move) & ((high > low + 1) | (behind < before))
    moved = F.when(up, own + 1).when(down, own - 1).otherwise(own)
    return F.least(F.lit(shards - 1), F.greatest(F.lit(0), moved)).cast("int")


def cells(rows: DataFrame, column: str, total: int) -> DataFrame:
    """column, n (its rows), cell: the rank of each value, spread over the cells if there are more values; null comes first."""
    values = C.numbered(C.materialise(rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")), "shard-values"), [F.col(column).asc_nulls_first()], "place")
    values = C.materialise(values, "shard-cells")
    most = F.lit(max(1 << BITS, values.count()))
    return values.select(column, "n", F.floor((F.col("place") - 1) * F.lit(1 << BITS) / most).cast("int").alias(f"{column}_cell"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """For each row of docs (doc_id, text, lang, source): doc_id, size, text_crc32, curve, shard, slot."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = C.materialise(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("g"),
            F.col("lang").cast("string").alias("lang"),
            F.col("source").cast("string").alias("source"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    total, total_bytes = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    least = F.struct(F.col("doc_id").isNull(), "doc_id", "lang", "source")
    groups = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min(least).alias("first"), F.min("size").alias("size"))
    log = F.least(F.lit((1 << BITS) - 1), F.floor(F.log2("size") * 1.5)).cast("int")
    groups = C.materialise(groups.select("g", F.col("n").alias("copies"), F.col("first.lang").alias("lang"), F.col("first.source").alias("source"), log.alias("c")), "shard-texts")
    for column in ("lang", "source"):
        groups = C.spread_join(groups, cells(rows, column, total), column, "n", total)
    groups = groups.select("g", F.col("copies").alias("n"), F.col("lang_cell").alias("a"), F.col("source_cell").alias("b"), "c")
    groups = C.materialise(groups.mapInPandas(_curve, "g long, n long, curve long").withColumn("copies", F.col("n")), "shard-groups")
    joined = C.hot_join(rows.drop("lang", "source"), groups, "g", "n", total)
    ranges = max(1, min(MAX_RANGES, total // ROWS_A_RANGE))
    key = ["curve", "g", "doc_id", "row"]  # the row's number parts rows that are equal otherwise
    placed = joined.select(*key, "size", "text_crc32", "copies").repartitionByRange(ranges, *key).sortWithinPartitions(*key)
    schema = T.StructType([*placed.schema.fields, *[T.StructField(c, T.LongType()) for c in ("start", "i", "at")]])
    placed = C.materialise(placed.mapInPandas(_local, schema).withColumn("part", F.spark_partition_id()), "shard-order")

    edge = lambda f, c: f(F.struct("i", c))[c].alias(f"{f.__name__}_{c}")
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), edge(F.min, "g"), edge(F.max, "g"), edge(F.max, "start"))
    offsets, rows_before, bytes_before, open_g, open_start = [], 0, 0, None, 0
    for p in sorted(parts.collect()):
        carried = open_start if open_g is not None and p["min_g"] == open_g else bytes_before
        offsets.append((p["part"], rows_before, bytes_before, carried))
        open_start = carried if p["max_start"] < 0 else bytes_before + p["max_start"]
        open_g, rows_before, bytes_before = p["max_g"], rows_before + p["rows"], bytes_before + p["bytes"]
    table = F.broadcast(spark.createDataFrame(offsets, "part int, rows_before long, bytes_before long, carried long"))
    start = F.when(F.col("start") < 0, F.col("carried")).otherwise(F.col("bytes_before") + F.col("start"))
    own, end = F.col("bytes_before") + F.col("at"), start + F.col("copies") * F.col("size")
    cut = placed.join(table, "part").select("doc_id", "size", "text_crc32", "curve", shard_of(own, start, end, total_bytes, shards).alias("shard"), (F.col("rows_before") + F.col("i")).alias("rank"))
    first = F.broadcast(cut.groupBy("shard").agg(F.min("rank").alias("first")))  # a row per shard
    return cut.join(first, "shard").select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("rank") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """docs as one folder per shard, rows in the order of the curve; doc_id must be unique."""
    placed = shard(docs, shards).select("doc_id", "shard", "slot")
    ordered = docs.join(placed, "doc_id").repartitionByRange(shards * 4, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
