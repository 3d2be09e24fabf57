"""Mixing sources to target weights by the cube method.

A source's target is its share of a total, with the excess over twice its size reshared by weight. Every document of
a source then has the multiplicity m = target / source size: floor(m) copies are certain, and the rest p = m - floor(m)
is an inclusion probability. The cube method draws the sample: in the flight phase the probabilities of a block of
documents move along the null space of the constraints (sum of p: documents; sum of p * size: tokens) until all but
two are 0 or 1. The few left over of each block fly again together with those of other blocks of their source, and
the landing problem that remains, at most two documents for each LANDING blocks, is settled by the rounding that
lies nearest to the token total.

Draws come from hashes of source rank and block, so reruns agree on any cluster. Blocks hold about BLOCK rows of a
source (by hash of doc_id, and of the row where over BLOCK rows share a doc_id), so a source of any size is spread over
many tasks.
Edge cases: null and empty texts have size 0; the null source comes last; a source of size 0 has target 0 and takes
nothing; repeated rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (3, 1, 2)
#: The mix holds this share of all words; a source at most LIMIT times its own.
SHARE, LIMIT = 1.5, 2.0
BLOCK, LANDING = 2048, 512
SEED = 20260


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: rank (from 0), source, docs, source_size, target.

    The targets solve target = min(LIMIT * size, level * weight) with the total given, the fixed point of
    sharing by weight and resharing what exceeds a limit. Windows run over one row per source.
    """
    by = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("rank", rank).withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.pmod("rank", F.lit(len(WEIGHTS)))))
    by = by.withColumn("cap", F.col("source_size") * F.lit(LIMIT))
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spent, weight = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    by = by.withColumn("level", (F.sum("source_size").over(whole) * F.lit(SHARE) - spent) / weight)
    by = by.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "rank", "level"))).over(whole)["level"])
    return by.select("rank", "source", "docs", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities moved until all but two are 0 or 1, with sum(p) and sum(p * size) kept."""
    p = p.astype(float).tolist()
    size = size.astype(float).tolist()
    eps = 1e-9
    queue = [i for i in range(len(p)) if eps < p[i] < 1 - eps]
    draws, at, live, k = rng.random(len(queue) + 3), 0, queue[:3], 3
    while len(live) == 3:
        a, b, c = live
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p[i]) if x > 0 else p[i]) / abs(x) for i, x in zip(live, u) if x)
        down = min((p[i] if x > 0 else (1 - p[i])) / abs(x) for i, x in zip(live, u) if x)
        step = up if draws[at] < down / (up + down) else -down
        at += 1
        for i, x in zip(live, u):
            p[i] += step * x
            if p[i] < eps:
                p[i] = 0.0
            elif p[i] > 1 - eps:
                p[i] = 1.0
        live = [i for i in live if 0 < p[i] < 1]
        while len(live) < 3 and k < len(queue):
            live.append(queue[k])
            k += 1
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The at most two open probabilities rounded so that the sum of p * size moves least (then their count)."""
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    best = min(product((0.0, 1.0), repeat=len(left)), key=lambda z: (abs(float(((np.array(z) - p[left]) * size[left]).sum())), abs(sum(z) - p[left].sum()), z))
    p[left] = best
    return p


def _fly(pdf: pd.DataFrame, block: str, last: bool) -> pd.DataFrame:
    # large documents fly first, so that those left for the landing are small
    pdf = pdf.sort_values(["size", "order", "p"], ascending=[False, True, True], kind="stable", ignore_index=True)
    seed = [SEED, int(pdf["rank"].iat[0]), int(pdf[block].iat[0]), int(last)]
    p = flight(pdf["p"].to_numpy(), pdf["size"].to_numpy(), np.random.default_rng(seed))
    pdf["p"] = landing(p, pdf["size"].to_numpy(dtype=float)) if last else p
    return pdf


def mix(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, source, size): doc_id, size, source_size, target, copies, and row, a number of its own (that of docs if it has one)."""
    row = F.col("row") if "row" in docs.columns else F.monotonically_increasing_id()
    sizes = C.materialise(docs.select("doc_id", "source", "size", row.alias("row")), "mix-sizes")
    table = C.materialise(targets(sizes), "mix-targets")
    total = table.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    known = C.spread_join(sizes, table.withColumn("n", F.col("docs")), "source", "n", total)
    m = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    order = F.xxhash64("doc_id", F.lit(SEED))
    # rows of an id that fills a block by itself are told apart by their place in the table; there are few such ids
    crowded = sizes.groupBy(F.xxhash64("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    crowded = C.materialise(crowded.select("__id", "n", F.lit(True).alias("__crowded")), "mix-crowded")
    if crowded.isEmpty():
        known = known.withColumn("__crowded", F.lit(None).cast("boolean"))
    else:
        known = C.spread_join(known.withColumn("__id", F.xxhash64("doc_id")), crowded, "__id", "n", total)
    order = F.when(F.col("__crowded"), F.xxhash64("doc_id", "row", F.lit(SEED))).otherwise(order)
    rows = known.withColumn("m", m).select(
        "doc_id",
        "row",
        "size",
        "source_size",
        "target",
        F.floor("m").cast("int").alias("base"),
        (F.col("m") - F.floor("m")).alias("p"),
        order.alias("order"),
        "rank",
        F.pmod(order, F.ceil(F.col("docs") / BLOCK)).cast("long").alias("block"),
    )
    schema = rows.schema
    first = C.materialise(rows.groupBy("rank", "block").applyInPandas(lambda pdf: _fly(pdf, "block", False), schema), "mix-flight")
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    rest = first.where(open_).withColumn("block", F.floor(F.col("block") / LANDING))
    rest = rest.groupBy("rank", "block").applyInPandas(lambda pdf: _fly(pdf, "block", True), schema)
    return first.where(~open_).unionByName(rest).select(
        "doc_id", "size", "source_size", "target", (F.col("base") + F.col("p").cast("int")).alias("copies"), "row"
    )


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(C.WORD_RE)).cast("long").alias("size"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: every document as often as the mix takes it, with the columns of docs.

    Rows are written with a number each, by which their copies come back: one rule for groups of equal rows of any size, and
    a task that runs again deals the same copies. Texts are shuffled once.
    """
    row, times, copy = (C.fresh(docs.columns, x) for x in ("_row", "_times", "_copy"))
    rows = C.materialise(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(C.WORD_RE)).cast("long")
    taken = mix(rows.select(F.xxhash64("doc_id", "source", "text").alias("doc_id"), "source", size.alias("size"), F.col(row).alias("row")))
    taken = taken.where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(times))
    return rows.join(taken, row).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).drop(copy)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mix(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
