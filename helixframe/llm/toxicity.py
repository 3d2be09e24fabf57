"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are its distinct n-grams of N_GRAMS characters (ASCII lower-cased, white space as one space, ends marked by spaces), hashed
to SLOTS. Each is scaled by r = ln of the ratio of its smoothed share among toxic and other training texts, where
these shares differ by over MIN_Z standard errors (else r = 0), and a logistic regression with an L2 penalty is
fitted on the scaled features. Only the text enters a score.

The fit reads a bounded sample of labelled rows: the first MAX_TOXIC toxic and MAX_OTHER others in the order of a
hash of doc_id, in one task; the weights (at most SLOTS) reach the executors by broadcast. Every text is scored whole.
Edge cases: null and empty texts score the intercept; rows with null labels are not learnt from; several labels of a
document count as toxic if one says so; without both labels the score is the smoothed share of toxic labels; repeated
rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

N_GRAMS = (4, 5, 6, 9)
SLOTS = 1 << 20
MAX_TOXIC, MAX_OTHER = 2000, 4000
SMOOTH, MIN_Z, L2, RATE, EPOCHS = 0.5, 4.0, 1e-3, 0.1, 10
#: N-grams of fewer training texts than this have no weight.
MIN_TEXTS = 3
SEED = 6
#: Characters of a text hashed at a time.
PART = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def slots(text: str | None) -> np.ndarray:
    """The distinct slots of the text's n-grams; a long text is hashed in parts of PART characters, each with what its last n-grams need."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not raw:
        return np.zeros(0, dtype=np.int64)
    whole = np.frombuffer((b" " + b" ".join(raw) + b" ").decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    distinct = []
    for at in range(0, len(whole), PART):
        b = whole[at : at + PART + max(N_GRAMS) - 1].astype(np.uint64)
        found, h, done = [], np.zeros(len(b), dtype=np.uint64), 0
        for n in N_GRAMS:
            for k in range(done, n):
                h = h[: max(0, len(b) - k)] * np.uint64(257) + b[k:]
            done = n
            found.append((h[:PART] * _FACTOR + np.uint64(n)) * _FACTOR >> np.uint64(64 - 20))
        distinct.append(np.unique(np.concatenate(found)))
    return (distinct[0] if len(distinct) == 1 else np.unique(np.concatenate(distinct))).astype(np.int64)


def fit(texts: list[str | None], labels: list[int]) -> tuple[np.ndarray, float]:
    """Weight per slot and intercept."""
    y = np.array(labels, dtype=float)
    weights, prior = np.zeros(SLOTS, dtype=np.float32), (y.sum() + SMOOTH) / (len(y) + 2 * SMOOTH)
    intercept = float(np.log(prior / (1 - prior)))
    if y.sum() in (0, len(y)):
        return weights, intercept
    toxic, other, n_toxic, n_other = np.zeros(SLOTS), np.zeros(SLOTS), y.sum(), len(y) - y.sum()
    for text, label in zip(texts, y):
        (toxic if label else other)[slots(text)] += 1
    share = (toxic + other) / len(y)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_toxic + 1 / n_other))
    chosen = (np.abs(toxic / n_toxic - other / n_other) > MIN_Z * error) & (toxic + other >= MIN_TEXTS)
    ratio = np.where(chosen, np.log((toxic + SMOOTH) / (n_toxic + 2 * SMOOTH)) - np.log((other + SMOOTH) / (n_other + 2 * SMOOTH)), 0.0)
    rows = [found[chosen[found]] for found in map(slots, texts)]  # made again, to hold few at a time
    w, square, b_square, rng = np.zeros(SLOTS), np.ones(SLOTS), 1.0, np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            row = rows[i]
            r = ratio[row]
            miss = 1 / (1 + np.exp(-np.clip(intercept + w[row] @ r, -30, 30))) - y[i]
            g = miss * r + L2 * w[row]
            square[row] += g * g
            w[row] -= RATE * g / np.sqrt(square[row])
            b_square += miss * miss
            intercept -= RATE * miss / np.sqrt(b_square)
    weights[:] = w * ratio
    return weights, float(intercept)


def score_texts(texts: list[str | None], weights: np.ndarray, intercept: float) -> np.ndarray:
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        found = slots(text)
        found = found[weights[found] != 0]
        out[i] = intercept + float(weights[found].sum(dtype=np.float64))
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of doc_id as text (null: empty) modulo m."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of the rows to learn from: labels (doc_id, toxic) joined to docs by broadcast of the bounded sample."""
    by_doc = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = by_doc.where("toxic > 0").orderBy(*order).limit(MAX_TOXIC).unionByName(by_doc.where("toxic <= 0").orderBy(*order).limit(MAX_OTHER))
    # a doc_id that many rows share still gives a bounded sample
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return joined.groupBy("doc_id").agg(F.max_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))


def train(rows: DataFrame) -> tuple[np.ndarray, float]:
    """fit() over rows (doc_id, text, toxic) in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, labels, ids = [], [], []
        for pdf in batches:
            texts += pdf["text"].tolist()
            labels += (pdf["toxic"] > 0).astype(int).tolist()
            ids += pdf["doc_id"].tolist()
        order = np.argsort(np.array(ids, dtype=np.int64), kind="stable") if ids else []
        weights, intercept = fit([texts[i] for i in order], [labels[i] for i in order])
        at = np.flatnonzero(weights).tolist()
        yield pd.DataFrame({"slot": [-1, *at], "weight": [intercept, *weights[at].astype(float)]})

    weights, intercept = np.zeros(SLOTS, dtype=np.float32), 0.0
    found = rows.select("doc_id", "text", "toxic").coalesce(1).mapInPandas(run, "slot long, weight double").toPandas()
    if len(found):
        intercept = float(found.loc[found["slot"] == -1, "weight"].iat[0])
        found = found[found["slot"] >= 0]
        weights[found["slot"].to_numpy()] = found["weight"].to_numpy()
    return weights, intercept


def with_scores(docs: DataFrame, weights: np.ndarray, intercept: float, text: str = "text") -> DataFrame:
    """docs with `score` and `predicted`."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, intercept))

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(texts.tolist(), *shared.value))

    C.small_batches(docs.sparkSession)
    return docs.withColumn("score", run(F.col(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(remainder(F.col("doc_id"), 5) != 0)
    model = train(sample(docs, labels))
    scored = with_scores(docs, *model)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
