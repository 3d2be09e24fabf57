"""Importance resampling towards a target distribution, on hashed features.

Documents are collapsed by their whole text first. Each distinct text is parted into words once, whose features (runs of 1 to
MOST consecutive words) are kept as numbers of buckets; bucket counts are those of the distinct texts times their copies.
A bucket's gain is the log ratio of its smoothed shares in the target and in the corpus, a text's weight the mean gain of its
features. Weights go back to documents by the text's SHA-256, and only then each document gets its own noise (Gumbel,
drawn from a hash of its id), so that the highest scores are a sample without replacement in proportion to the weights.

Texts are shuffled once, with copies counted before the shuffle; texts with very many copies get their weights by a broadcast of at
most a thousand keys (common.hot_join); ranks come from sorted ranges (common.numbered), so no task orders all rows.
Gains are one array of BUCKETS numbers, whatever the input.

Edge cases: a null or empty text has no features and weight 0; a null id has the hash of the seed alone and comes first among
equal scores; rows with one id and one text are documents of their own, which equal scores rank next to each other; an
empty table, or a target without features, gives smoothed shares of zero counts. Of further columns only the named ones are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MOST, BUCKETS, SEED = 1, 10_000, 2024
MIN_WORDS, PERCENT = 20, 10
WORD_RE = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BREAK_RE = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
SPAN = 4294967296


def words(text: Column) -> Column:
    """Words of a text (null: none): runs of digits, letters and whatever isn't ASCII, with A-Z lower-cased."""
    return F.filter(F.split(C.ascii_lower(F.coalesce(text, F.lit(""))), BREAK_RE), lambda w: w != "")


def features(of: Column, most: int = MOST) -> Column:
    """Buckets of all runs of 1 to `most` words."""
    bucket = lambda s: F.pmod(F.crc32(s), F.lit(BUCKETS)).cast("smallint")

    def runs(n: int) -> Column:
        starts = F.when(F.size(of) >= n, F.sequence(F.lit(1), F.size(of) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(of, i, n), " ")))

    return F.concat(F.transform(of, bucket), *map(runs, range(2, most + 1)))


def collapse(docs: DataFrame, text: str, most: int = MOST) -> DataFrame:
    """digest, copies, n_words, features of every distinct text; written, so that each is parted into words once."""
    whole = docs.select(F.coalesce(text, F.lit("")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    parted = whole.select(F.unhex(F.sha2("text", 256)).alias("digest"), "copies", words(F.col("text")).alias("words"))
    return C.materialise(parted.select("digest", "copies", F.size("words").alias("n_words"), features(F.col("words"), most).alias("features")), "distinct-texts")


def bucket_counts(distinct: DataFrame) -> DataFrame:
    return distinct.select("copies", F.explode("features").alias("bucket")).groupBy("bucket").agg(F.sum("copies").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> Column:
    """The gains of all buckets as one array, from the distinct texts of the two sides."""
    both = F.broadcast(bucket_counts(target).withColumnRenamed("n", "t"))  # at most BUCKETS rows, like the other side
    every = corpus.sparkSession.range(BUCKETS).select(F.col("id").cast("smallint").alias("bucket"))
    counts = every.join(F.broadcast(bucket_counts(corpus).withColumnRenamed("n", "s")), "bucket", "left").join(both, "bucket", "left").na.fill(0)
    rows = counts.select("bucket", "s", "t").collect()  # BUCKETS rows
    s_all, t_all = float(sum(r.s for r in rows)), float(sum(r.t for r in rows))
    ratio = (F.col("t") + 1) * (F.lit(s_all) + BUCKETS) / ((F.col("s") + 1) * (F.lit(t_all) + BUCKETS))
    table = corpus.sparkSession.createDataFrame([(r.bucket, float(r.s), float(r.t)) for r in rows], "bucket int, s double, t double")
    listed = table.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect()
    ordered = [r.gain for r in sorted(listed, key=lambda r: r.bucket)]
    return F.split(F.lit(",".join(map(str, ordered))), ",").cast("array<bigint>")


def weights(distinct: DataFrame, gain: Column) -> DataFrame:
    """distinct with the floored mean gain of a text's features (none: 0)."""
    n = F.size("features").cast("long")
    total = F.aggregate("features", F.lit(0).cast("long"), lambda a, b: a + F.get(gain, b.cast("int")))
    summed = distinct.select("digest", "copies", "n_words", n.alias("n_features"), total.alias("total"))
    mean = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(total - pmod(total, n_features)) div n_features"))
    return summed.select("digest", "copies", "n_words", "n_features", mean.alias("weight"))


def noise(key: Column, seed: int = SEED) -> Column:
    """A thousand times a Gumbel draw, floored, from the hash of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(float(SPAN)))))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, most: int = MOST) -> DataFrame:
    """key, n_features, weight, score, rank of every document; rank is null for those that aren't drawn."""
    distinct = collapse(docs, text, most)
    weighed = C.materialise(weights(distinct, gains(distinct, collapse(target, text, most))), "text-weights")
    keyed = docs.select(F.col(key), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("digest"))
    total = weighed.agg(F.sum("copies")).first()[0] or 0
    met = C.hot_join(keyed, weighed.withColumn("n", F.col("copies")), "digest", "n", total)
    scored = C.materialise(met.select(key, "n_features", "n_words", "weight", (F.col("weight") + noise(F.col(key), seed)).alias("score")), "scores")
    able, rest = scored.where(F.col("n_words") >= min_words), scored.where(F.col("n_words") < min_words)
    drawn = able.count() * percent // 100
    placed = C.numbered(able, [F.desc("score"), F.asc_nulls_first(key), F.asc("n_features")], "place")
    ranked = placed.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")))
    return ranked.unionByName(rest.withColumn("rank", F.lit(None).cast("long")), allowMissingColumns=True).select(key, "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql() -> str:
    from helixframe.functions import duck

    w = f"regexp_extract_all(translate(coalesce(text, ''), '{C.UPPER}', '{C.LOWER}'), '{WORD_RE}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {w} AS w FROM documents),
dw AS (SELECT r, unnest(w) AS w FROM d), tw AS (SELECT unnest({w}) AS w FROM benchmark),
b AS (SELECT w, ({duck.crc32(duck.utf8_bytes("w"))}) % {BUCKETS} AS b FROM (SELECT w FROM dw UNION SELECT w FROM tw)),
s AS (SELECT b, count(*) AS s FROM dw JOIN b USING (w) GROUP BY b), t AS (SELECT b, count(*) AS t FROM tw JOIN b USING (w) GROUP BY b),
g AS (SELECT s.b AS b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {BUCKETS}) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM tw) + {BUCKETS}))))::BIGINT AS g
  FROM s LEFT JOIN t ON s.b = t.b),
f AS (SELECT r, count(*) AS n, sum(g) AS g FROM dw JOIN b USING (w) JOIN g USING (b) GROUP BY r),
x AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(g / n), 0)::BIGINT AS weight,
  ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT AS h FROM d LEFT JOIN f USING (r)),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / {SPAN}::DOUBLE)))::BIGINT AS score, n_features >= {MIN_WORDS} AS able FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place, sum(able::INT) OVER () AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM z
"""


ORACLE_SQL = _sql()
