"""Document fingerprints by consistent weighted sampling.

Terms are five-word shingles (a text of fewer words is one term) and weigh as often as they occur. In each of SAMPLES
samples every term of weight w makes a bid, and the lowest bid is the sample; a term bids with
a = c / (y e^r), y = e^(r (t - b)), t = floor(ln w / r + b), where r and c are drawn from Gamma(2, 1) and b evenly, by term
and sample alone. Two texts then have the same sample (the term and its t) with the probability of their generalised
Jaccard similarity, whatever the weights, and the share of equal samples estimates it with an error of 1/sqrt(SAMPLES).

The draws are made in another order, which leaves their joint distribution as it is: the bid at weight 1, a1 = c e^(r (b - 1)),
is exponential, so it comes first, from one hash; given it, z = e^(r (1 - b)) is 1 plus an exponential of rate a1, and
y = e^(-r b) is even, which gives r = ln(z / y) and c = a1 z. A term of weight 1 needs its first draw only, and draws
are compared as they are hashed, without a logarithm; heavier terms need all three: a = a1 e^(-r t).

Only DataFrame functions. Terms are rows within a partition and the samples are minima by document, so partial
aggregation leaves one row a document before any shuffle, however long or repetitive a text is.
Edge cases: null and empty texts have the empty fingerprint; two empty fingerprints have likeness 1, an empty and
another one 0; equal texts have equal fingerprints; rows of one doc_id follow each other by the hash of text and row
(null ids come last); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 5
#: Fewer than the columns that Spark generates code for at once.
SAMPLES = 64
#: A sample in a signature: so many bits of its bid, six hexadecimal digits.
KEPT = 24
#: Bids are numbers of 63 bits; those of heavier terms have HEAVY bits of the bid and the others of their identity.
HEAVY = 40
#: Ids are cut into SEGMENTS ranges of as many rows, and these evenly into buckets of about ROWS_A_BUCKET rows.
SEGMENTS, ROWS_A_BUCKET = 1024, 1000


def terms(text: Column) -> Column:
    """Array of structs of a shingle's hash and weight; empty without words."""

    def hashes(w: Column) -> Column:
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) <= SHINGLE, F.array(F.xxhash64(w))).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))
        )

    def runs(s: Column) -> Column:
        """Of sorted hashes: each once, with its number."""
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i).otherwise(F.lit(-1))), lambda i: i >= 0)
        return C.let(starts, lambda e: F.transform(e, lambda i, j: F.struct(F.get(s, i).alias("x"), (F.coalesce(F.get(e, j + 1), F.size(s)) - i).alias("w"))))

    def weighted(h: Column) -> Column:
        once = F.size(F.array_distinct(h)) == F.size(h)
        return F.when(once, F.transform(h, lambda x: F.struct(x.alias("x"), F.lit(1).alias("w")))).otherwise(C.let(F.sort_array(h), runs))

    return C.let(C.let(C.words(text), hashes), weighted)


def first_draw(own: Column) -> Column:
    """The bid at weight 1 of a term and sample (their common hash) as a number of 63 bits, whose order is that of bids."""
    return F.shiftrightunsigned(F.xxhash64(own), 1)


def own_hash(x: Column, sample: Column) -> Column:
    return x.bitwiseXOR(F.xxhash64(sample.cast("int")))


def heavy_bid(x: Column, w: Column, sample: Column) -> Column:
    """The bid of a term x of any weight w, as a number whose order is that of bids and which tells samples apart."""
    own = own_hash(x, sample)
    first, more = first_draw(own), F.xxhash64(own, F.lit(1))
    even = lambda bits: (bits.cast("double") + 0.5) / float(1 << 32)
    a1 = -F.log1p(-(first.cast("double") + 0.5) / float(1 << 63))
    z = 1 - F.log(even(F.shiftrightunsigned(more, 32))) / a1
    y = even(more.bitwiseAND(F.lit((1 << 32) - 1)))
    r = F.log(z / y)
    t = F.floor(F.log(w.cast("double") / y) / r)
    high = F.floor(-F.expm1(-a1 * F.exp(-r * t)) * float(1 << HEAVY))
    low = F.xxhash64(own, t).bitwiseAND(F.lit((1 << (63 - HEAVY)) - 1))
    return F.when(t == 0, first).otherwise(F.shiftleft(high, 63 - HEAVY).bitwiseOR(low))


def signatures(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys (which tell the rows of df apart) and `signature`, an array of SAMPLES numbers, empty for a text without words.

    A term of weight 1 is one row, which bids in every sample; a heavier one is a row a sample.
    """
    rows = df.select(*keys, F.explode_outer(terms(F.coalesce(F.col(text), F.lit("")))).alias("__e")).select(*keys, F.col("__e.x").alias("__x"), F.col("__e.w").alias("__w"))
    every = F.when(F.col("__w") > 1, F.sequence(F.lit(0), F.lit(SAMPLES - 1))).otherwise(F.array(F.lit(-1)))
    rows = rows.select(*keys, "__x", "__w", F.explode(every).alias("__j"))
    rows = rows.select(*keys, "__x", "__j", F.when(F.col("__j") >= 0, heavy_bid(F.col("__x"), F.col("__w"), F.col("__j"))).alias("__v"))
    bids = [F.when(F.col("__j") < 0, first_draw(own_hash(F.col("__x"), F.lit(k)))).when(F.col("__j") == k, F.col("__v")) for k in range(SAMPLES)]
    least = rows.groupBy(*keys).agg(*[F.min(b).alias(f"__{k}") for k, b in enumerate(bids)], F.max("__x").alias("__x"))
    kept = F.array(*[F.col(f"__{k}").bitwiseAND(F.lit((1 << KEPT) - 1)).cast("int") for k in range(SAMPLES)])
    return least.select(*keys, F.when(F.col("__x").isNull(), F.array().cast("array<int>")).otherwise(kept).alias("signature"))


def fingerprint(sig: Column) -> Column:
    """The signature as text: six hexadecimal digits a sample."""
    return F.lower(F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), KEPT // 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, e: n + e)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same / F.lit(float(SAMPLES)))


def document_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `fingerprint` (string) and `signature` (array); columns of these names are replaced.

    Distinct texts (by their SHA-256) are signed once and joined back, common ones by broadcast.
    """
    kept = [c for c in docs.columns if c not in ("signature", "fingerprint")]
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("__sha")
    distinct = docs.groupBy(sha).agg(F.count(F.lit(1)).alias("__n"), F.first(text).alias("__text"))
    signed = C.materialise(signatures(distinct, ["__sha", "__n"], "__text"), "signatures")
    total = signed.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    joined = C.hot_join(docs.select(*kept, sha), signed, "__sha", "__n", total)
    return joined.select(*kept, "signature", fingerprint(F.col("signature")).alias("fingerprint"))


def _bucketed(rows: DataFrame) -> DataFrame:
    """rows (doc_id, ...) with `segment` and `bucket` (null lowest), which grow with doc_id, and `at`, the order among equal ids.

    Segments are quantiles of doc_id, at most SEGMENTS; each is cut evenly by value, or, where one id fills it (or id is
    null), by `at`. The driver gets one row.
    """
    x = F.col("doc_id").cast("long")
    at = rows.agg(F.count("doc_id").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.percentile_approx("doc_id", [i / SEGMENTS for i in range(SEGMENTS)], F.lit(10_000)).alias("q"), F.max("doc_id").alias("hi")).first()
    # fewer segments for fewer rows
    quantiles = (at["q"] or [0])[:: max(1, SEGMENTS * ROWS_A_BUCKET // max(1, at["n"] or 0))] or [0]
    bounds = sorted({*quantiles})
    hot = {b for b in bounds if quantiles.count(b) > 1}  # ids that fill a segment by themselves
    bounds = sorted({*bounds, *[b + 1 for b in hot]})
    share = max(1, round((at["n"] or 0) / len(quantiles) / ROWS_A_BUCKET))
    cuts = [share * max(1, quantiles.count(b)) for b in bounds]
    first, total = [], max(1, round(at["nulls"] / ROWS_A_BUCKET))
    nulls = total
    for c in cuts:
        first.append(total)
        total += c
    width = [max(1.0, (b - a) / c) for a, b, c in zip(bounds, [*bounds[1:], (at["hi"] or 0) + 1], cuts)]
    table = lambda values, kind: F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")  # noqa: E731  # one literal, once folded
    lower = table(bounds, "bigint")
    # the number of bounds up to x, by halving
    seg = F.lit(-1)
    step = 1 << max(0, (len(bounds) - 1).bit_length())
    halve = lambda step: lambda s: F.when(F.coalesce(F.get(lower, s + step) <= x, F.lit(False)), s + step).otherwise(s)
    while step:
        seg = C.let(seg, halve(step))
        step //= 2
    even = F.shiftrightunsigned("at", 11).cast("double") / float(1 << 53)
    place = lambda s: F.when(F.get(table([b in hot for b in bounds], "boolean"), s), even * F.get(table(cuts, "int"), s)).otherwise((x - F.get(lower, s)) / F.get(table(width, "double"), s))
    within = lambda s: F.least(F.get(table(cuts, "int"), s) - 1, F.greatest(F.lit(0), F.floor(place(s)).cast("int"))) + F.get(table(first, "int"), s)
    rows = rows.withColumn("segment", F.when(x.isNull(), -1).otherwise(F.greatest(seg, F.lit(0))))
    bucket = F.when(x.isNull(), F.floor(even * nulls).cast("int")).otherwise(within(F.col("segment")))
    return rows.withColumn("bucket", bucket)


def with_next(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (bucket, rank, doc_id, text) with next_text, that of the next row in descending doc_id (the first row's after
    the last), and by bucket the signature `head` of the row after its last one.

    Rows are ordered within buckets of about ROWS_A_BUCKET rows; a bucket's last row takes the first row of the next
    bucket in use, from a table of one row a bucket, which is ordered within segments.
    """
    at = F.xxhash64(F.xxhash64("text"), F.monotonically_increasing_id())
    rows = _bucketed(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), at.alias("at")))
    high = F.shiftrightunsigned("at", 1)  # order without regard to the sign
    key = F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"), high, F.col("at"))
    heads = C.materialise(rows.groupBy("segment", "bucket").agg(F.max_by("text", key).alias("head_text")), "bucket-heads")
    ids = heads.select("segment", "bucket")
    # one row a segment, so at most SEGMENTS of them and a few
    falling = Window.orderBy(F.desc("segment"))
    tops = ids.groupBy("segment").agg(F.max("bucket").alias("top"))
    tops = tops.select("segment", F.coalesce(F.lead("top").over(falling), F.first("top").over(falling)).alias("top"))
    following = ids.withColumn("following", F.lead("bucket").over(Window.partitionBy("segment").orderBy(F.desc("bucket"))))
    following = following.join(F.broadcast(tops), "segment").select("bucket", F.coalesce("following", "top").alias("following"))
    signed = signatures(heads, ["bucket"], "head_text").withColumnsRenamed({"bucket": "following", "signature": "head"})
    texts = heads.select(F.col("bucket").alias("following"), "head_text")
    within = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), high.desc(), F.col("at").desc())
    rows = rows.drop("segment").withColumns({"rank": F.row_number().over(within), "later": F.lead("text").over(within)})
    rows = rows.join(following.join(texts, "following"), "bucket")
    return rows.select("bucket", "rank", "doc_id", "text", F.coalesce("later", "head_text").alias("next_text")), following.join(signed, "following").drop("following")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows, heads = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("bucket", "rank", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    both = F.array(*[F.struct(F.lit(i).alias("which"), F.col(c).alias("text")) for i, c in enumerate(("text", "edited"))])
    keys = ["bucket", "rank", "doc_id", "n_chars", "edited_sha256", "which"]
    signed = signatures(rows.select(*keys[:4], F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), F.inline(both)), keys)
    order = Window.partitionBy("bucket").orderBy("rank", "which")
    signed = signed.withColumns({"edited": F.lead("signature", 1).over(order), "next": F.lead("signature", 2).over(order)}).where("which = 0")
    signed = signed.join(heads, "bucket").withColumn("next", F.coalesce("next", "head"))
    return signed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("signature")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next")).alias("near_next"),
    )
