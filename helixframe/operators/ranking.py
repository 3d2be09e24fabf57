"""Magic sniffing, compression candidates, ranking, deduplication and metric tables."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import duck as Q
from ..sources.tables import table

# Fixed values: (kind, extension, MIME type, confidence, hexadecimal prefix), first match wins.
SIGNATURES = [
    ("pdf", ".pdf", "application/pdf", 0.97, "255044462D"),
    ("gzip", ".gz", "application/gzip", 0.99, "1F8B"),
    ("png", ".png", "image/png", 0.99, "89504E470D0A1A0A"),
    ("jpeg", ".jpg", "image/jpeg", 0.98, "FFD8FF"),
    ("gif", ".gif", "image/gif", 0.98, "474946383761"),
    ("gif", ".gif", "image/gif", 0.98, "474946383961"),
    ("bmp", ".bmp", "image/bmp", 0.85, "424D"),
    ("tiff", ".tif", "image/tiff", 0.90, "49492A00"),
    ("tiff", ".tif", "image/tiff", 0.90, "4D4D002A"),
    ("webp", ".webp", "image/webp", 0.98, "52494646........57454250"),
    ("wav", ".wav", "audio/wav", 0.98, "52494646........57415645"),
    ("avi", ".avi", "video/x-msvideo", 0.85, "52494646........41564920"),
    ("mp3", ".mp3", "audio/mpeg", 0.85, "494433"),
    ("mp3", ".mp3", "audio/mpeg", 0.65, "FF[EF]."),
    ("ogg", ".ogg", "application/ogg", 0.90, "4F676753"),
    ("flac", ".flac", "audio/flac", 0.99, "664C6143"),
    ("mp4", ".mp4", "video/mp4", 0.92, "........66747970........"),
    ("mkv_webm", ".mkv", "video/x-matroska", 0.60, "1A45DFA3"),
    ("zip", ".zip", "application/zip", 0.99, "504B0304"),
    ("zip", ".zip", "application/zip", 0.99, "504B0506"),
    ("zip", ".zip", "application/zip", 0.99, "504B0708"),
]
DOMAINS = {
    "image": ["png", "jpeg", "gif", "bmp", "tiff", "webp"],
    "audio": ["wav", "mp3", "ogg", "opus_ogg", "flac"],
    "video": ["avi", "mp4", "mkv_webm"],
    "text": ["text", "pdf", "docx", "pptx", "xlsx", "epub"],
    "archive": ["zip", "gzip"],
}
#: Heads that the sniffing query puts before the pages' bytes, among them none.
HEADS = ["", *[s[4].replace("[EF].", "E0").replace(".", "0") for s in SIGNATURES]]


def magic(payload: Column) -> Column:
    """Struct kind, ext, mime, confidence; null under four bytes and for what is no known kind.

    Text: the first 4096 bytes decode and over 95 % of their characters print.
    """
    head = F.hex(F.substring(payload, 1, 64))
    info = lambda kind, ext, mime, conf: F.struct(F.lit(kind).alias("kind"), F.lit(ext).alias("ext"), F.lit(mime).alias("mime"), F.lit(conf).alias("confidence"))
    start = F.substring(payload, 1, 4096)
    text = F.try_validate_utf8(start.cast("string"))
    unprinted = F.regexp_count(text, F.lit("(?![\\r\\n\\t ])[\\p{C}\\p{Z}]"))
    out = F.when(text.isNotNull() & ((F.length(text) - unprinted) / F.greatest(F.length(text), F.lit(1)) > 0.95), info("text", ".txt", "text/plain", 0.60))
    for kind, ext, mime, conf, prefix in reversed(SIGNATURES):
        out = F.when(head.rlike("^" + prefix), info(kind, ext, mime, conf)).otherwise(out)
        if kind == "ogg":
            out = F.when(head.rlike("^" + prefix) & F.hex(start).contains("4F70757348656164"), info("opus_ogg", ".ogg", "audio/ogg", 0.95)).otherwise(out)
    return F.when(F.octet_length(payload) >= 4, out)


def domain(kind: Column) -> Column:
    out = F.lit("unknown")
    for name, kinds in DOMAINS.items():
        out = F.when(kind.isin(*kinds), name).otherwise(out)
    return out


def magic_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages behind every known head, sniffed."""
    p = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("html"))
    heads = F.explode(F.array(*[F.lit(h) for h in HEADS]))
    df = p.select("page_id", "html", heads.alias("head")).select("page_id", F.concat(F.unhex("head"), "html").alias("payload"))
    df = df.select(F.octet_length("payload").alias("bytes"), magic(F.col("payload")).alias("m"))
    return df.groupBy(F.coalesce("m.kind", F.lit("none")).alias("kind"), F.col("m.mime").alias("mime"), domain(F.col("m.kind")).alias("domain")).agg(F.count(F.lit(1)).alias("payloads"), F.sum("bytes").alias("bytes"))


_KIND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(h, '^{prefix}') THEN '{kind}'" for kind, _, _, _, prefix in SIGNATURES)
_MIME_SQL = "CASE kind WHEN 'text' THEN 'text/plain' " + " ".join(f"WHEN '{k}' THEN '{m}'" for k, m in {s[0]: s[2] for s in SIGNATURES}.items()) + " END"
_DOMAIN_SQL = "CASE " + " ".join(f"WHEN kind IN ({str(kinds)[1:-1]}) THEN '{name}'" for name, kinds in DOMAINS.items()) + " ELSE 'unknown' END"
# Only the empty head leaves text at the front; pages hold no Opus head.
MAGIC_KINDS_SQL = f"""WITH p AS (SELECT html, unnest({HEADS}) AS head FROM pages WHERE html IS NOT NULL),
t AS (SELECT head || hex(encode(html)) AS h, CASE WHEN head = '' THEN TRY(decode(array_slice(encode(html), 1, 4096))) END AS s FROM p),
k AS (SELECT length(h) // 2 AS bytes, CASE WHEN length(h) < 8 THEN 'none' ELSE {_KIND_SQL} WHEN s IS NULL THEN 'none'
  WHEN len(regexp_extract_all(regexp_replace(s, '[\\r\\n\\t ]', '', 'g'), '[\\pC\\pZ]')) / greatest(length(s), 1) < 0.05 THEN 'text' ELSE 'none' END END AS kind FROM t)
SELECT kind, {_MIME_SQL} AS mime, {_DOMAIN_SQL} AS domain, count(*) AS payloads, sum(bytes)::BIGINT AS bytes FROM k GROUP BY ALL"""


def magic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by sniffed kind."""
    d = table(spark, sf_dir, "documents").select("lang", magic(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("m"))
    return d.groupBy("lang", F.coalesce("m.kind", F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("docs"))


MAGIC_TEXT_SQL = """WITH t AS (SELECT lang, text, lower(hex(encode(text))) AS h, TRY(decode(array_slice(encode(text), 1, 4096))) AS s FROM documents)
SELECT lang, CASE WHEN strlen(text) < 4 THEN 'none' WHEN starts_with(h, '255044462d') THEN 'pdf' WHEN starts_with(h, '424d') THEN 'bmp' WHEN s IS NULL THEN 'none'
WHEN len(regexp_extract_all(regexp_replace(s, '[\\r\\n\\t ]', '', 'g'), '[\\pC\\pZ]')) / greatest(length(s), 1) < 0.05 THEN 'text' ELSE 'none' END AS kind, count(*) AS docs FROM t GROUP BY ALL"""


def _zip(data: bytes, method: int, level: int | None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method, compresslevel=level) as z:
        z.writestr(zipfile.ZipInfo("payload"), data, compress_type=method, compresslevel=level)
    return out.getvalue()


METHODS = {
    **{f"gzip_{n}": (lambda d, n=n: gzip.compress(d, n, mtime=0), "gzip") for n in (1, 6, 9)},
    **{f"bz2_{n}": (lambda d, n=n: bz2.compress(d, n), None) for n in (1, 6, 9)},
    **{f"xz_{n}": (lambda d, n=n: lzma.compress(d, preset=n), None) for n in (0, 6, 9)},
    "zip_store": (lambda d: _zip(d, zipfile.ZIP_STORED, None), "zip"),
    **{f"zip_deflate_{n}": (lambda d, n=n: _zip(d, zipfile.ZIP_DEFLATED, n), "zip") for n in (1, 6, 9)},
}


def compression_candidates(df: DataFrame, key: str, payload: str) -> DataFrame:
    """key, method, kind, size_bytes, compression_ratio, saving_pct, estimated_nt, rank of every method that sniffing
    knows again (bz2 and xz have no signature, so they are tried and dropped), the smallest first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, m, kind, len(p), len(f(bytes(p)))) for k, p in zip(pdf[key], pdf[payload]) for m, (f, kind) in METHODS.items()]
            yield pd.DataFrame(rows, columns=[key, "method", "kind", "original", "size_bytes"])

    made = df.select(key, payload).mapInPandas(run, f"{key} long, method string, kind string, original long, size_bytes long").where("kind IS NOT NULL")
    return ranked(made, key)


def ranked(rows: DataFrame, key: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy("size_bytes", "method")
    return rows.select(
        "*",
        F.round(F.col("original") / F.greatest("size_bytes", F.lit(1)), 6).alias("compression_ratio"),
        F.round((1 - F.col("size_bytes") / F.greatest("original", F.lit(1))) * 100, 4).alias("saving_pct"),
        (F.col("size_bytes") * 4).alias("estimated_nt"),
        F.row_number().over(order).alias("rank"),
    )


def zlib_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("payload"))
    return compression_candidates(b, "item_id", "payload")


def zlib_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's size under zlib level 6, and whether it inflates again before trailing bytes."""

    @F.pandas_udf("size_bytes int, same boolean, tail_same boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            raw = (t or "").encode()
            packed = zlib.compress(raw, 6)
            tail = zlib.decompressobj()
            rows.append((len(packed), zlib.decompress(packed) == raw, tail.decompress(packed + b"tail") == raw and tail.eof))
        return pd.DataFrame(rows, columns=["size_bytes", "same", "tail_same"])

    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("original"), run("text").alias("z"))
    return d.select("doc_id", "original", "z.*")


def candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as candidates of their order: the smallest first, equal (flag, status, quantity) once, ranks from 1."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("_", "l_returnflag", "l_linestatus").alias("method"), F.col("l_quantity").cast("int").alias("size_bytes"))
    first = F.row_number().over(Window.partitionBy("l_orderkey", "method", "size_bytes").orderBy("l_linenumber"))
    kept = li.withColumn("k", first).where("k = 1").drop("k")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("size_bytes", "method", "l_linenumber")))


RANK_SQL = """WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag || '_' || l_linestatus AS method, l_quantity::INT AS size_bytes FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, method, size_bytes ORDER BY l_linenumber) AS k FROM c)
SELECT l_orderkey, l_linenumber, method, size_bytes, row_number() OVER (PARTITION BY l_orderkey ORDER BY size_bytes, method, l_linenumber)::INT AS rank FROM k WHERE k = 1"""


def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_rank(spark, sf_dir).where("rank = 1").drop("rank")


def score_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each segment scored by min-max normalised columns weighted .45, .35 and .20; the best of each."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"), F.count(F.lit(1)).alias("orders"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"))
    bounds = c.groupBy("c_mktsegment").agg(*[f(x).alias(f"{n}_{x}") for x in ("spent", "orders", "c_acctbal") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    norm = lambda x: F.when(F.col(f"hi_{x}") > F.col(f"lo_{x}"), (F.col(x) - F.col(f"lo_{x}")) / F.nullif(F.col(f"hi_{x}") - F.col(f"lo_{x}"), F.lit(0.0))).otherwise(1.0)
    scored = c.join(bounds, "c_mktsegment").withColumn("score", F.round(0.45 * norm("spent") + 0.35 * norm("orders") + 0.20 * norm("c_acctbal"), 6))
    best = scored.groupBy("c_mktsegment").agg(F.max(F.struct("score", (-F.col("c_custkey")).alias("k"))).alias("b"))
    return best.select("c_mktsegment", (-F.col("b.k")).alias("c_custkey"), "b.score")


SCORE_SQL = """WITH o AS (SELECT o_custkey, sum(o_totalprice) AS spent, count(*) AS orders FROM orders GROUP BY o_custkey), c AS (SELECT * FROM customer JOIN o ON c_custkey = o_custkey),
n AS (SELECT c_mktsegment, c_custkey, min(spent) OVER w AS a, max(spent) OVER w AS b, min(orders) OVER w AS d, max(orders) OVER w AS e, min(c_acctbal) OVER w AS f, max(c_acctbal) OVER w AS g, spent, orders, c_acctbal FROM c WINDOW w AS (PARTITION BY c_mktsegment)),
s AS (SELECT c_mktsegment, c_custkey, round(0.45 * (CASE WHEN b > a THEN (spent - a) / (b - a) ELSE 1.0 END) + 0.35 * (CASE WHEN e > d THEN (orders - d) / (e - d) ELSE 1.0 END) + 0.20 * (CASE WHEN g > f THEN (c_acctbal - f) / (g - f) ELSE 1.0 END), 6) AS score FROM n)
SELECT c_mktsegment, c_custkey, score FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY score DESC, c_custkey) AS k FROM s) WHERE k = 1"""


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tall metric rows of the events: section, property, value as text."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.max("value"), 4).alias("top"))
    return e.select(F.col("event_type").alias("section"), F.expr("stack(3, 'count', format_string('%d items', n), 'mean', format_string('%.4f dB', mean), 'top', format_string('%.4f %%', top)) as (property, value)"))


METRIC_SQL = """WITH e AS (SELECT event_type AS section, count(*) AS n, round(avg(value), 4) AS mean, round(max(value), 4) AS top FROM events GROUP BY 1)
SELECT section, 'count' AS property, printf('%d items', n) AS value FROM e UNION ALL SELECT section, 'mean', printf('%.4f dB', mean) FROM e UNION ALL SELECT section, 'top', printf('%.4f %%', top) FROM e"""


def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tall rows as wide columns, with the number that a metric's text begins with."""
    n = F.try_to_number(F.regexp_extract("value", "^-?[0-9]+", 0), F.lit("999999999")).cast("long")
    whole = metric_rows(spark, sf_dir).withColumn("number", n)
    pick = lambda p: F.max(F.when(F.col("property") == p, F.col("number"))).alias(f"{p}_whole")
    return whole.groupBy("section").agg(pick("count"), pick("mean"), pick("top"))


PIVOT_SQL = f"""WITH m AS ({METRIC_SQL}), n AS (SELECT section, property, regexp_extract(value, '^-?[0-9]+')::BIGINT AS number FROM m)
SELECT section, max(number) FILTER (property = 'count') AS count_whole, max(number) FILTER (property = 'mean') AS mean_whole, max(number) FILTER (property = 'top') AS top_whole FROM n GROUP BY section"""


def bit_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte accuracy and bit error rate between consecutive turns, the gap in length counted in full."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    from ..functions import dna as D

    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode("text", "UTF-8").alias("a"), F.encode(F.lead("text").over(w), "UTF-8").alias("b")).where("b IS NOT NULL")
    t = t.select("conv_id", "turn", D.bits(F.col("a")).alias("a"), D.bits(F.col("b")).alias("b"))
    same = F.aggregate(F.zip_with(F.split("a", ""), F.split("b", ""), lambda x, y: F.when((x == y) & (x != ""), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    n = F.greatest(F.length("a"), F.length("b"))
    return t.select("conv_id", "turn", n.alias("bits"), (n - same).alias("errors"), F.round((n - same) / n, 6).alias("bit_error_rate"))


BIT_SQL = f"""WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations), b AS (SELECT conv_id, turn, {Q.bits("text")} AS a, {Q.bits("nx")} AS b FROM t WHERE nx IS NOT NULL),
e AS (SELECT conv_id, turn, greatest(length(a), length(b)) AS n, hamming(substr(a, 1, least(length(a), length(b))), substr(b, 1, least(length(a), length(b)))) + abs(length(a) - length(b)) AS errors FROM b)
SELECT conv_id, turn, n::INT AS bits, errors::INT AS errors, round(errors / n, 6) AS bit_error_rate FROM e"""

QUERIES = {
    "magic_kinds": (magic_kinds, MAGIC_KINDS_SQL),
    "magic_kind_counts": (magic_text, MAGIC_TEXT_SQL),
    "compression_candidates": (zlib_candidates, None),
    "zlib_sizes": (zlib_sizes, None),
    "candidate_rank_dedupe": (candidate_rank, RANK_SQL),
    "candidate_best": (best_candidate, f"SELECT l_orderkey, l_linenumber, method, size_bytes FROM ({RANK_SQL}) WHERE rank = 1"),
    "score_minmax_best": (score_best, SCORE_SQL),
    "metric_rows": (metric_rows, METRIC_SQL),
    "metric_pivot": (metric_pivot, PIVOT_SQL),
    "bit_error_rate": (bit_errors, BIT_SQL),
}
