"""Whole dataflows: payload to strands to reads and back, and text codecs against channel errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna as D
from ..functions import duck as Q
from ..operators import noise as N
from ..operators import strands as S
from ..sources.scratch import written
from ..sources.tables import table


def read_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts: strands, reads, clusters by index, consensus, payload again; byte accuracy of each."""
    texts = table(spark, sf_dir, "benchmark").select("item_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
    templates = written(S.strands(texts.select("item_id", D.simple(F.col("payload")).alias("dna"))), "templates")
    read = written(N.reads(templates, ["item_id", "no"]), "reads")
    clustered = written(N.nearest_prefix(read.select("item_id", "no", "copy_no", "seq"), templates, "item_id").where("assigned IS NOT NULL"), "clusters")
    made = N.consensus(clustered.select("item_id", F.col("assigned").alias("no"), "seq"), templates, ["item_id", "no"])
    joined = made.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("strands_read"),
        F.sum("payload_mismatches").alias("payload_mismatches"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "reconstructed_payload"))), lambda x: x["reconstructed_payload"]), "").alias("dna"),
    )
    decoded = joined.withColumn("decoded", D.unsimple(F.col("dna"))).join(texts, "item_id")
    a, b = F.hex("payload"), F.coalesce(F.hex("decoded"), F.lit(""))
    pairs = lambda h: F.regexp_extract_all(h, F.lit("[0-9A-F]{2}"), F.lit(0))
    same = F.aggregate(F.zip_with(pairs(a), pairs(b), lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    n = F.greatest(F.length(a), F.length(b)) / 2
    return decoded.select("item_id", "strands_read", "payload_mismatches", F.round(F.when(n == 0, 1.0).otherwise(same / n), 6).alias("byte_accuracy"))


RATES = (0.01, 0.02, 0.05, 0.10)


def text_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text at each substitution rate: bases, substitutions, the observed rate and character accuracy."""
    texts = table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    out = None
    for rate in RATES:
        noisy = N.substitution_noise(texts.withColumn("dna", D.plain(F.col("text"))), ["item_id"], "dna", rate)
        own = noisy.select("text", F.size("places").alias("bases"), F.size(F.filter("places", lambda p: p["changed"])).alias("substituted"), F.array_join(F.transform("places", lambda p: p["base"]), "").alias("noisy"))
        own = own.withColumn("bytes", D.unplain(F.col("noisy")))
        right = F.aggregate(
            F.zip_with(F.regexp_extract_all(F.hex("text"), F.lit("[0-9A-F]{2}"), F.lit(0)), F.regexp_extract_all(F.hex("bytes"), F.lit("[0-9A-F]{2}"), F.lit(0)), lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x
        )
        part = own.agg(F.sum("bases").alias("dna_bases"), F.sum("substituted").alias("substituted_bases"), F.sum(right).alias("right_bytes"), F.sum(F.octet_length("text")).alias("payload_bytes"))
        part = part.select(F.lit(rate).alias("error_rate"), "*", F.round(F.col("substituted_bases") / F.col("dna_bases"), 6).alias("actual_rate"), F.round(F.col("right_bytes") / F.col("payload_bytes"), 6).alias("byte_accuracy"))
        out = part if out is None else out.unionByName(part)
    return out


# A byte is four bases and a substituted base is another one, so a byte is right when none of its bases was drawn.
TEXT_BENCHMARK_SQL = f"""
WITH t AS (SELECT item_id, {Q.plain("coalesce(text, '')")} AS dna FROM benchmark),
b AS (SELECT item_id, pos FROM t, unnest(range(1, length(dna) + 1)) AS u(pos)),
d AS (SELECT item_id, pos, {Q.uniform(N.SEED, "item_id || '|' || pos", 1)} AS u FROM b),
r AS (SELECT unnest({list(RATES)})::DOUBLE AS error_rate, unnest({[int(rate * 2**32) for rate in RATES]}) AS bound),
g AS (SELECT error_rate, item_id, (pos - 1) // 4 AS byte, count(*) AS n, count(*) FILTER (u < bound) AS c FROM d, r GROUP BY ALL)
SELECT error_rate, sum(n)::BIGINT AS dna_bases, sum(c)::BIGINT AS substituted_bases, count(*) FILTER (c = 0) AS right_bytes, count(*) AS payload_bytes,
round(sum(c) / sum(n), 6) AS actual_rate, round(count(*) FILTER (c = 0) / count(*), 6) AS byte_accuracy FROM g GROUP BY error_rate"""

READ_PIPELINE_SQL = N.INDEX_AWARE_SQL.split("SELECT item_id, no, copy_no, CASE WHEN edits")[0] + f""",
found AS (SELECT kk.item_id, kk.assigned AS no, seq, t.full_strand, t.payload FROM kk JOIN reads USING (item_id, no, copy_no) JOIN strands t ON kk.item_id = t.item_id AND kk.assigned = t.no
  WHERE k = 1 AND edits <= {N.MAX_PREFIX_EDIT + 4} AND length(seq) = length(t.full_strand)),
votes AS (SELECT item_id, no, payload, pos, substr(seq, pos, 1) AS base, count(*) AS n FROM found, unnest(range(1, length(seq) + 1)) AS u(pos) GROUP BY ALL),
winners AS (SELECT *, row_number() OVER (PARTITION BY item_id, no, pos ORDER BY n DESC, base) AS k FROM votes),
made AS (SELECT item_id, no, payload, substr(string_agg(base, '' ORDER BY pos), {N.PREFIX + 1}, length(payload)) AS made FROM winners WHERE k = 1 GROUP BY item_id, no, payload),
whole AS (SELECT item_id, count(*) AS strands_read, sum(hamming(payload, made))::BIGINT AS payload_mismatches, string_agg(made, '' ORDER BY no) AS dna FROM made GROUP BY item_id),
decoded AS (SELECT whole.*, {Q.plain("coalesce(text, '')")} AS a, CASE WHEN dna = 'CA' THEN 'AAAA' WHEN dna LIKE 'A%' AND length(dna) % 4 = 1 THEN substr(dna, 2) ELSE '' END AS b FROM whole JOIN benchmark USING (item_id))
SELECT item_id, strands_read, payload_mismatches, round(CASE WHEN a = '' AND b = '' THEN 1 ELSE
  coalesce(list_sum(list_transform(range(least(length(a), length(b)) // 4), lambda i: (substr(a, 4 * i + 1, 4) = substr(b, 4 * i + 1, 4))::INT)), 0) / (greatest(length(a), length(b)) / 4) END, 6) AS byte_accuracy FROM decoded"""

QUERIES = {"read_pipeline": (read_pipeline, READ_PIPELINE_SQL), "text_benchmark": (text_benchmark, TEXT_BENCHMARK_SQL)}
