"""One-dimensional signals: companding, click repair, quality measures, votes, quantisation, offsets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table

# Companding constant, click threshold, quantiser step, centre and bits.
MU, CLICK, STEP, CENTRE, BITS = 255, 0.35, 8, 31, 6


def _clip(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x))


def mu_law(x: Column, bits: int, mu: int = MU) -> Column:
    """Samples in [-1, 1] as unsigned codes of so many bits; halves round to even."""
    x = _clip(x.cast("double"))
    y = F.signum(x) * F.log1p(F.abs(x) * mu) / F.lit(float(math.log1p(mu)))
    return F.bround((y + 1) / 2 * ((1 << bits) - 1)).cast("int")


def mu_law_inverse(code: Column, bits: int, mu: int = MU) -> Column:
    y = code / ((1 << bits) - 1) * 2 - 1
    return F.signum(y) * F.expm1(F.abs(y) * F.lit(float(math.log1p(mu)))) / mu


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as signals: vec_id, n (from 0), x."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode("embedding").alias("n", "x")).withColumn("x", F.col("x").cast("double"))


_LOG = repr(math.log1p(MU))
SAMPLES = "samples AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS n, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def _code(x: str, bits: int) -> str:
    return f"round_even((sign(least(1.0, greatest(-1.0, {x}))) * ln(1 + abs(least(1.0, greatest(-1.0, {x}))) * {MU}) / {_LOG} + 1) / 2 * {(1 << bits) - 1}, 0)::INT"


def _decoded(code: str, bits: int) -> str:
    y = f"({code} / {(1 << bits) - 1} * 2 - 1)"
    return f"sign{y} * (exp(abs{y} * {_LOG}) - 1) / {MU}"


def mulaw_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return s.select("vec_id", "n", mu_law(F.col("x"), 8).alias("code8"), mu_law(F.col("x"), 4).alias("code4"))


MULAW_SQL = f"WITH {SAMPLES} SELECT vec_id, n::INT AS n, {_code('x', 8)} AS code8, {_code('x', 4)} AS code4 FROM samples"


def nibble_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-bit codes packed two a byte, as hexadecimal text, and their number when unpacked."""
    codes = mulaw_codes(spark, sf_dir).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("n", "code4"))).alias("c"))
    packed = F.array_join(F.transform("c", lambda c: F.hex(c["code4"])), "")
    return codes.select("vec_id", packed.alias("payload_hex"), F.octet_length(F.unhex(packed)).alias("payload_bytes"))


NIBBLE_SQL = f"WITH {SAMPLES} SELECT vec_id, string_agg(substr('0123456789ABCDEF', {_code('x', 4)} + 1, 1), '' ORDER BY n) AS payload_hex, ((count(*) + 1) // 2)::INT AS payload_bytes FROM samples GROUP BY vec_id"


def quality(rows: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Mean squared error, SNR, PSNR (peak 1) and correlation per group, rounded; null where undefined or infinite."""
    e = (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    g = rows.groupBy(by).agg(F.avg(e).alias("mse"), F.avg(F.col(a) * F.col(a)).alias("power"), F.corr(a, b).alias("corr"), F.count(F.lit(1)).alias("n"))
    return g.select(
        by,
        "n",
        F.round("mse", 8).alias("mse"),
        F.round(F.when((F.col("mse") > 0) & (F.col("power") > 0), 10 * F.log10(F.col("power") / F.when(F.col("mse") > 0, F.col("mse")))), 4).alias("snr_db"),
        F.round(F.when(F.col("mse") > 0, -10 * F.log10(F.when(F.col("mse") > 0, F.col("mse")))), 4).alias("psnr_db"),
        F.round("corr", 6).alias("corr"),
    )


def signal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return quality(s.withColumn("y", mu_law_inverse(mu_law(F.col("x"), 8), 8)), "vec_id", "x", "y")


QUALITY_SQL = f"""WITH {SAMPLES}, d AS (SELECT vec_id, x, {_decoded(_code("x", 8), 8)} AS y FROM samples),
g AS (SELECT vec_id, count(*) AS n, avg((x - y) * (x - y)) AS mse, avg(x * x) AS power, corr(x, y) AS c FROM d GROUP BY vec_id)
SELECT vec_id, n, round(mse, 8) AS mse, round(CASE WHEN mse > 0 AND power > 0 THEN 10 * log10(power / mse) END, 4) AS snr_db, round(CASE WHEN mse > 0 THEN -10 * log10(mse) END, 4) AS psnr_db, round(c, 6) AS corr FROM g"""


def click_repair(df: DataFrame, key: str, order: str, x: str, threshold: float = CLICK) -> DataFrame:
    """df with `repaired`: the median of five neighbours where a sample is off it by over the threshold; the first and last two stay."""
    w = Window.partitionBy(key).orderBy(order)
    near = F.array_sort(F.collect_list(x).over(w.rowsBetween(-2, 2)))
    median = F.when(F.size(near) == 5, F.get(near, F.lit(2)))
    return df.withColumn("repaired", F.when(F.abs(F.col(x) - median) > threshold, median).otherwise(F.col(x)))


def click_repair_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return click_repair(e, "user_id", "event_id", "value").select("event_id", "repaired", (F.col("repaired") != F.col("value")).alias("changed"))


CLICK_SQL = f"""WITH w AS (SELECT event_id, value, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS l FROM events),
r AS (SELECT event_id, value, CASE WHEN len(l) = 5 AND abs(value - l[3]) > {CLICK} THEN l[3] ELSE value END AS repaired FROM w) SELECT event_id, repaired, repaired <> value AS changed FROM r"""


def vote3(a: Column, b: Column, c: Column) -> Column:
    """Majority of three; the first where all differ."""
    return F.when((a == b) | (a == c), a).when(b == c, b).otherwise(a)


def vote3_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of three copies, of which some are off at places a rule picks, voted place by place."""
    s = mulaw_codes(spark, sf_dir).select("vec_id", "n", F.col("code8").alias("x"))
    a = F.when((F.col("vec_id") + F.col("n")) % 7 == 0, (F.col("x") + 1) % 256).otherwise(F.col("x"))
    b = F.when((F.col("vec_id") * 3 + F.col("n")) % 11 == 0, (F.col("x") + 2) % 256).otherwise(F.col("x"))
    v = s.withColumn("v", vote3(a, b, F.col("x")))
    return v.groupBy("vec_id").agg(F.count_if(F.col("v") == F.col("x")).alias("right"), F.sum("v").alias("total"))


VOTE_SQL = f"""WITH {SAMPLES}, c AS (SELECT vec_id, n, {_code("x", 8)} AS x FROM samples),
v AS (SELECT vec_id, x, CASE WHEN (vec_id + n) % 7 = 0 THEN (x + 1) % 256 ELSE x END AS a, CASE WHEN (vec_id * 3 + n) % 11 = 0 THEN (x + 2) % 256 ELSE x END AS b FROM c),
r AS (SELECT vec_id, x, CASE WHEN a = b OR a = x THEN a WHEN b = x THEN b ELSE a END AS v FROM v)
SELECT vec_id, count(*) FILTER (v = x) AS right, sum(v)::BIGINT AS total FROM r GROUP BY vec_id"""


def quantised(x: Column, step: float, centre: int = CENTRE, bits: int = BITS) -> Column:
    return F.least(F.lit((1 << bits) - 1), F.greatest(F.lit(0), F.bround(x / step).cast("int") + centre))


def quantize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in 1/256 steps quantised to six bits about a centre, and the largest error of each signal."""
    s = samples(spark, sf_dir).withColumn("q", quantised(F.col("x") * 256, STEP))
    s = s.withColumn("e", F.abs((F.col("q") - CENTRE) * STEP - F.col("x") * 256))
    return s.groupBy("vec_id").agg(F.sum("q").alias("codes"), F.round(F.max("e"), 4).alias("largest_error"), F.count_if(F.col("q").isin(0, 63)).alias("clipped"))


QUANT_SQL = f"""WITH {SAMPLES}, q AS (SELECT vec_id, x, least(63, greatest(0, round_even(x * 256 / {STEP}, 0)::INT + {CENTRE})) AS q FROM samples)
SELECT vec_id, sum(q)::BIGINT AS codes, round(max(abs((q - {CENTRE}) * {STEP} - x * 256)), 4) AS largest_error, count(*) FILTER (q IN (0, 63)) AS clipped FROM q GROUP BY vec_id"""


def payload_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every turn's bytes in its conversation's payload; every fourth turn and the first are protected."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("bytes"))
    index = F.row_number().over(w) - 1
    return t.select("conv_id", "turn", "bytes", (F.sum("bytes").over(w) - F.col("bytes")).alias("offset"), (index % 4 == 0).alias("protected"))


OFFSETS_SQL = """SELECT conv_id, turn, strlen(text)::BIGINT AS bytes, (sum(strlen(text)) OVER w - strlen(text))::BIGINT AS offset, (row_number() OVER w - 1) % 4 = 0 AS protected
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""


def similar_frames(df: DataFrame, radius: int = 6, top: int = 3) -> DataFrame:
    """The `top` nearest of the frames within `radius` numbers, by mean squared difference: a band join on blocks of
    radius numbers, so that each frame meets its neighbours only. df: frame, pixels (array of double)."""
    block = F.floor(F.col("frame") / radius)
    left = df.select("frame", "pixels", F.explode(F.array(block - 1, block, block + 1)).alias("b"))
    right = df.select(F.col("frame").alias("other"), F.col("pixels").alias("others"), block.alias("b"))
    pairs = left.join(right, "b").where((F.abs(F.col("frame") - F.col("other")) <= radius) & (F.col("frame") != F.col("other")))
    error = F.aggregate(F.zip_with("pixels", "others", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / F.size("pixels")
    rank = F.row_number().over(Window.partitionBy("frame").orderBy("mse", "other"))
    return pairs.select("frame", "other", F.round(error, 10).alias("mse")).withColumn("rank", rank).where(F.col("rank") <= top)


def similar_frame_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("pixels"))
    return similar_frames(e).select("frame", "other", "rank", F.round("mse", 7).alias("mse"))


FRAMES_SQL = """WITH p AS (SELECT a.vec_id AS frame, b.vec_id AS other, round(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / len(a.embedding), 10) AS mse
  FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id - 6 AND a.vec_id + 6 AND a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY mse, other) AS rank FROM p) SELECT frame, other, rank::INT AS rank, round(mse, 7) AS mse FROM k WHERE rank <= 3"""


def array_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error measures of flat images: MSE, MAE, PSNR (99 when equal) and global SSIM of the codes against their top four bits."""
    s = mulaw_codes(spark, sf_dir).select("vec_id", F.col("code8").cast("double").alias("a"), (F.floor(F.col("code8") / 16) * 16).cast("double").alias("b"))
    g = s.groupBy("vec_id").agg(
        F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("mse"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"), F.covar_pop("a", "b").alias("c")
    )
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ssim = (2 * F.col("ma") * F.col("mb") + c1) * (2 * F.col("c") + c2) / ((F.col("ma") ** 2 + F.col("mb") ** 2 + c1) * (F.col("va") + F.col("vb") + c2))
    psnr = F.when(F.col("mse") <= 1e-12, 99.0).otherwise(10 * F.log10(F.lit(255.0 * 255.0) / F.greatest("mse", F.lit(1e-12))))
    return g.select("vec_id", F.round("mse", 6).alias("mse"), F.round("mae", 6).alias("mae"), F.round(psnr, 4).alias("psnr"), F.round(ssim, 6).alias("ssim"))


ARRAY_SQL = f"""WITH {SAMPLES}, s AS (SELECT vec_id, ({_code("x", 8)})::DOUBLE AS a FROM samples), t AS (SELECT vec_id, a, floor(a / 16) * 16 AS b FROM s),
g AS (SELECT vec_id, avg((a - b) * (a - b)) AS mse, avg(abs(a - b)) AS mae, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c FROM t GROUP BY vec_id)
SELECT vec_id, round(mse, 6) AS mse, round(mae, 6) AS mae, round(CASE WHEN mse <= 1e-12 THEN 99.0 ELSE 10 * log10(65025 / mse) END, 4) AS psnr,
round((2 * ma * mb + 6.5025) * (2 * c + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225)), 6) AS ssim FROM g"""


def dequantised_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as clipped six-bit fields, and signed prices as offset binary of twelve bits, joined per order."""
    u = F.lpad(F.bin(F.least(F.lit(63), F.greatest(F.lit(0), F.col("l_quantity").cast("int")))), 6, "0")
    signed = F.least(F.lit(2047), F.greatest(F.lit(-2048), F.round(F.col("l_discount") * 1000 - 50).cast("int"))) + 2048
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(u, F.lpad(F.bin(signed), 12, "0")).alias("f"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "f"))), lambda x: x["f"]), "")
    return rows.groupBy("l_orderkey").agg(ordered.alias("bits"))


FIELDS_SQL = """WITH f AS (SELECT l_orderkey, l_linenumber, lpad(bin(least(63, greatest(0, l_quantity::INT))), 6, '0') || lpad(bin(least(2047, greatest(-2048, round(l_discount * 1000 - 50)::INT)) + 2048), 12, '0') AS f FROM lineitem)
SELECT l_orderkey, string_agg(f, '' ORDER BY l_linenumber, f) AS bits FROM f GROUP BY l_orderkey"""

QUERIES = {
    "mulaw_codes": (mulaw_codes, MULAW_SQL),
    "nibble_pack": (nibble_pack, NIBBLE_SQL),
    "signal_snr_psnr": (signal_quality, QUALITY_SQL),
    "click_repair": (click_repair_events, CLICK_SQL),
    "vote3": (vote3_bytes, VOTE_SQL),
    "quantize_roundtrip": (quantize_roundtrip, QUANT_SQL),
    "payload_offsets": (payload_offsets, OFFSETS_SQL),
    "similar_frames": (similar_frame_indices, FRAMES_SQL),
    "array_quality": (array_quality, ARRAY_SQL),
    "integer_fields": (dequantised_fields, FIELDS_SQL),
}
