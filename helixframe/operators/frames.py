"""Frames of films: unequal protection, quality with windowed SSIM, and the second clean-up.

A frame is an array of grey values, row by row. The driver's tables hold no films, so each embedding is a frame of 8 x 8 values
of the film that its label names, in the order of vec_id. Everything is arrays and joins on film and frame; no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dna as D
from ..functions import duck as Q
from ..sources.scratch import written
from ..sources.tables import table
from .noise import _bound
from .signals import _code, mu_law, similar_frames, vote3

WIDTH, HEIGHT = 8, 8
# Bytes of a frame's protected band, frames between keyframes, copies of a protected band beside its own.
BAND, KEYFRAMES, COPIES = 16, 8, 2
MODES = ("None", "Light", "Strong")
# Fixed values of windowed SSIM: side of a window, constants for a peak of 255.
SIDE, C1, C2 = 7, (0.01 * 255) ** 2, (0.03 * 255) ** 2
# Fixed values of the second clean-up: least threshold, deviations, weights of time, place and colour, blends, largest masked share.
BASE, DEVIATIONS, TEMPORAL, LOCAL, COLOUR, BLEND, GENTLE, MASKED = 22.0, 3.0, 0.65, 0.25, 0.10, 0.55, 0.12, 0.25
SEED, ERROR = 23, 0.04


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """film, vec_id, frame (from 0 in its film), pixels."""
    e = table(spark, sf_dir, "embeddings", spread=True).where(F.size("embedding") == WIDTH * HEIGHT)
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").alias("film"), "vec_id", place.alias("frame"), F.transform("embedding", lambda x: mu_law(x, 8)).alias("pixels"))


def damaged(values: Column, copy: int, rate: float = ERROR) -> Column:
    """Bytes of one stored copy as they come back: each is another one at the rate."""

    def one(b: Column, i: Column) -> Column:
        u, v = D.hash_uniform(SEED, F.col("vec_id"), F.lit(copy), i)
        return F.when(u < _bound(rate), ((b + 1 + v % 255) % 256).cast("int")).otherwise(b)

    return F.transform(values, one)


def segments(rows: DataFrame, mode: Column) -> DataFrame:
    """rows (film, frame, offset, band) that the mode protects, with the place of their extra copies in the film's protection payload."""
    chosen = rows.where((mode == "Strong") | ((mode == "Light") & (F.col("frame") % KEYFRAMES == 0)))
    before = Window.partitionBy("mode", "film").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    extra = F.coalesce(F.sum(F.col("band") * COPIES).over(before), F.lit(0))
    return chosen.select("mode", "film", "frame", F.lit("Y").alias("channel"), F.col("offset").alias("original_offset"), F.col("band").alias("length"), extra.alias("extra_offset"), F.lit(COPIES).alias("extra_copies"), F.lit(COPIES + 1).alias("total_copies"))


def _by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("film").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    f = frames(spark, sf_dir).withColumn("offset", F.coalesce(F.sum(F.size("pixels")).over(before), F.lit(0))).withColumn("band", F.lit(BAND))
    return f.withColumn("mode", F.explode(F.array(*map(F.lit, MODES))))


def protection_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(_by_mode(spark, sf_dir), F.col("mode"))


FRAMES_CTE = f"""s AS (SELECT label AS film, vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE len(embedding) = {WIDTH * HEIGHT}),
px AS (SELECT film, vec_id, i - 1 AS i, {_code("x", 8)} AS p FROM s),
film AS (SELECT label AS film, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS frame FROM embeddings WHERE len(embedding) = {WIDTH * HEIGHT}),
modes AS (SELECT unnest({list(MODES)}) AS mode),
seg AS (SELECT mode, film, frame, 'Y' AS channel, frame::BIGINT * {WIDTH * HEIGHT} AS original_offset, {BAND} AS length, (row_number() OVER (PARTITION BY mode, film ORDER BY frame) - 1) * {COPIES * BAND} AS extra_offset,
  {COPIES} AS extra_copies, {COPIES + 1} AS total_copies FROM film, modes WHERE mode = 'Strong' OR (mode = 'Light' AND frame % {KEYFRAMES} = 0))"""
SEGMENTS_SQL = f"WITH {FRAMES_CTE} SELECT * FROM seg"


def voted(values: list[Column]) -> Column:
    """Majority of three copies, byte by byte."""
    a, b, c = values
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), c.alias("c")), lambda z: vote3(z["a"], z["b"], z["c"]))


def protected_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames joined with their segment: bands come back from three copies where there is one, else from their own."""
    rows = _by_mode(spark, sf_dir)
    found = rows.join(segments(rows, F.col("mode")).select("mode", "film", "frame", "extra_offset", "length"), ["mode", "film", "frame"], "left")
    band = F.slice("pixels", 1, BAND)
    copies = [damaged(band, k) for k in range(COPIES + 1)]
    out = found.select("mode", "film", "frame", F.coalesce("extra_offset", F.lit(-1)).alias("extra_offset"), F.col("length").isNotNull().alias("protected"), band.alias("band"), copies[0].alias("own"), F.when(F.col("length").isNotNull(), voted(copies)).otherwise(copies[0]).alias("back"))
    right = lambda c: F.aggregate(F.zip_with("band", c, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return out.select("mode", "film", "frame", "extra_offset", "protected", right("own").alias("right_alone"), right("back").alias("right_back"))


def _damaged_sql(copy: int) -> str:
    key = f"vec_id || '|{copy}|' || i"
    return f"CASE WHEN {Q.uniform(SEED, key, 1)} < {_bound(ERROR)} THEN (p + 1 + {Q.uniform(SEED, key, 9)} % 255) % 256 ELSE p END"


PROTECTED_SQL = f"""WITH {FRAMES_CTE},
c AS (SELECT film, vec_id, i, p, {", ".join(f"{_damaged_sql(k)} AS c{k}" for k in range(3))} FROM px WHERE i < {BAND}),
v AS (SELECT *, CASE WHEN c0 = c1 OR c0 = c2 THEN c0 WHEN c1 = c2 THEN c1 ELSE c0 END AS vote FROM c),
g AS (SELECT vec_id, count(*) FILTER (c0 = p) AS alone, count(*) FILTER (vote = p) AS together FROM v GROUP BY vec_id)
SELECT mode, film, frame, coalesce(extra_offset, -1)::BIGINT AS extra_offset, seg.frame IS NOT NULL AS protected, alone::INT AS right_alone, (CASE WHEN seg.frame IS NOT NULL THEN together ELSE alone END)::INT AS right_back
FROM film JOIN g USING (vec_id) CROSS JOIN modes LEFT JOIN seg USING (mode, film, frame)"""


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def windowed_ssim(a: Column, b: Column, width: int, height: int, side: int = SIDE) -> Column:
    """Mean over all whole windows of their structural similarity, with sample variances; a and b are arrays of double."""
    across, n = width - side + 1, float(side * side)
    window = lambda x, p: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda d: F.slice(x, ((p / across).cast("int") + d) * width + p % across + 1, side)))

    def one(p: Column) -> Column:
        pairs = F.zip_with(window(a, p), window(b, p), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        zero = F.struct(*[F.lit(0.0).alias(k) for k in ("x", "y", "xx", "yy", "xy")])
        add = lambda s, z: F.struct((s["x"] + z["x"]).alias("x"), (s["y"] + z["y"]).alias("y"), (s["xx"] + z["x"] * z["x"]).alias("xx"), (s["yy"] + z["y"] * z["y"]).alias("yy"), (s["xy"] + z["x"] * z["y"]).alias("xy"))

        def formula(s: Column) -> Column:
            ux, uy, k = s["x"] / n, s["y"] / n, n / (n - 1)
            vx, vy, vxy = (s["xx"] / n - ux * ux) * k, (s["yy"] / n - uy * uy) * k, (s["xy"] / n - ux * uy) * k
            return (2 * ux * uy + C1) * (2 * vxy + C2) / ((ux * ux + uy * uy + C1) * (vx + vy + C2))

        return F.aggregate(pairs, zero, add, formula)

    count = across * (height - side + 1)
    return _sum(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), one)) / count


def frame_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame against what comes back of it: PSNR (100 where equal), windowed SSIM, correlation (null for a flat frame)."""
    f = frames(spark, sf_dir).select("film", "frame", F.col("pixels").cast("array<double>").alias("a"), damaged(F.col("pixels"), 0).cast("array<double>").alias("b"))
    n = float(WIDTH * HEIGHT)
    mse = _sum(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y))) / n
    mean, mean2 = (lambda c: _sum(F.col(c)) / n), (lambda c: _sum(F.transform(c, lambda x: x * x)) / n)
    rows = f.select("film", "frame", mse.alias("mse"), windowed_ssim(F.col("a"), F.col("b"), WIDTH, HEIGHT).alias("ssim"), mean("a").alias("ma"), mean("b").alias("mb"), mean2("a").alias("a2"), mean2("b").alias("b2"), (_sum(F.zip_with("a", "b", lambda x, y: x * y)) / n).alias("ab"))
    va, vb = F.col("a2") - F.col("ma") * F.col("ma"), F.col("b2") - F.col("mb") * F.col("mb")
    corr = F.when((va > 1e-12) & (vb > 1e-12), (F.col("ab") - F.col("ma") * F.col("mb")) / F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0))))
    psnr = F.when(F.col("mse") == 0, 100.0).otherwise(10 * F.log10(F.lit(65025.0) / F.greatest("mse", F.lit(1e-12))))
    return rows.select("film", "frame", F.round("mse", 6).alias("mse"), F.round(psnr, 4).alias("psnr"), F.round("ssim", 6).alias("ssim"), F.round(corr, 6).alias("correlation"))


def film_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the frames of each film."""
    f = frame_quality(spark, sf_dir)
    return f.groupBy("film").agg(F.count(F.lit(1)).alias("frames_compared"), *[F.round(F.avg(c), 4).alias(f"film_{c}") for c in ("psnr", "ssim", "correlation")])


_SSIM = f"""d AS (SELECT film, vec_id, i, p::DOUBLE AS a, ({_damaged_sql(0)})::DOUBLE AS b FROM px),
wd AS (SELECT vec_id, w, avg(a) AS ux, avg(b) AS uy, var_samp(a) AS vx, var_samp(b) AS vy, covar_samp(a, b) AS vxy FROM d, range({(WIDTH - SIDE + 1) * (HEIGHT - SIDE + 1)}) AS r(w)
  WHERE i // {WIDTH} BETWEEN w // {WIDTH - SIDE + 1} AND w // {WIDTH - SIDE + 1} + {SIDE - 1} AND i % {WIDTH} BETWEEN w % {WIDTH - SIDE + 1} AND w % {WIDTH - SIDE + 1} + {SIDE - 1} GROUP BY vec_id, w),
sm AS (SELECT vec_id, avg((2 * ux * uy + {C1}) * (2 * vxy + {C2}) / ((ux * ux + uy * uy + {C1}) * (vx + vy + {C2}))) AS ssim FROM wd GROUP BY vec_id),
q AS (SELECT film, vec_id, avg((a - b) * (a - b)) AS mse, CASE WHEN var_pop(a) > 1e-12 AND var_pop(b) > 1e-12 THEN corr(a, b) END AS c FROM d GROUP BY film, vec_id),
fq AS (SELECT film.film, frame, round(mse, 6) AS mse, round(CASE WHEN mse = 0 THEN 100.0 ELSE 10 * log10(65025 / mse) END, 4) AS psnr, round(ssim, 6) AS ssim, round(c, 6) AS correlation FROM film JOIN q USING (vec_id) JOIN sm USING (vec_id))"""
FRAME_QUALITY_SQL = f"WITH {FRAMES_CTE}, {_SSIM} SELECT * FROM fq"
FILM_QUALITY_SQL = f"WITH {FRAMES_CTE}, {_SSIM} SELECT film, count(*) AS frames_compared, round(avg(psnr), 4) AS film_psnr, round(avg(ssim), 4) AS film_ssim, round(avg(correlation), 4) AS film_correlation FROM fq GROUP BY film"


def _neighbours(x: Column, p: Column, radius: int, width: int, height: int, clamp: bool) -> Column:
    """Values around a place: beyond the border the nearest ones again, or none."""
    row, col = (p / width).cast("int"), p % width
    if clamp:
        at = lambda k, d, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), k + d))
        steps = F.sequence(F.lit(-radius), F.lit(radius))
        return F.flatten(F.transform(steps, lambda dy: F.transform(steps, lambda dx: F.get(x, at(row, dy, height) * width + at(col, dx, width)))))
    span = lambda k, n: F.sequence(F.greatest(F.lit(0), k - radius), F.least(F.lit(n - 1), k + radius))
    return F.flatten(F.transform(span(row, height), lambda y: F.transform(span(col, width), lambda z: F.get(x, y * width + z))))


def _places(width: int, height: int) -> Column:
    return F.sequence(F.lit(0), F.lit(width * height - 1))


def median_blur(x: Column, radius: int, width: int, height: int) -> Column:
    middle = (2 * radius + 1) ** 2 // 2
    return F.transform(_places(width, height), lambda p: F.get(F.array_sort(_neighbours(x, p, radius, width, height, True)), F.lit(middle)))


def median(x: Column) -> Column:
    """The middle value, or the mean of the two middle ones."""
    return D.let(F.array_sort(x), lambda s: (F.get(s, ((F.size(s) - 1) / 2).cast("int")) + F.get(s, (F.size(s) / 2).cast("int"))) / 2)


def artifact_mask(cur: Column, ref: Column, width: int, height: int) -> Column:
    """Places (1, else 0) off the reference and their surroundings by over the robust threshold, without lone ones, one place wider."""
    local = D.let(median_blur(cur, 2, width, height), lambda m: F.zip_with(cur, m, lambda x, y: F.abs(x - y)))
    temporal = F.zip_with(cur, ref, lambda x, y: F.abs(x - y))
    combined = F.zip_with(temporal, local, lambda t, l: t * (TEMPORAL + COLOUR) + l * LOCAL)  # grey: colour differs as luma does
    threshold = lambda v: D.let(median(v), lambda m: F.greatest(F.lit(BASE), m + DEVIATIONS * (median(F.transform(v, lambda x: F.abs(x - m))) + 1e-6)))
    mask = D.let(combined, lambda v: D.let(threshold(v), lambda t: F.transform(v, lambda x: F.when(x > t, 1).otherwise(0))))
    near = lambda x, of: F.transform(_places(width, height), lambda p: of(_neighbours(x, p, 1, width, height, False)))
    return D.let(mask, lambda m: D.let(near(m, F.array_min), lambda e: D.let(near(e, F.array_max), lambda o: near(o, F.array_max))))


def second_cleanup(df: DataFrame, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """df (frame, pixels: array of double) with mask and cleaned, from the median of the three most similar frames nearby.

    A frame with too much of it masked moves a little towards the reference as a whole, others where they are masked only;
    then each place takes the median of its nine. Frames without another one nearby are left out.
    """
    near = similar_frames(df).select("frame", F.col("other").alias("o"))
    others = near.join(df.select(F.col("frame").alias("o"), F.col("pixels").alias("other")), "o").groupBy("frame").agg(F.collect_list("other").alias("others"))  # three at most
    ref = F.transform(_places(width, height), lambda p: F.floor(median(F.transform("others", lambda x: F.get(x, p)))).cast("double"))
    rows = written(df.join(others, "frame").select("frame", "pixels", ref.alias("ref")), "frame-references")
    rows = rows.withColumn("mask", artifact_mask(F.col("pixels"), F.col("ref"), width, height))
    much = _sum(F.col("mask").cast("array<double>")) / (width * height) > MASKED
    blend = lambda k: F.zip_with("pixels", "ref", lambda c, r: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (1 - k) * c + k * r))))
    some = F.zip_with(F.zip_with("mask", "pixels", lambda m, c: F.struct(m.alias("m"), c.alias("c"))), blend(BLEND), lambda x, b: F.when(x["m"] == 1, b).otherwise(F.floor(x["c"])))
    out = F.when(much, blend(GENTLE)).otherwise(some)
    return rows.withColumn("cleaned", D.let(out, lambda x: median_blur(x, 1, width, height)))


def frame_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged frames, cleaned: places masked, error before and after, and the pixels."""
    f = frames(spark, sf_dir).select(F.col("vec_id").alias("frame"), F.col("pixels").alias("clean"), damaged(F.col("pixels"), 0).cast("array<double>").alias("pixels"))
    f = written(f, "damaged-frames")
    done = second_cleanup(f.select("frame", "pixels")).join(f.select("frame", "clean"), "frame")
    error = lambda c: F.round(_sum(F.zip_with("clean", c, lambda x, y: (x - y) * (x - y))) / (WIDTH * HEIGHT), 4)
    return done.select("frame", F.aggregate("mask", F.lit(0), lambda s, x: s + x).alias("masked"), error("pixels").alias("mse_before"), error("cleaned").alias("mse_after"), F.array_join(F.col("cleaned").cast("array<int>").cast("array<string>"), ",").alias("pixels"))


def _around(x: str, radius: int, of: str, clamp: bool) -> str:
    side, n = 2 * radius + 1, WIDTH * HEIGHT
    if clamp:
        cell = f"{x}[least({HEIGHT - 1}, greatest(0, p // {WIDTH} + k // {side} - {radius})) * {WIDTH} + least({WIDTH - 1}, greatest(0, p % {WIDTH} + k % {side} - {radius})) + 1]"
        return f"list_transform(range({n}), lambda p: {of.format(l=f'list_transform(range({side * side}), lambda k: {cell})')})"
    inside = f"p // {WIDTH} + k // {side} - {radius} BETWEEN 0 AND {HEIGHT - 1} AND p % {WIDTH} + k % {side} - {radius} BETWEEN 0 AND {WIDTH - 1}"
    cell = f"CASE WHEN {inside} THEN {x}[(p // {WIDTH} + k // {side} - {radius}) * {WIDTH} + p % {WIDTH} + k % {side} - {radius} + 1] END"
    return f"list_transform(range({n}), lambda p: {of.format(l=f'list_transform(range({side * side}), lambda k: {cell})')})"


_EACH = f"range(1, {WIDTH * HEIGHT + 1})"
CLEANUP_SQL = f"""WITH {FRAMES_CTE},
f AS (SELECT vec_id AS frame, list(p ORDER BY i) AS clean, list(({_damaged_sql(0)})::DOUBLE ORDER BY i) AS cur FROM px GROUP BY vec_id),
pr AS (SELECT a.frame, b.cur AS other, b.frame AS o, round(list_sum(list_transform({_EACH}, lambda i: pow(a.cur[i] - b.cur[i], 2))) / {WIDTH * HEIGHT}, 10) AS mse FROM f a JOIN f b ON b.frame BETWEEN a.frame - 6 AND a.frame + 6 AND a.frame <> b.frame),
kk AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY frame ORDER BY mse, o) <= 3),
oo AS (SELECT frame, list(other) AS others FROM kk GROUP BY frame),
rf AS (SELECT frame, clean, cur, list_transform({_EACH}, lambda i: floor(list_median(list_transform(others, lambda x: x[i])))::DOUBLE) AS ref FROM f JOIN oo USING (frame)),
lm AS (SELECT *, {_around("cur", 2, "list_sort({l})[13]", True)} AS m5 FROM rf),
cb AS (SELECT *, list_transform({_EACH}, lambda i: abs(cur[i] - ref[i]) * {TEMPORAL + COLOUR} + abs(cur[i] - m5[i]) * {LOCAL}) AS v FROM lm),
md AS (SELECT *, list_median(v) AS m FROM cb), th AS (SELECT *, greatest({BASE}, m + {DEVIATIONS} * (list_median(list_transform(v, lambda x: abs(x - m))) + 1e-6)) AS t FROM md),
m0 AS (SELECT *, list_transform(v, lambda x: (x > t)::INT) AS mask0 FROM th), m1 AS (SELECT *, {_around("mask0", 1, "list_min({l})", False)} AS mask1 FROM m0),
m2 AS (SELECT *, {_around("mask1", 1, "list_max({l})", False)} AS mask2 FROM m1), m3 AS (SELECT *, {_around("mask2", 1, "list_max({l})", False)} AS mask FROM m2),
bl AS (SELECT *, CASE WHEN list_sum(mask) / {WIDTH * HEIGHT} > {MASKED} THEN list_transform({_EACH}, lambda i: floor(greatest(0, least(255, {1 - GENTLE} * cur[i] + {GENTLE} * ref[i]))))
  ELSE list_transform({_EACH}, lambda i: CASE WHEN mask[i] = 1 THEN floor(greatest(0, least(255, {1 - BLEND} * cur[i] + {BLEND} * ref[i]))) ELSE floor(cur[i]) END) END AS x FROM m3),
cl AS (SELECT *, {_around("x", 1, "list_sort({l})[5]", True)} AS cleaned FROM bl)
SELECT frame, list_sum(mask)::INT AS masked, round(list_sum(list_transform({_EACH}, lambda i: pow(clean[i] - cur[i], 2))) / {WIDTH * HEIGHT}, 4) AS mse_before,
round(list_sum(list_transform({_EACH}, lambda i: pow(clean[i] - cleaned[i], 2))) / {WIDTH * HEIGHT}, 4) AS mse_after, array_to_string(list_transform(cleaned, lambda y: y::INT::VARCHAR), ',') AS pixels FROM cl"""

QUERIES = {
    "protection_segments": (protection_segments, SEGMENTS_SQL),
    "protected_frames": (protected_frames, PROTECTED_SQL),
    "frame_quality": (frame_quality, FRAME_QUALITY_SQL),
    "film_quality": (film_quality, FILM_QUALITY_SQL),
    "frame_cleanup": (frame_cleanup, CLEANUP_SQL),
}
