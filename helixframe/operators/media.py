"""Image, sound and video payloads as numpy kernels in Arrow batches.

The driver's tables hold no media, so the queries take each embedding (64 values) as an 8 x 8 grey image, a clip of
sound, or a frame of a film in the order of vec_id. Images are resampled by block means and linear interpolation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dna as D
from ..sources.files import wav_bytes, wav_samples
from ..sources.tables import table
from .signals import mu_law, mu_law_inverse, similar_frames

# The JPEG standard's luminance quantisation table, row by row.
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]
# Bits of a DC value, tokens of a packet, quantiser scale; wavelet step, bits; base factor and bits.
DC_BITS, TOKENS, SCALE = 12, 4, 1.5
LL_STEP, LL_BITS = 16.0, 6
FACTOR, BASE_BITS = 2, 5
# Samples of a spectrogram's frame, and from one frame to the next.
FRAME, HOP = 512, 256


def cosine_matrix(n: int = 8) -> np.ndarray:
    k, i = np.mgrid[:n, :n]
    return np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n)) * np.cos(np.pi * (2 * i + 1) * k / (2 * n))


def zigzag(n: int = 8) -> np.ndarray:
    """Flat places by diagonal, upwards on even diagonals."""
    return np.array([r * n + c for r, c in sorted(((r, c) for r in range(n) for c in range(n)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])


_DCT, _ZIGZAG = cosine_matrix(), zigzag()


def _field(value: int, bits: int) -> str:
    return f"{max(0, min((1 << bits) - 1, value)):0{bits}b}"


def _crc8(bits: str) -> int:
    crc = 0
    for b in bits:
        crc = ((crc << 1) & 255) ^ (7 if (crc >> 7) ^ (b == "1") else 0)
    return crc


def block_packet(pixels: np.ndarray, scale: float = SCALE, tokens: int = TOKENS) -> str:
    """Bits of an 8 x 8 block: DC as offset binary, (zero run, value code) tokens in zigzag order, CRC-8."""
    table_ = np.maximum(1, np.round(np.array(LUMINANCE).reshape(8, 8) * scale))
    q = np.round(_DCT @ (pixels - 128.0) @ _DCT.T / table_).astype(int).ravel()[_ZIGZAG]
    out, run = [], 0
    for v in np.clip(q[1:], -31, 31).tolist():
        if v == 0:
            run += 1
            continue
        while run > 15:
            out.append((15, 0))
            run -= 15
        out.append((run, v if v > 0 else 31 - v))
        run = 0
    out = (out + [(0, 0)] * tokens)[:tokens]
    data = _field(int(q[0]) + (1 << DC_BITS - 1), DC_BITS) + "".join(_field(r, 4) + _field(c, 6) for r, c in out)
    return data + _field(_crc8(data), 8)


def block_pixels(packet: str, scale: float = SCALE, tokens: int = TOKENS) -> tuple[np.ndarray, bool]:
    """Pixels of a packet; neutral grey where its CRC fails."""
    data, q, at = packet[:-8], np.zeros(64), 1
    valid = _crc8(data) == int(packet[-8:], 2)
    if valid:
        q[0] = int(data[:DC_BITS], 2) - (1 << DC_BITS - 1)
        for k in range(tokens):
            token = data[DC_BITS + 10 * k : DC_BITS + 10 * k + 10]
            run, code = int(token[:4], 2), int(token[4:], 2)
            at += run
            if (run == 0 and code == 0) or at > 63:
                break
            if code:
                q[at] = code if code <= 31 else 31 - code
                at += 1
    flat = np.zeros(64)
    flat[_ZIGZAG] = q
    c = flat.reshape(8, 8) * np.maximum(1, np.round(np.array(LUMINANCE).reshape(8, 8) * scale))
    return np.clip(_DCT.T @ c @ _DCT + 128, 0, 255).astype(np.uint8), valid


def psnr(a: np.ndarray, b: np.ndarray, peak: float = 255.0, equal: float = 99.0) -> float:
    mse = float(np.mean((np.asarray(a, dtype=float) - np.asarray(b, dtype=float)) ** 2))
    return equal if mse <= 1e-12 else 10 * np.log10(peak * peak / mse)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, pixels (array of 64 grey values)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: mu_law(x, 8)).alias("pixels"))


def _per_image(spark: SparkSession, sf_dir: str, schema: str, f) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *f(int(k), np.array(p, dtype=np.uint8).reshape(8, 8))) for k, p in zip(pdf["vec_id"], pdf["pixels"])]
            yield pd.DataFrame(rows, columns=["vec_id", *[c.split()[0] for c in schema.split(", ")]])

    return images(spark, sf_dir).where(F.size("pixels") == 64).mapInPandas(run, f"vec_id long, {schema}")


def image_block_dct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images through DCT packets and two bits a base, one in ten with a wrong bit that the CRC finds."""

    def f(k: int, p: np.ndarray):
        packet = block_packet(p)
        read = packet[:5] + "10"[int(packet[5])] + packet[6:] if k % 10 == 0 else packet
        got, valid = block_pixels(read)
        return len(packet), len(packet) // 2, valid, round(psnr(p, got), 4)

    return _per_image(spark, sf_dir, "packet_bits int, bases int, valid boolean, psnr double", f)


def haar_ll(p: np.ndarray, level: int = 2) -> np.ndarray:
    """Approximation band of orthonormal Haar levels: block sums over 2**level; odd sizes are mirrored."""
    m = 1 << level
    p = np.pad(p, [(0, -n % m) for n in p.shape], mode="reflect")
    return p.reshape(p.shape[0] // m, m, p.shape[1] // m, m).sum(axis=(1, 3)) / m


def haar_from_ll(ll: np.ndarray, shape: tuple[int, int], level: int = 2) -> np.ndarray:
    m = 1 << level
    return np.kron(ll / m, np.ones((m, m)))[: shape[0], : shape[1]]


def video_haar_ll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as quantised wavelet approximations: payload, its checksum, PSNR (100 where equal)."""

    def f(k: int, p: np.ndarray):
        top = (1 << LL_BITS) - 1
        q = np.clip(np.round((haar_ll(p - 128.0)) / LL_STEP + top // 2), 0, top).astype(np.uint8)
        got = np.clip(haar_from_ll((q.astype(float) - top // 2) * LL_STEP, p.shape) + 128, 0, 255).astype(np.uint8)
        return q.tobytes(), q.size, round(min(100.0, psnr(p, got, equal=100.0)), 4)

    return _per_image(spark, sf_dir, "payload binary, payload_bytes int, psnr double", f)


def image_low_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images as means of blocks of FACTOR pixels in BASE_BITS bits, enlarged again by linear interpolation."""

    def f(k: int, p: np.ndarray):
        levels, s = (1 << BASE_BITS) - 1, 8 // FACTOR
        q = np.round(p.reshape(s, FACTOR, s, FACTOR).mean(axis=(1, 3)) / 255 * levels)
        back, at = q / levels * 255, (np.arange(8) + 0.5) / FACTOR - 0.5
        rows = np.stack([np.interp(at, np.arange(s), r) for r in back])
        got = np.stack([np.interp(at, np.arange(s), c) for c in rows.T]).T
        return "".join(_field(int(v), BASE_BITS) for v in q.ravel()), round(psnr(p, np.round(got)), 4)

    return _per_image(spark, sf_dir, "bits string, psnr double", f)


def raw_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels as bytes, and as one bit each at a threshold of 128, eight a byte."""
    i = images(spark, sf_dir)
    grey = F.array_join(F.transform("pixels", lambda p: F.lpad(F.hex(p), 2, "0")), "")
    bits = F.array_join(F.transform("pixels", lambda p: F.when(p >= 128, "1").otherwise("0")), "")
    return i.select("vec_id", grey.alias("grey_hex"), F.hex(D.unbits(bits)).alias("binary_hex"))


RAW_SQL = """
WITH s AS (SELECT vec_id, generate_subscripts(embedding, 1) AS n, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT vec_id, n, round_even((sign(x) * ln(1 + abs(x) * 255) / 5.545177444479562 + 1) / 2 * 255, 0)::INT AS p FROM (SELECT vec_id, n, least(1.0, greatest(-1.0, x)) AS x FROM s)),
b AS (SELECT vec_id, (n - 1) // 8 AS k, sum(CASE WHEN p >= 128 THEN 1 << (7 - (n - 1) % 8)::INT ELSE 0 END)::INT AS v FROM c GROUP BY ALL),
g AS (SELECT vec_id, string_agg(printf('%02X', p), '' ORDER BY n) AS grey_hex FROM c GROUP BY vec_id)
SELECT vec_id, grey_hex, string_agg(printf('%02X', v), '' ORDER BY k) AS binary_hex FROM g JOIN b USING (vec_id) GROUP BY vec_id, grey_hex"""


def audio_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips as WAV files read again, resampled to half the rate, companded to four bits: sizes and SNR."""

    @F.pandas_udf("wav_bytes int, samples int, payload_bytes int, snr_db double")
    def run(clips: pd.Series) -> pd.DataFrame:
        rows = []
        for clip in clips:
            raw = wav_bytes(np.array(clip, dtype=float), 16_000)
            rate, x = wav_samples(raw)
            half = np.interp(np.arange(len(x) // 2) * 2.0, np.arange(len(x)), x)
            code = np.round((np.sign(half) * np.log1p(np.abs(half) * 255) / np.log1p(255) + 1) / 2 * 15)
            y = code / 15 * 2 - 1
            back = np.sign(y) * np.expm1(np.abs(y) * np.log1p(255)) / 255
            noise = float(((half - back) ** 2).mean()) if len(half) else 0.0
            rows.append((len(raw), len(half), (len(half) + 1) // 2, round(10 * np.log10((half**2).mean() / noise), 4) if noise else None))
        return pd.DataFrame(rows, columns=["wav_bytes", "samples", "payload_bytes", "snr_db"])

    return table(spark, sf_dir, "embeddings").select("vec_id", run("embedding").alias("r")).select("vec_id", "r.*")


def temporal_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with places off the median of their three most similar neighbours by over three median deviations mended."""
    frames = images(spark, sf_dir).select(F.col("vec_id").alias("frame"), F.col("pixels").cast("array<double>").alias("pixels"))
    near = similar_frames(frames).select("frame", F.col("other").alias("o"))
    others = near.join(frames.select(F.col("frame").alias("o"), F.col("pixels").alias("other")), "o").groupBy("frame").agg(F.sort_array(F.collect_list("other")).alias("others"))

    @F.pandas_udf("mended int, mean_shift double")
    def run(pixels: pd.Series, others: pd.Series) -> pd.DataFrame:
        rows = []
        for p, o in zip(pixels, others):
            p, middle = np.array(p, dtype=float), np.median(np.array([np.array(x) for x in o], dtype=float), axis=0)
            gap = np.abs(p - middle)
            mask = gap > np.median(gap) + 3 * np.median(np.abs(gap - np.median(gap)))
            rows.append((int(mask.sum()), round(float((gap * mask).mean()), 6)))
        return pd.DataFrame(rows, columns=["mended", "mean_shift"])

    return frames.join(others, "frame").select("frame", run("pixels", "others").alias("r")).select("frame", "r.*")


def spectrogram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of log spectra (Hann frames of 32, hop 16) of each clip and the next."""
    w = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, sf_dir, "embeddings").withColumn("following", F.lead("embedding").over(w)).where("following IS NOT NULL")

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def spectrum(x) -> np.ndarray:
            x = np.array(x, dtype=float)
            frames = [x[i : i + 32] * np.hanning(32) for i in range(0, max(1, len(x) - 31), 16)]
            return np.log1p(np.abs(np.fft.rfft(frames, axis=1))).ravel()

        pairs = ((spectrum(x), spectrum(y)) for x, y in zip(a, b))
        return pd.Series([round(float(x @ y / max(1e-12, np.linalg.norm(x) * np.linalg.norm(y))), 6) for x, y in pairs])

    return e.select("vec_id", run("embedding", "following").alias("similarity"))


def frame_rows(samples: DataFrame, key: str, place: str, value: str, size: int = FRAME, hop: int = HOP) -> DataFrame:
    """key, frame, values: overlapping frames of a signal given a sample a row. A sample goes to the frames it lies in, so no
    signal is put together; frames that a signal's end cuts are left out, but a signal shorter than a frame has one."""
    last = F.floor(F.col(place) / hop)
    first = F.greatest(F.lit(0), F.floor((F.col(place) - size) / hop) + 1)
    rows = samples.select(key, place, value, F.explode(F.sequence(first, last)).alias("frame"))
    framed = rows.groupBy(key, "frame").agg(F.array_sort(F.collect_list(F.struct(place, value))).alias("v"))  # `size` samples at most
    return framed.where((F.size("v") == size) | (F.col("frame") == 0)).select(key, "frame", F.transform("v", lambda x: x[value]).alias("values"))


def log_spectrum(values: Column, size: int = FRAME) -> Column:
    """log(1 + magnitude) of a frame's spectrum under a Hann window; a short frame is filled with zeros."""

    @F.pandas_udf("array<double>")
    def run(frames: pd.Series) -> pd.Series:
        window = np.hanning(size + 1)[:-1]
        return pd.Series([np.log1p(np.abs(np.fft.rfft(np.pad(np.array(f, dtype=float), (0, size - len(f))) * window))) for f in frames], dtype=object)

    return run(values)


def spectral_likeness(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, frames, likeness: cosine of two signals' spectra over the frames that both have; 1 where both are silent, 0 where one is."""
    met = a.select(key, "frame", log_spectrum(F.col("values")).alias("x")).join(b.select(key, "frame", log_spectrum(F.col("values")).alias("y")), [key, "frame"])
    dot = lambda u, v: F.sum(F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x))
    sums = met.groupBy(key).agg(F.count(F.lit(1)).alias("frames"), dot("x", "y").alias("xy"), dot("x", "x").alias("xx"), dot("y", "y").alias("yy"))
    silent = F.when((F.col("xx") == 0) & (F.col("yy") == 0), 1.0).when((F.col("xx") == 0) | (F.col("yy") == 0), 0.0)
    return sums.select(key, "frames", F.round(F.coalesce(silent, F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))), 6).alias("likeness"))


def spectrogram_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's clips one behind the other, against the same companded to four bits."""
    w = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding", (F.row_number().over(w) - 1).alias("clip"))
    rows = e.select("label", "clip", F.posexplode("embedding").alias("n", "x")).select("label", (F.col("clip") * 64 + F.col("n")).alias("place"), F.col("x").cast("double").alias("x"))
    rows = rows.withColumn("y", mu_law_inverse(mu_law(F.col("x"), 4), 4))
    return spectral_likeness(frame_rows(rows, "label", "place", "x"), frame_rows(rows, "label", "place", "y"), "label")


QUERIES = {
    "spectrogram_frames": (spectrogram_frames, None),
    "image_block_dct": (image_block_dct, None),
    "video_haar_ll": (video_haar_ll, None),
    "image_low_resolution": (image_low_resolution, None),
    "raw_pixels": (raw_pixels, RAW_SQL),
    "audio_payload": (audio_payload, None),
    "temporal_repair": (temporal_repair, None),
    "spectrogram_similarity": (spectrogram_similarity, None),
}
