"""Reports on what was stored and what came back: integrity rows, method rows, word recovery, quality of candidates."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dna as D
from ..functions import duck as Q
from ..sources.scratch import written
from ..sources.tables import table
from . import noise as N
from . import text_methods as X
from .ecc import _WORD, align
from .ranking import METHODS
from .repair import bytes_text
from .tokens import position_accuracy

# Bytes of both sides that a candidate's key digests, bytes that tell equal payloads of a method apart.
KEY_BYTES, SAME_BYTES = 8192, 4096
#: Error rate at which decoded words are compared.
WORD_ERROR = 0.05


def percent(share: Column) -> Column:
    return F.concat(F.format_string("%.2f", D.rounded(share * 100, 2)), F.lit("%"))


def scientific(value: Column) -> Column:
    return F.format_string("%.2e", value)


def signed(n: Column, unit: str) -> Column:
    return F.format_string(f"%+,d {unit}", n.cast("long"))


def rows_of(df: DataFrame, keys: list[str], stage: str, metrics: dict[str, Column]) -> DataFrame:
    """keys, stage, metric, value: a row for each metric that isn't null."""
    each = F.array(*[F.struct(F.lit(stage).alias("stage"), F.lit(k).alias("metric"), v.alias("value")) for k, v in metrics.items()])
    return df.select(*keys, F.explode(F.filter(each, lambda x: x["value"].isNotNull())).alias("m")).select(*keys, "m.*")


def _counted(a: Column, b: Column, count) -> Column:
    """count(bytes of a, bytes of b) over the length that both have; null where a side is."""

    @F.pandas_udf("long")
    def counted(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None or y is None:
                return None
            n = min(len(x), len(y))
            return int(count(np.frombuffer(x, np.uint8, n), np.frombuffer(y, np.uint8, n))) if n else 0

        return pd.Series([one(x, y) for x, y in zip(left, right)], dtype="Int64")

    return counted(a, b)


def byte_accuracy(a: Column, b: Column) -> Column:
    """Share of places with the same byte; a gap in length counts as errors, two empty payloads as equal."""
    same = _counted(a, b, lambda x, y: np.count_nonzero(x == y))
    n = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(n == 0, 1.0).otherwise(same / n)


def bit_error_rate(a: Column, b: Column) -> Column:
    """Share of bits that differ; a gap in length counts in full."""
    errors = _counted(a, b, lambda x, y: np.bitwise_count(x ^ y).sum(dtype=np.int64)) + F.abs(F.octet_length(a) - F.octet_length(b)) * 8
    n = F.greatest(F.octet_length(a), F.octet_length(b)) * 8
    return F.when(n == 0, 0.0).otherwise(errors / n)


def integrity_rows(df: DataFrame, keys: list[str], stored: str, recovered: str) -> DataFrame:
    """Accuracy, bit errors, length and checksum of what came back (null: nothing) against what was stored."""
    a, b = F.col(stored), F.coalesce(F.col(recovered), F.lit("").cast("binary"))
    match = (F.octet_length(a) > 0) & (F.sha2(a, 256) == F.sha2(b, 256))
    return rows_of(
        df, keys, "DNA decode integrity",
        {
            "Payload accuracy": percent(byte_accuracy(a, b)),
            "Bit error rate": scientific(bit_error_rate(a, b)),
            "Length delta": signed(F.octet_length(b) - F.octet_length(a), "bytes"),
            "Checksum": F.when(match, "Pass").otherwise("Fail"),
        },
    )


def validation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns behind the Simple mapping, read back through substitutions. A changed header base leaves nothing to read."""
    turns = table(spark, sf_dir, "conversations", spread=True).select("conv_id", "turn", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("stored"))
    noisy = N.substituted(turns.withColumn("dna", D.simple(F.col("stored"))), ["conv_id", "turn"], "dna", 0.002)
    back = noisy.select("conv_id", "turn", "stored", D.unsimple(F.col("noisy")).alias("recovered"))
    return integrity_rows(back, ["conv_id", "turn"], "stored", "recovered")


_KT = "conv_id || '|' || turn || '|' || pos"
VALIDATION_SQL = f"""
WITH e AS (SELECT conv_id, turn, coalesce(text, '') AS text, {Q.simple("coalesce(text, '')")} AS dna FROM conversations),
b AS (SELECT conv_id, turn, pos, substr(dna, pos, 1) AS base FROM e, unnest(range(1, length(dna) + 1)) AS u(pos)),
d AS (SELECT *, {Q.uniform(N.SEED, _KT, 1)} AS u, {Q.uniform(N.SEED, _KT, 9)} AS v FROM b),
n AS (SELECT conv_id, turn, string_agg(CASE WHEN u < {N._bound(0.002)} THEN {N._SUB.format(b="base", v="v")} ELSE base END, '' ORDER BY pos) AS noisy FROM d GROUP BY conv_id, turn),
h AS (SELECT conv_id, turn, lower(hex(encode(text))) AS a, CASE WHEN noisy = 'CA' THEN '00' WHEN starts_with(noisy, 'A') THEN {Q.unplain_hex("substr(noisy, 2)")} ELSE '' END AS b FROM e JOIN n USING (conv_id, turn)),
m AS (SELECT *, length(a) // 2 AS na, length(b) // 2 AS nb, least(length(a), length(b)) // 2 AS nl FROM h),
c AS (SELECT *, greatest(na, nb) AS nm, coalesce(list_sum(list_transform(range(nl), lambda i: (substr(a, 2 * i + 1, 2) = substr(b, 2 * i + 1, 2))::INT)), 0) AS same,
  coalesce(list_sum(list_transform(range(nl), lambda i: bit_count(xor(('0x' || substr(a, 2 * i + 1, 2))::INT, ('0x' || substr(b, 2 * i + 1, 2))::INT)))), 0) AS wrong FROM m)
SELECT conv_id, turn, 'DNA decode integrity' AS stage, v.metric, v.value FROM c, LATERAL (VALUES
  ('Payload accuracy', printf('%.2f', round(CASE WHEN nm = 0 THEN 1 ELSE same / nm END * 100, 2)) || '%'),
  ('Bit error rate', printf('%.2e', CASE WHEN nm = 0 THEN 0.0 ELSE (wrong + abs(na - nb) * 8) / (nm * 8) END)),
  ('Length delta', CASE WHEN nb < na THEN '-' ELSE '+' END || format('{{:,}}', abs(nb - na)) || ' bytes'),
  ('Checksum', CASE WHEN na > 0 AND a = b THEN 'Pass' ELSE 'Fail' END)) AS v(metric, value)"""


def method_name(method: Column) -> Column:
    """A method's key as words."""
    return F.regexp_replace(F.substring(method, 3, 100), "_", " ")


def method_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report says of every turn's package: method, sizes, ratio and saving."""
    turns = table(spark, sf_dir, "conversations", spread=True).select("conv_id", "turn", "text")
    made = X.Codecs(turns).packages(turns, ["conv_id", "turn"], X.PLAIN)
    original, stored = F.octet_length("text"), F.octet_length("payload")
    rows = made.where(stored > 0)  # nothing is said of nothing
    saved = F.when(original > 0, percent(1 - stored / F.greatest(original, F.lit(1))))
    return rows_of(
        rows, ["conv_id", "turn", "method"], "Payload",
        {
            "Method": method_name(F.col("method")),
            "Original data": bytes_text(original),
            "Payload size": bytes_text(stored),
            "Estimated DNA length": F.format_string("%,d nt", (stored * 4).cast("long")),
            "Compression ratio": F.when(original > 0, F.format_string("%.2fx", D.rounded(original / F.greatest(stored, F.lit(1)), 2))),
            "Size reduction": saved,
        },
    )


_SIZE = "CASE WHEN {n} < 1024 THEN printf('%d B', {n}) ELSE printf('%.2f KB', round_even({n} / 1024, 2)) END"
METHOD_SQL = f"""WITH {X._CODED}, z AS (SELECT conv_id, turn, method, strlen(text)::BIGINT AS o, ((length(bits) + 7) // 8)::BIGINT AS s FROM package WHERE bits <> '')
SELECT conv_id, turn, method, 'Payload' AS stage, v.metric, v.value FROM z, LATERAL (VALUES ('Method', replace(substr(method, 3), '_', ' ')), ('Original data', {_SIZE.format(n="o")}), ('Payload size', {_SIZE.format(n="s")}),
  ('Estimated DNA length', format('{{:,}}', 4 * s) || ' nt'), ('Compression ratio', printf('%.2fx', round(o / greatest(s, 1), 2))), ('Size reduction', printf('%.2f', round((1 - s / greatest(o, 1)) * 100, 2)) || '%')) AS v(metric, value)"""


def word_pairs(df: DataFrame, keys: list[str], original: str, decoded: str) -> DataFrame:
    """keys, place, original_word, decoded_word, status: Match, Substitution, Deletion or Insertion, of a least-edit alignment."""

    @F.pandas_udf("array<struct<original_word:string,decoded_word:string,status:string>>")
    def aligned(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> list[tuple]:
            u, v = ([w.lower() for w in _WORD.findall(s or "")] for s in (x, y))
            said = lambda i, j: "Insertion" if i is None else "Deletion" if j is None else "Match" if u[i] == v[j] else "Substitution"
            return [(None if i is None else u[i], None if j is None else v[j], said(i, j)) for i, j in align(u, v)]

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)

    return df.select(*keys, F.posexplode_outer(aligned(original, decoded)).alias("place", "w")).select(*keys, "place", "w.*")


def word_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by status and the rates from them; keys of texts without words have zeros."""
    of = lambda s: F.count_if(F.col("status") == s)
    counts = pairs.groupBy(*keys).agg(
        F.count("original_word").alias("original_words"), F.count("decoded_word").alias("decoded_words"), of("Match").alias("exact_word_matches"),
        of("Substitution").alias("substitutions"), of("Deletion").alias("deletions"), of("Insertion").alias("insertions"),
    )
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    n = F.greatest("original_words", F.lit(1))
    return counts.withColumns({"word_error_count": errors, "word_error_rate": F.round(errors / n, 6), "word_accuracy": F.round(F.col("exact_word_matches") / n, 6)})


def word_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every turn against those that its sparse package gives back through substitutions, and the texts' likeness."""
    keys = ["conv_id", "turn"]
    turns = table(spark, sf_dir, "conversations", spread=True).select(*keys, "text")
    codecs = X.Codecs(turns)
    made = codecs.packages(turns, keys, ("D_SPARSE_SEMANTIC",)).select(*keys, "text", "method", "tokens", "codec_dna")
    noisy = X.noisy_at(made, keys, (WORD_ERROR,))
    back = written(noisy.select(*keys, "text", codecs.decode(F.col("method"), F.col("noisy_dna"), F.col("tokens")).alias("decoded")), "decoded-turns")
    likeness = back.select(*keys, F.round(position_accuracy(F.col("text"), F.col("decoded")), 6).alias("position_accuracy"))
    return word_metrics(word_pairs(back, keys, "text", "decoded"), keys).join(likeness, keys)


def _unpacked(kind: str, data: bytes) -> bytes:
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return z.read(z.namelist()[0])
    return {"gzip": gzip.decompress, "bz2": bz2.decompress, "xz": lzma.decompress}[kind](data)


def candidate_payloads(df: DataFrame, key: str, payload: str) -> DataFrame:
    """key, original (the payload), method, ext, data: every method's bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, bytes(p), m, m.split("_")[0], f(bytes(p))) for k, p in zip(pdf[key], pdf[payload]) for m, (f, _) in METHODS.items()]
            yield pd.DataFrame(rows, columns=[key, "original", "method", "ext", "data"])

    schema = f"{key} {dict(df.dtypes)[key]}, original binary, method string, ext string, data binary"
    return df.where(F.col(payload).isNotNull()).select(key, payload).mapInPandas(run, schema)


def distinct_candidates(made: DataFrame, key: str) -> DataFrame:
    """Of a payload's candidates with one method, size and digest of their first bytes the first by ext, ranked by size, then method."""
    made = made.withColumn("size_bytes", F.octet_length("data").cast("long"))
    digest = F.sha1(F.substring("data", 1, SAME_BYTES))
    first = F.row_number().over(Window.partitionBy(key, "method", "size_bytes", digest).orderBy("ext"))
    kept = made.withColumn("first", first).where("first = 1").drop("first")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("size_bytes", "method")))


def quality_key(path: Column) -> Column:
    """What a candidate's quality depends on: the same key, the same quality. Digests the first bytes of both sides."""
    digest = F.sha2(F.concat(F.substring("original", 1, KEY_BYTES), F.substring("data", 1, KEY_BYTES)), 256)
    return F.concat_ws("|", path, F.octet_length("original").cast("string"), "method", F.octet_length("data").cast("string"), "ext", digest)


def with_quality(candidates: DataFrame, path: Column) -> DataFrame:
    """candidates with text_accuracy, exact and length_delta of what they unpack to.

    Quality is worked out once for each key, on one of its rows, and joined back: equal payloads under one path cost once.
    """

    @F.pandas_udf("binary")
    def unpacked(kinds: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([_unpacked(k, bytes(d)) for k, d in zip(kinds, data)], dtype=object)

    keyed = written(candidates.withColumn("quality_key", quality_key(path)), "candidates")
    once = keyed.groupBy("quality_key").agg(F.first("original").alias("original"), F.first("ext").alias("ext"), F.first("data").alias("data"))
    once = written(once.select("quality_key", "original", unpacked("ext", "data").alias("restored")), "candidate-restored")
    text = lambda c: F.make_valid_utf8(F.col(c).cast("string"))
    quality = once.select(
        "quality_key", F.round(position_accuracy(text("original"), text("restored")), 6).alias("text_accuracy"), (F.col("original") == F.col("restored")).alias("exact"),
        (F.length(text("restored")) - F.length(text("original"))).alias("length_delta"),
    )
    return keyed.join(quality, "quality_key")


def candidate_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark texts' candidates by rank, with their report columns and quality."""
    texts = table(spark, sf_dir, "benchmark", spread=True).select("item_id", F.encode("text", "UTF-8").alias("payload"))
    ranked = distinct_candidates(candidate_payloads(texts, "item_id", "payload"), "item_id")
    o, s = F.octet_length("original"), F.octet_length("data")
    return with_quality(ranked, F.lit("benchmark")).select(
        "item_id", "rank", "method", F.concat(F.lit("."), "ext").alias("output"), bytes_text(s).alias("compressed_data"), F.format_string("%.2fx", o / F.greatest(s, F.lit(1))).alias("compression_ratio"),
        percent(1 - s / F.greatest(o, F.lit(1))).alias("size_reduction"), F.format_string("%,d nt", (s * 4).cast("long")).alias("estimated_dna"), "text_accuracy", "exact", "length_delta",
    )


QUERIES = {
    "validation_rows": (validation_rows, VALIDATION_SQL),
    "method_rows": (method_rows, METHOD_SQL),
    "word_recovery": (word_recovery, None),
    "candidate_quality": (candidate_quality, None),
}
