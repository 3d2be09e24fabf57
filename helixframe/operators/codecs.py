"""Codecs between bytes, bits and bases, and their metrics, over whole texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna as D
from ..functions import duck as Q
from ..sources.tables import table


def encoded(docs: DataFrame, mapping: str = "simple", text: str = "text") -> DataFrame:
    """docs with `dna`; mapping: simple, unconstrained or plain."""
    return docs.withColumn("dna", getattr(D, mapping)(F.coalesce(F.col(text), F.lit(""))))


def _encode(mapping: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = encoded(table(spark, sf_dir, "documents", spread=True).select("doc_id", "text"), mapping)
        return df.select("doc_id", F.length("dna").alias("bases"), F.md5("dna").alias("dna_md5"))

    sql = f"SELECT doc_id, length(dna)::INT AS bases, md5(dna) AS dna_md5 FROM (SELECT doc_id, {getattr(Q, mapping)('text')} AS dna FROM documents)"
    return query, sql


def _decode(mapping: str, back: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = encoded(table(spark, sf_dir, "documents", spread=True).select("doc_id", "text"), mapping)
        df = df.select("doc_id", F.encode("text", "UTF-8").alias("payload"), getattr(D, back)(F.col("dna")).alias("decoded"))
        return df.select(
            "doc_id",
            F.octet_length("payload").alias("payload_bytes"),
            F.octet_length("decoded").alias("decoded_bytes"),
            (F.sha2("payload", 256) == F.sha2("decoded", 256)).alias("same"),
            F.sha2("decoded", 256).alias("decoded_sha256"),
        )

    skip = {"simple": 2, "unconstrained": 3, "plain": 1}[mapping]
    sql = f"""
    WITH e AS (SELECT doc_id, text, {getattr(Q, mapping)("text")} AS dna FROM documents),
    d AS (SELECT doc_id, text, unhex({Q.unplain_hex(f"substr(dna, {skip})")}) AS decoded FROM e)
    SELECT doc_id, strlen(text)::INT AS payload_bytes, octet_length(decoded)::INT AS decoded_bytes, encode(text) = decoded AS same, sha256(decoded) AS decoded_sha256 FROM d"""
    return query, sql


def metrics(df: DataFrame, dna: str = "dna") -> DataFrame:
    """df with GC share (six decimals), longest run, and counts of runs by length."""
    names = ("total_runs", "len_1", "len_2", "len_3", "len_4", "longest")

    def one(sequence: str | None) -> tuple:
        if sequence is None:
            return (None,) * len(names)
        values = np.frombuffer(sequence.encode(), dtype=np.uint8)
        ends = np.flatnonzero(np.concatenate([values[1:] != values[:-1], [True]])) if len(values) else np.empty(0, dtype=np.int64)
        runs = np.diff(ends, prepend=-1)[_BASE[values[ends]]]  # of bases only
        counts = np.bincount(np.minimum(runs, 5), minlength=5)
        return len(runs), *(int(c) for c in counts[1:5]), int(runs.max(initial=0))

    @F.pandas_udf(", ".join(f"{n} int" for n in names))
    def counted(sequences: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(s) for s in sequences], columns=list(names), dtype="Int32")

    runs = lambda n: F.col("__runs")[n]
    df = df.withColumn("__runs", counted(dna))
    least = {k: runs("total_runs") - sum((runs(f"len_{j}") for j in range(2, k)), runs("len_1")) for k in range(2, 6)}
    return df.withColumns(
        {
            **{n: runs(n) for n in names[:-1]},
            "gc": F.round(D.gc(F.col(dna)), 6),
            "longest": F.coalesce(runs("longest"), F.lit(0)),
            "runs_ge2": least[2],
            "runs_ge3": least[3],
            "runs_ge4": least[4],
            "len_ge5": least[5],
        }
    ).drop("__runs")


_BASE = np.zeros(256, dtype=bool)
_BASE[list(D.BASES.encode())] = True


def dna_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(encoded(table(spark, sf_dir, "documents", spread=True).select("doc_id", "text"))).drop("text", "dna")


_COUNT = "len(list_filter(r, lambda x: x {}))::INT AS {}"
DNA_METRICS_SQL = f"""
WITH e AS (SELECT doc_id, {Q.simple("text")} AS dna FROM documents), m AS (SELECT doc_id, dna, {Q.runs("dna")} AS r FROM e)
SELECT doc_id, round(length(translate(dna, 'AT', '')) / length(dna), 6) AS gc, list_max(r)::INT AS longest, len(r)::INT AS total_runs,
{", ".join(_COUNT.format(c, n) for c, n in (("> 1", "runs_ge2"), ("> 2", "runs_ge3"), ("> 3", "runs_ge4"), ("= 1", "len_1"), ("= 2", "len_2"), ("= 3", "len_3"), ("= 4", "len_4"), ("> 4", "len_ge5")))}
FROM m"""


def dna_gc_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = encoded(table(spark, sf_dir, "documents", spread=True).select("lang", "text"))
    return df.groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum(F.length("dna").cast("long")).alias("bases"),
        F.sum(F.length(F.translate("dna", "AT", "")).cast("long")).alias("gc_bases"),
    )


GC_BY_LANG_SQL = f"""SELECT lang, count(*) AS docs, sum(length(dna))::BIGINT AS bases, sum(length(translate(dna, 'AT', '')))::BIGINT AS gc_bases
FROM (SELECT lang, {Q.simple("text")} AS dna FROM documents) GROUP BY lang"""


def bits_report(payload: Column) -> Column:
    """Bits of each payload: their number, ones and digest as text, whether they make the payload again, and the bytes that all but the
    last three make, padded and cut. A payload's bits stay in the task."""

    def one(raw: bytes) -> tuple:
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8))
        cut = bits[: max(len(bits) - 3, 0)]
        whole = cut[: len(cut) // 8 * 8]
        digest = hashlib.md5((bits + np.uint8(48)).tobytes()).hexdigest()
        return len(bits), int(np.count_nonzero(bits)), digest, np.packbits(bits).tobytes() == raw, len(np.packbits(cut)), len(np.packbits(whole))

    @F.pandas_udf("n_bits int, ones int, bits_md5 string, same boolean, padded_bytes int, whole_bytes int")
    def report(payloads: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(bytes(p)) for p in payloads], columns=["n_bits", "ones", "bits_md5", "same", "padded_bytes", "whole_bytes"])

    return report(payload)


def bits_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents", spread=True).select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
    return df.select("doc_id", bits_report("payload").alias("r")).select("doc_id", "r.*")


BITS_SQL = f"""SELECT doc_id, length(b)::INT AS n_bits, length(replace(b, '0', ''))::INT AS ones, md5(b) AS bits_md5, true AS same,
strlen(text)::INT AS padded_bytes, greatest(strlen(text) - 1, 0)::INT AS whole_bytes FROM (SELECT doc_id, text, {Q.bits("text")} AS b FROM documents)"""


def index_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order numbers as masked 12-base indices, their six-bit symbols, and plain counters of 8 bases in two alphabets."""
    x = F.col("o_orderkey")
    masked = x.bitwiseXOR(F.lit(D.INDEX_MASK)).bitwiseAND(F.lit(0xFFFFFF))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        D.masked_index(x).alias("index_dna"),
        *[F.shiftright(masked, 18 - 6 * i).bitwiseAND(F.lit(63)).cast("int").alias(f"symbol_{i}") for i in range(4)],
        D.base4(x.bitwiseAND(F.lit(65535)), 8).alias("counter_dna"),
        D.base4(x.bitwiseAND(F.lit(65535)), 8, "ATGC").alias("counter_atgc"),
    )


_M = f"(xor(o_orderkey, {D.INDEX_MASK}) & 16777215)"
INDEX_SQL = f"""SELECT o_orderkey, {Q.base4(_M, 12)} AS index_dna, {", ".join(f"(({_M} >> {18 - 6 * i}) & 63)::INT AS symbol_{i}" for i in range(4))},
{Q.base4("o_orderkey & 65535", 8)} AS counter_dna, {Q.base4("o_orderkey & 65535", 8, "ATGC")} AS counter_atgc FROM orders"""


def dna_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts read as raw, FASTA and JSON-headed sequences."""
    text = F.col("text")
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", text)
    return df.select(
        "conv_id",
        "turn",
        D.clean(text).alias("raw"),
        D.clean(F.concat(F.lit(">tag GATTACA\n"), text)).alias("fasta"),
        D.clean(F.concat(F.lit('{"tag": "GATTACA"}\r\n'), text)).alias("headed"),
    )


_BASES = "upper(regexp_replace({}, '[^ACGTacgt]', '', 'g')) AS {}"
_HEADED = "CASE WHEN starts_with(ltrim(text), '>') THEN regexp_replace(ltrim(text), '^[^\\n]*', '') ELSE text END"
CLEAN_SQL = f"SELECT conv_id, turn, {_BASES.format(_HEADED, 'raw')}, {_BASES.format('text', 'fasta')}, {_BASES.format('text', 'headed')} FROM conversations"


def crc8_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit packets of the benchmark texts with their CRC-8, and the check after one flipped bit."""
    df = table(spark, sf_dir, "benchmark").select("item_id", D.bits(F.col("text")).alias("bits"))
    flipped = F.concat(F.translate(F.substring("bits", 1, 1), "01", "10"), F.substring("bits", F.lit(2), F.length("bits")))
    return df.select("item_id", F.length("bits").alias("n_bits"), D.crc8(F.col("bits")).alias("crc"), D.crc8(flipped).alias("flipped_crc"))


def _crc8_sql(bits: str) -> str:
    step = "xor((c << 1) & 255, CASE WHEN ((c >> 7) & 1) <> b THEN 7 ELSE 0 END)"
    return f"list_reduce(list_prepend(0, list_transform(string_split({bits}, ''), lambda x: x::INT)), lambda c, b: {step})"


CRC8_SQL = f"""WITH b AS (SELECT item_id, {Q.bits("text")} AS bits FROM benchmark)
SELECT item_id, length(bits)::INT AS n_bits, {_crc8_sql("bits")}::INT AS crc, {_crc8_sql("translate(substr(bits, 1, 1), '01', '10') || substr(bits, 2)")}::INT AS flipped_crc FROM b"""


def crc32_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile packets (payload and CRC-32), and the low 8 and 16 bits of the CRC-32 of the bits as text."""
    payload = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    df = table(spark, sf_dir, "documents", spread=True).select("doc_id", payload.alias("payload"))
    crc, of_bits = F.crc32("payload"), F.crc32(D.bits(F.col("payload")).cast("binary"))
    return df.select(
        "doc_id",
        F.octet_length("payload").alias("payload_bytes"),
        crc.alias("crc32"),
        F.octet_length(F.concat("payload", F.unhex(F.lpad(F.hex(crc), 8, "0")))).alias("packet_bytes"),
        of_bits.bitwiseAND(F.lit(255)).cast("int").alias("token_crc8"),
        of_bits.bitwiseAND(F.lit(65535)).cast("int").alias("token_crc16"),
    )


def payload_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First document of every distinct payload, and how many hold it."""
    df = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return df.groupBy("sha256").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))


CRC32_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, strlen(text)::INT AS payload_bytes, CASE WHEN text = '' THEN 0 ELSE {Q.crc32(Q.utf8_bytes("text"))} END AS crc32, CASE WHEN text = '' THEN 0 ELSE {Q.crc32(Q.ascii_bytes(Q.bits("text")))} END AS of_bits FROM d)
SELECT doc_id, payload_bytes, crc32, payload_bytes + 4 AS packet_bytes, (of_bits & 255)::INT AS token_crc8, (of_bits & 65535)::INT AS token_crc16 FROM c"""
HASH_SQL = "SELECT sha256(text) AS sha256, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1"

QUERIES = {
    "dna_simple_encode": _encode("simple"),
    "dna_rinf_encode": _encode("unconstrained"),
    "dna_plain_encode": _encode("plain"),
    "dna_simple_decode": _decode("simple", "unsimple"),
    "dna_rinf_decode": _decode("unconstrained", "ununconstrained"),
    "dna_plain_decode": _decode("plain", "unplain"),
    "dna_metrics": (dna_metrics, DNA_METRICS_SQL),
    "dna_gc_by_lang": (dna_gc_by_lang, GC_BY_LANG_SQL),
    "bits_roundtrip": (bits_roundtrip, BITS_SQL),
    "index_symbols": (index_symbols, INDEX_SQL),
    "dna_clean": (dna_clean, CLEAN_SQL),
    "crc8_packets": (crc8_packets, CRC8_SQL),
    "crc32_packets": (crc32_packets, CRC32_SQL),
    "payload_hashes": (payload_hashes, HASH_SQL),
}
