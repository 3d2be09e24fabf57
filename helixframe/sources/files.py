"""Files in and out: texts, strand tables, reads, sound and image payloads."""

from __future__ import annotations

import gzip
import io
import json
import re
import struct
import wave
import zipfile
import zlib
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dna as D

# Encodings in the order tried, suffixes of text files, names of a strand's columns in order of preference.
ENCODINGS = ("utf-8-sig", "utf-8", "cp949", "euc-kr", "latin-1")
TEXT_SUFFIXES = ("txt", "md", "csv", "tsv", "log", "json", "xml", "html", "docx")
SEQUENCE_COLUMNS = ("Error payload", "Payload", "Error full strand", "Full strand")
STRAND_COLUMNS = ["No.", "FBR", "Strand index", "Payload", "Filler", "RBR", "Full strand"]
#: Rows of one a file and split that are broadcast.
MAX_SPLITS = 100_000
_PARAGRAPH = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """path, name (sanitised), length, content of files."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "[^A-Za-z0-9._-]+", "_")
    return spark.read.format("binaryFile").load(path).select("path", name.alias("name"), "length", "content")


def decode_text(raw: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 decodes any bytes")


def docx_text(raw: bytes) -> str:
    """Paragraphs that aren't blank, parted by blank lines."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    texts = ("".join(t.text or "" for t in p.iter(f"{_PARAGRAPH}t")) for p in root.iter(f"{_PARAGRAPH}p"))
    return "\n\n".join(t for t in texts if t.strip())


def json_text(text: str) -> str:
    """JSON indented by two; what is no JSON stays."""
    try:
        return json.dumps(json.loads(text), ensure_ascii=False, indent=2)
    except ValueError:
        return text


def upload_text(name: str, raw: bytes) -> str | None:
    """Text of a file by its suffix: line ends as \\n, no more than three in a row; null for other kinds or broken files."""
    suffix = name.lower().rpartition(".")[2]
    if suffix not in TEXT_SUFFIXES:
        return None
    try:
        text = docx_text(raw) if suffix == "docx" else decode_text(raw)
    except (KeyError, zipfile.BadZipFile, ElementTree.ParseError):
        return None
    if suffix == "json":
        text = json_text(text)
    return re.sub(r"\n{4,}", "\n\n\n", text.replace("\r\n", "\n").replace("\r", "\n"))


def texts(files: DataFrame) -> DataFrame:
    """name, text, chars, words, utf8_bytes of files (name, content)."""

    @F.pandas_udf("string")
    def run(names: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([upload_text(n, bytes(c)) for n, c in zip(names, contents)])

    t = files.select("name", run("name", "content").alias("text"))
    words = F.size(F.filter(F.split("text", "\\s+"), lambda w: w != ""))
    return t.select("name", "text", F.length("text").alias("chars"), words.alias("words"), F.octet_length("text").alias("utf8_bytes"))


def numbered(rows: DataFrame, name: str, by_file: bool) -> DataFrame:
    """rows with their number from 1 as `name`: in their file, or in all files by path, however these are split.

    Only the counts by file and split (a row each) are ordered and joined back, by broadcast if there are at most MAX_SPLITS.
    """
    placed = rows.withColumns({"__file": F.col("_metadata.file_path"), "__at": F.monotonically_increasing_id()}).withColumn("__split", F.shiftright("__at", 33))
    splits = placed.groupBy("__file", "__split").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"))
    order = (Window.partitionBy("__file") if by_file else Window.orderBy("__file")).orderBy("__file", "__split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("__file", "__split", (F.coalesce(F.sum("n").over(order), F.lit(0)) - F.col("first") + 1).alias("__add"))
    # a row for each file of each partition: at most their numbers together
    side = F.broadcast(splits) if rows.rdd.getNumPartitions() + len(rows.inputFiles()) <= MAX_SPLITS else splits
    return placed.join(side, ["__file", "__split"]).withColumn(name, F.col("__at") + F.col("__add")).drop("__file", "__split", "__at", "__add")


def strand_csv(spark: SparkSession, path: str) -> DataFrame:
    """Strand rows with all columns as text, blanks for what is missing, and `no` from No. or the row's place in its file."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True)
    if "No." in rows.columns:
        return rows.fillna("").withColumn("no", F.col("`No.`").try_cast("int"))
    return numbered(rows, "no", by_file=True).fillna("")


def dna_of_strands(rows: DataFrame) -> Column:
    """The first column of SEQUENCE_COLUMNS that a row fills."""
    filled = [F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")) for c in SEQUENCE_COLUMNS if c in rows.columns]
    return D.bases_only(F.coalesce(*filled, F.lit("")))


def message_of_strands(rows: DataFrame, *message: str) -> DataFrame:
    """One row a message (columns that name it; none: all rows are one): strands and their sequences joined in the order of no."""
    parts = rows.select(*message, "no", dna_of_strands(rows).alias("s")).where("s <> ''").groupBy(*message)
    parts = parts.agg(F.count(F.lit(1)).alias("strands"), F.array_sort(F.collect_list(F.struct("no", "s"))).alias("p"))
    return parts.select(*message, "strands", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("dna"))


def reads_text(spark: SparkSession, path: str) -> DataFrame:
    """One read a line: read_id (r and the read's number, six digits or more), seq; other letters go, empty lines too."""
    lines = numbered(spark.read.text(path).where(D.bases_only(F.col("value")) != ""), "__n", by_file=False)
    digits = F.col("__n").cast("string")
    return lines.select(F.concat(F.lit("r"), F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), F.lit("0"))).alias("read_id"), D.bases_only(F.col("value")).alias("seq"))


def fixed_strands(dna: Column, size: int = 120) -> Column:
    """Whole strands of a size: of each line that reaches it, else of the joined text."""
    lines = F.filter(F.transform(F.split(dna, "\n"), D.bases_only), lambda x: F.length(x) >= size)
    cut = lambda x: F.regexp_extract_all(x, F.lit(f"[ACGT]{{{size}}}"), F.lit(0))
    per_line = F.flatten(F.transform(lines, cut))
    return F.when(F.size(lines) > 0, per_line).otherwise(cut(D.bases_only(dna)))


def strand_table(strands: DataFrame) -> DataFrame:
    """Strands under the names of the exported table: preferred columns first, then all others."""
    names = {"no": "No.", "strand_index": "Strand index", "payload": "Payload", "filler": "Filler", "full_strand": "Full strand"}
    df = strands.withColumn("FBR", F.lit(D.FORWARD_PRIMER)).withColumn("RBR", F.lit(D.REVERSE_PRIMER))
    if "filler" not in df.columns:
        df = df.withColumn("filler", F.lit(""))
    df = df.withColumnsRenamed(names)
    return df.select(*[f"`{c}`" for c in STRAND_COLUMNS], *[c for c in df.columns if c not in STRAND_COLUMNS])


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """Nested columns as JSON. bom: every file begins with the mark that has spreadsheets read it as UTF-8."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in df.dtypes]
    names = [("\ufeff" if bom and i == 0 else "") + c for i, c in enumerate(df.columns)]
    df.select(*flat).toDF(*names).write.csv(path, header=True)


def write_dna_files(packages: DataFrame, path: str, keys: list[str], dna: str = "dna") -> None:
    """Sequences and what is needed to read them, apart: lines of key and sequence in `dna`, the other columns as JSON lines in
    `meta`, with the sequence's length and SHA-256. The key is that of JSON, so any columns may be it."""
    key = F.to_json(F.struct(*keys))
    packages.select(F.concat_ws("\t", key, dna).alias("value")).write.text(f"{path}/dna")
    meta = [F.col(c) for c in packages.columns if c != dna]
    packages.select(*meta, key.alias("key"), F.length(dna).alias("dna_length"), F.sha2(dna, 256).alias("dna_sha256")).write.json(f"{path}/meta")


def read_dna_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of `schema`, dna, and whole: whether the sequence has the length and digest that its metadata names.

    Lower case and whatever isn't a base goes, as in any sequence file; metadata without a sequence has dna null and whole false.
    """
    parts = F.split("value", "\t", 2)
    found = spark.read.text(f"{path}/dna").select(F.get(parts, F.lit(0)).alias("key"), D.bases_only(F.get(parts, F.lit(1))).alias("dna"))
    meta = spark.read.schema(f"{schema}, key string, dna_length long, dna_sha256 string").json(f"{path}/meta")
    whole = F.coalesce((F.length("dna") == F.col("dna_length")) & (F.sha2("dna", 256) == F.col("dna_sha256")), F.lit(False))
    return meta.join(found, "key", "left").withColumn("whole", whole).drop("key", "dna_length", "dna_sha256")


def write_reports(path: str, benchmark: DataFrame, inspection: dict[str, DataFrame] | None = None, texts: DataFrame | None = None) -> None:
    """A benchmark's rows and an inspection's tables as CSV, each in its folder, and texts (name, text) as one file a name's folder."""
    write_csv(benchmark, f"{path}/benchmark_results", bom=True)
    for name, rows in (inspection or {}).items():
        write_csv(rows, f"{path}/{name}", bom=True)
    if texts is not None:
        texts.select("name", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("name").text(f"{path}/texts", lineSep="\n")


def cluster_lines(read: DataFrame, order: str = "source_no") -> DataFrame:
    """Lines of a cluster file: CLUSTER n, then its reads; clusters by number."""
    n = F.col(order).try_cast("int")
    head = read.select(n.alias("k")).distinct().select("k", F.lit(0).alias("part"), F.lit("").alias("seq"), F.concat(F.lit("CLUSTER "), F.col("k").cast("string")).alias("value"))
    body = read.select(n.alias("k"), F.lit(1).alias("part"), "seq", F.col("seq").alias("value"))
    return head.unionByName(body).orderBy(F.col("k").asc_nulls_last(), "part", "seq").select("value")


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.col(column).alias("value")).write.text(path)


def shuffled_reads(read: DataFrame, seed: int = 1) -> DataFrame:
    """Reads in an order that a hash of seed and read decides."""
    return read.orderBy(F.xxhash64(F.lit(seed), "seq"), "seq").select(F.col("seq").alias("value"))


def wav_samples(raw: bytes) -> tuple[int, np.ndarray] | None:
    """Rate and mono samples in [-1, 1] of a WAV of 8, 16 or 32 bits."""
    try:
        with wave.open(io.BytesIO(raw)) as w:
            rate, channels, width, frames = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return None
    if width not in (1, 2, 4):
        return None
    x = np.frombuffer(frames, {1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    return rate, x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1)


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def png_bytes(pixels: np.ndarray) -> bytes:
    """PNG of grey (h, w) or RGB (h, w, 3) bytes."""
    h, w = pixels.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((h, 1), dtype=np.uint8), pixels.reshape(h, -1).astype(np.uint8)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def restore(raw: bytes, kind: str | None) -> bytes:
    """The content of a zip (its first file), gzip, xz or bz2; other bytes as they are."""
    import bz2
    import lzma

    try:
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                names = [n for n in z.namelist() if not n.endswith("/")]
                return z.read(names[0]) if names else raw
        return {"gzip": gzip.decompress, "bz2": bz2.decompress, "xz": lzma.decompress}[kind](raw) if kind in ("gzip", "bz2", "xz") else raw
    except (OSError, EOFError, zipfile.BadZipFile, lzma.LZMAError, zlib.error):
        return raw


def fitted(payload: Column, size: Column) -> Column:
    """Binary cut or filled with zero bytes to a size."""
    missing = F.greatest(size - F.octet_length(payload), F.lit(0))
    return F.substring(F.concat(payload, F.unhex(F.repeat(F.lit("00"), missing))), F.lit(1), size)
