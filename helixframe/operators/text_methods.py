"""Text methods as packages: built, stored behind a mapping, restored, and compared at rates of substitutions.

The methods are raw UTF-8, zlib, fixed-width token ids and sparse even-parity codes. A package is a text's codec sequence, the
number of its bits, and these as whole bytes, which any mapping of bytes stores. The vocabulary is that of the whole table, written
once and bounded by its limit, so decoding looks ids up in one array of literals and takes no join.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna as D
from ..functions import draws as R
from ..functions import duck as Q
from ..sources.files import read_dna_files, write_dna_files
from ..sources.scratch import new_path, written
from ..sources.tables import table
from . import noise as N
from . import tokens as T

# The methods' keys with the bits of a unit that is right or wrong as a whole, and the rates compared.
WIDTHS = {"A_RAW_UTF8": 8, "B_ZLIB": 0, "C_DENSE_TOKEN": 12, "D_SPARSE_SEMANTIC": T.CODE_BITS}
RATES = (0.01, 0.02, 0.05, 0.10)
#: What SQL can say as well.
PLAIN = ("A_RAW_UTF8", "C_DENSE_TOKEN", "D_SPARSE_SEMANTIC")
UNKNOWN = "[UNK]"
_TWO_BITS = np.zeros(256, dtype=np.int64)
_TWO_BITS[list(D.BASES.encode())] = range(4)


def dna_bits(dna: Column) -> Column:
    out = dna
    for i, base in enumerate(D.BASES):
        out = F.replace(out, F.lit(base), F.lit(f"{i:02b}"))
    return out


def bits_dna(bits: Column) -> Column:
    """An odd bit is padded with 0."""
    return D.bit_pairs(F.concat(bits, F.repeat(F.lit("0"), F.length(bits) % 2)), D.BASES)


def _bits(dna: str) -> np.ndarray:
    two = _TWO_BITS[np.frombuffer(dna.encode(), dtype=np.uint8)]
    return np.stack([two >> 1, two & 1], axis=1).reshape(-1)


def _numbers(dna: str, n: int, width: int) -> np.ndarray:
    """The first n numbers of so many bits."""
    return _bits(dna)[: n * width].reshape(n, width) @ (1 << np.arange(width - 1, -1, -1))


class Codecs:
    """The four methods over one table's vocabulary."""

    def __init__(self, texts: DataFrame, text: str = "text", limit: int = T.VOCABULARY) -> None:
        spark = texts.sparkSession
        dense = written(T.vocabulary(T.tokens(texts.select(text), text), limit), "vocabulary")
        sparse = T.semantic_ids(dense).join(T.parity_codebook(spark, ""), "code_id")
        self.text = text
        self.book = written(dense.join(sparse.select("token", "code"), "token"), "codec-book")
        rows = self.book.collect()  # at most `limit`, a parameter
        tokens = {r.token_id: r.token for r in rows}
        codes = {r.code: r.token for r in rows}
        self.unknown = next((r.token_id, r.code) for r in rows if r.token == UNKNOWN)
        #: numbers as they are where they have a token, else the unknown one's
        self.known = {
            "C_DENSE_TOKEN": np.array([i if tokens.get(i) else self.unknown[0] for i in range(1 << WIDTHS["C_DENSE_TOKEN"])]),
            "D_SPARSE_SEMANTIC": np.array([i if codes.get(i) else self.unknown[1] for i in range(1 << T.CODE_BITS)]),
        }
        numbered = {"C_DENSE_TOKEN": [tokens.get(i) for i in range(1 << WIDTHS["C_DENSE_TOKEN"])], "D_SPARSE_SEMANTIC": [codes.get(i) for i in range(1 << T.CODE_BITS)]}
        self.by_id, self.by_code = map(self._literal, numbered.values())
        self.words = {m: [t or UNKNOWN for t in own] for m, own in numbered.items()}

    @staticmethod
    def _literal(tokens: list[str | None]) -> Column:
        """Tokens at their numbers; the empty string, which is no token, where there is none."""
        return F.split(F.lit("\x00".join(t or "" for t in tokens)), "\x00")

    def _token_dna(self, texts: DataFrame, keys: list[str]) -> DataFrame:
        """keys, tokens, dense, sparse: the two methods' sequences, from one pass over the tokens; their units are made once a word."""
        unit = lambda c, width: F.lpad(F.bin(c), width, "0")
        units = lambda i, code: (bits_dna(unit(i, WIDTHS["C_DENSE_TOKEN"])).alias("dense"), unit(code, T.CODE_BITS).alias("sparse"))
        book = self.book.select("token", F.struct(*units(F.col("token_id"), F.col("code"))).alias("unit"))
        unknown = F.struct(*units(*map(F.lit, self.unknown)))
        coded = T.tokens(texts.select(*keys, self.text), self.text).join(F.broadcast(book), "token", "left")
        one = F.struct("pos", F.coalesce("unit", unknown).alias("unit"))
        listed = coded.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("l"))  # a text's tokens, no more
        join = lambda f: F.array_join(F.transform("l", lambda x: x["unit"][f]), "")
        return listed.select(*keys, F.size("l").alias("tokens"), join("dense").alias("dense"), bits_dna(join("sparse")).alias("sparse"))

    def packages(self, texts: DataFrame, keys: list[str], methods: tuple[str, ...] = tuple(WIDTHS)) -> DataFrame:
        """keys, text, method, tokens, codec_dna, codec_bits (their number), payload, and the sizes; a row a text and method."""

        @F.pandas_udf("binary")
        def packed(t: pd.Series) -> pd.Series:
            return t.map(lambda x: zlib.compress(x.encode(), 6))

        text = F.coalesce(F.col(self.text), F.lit(""))
        # as many tasks as there are cores at least: what follows costs more than a partition's size tells
        n = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), texts.sparkSession.sparkContext.defaultParallelism)
        rows = texts.select(*keys, text.alias("text")).repartition(n, *keys)
        rows = rows.join(self._token_dna(rows.withColumnRenamed("text", self.text), keys), keys, "left")
        of = lambda dna: (dna, D.whole_bytes(dna))
        raw, dense, sparse = F.col("text").cast("binary"), F.coalesce("dense", F.lit("")), F.coalesce("sparse", F.lit(""))
        stored = {"A_RAW_UTF8": (D.plain(raw), raw), "C_DENSE_TOKEN": of(dense), "D_SPARSE_SEMANTIC": of(sparse)}
        if "B_ZLIB" in methods:
            rows = rows.withColumn("packed", packed("text"))
            stored["B_ZLIB"] = D.plain(F.col("packed")), F.col("packed")
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), stored[m][0].alias("codec_dna"), stored[m][1].alias("payload")) for m in methods]))
        rows = rows.select(*keys, "text", F.coalesce("tokens", F.lit(0)).alias("tokens"), each.alias("m")).select(*keys, "text", "tokens", "m.*")
        bases, raw = F.length("codec_dna"), F.octet_length("text") * 4
        return rows.select(
            *keys, "text", "method", "tokens", "codec_dna", (2 * bases).alias("codec_bits"), "payload",
            raw.alias("raw_bases"), D.rounded(bases / F.greatest(raw, F.lit(1)), 6).alias("ratio_to_raw"),
            D.rounded((1 - bases / F.greatest(raw, F.lit(1))) * 100, 4).alias("reduction_percent"),
        )

    def units(self, method: Column, dna: Column, tokens: Column) -> Column:
        """What a codec sequence says: bytes in hexadecimal, or tokens (unknown ones as such); zlib has none."""
        def listed(width: int, bits: Column, value) -> Column:
            places = F.when(tokens > 0, F.sequence(F.lit(0), (tokens - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda i: value(F.substring(bits, i * width + 1, F.lit(width))))

        at = lambda book: lambda b: F.coalesce(F.nullif(F.get(book, F.conv(b, 2, 10).cast("int")), F.lit("")), F.lit(UNKNOWN))
        bits = dna_bits(dna)
        out = F.when(method == "A_RAW_UTF8", F.regexp_extract_all(F.hex(D.whole_bytes(dna)), F.lit("[0-9A-F]{2}"), F.lit(0)))
        out = out.when(method == "C_DENSE_TOKEN", D.let(bits, lambda b: listed(WIDTHS["C_DENSE_TOKEN"], b, at(self.by_id))))
        return out.when(method == "D_SPARSE_SEMANTIC", D.let(bits, lambda b: listed(T.CODE_BITS, b, at(self.by_code))))

    def right_units(self, method: Column, sent: Column, got: Column, tokens: Column) -> Column:
        """Struct (units, right, unknown): the units of a sequence, those that another of its length says as well, and the latter's
        unknown tokens (of the sparse method); numbers of no token are the unknown one. Null for zlib, which has no units."""
        widths, known, unknown = WIDTHS, self.known, self.unknown[1]

        def one(m: str, a: str, b: str, n: int) -> tuple:
            if not widths[m]:
                return None, None, None
            n = len(a) // 4 if m == "A_RAW_UTF8" else n
            x, y = (_numbers(dna, n, widths[m]) for dna in (a, b))
            if m in known:
                x, y = known[m][x], known[m][y]
            return n, int(np.count_nonzero(x == y)), int(np.count_nonzero(y == unknown)) if m == "D_SPARSE_SEMANTIC" else 0

        @F.pandas_udf("units int, right int, unknown int")
        def right(m: pd.Series, a: pd.Series, b: pd.Series, n: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([one(*row) for row in zip(m, a, b, n)], columns=["units", "right", "unknown"], dtype="Int32")

        return right(method, sent, got, tokens)

    def decode(self, method: Column, dna: Column, tokens: Column) -> Column:
        """Text of a codec sequence; bytes that aren't UTF-8 become the replacement character, a broken zlib stream null."""

        @F.pandas_udf("string")
        def inflated(payloads: pd.Series) -> pd.Series:
            def one(raw):
                try:
                    return zlib.decompress(bytes(raw)).decode("utf-8", "replace")
                except zlib.error:
                    return None

            return payloads.map(one, na_action="ignore")

        payload = D.whole_bytes(dna)
        out = F.when(method == "A_RAW_UTF8", F.make_valid_utf8(payload.cast("string")))
        return out.when(method == "B_ZLIB", inflated(F.when(method == "B_ZLIB", payload))).otherwise(self._said(method, dna, tokens))

    def _said(self, method: Column, dna: Column, tokens: Column) -> Column:
        """Text of a token method's sequence, as `tokens.detokenize` puts its units together; null for the other methods.

        A sequence's numbers are read, and its words joined, at once: a substring or concatenation for each token would go over
        the whole text every time. Tokens behind the sequence's end are unknown, one that it breaks off has the bits that are there.
        """
        widths, words = {m: WIDTHS[m] for m in self.words}, self.words

        def one(table: dict, m: str, dna: str | None, n: int) -> str | None:
            if m not in widths:
                return None
            plain, spaced, closing, glue, unknown = table[m]
            dna, n, width = dna or "", max(0, int(n)), widths[m]
            whole = min(n, 2 * len(dna) // width)
            at = _numbers(dna, whole, width)
            if whole < n:
                rest = _bits(dna)[whole * width :]
                cut = [int(rest @ (1 << np.arange(len(rest))[::-1]))] if len(rest) else []
                at = np.concatenate([at, cut, np.full(n - whole - len(cut), unknown)]).astype(np.int64)
            space = ~closing[at]
            space[:1] = False
            space[1:] &= ~glue[at[:-1]]
            return "".join(np.where(space, spaced[at], plain[at])).strip(" ")

        def tables() -> dict:
            out = {}
            for m, own in words.items():
                own = [*own, UNKNOWN]  # the last one is that of no number
                closing, glue = (np.array([bool(re.search(p, t)) for t in own]) for p in (r"^[.,;:!?)\]}]$", r"^[(\[{]$|[一-鿿]"))
                out[m] = np.array(own, dtype=object), np.array([" " + t for t in own], dtype=object), closing, glue, len(own) - 1
            return out

        @F.pandas_udf("string")
        def said(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            table = tables()
            for m, dna, n in batches:
                yield pd.Series([one(table, *row) for row in zip(m, dna, n)], dtype=object)

        return said(method, F.when(method.isin(*widths), dna), F.coalesce(tokens, F.lit(0)))


def restored(packages: DataFrame) -> DataFrame:
    """packages with mapped_dna (the payload behind the Simple mapping) and restored_dna, the codec sequence that comes back from it."""
    mapped = packages.withColumn("mapped_dna", D.simple(F.col("payload")))
    bytes_ = F.substring(D.unsimple(F.col("mapped_dna")), F.lit(1), F.octet_length("payload"))  # the empty payload comes back as a byte
    return mapped.withColumn("restored_dna", F.substring(D.plain(bytes_), F.lit(1), (F.col("codec_bits") / 2).cast("int")))


def noisy_at(packages: DataFrame, keys: list[str], rates: tuple[float, ...] = RATES) -> DataFrame:
    """packages at each error_rate: noisy_dna, substituted. One draw a base serves all rates, so errors at a rate are among those at a higher one."""

    def work(part, prefixes, bases, lengths):
        u, other, at = np.empty(len(bases), dtype=np.uint32), bases.copy(), 0
        for seq, _, (first, second, _, _) in R.digests(prefixes, lengths):
            own = slice(at, at + len(seq))
            u[own] = first
            hit = first < N._bound(max(rates))
            other[own][hit] = N._other(bases[own][hit], second[hit])
            at = own.stop
        starts = np.concatenate([[0], np.cumsum(lengths)])
        for rate in rates:
            hit = u < N._bound(rate)
            counts = np.diff(np.concatenate([[0], np.cumsum(hit)])[starts]).astype(np.int32)
            yield N._with(part, error_rate=pa.array(np.full(len(part), rate)), noisy_dna=R.to_strings(np.where(hit, other, bases), lengths), substituted=pa.array(counts))

    drawn = packages.withColumn("__drawn", F.col("codec_dna"))
    schema = N._schema(drawn, "__drawn", "error_rate double, noisy_dna string, substituted int")
    return N._by_batch(drawn, [*keys, "method"], "__drawn", schema, work, N.SEED)


def compared(codecs: Codecs, noisy: DataFrame, keys: list[str]) -> DataFrame:
    """method, error_rate and the sums of the benchmark: bases, substitutions, units and those that come back right."""
    rows = noisy.select(
        "method", "error_rate", "substituted", F.length("codec_dna").cast("long").alias("bases"), "raw_bases",
        codecs.right_units(F.col("method"), F.col("codec_dna"), F.col("noisy_dna"), F.col("tokens")).alias("u"),
    ).select("*", "u.*")
    by = rows.groupBy("method", "error_rate").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("bases").alias("dna_bases"), F.sum("substituted").alias("substituted_bases"), F.sum("raw_bases").alias("raw"),
        F.sum("units").alias("units"), F.sum("right").alias("right_units"), F.sum("unknown").alias("unknown_units"), F.count_if(F.col("right") == F.col("units")).alias("same_texts"),
    )
    return by.select(
        "method", "error_rate", "texts", "dna_bases", "substituted_bases", D.rounded(F.col("substituted_bases") / F.greatest("dna_bases", F.lit(1)), 6).alias("actual_rate"),
        D.rounded(F.col("dna_bases") / F.greatest("raw", F.lit(1)), 6).alias("ratio_to_raw"), D.rounded((1 - F.col("dna_bases") / F.greatest("raw", F.lit(1))) * 100, 4).alias("reduction_percent"),
        "units", "right_units", "unknown_units", "same_texts", D.rounded(F.col("right_units") / F.greatest("units", F.lit(1)), 6).alias("unit_accuracy"),
    )


KEYS = ["conv_id", "turn"]


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(*KEYS, "text")


def text_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of the conversations' turns by the methods that SQL can say."""
    turns = _turns(spark, sf_dir)
    made = Codecs(turns).packages(turns, KEYS, PLAIN)
    return made.select(*KEYS, "method", "tokens", F.length("codec_dna").alias("codec_bases"), "codec_bits", F.octet_length("payload").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), "raw_bases", "ratio_to_raw", "reduction_percent")


def text_package_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages stored behind the Simple mapping and decoded again."""
    turns = _turns(spark, sf_dir)
    codecs = Codecs(turns)
    back = restored(codecs.packages(turns, KEYS, PLAIN))
    text = codecs.decode(F.col("method"), F.col("restored_dna"), F.col("tokens"))
    return back.select(*KEYS, "method", F.length("mapped_dna").alias("mapped_bases"), (F.col("restored_dna") == F.col("codec_dna")).alias("same_sequence"), F.md5(text).alias("decoded_md5"), F.length(text).alias("decoded_chars"))


def text_package_zlib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zlib method's packages, decoded from the stored payload and after one substitution."""
    turns = _turns(spark, sf_dir)
    codecs = Codecs(turns)
    back = restored(codecs.packages(turns, KEYS, ("B_ZLIB",)))
    other = F.concat(F.translate(F.substring("restored_dna", 1, 1), "ACGT", "CGTA"), F.substring("restored_dna", F.lit(2), F.length("restored_dna")))
    text, broken = (codecs.decode(F.col("method"), x, F.col("tokens")) for x in (F.col("restored_dna"), other))
    return back.select(*KEYS, F.length("codec_dna").alias("codec_bases"), "ratio_to_raw", (text == F.col("text")).alias("same"), broken.isNull().alias("decode_failed"))


def text_method_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Method by error rate over the conversations' turns."""
    turns = _turns(spark, sf_dir)
    codecs = Codecs(turns)
    made = codecs.packages(turns, KEYS, PLAIN).select(*KEYS, "method", "tokens", "codec_dna", "raw_bases")
    return compared(codecs, noisy_at(made, KEYS), KEYS)


def dna_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages written as sequence and metadata files, read again, and decoded from these alone."""
    turns = _turns(spark, sf_dir)
    codecs = Codecs(turns)
    path = new_path(spark, "dna-files")
    made = codecs.packages(turns, KEYS, PLAIN).select(*KEYS, "method", "tokens", "codec_bits", "codec_dna")
    write_dna_files(made, path, [*KEYS, "method"], "codec_dna")
    back = read_dna_files(spark, path, "conv_id long, turn long, method string, tokens int, codec_bits int")
    text = codecs.decode(F.col("method"), F.col("dna"), F.col("tokens"))
    return back.select(*KEYS, "method", (F.length("dna") * 2 == F.col("codec_bits")).alias("bits_match"), "whole", F.md5(text).alias("decoded_md5"))


_CODED = f"""{T.SPARSE_CTE},
dense AS (SELECT conv_id, turn, count(*) AS n, string_agg(lpad(bin(coalesce(token_id, 1)), 12, '0'), '' ORDER BY pos) AS bits FROM tokens LEFT JOIN vocab USING (token) GROUP BY conv_id, turn),
sparse AS (SELECT conv_id, turn, string_agg(lpad(bin(code), {T.CODE_BITS}, '0'), '' ORDER BY pos) AS bits FROM coded GROUP BY conv_id, turn),
m AS (SELECT conv_id, turn, text, coalesce(n, 0) AS tokens, 'A_RAW_UTF8' AS method, {Q.bits("text")} AS b FROM conversations LEFT JOIN dense USING (conv_id, turn)
  UNION ALL SELECT conv_id, turn, text, coalesce(n, 0), 'C_DENSE_TOKEN', coalesce(bits, '') FROM conversations LEFT JOIN dense USING (conv_id, turn)
  UNION ALL SELECT conv_id, turn, text, coalesce(n, 0), 'D_SPARSE_SEMANTIC', coalesce(sparse.bits, '') FROM conversations LEFT JOIN dense USING (conv_id, turn) LEFT JOIN sparse USING (conv_id, turn)),
package AS (SELECT conv_id, turn, text, tokens, method, b || repeat('0', length(b) % 2) AS bits, 4 * strlen(text) AS raw FROM m)"""
_PADDED = "(bits || repeat('0', (8 - length(bits) % 8) % 8))"
_PAYLOAD_DNA = T._TO_DNA.format(b=_PADDED)
PACKAGES_SQL = f"""WITH {_CODED}
SELECT conv_id, turn, method, tokens::INT AS tokens, (length(bits) // 2)::INT AS codec_bases, length(bits)::INT AS codec_bits, (length({_PADDED}) // 8)::INT AS payload_bytes,
sha256(unhex({Q.unplain_hex(_PAYLOAD_DNA)})) AS payload_sha256, raw::INT AS raw_bases, round(length(bits) / 2 / greatest(raw, 1), 6) AS ratio_to_raw, round((1 - length(bits) / 2 / greatest(raw, 1)) * 100, 4) AS reduction_percent FROM package"""

_NO_SPACE = "pos > 0 AND NOT regexp_matches(token, '^[.,;:!?)\\]}}]$') AND NOT regexp_matches(lag(token) OVER (PARTITION BY conv_id, turn ORDER BY pos), '^[(\\[{{]$|[一-鿿]')".replace("{{", "{").replace("}}", "}")
DECODE_SQL = f"""WITH {_CODED},
known AS (SELECT conv_id, turn, pos, coalesce(vocab.token, '[UNK]') AS token FROM tokens LEFT JOIN vocab USING (token)),
spaced AS (SELECT conv_id, turn, pos, token, CASE WHEN {_NO_SPACE} THEN ' ' ELSE '' END AS sp FROM known),
said AS (SELECT conv_id, turn, string_agg(sp || token, '' ORDER BY pos) AS said FROM spaced GROUP BY conv_id, turn),
d AS (SELECT conv_id, turn, method, CASE WHEN method = 'A_RAW_UTF8' THEN text ELSE coalesce(said, '') END AS t, {_PADDED} AS p FROM package LEFT JOIN said USING (conv_id, turn))
SELECT conv_id, turn, method, (CASE WHEN p = '' THEN 2 ELSE length(p) // 2 + 1 END)::INT AS mapped_bases, true AS same_sequence, md5(t) AS decoded_md5, length(t)::INT AS decoded_chars FROM d"""

_KM = "conv_id || '|' || turn || '|' || method || '|' || pos"
BENCHMARK_SQL = f"""WITH {_CODED},
bases AS (SELECT conv_id, turn, method, tokens, raw, bits, pos, substr(bits, 2 * pos - 1, 2) AS pair FROM package, unnest(range(1, length(bits) // 2 + 1)) AS u(pos)),
draws AS (SELECT *, {Q.uniform(N.SEED, _KM, 1)} AS u, {Q.uniform(N.SEED, _KM, 9)} AS v FROM bases),
rates AS (SELECT unnest({list(RATES)})::DOUBLE AS error_rate, unnest({[N._bound(r) for r in RATES]}) AS bound),
noisy AS (SELECT conv_id, turn, method, error_rate, any_value(tokens) AS tokens, any_value(raw) AS raw, any_value(bits) AS bits, count(*) AS n, count(*) FILTER (u < bound) AS subs,
  string_agg(CASE WHEN u < bound THEN lpad(bin((('0b' || pair)::INT + 1 + v % 3) % 4), 2, '0') ELSE pair END, '' ORDER BY pos) AS got FROM draws, rates GROUP BY conv_id, turn, method, error_rate),
empty AS (SELECT method, error_rate, count(*) AS texts FROM package, rates GROUP BY ALL),
w AS (SELECT *, CASE method WHEN 'A_RAW_UTF8' THEN 8 WHEN 'C_DENSE_TOKEN' THEN 12 ELSE {T.CODE_BITS} END AS width FROM noisy),
un AS (SELECT conv_id, turn, method, error_rate, k, substr(bits, k * width + 1, width) AS a, substr(got, k * width + 1, width) AS b FROM w, unnest(range(CASE WHEN method = 'A_RAW_UTF8' THEN length(bits) // 8 ELSE tokens END)) AS u(k)),
j AS (SELECT un.*, CASE method WHEN 'A_RAW_UTF8' THEN un.a = un.b WHEN 'C_DENSE_TOKEN' THEN coalesce(va.token, '[UNK]') = coalesce(vb.token, '[UNK]') ELSE coalesce(ba.token, '[UNK]') = coalesce(bb.token, '[UNK]') END AS ok,
  method = 'D_SPARSE_SEMANTIC' AND coalesce(bb.token, '[UNK]') = '[UNK]' AS unk FROM un
  LEFT JOIN vocab va ON method = 'C_DENSE_TOKEN' AND va.token_id = ('0b' || un.a)::INT LEFT JOIN vocab vb ON method = 'C_DENSE_TOKEN' AND vb.token_id = ('0b' || un.b)::INT
  LEFT JOIN book ba ON method = 'D_SPARSE_SEMANTIC' AND ba.code = ('0b' || un.a)::INT LEFT JOIN book bb ON method = 'D_SPARSE_SEMANTIC' AND bb.code = ('0b' || un.b)::INT),
per AS (SELECT conv_id, turn, method, error_rate, count(*) AS units, count(*) FILTER (ok) AS good, count(*) FILTER (unk) AS unk FROM j GROUP BY ALL),
x AS (SELECT w.method, w.error_rate, sum(n) AS bases, sum(subs) AS subs, sum(raw) AS raw, sum(units) AS units, sum(good) AS good, sum(unk) AS unk, count(*) FILTER (good < units) AS bad FROM w LEFT JOIN per USING (conv_id, turn, method, error_rate) GROUP BY ALL),
r AS (SELECT method, error_rate, sum(raw) AS raw FROM package, rates GROUP BY ALL)
SELECT method, error_rate, texts, bases::BIGINT AS dna_bases, subs::BIGINT AS substituted_bases, round(subs / greatest(bases, 1), 6) AS actual_rate, round(bases / greatest(r.raw, 1), 6) AS ratio_to_raw,
round((1 - bases / greatest(r.raw, 1)) * 100, 4) AS reduction_percent, units::BIGINT AS units, good::BIGINT AS right_units, unk::BIGINT AS unknown_units, (texts - bad)::BIGINT AS same_texts, round(good / greatest(units, 1), 6) AS unit_accuracy
FROM x JOIN empty USING (method, error_rate) JOIN r USING (method, error_rate)"""

QUERIES = {
    "text_packages": (text_packages, PACKAGES_SQL),
    "text_package_decode": (text_package_decode, DECODE_SQL),
    "text_package_zlib": (text_package_zlib, None),
    "dna_file_roundtrip": (dna_file_roundtrip, f"SELECT conv_id, turn, method, true AS bits_match, true AS whole, decoded_md5 FROM ({DECODE_SQL})"),
    "text_method_benchmark": (text_method_benchmark, BENCHMARK_SQL),
}
