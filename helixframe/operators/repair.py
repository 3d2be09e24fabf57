"""Repair of tokens and rows: what is valid, which candidates count, what a repair made of each place; container checks."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dna as D
from ..functions import duck as Q
from ..sources.scratch import written
from ..sources.tables import table
from . import strands as S
from . import tokens as T

# Words that are valid in a language, pieces that are English, a true flag, bases of a direct strand.
WORDS = {
    "en": "^[A-Za-z]+([-'][A-Za-z]+)?$",
    "fr": "^[A-Za-zÀ-ÖØ-öø-ÿ]+([-'][A-Za-zÀ-ÖØ-öø-ÿ]+)?$",
    "vi": "^[A-Za-zÀ-ỹ]+([-'][A-Za-zÀ-ỹ]+)?$",
    "zh": "^[一-鿿]+$",
    "ko": "^[가-힯]+$",
}
ANY_WORD = "^([A-Za-zÀ-ỹ]+|[一-鿿]+|[가-힯]+)$"
SIGNS = "^[^\\p{L}\\p{N}]+$"
ENGLISH_PIECE = "^([A-Za-z]+([-'][A-Za-z]+)?|[0-9]+|[^\\p{L}\\p{N}_\\s])$"
TRUE = ("1", "true", "yes", "y")
DIRECT_LENGTH = 120
LANGUAGE_PENALTY, TOP = 2, 8
TEXT_PRIMER, TEXT_PAYLOAD = "ACACGACGCTCATCCGATCT", 120


def valid_for(token: Column, language: Column) -> Column:
    """Whether a token is a word of the language; signs are of every language, unknown and byte tokens of none."""
    word = F.trim(token)
    out = word.rlike(ANY_WORD)
    for name, pattern in WORDS.items():
        out = F.when(language == name, word.rlike(pattern)).otherwise(out)
    return F.when((word == "") | (word == "[UNK]") | word.contains("<0x"), False).when(word.rlike(SIGNS), True).otherwise(out)


def token_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, and those that are valid in the language of their sentence block, by language."""
    blocks = F.filter(F.split("text", "(?<=[.!?。！？])\\s+|\\n+"), lambda b: F.trim(b) != "")
    df = table(spark, sf_dir, "conversations").select(F.explode(blocks).alias("text"))
    t = T.tokens(df.withColumn("language", T.block_language(F.col("text"))).select("language", "text"))
    return t.groupBy("language").agg(F.count(F.lit(1)).alias("tokens"), F.count_if(valid_for(F.col("token"), F.col("language"))).alias("valid"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_WORD_SQL = "CASE " + " ".join(f"WHEN language = '{n}' THEN regexp_matches(token, {_quoted(p)})" for n, p in WORDS.items()) + f" ELSE regexp_matches(token, {_quoted(ANY_WORD)}) END"
VALIDITY_SQL = f"""WITH l AS ({T.BLOCK_SQL.replace("SELECT conv_id, turn, block_no::INT AS block_no, length(block)::INT AS chars,", "SELECT conv_id, turn, block_no, block,")}),
tokens AS (SELECT language, unnest(regexp_extract_all(block, {_quoted(T.V.TOKEN)})) AS token FROM l)
SELECT language, count(*) AS tokens, count(*) FILTER (regexp_matches(token, {_quoted(SIGNS)}) OR {_WORD_SQL}) AS valid FROM tokens GROUP BY language"""


def admissible(token: Column, english: bool = False) -> Column:
    """Whether a token may repair another: neither special nor empty; if asked for, an English word, a number or a sign."""
    some = ~token.isin("[PAD]", "[UNK]") & (F.trim(token) != "")
    return some & F.trim(token).rlike(ENGLISH_PIECE) if english else some


def repair_admissible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of the documents with what may repair."""
    v = T.vocab_topn(spark, sf_dir)
    return v.select("token_id", "token", admissible(F.col("token")).alias("admissible"), admissible(F.col("token"), True).alias("admissible_en"))


ADMISSIBLE_SQL = f"""WITH {T.DOC_TOKENS}, {T.VOCAB_CTE}
SELECT token_id, token, token NOT IN ('[PAD]', '[UNK]') AS admissible, token NOT IN ('[PAD]', '[UNK]') AND regexp_matches(token, {_quoted(ENGLISH_PIECE)}) AS admissible_en FROM vocab"""


def neighbours(codes: DataFrame, book: DataFrame, language: str | None = None, top: int = TOP) -> DataFrame:
    """noisy, (language,) rank, code_id, candidate, class, hamming, score: the `top` codes within two bits of each distinct code of
    `codes` (noisy), by distance plus a penalty for another language: that of the column `language`, else English. There are
    at most 2**CODE_BITS distinct codes, and a few languages."""
    keys = ["noisy"] + ([language] if language else [])
    own = F.col(language) if language else F.lit("en")
    flips = [1 << i for i in range(T.CODE_BITS)]
    masks = [0, *flips, *[a | b for i, a in enumerate(flips) for b in flips[:i]]]
    probes = codes.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    probes = probes.select(*keys, F.col("noisy").bitwiseXOR(F.col("mask")).alias("probe"), F.bit_count("mask").alias("hamming"))
    found = probes.join(F.broadcast(book.select(F.col("code").alias("probe"), "code_id", F.col("token").alias("candidate"), "class")), "probe")
    found = found.withColumn("score", F.col("hamming") + F.when((F.col("class") == own) | F.col("class").isin("special", "punct", "number"), 0).otherwise(LANGUAGE_PENALTY))
    order = Window.partitionBy(*keys).orderBy("score", "hamming", "code_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(*keys, "rank", "code_id", "candidate", "class", "hamming", "score")


def code_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, book = T._sparse(spark, sf_dir)
    return neighbours(T.noisy_codes(coded), book)


_NEAR_CTE = f"""near AS (SELECT noisy, code_id, token AS candidate, class, bit_count(xor(code, noisy))::INT AS hamming,
  (bit_count(xor(code, noisy)) + CASE WHEN class IN ('en', 'special', 'punct', 'number') THEN 0 ELSE {LANGUAGE_PENALTY} END)::INT AS score FROM (SELECT DISTINCT noisy FROM noisy) JOIN book ON bit_count(xor(code, noisy)) <= 2),
ordered AS (SELECT noisy, (row_number() OVER (PARTITION BY noisy ORDER BY score, hamming, code_id))::INT AS rank, code_id, candidate, class, hamming, score FROM near)"""
NEIGHBOURS_SQL = f"""WITH {T.SPARSE_CTE}, {T.NOISY_CTE}, {_NEAR_CTE} SELECT * FROM ordered WHERE rank <= {TOP}"""


def block_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per token of the sentence blocks of a text: the other columns of df, pos (from 0 in the text), token, language of its block."""
    kept = [c for c in df.columns if c != text]
    blocks = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "(?<=[.!?。！？])\\s+|\\n+"), lambda b: F.trim(b) != "")
    of = lambda b: F.transform(F.regexp_extract_all(b["text"], F.lit(T.V.TOKEN), F.lit(0)), lambda t: F.struct(t.alias("token"), b["language"].alias("language")))
    told = F.transform(blocks, lambda b: F.struct(b.alias("text"), T.block_language(b).alias("language")))
    return df.select(*kept, F.posexplode(F.flatten(F.transform(told, of))).alias("pos", "t")).select(*kept, "pos", "t.*")


def language_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that no token has, with the candidates that the language of the token's sentence block prefers."""
    turns = table(spark, sf_dir, "conversations", spread=True).select("conv_id", "turn", "text")
    book = written(T._sparse(spark, sf_dir)[1].select("code", "code_id", "token", "class"), "sparse-book")
    unknown = book.where("token = '[UNK]'").select(F.col("code").alias("__unk"))  # one row
    coded = block_tokens(turns).join(F.broadcast(book.select("token", "code")), "token", "left").crossJoin(F.broadcast(unknown))
    read = T.noisy_codes(coded.withColumn("code", F.coalesce("code", "__unk")).drop("__unk"))
    wrong = written(read.join(F.broadcast(book.select(F.col("code").alias("noisy"))), "noisy", "left_anti").select("conv_id", "turn", "pos", "language", "noisy"), "invalid-codes")
    return wrong.join(F.broadcast(neighbours(wrong, book, "language")), ["noisy", "language"])  # rows a code and language at most


LANGUAGE_DECODE_SQL = f"""WITH {T.SPARSE_CTE}, l AS ({T.BLOCK_SQL.replace("SELECT conv_id, turn, block_no::INT AS block_no, length(block)::INT AS chars,", "SELECT conv_id, turn, block_no, block,")}),
bt AS (SELECT conv_id, turn, block_no, language, generate_subscripts(x, 1) AS k, unnest(x) AS token FROM (SELECT conv_id, turn, block_no, language, regexp_extract_all(block, {_quoted(T.V.TOKEN)}) AS x FROM l)),
bp AS (SELECT conv_id, turn, language, token, row_number() OVER (PARTITION BY conv_id, turn ORDER BY block_no, k) - 1 AS pos FROM bt),
bc AS (SELECT bp.*, coalesce(book.code, (SELECT code FROM book WHERE token = '[UNK]')) AS code FROM bp LEFT JOIN book ON bp.token = book.token),
{T.NOISY_CTE.replace("FROM coded)", "FROM bc)").replace("SELECT conv_id, turn, pos, token, xor", "SELECT conv_id, turn, pos, token, language, xor")},
wrong AS (SELECT conv_id, turn, pos, language, noisy FROM noisy WHERE noisy NOT IN (SELECT code FROM book)),
near AS (SELECT noisy, language, code_id, token AS candidate, class, bit_count(xor(code, noisy))::INT AS hamming, (bit_count(xor(code, noisy)) + CASE WHEN class = language OR class IN ('special', 'punct', 'number') THEN 0 ELSE {LANGUAGE_PENALTY} END)::INT AS score
  FROM (SELECT DISTINCT noisy, language FROM wrong) JOIN book ON bit_count(xor(code, noisy)) <= 2),
ordered AS (SELECT *, (row_number() OVER (PARTITION BY noisy, language ORDER BY score, hamming, code_id))::INT AS rank FROM near)
SELECT conv_id, turn, pos::INT AS pos, language, noisy, rank, code_id, candidate, class, hamming, score FROM wrong JOIN ordered USING (noisy, language) WHERE rank <= {TOP}"""


def status(failed: Column, accepted: Column, masked: Column, original: Column, decoded: Column) -> Column:
    """What became of a place: Repaired, Unresolved or CRC fail where its check failed, else Decoded, Missing or Changed."""
    broken = F.when(accepted, "Repaired").when(masked, "Unresolved").otherwise("CRC fail")
    return F.when(failed, broken).when(original == decoded, "Decoded").when(decoded.isNull(), "Missing").otherwise("Changed")


def token_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that were not decoded, with the repair that was found for them; one is accepted at one bit if it is admissible."""
    coded, book = T._sparse(spark, sf_dir)
    read = T.noisy_codes(coded)
    known = F.broadcast(book.select(F.col("code").alias("noisy"), F.col("token").alias("decoded")))
    best = neighbours(read, book, top=1).select("noisy", "candidate", ((F.col("score") <= 1) & admissible(F.col("candidate"))).alias("accepted"))
    rows = read.join(known, "noisy", "left").join(F.broadcast(best), "noisy", "left")  # a row per code at most
    accepted = F.coalesce("accepted", F.lit(False))
    rows = rows.withColumn("status", status(F.col("decoded").isNull(), accepted, F.lit(False), F.col("token"), F.col("decoded")))
    return rows.where(F.col("status") != "Decoded").select("conv_id", "turn", "pos", "status", "token", F.when(F.col("status") == "Repaired", F.col("candidate")).otherwise("").alias("repaired_text"))


RECOVERY_SQL = f"""WITH {T.SPARSE_CTE}, {T.NOISY_CTE}, {_NEAR_CTE},
best AS (SELECT noisy, candidate, score <= 1 AND candidate NOT IN ('[PAD]', '[UNK]') AS accepted FROM ordered WHERE rank = 1),
s AS (SELECT conv_id, turn, pos, noisy.token, candidate, CASE WHEN book.token IS NULL THEN CASE WHEN accepted THEN 'Repaired' ELSE 'CRC fail' END WHEN book.token = noisy.token THEN 'Decoded' ELSE 'Changed' END AS status
  FROM noisy LEFT JOIN book ON noisy.noisy = book.code LEFT JOIN best ON best.noisy = noisy.noisy)
SELECT conv_id, turn, pos::INT AS pos, status, token, CASE WHEN status = 'Repaired' THEN candidate ELSE '' END AS repaired_text FROM s WHERE status <> 'Decoded'"""


def direct(flag: Column, column_index: Column, strand: Column) -> Column:
    """Whether a row is a coded strand as it stands: flagged, or with a column index and exactly 120 bases."""
    flagged = F.coalesce(F.lower(F.trim(flag)).isin(*TRUE), F.lit(False))
    return flagged | ((F.coalesce(column_index, F.lit("")) != "") & (F.length(D.bases_only(F.coalesce(strand, F.lit("")))) == DIRECT_LENGTH))


def direct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns' 120-base pieces with flags and column indices that their number decides."""
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", D.simple(F.coalesce("text", F.lit(""))).alias("dna"))
    flag = F.element_at(F.array(F.lit(" TRUE "), F.lit("0"), F.lit("y"), F.lit(""), F.lit(None)), (F.col("no") % 5 + 1).cast("int"))
    column = F.when(F.col("no") % 2 == 0, F.lit("ACGTACGT")).otherwise("")
    return S.split(df, DIRECT_LENGTH).select("conv_id", "turn", "no", direct(flag, column, F.col("payload")).alias("direct"))


DIRECT_SQL = f"""WITH e AS (SELECT conv_id, turn, {Q.simple("coalesce(text, '')")} AS dna FROM conversations),
p AS (SELECT conv_id, turn, no::INT AS no, length(substr(dna, ((no - 1) * 120 + 1)::INT, 120)) AS n FROM e, unnest(range(1, (length(dna) + 119) // 120 + 1)) AS u(no))
SELECT conv_id, turn, no, no % 5 IN (0, 2) OR (no % 2 = 0 AND n = 120) AS direct FROM p"""


def compact(rows: DataFrame, by: list[str], metric: str, order: list[str], keep: list[str]) -> DataFrame:
    """The first row of each kept metric, in the order given."""
    first = Window.partitionBy(*by, metric).orderBy(*order)
    return rows.where(F.col(metric).isin(*keep)).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


KEPT = ["A", "R"]


def metric_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as metric rows: the first line of each kept flag."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return compact(rows, ["l_orderkey"], "l_returnflag", ["l_linenumber", "l_quantity"], KEPT)


COMPACT_SQL = f"""SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem WHERE l_returnflag IN ({str(KEPT)[1:-1]})
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_quantity) = 1"""


def text_strand_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strands of 120 bases with a counter in each turn: number, mean length and GC share, longest run."""
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", D.plain(F.coalesce("text", F.lit(""))).alias("dna"))
    strand = F.concat(F.lit(TEXT_PRIMER), D.base4(F.col("no") - 1, 8), F.col("payload"), F.lit(D.REVERSE_PRIMER))
    s = S.split(df, TEXT_PAYLOAD).where("payload <> ''").select("conv_id", "turn", strand.alias("s"))
    return s.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("num_strands"), F.round(F.avg(F.length("s")), 6).alias("mean_strand_len"), F.round(F.avg(D.gc(F.col("s"))), 6).alias("mean_gc"), F.max(D.longest_run(F.col("s"))).alias("max_homopolymer")
    )


TEXT_STRAND_SQL = f"""WITH e AS (SELECT conv_id, turn, {Q.plain("coalesce(text, '')")} AS dna FROM conversations),
s AS (SELECT conv_id, turn, '{TEXT_PRIMER}' || {Q.base4("no", 8)} || substr(dna, (no * {TEXT_PAYLOAD} + 1)::INT, {TEXT_PAYLOAD}) || '{D.REVERSE_PRIMER}' AS s FROM e, unnest(range(0, (length(dna) + {TEXT_PAYLOAD - 1}) // {TEXT_PAYLOAD})) AS u(no))
SELECT conv_id, turn, count(*) AS num_strands, round(avg(length(s)), 6) AS mean_strand_len, round(avg(length(translate(s, 'AT', '')) / length(s)), 6) AS mean_gc, max(list_max({Q.runs("s")}))::INT AS max_homopolymer FROM s GROUP BY conv_id, turn"""


def bytes_text(n: Column) -> Column:
    """A byte count with its unit; a dash for null. Halves go to the even digit."""
    out = F.format_string("%.2f TB", F.bround(n / F.lit(1024.0**4), 2))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(n < 1024.0 ** (power + 1), F.format_string(f"%.2f {unit}", F.bround(n / F.lit(1024.0**power), 2))).otherwise(out)
    return F.when(n.isNull(), "—").when(n < 1024, F.format_string("%d B", n.cast("long"))).otherwise(out)


def duration_text(seconds: Column) -> Column:
    """Minutes and seconds; a dash for null, zero below zero."""
    s = F.greatest(seconds, F.lit(0.0))
    whole = F.floor(s / 60)
    return F.when(seconds.isNull(), "—").otherwise(F.format_string("%d:%05.2f", whole, s - whole * 60))


def preview(text: Column, n: int = 300) -> Column:
    return F.concat(F.substring(text, 1, n), F.when(F.length(text) > n, "...").otherwise(""))


def formatted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' sizes, reading times at 25 bytes a second, and previews as shown in reports."""
    text = F.coalesce("text", F.lit(""))
    n = F.octet_length(text)
    return table(spark, sf_dir, "documents").select("doc_id", bytes_text(n).alias("size"), bytes_text(n.cast("double") * 1048576).alias("size_mb"), duration_text(n / F.lit(25.0)).alias("duration"), preview(text, 30).alias("preview"))


FORMAT_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, ''))::BIGINT AS n FROM documents)
SELECT doc_id, CASE WHEN n < 1024 THEN printf('%d B', n) ELSE printf('%.2f KB', n / 1024) END AS size, CASE WHEN n = 0 THEN '0 B' WHEN n < 1024 THEN printf('%.2f MB', n::DOUBLE) ELSE printf('%.2f GB', n / 1024) END AS size_mb,
printf('%d:%05.2f', n // 1500, (n % 1500) / 25) AS duration, substr(text, 1, 30) || CASE WHEN length(text) > 30 THEN '...' ELSE '' END AS preview FROM d"""


def member_kind(names: list[str]) -> str:
    """Kind of a ZIP archive by its members' names."""
    folders = {"word": "docx", "ppt": "pptx", "xl": "xlsx"}
    if "[Content_Types].xml" in names:
        for folder, kind in folders.items():
            if any(n.startswith(folder + "/") for n in names):
                return kind
        if "mimetype" in names and any(n.startswith("META-INF/") for n in names):
            return "epub"
    return "zip"


def container(payload: Column, kind: Column) -> Column:
    """Struct kind (ZIP archives by their members), valid: whether the container opens and its sums hold. Other kinds count as valid."""

    def check(data: bytes, kind: str):
        try:
            if kind == "zip":
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    return member_kind(z.namelist()), z.testzip() is None
            {"gzip": gzip.decompress, "xz": lzma.decompress, "bz2": bz2.decompress}.get(kind, bytes)(data)
            return kind, True
        except Exception:  # whatever a damaged container raises, it is not valid  # noqa: BLE001
            return kind, False

    @F.pandas_udf("kind string, valid boolean")
    def run(payloads: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([check(bytes(p), k) for p, k in zip(payloads, kinds)], columns=["kind", "valid"])

    return run(payload, kind)


# Name: kind that its signature says, kind by members, valid.
CONTAINERS = {"gzip": ("gzip", "gzip", True), "gzip cut": ("gzip", "gzip", False), "xz": ("xz", "xz", True), "bz2": ("bz2", "bz2", True), "zip": ("zip", "zip", True), "docx": ("zip", "docx", True), "xlsx": ("zip", "xlsx", True), "zip damaged": ("zip", "zip", False), "text": ("text", "text", True)}


def _pack(text: Column, name: Column) -> Column:
    def archive(data: bytes, *names: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, data)
        return out.getvalue()

    makers = {
        "gzip": gzip.compress,
        "gzip cut": lambda d: gzip.compress(d)[:-6],
        "xz": lzma.compress,
        "bz2": bz2.compress,
        "zip": lambda d: archive(d, "a.txt"),
        "docx": lambda d: archive(d, "[Content_Types].xml", "word/document.xml"),
        "xlsx": lambda d: archive(d, "[Content_Types].xml", "xl/workbook.xml"),
        "zip damaged": lambda d: archive(d, "a.txt")[: -(22 + len("a.txt"))],
        "text": bytes,
    }
    @F.pandas_udf("binary")
    def run(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([makers[n](t.encode()) for t, n in zip(texts, names)])

    return run(text, name)


def container_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts in whole and damaged containers, checked."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text"), F.explode(F.array(*[F.struct(F.lit(n).alias("container"), F.lit(k).alias("sniffed")) for n, (k, _, _) in CONTAINERS.items()])).alias("c"))
    packed = b.select("item_id", "c.*", _pack(F.col("text"), F.col("c.container")).alias("payload"))
    return packed.select("item_id", "container", container(F.col("payload"), F.col("sniffed")).alias("r")).select("item_id", "container", "r.*")


CONTAINER_SQL = f"""SELECT item_id, v.* FROM benchmark, (VALUES {", ".join(f"('{n}', '{k}', {ok})" for n, (_, k, ok) in CONTAINERS.items())}) AS v(container, kind, valid)"""

QUERIES = {
    "token_language_validity": (token_validity, VALIDITY_SQL),
    "repair_admissible": (repair_admissible, ADMISSIBLE_SQL),
    "code_neighbours": (code_neighbours, NEIGHBOURS_SQL),
    "token_language_decode": (language_decode, LANGUAGE_DECODE_SQL),
    "token_recovery": (token_recovery, RECOVERY_SQL),
    "direct_rows": (direct_rows, DIRECT_SQL),
    "metric_compact": (metric_compact, COMPACT_SQL),
    "text_strand_summary": (text_strand_summary, TEXT_STRAND_SQL),
    "formatted_values": (formatted_values, FORMAT_SQL),
    "container_checks": (container_checks, CONTAINER_SQL),
}
