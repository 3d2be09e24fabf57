"""Token-level text coding: tokens, language classes, vocabularies, dense and sparse codes, candidates, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dna as D
from ..functions import duck as Q
from ..functions import words as V
from ..sources.scratch import written
from ..sources.tables import table

# Tokens of the vocabulary, bits of a sparse code, candidates kept, and the penalty of another language.
VOCABULARY, CODE_BITS, TOP, PENALTY = 4096, 13, 8, 2
CODE_ERROR = 0.02
SEED = 11


def _sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per token: the other columns of df, pos (from 0), token."""
    kept = [c for c in df.columns if c != text]
    return df.select(*kept, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(V.TOKEN), F.lit(0))).alias("pos", "token"))


def language_class(token: Column) -> Column:
    """special, number, punct, zh, ko, vi, fr or en."""
    return (
        F.when(token.isin("[PAD]", "[UNK]"), "special")
        .when(token.rlike("^[0-9]+$"), "number")
        .when(token.rlike("^[^A-Za-z0-9À-ÖØ-öø-ỹ一-鿿가-힯]+$"), "punct")
        .when(token.rlike("^[一-鿿]+$"), "zh")
        .when(token.rlike("^[가-힯]+$"), "ko")
        .when(token.rlike(f"[{V.VIETNAMESE}]"), "vi")
        .when(F.lower(token).isin(*V.FRENCH_CUES) | token.rlike(f"[{V.FRENCH}]"), "fr")
        .otherwise("en")
    )


_CLASS_SQL = f"""CASE WHEN token IN ('[PAD]', '[UNK]') THEN 'special' WHEN regexp_matches(token, '^[0-9]+$') THEN 'number'
WHEN regexp_matches(token, '^[^A-Za-z0-9À-ÖØ-öø-ỹ一-鿿가-힯]+$') THEN 'punct' WHEN regexp_matches(token, '^[一-鿿]+$') THEN 'zh'
WHEN regexp_matches(token, '^[가-힯]+$') THEN 'ko' WHEN regexp_matches(token, '[{V.VIETNAMESE}]') THEN 'vi'
WHEN lower(token) IN ({_sql_list(V.FRENCH_CUES)}) OR regexp_matches(token, '[{V.FRENCH}]') THEN 'fr' ELSE 'en' END"""


def _tokens_sql(keys: str, name: str) -> str:
    pattern = V.TOKEN.replace("'", "''")
    return f"tokens AS (SELECT {keys}, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS token FROM (SELECT {keys}, regexp_extract_all(text, '{pattern}') AS l FROM {name}))"


DOC_TOKENS = _tokens_sql("doc_id", "documents")
TURN_TOKENS = _tokens_sql("conv_id, turn", "conversations")


def tokens_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted within the row; rows of one doc_id meet with a text's distinct tokens only."""
    docs = table(spark, sf_dir, "documents", spread=True).select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(V.TOKEN), F.lit(0)).alias("l"))
    own = docs.select(
        "doc_id", F.size("l").cast("long").alias("tokens"), F.array_distinct("l").alias("own"), F.try_element_at("l", F.lit(-1)).alias("last"), F.length(F.array_join("l", "")).cast("long").alias("chars")
    )
    distinct = F.array_distinct(F.flatten(F.collect_list("own")))  # the tokens of one document
    return own.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.size(distinct).cast("long").alias("distinct_tokens"), F.max_by("last", "tokens").alias("last_token"), F.sum("chars").alias("chars")).where("tokens > 0")


TOKENS_SQL = f"WITH {DOC_TOKENS} SELECT doc_id, count(*) AS tokens, count(DISTINCT token) AS distinct_tokens, arg_max(token, pos) AS last_token, sum(length(token))::BIGINT AS chars FROM tokens GROUP BY doc_id"


def tokens_language_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language's equal tokens are counted first, so each distinct one is classified once."""
    t = tokens(table(spark, sf_dir, "documents", spread=True).select("lang", "text"))
    counted = t.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("lang", language_class(F.col("token")).alias("class")).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("distinct_tokens"))


CLASS_SQL = f"WITH {DOC_TOKENS} SELECT lang, {_CLASS_SQL} AS class, count(*) AS tokens, count(DISTINCT token) AS distinct_tokens FROM tokens JOIN documents USING (doc_id) GROUP BY ALL"


def block_language(text: Column) -> Column:
    """Language of a block by shares of script characters, then cue words."""
    total = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / total
    words = F.regexp_extract_all(F.lower(text), F.lit("[A-Za-zÀ-ỹ]+"), F.lit(0))
    hits = lambda cues: F.size(F.filter(words, lambda w: w.isin(*cues)))
    fr, en = hits(V.FRENCH_CUES), hits(V.ENGLISH_CUES)
    return (
        F.when(share("[一-鿿]") > 0.15, "zh")
        .when(share("[가-힯]") > 0.15, "ko")
        .when(share(f"[{V.VIETNAMESE}]") > 0.025, "vi")
        .when((fr >= 2) & (fr >= en), "fr")
        .when(en >= 1, "en")
        .when(F.size(words) > 0, "en")
        .otherwise("unknown")
    )


def block_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each sentence block of the conversations, which end at .!? and white space or a line's end."""
    blocks = F.filter(F.split("text", "(?<=[.!?。！？])\\s+|\\n+"), lambda b: F.trim(b) != "")
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(blocks).alias("block_no", "block"))
    return df.select("conv_id", "turn", "block_no", F.length("block").alias("chars"), block_language(F.col("block")).alias("language"))


_HITS = "len(list_filter(words, lambda w: w IN ({})))"
BLOCK_SQL = f"""
WITH m AS (SELECT conv_id, turn, string_split(regexp_replace(regexp_replace(text, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)) AS l FROM conversations),
k AS (SELECT conv_id, turn, list_filter(l, lambda b: trim(b) <> '') AS l FROM m),
b AS (SELECT conv_id, turn, generate_subscripts(l, 1) - 1 AS block_no, unnest(l) AS block FROM k),
w AS (SELECT *, regexp_extract_all(lower(block), '[A-Za-zÀ-ỹ]+') AS words FROM b),
c AS (SELECT *, {_HITS.format(_sql_list(V.FRENCH_CUES))} AS fr, {_HITS.format(_sql_list(V.ENGLISH_CUES))} AS en, greatest(length(block), 1) AS n FROM w)
SELECT conv_id, turn, block_no::INT AS block_no, length(block)::INT AS chars,
CASE WHEN len(regexp_extract_all(block, '[一-鿿]')) / n > 0.15 THEN 'zh' WHEN len(regexp_extract_all(block, '[가-힯]')) / n > 0.15 THEN 'ko'
WHEN len(regexp_extract_all(block, '[{V.VIETNAMESE}]')) / n > 0.025 THEN 'vi' WHEN fr >= 2 AND fr >= en THEN 'fr' WHEN en >= 1 THEN 'en' WHEN len(words) > 0 THEN 'en' ELSE 'unknown' END AS language FROM c"""


def vocabulary(t: DataFrame, limit: int = VOCABULARY) -> DataFrame:
    """token_id, token: the fixed tokens, then others by falling count and token, `limit` in all. The sort is a top-k."""
    spark = t.sparkSession
    fixed = list(dict.fromkeys(V.EXTRA))
    others = t.where(~F.col("token").isin(*fixed)).groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    first = spark.createDataFrame(list(enumerate(fixed)), "token_id int, token string").where(F.col("token_id") < limit)
    top = others.orderBy(F.desc("c"), "token").limit(max(0, limit - len(fixed)))
    ranked = top.withColumn("token_id", F.row_number().over(Window.orderBy(F.desc("c"), "token")) + F.lit(len(fixed) - 1))
    return first.unionByName(ranked.select("token_id", "token"))


_EXTRA = list(dict.fromkeys(V.EXTRA))
VOCAB_CTE = f"""
fixed AS (SELECT (generate_subscripts(l, 1) - 1)::INT AS token_id, unnest(l) AS token FROM (SELECT [{_sql_list(_EXTRA)}] AS l)),
counted AS (SELECT token, count(*) AS c FROM tokens WHERE token NOT IN (SELECT token FROM fixed) GROUP BY token),
ranked AS (SELECT token, row_number() OVER (ORDER BY c DESC, token) + {len(_EXTRA) - 1} AS token_id FROM counted),
vocab AS (SELECT token_id, token FROM fixed UNION ALL SELECT token_id::INT, token FROM ranked WHERE token_id < {VOCABULARY})"""


def _turn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(table(spark, sf_dir, "conversations", spread=True).select("conv_id", "turn", "text"))


def vocab_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(tokens(table(spark, sf_dir, "documents", spread=True).select("text")))


ORDER = ("special", "punct", "number", "en", "vi", "fr", "zh", "ko")


def semantic_ids(vocab: DataFrame) -> DataFrame:
    """Ids by language class, then place in the vocabulary: bounded, since a vocabulary is."""
    rank = F.array_position(F.array(*[F.lit(c) for c in ORDER]), language_class(F.col("token")))
    order = Window.orderBy(rank, "token_id")
    return vocab.select((F.row_number().over(order) - 1).alias("code_id"), "token", language_class(F.col("token")).alias("class"))


_RANK = "list_position([" + _sql_list(ORDER) + f"], {_CLASS_SQL})"
SEMANTIC_CTE = f"""{VOCAB_CTE},
semantic AS (SELECT (row_number() OVER (ORDER BY {_RANK}, token_id) - 1)::INT AS code_id, token, {_CLASS_SQL} AS class FROM vocab)"""


def vocab_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic_ids(vocabulary(_turn_tokens(spark, sf_dir)))


def with_ids(t: DataFrame, vocab: DataFrame, key: str = "token_id") -> DataFrame:
    """Tokens with their ids, unknown ones with that of [UNK]. A vocabulary has at most its limit of rows, so it is broadcast."""
    unknown = vocab.where("token = '[UNK]'").select(F.col(key).alias("__unk"))
    return t.join(F.broadcast(vocab.select("token", key)), "token", "left").crossJoin(F.broadcast(unknown)).withColumn(key, F.coalesce(key, "__unk")).drop("__unk")


def joined_bits(t: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """keys, tokens, bits, dna of the values in order; an odd bit is padded with 0."""
    parts = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("tokens"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", value.alias("v")))), lambda x: x["v"]), "").alias("bits"))
    even = F.concat("bits", F.repeat(F.lit("0"), F.length("bits") % 2))
    dna = D.bit_pairs(even, D.BASES)
    return parts.withColumn("dna", dna)


def dense_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-width ids of twelve bits."""
    t = _turn_tokens(spark, sf_dir)
    coded = with_ids(t, vocabulary(t))
    out = joined_bits(coded, ["conv_id", "turn"], F.lpad(F.bin(F.col("token_id")), 12, "0"))
    return out.select("conv_id", "turn", "tokens", F.length("bits").alias("n_bits"), "dna")


_TO_DNA = "replace(replace(replace(replace(regexp_replace({b} || repeat('0', length({b}) % 2), '([01]{{2}})', '\\1 ', 'g'), '00 ', 'A'), '01 ', 'C'), '10 ', 'G'), '11 ', 'T')"
_BITS = "string_agg({v}, '' ORDER BY pos)"
DENSE_SQL = f"""WITH {TURN_TOKENS}, {VOCAB_CTE},
b AS (SELECT conv_id, turn, count(*) AS tokens, {_BITS.format(v="lpad(bin(coalesce(token_id, 1)), 12, '0')")} AS bits FROM tokens LEFT JOIN vocab USING (token) GROUP BY conv_id, turn)
SELECT conv_id, turn, tokens, length(bits)::INT AS n_bits, {_TO_DNA.format(b="bits")} AS dna FROM b"""


def parity_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The even-parity codes of CODE_BITS bits in rising order; the high bits alone decide the order."""
    x = spark.range(1 << (CODE_BITS - 1)).withColumnRenamed("id", "code_id")
    code = F.shiftleft("code_id", 1) + F.bit_count("code_id") % 2
    return x.select(F.col("code_id").cast("int").alias("code_id"), code.cast("int").alias("code"), F.lpad(F.bin(code), CODE_BITS, "0").alias("code_bits"))


CODEBOOK_SQL = f"SELECT (row_number() OVER (ORDER BY code) - 1)::INT AS code_id, code::INT AS code, lpad(bin(code), {CODE_BITS}, '0') AS code_bits FROM range({1 << CODE_BITS}) AS r(code) WHERE bit_count(code) % 2 = 0"


def _sparse(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tokens with their sparse codes, and the codebook with its tokens, which is used several times and so written once."""
    t = _turn_tokens(spark, sf_dir)
    book = written(semantic_ids(vocabulary(t)).join(parity_codebook(spark, sf_dir), "code_id"), "sparse-book")
    unknown = book.where("token = '[UNK]'").select(F.col("code").alias("__unk"))
    coded = t.join(F.broadcast(book.select("token", "code")), "token", "left").crossJoin(F.broadcast(unknown))
    return coded.withColumn("code", F.coalesce("code", "__unk")).drop("__unk"), book


SPARSE_CTE = f"""{TURN_TOKENS}, {SEMANTIC_CTE}, codes AS ({CODEBOOK_SQL}),
book AS (SELECT semantic.code_id, token, class, code FROM semantic JOIN codes USING (code_id)),
coded AS (SELECT conv_id, turn, pos, tokens.token, coalesce(book.code, (SELECT code FROM book WHERE token = '[UNK]')) AS code FROM tokens LEFT JOIN book ON tokens.token = book.token)"""


def sparse_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, _ = _sparse(spark, sf_dir)
    out = joined_bits(coded, ["conv_id", "turn"], F.lpad(F.bin(F.col("code")), CODE_BITS, "0"))
    return out.select("conv_id", "turn", "tokens", F.length("bits").alias("n_bits"), "dna")


SPARSE_SQL = f"""WITH {SPARSE_CTE},
b AS (SELECT conv_id, turn, count(*) AS tokens, {_BITS.format(v=f"lpad(bin(code), {CODE_BITS}, '0')")} AS bits FROM coded GROUP BY conv_id, turn)
SELECT conv_id, turn, tokens, length(bits)::INT AS n_bits, {_TO_DNA.format(b="bits")} AS dna FROM b"""


def noisy_codes(coded: DataFrame) -> DataFrame:
    """Each token's code with at most one bit flipped, by a hash draw."""
    u, v = D.hash_uniform(SEED, F.col("conv_id"), F.col("turn"), F.col("pos"))
    flip = F.when(u < int(CODE_ERROR * 2**32), F.element_at(F.array(*[F.lit(1 << i) for i in range(CODE_BITS)]), (v % CODE_BITS + 1).cast("int"))).otherwise(0)
    return coded.withColumn("noisy", F.col("code").bitwiseXOR(flip))


def sparse_decode_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded tokens per turn: exact ones by a join with the codebook, the others unknown."""
    coded, book = _sparse(spark, sf_dir)
    read = noisy_codes(coded).join(F.broadcast(book.select(F.col("code").alias("noisy"), F.col("token").alias("decoded"))), "noisy", "left")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("decoded", F.lit("[UNK]")).alias("d")))), lambda x: x["d"]), " ")
    return read.groupBy("conv_id", "turn").agg(F.count("decoded").alias("exact"), F.count_if(F.col("decoded").isNull()).alias("invalid"), F.count_if(F.col("decoded") == F.col("token")).alias("right"), ordered.alias("decoded_text"))


NOISY_CTE = f"""draws AS (SELECT *, {Q.uniform(SEED, "conv_id || '|' || turn || '|' || pos", 1)} AS u, {Q.uniform(SEED, "conv_id || '|' || turn || '|' || pos", 9)} AS v FROM coded),
noisy AS (SELECT conv_id, turn, pos, token, xor(code, CASE WHEN u < {int(CODE_ERROR * 2**32)} THEN 1 << (v % {CODE_BITS})::INT ELSE 0 END)::INT AS noisy FROM draws)"""
DECODE_SQL = f"""WITH {SPARSE_CTE}, {NOISY_CTE}
SELECT conv_id, turn, count(book.token) AS exact, count(*) FILTER (book.token IS NULL) AS invalid, count(*) FILTER (book.token = noisy.token) AS right, string_agg(coalesce(book.token, '[UNK]'), ' ' ORDER BY pos) AS decoded_text
FROM noisy LEFT JOIN book ON noisy = code GROUP BY conv_id, turn"""


def candidates(invalid: DataFrame, book: DataFrame, keys: list[str], top: int = TOP) -> DataFrame:
    """The `top` nearest codes of each invalid one, by distance plus the penalty of a language other than English.

    An odd-parity code lies 1 or 3 bits from its nearest valid ones. The 13 neighbours at one bit come from probes of
    the codebook; where penalties let codes at three bits in, those 286 do too. No scan of the codebook. What is nearest
    depends on the code alone, so it is worked out once for each of the 2**CODE_BITS codes and broadcast; of the invalid
    rows only their keys and codes are shuffled, not their candidates.
    """
    spark = invalid.sparkSession
    flips = [1 << i for i in range(CODE_BITS)]
    triples = [a | b | c for i, a in enumerate(flips) for j, b in enumerate(flips[:i]) for c in flips[:j]]
    rows = spark.createDataFrame([(m, m.bit_count()) for m in flips + triples], "mask int, hamming int")
    codes = spark.range(1 << CODE_BITS).select(F.col("id").cast("int").alias("noisy")).repartition("noisy")
    near = codes.crossJoin(F.broadcast(rows)).withColumn("probe", F.col("noisy").bitwiseXOR(F.col("mask")))
    found = near.join(F.broadcast(book.select(F.col("code").alias("probe"), "code_id", F.col("token").alias("candidate"), "class")), "probe")
    score = F.col("hamming") + F.when(F.col("class").isin("en", "special", "punct", "number"), 0).otherwise(PENALTY)
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("score", "hamming", "code_id"))).where(F.col("rank") <= top)
    best = ranked(found.withColumn("score", score), "noisy").select("noisy", "code_id", "candidate", "class", "hamming", "score")
    # keys that occur twice share their ranks; the rows are where their keys are ranked before they get candidates
    met = invalid.select(*keys, "noisy").repartition(*keys).join(F.broadcast(best), "noisy")
    return ranked(met, *keys).select(*keys, "rank", "code_id", "candidate", "class", "hamming", "score")


def hamming_candidates_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, book = _sparse(spark, sf_dir)
    read = noisy_codes(coded)
    invalid = read.join(F.broadcast(book.select(F.col("code").alias("noisy"))), "noisy", "left_anti").select("conv_id", "turn", "pos", "noisy")
    return candidates(invalid, book, ["conv_id", "turn", "pos"])


CANDIDATES_SQL = f"""WITH {SPARSE_CTE}, {NOISY_CTE},
p AS (SELECT conv_id, turn, pos, code_id, book.token AS candidate, class, bit_count(xor(noisy, code))::INT AS hamming FROM noisy, book WHERE noisy NOT IN (SELECT code FROM book)),
s AS (SELECT *, hamming + CASE WHEN class IN ('en', 'special', 'punct', 'number') THEN 0 ELSE {PENALTY} END AS score FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, pos ORDER BY score, hamming, code_id) AS rank FROM s)
SELECT conv_id, turn, pos::INT AS pos, rank::INT AS rank, code_id, candidate, class, hamming, score::INT AS score FROM k WHERE rank <= {TOP}"""


def cleanup(text: Column) -> Column:
    """Replacement and control characters become [UNK], white space one space."""
    text = F.regexp_replace(text, "�|[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "[UNK]")
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def text_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents", spread=True).select("doc_id", cleanup(F.col("text")).alias("t"))
    return df.select("doc_id", F.length("t").alias("chars"), F.md5("t").alias("clean_md5"))


CLEANUP_SQL = "SELECT doc_id, length(t)::INT AS chars, md5(t) AS clean_md5 FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '�|[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '[UNK]', 'g'), '\\s+', ' ', 'g')) AS t FROM documents)"


def detokenize(ts: Column) -> Column:
    """Tokens as text: closing marks follow at once, opening ones and Chinese take no space behind."""
    step = lambda out, t: F.when(t.rlike("^[.,;:!?)\\]}]$"), F.concat(F.rtrim(out), t, F.lit(" "))).when(
        t.rlike("^[(\\[{]$") | t.rlike("[一-鿿]"), F.concat(out, t)
    ).otherwise(F.concat(out, t, F.lit(" ")))
    return F.trim(F.aggregate(ts, F.lit(""), step))


def text_detokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations")
    return df.select("conv_id", "turn", detokenize(F.regexp_extract_all("text", F.lit(V.TOKEN), F.lit(0))).alias("text"))


DETOKENIZE_SQL = f"""WITH {TURN_TOKENS},
p AS (SELECT conv_id, turn, pos, token, CASE WHEN pos > 0 AND NOT regexp_matches(token, '^[.,;:!?)\\]}}]$') AND NOT regexp_matches(lag(token) OVER (PARTITION BY conv_id, turn ORDER BY pos), '^[(\\[{{]$|[一-鿿]') THEN ' ' ELSE '' END AS sp FROM tokens)
SELECT conv_id, turn, string_agg(sp || token, '' ORDER BY pos) AS text FROM p GROUP BY conv_id, turn"""


def position_accuracy(a: Column, b: Column) -> Column:
    """Share of places with the same character, gaps in length counted as errors; 1 for two empty texts."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 1).otherwise(0))
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(F.aggregate(same, F.lit(0), lambda s, x: s + x) / n)


def text_position_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns against their token text put together again."""
    df = table(spark, sf_dir, "conversations").withColumn("d", detokenize(F.regexp_extract_all("text", F.lit(V.TOKEN), F.lit(0))))
    return df.select("conv_id", "turn", F.round(position_accuracy(F.col("text"), F.col("d")), 6).alias("accuracy"), (F.length("d") - F.length("text")).alias("length_delta"))


ACCURACY_SQL = f"""WITH d AS ({DETOKENIZE_SQL}),
j AS (SELECT c.conv_id, c.turn, c.text AS a, coalesce(d.text, '') AS b FROM conversations c LEFT JOIN d USING (conv_id, turn)),
n AS (SELECT *, greatest(length(a), length(b)) AS n, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[i] = b[i])) AS same FROM j)
SELECT conv_id, turn, round(CASE WHEN n = 0 THEN 1.0 ELSE same / n END, 6) AS accuracy, (length(b) - length(a))::INT AS length_delta FROM n"""

QUERIES = {
    "tokens_simple": (tokens_simple, TOKENS_SQL),
    "tokens_language_class": (tokens_language_class, CLASS_SQL),
    "block_language": (block_languages, BLOCK_SQL),
    "vocab_topn": (vocab_topn, f"WITH {DOC_TOKENS}, {VOCAB_CTE} SELECT * FROM vocab"),
    "vocab_semantic": (vocab_semantic, f"WITH {TURN_TOKENS}, {SEMANTIC_CTE} SELECT * FROM semantic"),
    "dense_encode": (dense_encode, DENSE_SQL),
    "parity_codebook": (parity_codebook, CODEBOOK_SQL),
    "sparse_encode": (sparse_encode, SPARSE_SQL),
    "sparse_decode_invalid": (sparse_decode_invalid, DECODE_SQL),
    "hamming_candidates_topk": (hamming_candidates_topk, CANDIDATES_SQL),
    "text_cleanup": (text_cleanup, CLEANUP_SQL),
    "text_detokenize": (text_detokenize, DETOKENIZE_SQL),
    "text_position_accuracy": (text_position_accuracy, ACCURACY_SQL),
}
