"""Packets of tokens with checks, contexts of changes, languages of tokens, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dna as D
from ..functions import duck as Q
from ..sources.tables import table
from . import noise as N
from . import strands as S
from . import tokens as T
from .signals import SAMPLES, samples

# Bases shown on either side of a change, bits of a token id, tokens of a checked block.
CONTEXT, ID_BITS, BLOCK = 12, 16, 8
SEED = 17


def substitution_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every changed base of the benchmark texts with its neighbourhood."""
    df = table(spark, sf_dir, "benchmark").select("item_id", D.simple(F.coalesce("text", F.lit(""))).alias("dna"))
    hits = F.filter("places", lambda p: p["changed"])
    rows = N.substitution_noise(df, ["item_id"], "dna").select("item_id", "dna", F.explode_outer(hits).alias("p")).where("p IS NOT NULL")
    rows = rows.select("item_id", "dna", F.col("p.pos").alias("pos"), F.col("p.old").alias("base"), F.col("p.base").alias("new_base"))
    first = F.greatest(F.lit(1), F.col("pos") - CONTEXT)
    near = F.substring("dna", first, F.col("pos") + CONTEXT + 1 - first)
    marked = F.concat(F.repeat(F.lit(" "), F.col("pos") - first), F.lit("^"))
    return rows.select("item_id", (F.col("pos") - 1).alias("position"), "base", "new_base", near.alias("context"), marked.alias("marker"))


_FIRST = f"greatest(1, pos - {CONTEXT})"
CONTEXT_SQL = N.SUBSTITUTION_SQL.split("SELECT item_id, count(*) AS bases")[0] + f"""
SELECT item_id, (pos - 1)::INT AS position, base, {N._SUB.format(b="base", v="v")} AS new_base, substr(dna, {_FIRST}, pos + {CONTEXT} + 1 - {_FIRST}) AS context, repeat(' ', (pos - {_FIRST})::INT) || '^' AS marker
FROM n JOIN e USING (item_id) WHERE changed"""


def token_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the conversations as 16 bits and the low 8 bits of the CRC-32 of these, read with at most one wrong bit.

    A packet whose check fails is repaired from the ids at one bit from it whose check is that read: the count of such.
    """
    t = T.tokens(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    vocab = T.vocabulary(t)
    coded = T.with_ids(t, vocab)
    u, v = D.hash_uniform(SEED, F.col("conv_id"), F.col("turn"), F.col("pos"))
    check = lambda c: F.crc32(F.lpad(F.bin(c), ID_BITS, "0").cast("binary")).bitwiseAND(F.lit(255)).cast("int")
    flip = F.when(u < int(0.02 * 2**32), F.element_at(F.array(*[F.lit(1 << i) for i in range(ID_BITS)]), (v % ID_BITS + 1).cast("int"))).otherwise(0)
    read = coded.select("conv_id", "turn", "pos", "token_id", F.col("token_id").bitwiseXOR(flip).alias("read_id"), check(F.col("token_id")).alias("read_crc"))
    read = read.withColumn("crc_ok", check(F.col("read_id")) == F.col("read_crc"))
    probes = F.filter(F.transform(F.array(*[F.lit(1 << i) for i in range(ID_BITS)]), lambda m: F.col("read_id").bitwiseXOR(m)), lambda c: c < T.VOCABULARY)
    fitting = F.filter(probes, lambda c: check(c) == F.col("read_crc"))
    read = read.withColumn("fitting", F.when(F.col("crc_ok"), F.array("read_id")).otherwise(fitting))
    right = F.array_contains("fitting", F.col("token_id"))
    return read.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("packets"), F.count_if(~F.col("crc_ok")).alias("invalid"), F.sum(F.when(~F.col("crc_ok"), F.size("fitting")).otherwise(0)).alias("candidates"), F.count_if(right).alias("recovered")
    )


_KP = "conv_id || '|' || turn || '|' || pos"
PACKETS_SQL = f"""WITH {T.TURN_TOKENS}, {T.VOCAB_CTE},
checks AS (SELECT id::INT AS id, {Q.crc32(f"list_transform(range({ID_BITS}), lambda i: 48 + ((id >> ({ID_BITS - 1} - i)) & 1))")} & 255 AS crc FROM range({1 << ID_BITS}) AS r(id)),
sent AS (SELECT conv_id, turn, pos, coalesce(token_id, 1) AS token_id, {Q.uniform(SEED, _KP, 1)} AS u, {Q.uniform(SEED, _KP, 9)} AS v FROM tokens LEFT JOIN vocab USING (token)),
got AS (SELECT *, xor(token_id, CASE WHEN u < {int(0.02 * 2**32)} THEN 1 << (v % {ID_BITS})::INT ELSE 0 END)::INT AS read_id FROM sent),
checked AS (SELECT got.*, a.crc AS read_crc, a.crc = b.crc AS ok FROM got JOIN checks a ON a.id = token_id JOIN checks b ON b.id = read_id),
fitting AS (SELECT conv_id, turn, pos, count(*) AS n, bool_or(id = token_id) AS hit FROM checked, range({ID_BITS}) AS f(bit), checks WHERE NOT ok AND id = xor(read_id, 1 << bit::INT) AND id < {T.VOCABULARY} AND crc = read_crc GROUP BY ALL)
SELECT conv_id, turn, count(*) AS packets, count(*) FILTER (NOT ok) AS invalid, coalesce(sum(n), 0)::BIGINT AS candidates, count(*) FILTER (CASE WHEN ok THEN read_id = token_id ELSE coalesce(hit, false) END) AS recovered
FROM checked LEFT JOIN fitting USING (conv_id, turn, pos) GROUP BY conv_id, turn"""


def block_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of BLOCK token ids with their number and the low 16 bits of the CRC-32 of their bits: bits and bases a turn."""
    t = T.tokens(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    coded = T.with_ids(t, T.vocabulary(t)).withColumn("block", F.floor(F.col("pos") / BLOCK))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token_id"))), lambda x: F.lpad(F.bin(x["token_id"]), ID_BITS, "0")), "")
    blocks = coded.groupBy("conv_id", "turn", "block").agg(F.count(F.lit(1)).alias("n"), ids.alias("ids"))
    crc = F.crc32(F.concat(F.lpad(F.bin("n"), 8, "0"), "ids").cast("binary")).bitwiseAND(F.lit(65535))
    return blocks.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.lit(24) + F.length("ids")).alias("bits"), F.sum((F.lit(24) + F.length("ids")) / 2).cast("long").alias("bases"), F.bit_xor(crc).alias("crc_of_blocks"))


BLOCK_CRC_SQL = f"""WITH {T.TURN_TOKENS}, {T.VOCAB_CTE},
coded AS (SELECT conv_id, turn, pos, pos // {BLOCK} AS block, lpad(bin(coalesce(token_id, 1)), {ID_BITS}, '0') AS id FROM tokens LEFT JOIN vocab USING (token)),
blocks AS (SELECT conv_id, turn, block, lpad(bin(count(*)), 8, '0') || string_agg(id, '' ORDER BY pos) AS sent FROM coded GROUP BY ALL)
SELECT conv_id, turn, count(*) AS blocks, sum(length(sent) + 16)::BIGINT AS bits, (sum(length(sent) + 16) // 2)::BIGINT AS bases, bit_xor({Q.crc32(Q.ascii_bytes("sent"))} & 65535) AS crc_of_blocks FROM blocks GROUP BY conv_id, turn"""


def token_block_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by the language of the sentence block they stand in and their own class."""
    blocks = F.filter(F.split("text", "(?<=[.!?。！？])\\s+|\\n+"), lambda b: F.trim(b) != "")
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(blocks).alias("block_no", "text"))
    df = df.withColumn("language", T.block_language(F.col("text")))
    t = T.tokens(df.select("language", "text"))
    return t.groupBy("language", T.language_class(F.col("token")).alias("class")).agg(F.count(F.lit(1)).alias("tokens"))


TOKEN_BLOCK_SQL = f"""WITH l AS ({T.BLOCK_SQL.replace("SELECT conv_id, turn, block_no::INT AS block_no, length(block)::INT AS chars,", "SELECT conv_id, turn, block_no, block,")}),
tokens AS (SELECT language, unnest(regexp_extract_all(block, '{T.V.TOKEN.replace("'", "''")}')) AS token FROM l)
SELECT language, {T._CLASS_SQL} AS class, count(*) AS tokens FROM tokens GROUP BY ALL"""


def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals at three quarters of their rate: linear between the neighbours, by a lead over the signal."""
    w = Window.partitionBy("vec_id").orderBy("n")
    s = samples(spark, sf_dir).withColumn("x1", F.lead("x").over(w))
    # sample k of the result lies at 4k/3: the pairs (n, place within) that a source sample serves
    at = F.explode(F.sequence(F.ceil(F.col("n") * 3 / 4).cast("int"), F.ceil((F.col("n") + 1) * 3 / 4).cast("int") - 1))
    s = s.where(F.ceil(F.col("n") * 3 / 4) < F.ceil((F.col("n") + 1) * 3 / 4)).withColumn("k", at).where("x1 IS NOT NULL")
    part = F.col("k") * 4 / 3 - F.col("n")
    return s.select("vec_id", "k", F.round(F.col("x") + (F.col("x1") - F.col("x")) * part, 9).alias("y"))


RESAMPLE_SQL = f"""WITH {SAMPLES}, k AS (SELECT vec_id, k, floor(k * 4 / 3)::INT AS n, k * 4 / 3 - floor(k * 4 / 3) AS part FROM (SELECT DISTINCT vec_id FROM samples), range(48) AS r(k))
SELECT vec_id, k::INT AS k, round(a.x + (b.x - a.x) * part, 9) AS y FROM k JOIN samples a USING (vec_id, n) JOIN samples b ON b.vec_id = k.vec_id AND b.n = k.n + 1"""


def fixed_size_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of exactly 120 bases of the encoded turns; a shorter rest is dropped, as a parser of such strands does."""
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", D.simple(F.coalesce("text", F.lit(""))).alias("dna"))
    return S.split(df, 120).where(F.length("payload") == 120).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("strands"), F.max_by("payload", "no").alias("last_strand"))


FIXED_SQL = f"""WITH e AS (SELECT conv_id, turn, {Q.simple("text")} AS dna FROM conversations)
SELECT conv_id, turn, (length(dna) // 120)::BIGINT AS strands, substr(dna, (length(dna) // 120 - 1) * 120 + 1, 120) AS last_strand FROM e WHERE length(dna) >= 120"""

QUERIES = {
    "substitution_context": (substitution_context, CONTEXT_SQL),
    "token_packets": (token_packets, PACKETS_SQL),
    "token_block_crc": (block_crc, BLOCK_CRC_SQL),
    "token_block_language": (token_block_language, TOKEN_BLOCK_SQL),
    "resample_linear": (resample_linear, RESAMPLE_SQL),
    "fixed_size_strands": (fixed_size_strands, FIXED_SQL),
}
