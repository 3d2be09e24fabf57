"""What repair starts from: ids within any distance, windows of context, reads aligned with their strand; tests of names and mappings."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna as D
from ..functions import duck as Q
from ..sources.scratch import written
from ..sources.tables import table
from . import noise as N
from . import packets as P
from . import strands as S
from . import tokens as T
from .ecc import align
from .ranking import _DOMAIN_SQL, _KIND_SQL, HEADS, domain, magic

# Distance and number of candidates of an id, tokens of context on either side, longest slice of a model.
DISTANCE, LIMIT, AROUND, MODEL = 2, 12, 35, 512
# Suffixes of internal payloads, names of mappings with their mode and scheme, and the first dimer.
INTERNAL = (".imgpayload", ".raw", ".audpayload", ".vidpayload", ".payload")
MAPPINGS = {"Simple Mapping": ("SIMPLE", "RINF_B16"), "RINF_B16": ("TABLE", "RINF_B16"), "R2_B15": ("TABLE", "R2_B15"), "R1_B12": ("TABLE", "R1_B12"), "R0_B9": ("TABLE", "R0_B9")}
FIRST_DIMER = "TA"
_BITS = range(P.ID_BITS)


def masks(distance: int, bits: int = P.ID_BITS) -> list[tuple[int, int]]:
    """Masks of up to so many bits with their number of bits: fewer bits first, then by places from the highest bit on."""
    return [(sum(1 << (bits - 1 - i) for i in places), d) for d in range(distance + 1) for places in combinations(range(bits), d)]


def ids_within(read_id: Column, valid: Column, distance: int = DISTANCE, limit: int = LIMIT) -> Column:
    """The first `limit` valid ids (those below `valid`) at up to `distance` bits, as an array of (token_id, hamming_distance).

    The masks are literals, so a row finds its candidates by itself: no join and no shuffle, whatever the distance.
    """
    table_ = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(d).alias("d")) for m, d in masks(distance)])
    found = F.transform(table_, lambda x: F.struct(read_id.bitwiseXOR(x["mask"]).cast("int").alias("token_id"), x["d"].alias("hamming_distance")))
    return F.slice(F.filter(found, lambda x: x["token_id"] < valid), 1, limit)


def _read_ids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Token ids of the turns as read, with at most two wrong bits, and the vocabulary."""
    t = T.tokens(table(spark, sf_dir, "conversations", spread=True).select("conv_id", "turn", "text"))
    vocab = written(T.vocabulary(t), "context-vocabulary")
    u, v = D.hash_uniform(P.SEED, F.col("conv_id"), F.col("turn"), F.col("pos"))
    bit = lambda k: F.element_at(F.array(*[F.lit(1 << i) for i in _BITS]), (k % P.ID_BITS + 1).cast("int"))
    flip = F.when(u < int(0.02 * 2**32), bit(v).bitwiseOR(F.when(v % 3 == 0, bit(F.floor(v / P.ID_BITS))).otherwise(0))).otherwise(0)
    return T.with_ids(t, vocab).withColumn("read_id", F.col("token_id").bitwiseXOR(flip)), vocab


def id_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every id that was read wrongly, with their tokens."""
    read, vocab = _read_ids(spark, sf_dir)
    wrong = read.where("read_id <> token_id").select("conv_id", "turn", "pos", "read_id", F.col("token_id").alias("sent_id"))
    n = vocab.select(F.count(F.lit(1)).cast("int").alias("valid"))  # one row
    rows = wrong.crossJoin(F.broadcast(n)).withColumn("c", ids_within(F.col("read_id"), F.col("valid")))
    rows = rows.select("conv_id", "turn", "pos", "read_id", "sent_id", F.posexplode("c").alias("rank", "x"))
    named = rows.select("conv_id", "turn", "pos", "read_id", (F.col("rank") + 1).alias("rank"), "x.*", (F.col("x.token_id") == F.col("sent_id")).alias("sent"))
    return named.join(F.broadcast(vocab), "token_id")


_KP = P._KP
READ_CTE = f"""{T.TURN_TOKENS}, {T.VOCAB_CTE},
drawn AS (SELECT conv_id, turn, pos, token, coalesce(token_id, 1) AS token_id, {Q.uniform(P.SEED, _KP, 1)} AS u, {Q.uniform(P.SEED, _KP, 9)} AS v FROM tokens LEFT JOIN vocab USING (token)),
got AS (SELECT *, xor(token_id, CASE WHEN u < {int(0.02 * 2**32)} THEN (1 << (v % {P.ID_BITS})::INT) | CASE WHEN v % 3 = 0 THEN 1 << (v // {P.ID_BITS} % {P.ID_BITS})::INT ELSE 0 END ELSE 0 END)::INT AS read_id FROM drawn)"""
IDS_SQL = f"""WITH {READ_CTE},
mask AS (SELECT * FROM (VALUES {", ".join(f"({i}, {m}, {d})" for i, (m, d) in enumerate(masks(DISTANCE)))}) AS v(place, mask, d)),
cand AS (SELECT conv_id, turn, pos, read_id, token_id AS sent_id, place, xor(read_id, mask)::INT AS token_id, d FROM got, mask WHERE read_id <> token_id AND xor(read_id, mask) < (SELECT count(*) FROM vocab)),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, pos ORDER BY place) AS rank FROM cand)
SELECT conv_id, turn, pos::INT AS pos, read_id, rank::INT AS rank, token_id, d::INT AS hamming_distance, token_id = sent_id AS sent, token FROM k JOIN vocab USING (token_id) WHERE rank <= {LIMIT}"""


def context_window(tokens: Column, pos: Column, around: int = AROUND) -> Column:
    """Struct start, place (of the token in its window), window: the tokens up to `around` before and behind."""
    start = F.greatest(F.lit(0), pos - around)
    return F.struct(start.alias("start"), (pos - start).alias("place"), F.slice(tokens, start + 1, F.least(F.size(tokens), pos + around + 1) - start).alias("window"))


def model_window(tokens: Column, pos: Column, longest: int = MODEL) -> Column:
    """The same for a model that takes `longest` tokens: the token in the middle, but no place wasted at an end."""
    n = F.size(tokens)
    right = F.least(n, F.greatest(F.lit(0), pos - longest // 2) + longest)
    left = F.greatest(F.lit(0), right - longest)
    return F.struct(left.alias("start"), (pos - left).alias("place"), F.slice(tokens, left + 1, right - left).alias("window"))


def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows around every token that was read wrongly; a turn's tokens stay in one row, so no window is shuffled."""
    read, _ = _read_ids(spark, sf_dir)
    turns = read.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"), F.array_sort(F.collect_list(F.when(F.col("read_id") != F.col("token_id"), F.col("pos")))).alias("wrong"))
    rows = turns.select("conv_id", "turn", F.transform("t", lambda x: x["token"]).alias("tokens"), F.explode("wrong").alias("pos"))
    rows = rows.select("conv_id", "turn", "pos", context_window(F.col("tokens"), F.col("pos")).alias("a"), model_window(F.col("tokens"), F.col("pos"), 64).alias("b"))
    of = lambda c, p: [F.col(f"{c}.start").alias(f"{p}_start"), F.col(f"{c}.place").alias(f"{p}_place"), F.array_join(f"{c}.window", " ").alias(f"{p}_text")]
    return rows.select("conv_id", "turn", "pos", *of("a", "near"), *of("b", "model"))


WINDOWS_SQL = f"""WITH {READ_CTE}, l AS (SELECT conv_id, turn, list(token ORDER BY pos) AS t, count(*) AS n FROM got GROUP BY conv_id, turn),
w AS (SELECT conv_id, turn, pos, t, n, greatest(0, pos - {AROUND}) AS a, least(n, greatest(0, pos - 32) + 64) AS r FROM got JOIN l USING (conv_id, turn) WHERE read_id <> token_id),
x AS (SELECT *, greatest(0, r - 64) AS b FROM w)
SELECT conv_id, turn, pos::INT AS pos, a::INT AS near_start, (pos - a)::INT AS near_place, array_to_string(t[a + 1:least(n, pos + {AROUND + 1})], ' ') AS near_text,
b::INT AS model_start, (pos - b)::INT AS model_place, array_to_string(t[b + 1:r], ' ') AS model_text FROM x"""


def template_calls(reads: DataFrame, seq: str, template: str) -> DataFrame:
    """reads with `called`: the read's bases at the places of its template; a place that the read lost is A, what it has more goes.

    Reads of the template's length stay as they are; the others are aligned with least edits, a pair before a lost base before one too many.
    """

    @F.pandas_udf("string")
    def run(seqs: pd.Series, templates: pd.Series) -> pd.Series:
        def one(s: str, t: str) -> str:
            out = ["A"] * len(t)
            for i, j in align(list(t), list(s)):
                if i is not None and j is not None:
                    out[i] = s[j]
            return "".join(out)

        return pd.Series([one(s, t) for s, t in zip(seqs, templates)], dtype=object)

    s, t = (D.bases_only(F.col(c)) for c in (seq, template))
    same = F.length(s) == F.length(t)
    return reads.withColumn("called", F.when(same, s).otherwise(run(F.when(same, F.lit("")).otherwise(s), F.when(same, F.lit("")).otherwise(t))))


def template_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with insertions and deletions at their strands' places."""
    strands = S.strands(table(spark, sf_dir, "benchmark", spread=True).select("item_id", D.simple(F.coalesce("text", F.lit(""))).alias("dna")))
    read = N.reads(strands, ["item_id", "no"], ins=0.01, dele=0.01)
    called = template_calls(read, "seq", "template")
    return called.select("item_id", "no", "copy_no", F.length("seq").alias("read_length"), F.length("template").alias("template_length"), "called", N.hamming(F.col("template"), F.col("called")).alias("mismatches"))


def suffix(name: Column) -> Column:
    """A file's suffix with its dot, in lower case; none for a name that begins with its only dot."""
    last = F.element_at(F.split(F.coalesce(name, F.lit("")), "/"), -1)
    return F.lower(F.regexp_extract(last, r"^.*[^.](\.[^.]+)$", 1))


def internal_payload(name: Column) -> Column:
    return suffix(name).isin(*INTERNAL)


def is_image(payload: Column) -> Column:
    """Whether sniffing says that a payload is an image."""
    return F.coalesce(domain(magic(payload)["kind"]) == "image", F.lit(False))


def payload_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages behind every known head, stored under internal and other names, by what the two tests say."""
    names = F.array(*[F.lit(n) for n in (*INTERNAL, ".png", ".RAW", "", ".tar.Payload")])
    head = F.explode(F.array(*[F.lit(h) for h in HEADS]))
    p = table(spark, sf_dir, "pages", spread=True).select("page_id", F.encode("html", "UTF-8").alias("html"), F.concat(F.lit("store/page_"), F.col("page_id").cast("string"), F.get(names, (F.col("page_id") % 9).cast("int"))).alias("name"))
    rows = p.select("name", "html", head.alias("head")).select("name", is_image(F.concat(F.unhex("head"), "html")).alias("image"))
    return rows.groupBy(suffix(F.col("name")).alias("suffix"), internal_payload(F.col("name")).alias("internal"), "image").agg(F.count(F.lit(1)).alias("payloads"))


_NAMES = list((*INTERNAL, ".png", ".RAW", "", ".tar.Payload"))
TESTS_SQL = f"""WITH p AS (SELECT lower(regexp_extract({_NAMES}[page_id % 9 + 1], '(\\.[^.]+)$', 1)) AS suffix, html, unnest({HEADS}) AS head FROM pages WHERE html IS NOT NULL),
t AS (SELECT suffix, head || hex(encode(html)) AS h FROM p),
k AS (SELECT suffix, CASE WHEN length(h) < 8 THEN 'none' ELSE {_KIND_SQL} ELSE 'none' END END AS kind FROM t)
SELECT suffix, suffix IN ({str(INTERNAL)[1:-1]}) AS internal, {_DOMAIN_SQL} = 'image' AS image, count(*) AS payloads FROM k GROUP BY ALL"""


def mapping_config(name: Column) -> Column:
    """Struct mode, scheme_name, init_dimer, whiten of a mapping's name; a name that isn't known is a table's scheme."""
    simple = name == "Simple Mapping"
    return F.struct(F.when(simple, "SIMPLE").otherwise("TABLE").alias("mode"), F.when(simple, "RINF_B16").otherwise(name).alias("scheme_name"), F.lit(FIRST_DIMER).alias("init_dimer"), F.lit(False).alias("whiten"))


def mapping_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration of each mapping's name with the bases that it needs for the documents, where whole bytes decide them."""
    names = F.explode(F.array(*[F.lit(n) for n in MAPPINGS]))
    docs = table(spark, sf_dir, "documents").select(F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    sizes = docs.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("bytes"), F.count_if(F.col("n") == 0).alias("empty"))
    rows = sizes.select("*", names.alias("mapping")).select("mapping", mapping_config(F.col("mapping")).alias("c"), "documents", "bytes", "empty")
    full = F.col("documents") - F.col("empty")
    # a header base before two bits a base, or the guard digit; the empty payload is a bit, and two bases
    bases = F.when(F.col("mapping") == "Simple Mapping", 4 * F.col("bytes") + full + 2 * F.col("empty")).when(F.col("mapping") == "RINF_B16", 4 * F.col("bytes") + 2 * F.col("documents")).otherwise(-1)
    return rows.select("mapping", "c.*", "documents", bases.alias("bases"))


_CONFIGS = ", ".join(f"('{n}', '{m}', '{s}')" for n, (m, s) in MAPPINGS.items())
MAPPING_SQL = f"""WITH d AS (SELECT count(*) AS documents, sum(length({Q.simple("coalesce(text, '')")}))::BIGINT AS simple, sum(length({Q.unconstrained("coalesce(text, '')")}))::BIGINT AS rinf FROM documents)
SELECT mapping, mode, scheme_name, '{FIRST_DIMER}' AS init_dimer, false AS whiten, documents, (CASE mapping WHEN 'Simple Mapping' THEN simple WHEN 'RINF_B16' THEN rinf ELSE -1 END)::BIGINT AS bases FROM d, (VALUES {_CONFIGS}) AS v(mapping, mode, scheme_name)"""


def butterworth(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital low-pass filter, cutoff as a share of half the rate: analog poles on a circle, through the bilinear transform."""
    k = np.arange(1, order + 1)
    poles = 4 * np.tan(np.pi * cutoff / 2) * np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    digital = (4 + poles) / (4 - poles)
    below = np.real(np.poly(digital))
    above = np.poly(-np.ones(order))
    return above * below.sum() / above.sum(), below  # gain one for what doesn't change


def _filtered(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """One pass, from the state in which a signal that is always x[0] would be."""
    n = len(a) - 1
    companion = np.eye(n) - np.vstack([-a[1:], np.eye(n - 1, n)]).T
    state = np.linalg.solve(companion, b[1:] - a[1:] * b[0]) * x[0]
    out = np.empty_like(x)
    for i, value in enumerate(x):
        y = b[0] * value + state[0]
        state = np.append(state[1:], 0.0) + b[1:] * value - a[1:] * y
        out[i] = y
    return out


def low_pass(x: np.ndarray, rate: int = 16_000) -> np.ndarray:
    """Median of five (zeros beyond the ends), then a fourth-order low-pass there and back, within [-1, 1]. Signals of up to
    fifteen samples take the median only."""
    around = np.lib.stride_tricks.sliding_window_view(np.pad(x.astype(float), 2), 5) if len(x) else np.zeros((0, 5))
    m = np.median(around, axis=1)
    b, a = butterworth(4, min(6000.0, rate * 0.45) / (rate / 2))
    pad = 3 * len(a)
    if len(m) > pad:
        wide = np.concatenate([2 * m[0] - m[pad:0:-1], m, 2 * m[-1] - m[-2 : -pad - 2 : -1]])
        m = _filtered(_filtered(wide, b, a)[::-1], b, a)[::-1][pad:-pad]
    return np.clip(m, -1, 1)


def low_pass_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips after the low-pass clean-up: power before and after, and the largest change."""

    @F.pandas_udf("power double, power_after double, largest_change double")
    def run(clips: pd.Series) -> pd.DataFrame:
        rows = []
        for clip in clips:
            x = np.clip(np.array(clip, dtype=float), -1, 1)
            y = low_pass(x)
            rows.append((round(float((x * x).mean()), 8), round(float((y * y).mean()), 8), round(float(np.abs(x - y).max()), 6)) if len(x) else (None, None, None))
        return pd.DataFrame(rows, columns=["power", "power_after", "largest_change"])

    return table(spark, sf_dir, "embeddings").select("vec_id", run("embedding").alias("r")).select("vec_id", "r.*")


QUERIES = {
    "id_candidates": (id_candidates, IDS_SQL),
    "context_windows": (context_windows, WINDOWS_SQL),
    "template_alignment": (template_alignment, None),
    "payload_tests": (payload_tests, TESTS_SQL),
    "mapping_lengths": (mapping_lengths, MAPPING_SQL),
    "low_pass_clips": (low_pass_clips, None),
}
