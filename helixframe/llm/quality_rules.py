"""Host-level quality rules: rule failures by host, shrunk with an empirical beta prior, joined back to documents.

Only DataFrame functions. Edge cases: a null or empty text has no words and fails the base rule; a null host is a
host of its own; repeated rows are judged one by one; an empty table gives an empty result; further columns of the
input are kept as they are unless a result column has their name, which then replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A document with more symbols than this percentage of its words fails the symbol rule.
MAX_SYMBOL_PERCENT = 10
#: A host whose shrunk failure rate is over this is rejected as a whole.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's strength (its alpha + beta).
STRENGTH = (2.0, 1e6)
#: Rejected hosts are broadcast up to this many; beyond it they are joined through a salted shuffle.
MAX_BROADCAST_HOSTS = 10_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice. Windows are compared by 64-bit hash."""
    windows = F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, 3)))
    )

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        starts = C.let(
            placed,
            lambda s: F.sort_array(
                F.transform(F.filter(s, lambda e, j: same(e, F.get(s, j - 1)) | same(e, F.get(s, j + 1))), lambda e: e["i"])
            ),
        )
        steps = C.let(starts, lambda p: F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b).cast("long")

    return C.let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the per-document counts and base_failed."""
    kept = [c for c in docs.columns if c not in (*COUNTS, "base_failed")]
    t, w, l = (C.fresh(kept, x) for x in ("_text", "_words", "_lines"))  # noqa: E741
    df = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(t))
    df = df.select(*kept, t, C.words(F.col(t)).alias(w), F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(C.SPACES)) != "").alias(l))
    counts = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(t, C.SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col(w)).alias("n_repeat_words"),
    )
    # through a generator, so that a later filter on the counts isn't pushed below and evaluated word by word
    df = df.select(*kept, F.inline(F.array(counts)))
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def fails() -> Column:
    """Whether a document fails a rule itself."""
    return F.col("base_failed") | (F.lit(100) * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words"))


def host_rates(flags: DataFrame, host: str, failed: str) -> DataFrame:
    """One row per host: docs, failures, and the failure rate shrunk to the prior fitted over all hosts by moments.

    The prior's variance is that of the hosts' rates, weighted by documents, less what binomial noise explains.
    """
    by_host = flags.groupBy(host).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("long")).alias("f"))
    low, high = STRENGTH
    m, v = F.col("m"), F.col("v")
    prior = (
        by_host.agg(
            F.sum("n").alias("n_all"), F.sum("f").alias("f_all"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("f") * F.col("f") / F.col("n")).alias("ff")
        )
        .select((F.col("f_all") / F.nullif(F.col("n_all"), F.lit(0))).alias("m"), "n_all", "hosts", "ff")
        .select("m", (F.col("ff") / F.nullif(F.col("n_all"), F.lit(0)) - m * m - m * (1 - m) * F.col("hosts") / F.nullif(F.col("n_all"), F.lit(0))).alias("v"))
        .select("m", F.when(v > 0, F.least(F.lit(high), F.greatest(F.lit(low), m * (1 - m) / F.when(v > 0, v) - 1))).otherwise(F.lit(high)).alias("k"))
    )
    rates = by_host.crossJoin(F.broadcast(prior))  # the prior is one row
    return rates.select(host, "n", "f", ((F.col("f") + F.col("m") * F.col("k")) / (F.col("n") + F.col("k"))).alias("rate"))


def judge(docs: DataFrame, flags: DataFrame, host: str) -> DataFrame:
    """docs (with the counts) and `kept`; flags: host and failed of every document."""
    at, bad = C.fresh(docs.columns, "_host"), C.fresh(docs.columns, "_bad")
    rejected = host_rates(flags, host, "failed").where(F.col("rate") > MAX_HOST_RATE).select(F.col(host).alias(at), F.col("n").alias("docs"), F.lit(True).alias(bad))
    rejected = C.materialise(rejected, "bad-hosts")
    found = rejected.agg(F.count(F.lit(1)).alias("hosts"), F.sum("docs").alias("docs")).first()
    if found.hosts <= MAX_BROADCAST_HOSTS:
        keyed = rejected.drop("docs")
        joined = docs.join(F.broadcast(keyed), docs[host].eqNullSafe(keyed[at]), "left").drop(at)
    else:  # the rejected hosts' documents are a part of all, so what is hot among all is hot here
        joined = C.spread_join(docs, rejected.withColumnRenamed(at, host), host, "docs", found.docs)
    return joined.withColumn("kept", ~fails() & F.col(bad).isNull()).drop(bad)


def apply_rules(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """docs with counts, base_failed and kept. Texts are read twice (once for the hosts' rates) instead of being written."""
    counted = with_counts(docs, text)
    return judge(counted, counted.select(host, fails().alias("failed")), host)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: rejected documents go, the others keep their columns."""
    plain = C.fresh(["text", "source", "kept", "base_failed", *COUNTS], "_row")
    own = docs.select(F.struct(*docs.columns).alias(plain), F.col("text").alias("text"), F.col("source").alias("source"))
    counted = C.materialise(with_counts(own).drop("text"), "rule-counts")  # written with their documents, so texts are counted once
    kept = judge(counted, counted.select("source", fails().alias("failed")), "source").where("kept")
    return kept.select(*[F.col(plain)[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = C.materialise(with_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).drop("text"), "rule-counts")
    return judge(counted, counted.select("source", fails().alias("failed")), "source").select("doc_id", *COUNTS, "base_failed", "kept")


#: The base counts and verdicts again, word by word.
ORACLE_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + d) AS n FROM rep, (VALUES (0), (1), (2)) AS s(d) GROUP BY r),
counts AS (
  SELECT w.r, doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
f AS (SELECT *, base_failed OR 100 * n_symbols > 10 * n_words AS failed FROM b),
h AS (SELECT source, count(*) AS n, sum(failed::INT) AS f FROM f GROUP BY source),
p AS (SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS q, count(*) / sum(n) AS e FROM h),
k AS (SELECT m, CASE WHEN q - m * m - m * (1 - m) * e > 0 THEN least(1e6, greatest(2.0, m * (1 - m) / (q - m * m - m * (1 - m) * e) - 1)) ELSE 1e6 END AS k FROM p),
bad AS (SELECT source FROM h, k WHERE (f + m * k) / (n + k) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM f.source) AS kept
FROM f
"""
