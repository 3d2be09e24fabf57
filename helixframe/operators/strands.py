"""Strand design: payload chunks, counters, length search, regions and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna as D
from ..functions import duck as Q
from ..sources.tables import table

#: Payload capacity of the default 125-base strand, index length, bounds of the length search.
CAPACITY, INDEX_LENGTH = 76, 8
MIN_TOTAL, MAX_TOTAL = 120, 130
FIXED = len(D.FORWARD_PRIMER) + INDEX_LENGTH + len(D.REVERSE_PRIMER)


def split(df: DataFrame, capacity: int = CAPACITY, dna: str = "dna") -> DataFrame:
    """One row per chunk: the columns of df but the sequence, no (from 1), payload. Capacities below 1 count as 100."""
    size = capacity if capacity > 0 else 100
    kept = [c for c in df.columns if c != dna]
    chunks = F.when(F.length(dna) == 0, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(dna, F.lit(f".{{1,{size}}}"), F.lit(0)))
    out = df.select(*kept, F.posexplode(chunks).alias("no", "payload"))
    return out.withColumn("no", F.col("no") + 1)


def strands(df: DataFrame, capacity: int = CAPACITY, dna: str = "dna") -> DataFrame:
    """Chunks with a counter index between the primers, region lengths and metrics; no filler."""
    out = split(df, capacity, dna)
    index = D.base4(F.col("no") - 1, INDEX_LENGTH)
    full = F.concat(F.lit(D.FORWARD_PRIMER), "strand_index", "payload", F.lit(D.REVERSE_PRIMER))
    out = out.withColumn("strand_index", index).withColumn("full_strand", full)
    return out.withColumns(
        {
            "total_len": F.length("full_strand"),
            "gc_content": F.round(D.gc(F.col("full_strand")), 4),
            "longest_hp": D.longest_run(F.col("full_strand")),
            "hp_count": F.size(F.filter(D.runs(F.col("full_strand")), lambda r: r >= 2)),
        }
    )


def of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strands of every turn; the message is the pair conv_id, turn."""
    turns = table(spark, sf_dir, "conversations", spread=True)
    return strands(turns.select("conv_id", "turn", D.simple(F.coalesce("text", F.lit(""))).alias("dna")))


STRANDS_SQL = f"""
WITH e AS (SELECT conv_id, turn, {Q.simple("text")} AS dna FROM conversations),
p AS (SELECT conv_id, turn, i::INT AS no, substr(dna, (i - 1) * {CAPACITY} + 1, {CAPACITY}) AS payload FROM e, unnest(range(1, (length(dna) + {CAPACITY - 1}) // {CAPACITY} + 1)) AS u(i)),
s AS (SELECT *, {Q.base4("no - 1", INDEX_LENGTH)} AS strand_index FROM p),
f AS (SELECT *, '{D.FORWARD_PRIMER}' || strand_index || payload || '{D.REVERSE_PRIMER}' AS full_strand FROM s),
strands AS (SELECT *, length(full_strand)::INT AS total_len, round(length(translate(full_strand, 'AT', '')) / length(full_strand), 4) AS gc_content,
  list_max({Q.runs("full_strand")})::INT AS longest_hp, len(list_filter({Q.runs("full_strand")}, lambda x: x > 1))::INT AS hp_count FROM f)"""


def strand_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document's sequence, as counts and digests."""
    docs = table(spark, sf_dir, "documents", spread=True).select("doc_id", D.simple(F.coalesce("text", F.lit(""))).alias("dna"))
    return split(docs).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_strands"), F.min(F.length("payload")).alias("shortest"), F.max(F.length("payload")).alias("longest"), F.max_by("payload", "no").alias("last_payload")
    )


SPLIT_SQL = f"""
WITH e AS (SELECT doc_id, {Q.simple("text")} AS dna FROM documents)
SELECT doc_id, ((length(dna) + {CAPACITY - 1}) // {CAPACITY})::BIGINT AS n_strands, least(length(dna), CASE WHEN length(dna) % {CAPACITY} = 0 THEN {CAPACITY} ELSE length(dna) % {CAPACITY} END)::INT AS shortest,
least(length(dna), {CAPACITY})::INT AS longest, substr(dna, ((length(dna) - 1) // {CAPACITY}) * {CAPACITY} + 1) AS last_payload FROM e"""


def length_search(lengths: DataFrame, fixed: int = FIXED, low: int = MIN_TOTAL, high: int = MAX_TOTAL) -> DataFrame:
    """lengths (dna_len, ...) with the total strand length that leaves least filler, then has most capacity, then lies
    nearest the middle; null where no length leaves a capacity."""
    low, high = min(low, high), max(low, high)

    def candidate(total: Column) -> Column:
        capacity = total - fixed
        n = F.when(F.col("dna_len") > 0, F.greatest(F.lit(1), F.ceil(F.col("dna_len") / capacity))).otherwise(0).cast("long")
        return F.struct(
            (n * capacity - F.when(n > 0, F.col("dna_len")).otherwise(0)).alias("filler_total"),
            (-capacity).alias("neg"),
            F.abs(total - F.lit((low + high) / 2)).alias("off"),
            n.alias("n_strands"),
            total.alias("target_total_len"),
            capacity.alias("payload_capacity"),
        )

    totals = F.sequence(F.lit(max(low, fixed + 1)), F.lit(high)) if high > fixed else F.array().cast("array<int>")
    best = F.array_min(F.transform(totals, candidate))
    return lengths.withColumn("__b", best).select(*lengths.columns, *[F.col(f"__b.{c}").alias(c) for c in ("target_total_len", "payload_capacity", "n_strands", "filler_total")])


def strand_length_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True)
    return length_search(docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) * 4 + 1).alias("dna_len")))


LENGTH_SQL = f"""
WITH e AS (SELECT doc_id, (strlen(text) * 4 + 1)::INT AS dna_len FROM documents),
c AS (SELECT *, t - {FIXED} AS cap, greatest(1, ceil(dna_len / (t - {FIXED})))::BIGINT AS n FROM e, unnest(range({MIN_TOTAL}, {MAX_TOTAL + 1})) AS u(t) WHERE t > {FIXED}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n * cap - dna_len, -cap, abs(t - {(MIN_TOTAL + MAX_TOTAL) / 2}), n) AS k FROM c)
SELECT doc_id, dna_len, t::INT AS target_total_len, cap::INT AS payload_capacity, n AS n_strands, (n * cap - dna_len)::BIGINT AS filler_total FROM r WHERE k = 1"""


def strand_counter_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_conversations(spark, sf_dir)


def summary(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("strands"),
        F.sum("total_len").alias("total_bases"),
        F.round(F.avg("total_len"), 4).alias("mean_len"),
        F.round(F.sum(F.length(F.translate("full_strand", "AT", ""))) / F.sum("total_len"), 6).alias("gc"),
        F.max("longest_hp").alias("longest_hp"),
    )


def strand_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(of_conversations(spark, sf_dir), ["conv_id"])


SUMMARY_SQL = f"""{STRANDS_SQL} SELECT conv_id, count(*) AS strands, sum(total_len)::BIGINT AS total_bases, round(avg(total_len), 4) AS mean_len,
round(sum(length(translate(full_strand, 'AT', ''))) / sum(total_len), 6) AS gc, max(longest_hp) AS longest_hp FROM strands GROUP BY conv_id"""


def summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of all strands as property and value rows."""
    s = of_conversations(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("strands"), F.sum("total_len").alias("bases"), F.max("longest_hp").alias("hp"), F.sum("hp_count").alias("hps")
    )
    return s.select(F.expr("stack(4, 'strand_count', strands, 'total_bases', bases, 'longest_homopolymer', cast(hp as bigint), 'homopolymers', hps) as (property, value)"))


SUMMARY_ROWS_SQL = f"""{STRANDS_SQL}, a AS (SELECT count(*) AS strand_count, sum(total_len)::BIGINT AS total_bases, max(longest_hp)::BIGINT AS longest_homopolymer, sum(hp_count)::BIGINT AS homopolymers FROM strands)
UNPIVOT a ON strand_count, total_bases, longest_homopolymer, homopolymers INTO NAME property VALUE value"""


def regions(df: DataFrame) -> DataFrame:
    """One row per strand region with its one-based bounds, also empty ones."""
    kept = [c for c in ("conv_id", "turn", "no") if c in df.columns]
    names, lens = ("FBR", "SI", "Payload", "Filler", "RBR"), (F.lit(len(D.FORWARD_PRIMER)), F.length("strand_index"), F.length("payload"), F.lit(0), F.lit(len(D.REVERSE_PRIMER)))
    ends, at = [], F.lit(0)
    for name, n in zip(names, lens):
        ends.append(F.struct(F.lit(name).alias("region"), (at + 1).alias("first"), (at + n).alias("last")))
        at = at + n
    return df.select(*kept, F.inline(F.array(*ends)))


def strand_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(of_conversations(spark, sf_dir))


_R = [("FBR", "0", "20"), ("SI", "20", "8"), ("Payload", "28", "length(payload)"), ("Filler", "28 + length(payload)", "0"), ("RBR", "28 + length(payload)", "21")]
REGIONS_SQL = STRANDS_SQL + " UNION ALL ".join(f" SELECT conv_id, turn, no, '{r}' AS region, ({a} + 1)::INT AS first, ({a} + {n})::INT AS last FROM strands" for r, a, n in _R)


def payload_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads put together again in the order of the strands and decoded."""
    parts = of_conversations(spark, sf_dir).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("no", "payload"))).alias("p"))
    dna = F.array_join(F.transform("p", lambda x: x["payload"]), "")
    return parts.select("conv_id", "turn", F.length(dna).alias("bases"), F.sha2(D.unsimple(dna), 256).alias("decoded_sha256"))


PAYLOAD_SQL = "SELECT conv_id, turn, (strlen(text) * 4 + 1)::INT AS bases, sha256(text) AS decoded_sha256 FROM conversations"

QUERIES = {
    "strand_split": (strand_split, SPLIT_SQL),
    "strand_counter_index": (strand_counter_index, STRANDS_SQL + " SELECT * FROM strands"),
    "strand_length_search": (strand_length_search, LENGTH_SQL),
    "strand_summary": (strand_summary, SUMMARY_SQL),
    "strand_summary_rows": (summary_rows, SUMMARY_ROWS_SQL),
    "strand_regions_unpivot": (strand_regions, REGIONS_SQL),
    "strand_payload_join": (payload_join, PAYLOAD_SQL),
}
