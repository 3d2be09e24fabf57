"""Noise on strands, sequencing reads, clustering and consensus.

Draws are hashes of seed and keys instead of a generator's stream, so any engine gets the same ones, in any order:
same distribution as drawing one by one, not the same stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dna as D
from ..functions import draws as R
from ..functions import duck as Q
from ..sources.scratch import written
from ..sources.tables import table
from . import strands as S

SEED = 7
SUBSTITUTION, INSERTION, DELETION = 0.02, 0.005, 0.005
COVERAGE, DROPOUT, READ_ERROR = 5, 0.05, 0.01
MAX_PREFIX_EDIT, Q_GRAM = 6, 5
#: Bases that a task draws at a time.
STEP_BASES = 1_000_000
FULL = float(2**32)
# Arrays of drawn bases are exploded by explode_outer and a test for null behind it: explode lets the optimizer put a test of
# the array's size before it, which would draw every base once more.
PREFIX = len(D.FORWARD_PRIMER) + S.INDEX_LENGTH


def _bound(rate: float) -> int:
    return int(rate * FULL)


def _base_index(base: Column) -> Column:
    return F.when(base == "A", 0).when(base == "C", 1).when(base == "G", 2).otherwise(3)


def _substitute(base: Column, v: Column) -> Column:
    return F.substring(F.lit(D.BASES), ((_base_index(base) + 1 + v % 3) % 4 + 1).cast("int"), F.lit(1))


def _bases(sequence: Column) -> Column:
    return F.filter(F.split(sequence, ""), lambda b: b != "")


def _digest(seed: int, keys: list[Column], i: Column) -> Column:
    """Draws of the base at place i (from 0): eight hexadecimal digits each."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys], (i + 1).cast("string")))


def _below(digest: Column, rate: float) -> Column:
    """Whether the first draw is below rate; digits of one length compare as numbers do."""
    return F.lit(False) if _bound(rate) <= 0 else F.substring(digest, 1, 8) <= f"{min(_bound(rate), 2**32) - 1:08x}"


def _second(digest: Column) -> Column:
    return F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")


def _joined(column: str, field: str) -> Column:
    return F.array_join(F.transform(column, lambda x: x[field]), "")


def _count(column: str, test) -> Column:
    return F.size(F.filter(column, test)).cast("long")


def substitution_noise(df: DataFrame, keys: list[str], sequence: str, rate: float = SUBSTITUTION, seed: int = SEED) -> DataFrame:
    """df with `places`, an array of (pos from 1, old, base, changed) of the sequence under noise; drawn within the row."""
    k = [F.col(c) for c in keys]

    def place(base: Column, i: Column) -> Column:
        digest = _digest(seed, k, i)
        changed = _below(digest, rate)
        return F.struct((i + 1).alias("pos"), base.alias("old"), changed.alias("changed"), F.when(changed, _substitute(base, _second(digest))).otherwise(base).alias("base"))

    return df.withColumn("places", F.transform(_bases(F.col(sequence)), place))


def noise_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy sequence and number of changes of each benchmark text."""
    df = table(spark, sf_dir, "benchmark", spread=True).select("item_id", D.simple(F.coalesce("text", F.lit(""))).alias("dna"))
    out = substitution_noise(df, ["item_id"], "dna")
    changed = _count("places", lambda x: x["changed"]).alias("substituted")
    return out.select("item_id", F.size("places").cast("long").alias("bases"), changed, _joined("places", "base").alias("noisy_dna"))


_IDX = "CASE {b} WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 ELSE 3 END"
_SUB = "substr('ACGT', ((" + _IDX + " + 1 + {v} % 3) % 4 + 1)::INT, 1)"
SUBSTITUTION_SQL = f"""
WITH e AS (SELECT item_id, {Q.simple("text")} AS dna FROM benchmark),
b AS (SELECT item_id, pos, substr(dna, pos, 1) AS base FROM e, unnest(range(1, length(dna) + 1)) AS u(pos)),
d AS (SELECT *, {Q.uniform(SEED, "item_id || '|' || pos", 1)} AS u, {Q.uniform(SEED, "item_id || '|' || pos", 9)} AS v FROM b),
n AS (SELECT *, u < {_bound(SUBSTITUTION)} AS changed FROM d)
SELECT item_id, count(*) AS bases, count(*) FILTER (changed) AS substituted, string_agg(CASE WHEN changed THEN {_SUB.format(b="base", v="v")} ELSE base END, '' ORDER BY pos) AS noisy_dna
FROM n GROUP BY item_id"""


class Mutations:
    """What becomes of every base of some sequences: gone, changed, inserted (tests), kept and new (bytes, 0 for none).

    A base is deleted or not, else substituted or not, and a base may be inserted behind it, each by a draw of its own: the
    four parts of one digest decide deletion, substitution, insertion, and the new bases.
    """

    def __init__(self, prefixes: list[bytes], bases: np.ndarray, lengths: np.ndarray, sub: float, ins: float, dele: float) -> None:
        n = len(bases)
        self.bases, self.starts = bases, np.concatenate([[0], np.cumsum(lengths)])
        self.seq, self.place = np.empty(n, dtype=np.int32), np.empty(n, dtype=np.int32)
        self.gone, self.changed, self.inserted = (np.empty(n, dtype=bool) for _ in range(3))
        self.kept, self.new = bases.copy(), np.zeros(n, dtype=np.uint8)
        at = 0
        for seq, place, (d, s, i, v) in R.digests(prefixes, lengths):
            own = slice(at, at + len(seq))
            self.seq[own], self.place[own] = seq, place
            self.gone[own] = gone = d < _bound(dele)
            self.changed[own] = changed = ~gone & (s < _bound(sub))
            self.inserted[own] = inserted = i < _bound(ins)
            self.kept[own][changed] = _other(bases[own][changed], v[changed])
            self.kept[own][gone] = 0
            self.new[own][inserted] = _LETTERS[v[inserted] // 3 % 4]
            at = own.stop

    def count(self, test: np.ndarray) -> np.ndarray:
        """How many bases of each sequence a test holds for."""
        return np.diff(np.concatenate([[0], np.cumsum(test, dtype=np.int64)])[self.starts])

    def out(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of what the sequences become, and each one's number of bytes."""
        cells = np.stack([self.kept, self.new], axis=1).ravel()
        return cells[cells != 0], self.count(self.kept != 0) + self.count(self.new != 0)

    def before(self) -> np.ndarray:
        """How many bases of the read come before a base of the sequence."""
        ends = np.cumsum((self.kept != 0).astype(np.int64) + (self.new != 0))
        begin = np.concatenate([[0], ends])
        return begin[:-1] - begin[self.starts[self.seq]]


_LETTERS = np.frombuffer(D.BASES.encode(), dtype=np.uint8)
_PLACES = np.full(256, 3, dtype=np.uint32)
_PLACES[_LETTERS] = np.arange(4)


def _other(bases: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Another base than each of these, by a draw."""
    return _LETTERS[(_PLACES[bases] + 1 + v % 3) % 4]


def _by_batch(df: DataFrame, keys: list[str], sequence: str, schema: str, work: Callable, seed: int) -> DataFrame:
    """work(rows as an Arrow batch, prefixes of their draws, bytes of their sequences, lengths) for some million bases at a time.
    A null sequence counts as empty."""
    kept = [c for c in df.columns if c != sequence]
    prefix = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.lit(""))
    rows = df.select(*kept, F.coalesce(F.col(sequence), F.lit("")).alias("__sequence"), prefix.alias("__prefix"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(R.strings(batch["__sequence"])[1])
            at = 0
            while at < len(batch):  # a row at least
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_BASES, side="right")))
                part = batch.slice(at, stop - at)
                yield from work(part.select(kept), [p.encode() for p in part["__prefix"].to_pylist()], *R.strings(part["__sequence"]))
                at = stop

    return rows.mapInArrow(run, schema)


def _schema(df: DataFrame, sequence: str, more: str) -> str:
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != sequence)
    return f"{own}, {more}"


def _with(part: pa.RecordBatch, **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*part.columns, *more.values()], names=[*part.schema.names, *more])


def substituted(df: DataFrame, keys: list[str], sequence: str, rate: float = SUBSTITUTION, seed: int = SEED) -> DataFrame:
    """df with `noisy` in the place of the sequence and `substituted`, the number of its changes; draws as in `substitution_noise`."""

    def work(part, prefixes, bases, lengths):
        noisy, hits, at = bases.copy(), np.empty(len(bases), dtype=bool), 0
        for seq, _, (u, v, _, _) in R.digests(prefixes, lengths):
            own = slice(at, at + len(seq))
            hits[own] = changed = u < _bound(rate)
            noisy[own][changed] = _other(bases[own][changed], v[changed])
            at = own.stop
        counts = np.diff(np.concatenate([[0], np.cumsum(hits, dtype=np.int64)])[np.concatenate([[0], np.cumsum(lengths)])])
        yield _with(part, noisy=R.to_strings(noisy, lengths), substituted=pa.array(counts))

    return _by_batch(df, keys, sequence, _schema(df, sequence, "noisy string, substituted long"), work, seed)


def mutated(df: DataFrame, keys: list[str], sequence: str, sub: float = SUBSTITUTION, ins: float = INSERTION, dele: float = DELETION, seed: int = SEED) -> DataFrame:
    """df with `out`, what the sequence becomes, in its place, and the numbers of errors, n_sub, n_ins and n_del."""

    def work(part, prefixes, bases, lengths):
        m = Mutations(prefixes, bases, lengths, sub, ins, dele)
        yield _with(part, out=R.to_strings(*m.out()), n_sub=pa.array(m.count(m.changed)), n_ins=pa.array(m.count(m.inserted)), n_del=pa.array(m.count(m.gone)))

    return _by_batch(df, keys, sequence, _schema(df, sequence, "out string, n_sub long, n_ins long, n_del long"), work, seed)


def mutation_events(df: DataFrame, keys: list[str], sequence: str, sub: float = SUBSTITUTION, ins: float = INSERTION, dele: float = DELETION, seed: int = SEED) -> DataFrame:
    """A row for each error: the columns of df but the sequence, places in the sequence and in the read, operation, bases before and after."""

    def work(part, prefixes, bases, lengths):
        m = Mutations(prefixes, bases, lengths, sub, ins, dele)
        own, new, before = np.flatnonzero(m.gone | m.changed), np.flatnonzero(m.inserted), m.before()
        read = np.concatenate([before[own] + 1, before[new] + np.where(m.gone[new], 1, 2)]).astype(np.int32)
        operation = np.concatenate([np.where(m.gone[own], 0, 1), np.full(len(new), 2)])
        to = np.concatenate([m.kept[own], m.new[new]])
        at = np.concatenate([own, new])
        yield _with(
            part.take(pa.array(m.seq[at])), position_original=pa.array(m.place[at] + np.int32(1)), position_read=pa.array(read),
            operation=pa.array(["deletion", "substitution", "insertion"]).take(pa.array(operation)),
            from_base=R.to_strings(bases[own], np.concatenate([np.ones(len(own)), np.zeros(len(new))])), to_base=R.to_strings(to[to != 0], to != 0),
        )

    return _by_batch(df, keys, sequence, _schema(df, sequence, "position_original int, position_read int, operation string, from_base string, to_base string"), work, seed)


def region_of(pos: Column, payload_len: Column) -> Column:
    a = len(D.FORWARD_PRIMER)
    return F.when(pos <= a, "FBR").when(pos <= PREFIX, "SI").when(pos <= payload_len + PREFIX, "Payload").otherwise("RBR")


_STRAND = ["conv_id", "turn", "no", "payload_len"]


def _payload_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.of_conversations(spark, sf_dir).select("conv_id", "turn", "no", F.length("payload").alias("payload_len"), "full_strand")


def noise_event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per error: place in strand and read, region, operation, bases before and after."""
    rows = mutation_events(_payload_strands(spark, sf_dir), _STRAND, "full_strand")
    region = region_of(F.col("position_original"), F.col("payload_len")).alias("region")
    return rows.select("conv_id", "turn", "no", "position_original", region, "position_read", "operation", "from_base", "to_base")


_K = "conv_id || '|' || turn || '|' || no || '|' || length(payload) || '|' || pos"
MUTATED_SQL = f"""{S.STRANDS_SQL},
b AS (SELECT conv_id, turn, no, payload, pos, substr(full_strand, pos, 1) AS base FROM strands, unnest(range(1, length(full_strand) + 1)) AS u(pos)),
d AS (SELECT *, {Q.uniform(SEED, _K, 1)} AS du, {Q.uniform(SEED, _K, 9)} AS su, {Q.uniform(SEED, _K, 17)} AS iu, {Q.uniform(SEED, _K, 25)} AS sv FROM b),
o AS (SELECT *, CASE WHEN du < {_bound(DELETION)} THEN 'deletion' WHEN su < {_bound(SUBSTITUTION)} THEN 'substitution' END AS op,
  CASE WHEN iu < {_bound(INSERTION)} THEN substr('ACGT', (sv // 3 % 4 + 1)::INT, 1) END AS inserted,
  CASE WHEN pos <= 20 THEN 'FBR' WHEN pos <= 28 THEN 'SI' WHEN pos <= 28 + length(payload) THEN 'Payload' ELSE 'RBR' END AS region FROM d),
mutated AS (SELECT *, (CASE WHEN op = 'deletion' THEN '' WHEN op = 'substitution' THEN {_SUB.format(b="base", v="sv")} ELSE base END) || coalesce(inserted, '') AS out FROM o)"""
EVENTS_SQL = f"""{MUTATED_SQL},
w AS (SELECT *, (sum(length(out)) OVER (PARTITION BY conv_id, turn, no ORDER BY pos) - length(out))::INT AS before FROM mutated)
SELECT conv_id, turn, no, (pos)::INT AS position_original, region, before + 1 AS position_read, op AS operation, base AS from_base, CASE WHEN op = 'deletion' THEN '' ELSE substr(out, 1, 1) END AS to_base FROM w WHERE op IS NOT NULL
UNION ALL SELECT conv_id, turn, no, (pos)::INT, region, before + CASE WHEN op = 'deletion' THEN 0 ELSE 1 END + 1, 'insertion', '', inserted FROM w WHERE inserted IS NOT NULL"""


def noise_op_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise_event_table(spark, sf_dir).groupBy("region", "operation").agg(F.count(F.lit(1)).alias("events"))


def noise_strand_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error strand, the fixed-place payload slice of it, and error counts of every strand."""
    rows = mutated(_payload_strands(spark, sf_dir), _STRAND, "full_strand")
    return rows.select("conv_id", "turn", "no", F.col("out").alias("error_full"), "n_sub", "n_ins", "n_del", F.substring("out", F.lit(PREFIX + 1), F.col("payload_len")).alias("error_payload"))


STRAND_ROWS_SQL = f"""{MUTATED_SQL},
g AS (SELECT conv_id, turn, no, length(any_value(payload)) AS n, string_agg(out, '' ORDER BY pos) AS error_full, count(*) FILTER (op = 'substitution') AS n_sub, count(inserted) AS n_ins, count(*) FILTER (op = 'deletion') AS n_del FROM mutated GROUP BY conv_id, turn, no)
SELECT conv_id, turn, no, error_full, n_sub, n_ins, n_del, substr(error_full, {PREFIX + 1}, n) AS error_payload FROM g"""


def noise_scope_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitutions in the payload only; the rest of the strand stays."""
    s = S.of_conversations(spark, sf_dir).select("conv_id", "turn", "no", "payload").where("payload <> ''")
    out = substituted(s, ["conv_id", "turn", "no"], "payload")
    return out.select("conv_id", "turn", "no", "substituted", F.col("noisy").alias("noisy_payload"))


_K3 = "conv_id || '|' || turn || '|' || no || '|' || pos"
SCOPE_SQL = f"""{S.STRANDS_SQL},
b AS (SELECT conv_id, turn, no, pos, substr(payload, pos, 1) AS base FROM strands, unnest(range(1, length(payload) + 1)) AS u(pos)),
d AS (SELECT *, {Q.uniform(SEED, _K3, 1)} AS u, {Q.uniform(SEED, _K3, 9)} AS v FROM b), n AS (SELECT *, u < {_bound(SUBSTITUTION)} AS changed FROM d)
SELECT conv_id, turn, no, count(*) FILTER (changed) AS substituted, string_agg(CASE WHEN changed THEN {_SUB.format(b="base", v="v")} ELSE base END, '' ORDER BY pos) AS noisy_payload FROM n GROUP BY conv_id, turn, no"""


def reads(df: DataFrame, keys: list[str], coverage: int = COVERAGE, dropout: float = DROPOUT, rate: float = READ_ERROR, ins: float = 0.0, dele: float = 0.0, seed: int = SEED, spread: bool = False) -> DataFrame:
    """keys, copy_no, template, seq, n_sub, n_ins, n_del of the reads that weren't dropped.

    spread: a strand's number of copies is drawn evenly between half the coverage and half as much again, one at least.
    One draw decides each base: substituted (by any base, also its own), an insertion before it, kept, or deleted.
    """
    drawn, _ = D.hash_uniform(seed + 5, *[F.col(c) for c in keys])
    low, high = max(1.0, coverage * 0.5), max(1.0, coverage * 1.5)
    number = F.greatest(F.lit(1), F.bround(F.lit(low) + drawn / F.lit(FULL) * (high - low), 0).cast("int")) if spread else F.lit(max(1, coverage))
    copies = df.select(*keys, "full_strand", F.explode(F.sequence(F.lit(1), number)).alias("copy_no"))
    k = [F.col(c) for c in (*keys, "copy_no")]
    lost, _ = D.hash_uniform(seed + 3, *k)
    copies = copies.where(lost >= _bound(dropout))

    def place(base: Column, i: Column) -> Column:
        digest = _digest(seed + 4, k, i)
        new = F.substring(F.lit(D.BASES), (_second(digest) % 4 + 1).cast("int"), F.lit(1))
        return (
            F.when(_below(digest, rate + ins + dele), F.struct(F.when(_below(digest, rate), "s").when(_below(digest, rate + ins), "i").otherwise("d").alias("kind"), new.alias("new"), base.alias("base")))
            .otherwise(F.struct(F.lit("k").alias("kind"), F.lit("").alias("new"), base.alias("base")))
        )

    become = lambda p: F.when(p["kind"] == "s", p["new"]).when(p["kind"] == "i", F.concat(p["new"], p["base"])).when(p["kind"] == "d", "").otherwise(p["base"])
    of = lambda kind: _count("places", lambda p: p["kind"] == kind)
    rows = copies.withColumn("places", F.transform(_bases(F.col("full_strand")), place))
    seq = F.coalesce(F.array_join(F.transform("places", become), ""), F.lit(""))  # never null, so no join tests it before it is made
    return rows.select(*keys, "copy_no", F.col("full_strand").alias("template"), seq.alias("seq"), of("s").alias("n_sub"), of("i").alias("n_ins"), of("d").alias("n_del"))


def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "benchmark", spread=True).select("item_id", D.simple(F.coalesce("text", F.lit(""))).alias("dna"))
    return S.strands(df)


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(_templates(spark, sf_dir), ["item_id", "no"])


def _written_reads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reads and their templates, drawn once for all that a dataflow does with them."""
    templates = written(_templates(spark, sf_dir), "templates")
    return written(reads(templates, ["item_id", "no"]), "reads"), templates


def reads_simulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reads(spark, sf_dir).drop("template")


def reads_random_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads at a coverage that each strand draws, with all three kinds of errors."""
    return reads(_templates(spark, sf_dir), ["item_id", "no"], rate=0.01, ins=0.004, dele=0.006, spread=True).drop("template")


_B = S.STRANDS_SQL.replace("conv_id, turn", "item_id").replace("conversations", "benchmark")
_KC = "item_id || '|' || no || '|' || copy_no"
READS_SQL = f"""{_B},
c AS (SELECT item_id, no, full_strand, payload, strand_index, copy_no::INT AS copy_no FROM strands, unnest(range(1, {COVERAGE + 1})) AS u(copy_no)),
k AS (SELECT * FROM c WHERE {Q.uniform(SEED + 3, _KC, 1)} >= {_bound(DROPOUT)}),
b AS (SELECT item_id, no, copy_no, full_strand, payload, pos, substr(full_strand, pos, 1) AS base FROM k, unnest(range(1, length(full_strand) + 1)) AS u(pos)),
d AS (SELECT *, {Q.uniform(SEED + 4, _KC + " || '|' || pos", 1)} AS u, {Q.uniform(SEED + 4, _KC + " || '|' || pos", 9)} AS v FROM b),
reads AS (SELECT item_id, no, copy_no, full_strand, string_agg(CASE WHEN u < {_bound(READ_ERROR)} THEN substr('ACGT', (v % 4 + 1)::INT, 1) ELSE base END, '' ORDER BY pos) AS seq,
  count(*) FILTER (u < {_bound(READ_ERROR)}) AS n_sub, 0::BIGINT AS n_ins, 0::BIGINT AS n_del FROM d GROUP BY item_id, no, copy_no, full_strand)"""


_COPIES = f"greatest(1, round_even({COVERAGE * 0.5} + {Q.uniform(SEED + 5, "item_id || '|' || no", 1)} / {FULL} * {COVERAGE * 1.0}, 0)::INT)"
_NEW = "substr('ACGT', (v % 4 + 1)::INT, 1)"
RANDOM_SQL = f"""{_B},
c AS (SELECT item_id, no, full_strand, copy_no::INT AS copy_no FROM (SELECT *, {_COPIES} AS copies FROM strands), unnest(range(1, copies + 1)) AS u(copy_no)),
k AS (SELECT * FROM c WHERE {Q.uniform(SEED + 3, _KC, 1)} >= {_bound(DROPOUT)}),
b AS (SELECT item_id, no, copy_no, pos, substr(full_strand, pos, 1) AS base FROM k, unnest(range(1, length(full_strand) + 1)) AS u(pos)),
d AS (SELECT *, {Q.uniform(SEED + 4, _KC + " || '|' || pos", 1)} AS u, {Q.uniform(SEED + 4, _KC + " || '|' || pos", 9)} AS v FROM b),
o AS (SELECT *, CASE WHEN u < {_bound(0.01)} THEN 's' WHEN u < {_bound(0.01 + 0.004)} THEN 'i' WHEN u < {_bound(0.01 + 0.004 + 0.006)} THEN 'd' ELSE 'k' END AS kind FROM d)
SELECT item_id, no, copy_no, string_agg(CASE kind WHEN 's' THEN {_NEW} WHEN 'i' THEN {_NEW} || base WHEN 'd' THEN '' ELSE base END, '' ORDER BY pos) AS seq,
count(*) FILTER (kind = 's') AS n_sub, count(*) FILTER (kind = 'i') AS n_ins, count(*) FILTER (kind = 'd') AS n_del FROM o GROUP BY item_id, no, copy_no"""


def reads_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempted, dropped and lost; errors and their observed rate."""
    r, templates = _written_reads(spark, sf_dir)
    own = r.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("reads"), F.count_distinct("no").alias("strands_with_reads"), F.sum("n_sub").alias("substitutions"), F.sum(F.length("template")).alias("nt")
    )
    all_ = templates.groupBy("item_id").agg(F.count(F.lit(1)).alias("input_strands"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return all_.join(own, "item_id", "left").select(
        "item_id",
        "input_strands",
        (F.col("input_strands") * COVERAGE).alias("attempted_reads"),
        (F.col("input_strands") * COVERAGE - z("reads")).alias("dropped_reads"),
        z("strands_with_reads").alias("strands_with_reads"),
        (F.col("input_strands") - z("strands_with_reads")).alias("lost_strands"),
        z("substitutions").alias("total_substitutions"),
        F.round(F.coalesce(F.col("substitutions") / F.col("nt"), F.lit(0.0)), 6).alias("observed_error_rate"),
    )


READS_SUMMARY_SQL = f"""{READS_SQL},
o AS (SELECT item_id, count(*) AS reads, count(DISTINCT no) AS ns, sum(n_sub) AS subs, sum(length(full_strand)) AS nt FROM reads GROUP BY item_id),
a AS (SELECT item_id, count(*) AS input_strands FROM strands GROUP BY item_id)
SELECT item_id, input_strands, input_strands * {COVERAGE} AS attempted_reads, (input_strands * {COVERAGE} - coalesce(reads, 0))::BIGINT AS dropped_reads, coalesce(ns, 0)::BIGINT AS strands_with_reads,
(input_strands - coalesce(ns, 0))::BIGINT AS lost_strands, coalesce(subs, 0)::BIGINT AS total_substitutions, round(coalesce(subs / nt, 0), 6) AS observed_error_rate FROM a LEFT JOIN o USING (item_id)"""


def cluster_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads by the strand they came from."""
    t = _templates(spark, sf_dir).select("item_id", "no")
    return t.join(_reads(spark, sf_dir), ["item_id", "no"]).groupBy("item_id", "no").agg(F.count(F.lit(1)).alias("reads"))


def nearest_prefix(read: DataFrame, templates: DataFrame, message: str, limit: int = MAX_PREFIX_EDIT + 4) -> DataFrame:
    """read with `assigned`, the strand of the same message whose designed prefix is nearest in edits (ties: nearest
    length, then least number), null beyond the limit.

    Equal prefixes join by hash. At one edit a half of the index is whole, moved by one place at most, so the second
    join is on halves; what is farther still (some 3 % at one error in 100 bases) compares within its message, which
    holds at most 4**INDEX_LENGTH strands."""
    t = templates.select(message, F.col("no").alias("assigned"), F.substring("full_strand", 1, PREFIX).alias("prefix"))
    own = read.withColumn("rp", F.substring("seq", 1, PREFIX))
    keys = read.columns
    exact = own.join(t.groupBy(message, F.col("prefix").alias("rp")).agg(F.min("assigned").alias("assigned")), [message, "rp"], "left").withColumn("edits", F.when(F.col("assigned").isNotNull(), 0))
    exact = written(exact, "exact-prefixes")
    off = exact.where("assigned IS NULL").select(*keys, "rp")

    def best(pairs: DataFrame, most: int) -> DataFrame:
        pairs = pairs.withColumn("edits", F.levenshtein("rp", "prefix", most)).where("edits >= 0")
        nearest = F.min(F.struct("edits", F.abs(F.length("rp") - F.length("prefix")).alias("gap"), "assigned"))
        return pairs.groupBy(*keys, "rp").agg(nearest.alias("b")).select(*keys, F.col("b.assigned").alias("assigned"), F.col("b.edits").alias("edits"))

    half, begin = S.INDEX_LENGTH // 2, PREFIX - S.INDEX_LENGTH
    part = lambda sequence, h, move: F.struct(F.lit(h).alias("h"), F.substring(sequence, begin + 1 + h * half + move, half).alias("half"))
    halves = t.withColumn("part", F.explode(F.array(*[part("prefix", h, 0) for h in (0, 1)])))
    moved = off.withColumn("part", F.explode(F.array_distinct(F.array(*[part("rp", h, m) for h in (0, 1) for m in (-1, 0, 1)]))))
    near = written(best(moved.join(halves, [message, "part"]), 1), "near-prefixes")
    far = off.join(near.select(*keys), keys, "left_anti")
    other = far.select(*keys).join(best(far.join(t, message), limit), keys, "left")
    return exact.where("assigned IS NOT NULL").select(*keys, "assigned", "edits").unionByName(near).unionByName(other)


def cluster_index_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, templates = _written_reads(spark, sf_dir)
    return nearest_prefix(r.select("item_id", "no", "copy_no", "seq"), templates, "item_id").drop("seq")


INDEX_AWARE_SQL = f"""{READS_SQL},
pp AS (SELECT r.item_id, r.no, r.copy_no, t.no AS assigned, levenshtein(substr(r.seq, 1, {PREFIX}), substr(t.full_strand, 1, {PREFIX}))::INT AS edits FROM reads r JOIN strands t ON r.item_id = t.item_id),
kk AS (SELECT *, row_number() OVER (PARTITION BY item_id, no, copy_no ORDER BY edits, assigned) AS k FROM pp)
SELECT item_id, no, copy_no, CASE WHEN edits <= {MAX_PREFIX_EDIT + 4} THEN assigned END AS assigned, CASE WHEN edits <= {MAX_PREFIX_EDIT + 4} THEN edits END AS edits FROM kk WHERE k = 1"""


def q_grams(sequence: Column, q: int = Q_GRAM) -> Column:
    """Distinct q-grams; a shorter sequence is one."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(sequence) - q + 1, F.lit(1))), lambda i: F.substring(sequence, i, F.lit(q)))
    return F.when(F.length(sequence) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def cluster_qgram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads by the strand of their message with the highest q-gram Jaccard similarity.

    Strands are found through shared q-grams other than the primers', which all strands have and which are only
    counted. Strands that share no more than those differ by their sizes alone, so one of each size competes."""
    common = F.array(*[F.lit(g) for p in (D.FORWARD_PRIMER, D.REVERSE_PRIMER) for g in sorted({p[i : i + Q_GRAM] for i in range(len(p) - Q_GRAM + 1)})])
    read_rows, templates = _written_reads(spark, sf_dir)
    r = read_rows.select("item_id", "no", "copy_no", q_grams(F.col("seq")).alias("g"), F.length("seq").alias("n"))
    r = r.select("item_id", "no", "copy_no", "n", F.size("g").alias("gs"), F.size(F.array_intersect("g", common)).alias("base"), F.array_except("g", common).alias("g"))
    t = templates.select("item_id", F.col("no").alias("assigned"), q_grams(F.col("full_strand")).alias("tg"), F.length("full_strand").alias("tn"))
    t = t.select("item_id", "assigned", "tn", F.size("tg").alias("ts"), F.array_except("tg", common).alias("tg"))
    read = ["item_id", "no", "copy_no", "n", "gs", "base"]
    a = r.select(*read, F.explode_outer("g").alias("gram")).where("gram IS NOT NULL")
    b = t.select("item_id", "assigned", "tn", "ts", F.explode("tg").alias("gram"))
    both = a.join(b, ["item_id", "gram"]).groupBy(*read, "assigned", "tn", "ts").agg(F.count(F.lit(1)).alias("more"))
    sizes = t.groupBy("item_id", "tn", "ts").agg(F.min("assigned").alias("assigned"))
    both = both.unionByName(r.select(*read).join(sizes, "item_id").withColumn("more", F.lit(0)))
    c = F.col("base") + F.col("more")
    score = c / (F.col("gs") + F.col("ts") - c)
    best = both.groupBy("item_id", "no", "copy_no").agg(F.min(F.struct((-score).alias("s"), F.abs(F.col("n") - F.col("tn")).alias("gap"), "assigned")).alias("b"))
    return best.select("item_id", "no", "copy_no", "b.assigned", F.round(-F.col("b.s"), 6).alias("jaccard"))


_GRAMS = "list_distinct(list_transform(range(1, greatest(length({s}) - 4, 1) + 1), lambda i: substr({s}, i, 5)))"
QGRAM_SQL = f"""{READS_SQL},
gr AS (SELECT item_id, no, copy_no, length(seq) AS n, {_GRAMS.format(s="seq")} AS g FROM reads),
t AS (SELECT item_id, no AS assigned, length(full_strand) AS tn, {_GRAMS.format(s="full_strand")} AS tg FROM strands),
pp AS (SELECT gr.item_id, no, copy_no, assigned, n, tn, len(list_intersect(g, tg)) AS c, len(g) AS gs, len(tg) AS ts FROM gr JOIN t USING (item_id)),
kk AS (SELECT *, c / (gs + ts - c) AS j, row_number() OVER (PARTITION BY item_id, no, copy_no ORDER BY c / (gs + ts - c) DESC, abs(n - tn), assigned) AS k FROM pp)
SELECT item_id, no, copy_no, assigned, round(j, 6) AS jaccard FROM kk WHERE k = 1"""


def vote(called: DataFrame, templates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, reconstructed_full: majority of the bases that `called` (keys, calls) has at each place of full_strand. Ties
    go to A, C, G, T in turn; `-` has no vote; a place without votes keeps the strand's base. Strands without calls are missing.

    Only calls that differ from the strand are counted one by one, by partial aggregation; all others vote for its base."""
    places = F.transform(_bases(F.col("calls")), lambda b, i: F.struct((i + 1).alias("pos"), b.alias("base")))
    differ = F.filter(F.zip_with(places, _bases(F.col("full_strand")), lambda x, o: x.withField("own", o)), lambda x: x["base"] != x["own"])
    own = called.join(templates.select(*keys, "full_strand"), keys)
    votes = own.select(*keys, F.explode_outer(differ).alias("d")).where("d IS NOT NULL").groupBy(*keys, "d.pos", "d.own", "d.base").agg(F.count(F.lit(1)).alias("c"))
    voters = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("voters"))
    order = F.when(F.col("base") != "-", F.struct((-F.col("c")).alias("c"), "base"))
    best = votes.groupBy(*keys, "pos", "own").agg(F.min(order).alias("b"), F.sum("c").alias("others")).where("b IS NOT NULL").join(voters, keys)
    won = F.least("b", F.struct((F.col("others") - F.col("voters")).alias("c"), F.col("own").alias("base")))["base"]
    changes = best.select(*keys, F.struct("pos", won.alias("base")).alias("x"), "own").where("x.base != own")
    changes = changes.groupBy(*keys).agg(F.map_from_entries(F.collect_list("x")).alias("changed"))  # a strand's places at most
    out = templates.select(*keys, "full_strand").join(voters, keys).join(changes, keys, "left")
    made = F.array_join(F.transform(_bases(F.col("full_strand")), lambda b, i: F.coalesce(F.col("changed")[i + 1], b)), "")
    return out.select(*keys, F.when(F.col("changed").isNull(), F.col("full_strand")).otherwise(made).alias("reconstructed_full"))


def consensus(read: DataFrame, templates: DataFrame, keys: list[str]) -> DataFrame:
    """Consensus of each strand from reads of its length, with its mismatches."""
    template = templates.select(*keys, "full_strand", "payload")
    called = read.join(template, keys).where(F.length("seq") == F.length("full_strand")).select(*keys, F.col("seq").alias("calls"))
    used = read.groupBy(*keys).agg(F.count(F.lit(1)).alias("reads_used"))
    payload = F.substring("reconstructed_full", F.lit(PREFIX + 1), F.length("payload"))
    out = vote(called, templates, keys).join(used, keys).join(template, keys).withColumn("reconstructed_payload", payload)
    return out.select(
        *keys, "reads_used", "reconstructed_full", "reconstructed_payload", hamming(F.col("full_strand"), F.col("reconstructed_full")).alias("full_mismatches"), hamming(F.col("payload"), F.col("reconstructed_payload")).alias("payload_mismatches")
    )


def hamming(a: Column, b: Column) -> Column:
    """Differing places, with the gap in length counted."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)


def consensus_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, templates = _written_reads(spark, sf_dir)
    return consensus(r.select("item_id", "no", "seq"), templates, ["item_id", "no"])


CONSENSUS_SQL = f"""{READS_SQL},
v AS (SELECT item_id, no, pos, substr(seq, pos, 1) AS base, count(*) AS c FROM reads, unnest(range(1, length(seq) + 1)) AS u(pos) GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY item_id, no, pos ORDER BY c DESC, base) AS k FROM v),
j AS (SELECT item_id, no, string_agg(base, '' ORDER BY pos) AS reconstructed_full FROM m WHERE k = 1 GROUP BY item_id, no),
n AS (SELECT item_id, no, count(*) AS reads_used FROM reads GROUP BY item_id, no)
SELECT item_id, no, reads_used, reconstructed_full, substr(reconstructed_full, {PREFIX + 1}, length(payload)) AS reconstructed_payload,
hamming(full_strand, reconstructed_full)::INT AS full_mismatches, hamming(payload, substr(reconstructed_full, {PREFIX + 1}, length(payload)))::INT AS payload_mismatches
FROM j JOIN n USING (item_id, no) JOIN strands USING (item_id, no)"""

QUERIES = {
    "noise_substitution": (noise_substitution, SUBSTITUTION_SQL),
    "noise_event_table": (noise_event_table, EVENTS_SQL),
    "noise_op_counts": (noise_op_counts, f"SELECT region, operation, count(*) AS events FROM ({EVENTS_SQL}) GROUP BY ALL"),
    "noise_strand_rows": (noise_strand_rows, STRAND_ROWS_SQL),
    "noise_region_scope": (noise_scope_payload, SCOPE_SQL),
    "reads_simulate": (reads_simulate, f"{READS_SQL} SELECT item_id, no, copy_no, seq, n_sub, n_ins, n_del FROM reads"),
    "reads_random_coverage": (reads_random_coverage, RANDOM_SQL),
    "reads_drop_summary": (reads_summary, READS_SUMMARY_SQL),
    "cluster_oracle": (cluster_oracle, f"{READS_SQL} SELECT item_id, no, count(*) AS reads FROM reads GROUP BY item_id, no"),
    "cluster_index_aware": (cluster_index_aware, INDEX_AWARE_SQL),
    "cluster_qgram": (cluster_qgram, QGRAM_SQL),
    "consensus_majority": (consensus_majority, CONSENSUS_SQL),
}
