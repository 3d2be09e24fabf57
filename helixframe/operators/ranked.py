"""Dimer codes that rank what may follow by base balance and repeats, whitened digits, and decoding without a known mapping."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna as D
from ..sources.tables import table
from .ecc import FIRST_DIMER, _from_digits, _to_digits, allowed
from .ranking import magic

# Weights of balance and repeats, lengths of repeats looked for, bases looked back at.
GC_WEIGHT, REPEAT_WEIGHT, REPEATS, BACK = 2.0, 1.0, (4, 6), 80
BASE = {"r2": 15, "r1": 12, "r0": 9}


def ranked(scheme: str, before: str, step: int, tail: str, gc: int, seed: str) -> list[str]:
    """Dimers that may follow, the best first: GC near one half, no recent repeat, ties by SHA-256."""

    def key(d: str):
        off = abs((gc + sum(c in "GC" for c in d)) / (2 * step + 2) - 0.5)
        new = tail + d
        again = sum(len(new) >= k and new[-k:] in new[:-k] for k in REPEATS)
        tie = hashlib.sha256(f"{seed}|{before}|{step}|{d}".encode()).digest()
        return GC_WEIGHT * off + REPEAT_WEIGHT * again, tie

    return sorted(allowed(scheme, before), key=key)


def _walk(scheme: str, seed: str, choose, steps: int) -> list[str]:
    before, tail, gc, out = FIRST_DIMER, "", 0, []
    for step in range(steps):
        before = choose(step, ranked(scheme, before, step, tail, gc, seed))
        out.append(before)
        tail, gc = (tail + before)[-BACK:], gc + sum(c in "GC" for c in before)
    return out


def mask(seed: str, step: int, base: int) -> int:
    """What whitening adds to a digit, by a keyed hash."""
    return int.from_bytes(hashlib.blake2b(step.to_bytes(8, "big"), key=seed.encode()[:64], digest_size=16).digest(), "big") % base


def encode(data: bytes, scheme: str, seed: str, whiten: bool = True) -> str:
    base = BASE[scheme]
    digits = _to_digits((1 << 8 * len(data)) | int.from_bytes(data, "big"), base)
    if whiten:
        digits = [(d + mask(seed, i, base)) % base for i, d in enumerate(digits)]
    return "".join(_walk(scheme, seed, lambda i, best: best[digits[i]], len(digits)))


def decode(dna: str, scheme: str, seed: str, whiten: bool = True) -> bytes | None:
    base, digits = BASE[scheme], []
    dimers = [dna[i : i + 2] for i in range(0, len(dna), 2)]

    def choose(i: int, best: list[str]) -> str:
        digits.append(best.index(dimers[i]))
        return dimers[i]

    try:
        _walk(scheme, seed, choose, len(dimers))
    except ValueError:
        return None
    if whiten:
        digits = [(d - mask(seed, i, base)) % base for i, d in enumerate(digits)]
    n = _from_digits(digits, base)
    bits = n.bit_length() - 1
    return (n - (1 << bits)).to_bytes(bits // 8, "big") if bits >= 0 and bits % 8 == 0 else None


def ranked_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts through the ranked and whitened codes: bases, GC share, whether they come back."""

    @F.pandas_udf("scheme string, bases int, gc double, same boolean")
    def run(texts: pd.Series, schemes: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(texts, schemes):
            dna = encode((t or "").encode(), s, "key")
            rows.append((s, len(dna), round((dna.count("G") + dna.count("C")) / max(1, len(dna)), 6), decode(dna, s, "key") == (t or "").encode()))
        return pd.DataFrame(rows, columns=["scheme", "bases", "gc", "same"])

    b = table(spark, sf_dir, "benchmark").select("item_id", "text", F.explode(F.array(*[F.lit(s) for s in BASE])).alias("scheme"))
    return b.select("item_id", run("text", "scheme").alias("r")).select("item_id", "r.*")


def blind(dna: Column) -> Column:
    """Struct mapping, score, kind, decoded of the mapping whose payload sniffing knows with most confidence (the first
    of equals); null where none is known. Score: 1, and 10 times the confidence."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  value computed once

    def attempt(i: int, name: str, back) -> Column:
        def made(p: Column, m: Column) -> Column:
            found = F.struct((1 + 10 * m["confidence"]).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("mapping"), m["kind"].alias("kind"), p.alias("decoded"))
            return F.when(m.isNotNull(), found)

        return let(back(dna), lambda p: let(magic(p), lambda m: made(p, m)))

    mappings = (("simple", D.unsimple), ("unconstrained", D.ununconstrained), ("plain", D.unplain))
    tries = [attempt(i, name, back) for i, (name, back) in enumerate(mappings)]
    return F.array_max(F.filter(F.array(*tries), lambda t: t.isNotNull()))


def blind_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns encoded by a mapping that their number decides, decoded without knowing which."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode("text", "UTF-8").alias("payload"))
    used = F.element_at(F.array(F.lit("simple"), F.lit("unconstrained"), F.lit("plain")), (F.col("turn") % 3 + 1).cast("int"))
    dna = F.when(F.col("turn") % 3 == 0, D.simple(F.col("payload"))).when(F.col("turn") % 3 == 1, D.unconstrained(F.col("payload"))).otherwise(D.plain(F.col("payload")))
    b = t.select("conv_id", "turn", used.alias("used"), "payload", dna.alias("dna")).select("conv_id", "turn", "used", "payload", F.inline(F.array(F.struct(blind(F.col("dna")).alias("b")))))
    return b.select("conv_id", "turn", "used", "b.mapping", "b.kind", "b.score", (F.col("b.decoded") == F.col("payload")).alias("same"))


# The three mappings' lengths differ modulo four, so only the one that was used can be read.
BLIND_SQL = """WITH t AS (SELECT conv_id, turn, text, lower(hex(encode(text))) AS h, TRY(decode(array_slice(encode(text), 1, 4096))) AS s FROM conversations),
k AS (SELECT conv_id, turn, ['simple', 'unconstrained', 'plain'][turn % 3 + 1] AS used, CASE WHEN strlen(text) < 4 OR s IS NULL THEN NULL
  WHEN len(regexp_extract_all(regexp_replace(s, '[\\r\\n\\t ]', '', 'g'), '[\\pC\\pZ]')) / greatest(length(s), 1) < 0.05 THEN 'text' END AS kind FROM t)
SELECT conv_id, turn, used, CASE WHEN kind IS NOT NULL THEN used END AS mapping, kind, CASE WHEN kind IS NOT NULL THEN 7.0::DOUBLE END AS score, CASE WHEN kind IS NOT NULL THEN true END AS same FROM k"""

QUERIES = {"ranked_roundtrip": (ranked_roundtrip, None), "blind_decode": (blind_decode, BLIND_SQL)}
