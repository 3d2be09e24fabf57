"""Draws of many bases at once against MD5 one by one, and what the noise makes of them."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from helixframe.functions import dna as D
from helixframe.functions import draws as R
from helixframe.operators import noise as N


def digest(prefix, place):
    h = hashlib.md5(prefix + str(place).encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]


def test_digests_are_those_of_md5():
    """Prefixes within a block, at its edge and beyond it; places of one to five digits; sequences without bases."""
    prefixes = [b"", *[b"7|" + b"9" * n + b"|" for n in (0, 5, 48, 49, 50, 51, 52, 53, 54, 60, 61, 62, 120)]]
    lengths = np.array([12, 101, *range(0, 11), 20_005])
    got = [(s, p, x) for seq, place, words in R.digests(prefixes, lengths) for s, p, *x in zip(seq, place, *words)]
    assert [(s, p) for s, p, _ in got] == [(s, p) for s, n in enumerate(lengths) for p in range(n)]
    for s, p, x in got[:300] + got[-30:] + got[10_000:10_020]:
        assert [int(v) for v in x] == digest(prefixes[s], p + 1)


def rows(spark):
    return spark.createDataFrame([(i, None if i == 2 else 2**60 + i, "ACGT" * 40 if i else "") for i in range(6)], "a long, b long, dna string")


def expected(r, seed, rates):
    """Events, what the sequence becomes and the places of the read, base by base."""
    prefix = "|".join(str(x) for x in (seed, r.a, r.b) if x is not None).encode() + b"|"
    events, out = [], ""
    for place, base in enumerate(r.dna, start=1):
        d, s, i, v = digest(prefix, place)
        sub, ins, dele = (N._bound(x) for x in rates)
        kept = "" if d < dele else D.BASES[(D.BASES.index(base) + 1 + v % 3) % 4] if s < sub else base
        if kept != base:
            events.append((place, len(out) + 1, "substitution" if kept else "deletion", base, kept))
        out += kept
        if i < ins:
            events.append((place, len(out) + 1, "insertion", "", D.BASES[v // 3 % 4]))
            out += events[-1][4]
    return sorted(events), out


def test_noise_base_by_base(spark):
    rates = (0.3, 0.2, 0.25)
    df = rows(spark)
    events = N.mutation_events(df, ["a", "b"], "dna", *rates, seed=3).collect()
    made = {r.a: r for r in N.mutated(df, ["a", "b"], "dna", *rates, seed=3).collect()}
    only = {r.a: r for r in N.substituted(df, ["a", "b"], "dna", 0.4, seed=3).collect()}
    for r in df.collect():
        want, out = expected(r, 3, rates)
        assert sorted((e.position_original, e.position_read, e.operation, e.from_base, e.to_base) for e in events if e.a == r.a) == want
        assert made[r.a].out == out
        assert (made[r.a].n_sub, made[r.a].n_ins, made[r.a].n_del) == tuple(sum(e[2] == k for e in want) for k in ("substitution", "insertion", "deletion"))
    old = N.substitution_noise(df, ["a", "b"], "dna", 0.4, seed=3).select("a", N._joined("places", "base").alias("noisy"), F.size(F.filter("places", lambda x: x["changed"])).alias("n"))
    assert all((only[r.a].noisy, only[r.a].substituted) == (r.noisy, r.n) for r in old.collect())
    none = N.mutated(df, ["a", "b"], "dna", 0, 0, 0).collect()
    assert all(r.out == ("ACGT" * 40 if r.a else "") and r.n_sub == r.n_ins == r.n_del == 0 for r in none)


def test_noise_draws_no_base_by_an_expression(spark):
    """A strand's bases are drawn together: the plans hash once a row at most, not in a function over an array of bases."""
    df = rows(spark)
    for made in (N.mutated(df, ["a"], "dna"), N.mutation_events(df, ["a"], "dna"), N.substituted(df, ["a"], "dna")):
        assert "md5" not in made._jdf.queryExecution().optimizedPlan().toString()
