"""Mappings by name, languages of tokens, drawn coverage and framed spectra against plain Python."""

import gzip
import random

import numpy as np
from pyspark.sql import functions as F

from helixframe.operators import mappings as M
from helixframe.operators import media as I
from helixframe.operators import noise as N
from helixframe.operators import repair as R
from helixframe.operators import tokens as T


def test_every_mapping_comes_back(spark):
    draw = random.Random(3)
    payloads = [b"", b"\0", b"a", b"text of a message", draw.randbytes(104), draw.randbytes(300)]
    df = M.each_mapping(spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(payloads)], "i int, payload binary"))
    df = df.withColumn("dna", M.encode(F.col("payload"), F.col("mapping"))).withColumn("back", M.decode(F.col("dna"), F.col("mapping"), F.octet_length("payload")))
    rows = df.collect()
    assert len(rows) == len(payloads) * len(M.NAMES)
    for r in rows:
        assert bytes(r.back) == bytes(r.payload), (r.mapping, bytes(r.payload))
        assert not set(r.dna) - set("ACGT")
    other = spark.createDataFrame([(bytearray(b"x"), "no such mapping"), (None, "Reed-Solomon")], "p binary, n string").select(M.encode(F.col("p"), F.col("n")).alias("d")).collect()
    assert [r.d for r in other] == [None, None]


def test_blind_attempts_prefer_what_opens(spark):
    packed = gzip.compress(b"some text " * 20, mtime=0)
    rows = [("whole", bytearray(packed)), ("cut", bytearray(packed[:-6])), ("unknown", bytearray(b"\x01\x02\x03\x04\x05")), ("text", bytearray(b"plain text"))]
    df = spark.createDataFrame(rows, "k string, p binary").withColumn("dna", M.encode(F.col("p"), F.lit("Simple Mapping")))
    tried = M.attempts(df, ["k"], "dna", M.NAMES[:3])
    got = {r.k: r for r in M.best_attempt(tried, ["k"]).collect()}
    assert set(got) == {"whole", "cut", "text"} and {r.mapping for r in got.values()} == {"Simple Mapping"}
    assert (got["whole"].status, got["cut"].status, got["text"].status) == ("Valid", "Weak", "Valid")
    assert got["whole"].score > got["text"].score > got["cut"].score and bytes(got["whole"].decoded) == packed
    other = {(r.k, r.mapping): r.status for r in tried.collect()}
    assert other["unknown", "Simple Mapping"] == "No magic" and other["whole", "Reed-Solomon"] == "Failed"


def test_block_tokens_are_those_of_the_text_in_order(spark):
    texts = ["Le chat et la souris sont dans la maison. The dog is in the house! 12", "", None, "한국어 문장입니다. English, after it.\nLine two"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = R.block_tokens(df).orderBy("k", "pos").collect()
    want = [(r.k, r.pos, r.token) for r in T.tokens(df).orderBy("k", "pos").collect()]
    assert [(r.k, r.pos, r.token) for r in got] == want
    said = {}
    for r in got:
        said.setdefault(r.token, r.language)
    assert said["chat"] == "fr" and said["dog"] == "en" and said["한국어"] == "ko" and said["English"] == "en"


def test_neighbours_prefer_the_language_of_the_block(spark):
    book = spark.createDataFrame([(3, 0, "le", "fr"), (5, 1, "the", "en"), (6, 2, "!", "punct")], "code int, code_id int, token string, class string")
    codes = spark.createDataFrame([(7, "fr"), (7, "en"), (7, "ko")], "noisy int, language string")
    got = {}
    for r in R.neighbours(codes, book, "language").orderBy("language", "rank").collect():
        got.setdefault(r.language, []).append(r.candidate)
    assert got == {"fr": ["le", "!", "the"], "en": ["the", "!", "le"], "ko": ["!", "le", "the"]}


def test_drawn_coverage_lies_between_half_and_half_as_much_again(spark):
    strands = spark.createDataFrame([(i, "ACGT" * 5) for i in range(400)], "no int, full_strand string")
    counts = [r["count"] for r in N.reads(strands, ["no"], coverage=10, dropout=0.0, spread=True).groupBy("no").count().collect()]
    assert len(counts) == 400 and min(counts) == 5 and max(counts) == 15 and abs(np.mean(counts) - 10) < 0.6
    one = [r["count"] for r in N.reads(strands, ["no"], coverage=1, dropout=0.0, spread=True).groupBy("no").count().collect()]
    assert set(one) <= {1, 2} and len(one) == 400


def test_frames_and_spectra(spark):
    rng = np.random.default_rng(5)
    signals = {1: rng.normal(size=1500), 2: rng.normal(size=100), 3: np.zeros(600), 4: rng.normal(size=512)}
    rows = [(k, n, float(x)) for k, s in signals.items() for n, x in enumerate(s)]
    df = spark.createDataFrame(rows, "k int, n int, x double").repartition(4)
    framed = {(r.k, r.frame): r["values"] for r in I.frame_rows(df, "k", "n", "x").collect()}
    for k, s in signals.items():
        starts = [i for i in range(0, max(1, len(s) - 511), 256)]
        assert sorted(f for q, f in framed if q == k) == list(range(len(starts)))
        for f, i in enumerate(starts):
            assert framed[k, f] == s[i : i + 512].tolist()
    louder = df.withColumn("x", F.when(F.col("k") == 1, F.col("x") * 1.5).otherwise(F.col("x")))
    got = {r.k: r for r in I.spectral_likeness(I.frame_rows(df, "k", "n", "x"), I.frame_rows(louder, "k", "n", "x"), "k").collect()}
    spectrum = lambda s, g: np.concatenate([np.log1p(np.abs(np.fft.rfft(s[i : i + 512] * g * np.hanning(513)[:-1]))) for i in range(0, len(s) - 511, 256)])
    a, b = spectrum(signals[1], 1.0), spectrum(signals[1], 1.5)
    assert got[1].likeness == round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6) and got[2].likeness == got[3].likeness == got[4].likeness == 1
