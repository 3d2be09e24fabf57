"""Packages, reports, frames, contexts and their files against plain Python versions."""

import glob
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import dna as D
from helixframe.operators import contexts as C
from helixframe.operators import frames as R
from helixframe.operators import quality as Y
from helixframe.operators import text_methods as X
from helixframe.operators import tokens as T
from helixframe.sources import files, scratch


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(1, 1, "The cat, the dog and (one) bird."), (1, 2, ""), (1, 3, None), (2, 1, "Ünïcode 漢字 words; numbers 12 345!"), (2, 2, "the the the the")]
    return spark.createDataFrame(rows, "conv_id long, turn long, text string")


def test_packages_come_back(turns):
    codecs = X.Codecs(turns)
    made = X.restored(codecs.packages(turns, ["conv_id", "turn"]))
    text = codecs.decode(F.col("method"), F.col("restored_dna"), F.col("tokens"))
    rows = made.select("conv_id", "turn", "text", "method", "payload", "codec_bits", "codec_dna", "restored_dna", text.alias("decoded")).collect()
    assert len(rows) == 20 and all(r.codec_dna == r.restored_dna for r in rows)
    for r in rows:
        bits = "".join(f"{'ACGT'.index(b):02b}" for b in r.codec_dna)
        assert r.codec_bits == len(bits) and "".join(f"{b:08b}" for b in r.payload) == bits + "0" * (-len(bits) % 8)
        if r.method == "A_RAW_UTF8":
            assert r.decoded == r.text and bytes(r.payload) == r.text.encode()
        if r.method == "B_ZLIB":
            assert r.decoded == r.text and zlib.decompress(bytes(r.payload)) == r.text.encode()
        if r.method in ("C_DENSE_TOKEN", "D_SPARSE_SEMANTIC"):
            assert r.decoded.split() and "".join(r.decoded.split()) == "".join(r.text.split()) if r.text else r.decoded == ""


def test_benchmark_of_no_noise_is_right(turns):
    codecs = X.Codecs(turns)
    made = codecs.packages(turns, ["conv_id", "turn"], X.PLAIN)
    for r in X.compared(codecs, X.noisy_at(made, ["conv_id", "turn"], (0.0000000003, 0.4)), ["conv_id", "turn"]).collect():
        if r.error_rate < 0.1:
            assert r.unit_accuracy == 1.0 and r.same_texts == r.texts == 5 and r.substituted_bases == 0
        else:
            assert r.unit_accuracy < 0.6 and 0.3 < r.actual_rate < 0.5


def test_right_units_are_those_of_the_decoded_units(turns):
    """Counted from the bits, as the decoded units say; and no base is drawn by an expression of its own."""
    codecs = X.Codecs(turns)
    noisy = X.noisy_at(codecs.packages(turns, ["conv_id", "turn"]), ["conv_id", "turn"], (0.02, 0.3))
    assert "md5" not in noisy._jdf.queryExecution().optimizedPlan().toString()
    m, n = F.col("method"), F.col("tokens")
    right = codecs.right_units(m, F.col("codec_dna"), F.col("noisy_dna"), n).alias("r")
    for r in noisy.select("method", right, codecs.units(m, F.col("codec_dna"), n).alias("a"), codecs.units(m, F.col("noisy_dna"), n).alias("b")).collect():
        if r.method == "B_ZLIB":
            assert r.a is None and tuple(r.r) == (None, None, None)
        else:
            assert tuple(r.r)[:2] == (len(r.a), sum(x == y for x, y in zip(r.a, r.b)))
            assert r.r.unknown == (sum(y == X.UNKNOWN for y in r.b) if r.method == "D_SPARSE_SEMANTIC" else 0)


def test_decoded_texts_are_those_of_the_units(turns):
    """As the units put together by `detokenize` say, from broken sequences and none too, and no expression walks over the tokens."""
    codecs = X.Codecs(turns)
    made = codecs.packages(turns, ["conv_id", "turn"], ("C_DENSE_TOKEN", "D_SPARSE_SEMANTIC")).select("method", "tokens", "codec_dna")
    odd = [("C_DENSE_TOKEN", 3, None), ("D_SPARSE_SEMANTIC", 2, ""), ("D_SPARSE_SEMANTIC", 3, "ACGTACGTAC"), ("C_DENSE_TOKEN", 4, "AAAAACAAC"), ("C_DENSE_TOKEN", None, "ACGT")]
    rows = made.union(X.noisy_at(made, ["tokens"], (0.3,)).select("method", "tokens", "noisy_dna")).union(turns.sparkSession.createDataFrame(odd, "method string, tokens int, codec_dna string"))
    m, dna, n = (F.col(c) for c in rows.columns[:1] + ["codec_dna", "tokens"])
    text = codecs.decode(m, dna, n)
    got = rows.select(T.detokenize(codecs.units(m, dna, n)).alias("want"), text.alias("got")).collect()
    assert len(got) == 25 and all(r.want == r.got for r in got) and any("[UNK]" in r.got for r in got)
    plan = rows.select(text)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "transform(sequence" not in plan


def test_dna_files(spark, turns, tmp_path):
    codecs = X.Codecs(turns)
    made = codecs.packages(turns, ["conv_id", "turn"], ("A_RAW_UTF8",)).select("conv_id", "turn", "tokens", F.col("codec_dna").alias("dna"))
    files.write_dna_files(made, f"file://{tmp_path}/d", ["conv_id", "turn"])
    back = files.read_dna_files(spark, f"file://{tmp_path}/d", "conv_id long, turn long, tokens int")
    assert sorted(map(tuple, back.select("conv_id", "turn", "tokens", "dna", "whole").collect())) == sorted((r.conv_id, r.turn, r.tokens, r.dna, True) for r in made.collect())
    # a base of every sequence is lost, and one sequence as a whole
    damaged = spark.read.text(f"file://{tmp_path}/d/dna").where("value not like '%\"turn\":2}%' or value like '%\"conv_id\":2%'")
    damaged.select(F.regexp_replace("value", "[ACGT]$", "").alias("value")).write.text(f"file://{tmp_path}/e/dna")
    spark.read.text(f"file://{tmp_path}/d/meta").write.text(f"file://{tmp_path}/e/meta")
    again = files.read_dna_files(spark, f"file://{tmp_path}/e", "conv_id long, turn long, tokens int").collect()
    # the empty text's sequence has nothing to lose where it is there
    assert len(again) == 5 and sum(r.dna is None for r in again) == 1 and {(r.conv_id, r.turn) for r in again if r.whole} == {(1, 3)}


def test_reports_have_a_mark_and_nested_columns_as_json(spark, tmp_path):
    rows = spark.createDataFrame([("ä", [1, 2])], "name string, list array<int>").coalesce(1)
    files.write_reports(f"file://{tmp_path}/r", rows, {"code_candidate_table": rows}, spark.createDataFrame([("decoded_text", "line\nline"), ("repaired", None)], "name string, text string").coalesce(1))
    for folder in ("benchmark_results", "code_candidate_table"):
        (path,) = glob.glob(f"{tmp_path}/r/{folder}/part*")
        with open(path, "rb") as f:
            assert f.read().decode() == '﻿name,list\nä,"[1,2]"\n'
    (path,) = glob.glob(f"{tmp_path}/r/texts/name=decoded_text/part*")
    assert open(path).read() == "line\nline\n"


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    assert scratch.new_path(spark, "x") != scratch.new_path(spark, "x")
    assert scratch.written(spark.range(3), "three").count() == 3


def test_byte_accuracy_and_bit_errors(spark):
    draw = random.Random(2)
    pairs = [(draw.randbytes(n), draw.randbytes(m)) for n, m in [(0, 0), (0, 3), (5, 5), (9, 4), (40, 40)]] + [(b"same", b"same"), (b"abcd", b"abce")]
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in pairs], "a binary, b binary").select(Y.byte_accuracy(F.col("a"), F.col("b")).alias("x"), Y.bit_error_rate(F.col("a"), F.col("b")).alias("y"))
    for (a, b), r in zip(pairs, df.collect()):
        n = max(len(a), len(b))
        assert r.x == pytest.approx(sum(x == y for x, y in zip(a, b)) / n if n else 1)
        assert r.y == pytest.approx((sum((x ^ y).bit_count() for x, y in zip(a, b)) + abs(len(a) - len(b)) * 8) / (8 * n) if n else 0)


def test_ratios_round_as_the_sql_does(spark):
    """Ratios such as 41 / 40, whose shortest decimal number is a tie and whose double is below it."""
    import duckdb

    pairs = [(o, s) for o in (41, 51, 641, 651, 2078) for s in range(1, 700)]
    o, s = F.col("o"), F.col("s")
    df = spark.createDataFrame(pairs, "o long, s long")
    got = df.select("o", "s", D.rounded(o / s, 2).alias("x"), D.rounded(o / s, 6).alias("y"), Y.percent(1 - s / o).alias("p")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (o BIGINT, s BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", pairs)
    want = con.execute("SELECT o, s, round(o / s, 2), round(o / s, 6), printf('%.2f', round((1 - s / o) * 100, 2)) || '%' FROM t").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and {(r.o, r.s): r.x for r in got}[41, 40] == 1.02


def test_integrity_rows_of_nothing(spark):
    df = spark.createDataFrame([(1, bytearray(b""), None), (2, bytearray(b"abc"), None), (3, bytearray(b"abc"), bytearray(b"abc"))], "k int, a binary, b binary")
    got = {(r.k, r.metric): r.value for r in Y.integrity_rows(df, ["k"], "a", "b").collect()}
    assert got[1, "Payload accuracy"] == "100.00%" and got[1, "Checksum"] == "Fail" and got[2, "Length delta"] == "-3 bytes"
    assert got[2, "Bit error rate"] == "1.00e+00" and got[3, "Checksum"] == "Pass" and len(got) == 12


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def test_words_are_aligned_with_least_edits(spark):
    draw = random.Random(4)
    words = "a b c d e".split()
    texts = [(k, " ".join(draw.choice(words) for _ in range(draw.randint(0, 12))), " ".join(draw.choice(words) for _ in range(draw.randint(0, 12)))) for k in range(60)]
    texts += [(100, None, "a b"), (101, "a", None), (102, "", "")]
    df = spark.createDataFrame(texts, "k int, x string, y string")
    got = {r.k: r for r in Y.word_metrics(Y.word_pairs(df, ["k"], "x", "y"), ["k"]).collect()}
    assert len(got) == len(texts)
    for k, x, y in texts:
        u, v, r = (x or "").split(), (y or "").split(), got[k]
        assert (r.original_words, r.decoded_words, r.word_error_count) == (len(u), len(v), edits(u, v))
        assert r.exact_word_matches + r.substitutions + r.deletions == len(u) and r.word_error_rate == round(edits(u, v) / max(1, len(u)), 6)


def test_candidates_are_worked_out_once_a_key(spark):
    df = spark.createDataFrame([(1, bytearray(b"text " * 50)), (2, bytearray(b"text " * 50)), (3, bytearray(b"")), (4, None)], "k int, p binary")
    ranked = Y.distinct_candidates(Y.candidate_payloads(df, "k", "p"), "k")
    got = Y.with_quality(ranked, F.lit("path")).collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append(r)
        assert r.exact and r.text_accuracy == 1 and r.length_delta == 0
    assert set(by) == {1, 2, 3} and {r.quality_key for r in by[1]} == {r.quality_key for r in by[2]}
    for rows in by.values():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and rows == sorted(rows, key=lambda r: (r.size_bytes, r.method))
    twice = ranked.unionByName(ranked.where("k = 1")).drop("rank", "size_bytes")
    assert Y.distinct_candidates(twice, "k").count() == ranked.count()
    # the same bytes beyond those digested share a key, other ones before do not
    digest = lambda a, b: hashlib.sha256(a[: Y.KEY_BYTES] + b[: Y.KEY_BYTES]).hexdigest()
    assert all(r.quality_key.endswith(digest(bytes(r.original), bytes(r.data))) for r in got)


def test_ids_within_any_distance(spark):
    for distance, limit, valid in ((0, 5, 65536), (1, 99, 4096), (2, 200, 4096), (3, 1000, 5000), (2, 7, 300)):
        ids = [0, 5, 4095, 65535, 1234]
        got = spark.createDataFrame([(i,) for i in ids], "i int").select("i", C.ids_within(F.col("i"), F.lit(valid), distance, limit).alias("c")).collect()
        for r in got:
            want = [(i, d) for d, i in sorted(((r.i ^ c).bit_count(), c) for c in range(valid) if (r.i ^ c).bit_count() <= distance)]
            assert len(r.c) == min(limit, len(want)) and len({x.token_id for x in r.c}) == len(r.c)
            assert [x.hamming_distance for x in r.c] == [d for _, d in want[: len(r.c)]]
            if limit >= len(want):
                assert sorted((x.token_id, x.hamming_distance) for x in r.c) == sorted(want)
    assert [m for m, _ in C.masks(2, 3)] == [0, 4, 2, 1, 6, 5, 3]


def test_windows(spark):
    tokens = [str(i) for i in range(100)]
    df = spark.createDataFrame([(tokens, p) for p in (0, 1, 40, 98, 99)], "t array<string>, p int")
    for r in df.select("t", "p", C.context_window(F.col("t"), F.col("p")).alias("a"), C.model_window(F.col("t"), F.col("p"), 30).alias("b"), C.model_window(F.col("t"), F.col("p")).alias("c")).collect():
        assert r.a.window == tokens[max(0, r.p - 35) : r.p + 36] and r.a.window[r.a.place] == r.b.window[r.b.place] == str(r.p)
        assert len(r.b.window) == 30 and r.b.start == min(max(0, r.p - 15), 70) and r.c.window == tokens


def test_template_calls(spark):
    draw = random.Random(6)
    rows = []
    for _ in range(60):
        t = "".join(draw.choice("ACGT") for _ in range(draw.randint(0, 40)))
        s = list(t)
        for _ in range(draw.randint(0, 4)):
            k = draw.randint(0, len(s))
            s[k : k + draw.randint(0, 1)] = draw.choice(["", "A", "CG"])
        rows.append(("".join(s), t))
    rows += [("acgt", "ACGT"), ("", "ACG"), ("ACG", ""), ("ACG", "ACTG"), ("AACG", "ACG")]
    got = C.template_calls(spark.createDataFrame(rows, "s string, t string"), "s", "t").collect()
    for r in got:
        assert len(r.called) == len(r.t)
        if len(r.s) == len(r.t):
            assert r.called == r.s.upper()
        else:  # what stands differs from the read by places lost and gained, and from the template by least edits
            assert sum(x != y for x, y in zip(r.called, r.t)) <= edits(r.s, r.t)
    assert {(r.s, r.t): r.called for r in got}[("", "ACG")] == "AAA" and {(r.s, r.t): r.called for r in got}[("ACG", "ACTG")] == "ACAG"


def test_names(spark):
    names = ["a.RAW", "dir.x/b", ".raw", "x.tar.payload", None, "", "p.imgpayload/q.png"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(C.suffix(F.col("n")).alias("s"), C.internal_payload(F.col("n")).alias("i")).collect()
    assert [(r.s, r.i) for r in got] == [(".raw", True), ("", False), ("", False), (".payload", True), ("", False), ("", False), (".png", False)]


def test_low_pass():
    b, a = C.butterworth(4, 0.75)
    w = np.linspace(0.01, 3.1, 50)
    z = np.exp(-1j * w[:, None] * np.arange(5))
    gain = np.abs((z @ b) / (z @ a)) ** 2
    assert gain == pytest.approx(1 / (1 + (np.tan(w / 2) / np.tan(np.pi * 0.75 / 2)) ** 8), rel=1e-9)
    flat = np.full(100, 0.3)
    assert C.low_pass(flat)[5:-5] == pytest.approx(flat[5:-5], abs=1e-2)
    n = np.arange(2000)
    slow, fast = 0.5 * np.sin(n / 20), 0.3 * np.sin(2.9 * n)
    assert np.abs(C.low_pass(slow + fast) - slow)[50:-50].max() < np.abs(fast).max()
    click = slow.copy()
    click[700] = 1
    assert np.abs(C.low_pass(click) - slow)[100:-100].max() < 0.05
    assert len(C.low_pass(np.zeros(0))) == 0 and C.low_pass(np.ones(9)).tolist() == [1.0] * 9 and np.abs(C.low_pass(np.ones(40) * 5)).max() <= 1


def ssim(a, b):
    out = []
    for r in range(a.shape[0] - 6):
        for c in range(a.shape[1] - 6):
            x, y = a[r : r + 7, c : c + 7].ravel(), b[r : r + 7, c : c + 7].ravel()
            cov = np.cov(x, y)
            out.append((2 * x.mean() * y.mean() + R.C1) * (2 * cov[0, 1] + R.C2) / ((x.mean() ** 2 + y.mean() ** 2 + R.C1) * (cov[0, 0] + cov[1, 1] + R.C2)))
    return float(np.mean(out))


def test_windowed_ssim_of_any_shape(spark):
    rng = np.random.default_rng(1)
    for h, w in ((8, 8), (7, 7), (9, 12), (11, 7)):
        a, b = rng.integers(0, 256, (2, h, w)).astype(float)
        df = spark.createDataFrame([(a.ravel().tolist(), b.ravel().tolist())], "a array<double>, b array<double>")
        assert df.select(R.windowed_ssim(F.col("a"), F.col("b"), w, h)).first()[0] == pytest.approx(ssim(a, b), rel=1e-9)
        assert df.select(R.windowed_ssim(F.col("a"), F.col("a"), w, h)).first()[0] == pytest.approx(1)


def test_vote_mends_what_one_copy_lost(spark, sf):
    rows = R.protected_frames(spark, sf).collect()
    strong = [r for r in rows if r.mode == "Strong"]
    assert sum(r.right_back for r in strong) > sum(r.right_alone for r in strong) and all(r.protected for r in strong)
    assert all(r.right_back == r.right_alone and not r.protected for r in rows if r.mode == "None")
    light = [r for r in rows if r.mode == "Light"]
    assert {r.protected for r in light if r.frame % R.KEYFRAMES == 0} == {True} and not any(r.protected for r in light if r.frame % R.KEYFRAMES)


def test_second_cleanup_takes_out_a_blot(spark):
    """A still film with a blot in one frame: the blot goes, the other frames stay as they are."""
    still = [[float(100 + 3 * (r % 8) + 2 * (c % 8)) for c in range(16)] for r in range(12)]
    films = []
    for k in range(9):
        frame = [list(row) for row in still]
        if k == 4:
            for r in range(3, 7):
                for c in range(5, 9):
                    frame[r][c] = 255.0
        films.append((k, [v for row in frame for v in row]))
    got = {r.frame: r for r in R.second_cleanup(spark.createDataFrame(films, "frame long, pixels array<double>"), 16, 12).collect()}
    assert sum(got[4].mask) >= 16 and all(sum(got[k].mask) == 0 for k in got if k != 4)
    clean = np.array([v for row in still for v in row])
    assert np.abs(np.array(got[4].cleaned) - clean).max() < 0.5 * (255 - clean.min())
    assert np.abs(np.array(got[0].cleaned) - clean).max() <= 16  # a median of nine at the ramps' edges
