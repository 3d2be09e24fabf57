"""Round trips, correction limits and hand-made vectors of the codecs and sources."""

import gzip
import io
import tracemalloc
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.functions import dna as D
from helixframe.functions.galois import field, reed_solomon
from helixframe.operators import ecc, media, noise, ranking, tokens
from helixframe.operators import strands as S
from helixframe.sources import files


def one(spark, **columns):
    names = [c.alias(n) for n, c in columns.items()]
    return spark.range(1).select(*names).first()


def test_headers_and_empty_payloads(spark):
    r = one(spark, a=D.simple(F.lit("")), b=D.unconstrained(F.lit("")), c=D.simple(F.lit("\x00ÿ")), d=D.unsimple(F.lit("CA")), e=D.unsimple(F.lit("GAAAA")), f=D.ununconstrained(F.lit("ACTTTT")))
    assert (r.a, r.b, r.c) == ("CA", "AG", "AAAAATAATGTTT")
    assert bytes(r.d) == b"\0" and r.e is None and bytes(r.f) == b"\xff"


def test_crc_vectors(spark):
    bits = ["1011001", "0000", "111111110"]
    assert list(one(spark, **{f"x{i}": D.crc8(F.lit(b)) for i, b in enumerate(bits)})) == [136, 0, 225]
    assert one(spark, x=F.crc32(F.lit("0101").cast("binary")).bitwiseAND(F.lit(255))).x == 211


def test_clean(spark):
    r = one(spark, a=D.clean(F.lit(">ACGT\nacg\nTTx")), b=D.clean(F.lit("{\"k\": 1}\n AC")), c=D.clean(F.lit("")), d=D.clean(F.lit("AC\r\nGN")))
    assert (r.a, r.b, r.c, r.d) == ("ACGTT", "AC", "", "ACG")


@pytest.mark.parametrize(("n", "parts"), [(0, []), (75, [75]), (76, [76]), (77, [76, 1]), (152, [76, 76])])
def test_split(spark, n, parts):
    rows = S.split(spark.createDataFrame([("A" * n,)], "dna string")).orderBy("no").collect()
    assert [len(r.payload) for r in rows] == parts


def test_no_capacity_is_null(spark):
    assert S.length_search(spark.createDataFrame([(100,)], "dna_len int"), fixed=200).first().n_strands is None


def test_constrained_codes_take_a_few_microseconds_a_dimer():
    """Ten kilobytes in all three codes: the rules are looked up, not worked out for every dimer."""
    import time

    data = bytes(range(256)) * 40
    began = time.process_time()
    dnas = {s: ecc.constrained_encode(data, s) for s in ("r2", "r1", "r0")}
    assert all(ecc.constrained_decode(dna, s) == data for s, dna in dnas.items())
    dimers = sum(len(dna) // 2 for dna in dnas.values())
    assert (time.process_time() - began) / dimers < 4e-6
    for s, dna in dnas.items():
        at = [ecc.FIRST_DIMER] + [dna[i : i + 2] for i in range(0, len(dna), 2)]
        assert all(b in ecc.allowed(s, a) for a, b in zip(at, at[1:]))


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=200))
def test_constrained_codes(data):
    for scheme, longest in (("r2", 3), ("r1", 2), ("r0", 1)):
        dna = ecc.constrained_encode(data, scheme)
        assert ecc.constrained_decode(dna, scheme) == (data or b"\0") and ecc._run(dna) <= longest


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 4), st.integers(0, 2**32))
def test_reed_solomon_corrects_four(errors, seed):
    rng, code = np.random.default_rng(seed), reed_solomon(6, 8)
    word = code.encode(message := rng.integers(0, 64, 20))
    at = rng.choice(28, errors, replace=False)
    word[at] ^= rng.integers(1, 64, errors)
    assert (code.decode(word) == message).all()


def test_field_laws():
    f = field(14)
    a = np.arange(1, 500)
    assert (f.mul(a, f.inv(a)) == 1).all() and (f.mul(a, 0) == 0).all()
    assert len(set(field(16).exp[:65535].tolist())) == 65535


@pytest.mark.parametrize("data", [b"", b"x", bytes(range(256)), b"payload" * 40])
def test_concatenated_and_matrix_codes(data):
    groups = {}
    for g, s, core in ecc.concatenated_encode(data):
        assert len(core) == 84
        if s not in (1, 7):
            gg, ss, symbols = ecc.concatenated_decode_strand(core[:10] + "ACGT"["ACGT".index(core[10]) - 1] + core[11:])
            assert (gg, ss) == (g, s)
            groups.setdefault(g, {})[s] = symbols
    raw = ecc._regroup(np.concatenate([ecc.concatenated_recover(groups[g]).ravel() for g in sorted(groups)]), 14, 8).astype(np.uint8).tobytes()
    assert raw[4 : 4 + int.from_bytes(raw[:4], "big")] == data
    assert ecc.concatenated_recover({s: [0] * 6 for s in range(9)}) is None
    strands = [core for _, _, core in ecc.matrix_encode(data)]
    lost = ecc.parity_columns(max(1, -(-max(1, -(-len(data) // 2)) // 14)))
    assert ecc.matrix_decode(strands[lost:], len(data)) == data and ecc.matrix_decode(strands[lost + 1 :], len(data)) is None
    assert all(len(s) == 120 for s in strands)


def test_matrix_code_of_many_messages(spark, tmp_path):
    """Together they are coded as one by one, whatever is lost, and no product of matrices is there as a whole."""
    rng = np.random.default_rng(3)
    data = {k: rng.bytes(n) for k, n in enumerate([0, 1, 28, 29, 56, 300, 300, 301, 2000])}
    df = spark.createDataFrame(list(data.items()), "msg long, payload binary").coalesce(1)
    made = {}
    for r in ecc.matrix_strands(df, "msg").collect():
        made.setdefault(r.msg, []).append((r.grp, r.no, r.core))
    assert {k: sorted(v) for k, v in made.items()} == {k: ecc.matrix_encode(d) for k, d in data.items()}
    rows = []
    for k, d in data.items():
        for lost in (0, 0.05, 0.12, 0.3, 1):
            kept = [core for _, _, core in made[k] if rng.random() >= lost]
            rng.shuffle(kept)
            rows.append((len(d), [*kept, *kept[:2]], ecc.matrix_decode(kept, len(d))))
    got = spark.createDataFrame(rows, "size int, l array<string>, want binary").select("want", ecc.matrix_payload(F.col("l"), F.col("size")).alias("got")).collect()
    assert len(got) == len(rows) and all(r.want == r.got for r in got) and any(r.got is None for r in got)
    spark.createDataFrame([(1, 1, "a" * 99), (1, 2, None), (2, 1, "")], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted((r.msg, r.bytes, r.columns, r.same) for r in ecc.matrix_rs_erasure(spark, str(tmp_path)).collect()) == [(1001, 99, 4, True), (1002, 0, 2, True), (2001, 0, 2, True)]
    a, b = rng.integers(0, 1 << 16, (100, 1000)), rng.integers(0, 1 << 16, (1000, 14))
    tracemalloc.start()
    product = field(16).matmul(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000_000 and (product[7] == np.bitwise_xor.reduce(field(16).mul(a[7][:, None], b), axis=0)).all()


def test_block_code():
    data = bytes(range(40))
    blocks = ecc.block_encode(data)
    assert [len(b) for b in blocks] == [77, 77, 27] and ecc.block_decode("".join(blocks)) == (data, 0)
    state = blocks[0][:-1] + ecc.BLOCK_BASES[(ecc.BLOCK_BASES.index(blocks[0][-1]) + 1) % 4]
    assert ecc.block_decode(state + "".join(blocks[1:]))[1] == 1


def test_design_has_unique_indices_and_equal_lengths():
    rows = ecc.design("ACGT" * 60)
    assert len({r[1] for r in rows}) == len(rows) and {len(r[4]) for r in rows} == {125}
    assert ecc.hashed_bases("s", 300)[128:172] == ecc.hashed_bases("s", 300)[256:300]


def test_align():
    pairs = ecc.align(list("ACGT"), list("AGTT"))
    assert sum(1 for i, j in pairs if i is None or j is None or "ACGT"[i] != "AGTT"[j]) == 2
    assert ecc.align([], ["x"]) == [(None, 0)] and ecc.align([], []) == []


def test_hamming_and_votes(spark):
    r = one(spark, a=noise.hamming(F.lit("ACG"), F.lit("AC")), b=noise.hamming(F.lit("ACGT"), F.lit("ACGA")), c=tokens.position_accuracy(F.lit(""), F.lit("")))
    assert (r.a, r.b, r.c) == (1, 1, 1.0)


def test_languages(spark):
    words = ["[UNK]", "12", "?!", "数据", "저장", "nghệ", "données", "le", "house"]
    got = one(spark, **{f"x{i}": tokens.language_class(F.lit(w)) for i, w in enumerate(words)})
    assert list(got) == ["special", "number", "punct", "zh", "ko", "vi", "vi", "fr", "en"]  # accents shared with Vietnamese come first


def test_magic(spark):
    heads = {b"%PDF-1.7": "pdf", b"\x1f\x8b\x08\x00": "gzip", b"RIFF\0\0\0\0WAVE": "wav", b"BM text": "bmp", b"plain": "text", b"abc": None, b"\0\1\2\3": None, b"OggS" + b"\0" * 20 + b"OpusHead": "opus_ogg", "é".encode() * 2100: "text", b"a" + "é".encode() * 2100: None}
    df = spark.createDataFrame([(bytearray(h),) for h in heads], "p binary")
    assert [r[0] for r in df.select(ranking.magic(F.col("p"))["kind"]).collect()] == list(heads.values())


def test_images():
    p = np.add.outer(np.arange(8), np.arange(8)).astype(np.uint8) * 8 + 60
    got, valid = media.block_pixels(media.block_packet(p))
    assert valid and media.psnr(p, got) > 25
    broken = media.block_packet(p)
    assert not media.block_pixels("10"[int(broken[0])] + broken[1:])[1]
    assert media.haar_ll(np.ones((8, 8))).tolist() == [[4, 4], [4, 4]] and (media.haar_from_ll(media.haar_ll(np.ones((8, 8))), (8, 8)) == 1).all()
    d = media.cosine_matrix()
    assert np.allclose(d @ d.T, np.eye(8)) and media.zigzag()[:6].tolist() == [0, 1, 8, 16, 9, 2]


def test_files(spark, tmp_path):
    x = np.sin(np.arange(400) / 10)
    rate, y = files.wav_samples(files.wav_bytes(x, 8000))
    assert rate == 8000 and abs(x - y).max() < 1e-3 and files.wav_samples(b"no") is None
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>one</w:t></w:p><w:p/><w:p><w:t>two</w:t></w:p></w:document>')
    assert files.upload_text("a.DOCX", docx.getvalue()) == "one\n\ntwo" and files.upload_text("a.docx", b"x") is None
    assert files.upload_text("a.json", b'{"b":1}') == '{\n  "b": 1\n}' and files.upload_text("a.json", b"{") == "{"
    assert files.upload_text("a.txt", b"\xef\xbb\xbfa\r\n\n\n\n\nb") == "a\n\n\nb" and files.upload_text("a.exe", b"") is None
    assert files.restore(gzip.compress(b"q"), "gzip") == b"q" and files.restore(b"bad", "zip") == b"bad"
    (tmp_path / "a b.txt").write_text("x y\nz")
    row = files.texts(files.read_bytes(spark, f"file://{tmp_path}/*.txt")).first()
    assert (row["name"], row.words, row.utf8_bytes) == ("a_b.txt", 3, 5)
    (tmp_path / "s.csv").write_text("No.,Payload,Full strand\n2,GG,xx\n1,,AC\n")
    assert tuple(files.message_of_strands(files.strand_csv(spark, f"file://{tmp_path}/s.csv")).first()) == (2, "ACGG")
    (tmp_path / "reads.log").write_text("acg\n\nNT\n")
    assert [r.seq for r in files.reads_text(spark, f"file://{tmp_path}/reads.log").collect()] == ["ACG", "T"]


def test_png_is_read_by_spark(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(files.png_bytes(np.zeros((3, 5, 3))))
    image = spark.read.format("image").load(f"file://{tmp_path}").first().image
    assert (image.height, image.width) == (3, 5)


def test_export(spark, tmp_path):
    df = S.strands(spark.createDataFrame([("ACGT" * 50,)], "dna string"))
    out = files.strand_table(df)
    assert out.columns[:7] == files.STRAND_COLUMNS
    files.write_csv(out, f"file://{tmp_path}/csv")
    assert files.strand_csv(spark, f"file://{tmp_path}/csv").count() == 3
    read = spark.createDataFrame([("10", "A"), ("2", "C"), ("x", "G")], "source_no string, seq string")
    assert [r.value for r in files.cluster_lines(read).collect()][:4] == ["CLUSTER 2", "C", "CLUSTER 10", "A"]
    assert files.shuffled_reads(read).count() == 3
    r = one(spark, f=files.fixed_strands(F.lit("A" * 250 + "\n" + "C" * 119)), g=files.fitted(F.unhex(F.lit("0102")), F.lit(3)))
    assert [len(x) for x in r.f] == [120, 120] and bytes(r.g) == b"\1\2\0"


def test_stream(spark, sf, tmp_path):
    from helixframe.streaming.encode import encoded_stream

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs.write.parquet(f"file://{tmp_path}/in")
    query = encoded_stream(spark, f"file://{tmp_path}/in", docs.schema).writeStream.format("memory").queryName("encoded").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("encoded").count() == docs.count()


def test_reads_and_rows_of_several_files_and_splits(spark, tmp_path):
    for d in ("reads", "rows"):
        (tmp_path / d).mkdir()
    for k in range(3):
        (tmp_path / "reads" / f"{k}.txt").write_text("".join(f"{'ACGT'[i % 4] * 40}\n\n" for i in range(60)))
        (tmp_path / "rows" / f"{k}.csv").write_text("Payload\n" + "".join("ACGT"[(i + k) % 4] * 4 + "\n" for i in range(5)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    got = files.reads_text(spark, f"file://{tmp_path}/reads")
    assert got.rdd.getNumPartitions() > 3
    assert sorted(r.read_id for r in got.collect()) == [f"r{i:06d}" for i in range(1, 181)]
    rows = files.strand_csv(spark, f"file://{tmp_path}/rows")
    assert sorted(r.no for r in rows.collect()) == sorted([*range(1, 6)] * 3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    keyed = rows.select("no", "Payload", F.lit("m").alias("message"))
    assert [r.strands for r in files.message_of_strands(keyed, "message").collect()] == [15]


def test_votes_by_differences_equal_counting_every_base(spark):
    from collections import Counter
    import random

    from helixframe.operators import noise

    rng, calls, strands = random.Random(5), [], []
    for k in range(40):
        own = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 30)))
        strands.append((k, own))
        calls += [(k, "".join(rng.choice("ACGT-") if rng.random() < 0.5 else b for b in own)) for _ in range(rng.randint(0, 6))]
    want = {}
    for k, own in strands:
        votes = [c for n, c in calls if n == k]
        if votes:
            counts = [Counter(v[i] for v in votes if v[i] != "-") for i in range(len(own))]
            want[k] = "".join(min(c, key=lambda b, c=c: (-c[b], b)) if c else own[i] for i, c in enumerate(counts))
    got = noise.vote(spark.createDataFrame(calls, "k int, calls string"), spark.createDataFrame(strands, "k int, full_strand string"), ["k"])
    assert {r.k: r.reconstructed_full for r in got.collect()} == want


def test_nearest_prefix_equals_comparing_all(spark):
    import random

    from pyspark.sql import functions as F

    from helixframe.operators import noise

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            diagonal, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
        return row[-1]

    rng = random.Random(3)
    primer = "ACACGACGCTCTTCCGATCT"
    templates = [(m, no, primer + "".join("ACGT"[(no >> 2 * (7 - i)) & 3] for i in range(8)) + "ACGTACGT") for m in (1, 2) for no in range(0, 300, 3)]
    found = []
    for i in range(150):
        s = list(templates[rng.randrange(len(templates))][2])
        for _ in range(rng.choice((0, 1, 1, 2, 4))):
            at = rng.randrange(12, 29)
            s[at : at + 1] = rng.choice(([], [rng.choice("ACGT")], [s[at], rng.choice("ACGT")]))
        found.append((i, rng.choice((1, 2)), "".join(s)))
    want = {}
    for i, m, s in found:
        p = s[:28]
        least = min((edits(p, t[:28]), abs(len(p) - 28), no) for own, no, t in templates if own == m)
        want[i] = (least[2], least[0]) if least[0] <= 10 else (None, None)
    out = noise.nearest_prefix(spark.createDataFrame(found, "i int, m int, seq string"), spark.createDataFrame(templates, "m int, no int, full_strand string"), "m")
    assert {r.i: (r.assigned, r.edits) for r in out.select("i", "assigned", F.col("edits").cast("int")).collect()} == want


def test_candidates_are_worked_out_once_a_code(spark):
    """The nearest codes by all distances; keys that occur twice share their ranks; only keys and codes are shuffled, once."""
    words = ["the", "le", "数据", ".", "12", "data", "les", "cat", "저장", "(", "dog", "có", "[PAD]", "[UNK]", "a", "b", "c"]
    vocab = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "token_id int, token string")
    book = tokens.semantic_ids(vocab).join(tokens.parity_codebook(spark, ""), "code_id")
    given = [(1, 0, 1), (1, 1, 7), (1, 2, 32), (2, 0, 7), (2, 0, 4), (3, 0, 8191)]
    invalid = spark.createDataFrame(given, "conv_id long, pos int, noisy int")
    found = tokens.candidates(invalid, book, ["conv_id", "pos"])
    want = set()
    for key in {g[:2] for g in given}:
        near = []
        for *own, noisy in given:
            if tuple(own) == key:
                near += [(d + (0 if b["class"] in ("en", "special", "punct", "number") else tokens.PENALTY), d, b.code_id, b.token) for b in book.collect() if (d := (noisy ^ b.code).bit_count()) in (1, 3)]
        want |= {(*key, k + 1, x[3], x[1], x[0]) for k, x in enumerate(sorted(near)[: tokens.TOP])}
    got = {(r.conv_id, r.pos, r["rank"], r.candidate, r.hamming, r.score) for r in found.collect()}
    assert {x[:3] + x[4:] for x in got} == {x[:3] + x[4:] for x in want} and {x for x in want if x[0] != 2} <= got
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("RepartitionByExpression")  # no row of a candidate is dealt out behind it
