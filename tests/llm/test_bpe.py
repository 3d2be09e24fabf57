"""Byte-level BPE against the library that defines it, and round trips."""

import hashlib
import random

import numpy as np
import pytest

from helixframe.llm import byte_bpe as B


@pytest.fixture(scope="module")
def encoder():
    return B.worker_encoder(B.VOCABULARY)


@pytest.fixture(scope="module")
def library(encoder):
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_random_parts_equal_the_library(encoder, library):
    draw = random.Random(5)
    for alphabet in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "0123456789", "-=*#", "日本語人", "éèa", "aA bB", " \n\t x"):
        for n in (1, 2, 7, 8, 9, 16, 17, 33, 64, 65, 130, 500):
            text = "".join(draw.choice(alphabet) for _ in range(n))
            assert ids(encoder.encode(text)) == library.encode_ordinary(text)
            assert encoder.decode(encoder.encode(text)) == text.encode()


def test_repetitive_and_long_parts(encoder, library):
    for text in ("a" * 5000, "ab" * 3000 + "b", " " * 4097 + "x", "=" * 3333, "日" * 2001, "aab" * 2222, "<|endoftext|>" * 50):
        assert ids(encoder.encode(text)) == library.encode_ordinary(text)
    long = "".join(random.Random(9).choice("abcdefgh") for _ in range(300_000))
    assert encoder.decode(encoder.encode(long)).decode() == long


def test_join_is_a_monoid(encoder):
    """Any tree of joins gives the same tokens, and nothing is neutral."""
    draw = random.Random(3)
    for _ in range(200):
        raw = "".join(draw.choice("thenaio") for _ in range(draw.randint(3, 60))).encode()
        i, j = sorted((draw.randint(0, len(raw)), draw.randint(0, len(raw))))
        a, b, c = (encoder.merge(x) for x in (raw[:i], raw[i:j], raw[j:]))
        assert encoder.join(encoder.join(a, b), c) == encoder.join(a, encoder.join(b, c)) == encoder.merge(raw)
        assert encoder.join(a, []) == a == encoder.join([], a)


def test_ranks_that_training_would_not_give(library):
    """The join holds for any ranks, not only for those of a trained vocabulary."""
    draw = random.Random(11)
    for _ in range(60):
        tokens = {bytes([c]) for c in b"abc"} | {"".join(draw.choice("abc") for _ in range(draw.randint(2, 5))).encode() for _ in range(25)}
        order = list(tokens)
        draw.shuffle(order)
        e = B.Encoder({t: i for i, t in enumerate(order)}, r"\S+")
        for _ in range(20):
            raw = "".join(draw.choice("abc") for _ in range(draw.randint(1, 90))).encode()
            assert e.tokens(raw) == e.merge(raw) == e.merge_long(raw)


def test_memory_is_bounded():
    memo = B.Memo(len, most=10)
    for i in range(100):
        assert memo["x" * (i % 70)] == i % 70
        assert len(memo) <= 10 and all(len(k) <= B.KEEP for k in memo)


def test_query(spark, folder, empty_folder, docs, library):
    got = {(r.doc_id, r.ids_sha256) for r in B.query(spark, folder).collect()}
    want = set()
    for r in docs.collect():
        raw = np.array(library.encode_ordinary(r.text or ""), dtype="<u4").tobytes()
        want.add((r.doc_id, hashlib.sha256(raw).hexdigest()))
    assert got == want and B.query(spark, folder).count() == docs.count()
    texts = {hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect()}
    assert {r.decoded_sha256 for r in B.query(spark, folder).collect()} == texts
    assert B.query(spark, empty_folder).count() == 0


def test_clashing_names_and_unpacking(spark, library):
    df = spark.createDataFrame([("two words", 1, "x"), (None, 2, "y")], "text string, ids int, Decoded string")
    got = B.round_trip(df).withColumn("list", B.unpack(B.F.col("ids"))).orderBy("text").collect()
    assert got[0].list == [] and got[1].list == library.encode_ordinary("two words") and bytes(got[1].decoded) == b"two words"
    odd = spark.sql("SELECT cast(unhex('61FF62') AS string) AS text")
    assert bytes(B.round_trip(odd).first().decoded).decode() == "a�b"
