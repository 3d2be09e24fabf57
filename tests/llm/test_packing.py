import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from helixframe.llm import packing as P

from .conftest import prose


def test_encoder_equals_the_tokenizer():
    whole, own, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), P.Encoder(), random.Random(1)
    parts = ["a", " ", "\n", "é", "1", "'s", "!", "  ", "\t", "中", "<|endoftext|>", " ", " ", "the", "\r", "\x0b", "\x85", "　", "\x1c"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert own(text) == np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def pieces_are_whole(rows, texts):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = [(i, np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")) for i, t in texts]
    want = Counter((i, len(x)) for i, x in encoded)
    tokens = Counter()
    for r in rows:
        tokens[(r.doc_id, r.doc_tokens)] += r.length
        assert any(i == r.doc_id and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for i, x in encoded)
    assert tokens == Counter({(i, n): n * k for (i, n), k in want.items()})
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= P.WINDOW
    return sum(n < P.WINDOW for n in (sum(x for _, x in own) for own in by.values()))


def test_every_token_lies_in_one_piece(spark, docs, empty):
    rows = P.pack(docs).collect()
    short = pieces_are_whole(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert short <= 1
    assert P.pack(empty).count() == 0


def test_windows_hold_the_target_shares():
    mixer = P.Mixer({0: 0.5, 1: 0.3, 2: 0.2})
    for q in (0, 1, 2):
        for d in range(400):
            mixer.add(q, d, 0, b"\1\0\0\0" * 500, 500)
    for _ in range(300):
        mixer.window()
    got = Counter()
    left = {q: sum(len(ids) // 4 for _, _, ids, _ in docs) for q, docs in mixer.queues.items()}
    taken = {q: 200_000 - n for q, n in left.items()}
    assert all(abs(taken[q] / sum(taken.values()) - s) < 0.01 for q, s in mixer.shares.items())
    assert all(abs(d) < 2 * P.WINDOW for d in mixer.deficit.values())


def deviations(spark, docs):
    """Over the full windows, the mean and the largest distance of a source's share from its share of all tokens."""
    rows = P.pack(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    whole, windows = Counter(), {}
    for r in rows:
        whole[r.source] += r.length
        windows.setdefault(r.sequence_id, Counter())[r.source] += r.length
    total = sum(whole.values())
    off = [abs(w[s] / P.WINDOW - whole[s] / total) for w in windows.values() if sum(w.values()) == P.WINDOW for s in whole]
    return sum(off) / len(off), max(off)


def test_windows_hold_the_target_shares_of_an_input_sorted_by_source(spark):
    rows = [(s * 1000 + i, "abc"[s], prose(100, s * 1000 + i)) for s, n in enumerate((250, 150, 100)) for i in range(n)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 5), "doc_id long, source string, text string")
    mean, most = deviations(spark, docs)
    print("mean, largest deviation:", mean, most)
    assert mean < 0.06 and most < 0.4


def test_twenty_sources_of_long_texts_share_every_window(spark):
    """Total variation between a full window's shares and the targets, on average."""
    rows = [(s * 1000 + i, f"s{s:02d}", prose(200 + 37 * (i * (s + 3) % 50), s * 1000 + i)) for s in range(20) for i in range(30)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "doc_id long, source string, text string")
    packed = P.pack(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    whole, windows = Counter(), {}
    for r in packed:
        whole[r.source] += r.length
        windows.setdefault(r.sequence_id, Counter())[r.source] += r.length
    total = sum(whole.values())
    off = [sum(abs(w[s] / P.WINDOW - whole[s] / total) for s in whole) / 2 for w in windows.values() if sum(w.values()) == P.WINDOW]
    print("mean, largest total variation:", sum(off) / len(off), max(off))
    assert sum(off) / len(off) < 0.1 and len(off) > 500


def test_an_empty_queue_hands_on_what_it_owes():
    mixer = P.Mixer({0: 0.5, 1: 0.5})
    mixer.add(0, 1, 0, b"\1\0\0\0" * 1100, 1100)
    mixer.add(1, 2, 0, b"\1\0\0\0" * 200, 200)
    mixer.window()
    owed = {r.queue: (r.length, r.deficit) for r in P._rests(mixer, 0).itertuples()}
    assert set(owed) == {0, 1} and owed[1] == (0, mixer.deficit[1])


def test_sources_that_share_a_queue_have_their_summed_share(spark, monkeypatch):
    monkeypatch.setattr(P, "MAX_QUEUES", 2)
    rows = [(i, "ab"[i % 2] if i < 120 else f"small{i}", prose(100, i)) for i in range(240)]  # the small ones are half of all
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    tail, windows = Counter(), Counter()
    for r in P.pack(docs).collect():
        windows[r.sequence_id] += r.length
        tail[r.sequence_id] += r.length * (r.doc_id >= 120)
    full = [s for s in windows if windows[s] == P.WINDOW]
    assert sum(abs(tail[s] / P.WINDOW - 0.5) for s in full) / len(full) < 0.1
