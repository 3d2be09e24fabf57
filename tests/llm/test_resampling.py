"""Importance resampling against a brute-force version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from helixframe.llm import importance_resampling as R

from .conftest import prose


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def grams(w, most):
    return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, most=1):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, grams(words(text), most)))
    for text in target:
        t.update(map(bucket, grams(words(text), most)))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    scored = []
    for key, text in docs:
        f = grams(words(text), most)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        scored.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((x for x in scored if x[5] >= 20), key=lambda x: (-x[3], x[0] is not None, x[0] or 0, x[1]))
    for i, x in enumerate(able[: len(able) * 10 // 100]):
        x[4] = i + 1
    return sorted(repr(tuple(x[:5])) for x in scored)


@pytest.fixture(scope="module")
def table():
    texts = [prose(19 + i % 90, i % 37) for i in range(120)] + ["Ünï-cödé 1st 2nd\x00 a_b " * 12, None, "", "!!!", prose(19, 3), "X" * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500 + i, prose(70, 5)) for i in range(60)] + [(9, prose(40, 9))] * 3 + [(None, prose(44, 4))]
    return rows, [prose(80, 5), prose(30, 91), None, ""]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_equals_brute_force(spark, table, most):
    rows, target = table
    docs = spark.createDataFrame([(a, b, "clash", 0) for a, b in rows], "doc_id long, text string, digest string, n long").repartition(5)
    got = R.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), most=most).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows, target, most)


def test_target_like_texts_are_drawn_more(spark):
    rows = [(i, prose(60, i) if i % 10 else "sun moon star " * 20) for i in range(400)]
    target = spark.createDataFrame([("moon sun star " * 5000,)], "text string")
    got = R.resample(spark.createDataFrame(rows, "doc_id long, text string"), target).where("rank is not null").collect()
    assert len(got) == 40 and sorted(r["rank"] for r in got) == list(range(1, 41)) and sum(r.doc_id % 10 == 0 for r in got) >= 30


def test_empty_tables(spark, docs, empty):
    assert R.resample(empty, empty).count() == 0
    assert R.resample(docs, empty).count() == docs.count()
    assert R.resample(empty, docs).count() == 0
