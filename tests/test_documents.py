"""Reports over whole documents: the same numbers as plain Python, without a row a token or a function over an array of runs."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from helixframe.functions import dna as D
from helixframe.operators import codecs, tokens

TEXTS = [(1, "en", "The cat, the hat."), (1, "en", "Un chat et the 12 cats and more of them"), (2, "fr", ""), (3, "fr", None), (4, None, "été 北京 the the"), (5, "en", "a" * 500 + " \n")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('documents')}"
    spark.createDataFrame(TEXTS, "doc_id long, lang string, text string").write.parquet(f"{path}/documents.parquet")
    return path


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def listed(spark, text):
    """Tokens of a text, a row each, as the operator makes them."""
    return [r.token for r in tokens.tokens(spark.createDataFrame([(text,)], "text string")).orderBy("pos").collect()]


def test_tokens_of_rows_that_share_a_doc_id(spark, folder):
    df = tokens.tokens_simple(spark, folder)
    want = {}
    for i, _, text in TEXTS:
        found = listed(spark, text)
        if found:
            want.setdefault(i, []).append(found)
    got = {r.doc_id: r for r in df.collect()}
    assert set(got) == set(want)
    for i, lists in want.items():
        flat = [t for found in lists for t in found]
        assert (got[i].tokens, got[i].distinct_tokens, got[i].chars) == (len(flat), len(set(flat)), sum(map(len, flat)))
        assert got[i].last_token == max(lists, key=len)[-1]
    assert "Generate" not in plan(df)  # no row a token


def test_a_distinct_token_is_classified_once(spark, folder):
    df = tokens.tokens_language_class(spark, folder)
    got = {(r.lang, r["class"]): (r.tokens, r.distinct_tokens) for r in df.collect()}
    assert got[None, "zh"] == (1, 1) and got["en", "number"] == (1, 1) and got[None, "en"][0] >= 2
    assert sum(n for n, _ in got.values()) == sum(len(listed(spark, t)) for _, _, t in TEXTS)
    assert re.search(r"Aggregate \[lang#\d+, token#\d+\]", plan(df))  # tokens are counted before their class is asked


def test_bits_and_runs_equal_plain_python(spark, folder):
    for r in codecs.bits_roundtrip(spark, folder).collect():
        bits = {"".join(f"{b:08b}" for b in (t or "").encode()) for i, _, t in TEXTS if i == r.doc_id}
        (own,) = [b for b in bits if hashlib.md5(b.encode()).hexdigest() == r.bits_md5]
        assert (r.n_bits, r.ones, r.same, r.padded_bytes, r.whole_bytes) == (len(own), own.count("1"), True, len(own) // 8, max(len(own) // 8 - 1, 0))
    dnas = ["", None, "A", "AACCCGGGGTTTTTTA", "NAANNC-", "ACGT" * 50 + "T" * 300]
    df = codecs.metrics(spark.createDataFrame([(d,) for d in dnas], "dna string"))
    for r in df.collect():
        runs = [len(x) for x in re.findall("A+|C+|G+|T+", r.dna or "")]
        assert r.longest == max(runs, default=0) and r.total_runs == (None if r.dna is None else len(runs))
        if r.dna is not None:
            assert [r[f"len_{k}"] for k in range(1, 5)] == [runs.count(k) for k in range(1, 5)]
            assert [r.runs_ge2, r.runs_ge3, r.runs_ge4, r.len_ge5] == [sum(x >= k for x in runs) for k in (2, 3, 4, 5)]
    assert "filter(" not in plan(df) and "translate" not in plan(codecs.bits_roundtrip(spark, folder))


def test_what_is_no_sequence_of_dimers_is_null(spark):
    dnas = ["", "ACGT", "ACG", "ACGN", "acgt", None, "ACGTA\n"]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in dnas], "dna string").select(D.unplain(F.col("dna"))).collect()]
    assert [None if g is None else bytes(g) for g in got] == [b"", b"\x1b", None, None, None, None, None]
