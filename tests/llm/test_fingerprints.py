import hashlib
from collections import Counter

from helixframe.llm import fingerprints as P

from .conftest import prose


def test_query(spark, folder):
    got = [r.asDict() for r in P.query(spark, folder).collect()]
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    texts = {r.doc_id: r.text or "" for r in docs}
    order = sorted((i for i in texts if i is not None), reverse=True)
    for g in got:
        i = g["doc_id"]
        if i not in (None, 1, 2, 0):  # around repeated ids and nulls the next row is one of several
            own, following = texts[i], texts[order[(order.index(i) + 1) % len(order)]]
            k = len(own) // 3
            assert g["edited_sha256"] == hashlib.sha256((own[: len(own) - k] + following[:k]).encode()).hexdigest()
        assert g["n_chars"] == len(texts[i])
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
    by = {g["doc_id"]: g["fingerprint"] for g in got}
    assert by[0] == by[1] and by[2] == by[3] == by[4] == "" and by[0] != by[7]


def shingles(t):
    w = t.split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def errors(spark, pairs):
    """Of the estimates of all pairs."""
    df = spark.createDataFrame([(2 * i + j, t) for i, pair in enumerate(pairs) for j, t in enumerate(pair)], "id long, text string")
    signed = P.signatures(df, ["id"])
    a, b = signed.where("id % 2 = 0"), signed.where("id % 2 = 1").withColumnsRenamed({"id": "other", "signature": "s"})
    got = {r.id // 2: r.near for r in a.join(b, a.id + 1 == b.other).select("id", P.likeness(P.F.col("signature"), P.F.col("s")).alias("near")).collect()}
    out = []
    for i, (a, b) in enumerate(pairs):
        x, y = shingles(a), shingles(b)
        out.append(got[i] - sum((x & y).values()) / sum((x | y).values()))
    return out


def test_likeness_estimates_generalised_jaccard(spark):
    pairs = []
    for k in range(30):
        a = prose(400, 100 + k).split()
        b = a[: 40 + 12 * k] + prose(400 - 12 * k, 900 + k).split() + a[:10] * (k % 3)
        pairs.append((" ".join(a), " ".join(b)))
    e = errors(spark, pairs)
    assert abs(sum(e) / len(e)) < 3 * 0.5 / (30 * P.SAMPLES) ** 0.5 and max(map(abs, e)) < 3 / P.SAMPLES**0.5


def test_likeness_holds_for_heavy_repeats(spark):
    """Weights up to a thousand: one shared shingle and unlike ones; the same, weighing 1000 on one side, or 1000 and 500 or 100."""
    pairs = []
    for k in range(20):
        a, b, c = (prose(104, 3000 + 3 * k + i) for i in range(3))
        pairs += [(f"{a} " + "x " * 1004, f"{b} " + "x " * 1004), (f"{c} " + "x " * 1004, f"{c} " + "x " * 504), (f"{c} " + "x " * 1004, c), ("x " * 1004, "x " * 104)]
    e = errors(spark, pairs)
    for kind in range(4):
        own = e[kind::4]
        assert abs(sum(own) / len(own)) < 3 * 0.5 / (len(own) * P.SAMPLES) ** 0.5
    assert max(map(abs, e)) < 4 * 0.5 / P.SAMPLES**0.5


def test_document_fingerprints(spark, docs, empty):
    got = P.document_fingerprints(docs.withColumn("signature", P.F.lit("clash"))).collect()
    assert len(got) == docs.count() and {len(r.signature) for r in got} == {0, P.SAMPLES}
    by = {r.doc_id: r.fingerprint for r in got}
    assert by[0] == by[1] and by[2] == by[3] == by[4] == ""
    assert P.document_fingerprints(empty).count() == 0


def test_order_with_a_doc_id_of_half_the_rows(spark, tmp_path):
    """Every row is some row's next one, and buckets stay small."""
    rows = [(None if i % 2 else i, f"{i % 4000} " + prose(6, i)) for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got, heads = P.with_next(df)
    out = got.collect()
    assert sorted(r.text for r in out) == sorted(r.next_text for r in out) == sorted(t for _, t in rows)
    assert max(Counter(r.bucket for r in out).values()) < 3 * P.ROWS_A_BUCKET and heads.count() == len({r.bucket for r in out})
    texts = dict(rows)
    order = sorted((i for i in texts if i is not None), reverse=True)
    following = {r.doc_id: r.next_text for r in out if r.doc_id is not None}
    assert all(following[a] == texts[b] for a, b in zip(order, order[1:]))


def test_empty(spark, empty_folder):
    assert P.query(spark, empty_folder).count() == 0
