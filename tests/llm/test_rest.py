"""Quality rules, URL templates, shards, toxicity, the language model, and the pipeline."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from helixframe.llm import common as C
from helixframe.llm import hilbert_shards as H
from helixframe.llm import quality_rules as Q
from helixframe.llm import recurrent_lm as L
from helixframe.llm import toxicity as X
from helixframe.llm import url_templates as U

from .conftest import prose


def test_counts_equal_brute_force(docs, empty):
    assert not any(r.kept and r.base_failed for r in Q.apply_rules(docs).collect())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in Q.with_counts(docs.select("doc_id", "text")).collect():
        w = [x for x in texts[r.doc_id].replace(" ", " ").encode().split()]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + d for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for d in range(3)}
        assert (r.n_words, r.n_repeat_words) == (len(w), len(covered))
        assert r.word_chars == sum(len(x.decode()) for x in w)
    assert Q.apply_rules(empty).count() == 0


def test_columns_of_any_name_stay(spark):
    clash = ["__t", "__w", "__l", "__h", "__bad", "_text", "_host", "_bad", "_WORDS"]
    df = spark.createDataFrame([(1, prose(60, 1), "s", *clash), (2, None, None, *clash)], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in clash))
    for r in Q.apply_rules(df).collect():
        assert [r[c] for c in clash] == clash


def test_spread_join_takes_equal_rows_maps_and_any_name(spark, tmp_path):
    rows = [("hot", {"a": 1}, "x")] * 3000 + [(None, None, "y")] * 500 + [(f"k{i}", {}, "z") for i in range(50)]
    left = spark.createDataFrame(rows, "key string, _key map<string,int>, _right_0 string")
    left.write.parquet(f"file://{tmp_path}/left")
    left = spark.read.parquet(f"file://{tmp_path}/left")
    right = left.groupBy("key").count().where("key is null or key != 'k7'").select("key", F.lit(5).alias("_right_0 "), F.concat(F.lit("v"), F.coalesce("key", F.lit("null"))).alias("value"), F.col("count").alias("n"))
    for total in (0, 3550, 10**9):
        got = C.spread_join(left, right, "key", "n", total)
        assert got.columns == ["key", "_key", "_right_0", "_right_0 ", "value"]
        assert Counter(r.value for r in got.collect()) == {"vhot": 3000, "vnull": 500, None: 1} | {f"vk{i}": 1 for i in range(50) if i != 7}


def test_hosts_shrink_towards_the_prior(spark):
    rows = [("good", i % 50 == 0) for i in range(1000)] + [("bad", i % 10 != 0) for i in range(1000)] + [("tiny", True)] + [(None, False)]
    rates = {r.host: r.rate for r in Q.host_rates(spark.createDataFrame(rows, "host string, failed boolean"), "host", "failed").collect()}
    assert rates["bad"] > 0.85 and rates["good"] < 0.05 and rates["tiny"] < 1 and set(rates) == {"good", "bad", "tiny", None}


def test_urls(spark, empty_folder):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/1?x=/", "http://a.example.com/en/7/x", "http://b.net/de/9", "http://x.example.net/de/8#f", "http://c.org/es/", "http://c.org", "http://notcom/en/1", "ftp://d.com/a/b/c/d/e"]
    got = {r.url: r for r in U.judge(spark.createDataFrame([(u, "clash") for u in urls] * 2, "url string, host string")).collect()}
    assert got[None].host == got[""].host == got["no scheme"].path == ""
    assert (got["HTTP://A.Example.COM/en/1?x=/"].host, got["HTTP://A.Example.COM/en/1?x=/"].rule) == ("a.example.com", "com/en/")
    assert got["http://a.example.com/en/7/x"].verdict == "allow" and got["http://x.example.net/de/8#f"].rule == "example.net/de/8"
    assert got["http://notcom/en/1"].rule is None and got["ftp://d.com/a/b/c/d/e"].template == "/a/b/c/d/e"
    assert U.query(spark, empty_folder).count() == 0


def test_rules_are_the_contracts(spark):
    """Every rule decides as the contract lists it, at its own host and at a subdomain."""
    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {rule: verdict for verdict, rule in U.RULES} == contract
    urls = [(f"http://{sub}{rule}", rule) for rule in contract for sub in ("", "a.b.")]
    got = U.judge(spark.createDataFrame(urls, "url string, expected string")).collect()
    assert len(got) == 10 and all((r.rule, r.verdict) == (r.expected, contract[r.expected]) for r in got)


def test_templates_of_five_segments_are_told_apart(spark):
    """Deep paths have templates and verdicts of their own, and wildcards at any depth."""
    name = lambda i: f"{chr(97 + i % 26)}{chr(97 + i // 26)}x"
    rows = [(f"http://h.com/a/b/c/up/{name(i)}",) for i in range(60)] + [(f"http://h.com/a/b/c/down/{i}",) for i in range(30)] + [("http://h.com/a/b/c/down",)] * 3
    rows += [(f"http://h.com/en/x/y/z/{name(i)}/last",) for i in range(60)]
    got = {r.template: r.verdict for r in U.judge(spark.createDataFrame(rows, "url string")).collect()}
    assert got == {"/a/b/c/up/*": "allow", "/a/b/c/down/*": "allow", "/a/b/c/down": "allow", "/en/x/y/z/*/last": "block"}


def brute_templates(urls):
    """Templates by a tree of dictionaries, a level at a time."""
    import re

    paths = Counter()
    for u in urls:
        parts = [p for p in u.split("://")[1].split("/")[1:] if p]
        paths[u.split("://")[1].split("/")[0], tuple("*" + re.search(r"(\.[A-Za-z]+)?$", p)[0] if re.search("[0-9]", p) else p for p in parts)] += 1
    now = {k: k[1] for k in paths}
    for level in range(max(len(t) for t in now.values())):
        kids = {}
        for k, t in now.items():
            if len(t) > level:
                at = kids.setdefault((k[0], t[:level]), Counter())
                at[t[level]] += paths[k]
        for k, t in list(now.items()):
            if len(t) > level:
                at = kids[k[0], t[:level]]
                if len(at) > U.MAX_CHILDREN and at[t[level]] < U.MIN_SHARE * sum(at.values()) and not t[level].startswith("*"):
                    now[k] = (*t[:level], "*", *t[level + 1 :])
    return {"/" + "/".join(t) for t in now.values()}


def test_templates_equal_brute_force(spark):
    draw = random.Random(8)
    word = lambda n: "".join(draw.choice("abcd") for _ in range(n))
    urls = [f"http://{draw.choice('hijk')}.com/" + "/".join(word(draw.choice((1, 1, 2, 3))) + draw.choice(("", "", "", "7", "7.html")) for _ in range(draw.randint(0, 5))) for _ in range(900)]
    assert {r.template for r in U.judge(spark.createDataFrame([(u,) for u in urls], "url string")).select("template").distinct().collect()} == brute_templates(urls)


def test_templates_generalise_and_follow_labels(spark):
    rows = [(f"http://h.com/en/{i}",) for i in range(40)] + [(f"http://h.com/tag/name{chr(97 + i % 26)}{chr(97 + i // 26)}x",) for i in range(60)] + [("http://h.com/fr/1",)]
    got = U.judge(spark.createDataFrame(rows, "url string")).collect()
    by = {r.template for r in got}
    assert by == {"/en/*", "/tag/*", "/fr/*"}
    assert {r.verdict for r in got if r.template == "/tag/*"} == {"allow"} and {r.verdict for r in got if r.template == "/en/*"} == {"block"}


def test_hilbert_index_is_a_walk():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    index = H.hilbert_index(cells, 3)
    assert sorted(index) == list(range(512))
    steps = np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_shards(spark, docs, empty):
    got = H.shard(docs, 4).collect()
    assert len(got) == docs.count()
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    small = spark.createDataFrame([(i, f"text {i // 3} " * 5, "en", f"s{i % 4}") for i in range(6000)], "doc_id long, text string, lang string, source string")
    parts = H.shard(small, 8)
    by = [r.b for r in parts.groupBy("shard").agg(H.F.sum("size").alias("b")).collect()]
    assert max(by) - min(by) < 0.02 * sum(by) / 8
    split = parts.join(small, "doc_id").groupBy("text").agg(H.F.count_distinct("shard").alias("k")).where("k > 1").count()
    assert split == 0
    assert H.shard(empty).count() == 0


def test_cuts_equal_brute_force(spark):
    """Every row's shard from the sorted rows, cut by cut; cells by rank; groups of copies of all sizes, one of them a third of all."""
    draw = random.Random(12)
    texts = [prose(draw.randint(1, 60), i) for i in range(150)]
    rows = [(i, texts[i % 150], draw.choice(("en", "de", None)), f"s{i % 20:02d}") for i in range(200)] + [(1000 + i, texts[3], "en", "s03") for i in range(100)]
    rows += [(None, texts[5], "en", "s00")] * 40 + [(7, "", "fr", None), (8, None, "fr", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = H.shard(df, 6).collect()
    langs, sources = [None, "de", "en", "fr"], [None, *(f"s{i:02d}" for i in range(20))]
    by = {}
    for i, t, lang, s in rows:
        by.setdefault(t or "", []).append((i is None, i or 0, lang is not None, lang or "", s is not None, s or "", lang, s))
    curve = {}
    for t, own in by.items():
        first = min(own)
        size = len(t.encode()) + 8
        cell = [langs.index(first[6]), sources.index(first[7]), min(31, math.floor(math.log2(size) * 1.5))]
        curve[zlib.crc32(t.encode())] = int(H.hilbert_index(np.array([cell]))[0])
    assert all(r.curve == curve[r.text_crc32] for r in got) and len(got) == len(rows)
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in got)
    total, at, runs = sum(r.size for r in got), 0, []
    for r in ordered:
        if not runs or runs[-1][0] != r.text_crc32:
            runs.append([r.text_crc32, at, at])
        at += r.size
        runs[-1][2] = at
    assert len(runs) == len(by)  # copies lie side by side
    cuts = []
    for k in range(1, 6):
        c = k * total / 6
        _, start, end = next(x for x in runs if x[1] <= c < x[2])
        near, far = (start, end) if c - start <= end - c else (end, start)
        cuts.append(near if abs(near - c) <= H.MOVE * total / 6 else c)
    at = 0
    for r in ordered:
        assert r.shard == sum(c <= at for c in cuts)
        at += r.size
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(sizes) == 6 and max(sizes.values()) - min(sizes.values()) < 0.05 * total / 6 + 2 * max(r.size for r in got)


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(5)
    bad = ["numbskull", "blockhead", "nitwit"]
    texts = []
    for i in range(400):
        w = prose(80, i).split()
        if i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(80)] = rng.choice(bad)
        texts.append((" ".join(w), int(i % 4 == 0)))
    weights, b = X.fit([t for t, _ in texts[:300]], [y for _, y in texts[:300]])
    score = X.score_texts([t for t, _ in texts[300:]], weights, b)
    assert np.mean((score >= 0.5) == [y for _, y in texts[300:]]) > 0.95
    assert 0 <= X.score_texts([None, "", "x" * 10**6], weights, b).min()


def test_toxicity_edge_cases(spark, folder, empty_folder):
    got = X.query(spark, folder).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.doc_id: r.held_out for r in got if r.doc_id is not None} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in {r.doc_id for r in got if r.doc_id is not None}}
    assert X.query(spark, empty_folder).count() == 0


def brute_base(texts):
    words = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in texts}
    train = [w for i, own in words.items() if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for w in own]
    c, n = Counter(train), len(train)
    z = n + 0.5 * (len(c) + 1)
    return {i: (len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 0.5) / z) for w in own)) for i, own in words.items()}


@pytest.mark.parametrize("frequent", [60_000, 10])
def test_language_model_base(spark, folder, monkeypatch, frequent):
    monkeypatch.setattr(L, "FREQUENT", frequent)
    rows = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id <> 1").collect()
    df = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    df = df.withColumn("held_out", L.F.pmod(L.F.crc32(L.F.coalesce(L.F.col("doc_id").cast("string"), L.F.lit("")).cast("binary")), L.F.lit(5)) == 1)
    want = brute_base([(r.doc_id, r.text) for r in rows])
    got = L.score(df).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(base)
        assert r.score < 0


def model(docs: list[list[bytes]]):
    """Vocabulary, tables and codes of documents given as words."""
    c = Counter(w for d in docs for w in d)
    words = [w for w, _ in c.most_common()]
    fold = lambda f: np.bincount([L.ending(w) for w in words], weights=[f(w) for w in words], minlength=L.ENDINGS)
    v = L.Vocabulary(words, np.array([c[w] for w in words]), fold(lambda w: c[w]), fold(lambda w: 1), 1)
    t = L.Tables(v, np.arange(L.ENDINGS) % L.CLASSES)
    encode = L.Encoder(words)
    return v, t, [encode(d)[0] for d in docs]


def test_language_model_learns_and_sums_to_one():
    pattern = [b"a", b"b", b"c", b"d"]
    _, t, codes = model([pattern * 30 + [L.END] for _ in range(20)])
    slots = [t.slot[c] for c in codes]
    learn = L.Trainer(L.Network.initial(t), t.end)
    before = L.score_slots(learn.net, slots[:1], t.end)[0]
    for _ in range(12):
        learn(slots)
    assert L.score_slots(learn.net, slots[:1], t.end)[0] > 0.2 * before
    h = np.random.default_rng(0).uniform(-1, 1, (1, L.HIDDEN)).astype(np.float32)
    everything = np.arange(L.CLASSES * L.SLOTS)
    logs, _ = learn.net.log_probs(np.repeat(h, len(everything), axis=0), everything)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def random_network(dtype=np.float64):
    rng = np.random.default_rng(1)
    _, t, _ = model([[b"a", L.END]])
    net = L.Network({k: (w + 0.3 * rng.standard_normal(w.shape)).astype(dtype) for k, w in L.Network.initial(t).w.items()})
    return net, rng


def test_gradients():
    """Against finite differences, through the steps of a window in which documents start and lanes end."""
    net, rng = random_network()
    cuts = np.cumsum([0, 4, 4, 3, 2])
    x, y = (rng.integers(0, L.CLASSES * L.SLOTS, cuts[-1]) for _ in range(2))
    fresh = rng.random(cuts[-1]) < 0.2
    h = rng.uniform(-1, 1, (4, L.HIDDEN))
    run = lambda: L.gradients(net, net.w["input"][x], fresh, y, cuts, h)

    def total():
        state, out = h, 0.0
        for a, z in zip(cuts, cuts[1:]):
            state, _ = net.step(net.w["input"][x[a:z]], np.where(fresh[a:z, None], 0.0, state[: z - a]))
            out += net.log_probs(state, y[a:z])[0].sum()
        return out

    grads, after = run()
    assert after.shape == (2, L.HIDDEN)
    whole = np.zeros_like(net.w["input"])
    np.add.at(whole, x, grads["input"])
    grads["input"] = whole
    k = int(y[0]) // L.SLOTS
    places = {"class": (3, k), "class_bias": (k,), "slot": (k, 2, int(y[0]) % L.SLOTS), "slot_bias": (k, 3)}
    checks = [*places.items(), *[("state", (2, j)) for j in (1, L.HIDDEN + 1, 2 * L.HIDDEN + 1)], *[("input", (x[0], j)) for j in (0, L.HIDDEN, 2 * L.HIDDEN)]]
    for name, at in checks:
        net.w[name][at] += 1e-5
        up = total()
        net.w[name][at] -= 2e-5
        down = total()
        net.w[name][at] += 1e-5
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-4), name


def test_scores_carry_the_state_across_windows(monkeypatch):
    """Lanes and windows against one document at a time, token by token; one document is far longer than the others."""
    net, rng = random_network(np.float32)
    docs = [rng.integers(0, L.CLASSES * L.SLOTS, n).astype(np.int16) for n in (1, 3, 1000, 64, 65, 2, 127)]
    monkeypatch.setattr(L, "LANES", 3)
    got = L.score_slots(net, docs, 31)
    for d, s in zip(docs, got):
        h, x, want = np.zeros((1, L.HIDDEN), dtype=np.float32), 31, 0.0
        for y in d.tolist():
            h, _ = net.step(net.w["input"][[x]], h)
            want += net.log_probs(h, np.array([y]))[0][0]
            x = y
        assert s == pytest.approx(want, rel=1e-4)


def test_streams_take_memory_by_tokens():
    s = L.Streams([np.zeros(200_000, dtype=np.int16), *[np.zeros(1, dtype=np.int16)] * 511], 512, 0)
    assert len(s.y) == len(s.x) == len(s.fresh) == len(s.doc) == 200_511


def test_language_model_on_an_empty_table(spark, empty_folder):
    assert L.query(spark, empty_folder).count() == 0


def test_pipeline(spark, folder, empty_folder):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = []
    for _, stage in P.STAGES:
        steps.append(stage(spark, steps[-1] if steps else docs, folder))
    assert all(s.columns == docs.columns for s in steps[:-1])
    kept = {r.doc_id for r in steps[1].collect()}
    assert kept == {0, 6, None, 10}  # short, repetitive and copied documents are gone
    assert P.run(spark, empty_folder).count() == 0


def test_the_network_learns_from_all_training_documents(spark, folder, monkeypatch):
    seen, whole = [], L.train_network
    monkeypatch.setattr(L, "train_network", lambda train, tables, net: seen.append(train.count()) or whole(train, tables, net))
    rows = L.query(spark, folder).collect()
    assert seen == [sum(not r.held_out for r in rows)]


def test_profiles():
    docs = [np.array([0, 1, 1], dtype=np.uint16), np.array([2], dtype=np.uint16), np.zeros(0, dtype=np.uint16)]
    ending_of = np.array([5, L.PROFILE + 5, 9])
    want = np.zeros((L.ENDINGS, L.PROFILE))
    want[5, 5], want[L.PROFILE + 5, 5], want[9, 9] = 1, 2, 1
    assert np.allclose(L.profile(docs, ending_of), want)


def brute_slots(text):
    """N-grams of characters, hashed by whole numbers."""
    t = " " + " ".join("".join(c.lower() if c.isascii() else c for c in text).encode().decode().translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ")) + " "
    while "  " in t:
        t = t.replace("  ", " ")
    out = set()
    for n in X.N_GRAMS:
        for i in range(len(t) - n + 1):
            h = 0
            for c in t[i : i + n]:
                h = (h * 257 + ord(c)) % 2**64
            out.add(((h * int(X._FACTOR) + n) * int(X._FACTOR)) % 2**64 >> 44)
    return out


@pytest.mark.parametrize("part", [1 << 20, 7])
def test_features_are_n_grams_of_characters(monkeypatch, part):
    monkeypatch.setattr(X, "PART", part)
    for text in ("abc", "Größe über ALLES", "пример текста", "a\tb\n c  d", "\U0001f600\U0001f601 smile twice \U0001f600", "x"):
        assert set(X.slots(text).tolist()) == brute_slots(text)
        assert len(X.slots(text)) == len(brute_slots(text))


def test_ratios_and_scores_in_plain_python():
    texts = [prose(12, i) + (" vile" if i % 3 == 0 else " kind") for i in range(60)]
    labels = [int(i % 3 == 0) for i in range(60)]
    weights, b = X.fit(texts, labels)
    n1, n0 = sum(labels), len(labels) - sum(labels)
    for slot in brute_slots("vile") | brute_slots("kind"):
        k1, k0 = (sum(slot in brute_slots(t) for t, y in zip(texts, labels) if y == own) for own in (1, 0))
        ratio = math.log((k1 + X.SMOOTH) / (n1 + 2 * X.SMOOTH)) - math.log((k0 + X.SMOOTH) / (n0 + 2 * X.SMOOTH))
        if weights[slot]:
            assert k1 + k0 >= X.MIN_TEXTS and (weights[slot] > 0) == (ratio > 0)
    for t, s in zip(texts, X.score_texts(texts, weights, b)):
        assert s == pytest.approx(1 / (1 + math.exp(-(b + sum(float(weights[k]) for k in brute_slots(t))))), abs=1e-6)


def test_profiles_of_endings_take_no_row_a_token():
    """Counts of endings by the shares of their documents, within memory that doesn't grow with the tokens."""
    rng = np.random.default_rng(4)
    docs, ending_of = [rng.integers(0, 6000, n) for n in [*[1000] * 300, 0, 1, 7]], rng.integers(0, L.ENDINGS, 6000)
    tracemalloc.start()
    got = L.profile(docs, ending_of)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.zeros((L.ENDINGS, L.PROFILE))
    for d in docs:
        e = ending_of[d]
        np.add.at(want, e, np.bincount(e % L.PROFILE, minlength=L.PROFILE) / max(len(d), 1))
    assert np.allclose(got, want, rtol=1e-5) and peak < 50_000_000
    assert not L.profile([], ending_of).any() and not L.profile(docs[300:301], ending_of).any()


def test_a_softmax_is_worked_out_by_blocks_of_tokens_not_by_classes(monkeypatch):
    """Against plain softmaxes of one token each; and the work has no call for every class of a window."""
    net, rng = random_network()
    n = 2 * L.BLOCK + 5
    h, y = rng.uniform(-1, 1, (n, L.HIDDEN)), rng.integers(0, L.CLASSES * L.SLOTS, n)
    calls, whole = [], L.Network._choices
    monkeypatch.setattr(L.Network, "_choices", staticmethod(lambda *a: calls.append(1) or whole(*a)))
    got, _ = net.log_probs(h, y)
    log = lambda a, k: a[k] - np.log(np.exp(a).sum())
    w, c, s = net.w, y // L.SLOTS, y % L.SLOTS
    want = [log(h[i] @ w["class"] + w["class_bias"], c[i]) + log(h[i] @ w["slot"][c[i]] + w["slot_bias"][c[i]], s[i]) for i in range(n)]
    assert np.allclose(got, want) and len(calls) == 6


def test_an_encoder_keeps_nothing_of_rare_words():
    encode = L.Encoder([b"a", L.END])
    words = [b"a", *[b"%d" % i for i in range(1000)], L.END]
    held = lambda: sum(len(x) for x in vars(encode).values() if hasattr(x, "__len__"))
    before = held()
    codes, hashes = encode(words)
    assert held() == before
    assert codes.tolist() == [0, *[2 + L.ending(w) for w in words[1:-1]], 1]
    assert [h % (1 << 64) for h in hashes.tolist()] == [L.xxhash.xxh64_intdigest(w, 42) for w in words[1:-1]]
