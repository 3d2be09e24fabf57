import random

import pytest

from helixframe.llm import simhash_dedup as S


def brute(fps, radius):
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= radius and find(a) != find(b):
                root[find(a)] = find(b)
    groups = {}
    for x in fps:
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def test_tree_finds_all_within_the_radius():
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(200)] + [rng.getrandbits(64) for _ in range(200)]
    tree = S.BKTree()
    for x in fps:
        tree.add(x)
    for x in fps:
        assert set(tree.within(x, 2)) == {y for y in fps if (x ^ y).bit_count() <= 2}


@pytest.mark.parametrize("most", [512, 4])
def test_components_equal_brute_force_also_where_shards_split(spark, monkeypatch, most):
    monkeypatch.setattr(S, "MAX_SHARD", most)
    rng = random.Random(2)
    fps = {0}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):  # chains and clusters
            fps.add(x)
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(fps)], "doc_id long, fp long")
    distinct = rows.groupBy("fp").agg(S.F.count(S.F.lit(1)).alias("n"), S.F.min("doc_id").alias("lo"))
    got = {}
    for r in S.with_components(rows, distinct, S.links(distinct, 2)).collect():
        got.setdefault(r.component_id, set()).add(fps[r.doc_id])
    assert {frozenset(g) for g in got.values()} == brute(fps, 2)
    assert all(min(fps.index(x) for x in g) == c for c, g in got.items())


def test_edge_cases(spark, docs, empty):
    got = {r.doc_id: r for r in S.near_duplicates(docs).collect()}
    assert len(S.near_duplicates(docs).collect()) == docs.count()
    assert got[2].fp == got[3].fp == got[4].fp == 0 and got[4].component_id == 2
    assert got[0].component_id == got[1].component_id == 0
    assert S.near_duplicates(empty).count() == 0


def test_stage_keeps_one_of_each_group(spark, docs, empty):
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in S.stage(spark, docs, "").collect())
    assert got == [(False, i) for i in (0, 2, 5, 6, 8, 10)] + [(True, 0)]
    assert S.stage(spark, docs, "").columns == docs.columns
    assert S.stage(spark, empty, "").count() == 0


def test_sketches():
    a = S._sketch(" ".join(map(str, range(100))))
    b = S._sketch(" ".join(map(str, range(90))))
    assert S.sketch_likeness(a, b) == pytest.approx(86 / 96) and S.sketch_likeness(a, a) == 1 and S.sketch_likeness(b"", b"") == 1


def _jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def _edited(rng, words, share):
    """A text of unlike words, and the same with one passage replaced such that the similarity is `share` or a little more."""
    a = [f"w{rng.getrandbits(40)}" for _ in range(words)]
    n = words - 4
    k = next(k for k in range(n, 0, -1) if (n - k - 4) / (n + k + 4) >= share)
    at = rng.randrange(5, words - k - 5)
    return " ".join(a), " ".join(a[:at] + [f"w{rng.getrandbits(40)}" for _ in range(k)] + a[at + k :])


def _groups(spark, texts):
    got = {}
    for r in S.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.component_id, set()).add(r.doc_id)
    return {frozenset(g) for g in got.values()}


def test_copies_are_found_whatever_the_distance_of_their_fingerprints(spark):
    rng, pairs = random.Random(3), []
    while len(pairs) < 60:  # at 0.8, further apart than any mask reaches
        a, b = _edited(rng, 60, 0.8)
        if (S.simhash(a) ^ S.simhash(b)).bit_count() > 12:
            pairs.append((a, b))
    assert all(0.8 <= _jaccard(a, b) < 0.87 for a, b in pairs)
    assert _groups(spark, [t for p in pairs for t in p]) == {frozenset((2 * i, 2 * i + 1)) for i in range(60)}


def test_band_agreement_is_that_of_the_similarity():
    rng = random.Random(5)
    pairs = [_edited(rng, 400, 0.8) for _ in range(150)]
    shared = [len(set(S.bands(S._shingle_set(a))) & set(S.bands(S._shingle_set(b)))) for a, b in pairs]
    assert min(shared) > 0 and abs(sum(shared) / 150 / S.BANDS - 0.8**S.BAND_ROWS) < 0.05


def test_every_member_is_compared_not_only_the_nearest(spark):
    """Pages of one template, unlike by the shingles, lie between a text and its copy."""
    rng, texts = random.Random(6), []
    while len(texts) < 160:
        a, b = _edited(rng, 300, 0.8)
        bits = (S.simhash(a) ^ S.simhash(b)).bit_count()
        words, between = a.split(), None
        for _ in range(40):
            k = rng.randrange(36, 60)
            at = rng.randrange(5, 295 - k)
            c = " ".join(words[:at] + [f"w{rng.getrandbits(40)}" for _ in range(k)] + words[at + k :])
            if (S.simhash(a) ^ S.simhash(c)).bit_count() < bits and _jaccard(a, c) < 0.79 and _jaccard(b, c) < 0.79:
                between = c
        if between:
            texts += [a, between, b, " ".join(f"w{rng.getrandbits(40)}" for _ in range(300))]
    want = {frozenset((i, i + 2)) for i in range(0, 160, 4)} | {frozenset((i + k,)) for i in range(0, 160, 4) for k in (1, 3)}
    assert _groups(spark, texts) == want


def test_links_span_the_groups_of_all_pairs():
    rng = random.Random(7)
    for members in (5, 60, 150):
        sets = [frozenset()]
        for _ in range(6):  # families: some alike, some just not, and chains
            x = [rng.getrandbits(60) for _ in range(rng.randrange(20, 80))]
            for _ in range(members):
                sets.append(frozenset(x))
                x = [rng.getrandbits(60) if rng.random() < 0.07 else e for e in x]
        sets = sorted(set(sets), key=lambda x: rng.random())
        arrays = [S.np.array(sorted(x), dtype="<u8") for x in sets]
        root = list(range(len(sets)))
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if x and y and len(x & y) >= 0.8 * len(x | y) and root[i] != root[j]:
                    root = [root[j] if r == root[i] else r for r in root]
        got = list(range(len(sets)))
        for i, j in S.alike_links(arrays):
            got = [got[i] if r == got[j] else r for r in got]
        groups = lambda of: {frozenset(i for i in range(len(of)) if of[i] == r) for r in set(of)}
        assert groups(got) == groups(root)


def test_similarity_is_settled_on_whole_texts(spark):
    """Long texts just above and just below 0.8, of which a sketch gets one in five wrong."""
    rng = random.Random(8)
    near, far = [_edited(rng, 1500, 0.81) for _ in range(25)], [_edited(rng, 1500, 0.785) for _ in range(25)]
    assert all(_jaccard(*p) >= 0.8 for p in near) and all(_jaccard(*p) < 0.8 for p in far)
    got = _groups(spark, [t for p in near + far for t in p])
    assert got == {frozenset((2 * i, 2 * i + 1)) for i in range(25)} | {frozenset((i,)) for i in range(50, 100)}


def test_equal_fingerprints_of_unlike_texts_stay_apart(spark):
    """Words that alternate have few three-word shingles: the fingerprint's majority is that of the repeated part."""
    a = " ".join(["x y z"] * 400 + [f"a{i}" for i in range(60)])
    b = " ".join(["x y z"] * 400 + [f"b{i}" for i in range(60)])
    assert S.simhash(a) == S.simhash(b)
    assert _groups(spark, [a, b]) == {frozenset((0,)), frozenset((1,))}


def test_stage_keeps_rows_by_text_where_a_doc_id_has_several(spark):
    """(3, A), (5, A), (5, B): one A and the B stay, whatever the columns are called."""
    from .conftest import prose

    a, b = prose(80, 61), prose(80, 62)
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "x"), (7, b + " more", "x"), (7, prose(80, 63), "x"), (None, a, "x"), (None, a, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __h string").withColumn("_first", S.F.lit(1)).withColumn("_Second", S.F.lit(2))
    got = S.stage(spark, df, "")
    assert got.columns == df.columns
    assert sorted(((r.doc_id or 0, r.text) for r in got.collect())) == sorted([(0, a), (3, a), (5, b), (7, prose(80, 63))]) 


def plain_simhash(text):
    """Bit by bit, from the contract's words."""
    import xxhash

    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_those_bit_by_bit(docs):
    for text in [r.text for r in docs.collect()] + ["a b", "A\x0bB\x0cc d", "é É x y", "\xa0a b c d", "x " * 500]:
        assert S.simhash(text) == plain_simhash(text)


def test_components_of_stars_and_chains(spark):
    """A hub of thousands of nodes, chains in both directions, and a hub that isn't the least node."""
    star = [(0, i) for i in range(1, 4000)] + [(10**6, 5000 + i) for i in range(2500)]
    chain = [(20_000 + i, 20_001 + i) for i in range(60)] + [(30_000 - i, 29_999 - i) for i in range(40)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(star + chain + [(7, 7)], "u long, v long")).collect()}
    want = dict.fromkeys(range(4000), 0) | dict.fromkeys([10**6, *range(5000, 7500)], 5000)
    want |= dict.fromkeys(range(20_000, 20_061), 20_000) | dict.fromkeys(range(29_960, 30_001), 29_960)
    assert got == want
