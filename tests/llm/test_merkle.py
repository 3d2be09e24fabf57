"""Merkle manifest against a recursive version, and its properties."""

import hashlib
import zlib

from helixframe.llm import merkle_manifest as M


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(digests):
    """Root, and every leaf's runs from below: (position, run)."""
    walks, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for leaf_at, i in enumerate(at):
            walks[leaf_at].append((i % 3, runs[i // 3]))
        at = [i // 3 for i in at]
        level = [sha(*run) for run in runs]
    return level[0], walks


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        ordered = sorted(by[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees[s] = (ordered, *climb([leaf(r, r.text) for r in ordered]))
    root, over = climb([trees[s][1] for s in sources])
    out = []
    for s, above in zip(sources, over):
        ordered, subroot, walks = trees[s]
        for r, walk in zip(ordered, walks):
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and r.text is not None
            x = leaf(r, r.text.replace("\n", "") if tampered else r.text)
            siblings = ""
            for p, run in walk + above:
                siblings += "".join(run[:p] + run[p + 1 :])
                x = sha(*run[:p], x, *run[p + 1 :])
            out.append((r.doc_id, leaf(r, r.text), subroot, root, sha(siblings), x, x == root))
    return sorted(map(repr, out))


def rows(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def test_equals_brute_force(spark, folder, empty_folder, docs):
    assert rows(M.query(spark, folder)) == brute(docs.collect())
    assert M.query(spark, empty_folder).count() == 0


def test_sizes_around_powers_and_a_hot_source(spark, tmp_path):
    table = []
    for n in (1, 2, 3, 4, 9, 10, 27, 28, 300):
        table += [(i - 2 if i % 11 else None, f"text {i}\n" * (i % 4), None if i % 5 == 0 else "en", f"source {n}" if n != 9 else None, i) for i in range(n)]
    table += [(7, "equal\nrow", "de", "Ä", 9)] * 5 + [(7, "a", "de", "=", 9), (7, "b", "de", "-", 9)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = M.query(spark, f"file://{tmp_path}")
    assert rows(got) == brute(df.collect())
    assert {r.verified for r in got.where("folded_root = root").collect()} == {True} and got.where("not verified").count() > 0


def test_one_row_is_its_own_root(spark, tmp_path):
    spark.createDataFrame([(4, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    (r,) = M.query(spark, f"file://{tmp_path}").collect()
    assert r.leaf == r.subroot == r.root == r.folded_root == sha("1:4", "-", "-", "-", "-") and r.proof_sha256 == sha("") and r.verified


def test_any_change_shows(spark):
    """A manifest of other columns, a load of one's own, and another fanout."""
    df = spark.createDataFrame([(i, i % 3, f"v{i}", "clash") for i in range(40)], "id long, part int, value string, tree string")
    leaves = df.withColumn("d", M.leaf([M.F.col("id"), M.F.col("value")]))
    found, root = M.manifest(leaves, "part", "id", "d", ["id", "tree", "value"], fanout=4)
    kept = found.select(M.folded(M.leaf([M.F.col("id"), M.F.col("value")]), M.F.col("path")).alias("x"), M.folded(M.leaf([M.F.col("id"), M.F.lit("v")]), M.F.col("path")).alias("y")).collect()
    assert len(kept) == 40 and {r.x for r in kept} == {root} and root not in {r.y for r in kept}
