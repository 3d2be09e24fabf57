import numpy as np
import pytest

from helixframe.llm import mixing as M


def test_flight_keeps_both_totals_and_leaves_two():
    rng = np.random.default_rng(3)
    size = rng.integers(0, 500, 400).astype(float)
    p = rng.random(400)
    q = M.flight(p, size, rng)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum()) and (q * size).sum() == pytest.approx((p * size).sum())


def test_flight_is_unbiased():
    p, size = np.full(9, 1 / 3), np.arange(9.0)
    mean = np.mean([M.landing(M.flight(p, size, np.random.default_rng(k)), size) for k in range(600)], axis=0)
    assert abs(mean - 1 / 3).max() < 0.13


def test_targets_share_the_excess(spark):
    sizes = [("b", 10), ("b", 0), ("a", 1000), (None, 400), ("c", 5), ("d", 0)]
    rows = M.targets(spark.createDataFrame([(s, n) for s, n in sizes], "source string, size long")).orderBy("rank").collect()
    assert [r.source for r in rows] == ["a", "b", "c", "d", None]
    own = {r.source: r.target for r in rows}
    weights, caps = {"a": 3, "b": 1, "c": 2, "d": 3, None: 1}, {"a": 2000, "b": 20, "c": 10, "d": 0, None: 800}
    left, live, want = 1.5 * 1415, set(weights), {}
    while True:
        level = left / sum(weights[s] for s in live)
        over = [s for s in live if level * weights[s] > caps[s]]
        if not over:
            break
        for s in over:
            want[s] = caps[s]
            left -= caps[s]
            live.discard(s)
    want |= {s: level * weights[s] for s in live}
    assert own == pytest.approx(want)


def test_query(spark, folder, empty_folder):
    got = M.query(spark, folder).collect()
    assert len(got) == 12 and all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, M.query(spark, folder).collect()), key=str)
    assert M.query(spark, empty_folder).count() == 0


def test_stage(spark, docs, empty):
    got = M.stage(spark, docs, "")
    assert got.columns == docs.columns
    taken = {}
    for r in M.mix(M.sized(docs)).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.copies
    rows = got.collect()
    assert {i: sum(r.doc_id == i for r in rows) for i in taken} == taken
    assert M.stage(spark, empty, "").count() == 0


def test_half_the_rows_share_a_null_doc_id(spark):
    rows = [(None if i % 2 else i, "w " * (1 + i % 7), "en", f"s{i % 3}") for i in range(12_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mixed = M.mix(M.sized(df)).withColumn("t", M.F.col("copies") * M.F.col("size"))
    by = mixed.groupBy("source_size").agg(M.F.sum("t").alias("taken"), M.F.first("target").alias("target"), M.F.count(M.F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in by) == len(rows) and all(abs(r.taken - r.target) < 30 for r in by)
    got = M.stage(spark, df, "").groupBy("source").agg(M.F.sum(M.F.size(M.F.split(M.F.trim("text"), " "))).alias("words")).collect()
    want = {}
    for r in M.targets(M.sized(df)).collect():
        want[r.source] = r.target
    assert all(abs(r.words - want[r.source]) < 0.02 * want[r.source] for r in got)


def test_taken_against_target(spark):
    """Each source's words within a document's size of its target, whatever the sizes."""
    rows = [(i, "w " * (1 + i * 37 % 400), "en", f"s{min(i % 7, 3)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = M.mix(M.sized(df)).groupBy("source_size").agg(M.F.sum(M.F.col("copies") * M.F.col("size")).alias("taken"), M.F.first("target").alias("target"), M.F.max(M.F.col("copies")).alias("most")).collect()
    assert len(got) == 4 and all(abs(r.taken - r.target) <= 400 and r.most <= 2 for r in got)


def test_stage_deals_copies_of_many_equal_rows_exactly(spark, tmp_path):
    """One rule for groups of equal rows of any size: the copies are those that the mix takes, and a rerun's."""
    rows = [(1, "w " * 9, "en", "hot", 1, 1)] * 1500 + [(i, "w " * (i % 9), "de", "cold", 1, 1) for i in range(700)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _row int, __times int").repartition(6).write.parquet(f"file://{tmp_path}/d")
    df = spark.read.parquet(f"file://{tmp_path}/d")
    once, again = (M.stage(spark, df, "").groupBy("doc_id", "text", "source").count().collect() for _ in range(2))
    assert sorted(map(tuple, once)) == sorted(map(tuple, again))
    want = M.mix(M.sized(df).where("doc_id = 1 and source = 'hot'").unionByName(M.sized(df).where("not (doc_id = 1 and source = 'hot')")))
    target = {r.source: r.target for r in M.targets(M.sized(df)).collect()}["hot"]
    assert abs(sum(r["count"] for r in once if r.source == "hot") * 9 - target) <= 9 and want.count() == len(rows)
