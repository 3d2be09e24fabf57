"""SimHash near-duplicates: fingerprints within a Hamming radius, found with BK-trees, joined to components.

Fingerprints within radius r agree on one of r + 1 blocks of their bits, so every block value is a shard, and a
shard's fingerprints form a BK-tree: children hang at their integer Hamming distance to the parent, and a search
follows only the edges within the radius. A shard of over MAX_SHARD fingerprints is split by the same argument over the
bits it doesn't yet agree on, until each is small (after six rounds some eight bits are free), so no link is lost and
no task holds a large group. A tree goes to the task that needs it through the shuffle; broadcasting all trees would
bring all fingerprints to the driver.

Equal fingerprints are one before any search. A shard emits a spanning forest of its links instead of all pairs, and
components are found by alternating large-star and small-star rounds, each written to the shared folder.
near_copies(), the pipeline's stage, groups texts by shared bands of min-hashes and by fingerprints within the radius, and
settles the pairs within a group on the whole sets of shingles.
Edge cases: null and empty texts have the fingerprint zero; a text of fewer words than a shingle is one shingle; rows
with a null doc_id are rows of their component, whose id is its least doc_id (null if all are); repeated rows are kept;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SHINGLE, RADIUS = 3, 2
MAX_SHARD, MAX_SPLITS = 512, 6
#: near_copies(): copies have a Jaccard similarity of SIMILARITY or more over their sets of shingles of COPY_SHINGLE words;
#: candidates share one of BANDS bands of BAND_ROWS min-hashes (at 0.8 all but 0.0004 do), or are within RADIUS.
COPY_SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 20, 5
CHUNK, LEADERS = 1 << 20, 8
SEED = 4
#: Parts the two hashes of an id and a text.
SECOND = 2


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included; fewer words are one shingle."""
    if not words:
        return np.zeros(0, dtype="<u8")
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(g, 42) for g in grams], dtype="<u8")


def word_list(text: str | None) -> list[bytes]:
    """bytes.lower() and bytes.split() know ASCII letters and white space only, as the contract does."""
    return (text or "").encode().lower().split()


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' hashes; zero without words."""
    hashes = shingle_hashes(word_list(text), shingle)
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, shingle) for t in texts], dtype="<u8").view("<i8"))

    return of(text)


class BKTree:
    """Fingerprints by distance to their parent."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        value, children = self.root
        while (d := (x ^ value).bit_count()) in children:
            value, children = children[d]
        if d:
            children[d] = (x, {})

    def within(self, x: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (x ^ value).bit_count()
            if d <= radius:
                found.append(value)
            if children:
                todo += [c for at, c in children.items() if d - radius <= at <= d + radius]
        return found


def _links(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask = (1 << 64) - 1
        for pdf in batches:
            u, v = [], []
            for members in pdf["members"]:
                tree, parent = BKTree(), {}

                def find(x: int) -> int:
                    while parent[x] != x:
                        parent[x] = x = parent[parent[x]]
                    return x

                for signed in members.tolist():
                    x = signed & mask
                    parent[x] = x
                    for y in tree.within(x, radius):
                        a, b = find(x), find(y)
                        if a != b:
                            parent[b] = a
                            u.append(x)
                            v.append(y)
                    tree.add(x)
            yield pd.DataFrame({"u": np.array(u, dtype="<u8").view("<i8"), "v": np.array(v, dtype="<u8").view("<i8")})

    return run


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _parts(mask: int, parts: int) -> list[int]:
    """`mask` with each of `parts` runs of the bits it lacks added."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(len(free) * i / parts) for i in range(parts + 1)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that span the components of `fingerprints` (column fp, distinct) within the radius."""
    spark, found = fingerprints.sparkSession, []
    masks, todo = [0], fingerprints.select("fp", F.lit(0).cast("long").alias("mask"))
    for split in range(MAX_SPLITS):
        table = [(_signed(m), _signed(child)) for m in masks for child in _parts(m, radius + 1)]
        masks = sorted({child & ((1 << 64) - 1) for _, child in table})
        finer = F.broadcast(spark.createDataFrame(table, "mask long, finer long"))  # 3 ** splits rows
        keyed = todo.join(finer, "mask").select("fp", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("value"))
        counts = keyed.groupBy("mask", "value").count().where("count > 1")
        shared = C.materialise(keyed.join(counts, ["mask", "value"]), "simhash-shards")
        last = split == MAX_SPLITS - 1
        small = shared if last else shared.where(F.col("count") <= MAX_SHARD)
        shards = small.groupBy("mask", "value").agg(F.sort_array(F.collect_list("fp")).alias("members")).select("members")
        found.append(C.materialise(shards.mapInPandas(_links(radius), "u long, v long").distinct(), "simhash-links"))
        todo = shared.where(F.col("count") > MAX_SHARD).select("fp", "mask")
        if last or todo.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's least node) for every node of `edges` (u, v).

    A large component's root is the key of as many rows as the component has nodes; common.hot_join spreads them.
    """
    state, edges = None, edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = C.materialise(edges, "component-links")
    total = 2 * edges.count()
    n = F.count(F.lit(1)).alias("n")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), n)
        large = C.hot_join(both, least, "u", "n", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = C.materialise(large, "components-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), n)
        joined = C.hot_join(large, least, "u", "n", total)
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = C.materialise(small.where("u != v").distinct(), "components")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first())
        if now == state:
            break
        state, total = now, 2 * now[0]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(word_list(text), COPY_SHINGLE))


def _sketch(text: str | None) -> bytes:
    """The hashes of all distinct shingles, sorted."""
    return _shingle_set(text).tobytes()


def _likeness(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def sketch_likeness(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two texts' shingles."""
    return _likeness(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"))


_RNG = np.random.default_rng(SEED)
_FACTORS, _TERMS = (_RNG.integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(odd) for odd in (1, 0))


def bands(hashes: np.ndarray) -> list[int]:
    """For each band a hash of BAND_ROWS min-hashes; two sets agree in a band with their similarity to the power BAND_ROWS."""
    if not len(hashes):
        return []
    least = np.full(BANDS * BAND_ROWS, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[at : at + 4096, None] * _FACTORS + _TERMS).min(axis=0), out=least)
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), j)) for j, row in enumerate(least.reshape(BANDS, BAND_ROWS))]


def alike_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (places in `sets`) that span the groups in which sets have a Jaccard similarity of SIMILARITY or more.

    Every pair is settled on the whole sets: as alike, as already linked through others, or because the rarest
    elements of the one are not among those of the other, as they are where the similarity is reached.
    """
    size, label, found = np.array([len(x) for x in sets]), np.arange(len(sets)), []

    def linked(i: int, j: int) -> bool:
        small, large = sorted((size[i], size[j]))
        if small < SIMILARITY * large - 1e-9 or _likeness(sets[i], sets[j]) < SIMILARITY - 1e-9:
            return False
        found.append((i, j))
        label[label == label[j]] = label[i]
        return True

    if len(sets) <= 2 * LEADERS:
        for i in range(len(sets)):
            for j in range(i):
                if label[i] != label[j]:
                    linked(j, i)
        return found
    leaders: list[int] = []
    for i in range(len(sets)):  # near copies of a few texts need no search
        if not any(linked(k, i) for k in leaders[:LEADERS]):
            leaders.append(i)
    if len(leaders) == 1:
        return found
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.argsort(np.argsort(count, kind="stable"))[place]
    cuts = np.cumsum([0, *size])
    rarest = [np.sort(rank[a:z])[: z - a - math.ceil(SIMILARITY * (z - a) - 1e-9) + 1] for a, z in zip(cuts, cuts[1:])]
    owner = np.repeat(np.arange(len(sets)), [len(r) for r in rarest])
    listed = np.concatenate(rarest)
    order = np.argsort(listed, kind="stable")
    listed, owner = listed[order], owner[order]
    largest = np.bincount(label).argmax()
    for i in np.flatnonzero(label != largest).tolist():  # of two sets in different groups one is not in the largest
        runs = zip(np.searchsorted(listed, rarest[i]), np.searchsorted(listed, rarest[i], side="right"))
        others = np.unique(np.concatenate([owner[:0], *[owner[a:z] for a, z in runs]]))
        for j in others[label[others] != label[i]].tolist():
            if label[j] != label[i]:
                linked(i, j)
    return found


def _alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between the keys of each row's members, which are a key and the set that it stands for."""
    for pdf in batches:
        u, v = [], []
        for members in pdf["members"]:
            parts = sorted({int(x[0]): x[1:] for x in (np.frombuffer(m, "<u8") for m in members)}.items())
            for i, j in alike_links([x for _, x in parts]):
                u.append(parts[i][0])
                v.append(parts[j][0])
        yield pd.DataFrame({"u": np.array(u, dtype="<u8").view("<i8"), "v": np.array(v, dtype="<u8").view("<i8")})


def clusters(distinct: DataFrame) -> DataFrame:
    """node, root: groups of keys (distinct: key, fp, bands) that share a band or have fingerprints within RADIUS, directly or through others.

    A band's agreement depends on the two texts only, so no candidate is lost as the input grows.
    """
    keyed = distinct.select("key", F.posexplode("bands").alias("j", "value")).select("key", F.xxhash64("j", "value").alias("band"))
    least = C.materialise(keyed.groupBy("band").agg(F.min("key").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copy-bands")
    # a band that very many texts share is joined by broadcast
    banded = C.hot_join(keyed, least, "band", "n", distinct.count() * BANDS).select(F.col("key").alias("u"), "v")
    reps = C.materialise(distinct.groupBy("fp").agg(F.min("key").alias("rep")), "copy-fingerprints")
    same = distinct.join(reps, "fp").select(F.col("key").alias("u"), F.col("rep").alias("v"))
    rep = lambda end: reps.select(F.col("fp").alias(end), F.col("rep").alias(f"rep_{end}"))
    near = links(reps.select("fp")).join(rep("u"), "u").join(rep("v"), "v").select(F.col("rep_u").alias("u"), F.col("rep_v").alias("v"))
    edges = banded.unionByName(same).unionByName(near).where("u != v").distinct()
    return components(C.materialise(edges, "copy-candidates"))


def near_copies(docs: DataFrame, carry: bool = False) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, fp (a number for its set of shingles), component_id, where links are similarities of SIMILARITY or more.

    With `carry` also at and also, two hashes of its doc_id and text.
    """
    C.small_batches(docs.sparkSession)

    @F.pandas_udf("fp long, key long, size long, bands array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [_shingle_set(t) for t in texts]
        return pd.DataFrame(
            {
                "fp": np.array([simhash(t) for t in texts], dtype="<u8").view("<i8"),
                "key": np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], dtype="<u8").view("<i8"),
                "size": [len(x) for x in sets],
                "bands": [bands(x) for x in sets],
            }
        )

    @F.pandas_udf("binary")
    def member(keys: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([np.array([k], dtype="<i8").tobytes() + _sketch(t) for k, t in zip(keys, texts)])

    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("at"), F.xxhash64("text", F.lit(SECOND), "doc_id").alias("also"))
    rows = C.materialise(texts.select("doc_id", "at", "also", of(F.col("text")).alias("s")).select("doc_id", "at", "also", "s.*"), "copies")
    first = [F.min(c).alias(c) for c in ("at", "fp", "size", "bands")]
    distinct = C.materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), *first), "copies-distinct")
    grouped = C.materialise(distinct.join(clusters(distinct), F.col("key") == F.col("node")).select("key", "at", "size", "root"), "copy-clusters")
    # a group of over CHUNK hashes is parted, and every two parts meet in a task
    parts = grouped.groupBy("root").agg(F.ceil(F.sum("size") / CHUNK).cast("int").alias("parts"))
    sets = texts.select("at", "text").dropDuplicates(["at"]).join(grouped, "at").join(parts, "root").withColumn("own", F.pmod(F.xxhash64("key"), F.greatest("parts", F.lit(1))).cast("int"))
    sets = sets.select("root", "own", "parts", member("key", "text").alias("member"))
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(F.col("parts") - 1, F.lit(0)))))
    met = sets.groupBy("root", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).agg(F.collect_list("member").alias("members"))
    alike = C.materialise(met.select("members").mapInPandas(_alike, "u long, v long"), "copies-alike")
    carried = ["at", "also"] if carry else []
    return with_components(rows.select("doc_id", F.col("key").alias("fp"), *carried), distinct.select(F.col("key").alias("fp"), "n", "lo"), alike)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: of each group of near copies one document, that of the least doc_id.

    Where several texts of a group share that doc_id, the one of the least key stays; rows without a doc_id stay, once for each text.
    """
    first, second = C.fresh(docs.columns, "_first"), C.fresh(docs.columns, "_second")
    # two hashes of 64 bits name a row's id and text, so that no other row is taken for it
    named = docs.withColumn(first, F.xxhash64("doc_id", "text")).withColumn(second, F.xxhash64("text", F.lit(SECOND), "doc_id"))
    found = near_copies(docs, carry=True).where(F.col("doc_id") == F.col("component_id"))
    kept = found.groupBy("component_id").agg(F.min(F.struct("fp", "at", "also")).alias("least")).select(F.col("least.at").alias(first), F.col("least.also").alias(second))
    rows = named.where(F.col("doc_id").isNotNull()).join(kept, [first, second], "left_semi").unionByName(named.where(F.col("doc_id").isNull()), allowMissingColumns=True)
    # equal rows meet by partial aggregation, so none of them is a group for one task
    return rows.dropDuplicates([first, second]).select(*docs.columns)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, fp (signed 64 bits), component_id."""
    C.small_batches(docs.sparkSession)
    rows = C.materialise(docs.select("doc_id", fingerprint_column(F.col("text"), shingle).alias("fp")), "simhash")
    distinct = C.materialise(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo")), "simhash-distinct")
    return with_components(rows, distinct, links(distinct, radius))


def with_components(rows: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (doc_id, fp) with component_id; distinct: fp, rows n, least doc_id lo; edges: links (u, v) of fp."""
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    roots = components(edges)
    linked = C.materialise(distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "n", "lo", "root"), "simhash-linked")
    ids = linked.groupBy("root").agg(F.min("lo").alias("component_id"))
    joined = linked.join(ids, "root").select("fp", "n", "component_id")
    alone = distinct.join(linked.select("fp"), "fp", "left_anti").select("fp", "n", F.col("lo").alias("component_id"))
    return C.hot_join(rows, C.materialise(joined.unionByName(alone), "simhash-ids"), "fp", "n", total)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
