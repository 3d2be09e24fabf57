"""Merkle manifest of a table: one hash tree a source, one over the sources' subroots, and a proof for every row.

The trees are built by DataFrame levels. Rows are numbered within their source, the number divided by the fanout names a
node's parent, children are grouped and sorted into an array, and the array is hashed into the parent, until one node a
source is left, its subroot; the subroots, numbered by source, are the leaves of the upper tree. Then the levels are joined
from the root down, each join adding a run's siblings to its children's paths, so a node's path is built once for all the
leaves below it and the rows of a level are a third of those of the level under it.

No step depends on the size of a source: numbers come from sorted ranges (common.numbered), nodes are grouped by source and
parent, and a source's size reaches its rows by common.hot_join. Digests are kept as 32 bytes and hashed as hex text.

Edge cases: a null field is hashed as `-`, an empty text as `0:`; null ids come first in their source, equal ids are ordered by
leaf, and rows that are equal altogether take their places in any order, which gives the same rows; a source of one row has
its leaf as subroot, and a single source's subroot is the root; a row without siblings has the hash of nothing as
proof; a row with a null id isn't tampered with; an empty table gives an empty result. Only the columns named are read, so
further ones, whatever their names, don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

FANOUT = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(value: Column) -> Column:
    """`-` for null, otherwise the number of UTF-8 bytes, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """A row's digest."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(kids: Column) -> Column:
    """The digests of children one after the other."""
    return F.unhex(F.array_join(F.transform(kids, lambda x: F.hex(x["digest"])), ""))


def _parent(kids: Column) -> Column:
    return F.unhex(F.sha2(_hex(_joined(kids)), 256))


def _climb(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Runs of children by level, and the nodes that are left alone in their tree by level.

    nodes: tree, i (from 0), n (nodes of its tree), digest, load (what a leaf carries).
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    runs, tops = [], []
    while True:
        tops.append(nodes.where("n = 1").select("tree", "digest", "load"))
        if most <= 1:
            return runs, tops
        grouped = nodes.where("n > 1").groupBy("tree", F.floor(F.col("i") / fanout).alias("i"), F.ceil(F.col("n") / fanout).alias("n"))
        run = C.materialise(grouped.agg(F.array_sort(F.collect_list(F.struct("i", "digest", "load"))).alias("kids")), f"merkle-{len(runs)}")
        runs.append(run)
        nodes = run.select("tree", "i", "n", _parent(F.col("kids")).alias("digest"), F.get("kids", F.lit(0))["load"].alias("load"))
        most = -(-most // fanout)


def _descend(runs: list[DataFrame], tops: list[DataFrame]) -> DataFrame:
    """tree, subroot, digest, load, path of every leaf; tops: tree, subroot, digest, load and path above it, by level.

    A path is an array from the leaf up; an entry has the digests left and right of a node in its run.
    """
    columns = ["tree", "i", "subroot", "digest", "load", "path"]
    above = tops[-1].withColumn("i", F.lit(0).cast("long")).select(*columns)
    for run, top in zip(reversed(runs), reversed(tops[:-1])):
        met = run.select("tree", "i", "kids").join(above.select("tree", "i", "subroot", "path"), ["tree", "i"])
        kids = met.select("tree", "subroot", "path", "kids", F.posexplode("kids").alias("at", "kid"))
        step = F.struct(_joined(F.slice("kids", F.lit(1), F.col("at"))).alias("left"), _joined(F.slice("kids", F.col("at") + 2, F.size("kids"))).alias("right"))
        kids = kids.select("tree", F.col("kid")["i"].alias("i"), "subroot", F.col("kid")["digest"].alias("digest"), F.col("kid")["load"].alias("load"), F.concat(F.array(step), "path").alias("path"))
        above = kids.unionByName(top.withColumn("i", F.lit(0).cast("long")).select(*columns))
    return above


def manifest(leaves: DataFrame, tree: str, order: str, digest: str, load: list[str], fanout: int = FANOUT) -> tuple[DataFrame, str | None]:
    """The columns `load`, `leaf`, `subroot` and `path` of every row, and the root in hex (None for no rows).

    tree: the column whose values have trees of their own (null is one); order: the column that orders a tree's leaves,
    then `digest`, which has the leaves.
    """
    tree_key = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("-"))  # null comes first, and is a value of its own
    rows = C.materialise(leaves.select(tree_key.alias("tree"), F.col(order).alias("by"), F.col(digest).alias("digest"), F.struct(*load).alias("load")), "merkle-leaves")
    placed = C.numbered(rows, [F.col("tree"), F.col("by").asc_nulls_first(), F.col("digest")], "place")
    trees = C.materialise(placed.groupBy("tree").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size")), "merkle-trees")
    total = trees.agg(F.sum("size")).first()[0] or 0
    sized = C.hot_join(placed, trees.withColumn("n", F.col("size")), "tree", "size", total)
    nodes = sized.select("tree", (F.col("place") - F.col("first")).alias("i"), "n", "digest", "load")
    runs, tops = _climb(nodes, fanout)

    subroots = None
    for level, top in enumerate(tops):
        one = top.select(F.col("tree").alias("of"), "digest", F.lit(level).alias("level"), "load")
        subroots = one if subroots is None else subroots.unionByName(one)
    subroots = C.materialise(subroots, "merkle-subroots")
    n = subroots.count()
    upper = C.numbered(subroots, [F.col("of")], "place").select(
        F.lit("").alias("tree"), (F.col("place") - 1).alias("i"), F.lit(n).cast("long").alias("n"), "digest", F.struct("of", "level", "load").alias("load")
    )
    upper_runs, upper_tops = _climb(upper, fanout)
    root = upper_tops[-1].select(_hex(F.col("digest"))).first()
    empty_path = F.array().cast("array<struct<left:binary,right:binary>>")
    start = [t.select("tree", F.col("digest").alias("subroot"), "digest", "load", empty_path.alias("path")) for t in upper_tops]
    below = C.materialise(_descend(upper_runs, start), "merkle-upper")
    tops = [
        below.where(F.col("load.level") == level).select(F.col("load.of").alias("tree"), F.col("digest").alias("subroot"), "digest", F.col("load.load").alias("load"), "path")
        for level in range(len(tops))
    ]
    found = _descend(runs, tops)
    return found.select("load.*", F.col("digest").alias("leaf"), "subroot", "path"), root and root[0]


def proof(path: Column) -> Column:
    """Hash of all siblings from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(_hex(x["left"]), _hex(x["right"]))), ""), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root in hex that a leaf's digest and its siblings give."""
    return F.aggregate(path, _hex(digest), lambda under, x: F.sha2(F.concat(_hex(x["left"]), under, _hex(x["right"])), 256))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    values = {c: F.col(c) for c in FIELDS}
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    changed = chosen & F.contains("text", F.lit("\n"))
    # null where the leaf stays as it is
    other = F.when(changed, leaf(list((values | {"text": F.translate("text", "\n", "")}).values())))
    leaves = docs.select("doc_id", "source", leaf(list(values.values())).alias("digest"), other.alias("tampered"))
    rows, root = manifest(leaves, "source", "doc_id", "digest", ["doc_id", "tampered"])
    rows = rows.select(
        "doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), F.lit(root).cast("string").alias("root"), proof(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    from helixframe.functions import duck

    def enc(value: str) -> str:
        return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"

    def h(text: str) -> str:
        return f"sha256({' || '.join(enc(text if c == 'text' else c) for c in FIELDS)})"

    crc = duck.crc32(duck.ascii_bytes("doc_id::VARCHAR"))
    return f"""
WITH RECURSIVE
d AS (SELECT doc_id, coalesce('=' || source, '-') AS s, {h("text")} AS leaf,
  CASE WHEN ({crc}) % 2 = 0 THEN {h("replace(text, chr(10), '')")} END AS changed FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM d),
up AS (SELECT 0 AS level, s, i, n, leaf AS x FROM l
  UNION ALL SELECT level + 1, s, i // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(x, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY level, s, i // {FANOUT}, n),
top AS (SELECT s, x, row_number() OVER (ORDER BY encode(s)) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
over AS (SELECT 0 AS level, i, n, x FROM top
  UNION ALL SELECT level + 1, i // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(x, '' ORDER BY i)) FROM over WHERE n > 1 GROUP BY level, i // {FANOUT}, n),
runs AS (SELECT level, s, i // {FANOUT} AS p, list(x ORDER BY i) AS xs FROM up WHERE n > 1 GROUP BY ALL),
over_runs AS (SELECT level, i // {FANOUT} AS p, list(x ORDER BY i) AS xs FROM over WHERE n > 1 GROUP BY ALL),
walk AS (SELECT row_number() OVER () AS r, 0 AS level, s, i, coalesce(changed, leaf) AS x, '' AS proof FROM l
  UNION ALL SELECT r, level + 1, s, p, sha256(array_to_string(xs[:i % {FANOUT}], '') || x || array_to_string(xs[i % {FANOUT} + 2:], '')),
    proof || array_to_string(xs[:i % {FANOUT}], '') || array_to_string(xs[i % {FANOUT} + 2:], '') FROM walk JOIN runs USING (level, s) WHERE p = i // {FANOUT}),
mid AS (SELECT r, s, x, proof FROM walk QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1),
walk2 AS (SELECT r, 0 AS level, top.i AS i, mid.x AS x, proof FROM mid JOIN top USING (s)
  UNION ALL SELECT r, level + 1, p, sha256(array_to_string(xs[:i % {FANOUT}], '') || x || array_to_string(xs[i % {FANOUT} + 2:], '')),
    proof || array_to_string(xs[:i % {FANOUT}], '') || array_to_string(xs[i % {FANOUT} + 2:], '') FROM walk2 JOIN over_runs USING (level) WHERE p = i // {FANOUT}),
done AS (SELECT r, x, proof FROM walk2 QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1),
numbered AS (SELECT row_number() OVER () AS r, * FROM l)
SELECT doc_id, leaf, top.x AS subroot, o.x AS root, sha256(proof) AS proof_sha256, done.x AS folded_root, done.x = o.x AS verified
FROM numbered JOIN done USING (r) JOIN top USING (s) CROSS JOIN (SELECT x FROM over WHERE n = 1) AS o
"""


ORACLE_SQL = _sql()
