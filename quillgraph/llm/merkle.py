"""A Merkle manifest of a dataset: an external-memory store of tree nodes, built level by level, with a proof for every row.

Rows are hashed to leaves; the leaves of one tree (one value of a column) are in order of their id. They are sorted once over
all trees and written as sorted runs; a leaf's coordinate (tree, position) is its place in its run and the sizes of earlier
runs' parts of the same tree. Levels are Parquet tables in the shared folder, a row per run of 16 nodes and in coordinate
order; each level is made by one pass over the one before, whose rows go to the range of coordinates of their parent. The roots
of the trees are the leaves of one more tree. Proofs go the other way: from the top down, each level is merged with the one
above by coordinate, so a row gets the siblings of all its ancestors. No tree, however large, is in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from quillgraph.llm.common import prepare, quoted, remove, shared_dir

#: Consecutive nodes that have one parent.
WIDTH = 16
#: What a leaf is the hash of, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    """The hash of a row's values."""
    return digest(*[field(v) for v in values])


def leaves(df: DataFrame, columns: tuple[str, ...] = COLUMNS, tree: str = "source", key: str = "doc_id", changed: Column | None = None, text: str = "text") -> DataFrame:
    """tree, key, leaf and `claim`: the leaf of the row as somebody else may have it.

    claim is made as leaf is, but with the value of `changed` as `text` (as it is, if None). The tree is a text that orders as the
    column does with nulls first: empty for null, else the value after a sign.
    """
    own = leaf([quoted(c) for c in columns])
    claim = own if changed is None else leaf([changed if c == text else quoted(c) for c in columns])
    name = F.when(quoted(tree).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), quoted(tree).cast("string")))
    return df.select(name.alias("tree"), quoted(key).alias("key"), own.alias("leaf"), claim.alias("claim"))


class Store:
    """Tables of one manifest below a folder, one for each level; what was written is read and never computed again."""

    def __init__(self, spark, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")


def sorted_runs(nodes: DataFrame, store: Store, name: str) -> DataFrame:
    """nodes (tree, key, leaf, claim) with `pos`, the place in the tree by key (nulls first) and then leaf.

    One sort over all trees. The order's partitions are the runs; a row is counted within its run and tree as the sorted
    stream goes by. Only a run's first tree can go on from earlier runs, so the offsets to add are one row a run at most,
    a number that the session sets (spark.sql.shuffle.partitions) and that is broadcast.
    """
    out = StructType([*nodes.schema.fields, *StructType.fromDDL("run int, nth long").fields])
    schema = to_arrow_schema(out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            nth = []
            for tree in batch.column(0).to_pylist():
                last, n = (tree, n + 1) if tree == last else (tree, 0)
                nth.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([run] * batch.num_rows, pa.int32()), pa.array(nth, pa.int64())], schema=schema)

    runs = store.keep(nodes.orderBy(F.asc_nulls_first("tree"), F.asc_nulls_first("key"), "leaf").mapInArrow(count, out), name)
    parts = runs.groupBy("run", "tree").agg((F.max("nth") + 1).alias("n"))
    before = F.sum("n").over(W.partitionBy("tree").orderBy("run")) - F.col("n")
    offsets = parts.select("run", "tree", before.alias("before")).filter("before > 0")
    return runs.join(F.broadcast(offsets), ["run", "tree"], "left").select(*nodes.columns, (F.col("nth") + F.coalesce("before", F.lit(0))).alias("pos"))


def grouped(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """Rows (tree, run, kids): runs of WIDTH consecutive nodes of (tree, pos, payload), in coordinate order.

    The rows of a run go to one range of coordinates, so grouping needs no further exchange, and ranges split large trees. A kid
    is a struct whose field `node` is its digest.
    """
    spread = nodes.withColumn("run", F.expr(f"pos div {WIDTH}")).repartitionByRange("tree", "run")
    runs = spread.groupBy("tree", "run").agg(F.array_sort(F.collect_list(F.struct("pos", *payload))).alias("kids"))
    return runs.sortWithinPartitions("tree", "run")


def lone(run: str = "run", kids: str = "kids") -> Column:
    """Whether a run is all of its level: a tree's root is the only node of the last one."""
    return (F.col(run) == 0) & (F.size(kids) == 1)


def levels(nodes: DataFrame, payload: list[str], store: Store, name: str) -> list[DataFrame]:
    """Tables of runs from the leaves up, until every tree has a level with its root alone.

    Level k + 1 has the hashes of the runs of level k but for roots. The number of levels is log16 of the largest tree's size.
    """
    out = [store.keep(grouped(nodes, payload), f"{name}/level=0")]
    while True:
        inner = out[-1].filter(~lone())
        if inner.isEmpty():
            return out
        parents = inner.select("tree", F.col("run").alias("pos"), digest(F.array_join(F.col("kids.node"), "")).alias("node"))
        out.append(store.keep(grouped(parents, ["node"]), f"{name}/level={len(out)}"))


def siblings(kids: str, at: Column) -> Column:
    """The digests left and right of the kid at a place (from 0) of its run."""
    node, n = F.col(f"{kids}.node"), F.size(kids)
    return F.struct(F.array_join(F.slice(node, F.lit(1), at), "").alias("left"), F.array_join(F.slice(node, at + 2, n), "").alias("right"))


def proofs(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """The runs of level 0 (tree, run, kids) with `path`, the siblings of all ancestors, lowest first, and `above`'s columns.

    above has a row for each tree: its path from the tree's root on, and what else all its rows take. From the top down, a
    level's runs are merged with those of the level above by coordinate (tree, run of the parent). At most WIDTH rows meet in
    a coordinate.
    """
    extra = [c for c in above.columns if c not in ("tree", "path")]
    known = None
    for runs in reversed(tables):
        here = runs.filter(lone()).join(above, "tree")
        if known is not None:
            at = (F.col("run") % WIDTH).cast("int")
            up = known.select("tree", F.col("run").alias("up"), F.col("kids").alias("kin"), "path", *extra)
            below = runs.filter(~lone()).withColumn("up", F.expr(f"run div {WIDTH}")).join(up.hint("merge"), ["tree", "up"])
            # a root alone in its level has no siblings and is no step
            step = F.when(lone("up", "kin"), F.array().cast(PATH)).otherwise(F.array(siblings("kin", at)))
            here = here.unionByName(below.withColumn("path", F.concat(step, "path")).drop("up", "kin"))
        known = here.select("tree", "run", "kids", "path", *extra)
    return known


def expanded(runs: DataFrame) -> DataFrame:
    """A row for each node of level 0: `kid`, and the path with its own siblings first."""
    one = runs.select("*", F.posexplode("kids").alias("at", "kid"))
    own = F.when(lone(), F.array().cast(PATH)).otherwise(F.array(siblings("kids", F.col("at"))))
    return one.withColumn("path", F.concat(own, "path")).drop("kids", "at", "run")


def fold(node: Column, path: Column) -> Column:
    """The root that a node and the siblings of its ancestors make."""
    return F.aggregate(path, node, lambda acc, s: digest(s["left"], acc, s["right"]))


def prove(nodes: DataFrame, folder: str | None = None) -> DataFrame:
    """Per row of nodes (tree, key, leaf, claim): tree, key, leaf, subroot, root, proof, claim and folded.

    proof is an array of (left, right) concatenated digests of the run's others, level by level from the leaf to the root; folded
    is the root that claim and proof make. A tree of one row has its leaf as subroot. With a folder (of the shared storage) the
    node store stays there: `runs`, `trees/level=k`, `roots/level=k`; without one it lies in the checkpoint folder for as long as
    the application's checkpoints. Rows that repeat are leaves of their own; rows of one key are in order of their leaves; an
    empty input gives an empty result.
    """
    spark = nodes.sparkSession
    prepare(spark)
    store = Store(spark, folder or f"{shared_dir(spark)}/merkle-{uuid.uuid4().hex}")
    hashed = store.keep(nodes, "leaves")  # the sort reads its input twice
    placed = sorted_runs(hashed, store, "runs").withColumnRenamed("leaf", "node")
    tables = levels(placed, ["node", "key", "claim"], store, "trees")
    roots = None
    for runs in tables:
        found = runs.filter(lone()).select("tree", F.col("kids")[0]["node"].alias("leaf"))
        roots = found if roots is None else roots.unionByName(found)
    tops = roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "leaf", F.lit(None).cast("string").alias("claim"))
    tops = sorted_runs(tops, store, "subroots").withColumnRenamed("leaf", "node")
    over = levels(tops, ["node", "key"], store, "roots")
    no_path = F.array().cast(PATH)
    last = over[-1].filter(lone())
    top = last.select("tree", F.col("kids")[0]["node"].alias("root"), no_path.alias("path"))
    above = expanded(proofs(over, top)).select(F.col("kid.key").alias("tree"), F.col("kid.node").alias("subroot"), "root", "path")
    rows = expanded(proofs(tables, above))
    if folder is None:
        for name in ("leaves", "runs"):  # the levels have all of it
            remove(spark, f"{store.folder}/{name}")
    return rows.select(
        "tree", F.col("kid.key").alias("key"), F.col("kid.node").alias("leaf"), "subroot", "root", F.col("path").alias("proof"),
        F.col("kid.claim").alias("claim"), fold(F.col("kid.claim"), F.col("path")).alias("folded"),
    )


def lowered(text: Column) -> Column:
    """A-Z in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def manifest(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, after tampering with every fifth.

    Where 5 divides the CRC-32 of the id as text (null ids: never) the text is tampered with: A-Z in lower case. folded_root
    is what the tampered leaf and the siblings of the original tree make; verified: whether it is the root.
    """
    key = quoted("doc_id")
    hit = F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))
    nodes = leaves(df, changed=F.when(hit, lowered(quoted("text"))).otherwise(quoted("text")))
    joined = F.aggregate("proof", F.lit(""), lambda acc, s: F.concat(acc, s["left"], s["right"]))
    return prove(nodes, folder).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(joined.cast("binary"), 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


#: The same in SQL: levels and folds by recursion. CRC-32 has no function there, so its table of bytes is made first.
SQL = """
WITH RECURSIVE bits(k, v) AS (
  SELECT 0, list_transform(range(256), lambda x: x::BIGINT)
  UNION ALL SELECT k + 1, list_transform(v, lambda x: xor(x >> 1, 3988292384 * (x & 1))) FROM bits WHERE k < 8),
raw AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda acc, b: xor(acc >> 8, v[(xor(acc, b) & 255) + 1])), 4294967295) % 5 = 0 AS hit
  FROM documents, bits WHERE k = 8),
leaves AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS claim
  FROM raw),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos FROM leaves),
nodes(tree, level, pos, node) AS (
  SELECT tree, 0, pos, leaf FROM placed
  UNION ALL
  SELECT tree, level, up, sha256(string_agg(node, '' ORDER BY pos)) FROM (
    SELECT tree, level + 1 AS level, pos // 16 AS up, pos, node, count(*) OVER (PARTITION BY tree) AS n FROM nodes) AS below
  WHERE n > 1 GROUP BY tree, level, up),
sizes AS (SELECT tree, level, count(*) AS n FROM nodes GROUP BY tree, level),
subroots AS (
  SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos
  FROM nodes JOIN sizes USING (tree, level) WHERE n = 1),
tops(level, pos, node) AS (
  SELECT 0, pos, subroot FROM subroots
  UNION ALL
  SELECT level, up, sha256(string_agg(node, '' ORDER BY pos)) FROM (
    SELECT level + 1 AS level, pos // 16 AS up, pos, node, count(*) OVER () AS n FROM tops) AS below
  WHERE n > 1 GROUP BY level, up),
top_sizes AS (SELECT level, count(*) AS n FROM tops GROUP BY level),
steps AS (
  SELECT p.doc_id, p.leaf, p.tree, s.level, p.pos // (16 ** s.level)::BIGINT AS own FROM placed AS p JOIN sizes AS s USING (tree) WHERE s.n > 1),
top_steps AS (
  SELECT r.tree, t.level, r.pos // (16 ** t.level)::BIGINT AS own FROM subroots AS r, top_sizes AS t WHERE t.n > 1),
lower_path AS (
  SELECT s.doc_id, s.leaf, s.level, coalesce(string_agg(n.node, '' ORDER BY n.pos) FILTER (n.pos < own), '') AS l,
    coalesce(string_agg(n.node, '' ORDER BY n.pos) FILTER (n.pos > own), '') AS r
  FROM steps AS s JOIN nodes AS n ON n.tree = s.tree AND n.level = s.level AND n.pos // 16 = own // 16 GROUP BY s.doc_id, s.leaf, s.level),
upper_path AS (
  SELECT s.tree, s.level, coalesce(string_agg(n.node, '' ORDER BY n.pos) FILTER (n.pos < own), '') AS l,
    coalesce(string_agg(n.node, '' ORDER BY n.pos) FILTER (n.pos > own), '') AS r
  FROM top_steps AS s JOIN tops AS n ON n.level = s.level AND n.pos // 16 = own // 16 GROUP BY s.tree, s.level),
lower_list AS (SELECT doc_id, leaf, list(l || '|' || r ORDER BY level) AS steps FROM lower_path GROUP BY doc_id, leaf),
upper_list AS (SELECT tree, list(l || '|' || r ORDER BY level) AS steps FROM upper_path GROUP BY tree),
paths AS (
  SELECT p.doc_id, p.leaf, p.claim, subroot, (SELECT max(node) FROM tops JOIN top_sizes USING (level) WHERE n = 1) AS root,
    list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) AS steps
  FROM placed AS p JOIN subroots USING (tree) LEFT JOIN lower_list AS a ON a.doc_id IS NOT DISTINCT FROM p.doc_id AND a.leaf = p.leaf
  LEFT JOIN upper_list AS b ON b.tree = p.tree),
folded AS (
  SELECT *, list_reduce(list_prepend(claim, steps), lambda acc, s: sha256(split_part(s, '|', 1) || acc || split_part(s, '|', 2))) AS folded_root FROM paths)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded
"""
