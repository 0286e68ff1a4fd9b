"""The manifest against a plain tree, its store, and proofs that only the right leaf passes."""

import random
import zlib
from hashlib import sha256
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import merkle

DDL = "doc_id long, source string, lang string, n_chars int, text string"
NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """(root, siblings left and right of each leaf, level by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            lo = p // 16 * 16
            paths[i].append(("".join(nodes[lo:p]), "".join(nodes[p + 1 : lo + 16])))
        nodes, at = [h(*nodes[lo : lo + 16]) for lo in range(0, len(nodes), 16)], [p // 16 for p in at]
    return nodes[0], paths


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    root, tops = tree([trees[s][0] for s in sources])
    out = []
    for s, above in zip(sources, tops, strict=True):
        for (_, _, own, r), below in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            path, node = below + above, own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in path:
                node = h(left, node, right)
            out.append((r[0], own, trees[s][0], root, h(*[x for p in path for x in p]), node, node == root))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=repr)


def some(n, seed, sources):
    r = random.Random(seed)
    texts = [None, "", "Small Text", "small text", "ÄÖ É Ünïcode ABC", "long " * 3000]
    rows = [(r.choice([None, i, i, i // 2]), r.choice(sources), r.choice([None, "en", ""]), r.choice([None, 7]), r.choice(texts)) for i in range(n)]
    return rows + rows[:3]


@pytest.mark.parametrize("n,sources", [(1, ["a"]), (15, ["a"]), (16, ["a"]), (17, ["a"]), (40, [None]), (300, ["hot"] * 9 + [None, "", "a", "é", "Z", "a b"]), (600, [f"s{i}" for i in range(290)])])
@pytest.mark.parametrize("parts", [1, 7])
def test_against_a_plain_tree(spark, n, sources, parts):
    rows = some(n, n, sources)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))  # runs end anywhere
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], DDL + ", tree string, pos int").repartition(3)
        assert got(merkle.manifest(df)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sql_says_the_same(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    cursor = con.execute(merkle.SQL)
    at = [[d[0] for d in cursor.description].index(c) for c in NAMES]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert got(merkle.manifest(docs)) == sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], DDL)).collect() == []


def test_the_store_holds_levels_in_order_and_any_column_can_be_the_tree(spark, tmp_path):
    df = spark.range(600).select(F.col("id").alias("key.of"), (F.col("id") % 2).alias("the.tree"), F.lit("T").alias("text"))
    nodes = merkle.leaves(df, ("key.of", "text"), "the.tree", "key.of")
    rows = merkle.prove(nodes, str(tmp_path)).collect()
    assert len(rows) == 600 and all(r["folded"] == r["root"] for r in rows) and len({r["subroot"] for r in rows}) == 2
    sizes = [spark.read.parquet(f"{tmp_path}/trees/level={k}").selectExpr("sum(size(kids))").first()[0] for k in range(4)]
    assert sizes == [600, 38, 4, 2] and not Path(f"{tmp_path}/trees/level=4").exists()
    for f in sorted(Path(f"{tmp_path}/trees/level=0").glob("*.parquet")):
        own = [(r["tree"], r["run"]) for r in spark.read.parquet(str(f)).collect()]
        assert own == sorted(own)
    other = merkle.prove(merkle.leaves(df, ("key.of", "text"), "the.tree", "key.of", changed=F.lit("t"))).collect()
    assert not any(r["folded"] == r["root"] for r in other)
