"""Stores and memories as a whole."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.vector import hashed_embedding
from quillgraph.operators.memory import Memory
from quillgraph.sources.store import FolderStore

def now():
    return F.lit("2024-01-01").cast("timestamp")



@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_folder_store(spark, tmp_path, fmt):
    s = FolderStore(spark, f"{tmp_path}/kb", fmt)
    assert s.docs().count() == 0 and s.health()["status"] in ("healthy", "degraded")
    new = lambda *rows: spark.createDataFrame(list(rows), "path string, content string")
    s.write(new(("active/a.md", "alpha"), ("b.md", "beta")), now())
    s.write(new(("b.md", "gamma")), now())
    assert {r["path"]: (r["content"], r["category"]) for r in s.docs().collect()} == {"active/a.md": ("alpha", "active"), "b.md": ("gamma", "general")}
    assert s.versions() == [1, 2] and s.read("b.md").count() == 1 and s.search("gam").count() == 1 and s.list("active").count() == 1 and s.stats().count() == 2
    s.export(f"{tmp_path}/dump")
    s.delete(new(("b.md", "")))
    assert s.docs().count() == 1
    s.restore(f"{tmp_path}/dump")
    assert s.docs().count() == 2


def test_memory(spark):
    seen = []
    nodes = spark.createDataFrame([(1, "The cache is warm", "fact"), (2, "The event started", "event")], "id long, content string, node_type string").withColumn("embedding", hashed_embedding(64)("content"))
    edges = spark.createDataFrame([], "src long, dst long, edge_type string, weight double")
    m = Memory(nodes, edges).on("after_store", lambda df: seen.append(df.count()))
    new = spark.createDataFrame([(3, "The cache is not warm", "fact", 1.0), (4, "bad", "fact", 2.0)], "id long, content string, node_type string, confidence double")
    m, refused = m.store(new, now(), hashed_embedding(64))
    assert [r["id"] for r in refused.collect()] == [4] and seen == [1] and m.nodes.count() == 3
    assert [(r["src"], r["dst"], r["edge_type"]) for r in m.edges.collect()] == [(3, 1, "CONTRADICTS")]
    m = m.update(spark.createDataFrame([(3, 0.1)], "id long, importance double"))
    assert m.nodes.filter("id = 3").first()["importance"] == 0.1
    m = m.forget(spark.createDataFrame([(1,)], "id long"))
    assert m.edges.count() == 0 and m.nodes.count() == 2
    with pytest.raises(ValueError, match="no event"):
        m.on("never", print)


def test_insights(spark):
    nodes = spark.createDataFrame([(i, f"e{i}", "event") for i in range(3)], "id long, content string, node_type string")
    edges = spark.createDataFrame([(0, 1, "NEXT"), (1, 2, "NEXT")], "src long, dst long, edge_type string")
    assert [r["insight"] for r in Memory(nodes, edges).insights().collect()] == ["Sequence of events detected: e0 → e1 → e2"]
