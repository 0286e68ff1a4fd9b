"""The deepest calls from the least starts, without those of the others."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph


@pytest.mark.parametrize("limit", [3, 40, 10_000])
@pytest.mark.parametrize("depth", [3, 9])
def test_same_rows_as_all(spark, monkeypatch, limit, depth):
    """Also where the first starts have too few rows, or no start reaches the depth."""
    monkeypatch.setattr(graph, "STARTS", (2, 5))
    rng = random.Random(9)
    edges = spark.createDataFrame(sorted({(a, a + rng.randrange(1, 9)) for a in range(60) for _ in range(2) if a > 4}), "src long, dst long")
    starts, ends = spark.range(40), spark.range(0, 70, 2)
    every = graph.reach(edges, starts, depth).filter("depth >= 2").join(ends, "id", "left_semi").select("src", "id", "depth").collect()
    want = sorted(map(tuple, every), key=lambda r: (-r[2], r[0], r[1]))[:limit]
    assert [tuple(r) for r in graph.first_reached(edges, starts, ends, 2, depth, limit).orderBy(F.desc("depth"), "src", "id").collect()] == want


def test_only_the_first_starts_go_on(spark, monkeypatch):
    monkeypatch.setattr(graph, "STARTS", (3, 10))
    edges = spark.createDataFrame([(4 * i + k, 4 * i + k + 1) for i in range(200) for k in range(3)], "src long, dst long")
    kept, keep = [], graph.keep
    monkeypatch.setattr(graph, "keep", lambda df: kept.append(keep(df)) or kept[-1])
    rows = graph.first_reached(edges, spark.range(0, 800, 4), spark.range(800), 2, 3, 2).collect()
    assert [tuple(r) for r in rows] == [(0, 3, 3), (4, 7, 3)]
    assert max(df.count() for df in kept if "depth" in df.columns) <= 6
