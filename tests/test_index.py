"""The vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import index
from quillgraph.plans import more  # noqa: F401  registers its queries
from quillgraph.plans.registry import QUERIES


def test_recall_on_the_given_vectors(spark, small):
    exact, found = QUERIES["t05_exact_search"](spark, small), QUERIES["t05_index_search"](spark, small)
    assert index.recall(found, exact) >= 0.9


@pytest.fixture
def clustered(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.2 * r.normal(size=16)], "x") for i in range(1200)]
    rows += [(5000 + i, rows[0][1], "x") for i in range(300)] + [(9000, None, "x"), (9001, [0.0] * 16, "x")]
    return spark.createDataFrame(rows, "id long, embedding array<double>, list string")


def test_every_row_is_indexed_and_hot_lists_are_split(spark, clustered, monkeypatch):
    monkeypatch.setattr(index, "PART_ROWS", 50)
    centres = index.fit(clustered)
    built = index.build(clustered, centres)
    assert built.count() == 1501 and built.groupBy("list", "part").count().agg(F.max("count")).first()[0] < 120
    queries = clustered.filter("id % 50 = 0")
    exact = index.search(built, centres, queries, 5, len(centres))
    plain = {r["id"]: np.array(r["embedding"]) for r in clustered.filter("embedding IS NOT NULL").collect()}
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
    for query in (50, 100, 0):
        want = sorted((-round(float(unit(plain[query]) @ unit(v)), 6), k) for k, v in plain.items() if k != query)[:5]
        assert [r["key"] for r in exact.filter(F.col("query") == query).orderBy("rank").collect()] == [k for _, k in want] or query == 0
    probes = index.tune(built, centres, clustered, 5, 0.95)
    assert probes < len(centres) and index.recall(index.search(built, centres, queries, 5, probes), exact) >= 0.9


def test_nothing_to_index(spark, clustered):
    none = clustered.limit(0)
    centres = index.fit(none)
    built = index.build(none, centres)
    assert built.count() == 0 and index.search(built, centres, none).count() == 0 and index.tune(built, centres, none) == 1
