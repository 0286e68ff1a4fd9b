"""Cycles of a graph that each task holds: the same as by joins and by hand, without a join or a walk that is kept."""

import random

import pytest
from test_cycles import by_hand

from quillgraph.operators import circuits, graph


def pairs_of(seed, vertices, edges, hub=None):
    rng = random.Random(seed)
    some = {(rng.randrange(vertices) * 3 - 20, rng.randrange(vertices) * 3 - 20) for _ in range(edges)}
    return sorted(some | ({(hub, a) for a, _ in some} | {(b, hub) for _, b in some} if hub is not None else set()))


def test_rounds_have_no_shuffle(spark, monkeypatch):
    """Many rounds; the walks are in no join, and the edges alone are kept."""
    monkeypatch.setattr(graph, "WALKS", 60)
    pairs = pairs_of(5, 30, 90)
    kept, keep = [], graph.keep
    monkeypatch.setattr(graph, "keep", lambda df: kept.append(keep(df)) or kept[-1])
    found = graph.cycles(spark.createDataFrame(pairs, "src long, dst long"), 3, 8, None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert len(kept) == 1
    want = {w for w in by_hand([p for p in pairs if p[0] != p[1]], 8) if len(w) >= 3}
    assert sorted(tuple(r["cycle"]) for r in found.collect()) == sorted(want)


@pytest.mark.parametrize("chunk,noted,places", [(1 << 18, 1 << 17, 22), (7, 5, 22), (3, 1, 3)])
@pytest.mark.parametrize("seed,hub", [(1, None), (2, -11), (3, 1000)])
def test_chunks_batches_and_shared_places(spark, monkeypatch, chunk, noted, places, seed, hub):
    """Found whole however small the chunks are and however many vertices share a place."""
    pairs = [p for p in pairs_of(seed, 16, 34, hub) if p[0] != p[1]]
    monkeypatch.setattr(circuits, "CHUNK", chunk)
    monkeypatch.setattr(circuits, "NOTED", noted)
    monkeypatch.setattr(circuits, "PLACES", places)
    import numpy as np

    held = circuits.load(spark.createDataFrame(pairs, "src int, dst int"))
    for lengths in ({2, 3, 4, 5, 6, 7}, {2}, {3}, {5, 6}):
        rows = [tuple(held[0][r].tolist()) for first in range(3) for own in [np.arange(first, len(held[0]), 3, dtype=np.int32)]
                for rows in circuits.found(held, own, frozenset(lengths), np.empty(1 << places, np.uint8)) for r in rows]
        assert sorted(rows) == sorted(w for w in by_hand(pairs, 7) if len(w) in lengths)


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_same_by_joins(spark, monkeypatch, kind):
    pairs = pairs_of(7, 20, 60)
    edges = spark.createDataFrame(pairs, "src long, dst long").selectExpr(f"cast(src as {kind}) src", f"cast(dst as {kind}) dst")
    here = graph.cycles(edges, 2, 6, None)
    first = graph.cycles(edges, 2, 6, 9).collect()
    monkeypatch.setattr(graph, "LINKS", 0)
    there = graph.cycles(edges, 2, 6, None)
    assert here.dtypes == there.dtypes
    assert sorted(map(tuple, here.collect())) == sorted(map(tuple, there.collect()))
    assert first == graph.cycles(edges, 2, 6, 9).collect() and len(first) == 9


def test_no_edges(spark):
    assert graph.cycles(spark.createDataFrame([(1, 1)], "src long, dst long"), 2, 10, None).collect() == []
