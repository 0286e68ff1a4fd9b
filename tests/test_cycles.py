"""Cycles by rounds: what is kept, and that rounds find what a search by hand finds."""

import random

from quillgraph.operators import graph


def by_hand(edges, most):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found, stack = set(), [(a, (a,)) for a in out]
    while stack:
        at, walk = stack.pop()
        for b in out.get(at, ()):
            if b == walk[0] and len(walk) >= 2:
                found.add(walk)
            if b > walk[0] and b not in walk and len(walk) < most:
                stack.append((b, (*walk, b)))
    return found


def test_walks_are_not_kept(spark, monkeypatch):
    """A ring of 12 layers has many walks and no cycle of ten."""
    edges = spark.createDataFrame([(3 * a + i, 3 * ((a + 1) % 12) + j) for a in range(12) for i in range(3) for j in range(3)], "src long, dst long")
    kept, keep = [], graph.keep
    monkeypatch.setattr(graph, "keep", lambda df: kept.append(keep(df)) or kept[-1])
    assert graph.cycles(edges, 3, 10, None).count() == 0
    assert max(df.count() for df in kept) <= 108


def test_rounds_find_every_cycle_once(spark, monkeypatch):
    monkeypatch.setattr(graph, "WALKS", 60)
    rng = random.Random(4)
    pairs = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(40)})
    made, rounds = [], graph.cycle_rounds
    monkeypatch.setattr(graph, "cycle_rounds", lambda *a: made.append(rounds(*a)) or made[-1])
    rows = graph.cycles(spark.createDataFrame(pairs, "src long, dst long"), 2, 7, None).collect()
    assert sorted(tuple(r["cycle"]) for r in rows) == sorted(by_hand([p for p in pairs if p[0] != p[1]], 7))
    assert all(r["length"] == len(r["cycle"]) for r in rows)
    assert 1 < len(made[0]) <= graph.ROUNDS
