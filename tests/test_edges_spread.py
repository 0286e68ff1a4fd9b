"""Edges of many rows are made by more tasks than the session's shuffles have."""

from quillgraph.plans import domain


def test_tasks_grow_with_rows(spark, small, monkeypatch):
    few = domain.Tables(spark, small).edges
    monkeypatch.setattr(domain, "EDGE_ROWS", 500)
    many = domain.Tables(spark, small).edges
    assert many.rdd.getNumPartitions() >= 12 > few.rdd.getNumPartitions()
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
