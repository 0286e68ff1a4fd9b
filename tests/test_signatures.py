"""Pairs of one signature, whole and the first of them."""

import itertools

from quillgraph.operators import graph


def test_pairs_of_a_large_signature_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(graph, "MEMBERS", 5)
    rows = [(i, "s" if i % 4 else f"t{i % 16}", f"f{i % 3}", i % 7) for i in range(90)] + [(200, None, "f0", 1), (201, "s", None, 1), (202, "alone", "f0", 99)]
    functions = spark.createDataFrame(rows, "id long, signature string, file_path string, line_count int")
    pairs = graph.same_signature(functions)
    assert pairs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    want = sorted((a[0], a[3], b[0]) for a, b in itertools.permutations(rows, 2) if a[1] is not None and a[1] == b[1] and None not in (a[2], b[2]) and a[2] != b[2])
    assert sorted((r["id1"], r["line_count1"], r["id2"]) for r in pairs.collect()) == want
    first = sorted(want, key=lambda r: (-r[1], r[0], r[2]))[:20]
    assert [(r["id1"], r["line_count1"], r["id2"]) for r in graph.first_same_signature(functions, 20).collect()] == first


def test_a_member_and_its_partners_are_expanded_apart(spark):
    """Code of one stage would hold the square of a chunk; ids that two files share and null ids are no partners."""
    rows = [(i, "s", f"f{i % 3}", i) for i in range(30)] + [(0, "s", "f1", 5), (None, "s", "f2", 6)]
    pairs = graph.same_signature(spark.createDataFrame(rows, "id long, signature string, file_path string, line_count int"))
    narrow = pairs.select("id1", "id2")
    for df in (pairs, narrow):
        df.collect()
        steps = [s.strip("*()0123456789 +-:!|") for s in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].split("\n")]
        made = [s.split(" ")[0] for s in steps if s.startswith(("Generate", "Coalesce"))]
        assert made == ["Generate", "Coalesce", "Generate"]
    want = sorted((a[0], b[0]) for a, b in itertools.permutations(rows, 2) if None not in (a[0], b[0]) and a[0] != b[0] and a[2] != b[2])
    assert sorted(map(tuple, narrow.collect())) == want
