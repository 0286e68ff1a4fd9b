"""Names are looked up without a broadcast of all entities."""

from quillgraph.operators import code


def test_lookup_broadcasts_frequent_names_only(spark, monkeypatch):
    monkeypatch.setattr(code, "FREQUENT", 2)
    uses = spark.createDataFrame([(i, f"f{i % 3}", n) for i, n in enumerate(["A"] * 6 + ["B"] * 4 + ["C", "C", "D", None])], "id long, file_path string, name string")
    entities = spark.createDataFrame([("a9", "f0", "A", "Class"), ("a1", "f9", "A", "Class"), ("c1", "f9", "C", "Class"), ("b1", "f1", "B", "Function")], "id string, file_path string, name string, entity_type string")
    found = code.lookup(uses, entities, code.TYPES)
    want = {i: ("a9" if i % 3 == 0 else "a1") if n == "A" else "c1" if n == "C" else None for i, _, n in (tuple(r) for r in uses.collect())}
    assert {r["id"]: r["entity_id"] for r in found.collect()} == want and found.count() == uses.count()
    assert found._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") >= 2
