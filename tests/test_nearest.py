"""Nearest partners by blocks: the same rows as from all pairs, of which only each row's first leave a group."""

import random

from pyspark.sql import functions as F

from quillgraph.operators import blocks


def test_same_rows_as_all_pairs_and_few_leave_a_group(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 20)
    monkeypatch.setattr(blocks, "BLOCKS", 3)
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(60)]
    rows = spark.createDataFrame([(i, base[i % 60]) for i in range(150)] + [(150, [0.0] * 4)], "id long, embedding array<float>")
    want = {}
    for r in blocks.pairs(rows, "id", "embedding", 0.3).collect():
        for a, b in ((r["a"], r["b"]), (r["b"], r["a"])):
            want.setdefault(a, []).append((-int(r["similarity"] * 1e7 + 0.5), b))
    want = sorted((a, b) for a, near in want.items() for _, b in sorted(near)[:3])
    out = blocks.nearest(rows, "id", "embedding", 0.3, 3)
    assert sorted((r["src"], r["dst"]) for r in out.collect()) == want
    groups = blocks.dealt(rows, "id", "embedding").groupBy("x", "y").agg(F.count("*").alias("n")).collect()
    assert len(groups) == 10  # of four blocks, of 50 rows as BLOCKS asks for; BLOCK would make eight

    real, given = type(rows).withColumn, []
    monkeypatch.setattr(type(rows), "withColumn", lambda self, name, c: (given.append(self) if "near" in self.columns else None) or real(self, name, c))
    blocks.nearest(rows, "id", "embedding", 0.3, 3)
    assert given[0].count() <= 3 * sum(r["n"] for r in groups)
