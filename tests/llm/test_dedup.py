"""Exact and near de-duplication against brute force."""

import random
import re

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgraph.llm import common, exact, simhash


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def plain_components(ids, prints):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)), key=lambda k: ids[k])
                parent[b] = a
    least = {}
    for i in range(len(ids)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least[root(i)] for i in range(len(ids))]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    words = "alpha beta gamma delta epsilon zeta eta theta é 漢字".split()
    base = [" ".join(r.choice(words) for _ in range(r.randint(3, 60))) for _ in range(60)]
    near = [b + " extra" for b in base[:30]] + [b.replace(" ", "\t \n", 2) for b in base[:30]] + [b.upper() for b in base[:10]]
    return base + near + base[:5] * 20 + ["", " ", None, "", "a", "a b", "A b", "a b", "x " * 30000]


def frame(spark, texts):
    r = random.Random(1)
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return spark.createDataFrame([(i, t, "k", 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fingerprint string, kept int"), dict(zip(ids, texts, strict=True))


def test_exact_groups_are_duckdbs(spark, texts):
    df, by = frame(spark, texts)
    con = duckdb.connect()
    documents = df.toPandas()  # noqa: F841  read by DuckDB
    con.register("documents", documents)
    want = sorted(con.execute(exact.SQL).fetchall())
    got = sorted(tuple(r) for r in exact.groups(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == want


def test_exact_with_ties_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a  b"), (None, "a b"), (None, "q"), (None, "q"), (2, None), (3, "")], "doc_id long, text string")
    got = exact.groups(df).collect()
    assert len(got) == 7
    kept = [(r["doc_id"], r["keep_id"], r["group_size"]) for r in got if r["kept"]]
    assert sorted(kept, key=str) == sorted([(1, 1, 3), (None, None, 2), (2, 2, 2)], key=str)
    assert exact.groups(df.limit(0)).count() == 0 and exact.distinct(df.limit(0)).count() == 0


@pytest.mark.parametrize("small", [{"ROWS_A_BLOCK": 4, "BLOCKS_A_FILTER": 8}, {"ROWS_A_BLOCK": 1, "HOT_TIMES": 1}, {"WIDTH": 4}])
def test_exact_stays_right_with_many_filters_hot_blocks_and_full_ones(spark, texts, monkeypatch, small):
    df, _ = frame(spark, texts)
    want = sorted(tuple(r) for r in exact.groups(df).collect())
    rows = sorted(tuple(r) for r in exact.distinct(df).collect())
    for k, v in small.items():
        monkeypatch.setattr(exact, k, v)
    monkeypatch.setattr(common, "HOT_SHARE", 1 / 20)
    assert sorted(tuple(r) for r in exact.groups(df).collect()) == want
    assert sorted(tuple(r) for r in exact.distinct(df).collect()) == rows


def exchanged(df):
    """Rows written by the exchanges of the last action's plan."""
    import re as r

    plan = df._jdf.queryExecution().executedPlan()
    out, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if r.search("QueryStage", name):
            todo.append(node.plan())
            continue
        if name == "Exchange":
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_only_suspects_are_shuffled(spark):
    n = 40_000
    keys = spark.range(0, n, 1, 4).selectExpr("sha2(cast(if(id < 100, 0, id) as string), 256) AS key").checkpoint()
    made = exact.bitmaps(keys, "key", exact.blocks_for(n), 2)
    assert made.collect() and all(w <= 4 * exact.blocks_for(n) for w in exchanged(made)) and exchanged(made)
    rows = exact.suspects(keys, "key", keys, n, 2)
    maybe = rows.filter("maybe").select("row.key").groupBy("key").count()
    assert len(maybe.collect()) < 0.05 * n and sum(exchanged(maybe)) < 0.05 * n


def test_exact_distinct_of_any_columns(spark):
    rows = spark.sql("""SELECT * FROM VALUES (1L, 'a b', map('x', 1), 'k', true, 7L), (2L, 'a  b', map('y', 2), 'k', true, 7L), (3L, 'c', map(), 'k', false, 8L), (3L, 'c', map('z', 1), 'k', false, 8L)
        AS t(doc_id, text, m, key, maybe, block)""").withColumnRenamed("m", "__byte0").withColumn("row", F.lit(1)).withColumn("own.x", F.lit(2))
    got = exact.distinct(rows)
    assert got.columns == rows.columns and sorted((r["doc_id"], str(r["__byte0"])) for r in got.collect()) == [(1, "{'x': 1}"), (3, "{'z': 1}")]
    assert exact.absent(rows, spark.createDataFrame([(1,)], "key long"), "doc_id").count() == 3


def test_exact_distinct_keeps_whole_rows(spark, texts):
    df, by = frame(spark, texts)
    kept = exact.distinct(df)
    assert kept.columns == df.columns
    want = {r["doc_id"] for r in exact.groups(df).collect() if r["kept"]}
    rows = kept.collect()
    assert {r["doc_id"] for r in rows} == want and len(rows) == len(want) and all(r["text"] == by[r["doc_id"]] for r in rows)


def test_probe_never_misses_a_repeat(spark):
    keys = spark.range(4000).selectExpr("cast(id % 3000 as string) AS k")
    rows = exact.suspects(keys, "k", keys, 4000, 2).select("maybe", "row.k")
    assert rows.filter("NOT maybe AND cast(k as long) < 1000").count() == 0
    assert rows.filter("NOT maybe").count() > 1800


def test_fingerprints(spark, texts):
    for t in texts:
        assert simhash.fingerprint(t or "") % (1 << 64) == plain_fingerprint(t)


def test_near_groups(spark, texts):
    df, by = frame(spark, texts)
    ids = sorted(by)
    prints = [plain_fingerprint(by[i]) for i in ids]
    want = {i: (f"{p:016x}", c) for i, p, c in zip(ids, prints, plain_components(ids, prints), strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.groups(df).collect()}
    assert got == want
    kept = simhash.distinct(df)
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in want.values()} and kept.columns == df.columns


def test_near_chain_and_ball(spark):
    def component(prints):
        df = spark.createDataFrame([(p if p < 1 << 63 else p - (1 << 64),) for p in prints], "fingerprint long")
        return {r["vertex"] % (1 << 64): r["label"] for r in simhash.components(simhash.links(df)).collect()}

    chain = [sum(3 << (2 * j) for j in range(i)) for i in range(25)]  # each two bits from the next
    assert len(set(component(chain).values())) == 1 and len(component(chain)) == 25
    ball = [0, *(1 << i for i in range(64))]
    assert len(set(component(ball).values())) == 1 and len(component(ball)) == 65
    assert component([0, 7, 7 << 10]) == {}


def test_near_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "zz")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.groups(df).collect()}
    assert got == {(None, 5), (5, 5), (None, None)}
    assert simhash.groups(df.limit(0)).count() == 0 and simhash.distinct(df.limit(0)).count() == 0
    assert {(r["doc_id"], r["text"]) for r in simhash.distinct(df).collect()} == {(5, "a b c d"), (None, "zz")}


def test_near_distinct_goes_by_row_and_not_by_id(spark):
    rows = [(1, "a b c d", "x"), (2, "a b c d", "x"), (2, "one of its own kind", "x"), (3, "q r s", "x"), (3, "q r s", "x"), (3, "q r s", "y"), (4, "q  r s", "x"), (None, "z z z z", "x"), (None, "z z z z", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string").withColumn("own", F.create_map(F.lit("k"), F.col("doc_id")))
    got = simhash.distinct(df)
    assert got.columns == df.columns
    assert sorted(map(str, ((r["doc_id"], r["text"], r["mark"]) for r in got.collect()))) == sorted(map(str, [(1, "a b c d", "x"), (2, "one of its own kind", "x"), (3, "q r s", "x"), (None, "z z z z", "x")]))


def test_hubs_and_labels_are_split(spark, monkeypatch):
    """A star and a long path beside many pairs: hubs and labels go by broadcast, and what is left over is removed."""
    import os

    monkeypatch.setattr(common, "HOT_SHARE", 1 / 50)
    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000 + 2 * i, 5001 + 2 * i) for i in range(100)]
    before = len([f for f in os.listdir(common.shared_dir(spark).removeprefix("file:")) if f.startswith("rdd-")])
    got = {r["vertex"]: r["label"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: (0 if v < 300 else 1000 if v < 2000 else v - v % 2) for e in edges for v in e}
    left = len([f for f in os.listdir(common.shared_dir(spark).removeprefix("file:")) if f.startswith("rdd-")])
    assert left <= before + 1


def test_attach_splits_hot_keys(spark):
    rows = spark.range(1000).selectExpr("id", "CASE WHEN id < 600 THEN 0 ELSE id END AS k")
    groups = rows.groupBy("k").count().withColumnRenamed("count", "n")
    got = common.attach(rows, groups, "k", "n", 1000)
    assert got.count() == 1000 and got.filter("k = 0 AND n = 600").count() == 600


def test_absent(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (3, "e")], "key long, maybe string")
    got = exact.absent(df, spark.createDataFrame([(2,), (9,)], "key long"), "key")
    assert sorted(r["maybe"] for r in got.collect()) == ["a", "d", "e"] and got.columns == df.columns
    assert exact.absent(df, spark.createDataFrame([], "key long"), "key").count() == 5
