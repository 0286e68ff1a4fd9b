"""Segmented scans and what is built on them against sequential versions, with keys whose rows lie in several chunks."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph, scan, windows
from quillgraph.streaming import changes


@pytest.fixture(autouse=True)
def several_chunks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def some(n=400, seed=1):
    """key (one with most rows, a null one), second with ties, id, value (some null)."""
    r = random.Random(seed)
    return [(r.choice(["hot"] * 6 + ["a", "b", None]), r.randint(0, 300), i, r.choice([None, float(r.randint(0, 9))])) for i in range(n)]


def by_key(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r[1:3]):
        out[r[0]].append(r)
    return out


DDL = "key string, second int, id int, value double"


def test_totals_and_shifts(spark):
    rows = some()
    df = scan.chunks(spark.createDataFrame(rows, DDL).repartition(3), "key", ["second", "id"])
    assert df.filter("key = 'hot'").select(scan.CHUNK).distinct().count() > 1
    got = scan.shifted(scan.totals(df, ["second", "id"], ("top",), ("low",), n=F.lit(1), s=F.col("value"), top=F.col("value"), low=F.col("value")), ["second", "id"], was=F.col("id"))
    found = {r["id"]: (r["n"], r["s"], r["top"], r["low"], r["was"]) for r in got.collect()}
    for own in by_key(rows).values():
        seen, was = [], None
        for n, (_, _, i, v) in enumerate(own, 1):
            seen += [v] if v is not None else []
            assert found[i] == (n, sum(seen), max(seen, default=None), min(seen, default=None), was)
            was = i


def test_averages_running_means_and_edges(spark):
    rows = [(*r[:3], r[3] or 0.0) for r in some(300, 2)]
    df = spark.createDataFrame(rows, DDL).repartition(3)
    ema = {r["key"]: r["ema"] for r in windows.moving_average(df, "key", ["second", "id"], "value").collect()}
    mean = {r["id"]: (r["running_mean"], r["success_rate"]) for r in windows.running(df.withColumn("ok", F.col("value") > 4), "key", ["second", "id"], "value", "ok").collect()}
    edges = {r["id"]: r["transition"] for r in windows.transitions(df, "key", ["second", "id"], F.col("value") > 4).collect()}
    want = {}
    for key, own in by_key(rows).items():
        now, on, values = own[0][3], False, []
        for k, (_, _, i, v) in enumerate(own):
            now = now if k == 0 else 0.8 * now + 0.2 * v
            values.append(v)
            assert mean[i] == pytest.approx((sum(values) / len(values), sum(x > 4 for x in values) / len(values)))
            if (v > 4) != on:
                on = v > 4
                want[i] = "fired" if on else "resolved"
        assert ema[key] == pytest.approx(now)
    assert edges == want
    assert windows.moving_average(df.limit(0), "key", ["second", "id"], "value").count() == 0


@pytest.mark.parametrize("preset", [(3, 20, 50), (1, 5, 0)])
def test_block_limiter(spark, preset):
    points, duration, block = preset
    rows = some(250, 3)
    got = {r["id"]: r["allowed"] for r in windows.block_limiter(spark.createDataFrame(rows, DDL).repartition(3), "key", ("second", "id"), preset).collect()}
    for own in by_key(rows).values():
        start, used, until = None, 0, -1e9
        for _, t, i, _ in own:
            if t < until:
                assert got[i] is False
                continue
            if start is None or t >= start + duration:
                start, used = t, 0
            used += 1
            if used > points:
                start, until = None, t + block
            assert got[i] == (used <= points)


def test_bursts_of_one_sequence(spark):
    r = random.Random(4)
    rows = [(float(r.randint(0, 400)), f"p{r.randint(0, 5)}", f"c{i}") for i in range(120)]
    got = changes.debounce_batch(spark.createDataFrame(rows, "ts double, path string, change string").repartition(3), 10).collect()
    want, burst, last = defaultdict(list), 0, None
    for ts, path, change in sorted(rows):
        burst += last is not None and ts - last >= 10
        last = ts
        want[burst, path].append((ts, change))
    assert {(r["burst"], r["path"]): (r["change"], r["events"]) for r in got} == {k: (max(v)[1], len(v)) for k, v in want.items()}


@pytest.mark.parametrize("shared", [True, False])
def test_containment(spark, shared):
    r = random.Random(5)
    ranges = [(i, r.choice("xxxxy"), (a := r.randint(0, 120)), a + r.choice([0, 1, 3, 10, 60])) for i in range(220)] + [(900, "x", None, 3), (901, None, 1, 2), (902, "x", 0, 0)]
    df = spark.createDataFrame(ranges, "id long, file_path string, line int, end_line int")
    outer, inner = (df, df) if shared else (df.filter("id % 2 = 0"), df.filter("id % 2 = 1"))
    got = {x["inner_id"]: x["outer_id"] for x in graph.contained(outer, inner).collect()}
    want = {}
    for i, f, a, b in ranges:
        if f is None or a is None or not (shared or i % 2):
            continue
        held = [(d - c, -c, o) for o, g, c, d in ranges if g == f and o != i and c is not None and c <= a and b <= d and (shared or o % 2 == 0)]
        if held:
            want[i] = min(held)[2]
    assert got == want


def test_one_file_of_many_ranges_takes_no_quadratic_step(spark):
    """100,000 ranges that all lie in each other: pairs would be five billion."""
    df = spark.range(100_000).selectExpr("id", "'f' AS file_path", "id AS line", "200000 - id AS end_line")
    got = graph.contained(df, df).agg(F.count("*"), F.sum(F.col("inner_id") - F.col("outer_id"))).first()
    assert tuple(got) == (99_999, 99_999)
