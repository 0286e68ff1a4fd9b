"""Streams over files against the same work over tables."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from quillgraph.streaming import changes, monitor

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def feed(tmp_path):
    """Writes rows as JSON files, one file a batch."""

    def write(name, batches):
        folder = tmp_path / name
        folder.mkdir()
        for i, rows in enumerate(batches):
            (folder / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
            os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken in order of time
        return str(folder)

    return write


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def at(s):
    return (T0 + dt.timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%S.%f")


def test_debounce(spark, feed):
    rows = [("a", "add", 0), ("a", "change", 1), ("b", "add", 1.5), ("a", "unlink", 60), ("z", "add", 9000)]
    batch = [{"path": p, "change": c, "is_dir": False, "ts": at(s)} for p, c, s in rows]
    stream = changes.read_changes(spark, feed("ch", [batch[:2], batch[2:]]))
    got = run(changes.debounce(stream, "5 seconds"), "debounced").collect()
    assert sorted((r["path"], r["change"]) for r in got) == [("a", "change"), ("a", "unlink"), ("b", "add")]
    assert len({r["batch_id"] for r in got}) == 2
    table = spark.createDataFrame([(p, c, T0 + dt.timedelta(seconds=s)) for p, c, s in rows], "path string, change string, ts timestamp")
    assert sorted((r["burst"], r["path"], r["change"]) for r in changes.debounce_batch(table, 5.0).collect()) == [(0, "a", "change"), (0, "b", "add"), (1, "a", "unlink"), (2, "z", "add")]


def test_incremental_analyses_only_what_changed(spark, feed, tmp_path):
    seen = []
    known = spark.createDataFrame([("a", "same"), ("b", "old")], "path string, content string").transform(changes.content_hash).select("path", "hash")
    source = feed("files", [[{"path": "a", "content": "same", "modified": at(1)}, {"path": "b", "content": "new", "modified": at(1)}, {"path": "b", "content": "newer", "modified": at(2)}]])
    stream = spark.readStream.schema("path string, content string, modified timestamp").json(source)
    q = changes.incremental(stream, lambda: known, lambda df: seen.extend(df.select("path", "content").collect()), f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert [tuple(r) for r in seen] == [("b", "newer")]
    assert [r["path"] for r in changes.deleted(known, spark.createDataFrame([("a",)], "path string")).collect()] == ["b"]


def test_sessions_of_closed_windows(spark, feed):
    rows = [{"user_id": u, "ts": at(s)} for u, s in ((1, 0), (1, 100), (1, 5000), (2, 50), (1, 90000))]
    stream = spark.readStream.schema("user_id long, ts timestamp").json(feed("ev", [rows]))
    got = run(monitor.sessions(stream), "sessions")
    assert sorted((r["user_id"], r["events"]) for r in got.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_limiter_over_batches(spark, feed):
    rows = [{"user_id": i % 3, "event_id": i, "ts": at(i * 7 % 400)} for i in range(60)]
    rows.sort(key=lambda r: r["ts"])
    stream = spark.readStream.schema("user_id long, event_id long, ts timestamp").option("maxFilesPerTrigger", 1).json(feed("calls", [rows[:20], rows[20:40], rows[40:]]))
    got = {r["event_id"]: r["allowed"] for r in run(monitor.limiter(stream, 3, 60), "limited").collect()}
    for u in range(3):
        kept = []
        for r in (r for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])) if r["user_id"] == u):
            t = (dt.datetime.fromisoformat(r["ts"]) - T0).total_seconds()
            ok = sum(k > t - 60 for k in kept) < 3
            kept += [t] * ok
            assert got[r["event_id"]] is ok


def test_alert_edges(spark, feed):
    flags = [0, 1, 1, 0, 1, 0, 0]
    rows = [{"name": "cpu", "value": 100.0 * f, "ts": at(i)} for i, f in enumerate(flags)]
    stream = spark.readStream.schema("name string, value double, ts timestamp").option("maxFilesPerTrigger", 1).json(feed("m", [rows[:3], rows[3:]]))
    rules = monitor.rules_table(spark, {"hot": ("cpu > 50", "high"), "other": ("mem > 1", "low")})
    got = run(monitor.alert_edges(monitor.evaluate(stream, rules).select("rule", "ts", "triggered")), "alerts").orderBy("ts").collect()
    assert [(r["rule"], r["transition"]) for r in got] == [("hot", "fired"), ("hot", "resolved"), ("hot", "fired"), ("hot", "resolved")]


def test_conditions(spark):
    assert monitor.condition(" cpu >= 1.5 ") == ("cpu", ">=", 1.5)
    with pytest.raises(ValueError, match="not a condition"):
        monitor.condition("cpu => 1; drop")
    df = spark.createDataFrame([(1.0,), (2.0,)], "cpu double")
    assert df.filter(monitor.holds("cpu == 2")).count() == 1
    assert df.select(monitor.progress(F.lit(1), F.lit(4), F.lit(10)).alias("p")).first()["p"]["eta_s"] == 30
