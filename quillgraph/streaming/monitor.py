"""Alerts, metrics and limiters on streams, with state bounded by watermarks and time-outs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CONDITION = re.compile(r"^\s*(\w+)\s*(>=|<=|==|>|<)\s*(-?\d+(?:\.\d+)?)\s*$")


def condition(text: str) -> tuple[str, str, float]:
    """`metric op number`, with >, >=, <, <= or ==."""
    m = CONDITION.match(text)
    if not m:
        raise ValueError(f"not a condition: {text!r}")
    return m[1], m[2], float(m[3])


def holds(text: str, value: Column | None = None) -> Column:
    """The condition as an expression over its metric's column, or over value."""
    name, op, bound = condition(text)
    c = F.col(name) if value is None else value
    return {">": c > bound, ">=": c >= bound, "<": c < bound, "<=": c <= bound, "==": c == bound}[op]


def windows(metrics: DataFrame, length: str = "30 seconds", delay: str = "1 minute") -> DataFrame:
    """Per metric and window: count, mean, highest, last."""
    rows = metrics.withWatermark("ts", delay) if metrics.isStreaming else metrics
    return rows.groupBy(F.window("ts", length).alias("w"), "name").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("high"), F.max_by("value", F.struct("ts", "value")).alias("last"))


def evaluate(values: DataFrame, rules: DataFrame) -> DataFrame:
    """values (name, value, ...) with a row for each rule on that metric (rule, metric, op, bound, severity) and `triggered`."""
    op, v, b = F.col("op"), F.col("value"), F.col("bound")
    hit = F.when(op == ">", v > b).when(op == ">=", v >= b).when(op == "<", v < b).when(op == "<=", v <= b).when(op == "==", v == b)
    return values.join(rules.withColumnRenamed("metric", "name"), "name").withColumn("triggered", F.coalesce(hit, F.lit(False)))


def rules_table(spark, rules: dict[str, tuple[str, str]]) -> DataFrame:  # noqa: ANN001
    """rule -> (condition, severity) as a frame."""
    return spark.createDataFrame([(name, *condition(text), severity) for name, (text, severity) in rules.items()], "rule string, metric string, op string, bound double, severity string")


def alert_edges(values: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """A stream of evaluated rows (rule, ts, triggered) as fired and resolved rows; every rising edge fires. Rows of one time are taken with those not triggered first. State is one flag a rule."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        on = state.get[0] if state.exists else False
        rows: list[tuple[str, Any, str]] = []
        for r in pd.concat(frames).sort_values(["ts", "triggered"]).itertuples():
            if r.triggered != on:
                on = bool(r.triggered)
                rows.append((key[0], r.ts, "fired" if on else "resolved"))
        state.update((on,))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["rule", "ts", "transition"])

    return values.groupBy("rule").applyInPandasWithState(step, "rule string, ts timestamp, transition string", "on boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def limiter(calls: DataFrame, limit: int, window_s: float, delay: str = "1 minute") -> DataFrame:
    """A stream of calls (user_id, event_id, ts) with `allowed`: fewer than limit accepted in the window before, in event time.

    Calls may be late by `delay`: each is held against the accepted calls of its own window, so what came after it doesn't
    count. State is the accepted times that a call yet to come can still ask for, those since the watermark less a window; it
    goes once the watermark has passed the last of them by a window.
    """
    from quillgraph.operators.windows import admitted

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(frames).sort_values(["ts", "event_id"])
        mark = state.getCurrentWatermarkMs()
        accepted, out = admitted(state.get[0] if state.exists else [], pdf["ts"].astype("datetime64[us]").astype("int64") / 1e6, limit, window_s)
        accepted = [a for a in accepted if a > mark / 1000 - window_s]
        state.update((accepted,))
        state.setTimeoutTimestamp(max(mark, int(max(accepted, default=0) * 1000)) + int(window_s * 1000) + 1)
        yield pdf.assign(user_id=key[0], allowed=out)[["user_id", "event_id", "ts", "allowed"]]

    timed = calls.withWatermark("ts", delay)
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, ts timestamp, allowed boolean", "accepted array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", by: str = "user_id") -> DataFrame:
    """Per key and session: start, end, events."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("events")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def progress(done: Column, total: Column, elapsed_s: Column) -> Column:
    """struct<share, eta_s> of work in chunks."""
    return F.struct(F.coalesce(F.try_divide(done, total), F.lit(0.0)).alias("share"), F.try_divide(elapsed_s * (total - done), done).alias("eta_s"))
