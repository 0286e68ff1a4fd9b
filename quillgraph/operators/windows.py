"""Ordered operators: chains of hashes, averages, limiters, eviction and edges of alerts. Ties are broken by an id."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from quillgraph.operators import scan

# Points, seconds and seconds of blocking of the preset limiters.
LIMITERS = {"auth_login": (5, 300, 900), "api_user": (1000, 3600, 3600), "search": (100, 60, 60), "file_ops": (50, 60, 120), "ip_general": (200, 60, 300)}


def moving_average(rows: DataFrame, by: str, order: list[str], value: str, old: float = 0.8, new: float = 0.2) -> DataFrame:
    """Per key the exponential average after its last row, from the first one's value.

    A chunk of rows is folded to its number and the average it adds; chunks are weighted by how many rows come after them. Only
    the first row's value counts whole. So a key's rows may lie in many tasks.
    """
    held = scan.chunks(rows.select(by, *order, value), by, order)
    w = W.partitionBy(scan.KEY, scan.CHUNK)
    ranked = held.withColumn("__i", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.count("*").over(w))
    added = F.sum(F.col(value) * new * F.pow(F.lit(old), F.col("__n") - F.col("__i")))
    parts = scan.summaries(ranked, added=added, n=F.count("*"), first=F.min_by(value, F.struct(*order)), key=F.first(by))
    chunk = W.partitionBy(scan.KEY).orderBy(scan.CHUNK)
    after = F.coalesce(F.sum("n").over(chunk.rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    start = F.when(F.row_number().over(chunk) == 1, F.col("first") * (1 - new) * F.pow(F.lit(old), F.col("n") - 1)).otherwise(0.0)
    each = parts.withColumn("ema", (F.col("added") + start) * F.pow(F.lit(old), after))
    return each.groupBy(F.col("key").alias(by)).agg(F.sum("ema").alias("ema"), F.sum("n").alias("n"))


def running(rows: DataFrame, by: str, order: list[str], value: str, ok: str) -> DataFrame:
    """rows with the mean of value and the share of ok up to each, nulls left out; a key's rows may lie in many tasks."""
    good = F.col(ok).cast("double")
    one = lambda c: c.isNotNull().cast("long")
    held = scan.totals(scan.chunks(rows, by, order), order, __s=F.col(value), __n=one(F.col(value)), __g=good, __m=one(good))
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return scan.plain(held.withColumn("running_mean", share("__s", "__n")).withColumn("success_rate", share("__g", "__m"))).drop("__s", "__n", "__g", "__m")


def sliding_limiter(calls: DataFrame, by: str, order: tuple[str, str], limit: int, window_s: float) -> DataFrame:
    """calls with `allowed`: fewer than limit accepted calls in the window before; refused calls don't count.

    order: the second and an id. What a call gets depends on all before it, so each key's calls stream in order through one
    worker; the state is its accepted times within the window, `limit` at most.
    """

    def new() -> Callable[[float], bool]:
        accepted: deque[float] = deque()

        def step(t: float) -> bool:
            while accepted and accepted[0] <= t - window_s:
                accepted.popleft()
            if len(accepted) >= limit:
                return False
            accepted.append(t)
            return True

        return step

    return _in_order(calls, by, order, new)


def block_limiter(calls: DataFrame, by: str, order: tuple[str, str], preset: str | tuple[int, int, int]) -> DataFrame:
    """calls with `allowed`: windows from a key's first call with so many points; a call beyond blocks the key for a while.

    order: the second and an id. Where a window begins, the next one's first call follows from that call alone: the first at or
    after the window's end, or at or after the block that the call beyond the points begins. So every call points to another one,
    and the calls that do begin windows are found by doubling these pointers. No key's calls are in one task.
    """
    points, duration, block = LIMITERS[preset] if isinstance(preset, str) else preset
    second, ident = order
    flat = calls.select(by, ident, F.col(second).cast("double").alias(second))
    placed = scan.totals(scan.chunks(flat, by, [second, ident]), [second, ident], place=F.lit(1)).withColumn("t", F.col(second)).checkpoint()
    beyond = placed.select(scan.KEY, (F.col("place") - points).alias("place"), F.col("t").alias("__over"))
    window = placed.join(beyond, [scan.KEY, "place"], "left")
    blocked = F.col("__over") < F.col("t") + duration
    soonest = F.col("place") + F.when(blocked, points + 1).otherwise(1)  # behind the call that begins the block, though it be of no length
    asked = window.select(scan.KEY, "place", F.when(blocked, F.col("__over") + block).otherwise(F.col("t") + duration).alias("t"), soonest.alias("soonest"))
    # calls before a time, for all times at once: both sorted together, times first where they tie
    both = asked.withColumn("kind", F.lit(0)).unionByName(placed.select(scan.KEY, "place", "t", F.lit(None).cast("long").alias("soonest"), F.lit(1).alias("kind")))
    merged = scan.chunks(both.withColumnRenamed(scan.KEY, "__of"), "__of", ["t", "kind", "place"])
    counted = scan.totals(merged, ["t", "kind", "place"], to=F.col("kind")).filter("kind = 0").select(F.col("__of").alias(scan.KEY), "place", F.greatest(F.col("to") + 1, "soonest").alias("to"))
    pointers = counted.join(placed.select(scan.KEY, F.col("place").alias("to")), [scan.KEY, "to"], "left_semi")
    starts = scan.reached(pointers, placed.filter("place = 1")).withColumn("__start", F.lit(True))
    marked = placed.join(starts, [scan.KEY, "place"], "left")
    last = scan.totals(marked, [second, ident], largest=("__last",), __last=F.when(F.col("__start"), F.col("place")))
    return last.select(by, ident, second, (F.col("place") - F.col("__last") < points).alias("allowed"))


def _in_order(calls: DataFrame, by: str, order: tuple[str, str], new: Callable[[], Callable[[float], bool]]) -> DataFrame:
    """by, order's columns and `allowed`: what a fresh step function for each key says of its calls in order."""
    second, ident = order
    flat = calls.select(by, ident, F.col(second).cast("double").alias(second))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, step = None, None
        for pdf in frames:
            out = []
            for k, t in zip(pdf[by], pdf[second], strict=True):
                if step is None or k != key:
                    key, step = k, new()
                out.append(step(t))
            yield pdf.assign(allowed=out)

    return flat.repartition(by).sortWithinPartitions(by, second, ident).mapInPandas(run, StructType([*flat.schema.fields, *StructType.fromDDL("allowed boolean").fields]))


def attention(items: DataFrame) -> DataFrame:
    """items with weight (priority times importance, twice that if focused) and attention, its share of the session's."""
    weight = F.col("priority") * F.col("importance") * F.when(F.col("focused"), 2.0).otherwise(1.0)
    return items.withColumn("weight", weight).withColumn("attention", F.coalesce(F.try_divide(F.col("weight"), F.sum("weight").over(W.partitionBy("session"))), F.lit(0.0)))


def evict(items: DataFrame, capacity: int = 20, share: float = 0.2) -> DataFrame:
    """items with `evicted`: in sessions of capacity or more the least important unfocused ones, share of capacity."""
    per, drop = W.partitionBy("session"), max(1, int(capacity * share))
    rank = F.row_number().over(per.orderBy(F.col("focused").cast("int"), "importance", "id"))
    return items.withColumn("evicted", (F.count("*").over(per) >= capacity) & ~F.col("focused") & (rank <= drop))


def lru(entries: DataFrame, capacity: int, now_s: Column, ttl_s: int = 3600, buckets: int = 64) -> DataFrame:
    """entries with `kept`: not older than ttl, and among the `capacity` last used. The bound is found by the two-step top-n, not by one task's sort."""
    alive = entries.filter(F.col("created_s") + ttl_s > now_s)
    top = alive.select("last_s", "key").orderBy(F.desc("last_s"), "key").limit(capacity).withColumn("kept", F.lit(True))
    return entries.join(top, ["last_s", "key"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def transitions(samples: DataFrame, by: str, order: list[str], triggered: Column) -> DataFrame:
    """The rows where triggered changes: `fired` on each rising edge and `resolved` on each falling one; off before the first."""
    now = scan.chunks(samples.withColumn("triggered", F.coalesce(triggered, F.lit(False))), by, order)
    was = F.coalesce("__was", F.lit(False))
    edge = F.when(F.col("triggered") & ~was, "fired").when(~F.col("triggered") & was, "resolved")
    return scan.plain(scan.shifted(now, order, __was=F.col("triggered")).withColumn("transition", edge)).drop("__was").filter("transition IS NOT NULL")


def trend(samples: DataFrame, by: str, second: str, value: str, now_s: Column, window_s: int = 300, stable: float = 1000.0) -> DataFrame:
    """Per key the change a second over the window before now, and its direction; between -stable and stable it is none."""
    recent = samples.filter((F.col(second) > now_s - window_s) & (F.col(second) <= now_s))
    first, last = F.min_by(value, F.struct(second, value)), F.max_by(value, F.struct(second, value))
    rate = F.coalesce(F.try_divide(last - first, F.max(second) - F.min(second)), F.lit(0.0))
    return recent.groupBy(by).agg(F.count("*").alias("n"), rate.alias("rate"), F.when(F.abs(rate) < stable, "stable").when(rate > 0, "increasing").otherwise("decreasing").alias("direction"))


def run_trend(runs: DataFrame, order: list[str], total: str) -> DataFrame:
    """runs with trend against the one before: more than a tenth up or down, else stable."""
    before = F.lag(total).over(W.orderBy(*order))
    return runs.withColumn("trend", F.when(before.isNull(), "stable").when(F.col(total) > before * 1.1, "increasing").when(F.col(total) < before * 0.9, "decreasing").otherwise("stable"))


def first_of(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("__n = 1").drop("__n")


def admitted(accepted: list[float], times: Iterable[float], limit: int, window_s: float) -> tuple[list[float], list[bool]]:
    """The accepted times after taking each time in order, and whether each is: fewer than limit accepted in the window up to it."""
    held, out = sorted(accepted), []
    for t in times:
        ok = bisect_right(held, t) - bisect_right(held, t - window_s) < limit
        out.append(ok)
        if ok:
            insort(held, t)
    return held, out
