"""Simple directed cycles of a graph whose edges fit each task's memory: 8 bytes an edge, 24 a vertex.

Starts are taken in batches. Steps back from a batch's starts note how near each vertex is to its start; walks ahead go on only
to vertices near enough to close in time, so hardly any walk is made in vain, and none leaves its task. Notes are in a table by
hash, where two vertices may share a place: that only lets a walk go on, as closing edges are looked up exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegralType, StructType

from quillgraph.session import ship

#: Walks that are lengthened at once, vertices noted for a batch of starts (about), the table's places as a power of two, and rows of a batch of results.
CHUNK, NOTED, PLACES, ROWS = 1 << 18, 1 << 17, 22, 20_000

#: ids (ascending), where each vertex's edges ahead begin, their ends, where its edges back begin, their ends.
Graph = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def fits(links: DataFrame, most: int) -> bool:
    """Whether links (src, dst) are whole numbers and not more than so many; other ids have no bound on their size."""
    kinds = [links.schema[c].dataType for c in ("src", "dst")]
    return kinds[0] == kinds[1] and isinstance(kinds[0], IntegralType) and links.count() <= most


def load(links: DataFrame) -> Graph:
    """The graph of distinct links without loops."""
    ends = links.select(F.col("src").cast("long").alias("id")).union(links.select(F.col("dst").cast("long"))).distinct().toArrow()
    ids = np.sort(ends.column(0).to_numpy())
    ranks = [np.zeros((2, 0), np.int32)]
    for batch in links.select(F.col("src").cast("long"), F.col("dst").cast("long")).toArrow().to_batches():
        ranks.append(np.stack([np.searchsorted(ids, c.to_numpy()) for c in batch.columns]).astype(np.int32))
    src, dst = np.concatenate(ranks, axis=1)
    return ids, *by_rows(src, dst, len(ids)), *by_rows(dst, src, len(ids))


def by_rows(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(a, minlength=n), out=at[1:])
    return at, b[np.argsort(a, kind="stable")]


def walks(at: np.ndarray, to: np.ndarray, edges: int) -> np.ndarray:
    """How many walks of so many edges begin in each vertex."""
    n = np.ones(len(at) - 1)
    for _ in range(edges):
        total = np.concatenate([[0.0], np.cumsum(n[to])])
        n = total[at[1:]] - total[at[:-1]]
    return n


def pieces(at: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of ends with about CHUNK edges each, one end at least."""
    cut = np.flatnonzero(np.diff(np.cumsum(at[ends + 1] - at[ends]) // CHUNK)) + 1
    yield from zip([0, *cut.tolist()], [*cut.tolist(), len(ends)])


def steps(at: np.ndarray, to: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All edges of the ends: the end's place among them and the vertex stepped to."""
    n = at[ends + 1] - at[ends]
    edge = np.repeat(at[ends] - np.cumsum(n) + n, n)
    edge += np.arange(len(edge))
    return np.repeat(np.arange(len(ends), dtype=np.int32), n), to[edge]


def among(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which keys are in held (ascending)."""
    if not len(held):
        return np.zeros(len(keys), bool)
    return held[np.minimum(np.searchsorted(held, keys), len(held) - 1)] == keys


def places(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PLACES)).astype(np.int64)


def note(graph: Graph, starts: np.ndarray, depth: int, near: np.ndarray) -> np.ndarray:
    """Puts to near, by place, how many edges (depth at most) lead from a vertex above its start to it; the keys of one edge, ascending."""
    n, back_at, back = len(graph[0]), graph[3], graph[4]
    near.fill(255)
    first = known = None
    row, at = np.arange(len(starts), dtype=np.int64), starts
    for d in range(1, depth + 1):
        found = [np.zeros(0, np.int64)]
        for a, b in pieces(back_at, at):
            i, v = steps(back_at, back, at[a:b])
            own = row[a:b][i]
            above = v > starts[own]
            keys = own[above] * n + v[above]
            place = places(keys)
            near[place[near[place] > d]] = d
            if d < depth or d == 1:  # the farthest are only noted
                found.append(np.unique(keys))
        new = np.unique(np.concatenate(found))
        if d == 1:
            first = known = new
        elif d < depth:
            new = new[~among(new, known)]
            known = np.sort(np.concatenate([known, new]))
        row, at = new // n, new % n
    return first


def found(graph: Graph, starts: np.ndarray, lengths: frozenset[int], near: np.ndarray) -> Iterator[np.ndarray]:
    """The cycles whose least vertices are the starts, as ranks, one cycle a row."""
    n, ahead_at, ahead = len(graph[0]), graph[1], graph[2]
    longest = max(lengths)
    depth = max(1, longest // 2)
    closing = note(graph, starts, depth, near)

    def go(row: np.ndarray, walk: list[np.ndarray]) -> Iterator[np.ndarray]:
        edges = len(walk) + 1  # of the walks made here
        at = walk[-1] if walk else starts[row]
        for a, b in pieces(ahead_at, at):
            i, v = steps(ahead_at, ahead, at[a:b])
            above = v > starts[row[a:b]][i]
            i, v = i[above], v[above]
            keys = row[a:b][i].astype(np.int64) * n + v
            left = near[places(keys)]
            ok = left <= longest - edges if edges >= longest - depth else np.ones(len(v), bool)
            for c in walk[:-1]:
                ok &= c[a:b][i] != v
            i, v, keys, left = i[ok], v[ok], keys[ok], left[ok]
            if edges + 1 in lengths:
                last = np.flatnonzero(left == 1)
                last = last[among(keys[last], closing)]
                if len(last):
                    yield np.stack([starts[row[a:b][i[last]]], *(c[a:b][i[last]] for c in walk), v[last]], axis=1)
            if edges + 1 < longest and len(v):
                yield from go(row[a:b][i], [*(c[a:b][i] for c in walk), v])

    yield from go(np.arange(len(starts), dtype=np.int32), [])


def rounds(links: DataFrame, shared, lengths: Iterable[int], number: int) -> list[DataFrame]:
    """cycle (array), length of the simple cycles of the shared graph, by rounds of least vertices; nothing is kept or sorted."""
    spark, lengths = links.sparkSession, frozenset(lengths)
    ship(spark)
    tasks = -(-4 * spark.sparkContext.defaultParallelism // number)
    slices = tasks * number  # a slice has every so-manieth vertex, as low ones have the most walks
    kind = links.schema["src"].dataType.simpleString()
    schema = StructType.fromDDL(f"cycle array<{kind}>, length int")
    arrow = to_arrow_schema(schema)
    of_ids = arrow.field(0).type

    def batch(held: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.concatenate([np.full(len(h), h.shape[1], np.int32) for h in held])
        ids = shared.value[0][np.concatenate([h.ravel() for h in held])]
        at = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at, pa.array(ids).cast(of_ids.value_type), type=of_ids), pa.array(sizes)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, near = shared.value, np.empty(1 << PLACES, np.uint8)
        n, weight, held = len(graph[0]), None, []
        for part in batches:
            for first in part.column(0).to_pylist():
                if weight is None:
                    weight = 1 + np.minimum(walks(graph[3], graph[4], max(0, max(lengths) // 2 - 1)), n)
                starts = np.arange(first, n, slices)
                cut = np.flatnonzero(np.diff(np.cumsum(weight[starts]) // NOTED)) + 1
                for own in np.split(starts.astype(np.int32), cut):
                    for rows in found(graph, own, lengths, near):
                        for a in range(0, len(rows), ROWS):
                            held.append(rows[a : a + ROWS])
                            if sum(map(len, held)) >= ROWS:
                                yield batch(held)
                                held = []
        if held:
            yield batch(held)

    return [spark.range(r * tasks, (r + 1) * tasks, 1, tasks).mapInArrow(run, schema) for r in range(number if lengths else 0)]
