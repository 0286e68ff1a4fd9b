"""An inverted-file index of vectors: rows in lists by their nearest centre; a search compares with the nearest lists only.

Centres are fitted on a bounded sample (SAMPLE rows by a hash of the key); every row is indexed. How many lists a search takes is
tuned against exact results of a few rows until the wanted recall is met; with all lists it is exact. Cosine similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from quillgraph.operators.graph import keep

#: Rows that centres are fitted on at most, about; lists at most; rows that a task compares at once; rows that tuning asks for.
SAMPLE, LISTS, PART_ROWS, ASKED = 20_000, 4096, 20_000, 64


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def stacked(column: pa.Array) -> np.ndarray:
    return unit(np.stack([np.asarray(v, np.float32) for v in column.to_pylist()])) if len(column) else np.zeros((0, 1), np.float32)


def share_of(df: DataFrame, key: str, rows: int, n: int, salt: str) -> DataFrame:
    """About so many rows, by a hash of the key."""
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, rows / max(1, n))))


def fit(vectors: DataFrame, key: str = "id", vector: str = "embedding", lists: int | None = None, rounds: int = 8) -> np.ndarray:
    """Centres by spherical k-means over a sample; by default as many as the root of the rows, LISTS at most."""
    known = vectors.filter(F.col(vector).isNotNull())
    n = known.count()
    rows = sorted(share_of(known, key, SAMPLE, n, "fit").select(F.xxhash64(F.col(key)).alias("h"), F.col(vector).cast("array<float>").alias("v")).collect(), key=lambda r: r["h"])
    m = unit(np.array([r["v"] for r in rows], np.float32)) if rows else np.zeros((1, 1), np.float32)
    k = max(1, min(lists or int(n**0.5), LISTS, len(m)))
    centres = m[np.linspace(0, len(m) - 1, k).astype(int)]
    for _ in range(rounds):
        nearest = np.concatenate([(m[i : i + 2000] @ centres.T).argmax(axis=1) for i in range(0, len(m), 2000)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, m)
        used = np.bincount(nearest, minlength=k) > 0
        centres = np.where(used[:, None], unit(sums), centres)
    return centres


def build(vectors: DataFrame, centres: np.ndarray, key: str = "id", vector: str = "embedding") -> DataFrame:
    """key, v, list, part of every row with a vector. A list of more than PART_ROWS rows is dealt to several parts, so that none is hot."""
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("v"))
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("list int").fields])
    arrow, shared = to_arrow_schema(schema), vectors.sparkSession.sparkContext.broadcast(centres)  # LISTS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = stacked(batch.column(1))
            nearest = (m @ shared.value.T).argmax(axis=1) if len(m) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nearest, pa.int32())], schema=arrow)

    listed = keep(rows.mapInArrow(run, schema))
    parts = listed.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    return keep(listed.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int")))


def search(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int = 10, probes: int = 8, key: str = "id", vector: str = "embedding") -> DataFrame:
    """query, key, similarity, rank: of each query's `probes` nearest lists the k most similar other rows; ties by key."""
    asked = queries.filter(F.col(vector).isNotNull()).select(F.col(key).alias("query"), F.col(vector).cast("array<float>").alias("q"))
    schema = StructType([*asked.schema.fields, *StructType.fromDDL("lists array<int>").fields])
    arrow, shared, probes = to_arrow_schema(schema), index.sparkSession.sparkContext.broadcast(centres), min(probes, len(centres))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = stacked(batch.column(1))
            lists = np.argsort(-(m @ shared.value.T), axis=1, kind="stable")[:, :probes].astype(np.int32).tolist() if len(m) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, arrow.field(2).type)], schema=arrow)

    parts = index.select(F.col("list").alias("list"), F.col("parts").alias("parts_of")).distinct()
    sent = asked.mapInArrow(near, schema).select("query", "q", F.explode("lists").alias("list")).join(F.broadcast(parts), "list").select("query", "q", "list", "parts_of").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts_of") - 1)))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            rows, keys = unit(np.stack(right["v"].to_numpy()).astype(np.float64)), right["key"].to_numpy()
            for at in range(0, len(left), 200):
                some = left.iloc[at : at + 200]
                s = unit(np.stack(some["q"].to_numpy()).astype(np.float64)) @ rows.T
                s[some["query"].to_numpy()[:, None] == keys[None, :]] = -9
                for i, query in enumerate(some["query"]):
                    best = np.lexsort((keys, -np.round(s[i], 9)))[:k]
                    out.append(pd.DataFrame({"query": query, "key": keys[best], "similarity": s[i][best]}))
        found = pd.concat(out) if out else pd.DataFrame({"query": [], "key": [], "similarity": []})
        return found[found["similarity"] > -2]

    kind = dict(index.dtypes)["key"]
    found = sent.groupBy("list", "part").cogroup(index.groupBy("list", "part")).applyInPandas(compare, f"query {kind}, key {kind}, similarity double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "key"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact results that were found."""
    both = exact.select("query", "key").join(found.select("query", "key", F.lit(1).alias("hit")), ["query", "key"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hit")).first()
    return both["hit"] / both["n"] if both["n"] else 1.0


def tune(index: DataFrame, centres: np.ndarray, vectors: DataFrame, k: int = 10, wanted: float = 0.95, key: str = "id", vector: str = "embedding") -> int:
    """The least number of lists, doubling, whose results for about ASKED rows have the wanted recall; all lists at the most."""
    n = index.count()
    some = keep(share_of(vectors.filter(F.col(vector).isNotNull()), key, ASKED, n, "tune"))
    exact, probes = keep(search(index, centres, some, k, len(centres), key, vector)), 1
    while probes < len(centres) and recall(search(index, centres, some, k, probes, key, vector), exact) < wanted:
        probes *= 2
    return min(probes, len(centres))
