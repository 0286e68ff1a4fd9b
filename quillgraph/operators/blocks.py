"""Similarity joins of vectors by blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows of a block; how many blocks there are before they get larger.
BLOCK, BLOCKS = 2000, 24


def dealt(rows: DataFrame, key: str, vector: str, within: str | None = None) -> DataFrame:
    """Rows (k, v, g) sent to each pair of blocks (place, x, y) that they are compared in; b is a row's own block.

    Rows are dealt by hash to about n / size blocks, and every pair of blocks is one group: each row is sent to as many
    groups as there are blocks, which is what an exact comparison of all rows costs. Blocks have BLOCK rows; where that makes
    more than BLOCKS of them, up to three times as many, so that less is sent. With `within` a value has blocks of its
    own, as many as its rows need, and values of few rows share blocks, so nothing is sent to where it can have no partner.
    """
    flat = rows.select(F.col(key).alias("k"), F.col(vector).cast("array<float>").alias("v"), (F.col(within).cast("string") if within else F.lit("")).alias("g"))
    flat = flat.filter("g IS NOT NULL")
    n = rows.count()
    size = min(3 * BLOCK, max(BLOCK, n // BLOCKS))
    sizes = flat.groupBy("g").agg(F.count("*").alias("n"))
    # groups of at most a block go to shared bins; a larger one, of which there are n / size at most, is its own place
    large = sizes.filter(F.col("n") > size).select("g", F.ceil(F.col("n") / size).cast("int").alias("blocks"))
    bins = max(1, -(-n // size))
    bin_ = F.concat(F.lit("bin "), F.pmod(F.xxhash64("g"), F.lit(bins)).cast("string"))
    placed = flat.join(F.broadcast(large), "g", "left").withColumn("place", F.when(F.col("blocks").isNotNull(), F.concat(F.lit("own "), "g")).otherwise(bin_))
    placed = placed.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("b", F.pmod(F.xxhash64("k"), "blocks").cast("int"))
    return placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("k", "v", "g", "place", "b", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"))


def hits(pdf: pd.DataFrame, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys a < b and similarity of one group's pairs at or above the threshold, some rows at a time."""
    x, y = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
    m = np.stack(pdf["v"].to_numpy()).astype(np.float64)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    m = np.divide(m, length, out=np.zeros_like(m), where=length > 0)
    left, right = np.flatnonzero(pdf["b"] == x), np.flatnonzero(pdf["b"] == y)
    keys, groups = pdf["k"].to_numpy(), pdf["g"].to_numpy()
    other = np.ascontiguousarray(m[right].T)
    for at in range(0, len(left), 500):
        part = left[at : at + 500]
        s = m[part] @ other
        i, j = np.nonzero(s >= threshold - 1e-12)
        a, b = part[i], right[j]
        good = (keys[a] < keys[b]) if x == y else np.ones(len(a), bool)
        good &= groups[a] == groups[b]
        a, b, s = a[good], b[good], s[i, j][good]
        swap = keys[a] > keys[b]
        yield np.where(swap, keys[b], keys[a]), np.where(swap, keys[a], keys[b]), s


def pairs(rows: DataFrame, key: str, vector: str, threshold: float, within: str | None = None) -> DataFrame:
    """a < b, similarity (cosine) for all pairs at or above the threshold; with `within`, only pairs of one value of it."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([pd.DataFrame({"a": a, "b": b, "similarity": s}) for a, b, s in hits(pdf, threshold)] or [pd.DataFrame({"a": [], "b": [], "similarity": []})])

    sent = dealt(rows, key, vector, within)
    kind = dict(sent.dtypes)["k"]
    return sent.groupBy("place", "x", "y").applyInPandas(compare, f"a {kind}, b {kind}, similarity double")


def nearest(rows: DataFrame, key: str, vector: str, threshold: float, most: int) -> DataFrame:
    """src, dst: each row's first partners at or above the threshold, by similarity at seven digits (highest first) and dst.

    A group of blocks gives each of its rows' first partners alone, so what is sorted grows with rows and blocks, not with pairs.
    """

    def first(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["src", "near", "dst"], ascending=[True, False, True])
        return found[found.groupby("src").cumcount() < most]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"src": pdf["k"].iloc[:0], "dst": pdf["k"].iloc[:0], "near": np.zeros(0, np.int64)})
        for a, b, s in hits(pdf, threshold):
            near = np.floor(s * 1e7 + 0.5).astype(np.int64)
            out = first(pd.concat([out, pd.DataFrame({"src": np.concatenate([a, b]), "dst": np.concatenate([b, a]), "near": np.concatenate([near, near])})]))
        return out

    sent = dealt(rows, key, vector)
    kind = dict(sent.dtypes)["k"]
    found = sent.groupBy("place", "x", "y").applyInPandas(compare, f"src {kind}, dst {kind}, near long")
    place = F.row_number().over(W.partitionBy("src").orderBy(F.desc("near"), "dst"))
    return found.withColumn("place", place).filter(F.col("place") <= most).select("src", "dst")
