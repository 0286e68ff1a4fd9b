"""Vector arithmetic on array columns, in doubles and within the JVM; only the embedder is a pandas UDF."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile("[a-z0-9]+")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def normalise(v: Column) -> Column:
    """To length 1; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """0 if one of them is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def euclid(a: Column, b: Column) -> Column:
    """Similarity 1 / (1 + distance)."""
    return 1 / (1 + F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)))


def hashed_embedding(size: int = 384):
    """A deterministic embedder, text to array<float> of length 1: signed counts of words by hashed place. Another model's UDF can take its place."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            h = np.array([zlib.crc32(w.encode()) for w in WORD.findall((text or "").lower())], np.int64)
            v = np.bincount(h % size, 1.0 - 2.0 * (h >> 31), size) if len(h) else np.zeros(size)
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32))
        return pd.Series(out)

    return embed
