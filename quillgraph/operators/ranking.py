"""Sorted and limited results: top-k by vectors, importance, severity or debt. Every order ends in an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillgraph.functions import vector as V
from quillgraph.schemas import ordinal


def by_type(nodes: DataFrame, node_type: str, limit: int = 100) -> DataFrame:
    return nodes.filter(F.col("node_type") == node_type).orderBy(F.desc("importance"), F.desc("created_s"), "id").limit(limit)


def working_context(items: DataFrame, session: str, limit: int = 10) -> DataFrame:
    return items.filter(F.col("session") == session).orderBy(F.desc("focused"), F.desc("priority"), F.desc("accessed_s"), "id").limit(limit)


def similarity(metric: str) -> object:
    return {"cosine": V.cosine, "euclid": V.euclid}[metric]


def nearest(vectors: DataFrame, query: list[float] | Column, k: int = 10, threshold: float = 0.5, key: str = "id", vector: str = "embedding", metric: str = "cosine", types: tuple[str, ...] | None = None) -> DataFrame:
    """The k rows most similar to the query vector, exact, with `similarity`; a top-k without a full sort. Kinds are filtered first."""
    rows = vectors.filter(F.col(vector).isNotNull())
    rows = rows.filter(F.col("node_type").isin(*types)) if types else rows
    q = query if isinstance(query, Column) else F.array(*(F.lit(float(x)) for x in query))
    return rows.withColumn("similarity", similarity(metric)(F.col(vector), q)).filter(F.col("similarity") >= threshold).orderBy(F.desc(F.round("similarity", 9)), key).limit(k)


def query_vector(vectors: DataFrame, ident, key: str = "id", vector: str = "embedding") -> list[float]:  # noqa: ANN001
    row = vectors.filter(F.col(key) == ident).select(F.col(vector).cast("array<double>")).first()
    if row is None:
        raise KeyError(ident)
    return row[0]


def similar_to(vectors: DataFrame, ident, k: int = 10, threshold: float = 0.5, key: str = "id", vector: str = "embedding", metric: str = "cosine") -> DataFrame:  # noqa: ANN001
    """The k rows most similar to one of them, itself left out."""
    return nearest(vectors.filter(F.col(key) != ident), query_vector(vectors, ident, key, vector), k, threshold, key, vector, metric)


def candidates_then_cut(vectors: DataFrame, query: list[float], k: int = 10, threshold: float = 0.5, key: str = "id", vector: str = "embedding") -> DataFrame:
    """2k candidates, then the threshold, then k: as an index would be used."""
    return nearest(vectors, query, 2 * k, -2.0, key, vector).filter(F.col("similarity") >= threshold).orderBy(F.desc(F.round("similarity", 9)), key).limit(k)


def similar_pairs(vectors: DataFrame, threshold: float, key: str = "id", vector: str = "embedding", within: str | None = None) -> DataFrame:
    """a < b and similarity of pairs at or above the threshold, exact, in blocks of rows joined to blocks; with `within`, only in one group.

    Blocks are BLOCK rows, compared by matrix products; each pair of blocks is a task of its own, so no task holds more than two.
    """
    from quillgraph.operators.blocks import pairs

    return pairs(vectors.filter(F.col(vector).isNotNull()), key, vector, threshold, within)


def findings(rows: DataFrame, min_confidence: float = 0.5, min_severity: str | None = None, name: str | None = None, limit: int | None = None) -> DataFrame:
    """By severity, then confidence, then id."""
    out = rows.filter(F.col("confidence") >= min_confidence)
    out = out.filter(ordinal(F.col("severity")) >= ordinal(F.lit(min_severity))) if min_severity else out
    out = out.filter(F.contains(F.lower("name"), F.lit(name.lower()))) if name else out
    out = out.orderBy(F.desc(ordinal(F.col("severity"))), F.desc("confidence"), "id")
    return out.limit(limit) if limit else out


def insights(rows: DataFrame) -> DataFrame:
    """By severity (critical, warning, info), confidence and magnitude."""
    level = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "warning", 2).otherwise(1)
    size = F.when(F.col("magnitude") == "high", 3).when(F.col("magnitude") == "medium", 2).otherwise(1)
    return rows.orderBy(F.desc(level), F.desc("confidence"), F.desc(size), "id")


def debt_plan(items: DataFrame) -> DataFrame:
    """Debt items in order (priority, then hours) with their phase: the first five, the next five, the rest.

    Only the first ten need an order over all rows, which a top-10 gives.
    """
    first = items.orderBy(F.desc("priority"), "hours", "id").limit(10)
    phased = first.withColumn("n", F.row_number().over(W.orderBy(F.desc("priority"), "hours", "id"))).select("id", F.when(F.col("n") <= 5, 1).otherwise(2).alias("phase"))
    return items.join(F.broadcast(phased), "id", "left").withColumn("phase", F.coalesce("phase", F.lit(3)))  # ten rows


def issues(rows: DataFrame, limit: int | None = None) -> DataFrame:
    out = rows.orderBy(F.desc(F.coalesce(ordinal(F.col("severity")), F.lit(0))), F.desc("created_s"), "id")
    return out.limit(limit) if limit else out


def page(rows: DataFrame, order: str, descending: bool = True, offset: int = 0, limit: int = 1000, ident: str = "event_id") -> DataFrame:
    return rows.orderBy(F.desc(order) if descending else F.asc(order), ident).offset(offset).limit(limit)


def debt_flags(functions: DataFrame, complexity: int = 10, lines: int = 100, limit: int = 50) -> DataFrame:
    """Functions over either bound by how many they are over, then complexity."""
    score = (F.col("complexity") > complexity).cast("int") + (F.col("line_count") > lines).cast("int")
    return functions.withColumn("debt_score", score).filter("debt_score > 0").orderBy(F.desc("debt_score"), F.desc("complexity"), "id").limit(limit)


def top(rows: DataFrame, by: str, ident: str, n: int = 5) -> DataFrame:
    return rows.orderBy(F.desc(by), ident).limit(n)


def quick_wins(items: DataFrame) -> DataFrame:
    return items.filter("hours <= 4 AND priority >= 70").orderBy(F.desc("priority"), "id").limit(5)


def major(items: DataFrame) -> DataFrame:
    return items.filter("hours > 16 AND severity = 'high'").orderBy(F.desc("priority"), "id").limit(3)
