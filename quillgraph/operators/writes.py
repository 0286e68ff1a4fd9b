"""State changes as functions from frames to frames: the new state is written as a whole, then swapped in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.functions import text as T

# What a new node has where nothing is given.
NODE_DEFAULTS = {"access_count": 0, "importance": 0.5, "confidence": 1.0}


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with their key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return old.join(gone.select(key), key, "left_anti")


def create_nodes(rows: DataFrame, now: Column) -> DataFrame:
    """Nodes with defaults, a kind inferred where none is given, timestamps, and `_error` where a value isn't valid."""
    out = rows
    for name, value in NODE_DEFAULTS.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value))
    given = F.col("node_type") if "node_type" in rows.columns else None
    out = out.withColumn("node_type", T.node_type(F.col("content"), given))
    for name in ("created_at", "updated_at", "accessed_at"):
        out = out.withColumn(name, F.coalesce(F.col(name), now) if name in rows.columns else now)
    return schemas.check(out, {"node_type": schemas.NODE_TYPES}, ("importance", "confidence"), ("id", "content"))


def with_kind_fields(nodes: DataFrame) -> DataFrame:
    """Columns that depend on the kind: a fact is unverified, an event lasts 0 s, a question is open, a memory decays."""
    kind = F.col("node_type")
    return (
        nodes.withColumn("verified", F.when(kind == "fact", F.lit(False)))
        .withColumn("duration", F.when(kind == "event", F.lit(0.0)))
        .withColumn("answered", F.when(kind == "question", F.lit(False)))
        .withColumn("decay_rate", F.when(kind == "memory", F.lit(0.1)))
        .withColumn("title", F.when(kind == "document", T.title(F.col("content"))))
    )


def patch(nodes: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """nodes with the values of changes where they aren't null; the key itself doesn't change."""
    new = changes.select(key, *(F.col(c).alias(f"__{c}") for c in changes.columns if c != key))
    both = nodes.join(new, key, "left")
    return both.select(*(F.coalesce(f"__{c}", c).alias(c) if c in changes.columns and c != key else F.col(c) for c in nodes.columns))


def forget(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both without the nodes of gone (ids) and the edges at either end."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left.select(*edges.columns)


def reinforce(nodes: DataFrame, touches: DataFrame, amount: float = 0.1) -> DataFrame:
    """importance up by amount for each touch, 1 at most, and the counters by one; touches: id, a row each."""
    n = touches.groupBy("id").agg(F.count("*").alias("__n"))
    out = nodes.join(n, "id", "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    out = out.withColumn("importance", F.least(F.lit(1.0), F.col("importance") + amount * F.col("__n")))
    for c in ("access_count", "reinforcement"):
        if c in nodes.columns:
            out = out.withColumn(c, F.col(c) + F.col("__n"))
    return out.drop("__n")


def decay_idle(nodes: DataFrame, now_s: Column, interval_s: int) -> DataFrame:
    """Short-term and working memories that weren't used for the interval lose decay_rate of importance and confidence."""
    idle = F.col("memory_type").isin("short_term", "working") & (F.col("accessed_s") + interval_s < now_s)
    return nodes.withColumns({c: F.when(idle, F.col(c) * (1 - F.col("decay_rate"))).otherwise(F.col(c)) for c in ("importance", "confidence")})


def decay_old(nodes: DataFrame, before_s: Column, importance: float = 0.9, confidence: float = 0.95) -> DataFrame:
    """Nodes created before that matter more than 0.1 fade; `decayed` tells which."""
    old = (F.col("created_s") < before_s) & (F.col("importance") > 0.1)
    out = nodes.withColumn("decayed", old)
    return out.withColumn("importance", F.when(old, F.col("importance") * importance).otherwise(F.col("importance"))).withColumn("confidence", F.when(F.col("decayed"), F.col("confidence") * confidence).otherwise(F.col("confidence")))


def consolidate(nodes: DataFrame, threshold: int = 5) -> DataFrame:
    """Short-term memories reinforced often enough become long-term, half as important again, 1 at most."""
    due = (F.col("memory_type") == "short_term") & (F.col("reinforcement") >= threshold)
    return nodes.withColumns({"memory_type": F.when(due, "long_term").otherwise(F.col("memory_type")), "importance": F.when(due, F.least(F.lit(1.0), F.col("importance") * 1.5)).otherwise(F.col("importance"))})


def promote(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The given working memories become long-term, half as important again, 1 at most."""
    out = nodes.join(ids.select("id").distinct().withColumn("__due", F.lit(True)), "id", "left")
    due = F.coalesce("__due", F.lit(False)) & (F.col("memory_type") == "working")
    return out.withColumns({"memory_type": F.when(due, "long_term").otherwise(F.col("memory_type")), "importance": F.when(due, F.least(F.lit(1.0), F.col("importance") * 1.5)).otherwise(F.col("importance"))}).drop("__due")


def focus(items: DataFrame, session: str, ids: list) -> DataFrame:
    """The session's focus is set to ids, whose priority rises by 0.2, 1 at most; its others lose focus."""
    own, chosen = F.col("session") == session, F.col("id").isin(*ids) if ids else F.lit(False)
    return items.withColumns({"focused": F.when(own, chosen).otherwise(F.col("focused")), "priority": F.when(own & chosen, F.least(F.lit(1.0), F.round(F.col("priority") + 0.2, 10))).otherwise(F.col("priority"))})


def clear_session(items: DataFrame, session: str) -> DataFrame:
    return items.filter(F.col("session") != session)


def touch(nodes: DataFrame, hit: Column, now_s: Column) -> DataFrame:
    """Nodes that match are marked as used now."""
    return nodes.withColumns({"accessed_s": F.when(hit, now_s).otherwise(F.col("accessed_s")), "access_count": F.when(hit, F.col("access_count") + 1).otherwise(F.col("access_count"))})


def set_importance(nodes: DataFrame, values: DataFrame, now_s: Column) -> DataFrame:
    """values: id, importance."""
    return patch(nodes, values.withColumn("updated_s", now_s))


def remove_file(entities: DataFrame, paths: DataFrame) -> DataFrame:
    return entities.join(paths.select("file_path").distinct(), "file_path", "left_anti")


def apply_batch(nodes: DataFrame, edges: DataFrame, created: DataFrame | None = None, changed: DataFrame | None = None, gone: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All of a batch's operations as one new state: creations, then changes, then removals."""
    if created is not None:
        nodes = upsert(nodes, created, "id")
    if changed is not None:
        nodes = patch(nodes, changed)
    return forget(nodes, edges, gone) if gone is not None else (nodes, edges)


def embed_missing(rows: DataFrame, embed, text: str = "content", vector: str = "embedding") -> DataFrame:  # noqa: ANN001
    """rows with a vector where there was none; drop the column first to compute all anew."""
    have = F.col(vector) if vector in rows.columns else F.lit(None).cast("array<float>")
    return rows.withColumn(vector, F.coalesce(have, embed(F.col(text))))


def ttl(nodes: DataFrame, edges: DataFrame, now_s: Column) -> DataFrame:
    """nodes with `expired`: working memories of an hour below 0.3, any of a week below 0.1, isolated ones of a day."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("__linked", F.lit(True))
    age = now_s - F.col("created_s")
    out = nodes.join(ends, "id", "left")
    rule = ((age > 3600) & (F.col("importance") < 0.3) & (F.col("memory_type") == "working")) | ((F.col("importance") < 0.1) & (age > 7 * 86400)) | (F.col("__linked").isNull() & (age > 86400))
    return out.withColumn("expired", rule).drop("__linked")
