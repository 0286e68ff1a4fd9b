"""A graph memory as a whole: storing across nodes, vectors and edges, with contradictions, insights and hooks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions import vector as V
from quillgraph.operators import graph, writes

#: What hooks can be given for; each is called on the driver with the frame concerned.
EVENTS = ("before_store", "after_store", "before_update", "after_update", "before_delete", "after_delete")


@dataclass
class Memory:
    """nodes (with node_type, content, embedding) and edges (src, dst, edge_type, weight). Methods give a new memory."""

    nodes: DataFrame
    edges: DataFrame
    hooks: dict[str, list[Callable[[DataFrame], None]]] = field(default_factory=dict)

    def on(self, event: str, hook: Callable[[DataFrame], None]) -> Memory:
        if event not in EVENTS:
            raise ValueError(f"no event {event!r}")
        return replace(self, hooks={**self.hooks, event: [*self.hooks.get(event, []), hook]})

    def tell(self, event: str, rows: DataFrame) -> None:
        for hook in self.hooks.get(event, []):
            hook(rows)

    def store(self, new: DataFrame, now: Column, embed, similar: float = 0.7) -> tuple[Memory, DataFrame]:  # noqa: ANN001
        """The memory with the valid rows of new, vectors and CONTRADICTS edges, and the rows that aren't valid.

        New facts are compared with the facts that share a word of four letters or more with them.
        """
        self.tell("before_store", new)
        checked = graph.keep(writes.embed_missing(writes.create_nodes(new, now), embed))
        good = checked.filter("_error IS NULL").drop("_error")
        nodes = writes.upsert(self.nodes, good, "id")
        edges = self.edges.unionByName(contradiction_edges(good, nodes, similar), allowMissingColumns=True)
        self.tell("after_store", good)
        return replace(self, nodes=nodes, edges=edges), checked.filter("_error IS NOT NULL")

    def update(self, changes: DataFrame) -> Memory:
        self.tell("before_update", changes)
        out = replace(self, nodes=writes.patch(self.nodes, changes))
        self.tell("after_update", changes)
        return out

    def forget(self, gone: DataFrame) -> Memory:
        self.tell("before_delete", gone)
        nodes, edges = writes.forget(self.nodes, self.edges, gone)
        self.tell("after_delete", gone)
        return replace(self, nodes=nodes, edges=edges)

    def insights(self, limit: int = 20) -> DataFrame:
        """a, b, c and what their kinds suggest."""
        found = graph.wedges(self.edges, self.nodes, limit=limit)
        for k in ("a", "b", "c"):
            found = found.join(self.nodes.select(F.col("id").alias(k), F.col("node_type").alias(f"{k}_type"), F.col("content").alias(f"{k}_text")), k)
        text = T.insight_text(*(F.col(f"{k}_{x}") for k in ("a", "b", "c") for x in ("type", "text")))
        return found.select("a", "b", "c", text.alias("insight")).filter("insight IS NOT NULL")


def contradiction_edges(new: DataFrame, nodes: DataFrame, similar: float) -> DataFrame:
    """CONTRADICTS edges from new facts to facts that are similar and deny them. Pairs come from shared words, each once."""
    facts = lambda rows, k: rows.filter("node_type = 'fact'").select(F.col("id").alias(k), F.col("content").alias(f"{k}_text"), F.col("embedding").alias(f"{k}_v"))
    words = lambda c: F.array_distinct(T.words(F.col(c)))
    a, b = facts(new, "src"), facts(nodes, "dst")
    # of a pair's shared words only the least counts, so that a pair is one row whatever it shares
    left = a.select("src", words("src_text").alias("src_words")).withColumn("word", F.explode("src_words"))
    right = b.select("dst", words("dst_text").alias("dst_words")).withColumn("word", F.explode("dst_words"))
    pairs = left.join(right, "word").filter((F.col("src") != F.col("dst")) & (F.col("word") == F.array_min(F.array_intersect("src_words", "dst_words")))).select("src", "dst")
    near = pairs.join(a, "src").join(b, "dst")
    hit = near.filter(T.contradicts(F.col("src_text"), F.col("dst_text")) & (V.cosine(F.col("src_v"), F.col("dst_v")) >= similar))
    return hit.select("src", "dst", F.lit("CONTRADICTS").alias("edge_type"), V.cosine(F.col("src_v"), F.col("dst_v")).alias("weight"))
