"""Text, line and hybrid search over documents and nodes."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from quillgraph.functions import text as T


def terms_of(query: str) -> list[str]:
    return [w for w in query.lower().split() if w]


def phrase_score(text: Column, query: str, fuzzy: bool = False) -> Column:
    """1 if the text has the phrase; fuzzy: how many of its words the text has. Case doesn't matter."""
    low = F.lower(text)
    if not fuzzy:
        return F.contains(low, F.lit(query.lower())).cast("int")
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in terms_of(query)], F.lit(0))


def search_documents(docs: DataFrame, query: str, limit: int = 50, category: str | None = None, include_content: bool = True, fuzzy: bool = False, directory: str | None = None) -> DataFrame:
    """Documents by score, then path, with score and snippet. Predicates are applied before the text is looked at."""
    rows = docs
    if category:
        rows = rows.filter(F.col("category") == category)
    if directory:
        rows = rows.filter(F.startswith("path", F.lit(directory.rstrip("/") + "/")))
    meta = F.col("metadata") if "metadata" in docs.columns else F.lit("{}")
    text = F.concat_ws(" ", "content", meta) if include_content else meta
    return rows.withColumn("score", phrase_score(text, query, fuzzy)).filter("score > 0").orderBy(F.desc("score"), "path").limit(limit).withColumn("snippet", T.snippet(F.col("content"), query))


def search_newest(docs: DataFrame, query: str, category: str | None = None, limit: int = 50) -> DataFrame:
    """Documents that have the query, whatever the case, newest first."""
    rows = docs.filter(F.contains(F.lower("content"), F.lit(query.lower())))
    rows = rows.filter(F.col("category") == category) if category else rows
    return rows.orderBy(F.desc("modified"), "path").limit(limit)


def search_lines(docs: DataFrame, query: str, context: int = 2, max_hits: int | None = None, line_width: int | None = None, context_width: int | None = None) -> DataFrame:
    """A row for each line that has the query: path, line (from 1), content, context (the lines around, clipped at the ends).

    With max_hits the first hits by path and line; widths cut lines and contexts.
    """
    low = query.lower()
    numbered = F.transform("__lines", lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    # only hits are exploded, so that a document's lines are copied once for each hit and not for each line
    hits = F.filter(numbered, lambda s: F.contains(F.lower(s["line"]), F.lit(low)))
    split = docs.filter(F.contains(F.lower("content"), F.lit(low))).select("path", T.lines(F.col("content")).alias("__lines"))
    hit = split.select("path", "__lines", F.explode(hits).alias("__hit")).select("path", "__lines", F.col("__hit.at").alias("__at"), F.col("__hit.line").alias("content"))
    start = F.greatest(F.lit(0), F.col("__at") - context)
    around = F.array_join(F.slice("__lines", start + 1, F.col("__at") + context + 1 - start), "\n")
    cut = lambda c, n: F.substring(c, 1, n) if n else c
    out = hit.select("path", (F.col("__at") + 1).alias("line"), cut(F.col("content"), line_width).alias("content"), cut(around, context_width).alias("context"))
    return out.orderBy("path", "line").limit(max_hits) if max_hits else out


def term_score(text: Column, query: str) -> Column:
    """The share of the query's distinct words that the text has."""
    terms = sorted(set(terms_of(query)))
    return phrase_score(text, " ".join(terms), fuzzy=True) / float(max(1, len(terms)))


def keywords(docs: DataFrame, key: str = "doc_id", text: str = "text", top: int = 10, by: str = "") -> DataFrame:
    """Per row its most frequent words of more than 3 characters with count and rank; ties by word.

    A row's words are counted within the row, in Arrow batches, so nothing shuffles.
    """
    kind = StructType.fromDDL("words array<struct<word: string, n: bigint, rank: int>>")
    schema = StructType([docs.schema[key], *kind.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = []
                for words in part.column(1).to_pylist():
                    best = heapq.nsmallest(top, ((-n, w) for w, n in Counter(words or ()).items()))
                    found.append([{"word": w, "n": -n, "rank": i} for i, (n, w) in enumerate(best, 1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, arrow.field(1).type)], schema=arrow)

    each = docs.select(key, T.words(F.col(text), by=by).alias("__words")).mapInArrow(run, schema)
    return each.select(key, F.inline("words"))


def hybrid_rank(nodes: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Nodes with `rank_score` from importance, confidence, recency (accessed over now, seconds), access count and kind; best first."""
    score = (
        0.3 * F.col("importance") + 0.2 * F.col("confidence") + 0.2 * (F.col("accessed_s") / now) + 0.1 * F.least(F.col("access_count") / 100, F.lit(1.0))
        + F.when(F.col("node_type").isin("fact", "insight", "memory"), 0.2).otherwise(0.0)
    )
    out = nodes.withColumn("rank_score", score)
    return out.orderBy(F.desc(F.round("rank_score", 6)), "id").limit(limit) if limit else out


def hybrid_search(hits: list[DataFrame], now: Column, limit: int = 20) -> DataFrame:
    """Hits of several searches (same columns) as one list: each id once, from the last search that has it; best first."""
    union = reduce(DataFrame.unionByName, [h.withColumn("__source", F.lit(i)) for i, h in enumerate(hits)])
    last = F.row_number().over(W.partitionBy("id").orderBy(F.desc("__source")))
    return hybrid_rank(union.withColumn("__n", last).filter("__n = 1").withColumn("source", F.col("__source")).drop("__n", "__source"), now, limit)


def tree(docs: DataFrame) -> DataFrame:
    """dir, entry, is_dir: what each folder holds, folders first."""
    parts = docs.select(F.split("path", "/").alias("p"))
    level = parts.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("i"))
    rows = level.select(F.array_join(F.slice("p", 1, F.col("i") - 1), "/").alias("dir"), F.element_at("p", F.col("i")).alias("entry"), (F.col("i") < F.size("p")).alias("is_dir"))
    return rows.distinct()
