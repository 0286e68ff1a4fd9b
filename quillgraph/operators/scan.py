"""Segmented parallel scans: ordered operators over keys whose rows don't fit a task.

Rows are sorted once by key and order over all tasks, so a key's rows lie in as many chunks as it needs. Each chunk is folded to
a summary (sums, counts, last values); the few summaries of a key are scanned in order; and what comes before a chunk is put to
the rows of that chunk. A chunk is never larger than a task's share of the sort, whatever the keys are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillgraph.session import shared_dir

KEY, CHUNK, END = "__key", "__chunk", "__end"


def chunks(rows: DataFrame, by: str | list[str], order: list) -> DataFrame:
    """rows with their key (null keys are a key) and chunk, kept in the shared folder, as chunks must not change between passes.

    order must be total within a key (end in an id), or rows that tie may be dealt either way.
    """
    shared_dir(rows.sparkSession)
    keyed = rows.withColumn(KEY, F.struct(*([by] if isinstance(by, str) else by)))
    return keyed.orderBy(KEY, *order).withColumn(CHUNK, F.spark_partition_id()).checkpoint()


def plain(chunked: DataFrame) -> DataFrame:
    """Without the columns that chunks adds."""
    return chunked.drop(KEY, CHUNK, END)


def ended(chunked: DataFrame) -> DataFrame:
    """chunked with END: whether a row's key is the least or the greatest of its chunk. No other key can lie in two chunks.

    So summaries are made of two keys a chunk, whatever the number of keys, and are few enough to be broadcast.
    """
    if END in chunked.columns:
        return chunked
    bounds = chunked.groupBy(CHUNK).agg(F.min(KEY).alias("__least"), F.max(KEY).alias("__most"))
    return chunked.join(F.broadcast(bounds), CHUNK).withColumn(END, (F.col(KEY) == F.col("__least")) | (F.col(KEY) == F.col("__most"))).drop("__least", "__most")


def summaries(chunked: DataFrame, **folds: Column) -> DataFrame:
    """A row for each key and chunk with aggregates of its rows."""
    return chunked.groupBy(KEY, CHUNK).agg(*(c.alias(n) for n, c in folds.items()))


def before(found: DataFrame, **folds: Column) -> DataFrame:
    """key and chunk of summaries with aggregates over the same key's earlier chunks. A key has at most as many chunks as there are tasks."""
    w = W.partitionBy(KEY).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    return found.select(KEY, CHUNK, *(c.over(w).alias(n) for n, c in folds.items()))


def totals(chunked: DataFrame, order: list, largest: tuple[str, ...] = (), smallest: tuple[str, ...] = (), **values: Column) -> DataFrame:
    """chunked with running sums of values up to and with each row, in order; of those named in `largest` or `smallest`, running maxima or minima.

    Nulls count for nothing; a sum of nothing is 0 and a maximum or minimum of nothing null.
    """
    w = W.partitionBy(KEY, CHUNK, END).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)  # with END, so that filters on it go below
    fold = {n: F.max if n in largest else F.min if n in smallest else F.sum for n in values}
    held = ended(chunked).select("*", *(v.alias(f"__v_{n}") for n, v in values.items()))
    earlier = before(summaries(held.filter(END), **{n: fold[n](f"__v_{n}") for n in values}), **{f"__b_{n}": fold[n](n) for n in values})
    out = held.join(F.broadcast(earlier), [KEY, CHUNK], "left")
    for n in values:
        own, old = fold[n](f"__v_{n}").over(w), F.col(f"__b_{n}")
        pick = F.greatest if n in largest else F.least
        out = out.withColumn(n, pick(own, old) if n in (*largest, *smallest) else F.coalesce(own, F.lit(0)) + F.coalesce(old, F.lit(0)))
    return out.drop(*(f"__{k}_{n}" for n in values for k in "vb"))


def shifted(chunked: DataFrame, order: list, **values: Column) -> DataFrame:
    """chunked with the values of the row before, in order; null for a key's first row.

    order: names of columns.
    """
    chunked = ended(chunked)
    w = W.partitionBy(KEY, CHUNK, END).orderBy(*order)
    one = F.struct(*(v.alias(n) for n, v in values.items()))
    held = chunked.withColumn("__one", one)
    last = summaries(held.filter(END), last=F.max_by("__one", F.struct(*order)))
    earlier = last.select(KEY, CHUNK, F.lag("last").over(W.partitionBy(KEY).orderBy(CHUNK)).alias("__last"))
    out = held.join(F.broadcast(earlier), [KEY, CHUNK], "left").withColumn("__was", F.when(F.row_number().over(w) == 1, F.col("__last")).otherwise(F.lag("__one").over(w)))
    return out.select(*chunked.columns, *(F.col("__was")[n].alias(n) for n in values))


def reached(pointers: DataFrame, starts: DataFrame) -> DataFrame:
    """key and place of all places that starts (key, place) lead to along pointers (key, place, to; to lies behind place).

    By doubling: pointers of 1, 2, 4 and so on steps, each round joined by place, so the number of rounds is the logarithm of the
    longest way and no key's places are in one task. A null `to` ends a way.
    """
    shared_dir(pointers.sparkSession)
    step = pointers.filter("to > place").select(KEY, "place", "to").checkpoint()
    found = starts.select(KEY, "place").checkpoint()
    while not step.isEmpty():
        more = found.join(step, [KEY, "place"]).select(KEY, F.col("to").alias("place"))
        found = found.unionByName(more).distinct().checkpoint()
        then = step.select(KEY, F.col("place").alias("to"), F.col("to").alias("__far"))
        step = step.join(then, [KEY, "to"]).select(KEY, "place", F.col("__far").alias("to")).checkpoint()
    return found
