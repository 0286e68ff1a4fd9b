"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance 2r share a variant within r of both. So every distinct fingerprint emits all variants within
half the radius (RADIUS 2: itself and 64 with one bit changed) and the variants shuffle. A variant's fingerprints all lie
within r of it, so there are 65 at most and no variant is hot; each is linked to the least of them and the distance
verified. The links' components give the documents' groups. Equal fingerprints are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import attach, extended, prepare, release, table
from quillgraph.llm.exact import order_of, suspects

WORDS, SEED, RADIUS, BLOCK = 3, 42, 2, 1 << 14


def fingerprint(text: str, words: int = WORDS) -> int:
    """Bit i is 1 if set in over half the XXH64 of the word shingles, as a signed 64-bit number; 0 without words."""
    w = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and ASCII white space
    if not w:
        return 0
    joined = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else iter((b" ".join(w),))
    n = max(1, len(w) - words + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, text: str = "text", words: int = WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, fingerprint (long); a null text counts as empty."""
    prepare(df.sparkSession)
    out, schema = extended(df.select(*keep), "fingerprint long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t.as_py() or "", words) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.int64())], schema=schema)

    return df.select(*keep, F.col(f"`{text}`").alias("__text")).mapInArrow(run, out)


def links(classes: DataFrame, key: str = "fingerprint") -> DataFrame:
    """a, b: links between distinct fingerprints within RADIUS, enough to connect what is connected.

    A variant's fingerprints differ from it in one bit or none, so they are one number, a bit for each, combined before they
    shuffle; each is linked to the least of them.
    """
    bits = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    flips = F.array(*(F.lit(b).cast("long") for b in (0, *bits)))
    variants = classes.select(F.col(key).alias("b"), F.explode(flips).alias("flip")).select(F.col("b").bitwiseXOR(F.col("flip")).alias("variant"), "flip")
    met = variants.groupBy("variant").agg(F.bit_or("flip").alias("flips"), F.max(F.col("flip") == 0).alias("itself"))
    met = met.filter(F.bit_count("flips") + F.col("itself").cast("int") > 1)
    v, set_ = F.col("variant"), F.col("flips")
    members = F.array(F.when(F.col("itself"), v), *(F.when(set_.bitwiseAND(F.lit(b)) != 0, v.bitwiseXOR(F.lit(b))) for b in bits))
    near = met.select(F.filter(members, lambda x: x.isNotNull()).alias("all")).select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
    near = near.filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
    return near.distinct()


def components(edges: DataFrame) -> DataFrame:
    """vertex, label: the least vertex of its component, for every vertex of the edges (a, b).

    Each round takes the least label among neighbours, then that label's label, until nothing changes. Labels only fall, and
    jumping to the label's label halves the way to the least one, so rounds grow with the logarithm of the longest path. A
    vertex with many links (2080 at most) and a label with many vertices go by `attach`, so neither meets in one task, and
    minima are combined before they shuffle. A round's tables go once the next round has used them.
    """
    both = table(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    start = both.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("links")).select(F.col("u").alias("vertex"), F.least("u", "v").alias("label"), "links")
    labels = table(start)
    n, total = labels.count(), both.count()
    while True:
        of_v = labels.select(F.col("vertex").alias("v"), "label", "links")
        near = attach(both, of_v, "v", "links", total).groupBy(F.col("u").alias("vertex")).agg(F.min("label").alias("near"))
        lower = table(labels.join(near, "vertex").select("vertex", F.least("label", "near").alias("label"), F.col("label").alias("was"), "links"))
        held = lower.groupBy("label").agg(F.count("*").alias("members"))
        of_label = table(held.join(lower.select(F.col("vertex").alias("label"), F.col("label").alias("next")), "label"))
        after = table(attach(lower, of_label, "label", "members", n).select("vertex", F.least("label", "next").alias("label"), "was", "links"))
        release(labels, lower, of_label)
        labels = after
        if after.filter("label != was").isEmpty():
            release(both)
            return labels.select("vertex", "label")


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable; null if none has an id).

    Repeated rows and ids are rows of their own; empty and null texts have fingerprint zero.
    """
    rows = table(fingerprints(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), words=words))
    return labelled(rows).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def labelled(rows: DataFrame) -> DataFrame:
    """rows (doc_id, fingerprint, perhaps more) with `first`: the least by (no id, id, more) of the rows reachable, and `size`, how many of them are alike in these."""
    more = [c for c in rows.columns if c not in ("doc_id", "fingerprint")]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *more))
    classes = table(rows.groupBy("fingerprint").agg(first.alias("first"), F.count("*").alias("size")))
    labels = components(links(classes))
    linked = table(classes.join(labels.withColumnRenamed("vertex", "fingerprint"), "fingerprint"))
    of_label = table(linked.groupBy("label").agg(F.min("first").alias("least"), F.count("*").alias("members")))
    n = of_label.agg(F.sum("members")).first()[0] or 0
    joined = attach(linked.select("fingerprint", "label"), of_label, "label", "members", n).select("fingerprint", "least")
    whole = table(classes.join(joined, "fingerprint", "left").select("fingerprint", F.coalesce("least", "first").alias("first"), "size"))
    total = whole.agg(F.sum("size")).first()[0] or 0
    return attach(rows, whole, "fingerprint", "size", total)


def distinct(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of df that stay, with all columns: of each group one row, that with the smallest doc_id.

    Rows are told apart by id and text (as a hash of 128 bits), so texts that share an id don't go together. Null ids come last;
    of rows tied on the id the one with the least hash stays, and of rows that repeat both exactly one.
    """
    mark = F.concat_ws("-", F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.xxhash64(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`")))
    own = df.select(F.col(f"`{doc_id}`").alias("doc_id"), mark.alias("mark"), F.col(f"`{text}`").alias("text"))
    rows = labelled(table(fingerprints(own, words=words, keep=("doc_id", "mark"))))
    stays = F.col("mark").eqNullSafe(F.col("first.mark")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    marks = table(rows.select("doc_id", "mark", stays.alias("stays")))
    gone = table(marks.filter("NOT stays").select("mark").distinct())
    # rows alike in id and text have one mark; where the row that stays is repeated, its copies are asked too and made one
    again = marks.filter("stays").groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select("mark")
    called = table(gone.unionByName(again))
    held = df.select(mark.alias("mark"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("own"))
    found = suspects(held, "mark", called, called.count(), 1)
    asked = found.filter("maybe").select("row.mark", "row.own").groupBy("mark").agg(F.min_by("own", order_of(df, doc_id, "own")).alias("own"))
    back = asked.join(gone, "mark", "left_anti")
    return found.filter("NOT maybe").select("row.own").unionByName(back.select("own")).select(*(F.col(f"own.`{c}`").alias(c) for c in df.columns))
