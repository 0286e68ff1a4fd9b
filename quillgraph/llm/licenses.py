"""License scans by diagonal voting.

Templates are short phrases and longer notices. Every rolling k-gram of a document's words is hashed and joined to the
templates' positions; a hit at word p of position t votes for the diagonal p - t. Votes are added by diagonal (combined
before they shuffle), each diagonal of a longer template is merged with its neighbours (words put in or left out), and the
span counts if enough of its template is covered: all of a phrase, NOTICE_COVER of a notice. Of verified spans on neighbouring
diagonals the best covered one stays, so stray hits beside a span neither stretch nor hide it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillgraph.llm.common import extended, hold, prepare

# The phrases whose places are counted, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Passages of public licenses and the notices they ask for.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under the gnu general public license version", "gpl"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("licensed under cc by nd", "cc-by-nd"),
)

#: k of the rolling grams: phrases and notices of up to LONG words vote with pairs, longer ones with four words.
SHORT_K, LONG_K, LONG = 2, 4, 8
#: Share of a notice's grams that a span must have; a diagonal is merged with those this near on both sides.
NOTICE_COVER, NEAR = 0.6, 8
#: Bits of a mask; a template has at most MASKS times as many grams.
BITS, MASKS = 62, 3
SENTINEL = -1

_WORD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


class Hashes(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = Hashes()


def words_of(text: str) -> list[bytes]:
    """Words in UTF-8: runs of digits, letters (A-Z lowered) and characters beyond ASCII."""
    return text.encode("utf-8", "replace").translate(_WORD).split()


def grams(words: list[bytes], k: int, hashes: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the rolling k-grams, as int64."""
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)) if hashes is None else hashes
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out += h[i : i + n] * _MIX[i]
        out ^= out >> np.uint64(29)
    out = out.view(np.int64)
    return np.where(out == SENTINEL, 0, out)


def templates(spark: SparkSession, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """hash, k, template, label, base, grams, at: a row for each gram position, as many as the templates have words at most."""
    rows = [(SENTINEL, 0, -1, "", False, 1, 0)]
    for i, (text, label) in enumerate((*phrases, *notices)):
        words = words_of(text)
        k = SHORT_K if i < len(phrases) or len(words) <= LONG else LONG_K
        found = grams(words, k).tolist()
        if not found or len(found) > BITS * MASKS:
            raise ValueError(f"a template has {k} to {BITS * MASKS + k - 1} words: {text[:60]!r}")
        rows += [(h, k, i, label, i < len(phrases), len(found), at) for at, h in enumerate(found)]
    return spark.createDataFrame(rows, "hash long, k int, template int, label string, base boolean, grams int, at int")


def hashed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_key, n_words and hashes: the sentinel, then all pairs', then all four-grams' hashes in order."""
    out, schema = extended(df.select(F.col(doc_id).alias("doc_id")), "text_key long, n_words long, hashes array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("licenses", _HASHES.clear)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                keys, counts, parts = [], [], []
                for t in part.column(1).to_pylist():
                    words = words_of(t)
                    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
                    keys.append(xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) - (1 << 63))
                    counts.append(len(words))
                    parts.append(np.concatenate([[SENTINEL], grams(words, SHORT_K, h), grams(words, LONG_K, h)]).astype(np.int64))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), lists.cast(schema.field(3).type)], schema=schema)

    return df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, out)


def _mask(i: int) -> Column:
    return F.expr(f"CASE WHEN at >= {BITS * i} AND at < {BITS * (i + 1)} THEN shiftleft(1L, at - {BITS * i}) ELSE 0L END")


def spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """Verified spans and a row for each document: doc_id, text_key, n_words, copies, template, label, base, first, last, cover.

    Every document has a row with template -1, in which copies tells how many rows have its id and text; all other rows are
    spans of words first to last, in any order. Rows are found by id and text together, so repeated ids don't mix and repeated rows
    give each span once. Null texts count as empty; null ids are a value like any other.
    """
    prepare(df.sparkSession)
    key = ["doc_id", "text_key", "n_words"]
    all_grams = hashed(df, doc_id, text).select(*key, F.posexplode("hashes").alias("pos", "hash"))
    hits = all_grams.join(F.broadcast(templates(df.sparkSession, phrases, notices)), "hash")  # as large as the templates
    word = F.expr(f"CASE k WHEN 0 THEN 0 WHEN {SHORT_K} THEN pos - 1 ELSE pos - greatest(n_words, 1) END")
    votes = (
        hits.withColumn("diagonal", word - F.col("at"))
        .groupBy(*key, "template", "label", "base", "grams", "k", "diagonal")
        .agg(*(F.bit_or(_mask(i)).alias(f"m{i}") for i in range(MASKS)), F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n"))
        .repartition("doc_id", "text_key")  # what is left is a row for each diagonal; all that follows goes by document
    )
    by_template = W.partitionBy(*key, "template").orderBy("diagonal")
    beside = by_template.rangeBetween(-NEAR, NEAR)
    alone = F.col("base") | (F.col("k") <= SHORT_K)
    own = sum((F.bit_count(f"m{i}") for i in range(MASKS)), F.lit(0))
    merged = sum((F.bit_count(F.bit_or(f"m{i}").over(beside)) for i in range(MASKS)), F.lit(0))
    start, end = F.col("diagonal") + F.col("lo"), F.col("diagonal") + F.col("hi") + F.col("k") - 1
    found = votes.withColumn("cover", F.when(alone, own).otherwise(merged) / F.col("grams"))
    found = found.withColumn("first", F.when(alone, start).otherwise(F.min(start).over(beside))).withColumn("last", F.when(alone, end).otherwise(F.max(end).over(beside)))
    verified = found.filter((F.col("template") < 0) | (F.col("cover") >= F.when(alone, 1.0).otherwise(NOTICE_COVER)))
    apart = F.when(alone | (F.col("diagonal") - F.lag("diagonal").over(by_template) > NEAR), 1).otherwise(0)
    clusters = verified.withColumn("apart", apart).withColumn("cluster", F.sum("apart").over(by_template))
    best = F.max(F.struct("cover", -F.col("first"), -F.col("last")))
    one = clusters.groupBy(*key, "template", "label", "base", "cluster").agg(best.alias("best"), F.sum("n").alias("copies"))
    return one.select(*key, "copies", "template", "label", "base", (-F.col("best.col2")).alias("first"), (-F.col("best.col3")).alias("last"), F.col("best.cover").alias("cover"))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """Per row of df: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best span's cover, else 0)."""
    found = spans(df, doc_id, text, phrases, notices)
    base, hit = F.col("base"), F.col("template") >= 0
    joined = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    docs = found.groupBy("doc_id", "text_key", "n_words").agg(
        F.sum(F.when(base, 1).otherwise(0)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(hit).alias("labels"),
        F.coalesce(F.max(F.when(hit, F.col("cover"))), F.lit(0.0)).alias("score"),
        F.max(F.when(~hit, F.col("copies"))).alias("copies"),
    )
    return docs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("text_key", "copies", "copy")


def _templates_sql(phrases: tuple, notices: tuple) -> str:
    rows = []
    for i, (text, label) in enumerate((*phrases, *notices)):
        k = SHORT_K if i < len(phrases) or len(text.split()) <= LONG else LONG_K
        rows.append(f"({i}, '{label}', {i < len(phrases)}, {k}, '{text}')")
    return f"(VALUES {', '.join(rows)}) AS v(i, label, base, k, phrase)"


#: DuckDB: grams compared as words, and neighbouring diagonals by a self-join.
SQL = rf"""
WITH t AS (SELECT i, label, base, k, string_split(phrase, ' ') AS w FROM {_templates_sql(PHRASES, NOTICES)}),
tg AS (SELECT i, label, base, k, len(w) - k + 1 AS grams, place, array_to_string(w[place + 1:place + k], ' ') AS g FROM (SELECT *, unnest(range(0, len(w) - k + 1)) AS place FROM t)),
d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT n, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
ahead AS (SELECT n, p, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS e FROM words WINDOW o AS (PARTITION BY n ORDER BY p)),
grams AS (SELECT n, p, 2 AS k, a || ' ' || b AS g FROM ahead WHERE b IS NOT NULL UNION ALL SELECT n, p, 4, a || ' ' || b || ' ' || c || ' ' || e FROM ahead WHERE e IS NOT NULL),
hits AS (SELECT n, i, label, base, tg.k, grams, p - place AS diagonal, place FROM grams JOIN tg ON tg.k = grams.k AND tg.g = grams.g),
alone AS (SELECT n, label, base, diagonal, count(DISTINCT place) / grams AS cover FROM hits WHERE base OR k = {SHORT_K} GROUP BY n, i, label, base, diagonal, grams),
places AS (SELECT DISTINCT n, i, diagonal FROM hits WHERE NOT base AND k > {SHORT_K}),
merged AS (SELECT p.n, h.label, h.base, p.diagonal, count(DISTINCT h.place) / h.grams AS cover FROM places p JOIN hits h ON h.n = p.n AND h.i = p.i AND abs(h.diagonal - p.diagonal) <= {NEAR} GROUP BY p.n, p.i, h.label, h.base, p.diagonal, h.grams),
verified AS (SELECT * FROM alone WHERE cover >= 1 UNION ALL SELECT * FROM merged WHERE cover >= {NOTICE_COVER}),
found AS (SELECT n, count(*) FILTER (base) AS n_base, min(diagonal) FILTER (base) AS first_word, max(diagonal) FILTER (base) AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(cover) AS score FROM verified GROUP BY n)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN found USING (n)
"""
