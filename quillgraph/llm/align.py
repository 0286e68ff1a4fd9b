"""Alignment of two tokenizers: which tokens of one cover the same bytes as which tokens of the other, and how often.

A text is tokenised by A (byte-level BPE) and by B (pieces with a space before each word). Byte offsets where tokens of both end
cut it into groups; all tokens of A in a group are linked to all of B. The pairs of a document, each with how often it is
linked, are its postings. A task's postings are put together by pair, and these blocks are shuffled by A's id: a task gets an
id's blocks as a stream sorted by B's id, sums the documents of each pair and finds the highest sum, in buffers that spill, and
emits what each document gets from them; that is summed by document. An id with very many postings is split by pair and block
instead of going to one task.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from quillgraph.llm.bpe import SPACE, byte_alphabet
from quillgraph.llm.common import HOT_SHARE, attach, hold, plain_names, prepare, quoted, remove, shared_dir, table

#: Where byte-level files split texts.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Stretches that no token of either side crosses: from a space after something else up to the next such space.
STRETCHES = re.compile(rf"[{SPACE}]*[^{SPACE}]+(?:(?! )[{SPACE}]+(?:[^{SPACE}]+|\Z))*|[{SPACE}]+")
#: White space that keeps a space after it in its stretch.
BEFORE = [c + " " for c in "\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
#: Stretches that are encoded in one go (fewer than 2 ** 19, as texts of a batch, to be put before a pair's 44 bits).
TOGETHER = 1000
#: Known stretches after which they are forgotten, and characters above which one isn't kept.
CACHE, LONG = 400_000, 48
#: Postings that a task puts together, about; links of a group above which its pairs are counted by distinct ids.
BLOCK, LARGE = 2_000_000, 10_000
#: Contributions that are added up by document before they leave a task: few, so that their number stays in proportion to postings.
ADDED = 50_000
#: A pair as one number of 44 bits: A's id moved by so many, and B's.
SHIFT = 24
STATS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class ByteModel:
    """A byte-level BPE file of the tokenizers library: ids of texts, with special strings as plain text, and each token's bytes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back, vocab = {c: i for i, c in enumerate(byte_alphabet())}, spec["model"]["vocab"]
        tokens = {t: i for t, i in vocab.items() if all(c in back for c in t)}
        self.bytes = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.bytes[i] = bytes(back[c] for c in token)
        added = {t["content"] for t in spec.get("added_tokens", [])}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ranks = [vocab[left + right] for left, right in pairs]
        first = max((vocab[c] for c in back if c in vocab), default=0)
        plain = spec.get("normalizer") is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if plain and ranks == sorted(ranks) and ranks[0] > first and all(c in vocab for c in back):
            # ids are ranks of merges, so a faster encoder of the same kind gives the same ids
            import tiktoken

            known = {self.bytes[i]: i for t, i in tokens.items() if t not in added}
            one = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=known, special_tokens={}).encode_ordinary
            self.encode = one
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        model.encode_special_tokens = True
        self.encode = lambda text: model.encode(text, add_special_tokens=False).ids


class PieceModel:
    """A sentencepiece model: ids of texts, and each piece's bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # a space can't be inside or at the end of a piece with other characters, and spaces are kept, with one more before
        kept = "".join(self.model.encode(" a  b ", out_type=str)) == "▁▁a▁▁b▁"
        self.space = self.model.piece_to_id("▁")
        self.parts_at_spaces = kept and pieces[self.space] == "▁" and not any("▁" in p.lstrip("▁") for i, p in enumerate(pieces) if not self.model.is_byte(i))

    def stretches(self, text: str) -> list[str]:
        """Parts that are encoded independently, with a space before each; together they are a space and the text."""
        if not text:
            return []
        if not self.parts_at_spaces:
            return [text]
        if text[0] != " " and text[-1] != " " and not any(b in text for b in BEFORE):
            return text.split(" ")  # words, some with white space inside or at the end of the last one
        return [p[1:] for p in STRETCHES.findall(" " + text)]

    def encode(self, text: str) -> list[int]:
        """Ids of a space and the text. The model adds the space itself, but not to nothing."""
        return self.model.encode(text) if text else [self.space]


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


@lru_cache(maxsize=1)
def byte_model(path: str) -> ByteModel:
    return ByteModel(path)


class Grown:
    """An array of rows that is added to."""

    def __init__(self, width: int) -> None:
        self.rows, self.n = np.zeros((1 << 12, width), np.int64), 0

    def add(self, rows: np.ndarray) -> None:
        while self.n + len(rows) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.n : self.n + len(rows)] = rows
        self.n += len(rows)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, each with the sum of its counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(counts, starts)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on for each start, count of them."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Aligner:
    """Tokenises by both sides and aligns, each distinct stretch once; stretches are numbers, rows of growing tables.

    For a stretch: its numbers of tokens of A and B, of groups and links; where its pairs start and how many there are; the text
    of its groups. A row of pairs is a pair's number and how often it is linked.
    """

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = byte_model(a_path), piece_model(b_path)
        self.a_len, self.b_len = (np.array([len(t) for t in m.bytes], np.int64) for m in (self.a, self.b))
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.stats, self.pairs, self.shown = Grown(6), Grown(2), []

    def add(self, parts: list[str]) -> list[int]:
        """Tokenise and align parts, each with a space before it; the number of each, or -1 where a side's bytes differ from it.

        Parts are encoded in one go, as no token crosses the space between them, unless one ends in white space. Where that
        isn't so, or bytes differ, each goes by itself.
        """
        text = " ".join(parts)
        a, b = self.a.encode(" " + text), self.b.encode(text)
        data = (" " + text).encode("utf-8", "replace")
        if not all(b"".join([m.bytes[i] for i in ids]) == data for m, ids in ((self.a, a), (self.b, b))):
            return [-1] if len(parts) == 1 else [k for p in parts for k in self.add([p])]
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.a_len[ids_a]), np.cumsum(self.b_len[ids_b])
        ends = np.cumsum([len(p) + 1 for p in parts] if text.isascii() else [len(p.encode("utf-8", "replace")) + 1 for p in parts])
        last_a, last_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        apart = (ends_a[last_a] == ends).all() and (ends_b[last_b] == ends).all()
        if len(parts) > 1 and (not apart or any(p[-1:].isspace() or not p for p in parts)):
            return [k for p in parts for k in self.add([p])]
        at = self.stats.n
        self.align(ids_a, ids_b, ends_a, ends_b, last_a + 1, last_b + 1)
        return list(range(at, self.stats.n))

    def align(self, ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> None:
        """Add rows for stretches by both sides' ids, the bytes after which these end, and the places after each stretch's ids."""
        n_a, n_b, n = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0), len(to_a)
        found = np.searchsorted(ends_b, ends_a)  # both end at the same byte in the end
        last_a = ends_b[found] == ends_a
        last_b = np.zeros(len(ids_b), bool)
        last_b[found[last_a]] = True
        of_a, of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b  # a token's group
        in_a, in_b = np.bincount(of_a), np.bincount(of_b)
        from_a, from_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        of = np.repeat(np.arange(n), np.diff(of_a[to_a - 1] + 1, prepend=0))  # a group's stretch
        links = in_a * in_b
        # every token of A with every token of B of its group; few pairs need more than one number each
        small = links[of_a] <= LARGE
        times = in_b[of_a] * small
        left, group = np.repeat(ids_a, times), np.repeat(of_a, times)
        right = ids_b[ranges(from_b[of_a], times)]
        stretch, codes, counts = of[group], (left << SHIFT) | right, np.ones(len(left), np.int64)
        for g in np.flatnonzero(links > LARGE):
            x, y = (np.unique(ids[f : f + m], return_counts=True) for ids, f, m in ((ids_a, from_a[g], in_a[g]), (ids_b, from_b[g], in_b[g])))
            stretch = np.append(stretch, np.full(len(x[0]) * len(y[0]), of[g]))
            codes = np.append(codes, ((x[0][:, None] << SHIFT) | y[0]).ravel())
            counts = np.append(counts, (x[1][:, None] * y[1]).ravel())
        order = np.argsort((stretch << 44) | codes)
        stretch, codes, counts = stretch[order], codes[order], counts[order]
        new = np.flatnonzero(np.append(True, (stretch[1:] != stretch[:-1]) | (codes[1:] != codes[:-1])))
        per = np.bincount(stretch[new], minlength=n)
        first = self.pairs.n + np.cumsum(per) - per
        self.pairs.add(np.stack([codes[new], np.add.reduceat(counts, new)], axis=1))
        groups = np.bincount(of, minlength=n)
        self.stats.add(np.stack([n_a, n_b, groups, np.bincount(of, links, n).astype(np.int64), first, per], axis=1))
        shown_a, shown_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        texts = [f"{shown_a[i]}|{shown_b[j]}" if k == m == 1 else f"{','.join(shown_a[i : i + k])}|{','.join(shown_b[j : j + m])}" for i, k, j, m in zip(*(x.tolist() for x in (from_a, in_a, from_b, in_b)))]
        at = 0
        for m in groups.tolist():
            self.shown.append(texts[at] if m == 1 else ";".join(texts[at : at + m]))
            at += m

    def documents(self, texts: list[str | None]) -> tuple[list[list], np.ndarray, np.ndarray, np.ndarray]:
        """For each text its numbers and the digest of its groups; and postings: place of the text, pair, links.

        A text has none where it is null or empty, or where a side's bytes aren't a space and the text.
        """
        if len(self.known) > CACHE or self.pairs.n > 8 * CACHE:
            self.clear()
        split = [self.b.stretches(t or "") for t in texts]
        new = list(set().union(*split).difference(self.known))
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            self.known.update(zip(part, self.add(part), strict=True))
        found = [list(map(self.known.__getitem__, parts)) for parts in split]
        for i, ids in enumerate(found):
            if -1 in ids:  # differences of several stretches might make up for each other
                (k,) = self.add([texts[i]])
                found[i] = [k] if k >= 0 else []
        for p in new:
            if len(p) > LONG or self.known[p] < 0:
                del self.known[p]
        sizes = np.array(list(map(len, found)), np.int64)
        flat = np.array([k for ids in found for k in ids], np.int64)
        ends = np.cumsum(sizes)
        totals = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.stats.rows[flat, :4], axis=0)])
        numbers = (totals[ends] - totals[ends - sizes]).tolist()
        rows = [[*n, sha256(";".join([self.shown[k] for k in ids]).encode()).hexdigest() if ids else ""] for n, ids in zip(numbers, found, strict=True)]
        times_of, times = summed(np.repeat(np.arange(len(texts)), sizes) * self.stats.n + flat, np.ones(len(flat), np.int64))
        doc, stretch = times_of // max(1, self.stats.n), times_of % max(1, self.stats.n)
        per = self.stats.rows[stretch, 5]
        at = ranges(self.stats.rows[stretch, 4], per)
        codes, links, doc = self.pairs.rows[at, 0], self.pairs.rows[at, 1] * np.repeat(times, per), np.repeat(doc, per)
        order = np.argsort((doc << 44) | codes)
        codes, links, doc = codes[order], links[order], doc[order]
        first = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1]))) if len(codes) else np.zeros(0, np.int64)
        return rows, doc[first], codes[first], np.add.reduceat(links, first) if len(first) else links


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def forget() -> None:
    """In a worker: drop what was cached for this operator."""
    aligner.cache_clear()
    byte_model.cache_clear()
    piece_model.cache_clear()


def blobs(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """One binary for each part of values, which begin at starts."""
    ends = (np.append(starts, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


BLOCKS = "a int, b int, docs int, base long, rows binary, links binary"


def postings(df: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of two kinds, told apart by `row`: documents, and blocks of postings (without row).

    A document: row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256. A block has the documents of one pair, of up to about
    BLOCK postings of a task: a, b, docs (how many), base, rows (their rows less base, 32 bits each) and links (how often each has
    the pair, 64 bits). `row` tells documents apart, whatever their ids; it holds for one evaluation. Null and empty texts, and
    those that either side's tokens don't spell, have zeros, no postings, and an empty text instead of a digest.
    """
    prepare(df.sparkSession)
    head = df.select(quoted(doc_id).alias("doc_id"))
    out = StructType([*head.schema.fields, *StructType.fromDDL(f"row long, {STATS}, {BLOCKS}").fields])
    schema = to_arrow_schema(out)
    n_blocks = len(BLOCKS.split(","))

    def block(base: int, kept: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        """The batches of postings (row less base, pair, links), by pair."""
        rows, codes, links = (np.concatenate(c) for c in zip(*kept, strict=True))
        order = np.argsort(codes, kind="stable")
        rows, codes, links = rows[order].astype(np.uint32), codes[order], links[order]
        starts = np.append(np.flatnonzero(np.append(True, codes[1:] != codes[:-1])), len(codes))
        for lo in range(0, len(starts) - 1, 5000):
            at = starts[lo : lo + 5001]
            own, part = slice(at[0], at[-1]), at[:-1] - at[0]
            pair = codes[at[:-1]]
            columns = [pa.array(pair >> SHIFT, pa.int32()), pa.array(pair & ((1 << SHIFT) - 1), pa.int32()), pa.array(np.diff(at), pa.int32()), pa.array(np.full(len(part), base)), blobs(rows[own], part), blobs(links[own], part)]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(part), f.type) for f in schema][:-n_blocks], *columns], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("align", forget)
        both, row = aligner(a_path, b_path), TaskContext.get().partitionId() << 40
        base, kept, many = row, [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 250):
                ids, texts = (c.to_pylist() for c in batch.slice(lo, 250).columns)
                rows, doc, codes, links = both.documents(texts)
                columns = [ids, range(row, row + len(ids)), *zip(*rows, strict=True)]
                arrays = [pa.array(c, f.type) for c, f in zip(columns, schema)]
                yield pa.RecordBatch.from_arrays([*arrays, *[pa.nulls(len(ids), f.type) for f in schema][-n_blocks:]], schema=schema)
                if len(codes):
                    kept.append((doc + (row - base), codes, links))
                many, row = many + len(codes), row + len(ids)
                if many >= BLOCK:
                    yield from block(base, kept)
                    base, kept, many = row, [], 0
        if kept:
            yield from block(base, kept)

    return df.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text")).mapInArrow(run, out)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, total and best of blocks: in how many documents a pair is, and whether no other pair of a is in more."""
    counts = blocks.groupBy("a", "b").agg(F.sum(F.col("docs").cast("long")).alias("total"))
    return counts.withColumn("best", F.col("total") == F.max("total").over(W.partitionBy("a")))


def given(blocks: DataFrame) -> DataFrame:
    """row, n_best, count_sum: what documents get from blocks (base, rows, links, total, best), added up over about ADDED postings of a task at a time."""
    out = StructType.fromDDL("row long, n_best long, count_sum long")
    schema = to_arrow_schema(out)

    def added(kept: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        rows, best, sums = (np.concatenate(c) for c in zip(*kept, strict=True))
        order = np.argsort(rows)
        rows = rows[order]
        starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        return pa.RecordBatch.from_arrays([pa.array(rows[starts]), pa.array(np.add.reduceat(best[order], starts)), pa.array(np.add.reduceat(sums[order], starts))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, many = [], 0
        for batch in batches:
            base, rows, links, total, best = batch.columns
            rows, links = rows.to_pylist(), links.to_pylist()
            sizes = np.array(list(map(len, rows)), np.int64) // 4
            if not sizes.sum():
                continue
            n = np.frombuffer(b"".join(links), np.int64)
            own = np.repeat(base.to_numpy(), sizes) + np.frombuffer(b"".join(rows), np.uint32)
            kept.append((own, n * np.repeat(best.to_numpy(zero_copy_only=False).astype(np.int64), sizes), n * np.repeat(total.to_numpy(), sizes)))
            many += len(n)
            if many >= ADDED:
                yield added(kept)
                kept, many = [], 0
        if kept:
            yield added(kept)

    return blocks.select("base", "rows", "links", "total", "best").mapInArrow(run, out)


def contributions(blocks: DataFrame) -> DataFrame:
    """row, n_best and count_sum from blocks of postings, which must read a written table.

    The blocks of an id of A go to one task, where they are sorted by B's id and summed in windows that spill. Ids with more than
    HOT_SHARE of all postings, at most 1 / HOT_SHARE, are told apart by a broadcast list; their pairs are counted with partial sums
    and joined back by pair, hot pairs by broadcast of at most as many counts.
    """
    sizes = blocks.groupBy("a").agg(F.sum(F.col("docs").cast("long")).alias("size")).collect()  # at most one row for each id of A's vocabulary
    total = sum(r["size"] for r in sizes)
    limit = max(8, int(total * HOT_SHARE))
    hot_ids = blocks.sparkSession.createDataFrame([(r["a"],) for r in sizes if r["size"] > limit], "a int")
    cold, hot = blocks.join(F.broadcast(hot_ids), "a", "left_anti"), blocks.join(F.broadcast(hot_ids), "a", "left_semi")
    streams = cold.repartition("a").withColumn("total", F.sum(F.col("docs").cast("long")).over(W.partitionBy("a", "b")))
    streams = streams.withColumn("best", F.col("total") == F.max("total").over(W.partitionBy("a")))
    known = table(pair_counts(hot).select(F.struct("a", "b").alias("pair"), "total", "best"))
    split = attach(hot.select("base", "rows", "links", F.struct("a", "b").alias("pair")), known, "pair", "total", total)
    names = ["base", "rows", "links", "total", "best"]
    return given(streams.select(names).unionByName(split.select(names))).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(df: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (see postings).

    n_best: its links whose pair is in as many documents as any pair of the same id of A; count_sum: the documents of the pair,
    summed over links. Rows that repeat are documents of their own; an empty input gives an empty result. Postings are
    written once to the shared folder, the result too, and then the postings are removed.
    """
    spark = df.sparkSession
    made = postings(df, a_path, b_path, doc_id, text)
    folder = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    made.write.parquet(folder)
    kept = spark.read.schema(made.schema).parquet(folder)
    sums = contributions(kept.filter(F.col("a").isNotNull()).select("a", "b", "docs", "base", "rows", "links"))
    documents = kept.filter(F.col("row").isNotNull())
    zero = F.lit(0).cast("long")
    out = table(documents.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    ))
    remove(spark, folder)
    return out
