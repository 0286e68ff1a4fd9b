"""Numbers of tokens of whole texts by a lookup in two tiers, with no exchange of pre-tokens.

A text's tokens are those of its pre-tokens. First tier: the numbers of tokens of frequent pre-tokens, a compact table that is
broadcast. Second tier: what a worker has encoded itself. Frequent pre-tokens are found over all rows: each partition keeps a
summary of a fixed number of counters (Misra-Gries), and summaries are merged in a tree, as one row each; any pre-token that
makes more than 1 / KEPT of all is in the last one. Counts don't depend on what is in the table, only the time does.
"""

from __future__ import annotations

import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.align import piece_model
from quillgraph.llm.bpe import WordBpe
from quillgraph.llm.common import extended, hold, prepare, quoted, release, rows_of, table
from quillgraph.llm.packing import byte_tokens

#: Pre-tokens of a summary and of the table; with LONG characters of four bytes at most, the table has under 4 MB.
KEPT = 16_384
#: Entries after which a worker's own ones are forgotten, and characters above which a pre-token is in neither tier.
CACHE, LONG = 300_000, 48
#: Summaries that are merged into one.
MERGED = 32
#: Tokens above which a document is over the limit.
LIMIT = 2048


class Itself(dict):
    """Gives each word as its only part."""

    def __missing__(self, word: str) -> tuple[str]:
        return (word,)


class WordParts:
    """Pre-tokens of a word-end BPE file and their numbers of tokens by its automaton. Special strings count one each."""

    def __init__(self, path: str) -> None:
        self.bpe = WordBpe(path)
        self.marks = {t: 1 for t in self.bpe.added}
        self.bpe.added = {t: t for t in self.marks}
        self.bpe.words = Itself()
        self.split = self.bpe.encode

    def size(self, part: str) -> int:
        return len(self.bpe.word(part))


class ByteParts:
    """Pre-tokens of a byte-level BPE file, by the tokenizers library. Special strings count one each."""

    def __init__(self, path: str) -> None:
        tokens = byte_tokens(path)
        self.tokenizer, self.split = tokens.tokenizer, tokens.parts
        self.marks = {mark: 1 for mark in tokens.added.values()}

    def size(self, part: str) -> int:
        return len(self.tokenizer.encode(part, add_special_tokens=False).ids)


class PieceParts:
    """Stretches between spaces of a sentencepiece model."""

    def __init__(self, path: str) -> None:
        self.model, self.marks = piece_model(path), {}
        self.split = self.model.stretches

    def size(self, part: str) -> int:
        return len(self.model.encode(part))


@lru_cache(maxsize=1)
def parts_of(path: str) -> WordParts | ByteParts | PieceParts:
    """The splitter for a file: .model is sentencepiece's, .json with word ends or byte-level is the tokenizers library's."""
    if path.endswith(".model"):
        return PieceParts(path)
    with open(path, encoding="utf-8") as f:
        word_ends = '"end_of_word_suffix":"</w>"' in "".join(f.read().split())
    return WordParts(path) if word_ends else ByteParts(path)


# ---------------------------------------------------------------- frequent pre-tokens


def pruned(counts: Counter, kept: int) -> Counter:
    """At most `kept` counters: the next largest count is taken off all (Misra-Gries), so errors add up to 1 / kept of all."""
    if len(counts) <= kept:
        return counts
    off = sorted(counts.values(), reverse=True)[kept]
    return Counter({w: n - off for w, n in counts.items() if n > off})


def summaries(df: DataFrame, path: str, kept: int = KEPT) -> DataFrame:
    """A row for each partition with texts: part, words and counts, its summary of pre-tokens of up to LONG characters."""
    out, schema = extended(df.select(), "part int, words array<string>, counts array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("counts", forget)
        split, seen = parts_of(path).split, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(split(text))
                if len(seen) > 4 * kept:
                    seen = pruned(Counter({w: n for w, n in seen.items() if len(w) <= LONG and isinstance(w, str)}), kept)
        seen = pruned(Counter({w: n for w, n in seen.items() if len(w) <= LONG and isinstance(w, str)}), kept)
        if seen:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "words": list(seen), "counts": list(seen.values())}], schema=schema)

    return df.mapInArrow(run, out)


def frequent(df: DataFrame, path: str, kept: int = KEPT) -> Frequent:
    """The frequent pre-tokens of the one column of df, over all rows, with their numbers of tokens.

    A merge takes MERGED rows of at most `kept` counters; the driver gets the last row, whose size is bounded likewise.
    """

    def merge(frame):
        seen = Counter()
        for words, counts in zip(frame["words"], frame["counts"], strict=True):
            seen.update(dict(zip(words.tolist(), counts.tolist(), strict=True)))
        seen = pruned(seen, kept)
        return frame.iloc[:1].assign(part=frame["part"] // MERGED, words=[list(seen)], counts=[list(seen.values())])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("counts", forget)
        size = parts_of(path).size
        return rows_of(batches, lambda words: [words, [[size(w) for w in ws] for ws in words]], schema)

    kind = "part int, words array<string>, counts array<long>"
    now = table(summaries(df, path, kept))
    while now.count() > 1:
        last, now = now, table(now.groupBy((F.col("part") / MERGED).cast("int")).applyInPandas(merge, kind))
        release(last)
    out, schema = extended(now.select("words"), "sizes array<int>")
    rows = now.select("words").mapInArrow(measured, out).collect()
    release(now)
    return Frequent(*(rows[0] if rows else ([], [])))


class Frequent:
    """The first tier as it is sent: one string, the ends of the pre-tokens in it, and their numbers of tokens."""

    def __init__(self, words: list[str], sizes: list[int]) -> None:
        self.name, self.text, self.ends, self.sizes = uuid.uuid4().hex, "".join(words), array("I"), array("H", sizes)
        end = 0
        for w in words:
            end += len(w)
            self.ends.append(end)

    def entries(self) -> dict[str, int]:
        return {self.text[a:b]: n for a, b, n in zip([0, *self.ends], self.ends, self.sizes)}


class Tiers(dict):
    """The first tier; what isn't in it is looked up in the second, and encoded where that lacks it too."""

    def __init__(self, first: dict, parts: WordParts | ByteParts | PieceParts) -> None:
        super().__init__(first)
        self.update(parts.marks)
        self.encode, self.second = parts.size, {}

    def __missing__(self, part: str) -> int:
        n = self.second.get(part)
        if n is None:
            n = self.encode(part)
            if len(part) <= LONG:
                if len(self.second) >= CACHE:
                    self.second.clear()
                self.second[part] = n
        return n


_TIERS: dict[tuple[str, str], Tiers] = {}


def forget() -> None:
    """In a worker: drop what was cached for this operator."""
    _TIERS.clear()
    parts_of.cache_clear()


def tiers(path: str, known: Frequent) -> Tiers:
    if (path, known.name) not in _TIERS:
        _TIERS.clear()
        _TIERS[path, known.name] = Tiers(known.entries(), parts_of(path))
    return _TIERS[path, known.name]


# ---------------------------------------------------------------- counts


def count(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, known: Frequent | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens).

    Tokens are those that the file's library gives without begin, end or added special tokens, truncation or padding. Null texts
    count as empty: no bytes, no tokens. Rows that repeat are documents of their own; further columns are left out; an empty
    input gives an empty result. `known` is an earlier table of frequent pre-tokens (any will do); without one it is made from df.
    """
    spark = df.sparkSession
    prepare(spark)
    whole = F.coalesce(quoted(text), F.lit(""))
    sent = spark.sparkContext.broadcast(known or frequent(df.select(whole.alias("text")), path))
    rows = df.select(quoted(doc_id).alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text"))
    out, schema = extended(rows.select("doc_id", "n_bytes"), "n_tokens long, over_limit boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("counts", forget)
        size, split = tiers(path, sent.value).__getitem__, parts_of(path).split

        def work(ids: list, n_bytes: list, texts: list) -> list:
            counts = [sum(map(size, split(t))) for t in texts]
            return [ids, n_bytes, counts, [n > limit for n in counts]]

        return rows_of(batches, work, schema)

    return rows.mapInArrow(run, out)
