"""Packing token sequences into as few bins as it can by linear grouping.

Lengths are integers up to the bin's size, so the whole corpus is a histogram of at most `size` counts. The driver plans on
that histogram alone: large lengths are cut into groups of equal cardinality and rounded up to their group's largest; how
often each configuration of these few sizes is used is optimised by column generation; actual lengths replace the rounded
ones; large ones that are left over are grouped again until no configuration has a whole bin of them; small lengths are added by
best fit, and with them the shortest piece of each configuration, as gaps that rounding leaves would stay empty. A plan is a list of runs (length, ranks from,
to, first bin, offset), whose number depends on the bin's size and not on the data; each piece finds its run by its rank
among the pieces of its length.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from struct import pack as packed

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillgraph.llm.bpe import BLANK, LETTER, OTHER, RARE, SPACE
from quillgraph.llm.common import extended, hold, prepare, rows_of, table

SIZE = 2048
#: Lengths above this share of a bin are large; each of so many groups of them is rounded up.
LARGE, GROUPS = 1 / 4, 40
#: Distinct pre-tokens after which their cache is emptied, and characters above which one isn't cached.
CACHE, LONG = 1_000_000, 48
#: Runs of a plan up to which it is broadcast (40 bytes each); a plan has a few runs for each length.
BROADCAST_RUNS = 500_000

PRETOKENS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
LATIN_PRETOKENS = re.compile(rf" ?[{LETTER}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[{OTHER}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")


# ---------------------------------------------------------------- tokens


class ByteTokens:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, by the tokenizers library, each distinct pre-token once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = {t: np.uint32(i).tobytes() for t, i in added.items()}
        self.split = re.compile("|".join(f"({re.escape(t)})" for t in sorted(added, key=len, reverse=True))) if added else None
        self.known: dict[str, bytes] = {}

    def parts(self, text: str) -> list[str | bytes]:
        find = (PRETOKENS if RARE.search(text) else LATIN_PRETOKENS).findall
        if self.split is None or "<" not in text or not (marks := list(self.split.finditer(text))):
            return find(text)
        out, at = [], 0
        for m in marks:
            out += find(text[at : m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return out + find(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.parts(t) for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        new = [p for p in set().union(*split).difference(self.known) if isinstance(p, str)]
        for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[p] = packed(f"<{len(e.ids)}I", *e.ids)
        for mark in self.added.values():
            self.known[mark] = mark
        out = [b"".join(map(self.known.__getitem__, parts)) for parts in split]
        for p in new:
            if len(p) > LONG:
                del self.known[p]
        return out


@lru_cache(maxsize=2)
def byte_tokens(path: str) -> ByteTokens:
    return ByteTokens(path)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones of `size`, the first with what is over."""
    first = n % size or min(n, size)
    return [(0, first), *((at, size) for at in range(first, n, size))] if n else []


def pieces(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, part and nth (its rank among the part's pieces of its length).

    A document is its text's ids (null: none) and the id `end`. with_ids adds `ids` array<long>. Rows are independent;
    part and nth hold for one evaluation, so keep the result in a table before using them twice.
    """
    prepare(df.sparkSession)
    ddl = "piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<long>" * with_ids
    out, schema = extended(df.select(F.col(doc_id).alias("doc_id")), ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("packing", byte_tokens.cache_clear)
        tokens, last, part = byte_tokens(path), np.uint32(end).tobytes(), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)

        def work(ids: list, texts: list) -> list:
            columns: list[list] = [[] for _ in schema]
            for doc, data in zip(ids, tokens.encode(texts), strict=True):
                data += last
                for k, (start, length) in enumerate(cut(len(data) // 4, size)):
                    own = data[4 * start : 4 * (start + length)]
                    row = (doc, k, start, length, zlib.crc32(own), part, seen[length], *([np.frombuffer(own, "<u4").tolist()] if with_ids else []))
                    seen[length] += 1
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
            return columns

        return rows_of(batches, work, schema)

    return df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, out)


# ---------------------------------------------------------------- plan


def groups_of(counts: dict[int, int], n_groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(largest length, [(length, count)] from the longest on) of groups of equal cardinality, the longest first.

    A length that doesn't fit what is left of a group begins the next one with all of its pieces: that costs no more sizes, and
    none of them is rounded up.
    """
    total = sum(counts.values())
    share = max(1, -(-total // n_groups))
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        if left > room:
            out.append((length, [(length, left)]))
            room = -left % share
        else:
            out[-1][1].append((length, left))
            room -= left
    return out


def configurations(sizes: list[int], need: list[int], size: int) -> list[tuple[list[int], float]]:
    """(how many of each size, how often) of an optimal fractional packing, by column generation on a simplex basis.

    Ends when no configuration is worth more than a bin, or when what better ones could still save is no whole bin. Needs are
    moved apart by a hair, so that no two bases are equal and none comes back.
    """
    k = len(sizes)
    basis = np.diag([float(size // s) for s in sizes])
    inverse = np.diag(1 / np.diag(basis))
    goal = np.array(need, float) * (1 + 1e-9 * np.arange(1, k + 1) / k)
    x, done, still = inverse @ goal, 0, 0
    while True:
        price = inverse.sum(axis=0)  # each configuration costs one bin
        best, choice = np.zeros(size + 1), np.full(size + 1, -1)
        for j in np.argsort([-price[i] / sizes[i] for i in range(k)]):
            s, v = sizes[j], price[j]
            if v <= 1e-12:
                continue
            for lo in range(s, size + 1, s):  # blocks of s: what a block takes from is done
                hi = min(lo + s, size + 1)
                gain = best[lo - s : hi - s] + v
                better = gain > best[lo:hi] + 1e-12
                best[lo:hi][better] = gain[better]
                choice[lo:hi][better] = j
        column, at = np.zeros(k), int(np.argmax(best))
        if best[at] <= 1 + 1e-7 or np.ceil(x.sum() / best[at] - 1e-6) >= np.ceil(x.sum() - 1e-6):
            break
        while at > 0 and choice[at] >= 0:
            column[choice[at]] += 1
            at -= sizes[choice[at]]
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]) or (basis == column[:, None]).all(axis=0).any():
            break  # only rounding makes a configuration of the basis look better
        basis[:, out] = column
        done += 1
        if done % 50:
            row = inverse[out] / step[out]
            inverse = inverse - np.outer(step, row)
            inverse[out] = row
        else:
            inverse = np.linalg.inv(basis)  # afresh, as errors add up
        x, last = np.maximum(inverse @ goal, 0), x.sum()
        still = 0 if x.sum() < last - 1e-9 else still + 1
        if still > 10 * k:
            break  # nothing has been saved since
    return [([int(round(n)) for n in basis[:, i]], float(x[i])) for i in range(k) if x[i] > 1e-9]


class Bins:
    """Runs of bins with the same contents: gap -> [(first bin, how many, offset of the gap)]."""

    def __init__(self, size: int) -> None:
        self.size, self.n = size, 0
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        self.order: list[int] = []
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.used: dict[int, int] = defaultdict(int)

    def open(self, many: int) -> int:
        self.n += many
        return self.n - many

    def put(self, length: int, first: int, many: int, offset: int) -> None:
        """The next `many` pieces of this length go one each to the bins from first on."""
        lo = self.used[length]
        self.used[length] = lo + many
        self.rows.append((length, lo, lo + many, first, offset))

    def leave(self, gap: int, first: int, many: int) -> None:
        if gap > 0 and many > 0:
            if gap not in self.gaps:
                self.gaps[gap] = []
                bisect.insort(self.order, gap)
            self.gaps[gap].append((first, many))

    def best_fit(self, length: int, count: int) -> None:
        """Each piece to the fullest bin that has room, else to a new one."""
        while count:
            at = bisect.bisect_left(self.order, length)
            if at == len(self.order):
                per = self.size // length
                first, many, gap = self.open(max(1, count // per)), max(1, count // per), self.size
            else:
                gap = self.order[at]
                first, many = self.gaps[gap].pop()
                if not self.gaps[gap]:
                    del self.gaps[gap], self.order[at]
                per = gap // length
                if many * per > count:
                    full = max(1, count // per)
                    self.leave(gap, first + full, many - full)
                    many = full
            here = min(per, max(1, count // many))
            for j in range(here):
                self.put(length, first, many, self.size - gap + j * length)
            count -= here * many
            self.leave(gap - here * length, first, many)


def place(bins: Bins, groups: list[tuple[int, list[tuple[int, int]]]], config: list[int], many: int, apart: dict[int, int]) -> None:
    """Put actual lengths of the groups, longest first, into up to `many` new bins of a configuration.

    What its shortest slot would get, where it has several, goes apart: by best fit that room takes a length without rounding.
    """
    slots = [g for g, n in enumerate(config) for _ in range(n)]
    many = min([many, *(sum(c for _, c in groups[g][1]) // config[g] for g in set(slots))])
    if len(slots) > 1:
        last, left = slots.pop(), many
        items = groups[last][1]
        while left:
            length, n = items[-1]
            take = min(n, left)
            apart[length] = apart.get(length, 0) + take
            left -= take
            items[-1] = (length, n - take)
            if n == take:
                items.pop()
        config = [n - (g == last) for g, n in enumerate(config)]
    while many and slots:
        # as many bins as have the same actual lengths in every slot
        run = min([many, *(max(1, groups[g][1][0][1] // config[g]) for g in slots)])
        first, offset = bins.open(run), 0
        for g in slots:
            items, done = groups[g][1], 0
            longest = items[0][0]
            while done < run:  # a run of one bin may cross from one length to the next
                length, left = items[0]
                take = min(left, run - done)
                bins.put(length, first + done, take, offset)
                items[0] = (length, left - take)
                if left == take:
                    items.pop(0)
                done += take
            offset += longest
        bins.leave(bins.size - offset, first, run)
        many -= run


def plan(counts: dict[int, int], size: int = SIZE, n_groups: int = GROUPS, large: float = LARGE, share: float = 1.0) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """(bins, runs) for counts of lengths; a run: length, ranks from, to (exclusive), first bin, offset.

    Configurations are used for `share` of the bins that they could fill; with a share of 1, what is left over is grouped again.
    """
    bins = Bins(size)
    long = {k: c for k, c in counts.items() if k > size * large and c > 0}
    rest = {k: c for k, c in counts.items() if k <= size * large and c > 0}
    while long:
        groups, before = groups_of(long, n_groups), bins.n
        for config, often in configurations([g for g, _ in groups], [sum(c for _, c in items) for _, items in groups], size):
            place(bins, groups, config, int(often * share + 1e-6), rest)
        long = {}
        for _, items in groups:
            for length, c in items:
                long[length] = long.get(length, 0) + c
        if bins.n == before or share < 1:
            for length, c in long.items():
                rest[length] = rest.get(length, 0) + c
            break
    for length in sorted(rest, reverse=True):
        bins.best_fit(length, rest[length])
    return bins.n, bins.rows


def best_plan(counts: dict[int, int], size: int = SIZE) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """The plan with the fewest bins, over shares of configurations, numbers of groups and bounds of large lengths; ends where the volume is met.

    The most share of configurations comes first: they find mixes that best fit misses, which in turn leaves the least room where
    there are many lengths. Best fit alone is the last resort, so no plan is worse.
    """
    least = -(-sum(k * c for k, c in counts.items()) // size)
    best = None
    for share in (1.0, 0.75, 0.5, 0.25, 0.1):
        for n_groups, large in ((GROUPS, LARGE), (2 * GROUPS, LARGE), (GROUPS, LARGE / 2)):
            found = plan(counts, size, n_groups, large, share)
            if best is None or found[0] < best[0]:
                best = found
            if best[0] <= least:
                return best
    found = plan(counts, size, 1, 1.0)
    return found if found[0] < best[0] else best


# ---------------------------------------------------------------- assignment


def assign(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """rows (length, part, nth: see pieces; at most `size` long) with sequence_id and offset.

    rows is kept in the shared folder first. Ranks come from counts by (part, length); no length's pieces meet in one task.
    Ties and repeated rows are pieces of their own; an empty input gives an empty result.
    """
    spark = rows.sparkSession
    rows = table(rows)
    by_part = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    # the histogram has at most `size` rows, the plan a few for each of them
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    _, runs = best_plan(counts, size)
    base = by_part.select("part", "length", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    runs_df = spark.createDataFrame(runs, "length long, lo long, hi long, first long, offset long")
    ranked = rows.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "part", "nth")
    small = F.broadcast(runs_df) if len(runs) <= BROADCAST_RUNS else runs_df
    placed = ranked.join(small, (ranked["length"] == runs_df["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(*[ranked[c] for c in ranked.columns if c != "rank"], (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def pack(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenise documents and place their pieces: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    return assign(pieces(df, path, doc_id, text, size, end, with_ids), size)
