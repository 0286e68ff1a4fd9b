"""BPE as a deterministic automaton over tokens.

The automaton starts with one state that accepts every base symbol. Each merge (u, v) -> uv, in order of rank, is a gadget:
arcs labelled u are redirected to a copy of their target that lacks the arc v, and every state that had an arc u to a state
with an arc v gets the arc uv to where u, v led. What is left accepts exactly the correct token sequences, so one path spells
a given word. A state is kept as its difference from the state that it was copied from (parent, the arc cut, and when);
rows of the table next[state, token] are filled from these differences when first asked for.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import TYPE_CHECKING

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import extended, hold, prepare, rows_of

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: White space as Unicode's White_Space property has it.
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")


def latin(wanted: Callable[[str], bool]) -> str:
    """The characters below U+0250 that are wanted, as ranges of a character class; a set is faster to match than categories."""
    found = [c for c in range(0x250) if wanted(chr(c))]
    starts = [c for c in found if c == 0 or not wanted(chr(c - 1))]
    ends = [c for c in found if c == 0x24F or not wanted(chr(c + 1))]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))


BLANK = "\t\n\x0b\x0c\r\x20\x85\xa0"
LETTER, OTHER = latin(str.isalpha), latin(lambda c: not c.isalnum() and c not in BLANK)
#: WORDS for texts without characters of RARE. Letters come first, which changes nothing: no other branch starts with one.
LATIN_WORDS = re.compile(rf"[{LETTER}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[{OTHER}]+")
RARE = re.compile("[\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")
NEVER = 1 << 60
#: Entries after which a cache is emptied, and letters above which a word isn't cached: an entry takes a few hundred bytes at most.
CACHE, LONG = 600_000, 48


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Automaton:
    """States are numbers: 0 is the first, and each gadget adds one. to[t] is the state that every arc labelled t leads to."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "") -> None:
        self.vocab, self.end = vocab, end
        plain = [t.removesuffix(end) if end else t for t in vocab]
        self.starts = {t[:i] for t in plain for i in range(1, len(t) + 1)}
        self.last = {t.removesuffix(end): i for t, i in vocab.items() if t.endswith(end)} if end else vocab
        self.n = max(vocab.values(), default=0) + 1
        self.to = [0] * self.n
        self.parent, self.cut, self.when = [0], [-1], [-2]
        self.made = [-1] * self.n  # the rank of the merge that makes a token; base symbols were there before
        self.left = [-1] * self.n
        self.next: dict[int, int] = {}
        for rank, (left, right) in enumerate(merges):
            self.gadget(vocab[left], vocab[right], vocab[left + right], rank)
        self.next.clear()  # what was asked for while states were added

    def gadget(self, u: int, v: int, uv: int, rank: int) -> None:
        """Copy the target of u without its arc v; uv leads where u, v led. A merge that no path has any more makes nothing."""
        target = self.to[u]
        if self.made[u] == NEVER or not self.has(target, v):
            self.made[uv] = NEVER
            return
        self.made[uv], self.left[uv], self.to[uv] = rank, u, self.to[v]
        self.parent.append(target)
        self.cut.append(v)
        self.when.append(rank)
        self.to[u] = len(self.parent) - 1

    def has(self, state: int, token: int) -> bool:
        """Whether the state has an arc `token`, from its differences.

        A state has the arcs of its parent at the time of the copy, but for the one cut; of a later merge uv it has the arc if
        it has u. An arc once made stays.
        """
        made, when, cut = self.made, self.when, self.cut
        if made[token] == NEVER:
            return False
        while True:
            if made[token] >= when[state]:
                if made[token] < 0:
                    return True  # a base symbol in the first state
                token = self.left[token]
            elif cut[state] == token:
                return False
            else:
                state = self.parent[state]

    def step(self, state: int, token: int) -> int:
        """next[state, token]: the state that the arc leads to, or -1 where there is no such arc."""
        key = state * self.n + token
        found = self.next.get(key)
        if found is None:
            if len(self.next) > 2 * CACHE:
                self.next.clear()
            found = self.next[key] = self.to[token] if self.has(state, token) else -1
        return found

    def matches(self, word: str, at: int) -> list[tuple[int, int]]:
        """(end, token) of the tokens that stand at a place of the word, shortest first."""
        out, n, known = [], len(word), self.starts
        for end in range(at + 1, n + 1):
            part = word[at:end]
            if part not in known:
                break
            token = self.last.get(part) if end == n else self.vocab.get(part)
            if token is not None:
                out.append((end, token))
        return out

    def encode_word(self, word: str) -> list[int]:
        """The labels on the one path from state 0 that spells word (in the byte alphabet).

        Arcs are tried from the longest label on. A prefix has one path only, so a place from which the end can't be reached
        is given up for good.
        """
        n, dead = len(word), set()
        if not n:
            return []
        tokens, ends, states, open_ = [], [0], [0], [self.matches(word, 0)]
        while open_:
            options, state = open_[-1], states[-1]
            while options:
                end, token = options.pop()
                if end not in dead and (target := self.step(state, token)) >= 0:
                    tokens.append(token)
                    if end == n:
                        return tokens
                    ends.append(end)
                    states.append(target)
                    open_.append(self.matches(word, end))
                    break
            else:
                dead.add(ends.pop())
                states.pop()
                open_.pop()
                if tokens:
                    tokens.pop()
        return []


class Known(dict):
    """What a function gives, kept until there are CACHE entries; long words aren't kept."""

    def __init__(self, work: Callable[[str], tuple[int, ...]]) -> None:
        super().__init__()
        self.work = work

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(word) > LONG:
            return self.work(word)
        if len(self) > CACHE:
            self.clear()
        found = self[word] = self.work(word)
        return found


@lru_cache(maxsize=1)
def unknown() -> re.Pattern:
    """The code points that Python's Unicode tables leave unassigned; the library's tables may know them as letters or numbers."""
    out, start = [], -1
    for c in range(0x110001):
        free = c < 0x110000 and unicodedata.category(chr(c)) == "Cn"
        if free and start < 0:
            start = c
        elif not free and start >= 0:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = -1
    return re.compile(f"[{''.join(out)}]")


class WordBpe:
    """Encodes and decodes as the tokenizers library does with a word-end BPE file (NFC, lower case, byte level)."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.automaton = Automaton(model["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]], model.get("end_of_word_suffix") or "")
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.labels = {i: t for t, i in (*model["vocab"].items(), *self.added.items())}
        self.alphabet = byte_alphabet()
        self.words = Known(self.word)
        self.unknown = unknown()
        self.library: Tokenizer | None = None

    def word(self, word: str) -> tuple[int, ...]:
        return tuple(self.automaton.encode_word("".join([self.alphabet[b] for b in word.encode("utf-8", "replace")])))

    def odd_words(self, text: str) -> list[str]:
        """The words of a text with characters that Python's Unicode tables lack, by the library's normaliser and splitter."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        back = {c: b for b, c in enumerate(self.alphabet)}
        shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(back.__getitem__, w)).decode("utf-8") for w, _ in shown]

    def _plain(self, text: str, out: list[int]) -> None:
        if RARE.search(text) and self.unknown.search(text):
            out.extend(chain.from_iterable(map(self.words.__getitem__, self.odd_words(text))))
            return
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # each character by itself: no final sigma
        words = (WORDS if RARE.search(text) else LATIN_WORDS).findall(text)
        out.extend(chain.from_iterable(map(self.words.__getitem__, words)))

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        if self.split is None or "<" not in text:
            self._plain(text, out)
            return out
        at = 0
        for m in self.split.finditer(text):
            self._plain(text[at : m.start()], out)
            out.append(self.added[m[0]])
            at = m.end()
        self._plain(text[at:], out)
        return out

    def decode(self, ids: list[int]) -> str:
        """The arcs' labels with a space between, as the library gives them where the file names no decoder."""
        return " ".join([self.labels[i] for i in ids])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """keep, `ids` array<int> and, if decoded, `decoded` string: the text encoded by the automaton of the file at path.

    A null text counts as empty and gives no ids and an empty decoded text. Rows are independent: repeated rows and ids,
    null ids and further columns (dropped unless kept) are fine.
    """
    prepare(df.sparkSession)
    kept = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    out, schema = extended(df.select(*keep), "ids array<int>, decoded string" if decoded else "ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("bpe", tokenizer.cache_clear)
        bpe = tokenizer(path)

        def work(*columns: list) -> list:
            ids = [bpe.encode(t) for t in columns[-1]]
            return [*columns[:-1], ids, *([[bpe.decode(x) for x in ids]] if decoded else [])]

        return rows_of(batches, work, schema)

    return kept.mapInArrow(run, out)


def decode(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and `decoded`: the arcs' labels of ids; null ids count as none."""
    prepare(df.sparkSession)
    out, schema = extended(df.select(*keep), "decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("bpe", tokenizer.cache_clear)
        bpe = tokenizer(path)
        return rows_of(batches, lambda *c: [*c[:-1], [bpe.decode(x or []) for x in c[-1]]], schema)

    return df.select(*keep, ids).mapInArrow(run, out)


def digests(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number of ids and SHA-256 of the ids and of the decoded text, derived from encode's outputs."""
    return encode(df, path, text, (doc_id,), decoded=True).select(
        F.col(doc_id).alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
