"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's vector is the mean of the embeddings of its words' subwords (character n-grams with word bounds, hashed into
BUCKETS). Both layers are trained by stochastic gradient descent in numpy on a bounded, balanced sample of labelled rows; a
third of it is left out to calibrate the scores and the rejection bounds. For prediction both layers are multiplied out, so
a word is a sum of logits, worked out once for each distinct word.

A softmax is sure of texts unlike any that it has learned from, so a text is rejected as well for the share of its n-grams that
no learned row has: those are kept as a bitmap of KNOWN hashes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillgraph.llm.common import crc_mod, extended, hold, learned, plain_names, prepare, quoted

WORD = re.compile(r"[^\W\d_]+")
BUCKETS, DIMENSIONS, EPOCHS, RATE, BATCH = 1 << 16, 12, 6, 0.6, 16
GRAMS = (2, 3, 4)
#: Hashes of n-grams that are told apart; a bucket is a hash's lower bits.
KNOWN = 1 << 20
#: Rows of each language that are learned from, about, and of all together; the most frequent languages are learned, so many.
SAMPLE, ROWS, LANGUAGES = 1500, 12_000, 200
#: Distinct n-grams of a row that are learned from, drawn from its whole text: 8 bytes each, so a sample has under 400 MB. They go to the task that learns packed, in less than a third of it.
DRAWN = 4096
#: Bound of each weight, so that logits are at most DIMENSIONS times its square. Letters above which a word isn't cached.
WEIGHT, LONG = 4.0, 78
UNKNOWN = "und"
#: Share of rows with a right prediction that each bound of rejection may take, about.
WRONGED = 0.0002
#: Words after which the table of their logits starts anew. Letters and bounds that are hashed at once, about.
CACHE, AT_ONCE = 450_000, 1 << 15
#: CRC-32 of each byte, as zlib has it.
CRC = np.array([zlib.crc32(bytes([i])) ^ 0xFF000000 for i in range(256)], np.uint32)[np.arange(256) ^ 0xFF]


def crc_of_next(crc: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Each CRC-32 (before its last inversion) carried on over the UTF-8 bytes of a letter."""
    step = lambda crc, byte: CRC[(crc ^ byte) & 0xFF] ^ (crc >> 8)
    if not len(letters) or letters.max() < 0x80:
        return step(crc, letters)
    size = 1 + (letters >= 0x80) + (letters >= 0x800) + (letters >= 0x10000)
    crc = step(crc, np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)[size] | letters >> (6 * (size - 1)).astype(np.uint32))
    for left in (3, 2, 1):
        at = np.flatnonzero(size > left)
        crc[at] = step(crc[at], 0x80 | letters[at] >> np.uint32(6 * left - 6) & 0x3F)
    return crc


def hashes_of(words: Collection[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of whole words, word by word, and where each word's begin: crc32 of an n-gram's UTF-8."""
    letters = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "replace"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    grams = [np.maximum(0, size - n + 1) for n in GRAMS]
    total = sum(grams)
    begins = np.cumsum(total) - total
    place = np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)
    left, out, before = np.repeat(size, size) - place, np.empty(int(total.sum()), np.uint32), begins
    crc = np.full(len(letters), 0xFFFFFFFF, np.uint32)
    for n in range(1, max(GRAMS) + 1):
        crc = crc_of_next(crc[: len(letters) - n + 1], letters[n - 1 :])
        if n in GRAMS:
            at = np.flatnonzero(left[: len(crc)] >= n)
            out[np.repeat(before, size)[at] + place[at]] = ~crc[at] & (KNOWN - 1)
            before = before + grams[GRAMS.index(n)]
    return out, begins


def portions(words: Collection[str]) -> Iterator[list[str]]:
    """The words, about AT_ONCE letters at a time."""
    part, size = [], 0
    for w in words:
        part.append(w)
        size += len(w) + 2
        if size >= AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def subwords(word: str) -> np.ndarray:
    """Hashes of the whole word's n-grams."""
    return hashes_of([word])[0]


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # a bucket's embedding times the second layer
    bias: np.ndarray
    temperature: float
    reject: float  # lowest score of a text in a learned language
    known: np.ndarray  # bits of the n-grams that were learned from
    strange: float  # largest share of other n-grams of such a text

    def unknown(self, hashes: np.ndarray) -> np.ndarray:
        """Which n-grams are of no learned row."""
        return (self.known[hashes >> 3] >> (hashes & 7)) & 1 == 0


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of distinct n-grams of a text and each one's number; of more than DRAWN, those that come first by another hash."""
    parts = portions(WORD.findall(text.lower()))
    ids, n = np.unique(hashes_of(next(parts, []))[0], return_counts=True)
    if (more := next(parts, None)) is not None:
        found = np.zeros(KNOWN, np.int64)
        found[ids] = n
        while more is not None:
            ids, n = np.unique(hashes_of(more)[0], return_counts=True)
            found[ids] += n
            more = next(parts, None)
        ids = np.flatnonzero(found).astype(np.uint32)
        n = found[ids]
    if len(ids) > DRAWN:
        rank = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(zlib.crc32(text.encode("utf-8", "replace")))) * np.uint64(0xBF58476D1CE4E5B9)
        drawn = np.sort(np.argpartition(rank >> np.uint64(32), DRAWN)[:DRAWN])
        ids, n = ids[drawn], n[drawn]
    return ids, n


def shares(n: np.ndarray) -> np.ndarray:
    return (n / max(1, n.sum())).astype(np.float32)


def bag(text: str, known: object = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of distinct n-grams of a text, at most DRAWN, and each one's share."""
    ids, n = counted(text)
    return ids, shares(n)


def packed(text: str) -> bytes:
    """What bag gives, in few bytes: steps between the hashes and their numbers, compressed."""
    ids, n = counted(text)
    both = np.concatenate([np.diff(ids, prepend=np.uint32(0)), np.minimum(n, 0xFFFFFFFF).astype(np.uint32)])
    return zlib.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)  # all first bytes, all second ones: mostly zeros from there on


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view(np.uint32)[:, 0]
    return np.cumsum(both[: len(both) // 2], dtype=np.uint32), shares(both[len(both) // 2 :])


def buckets(hashes: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their shares."""
    ids, at = np.unique(hashes & (BUCKETS - 1), return_inverse=True)
    return ids, np.bincount(at, share, len(ids)).astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def shuffled(text: str) -> str:
    """The text's words with their letters dealt anew: as long, but of no language."""
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "replace")))
    return " ".join("".join(rng.permutation(list(w))) for w in WORD.findall(text.lower()))


Bag = tuple[np.ndarray, np.ndarray]


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Learns from whole texts; see learn."""
    rows = [(bag(t), label) for t, label in zip(texts, labels, strict=True)]
    return learn(rows, [bag(shuffled(t)) for t in texts[: max(20, len(texts) // 10)]], seed)


def learn(rows: list[tuple[Bag, str]], foreign: list[Bag], seed: int = 7) -> Model:
    """Both layers by stochastic gradient descent; a third of the rows is left out and calibrates scores and, with the foreign rows, rejection.

    Without rows to learn from, a model of no language.
    """
    rows = [r for r in rows if len(r[0][0])]
    languages = sorted({label for _, label in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0, np.zeros(KNOWN // 8, np.uint8), 1.0)
    number = {label: i for i, label in enumerate(languages)}
    rng = np.random.default_rng(seed)
    rng.shuffle(rows)
    held, learned = rows[: len(rows) // 3], [(buckets(*b), label) for b, label in rows[len(rows) // 3 :]]
    known = np.zeros(KNOWN, bool)
    for (hashes, _), _ in rows[len(rows) // 3 :]:
        known[hashes] = True
    first = (rng.random((BUCKETS, DIMENSIONS), np.float32) - 0.5) / DIMENSIONS
    second, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, step = EPOCHS * max(1, -(-len(learned) // BATCH)), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(learned))
        for at in range(0, len(order), BATCH):
            part = [learned[i] for i in order[at : at + BATCH]]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = np.stack([share @ first[ids] for (ids, share), _ in part])
            gap = softmax(hidden @ second + bias)
            gap[np.arange(len(part)), [number[label] for _, label in part]] -= 1
            back = gap @ second.T
            second = np.clip(second - rate * hidden.T @ gap, -WEIGHT, WEIGHT)
            bias -= rate * gap.mean(axis=0)
            for ((ids, share), _), b in zip(part, back, strict=True):
                # shares are small: by their squares' sum, so that a row moves its own mean by no more than rate times b
                move = np.outer(share, b) * (rate * min(20.0, 1 / float(share @ share)))
                first[ids] = np.clip(first[ids] - move, -WEIGHT, WEIGHT)
    model = Model(languages, first @ second, bias.astype(np.float64), 1.0, 0.0, np.packbits(known, bitorder="little"), 1.0)
    if held:
        logits = lambda bags: np.stack([share @ model.logits[ids] + model.bias for ids, share in (buckets(*b) for b in bags)])
        novel = lambda bags: np.array([float(share[model.unknown(ids)].sum()) for ids, share in bags])
        own = [b for b, _ in held]
        z = logits(own)
        right = np.array([number[label] for _, label in held])
        model.temperature = calibrated(z, right)
        p = softmax(z / model.temperature)
        best, hit = p.max(axis=1), p.argmax(axis=1) == right
        foreign = [b for b in foreign if len(b[0])]
        alien = softmax(logits(foreign) / model.temperature).max(axis=1) if foreign else np.zeros(0)
        model.reject = rejection(best[hit], alien)
        model.strange = strangeness(novel(own)[hit], novel(foreign))
    return model


def calibrated(z: np.ndarray, right: np.ndarray) -> float:
    """The temperature under which the right labels are likeliest, by a search over a convex loss.

    Labels count as wrong with the chance that one more row is (Laplace), or rows that are all right would have none.
    """
    n, k = z.shape
    if k == 1:
        return 1.0
    off = 1 / (n + 2)
    aim = np.full((n, k), off / (k - 1))
    aim[np.arange(n), right] = 1 - off
    loss = lambda b: -(aim * np.log(softmax(z * b) + 1e-300)).sum()  # noqa: E731  in 1 / temperature, by its logarithm
    lo, hi = np.log(1e-3), np.log(1e3)
    while hi - lo > 1e-3:
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, hi)
    return float(np.exp(-(lo + hi) / 2))


def strangeness(right: np.ndarray, foreign: np.ndarray) -> float:
    """The share of unknown n-grams above which a text counts as of no learned language.

    Half way from what right rows have to what the lowest tenth of the foreign ones have; where these aren't apart, what right
    rows have. That is the share that WRONGED of them have, carried on from their highest tenth, whose shares fall off as
    an exponential's. 1 without rows of either kind.
    """
    if not len(right) or not len(foreign):
        return 1.0
    shares = np.sort(right)[::-1]
    tenth = shares[: max(1, len(shares) // 10)]
    spared = tenth[-1] + (tenth - tenth[-1]).mean() * max(0.0, np.log(len(tenth) / len(shares) / WRONGED))
    spared = min(1.0, max(spared, shares[0]))
    return float((spared + max(spared, np.quantile(foreign, 0.1))) / 2)


def rejection(right: np.ndarray, foreign: np.ndarray) -> float:
    """The score below which a text counts as of no learned language, from left-out rows that were right and rows of no language.

    It lies at the median of the latter, so that half of such texts go, but no higher than where WRONGED of the right rows
    would go with them. There are too few rows to count so small a share, so it is carried on from the lowest tenth, whose
    log-odds fall off as an exponential's, and by their mean fall below the lowest one. 0 without rows of either kind.
    """
    if not len(right) or not len(foreign):
        return 0.0
    odds = np.sort(right.clip(1e-9, 1 - 1e-9))
    odds = np.log(odds / (1 - odds))
    tenth = odds[: max(1, len(odds) // 10)]
    spared = tenth[-1] - (tenth[-1] - tenth).mean() * np.log(len(tenth) / len(odds) / WRONGED)
    spared = min(spared, odds[0] - (tenth[-1] - tenth).mean())
    return float(min(np.median(foreign), 1 / (1 + np.exp(-spared))))


def drawn(df: DataFrame, text: str, lang: str, key: str, size: int = SAMPLE) -> DataFrame:
    """mark, lang, bag, foreign: packed bags of about `size` rows of each language by a hash, and of no language from a tenth of them.

    The LANGUAGES most frequent ones share ROWS rows. Rows that repeat key, text and language count once. The sample is bounded by
    ROWS and DRAWN, however long the texts and however many the languages.
    """
    counts = df.groupBy(quoted(lang).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    size = min(size, max(1, ROWS // max(1, len(counts))))
    shares = df.sparkSession.createDataFrame([(r["lang"], size / r["n"]) for r in counts], StructType([StructField("lang", df.schema[lang].dataType), StructField("part", DoubleType())]))
    mark = F.xxhash64(quoted(key).cast("string"), quoted(text), quoted(lang))
    rows = df.select(mark.alias("mark"), quoted(lang).alias("lang"), quoted(text).alias("text")).join(F.broadcast(shares), "lang")
    rows = rows.filter(F.pmod(F.xxhash64("mark", F.lit("sample")), F.lit(1 << 20)) / (1 << 20) < F.col("part")).dropDuplicates(["mark"]).select("mark", "lang", "text")
    out, schema = extended(rows.select("mark", "lang"), "bag binary, foreign boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("language sample", lambda: None)
        for batch in batches:
            for mark, language, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for foreign in (False, True) if mark % 10 == 0 else (False,):
                    yield pa.RecordBatch.from_pylist([{"mark": mark, "lang": language, "bag": packed(shuffled(t) if foreign else t), "foreign": foreign}], schema=schema)

    return rows.mapInArrow(run, out)


def bags_of(found: pa.Table) -> tuple[list[tuple[Bag, str]], list[Bag]]:
    """Bags and labels of drawn rows, and the bags of no language."""
    found = found.sort_by([("mark", "ascending"), ("foreign", "ascending")])
    bags = [(unpacked(b.as_py()), language.as_py(), foreign.as_py()) for b, language, foreign in zip(*(found.column(c) for c in ("bag", "lang", "foreign")), strict=True)]
    return [(b, language) for b, language, foreign in bags if not foreign], [b for b, _, foreign in bags if foreign]


def sample(df: DataFrame, text: str, lang: str, key: str, size: int = SAMPLE) -> tuple[list[tuple[Bag, str]], list[Bag]]:
    """Bags of drawn rows on the driver; see drawn."""
    return bags_of(drawn(df, text, lang, key, size).toArrow())


def fit(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from text and lang of rows with a lang whose crc32(id) mod 3 is not 1, in one task."""
    prepare(df.sparkSession)
    known = quoted(lang).isNotNull() & quoted(text).isNotNull() & (crc_mod(quoted(doc_id), 3) != 1)
    rows = df.filter(known).select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"), quoted(lang).alias("lang"))
    return learned(drawn(rows, "text", "lang", "doc_id"), lambda found: learn(*bags_of(found)))


class Words(dict):
    """A word's row in a growing table of logits; the table starts anew once it is large."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model, self.n = model, 0
        self.rows = np.zeros((1 << 12, len(model.languages) + 2), np.float32)

    def add(self, words: Collection[str]) -> None:
        """Work out words that aren't in the table, many at once."""
        for part in portions(words):
            ids, begins = hashes_of(part)
            while self.n + len(part) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            new = self.rows[self.n : self.n + len(part)]
            new[:, :-2] = np.add.reduceat(self.model.logits[ids & (BUCKETS - 1)], begins)
            new[:, -2] = np.diff(begins, append=len(ids))
            new[:, -1] = np.add.reduceat(self.model.unknown(ids), begins, dtype=np.int64)
            self.update(zip(part, range(self.n, self.n + len(part)), strict=True))
            self.n += len(part)


def predictions_of(words: Words, texts: list[str | None]) -> list[tuple[str, float, float]]:
    """Language, score and the share of n-grams that no learned row has; `und`, 0 and 1 without a letter or a learned language."""
    if not words.model.languages:
        return [(UNKNOWN, 0.0, 1.0)] * len(texts)
    if words.n > CACHE:
        words.clear()
        words.n = 0
    found = [WORD.findall((t or "").lower()) for t in texts]
    long = [[w for w in f if len(w) > LONG] if len(t or "") > LONG and max(map(len, f), default=0) > LONG else [] for f, t in zip(found, texts, strict=True)]
    short = [[w for w in f if len(w) <= LONG] if x else f for f, x in zip(found, long, strict=True)]
    words.add([w for w in set().union(*short) if w not in words])
    return [prediction(words, *x) for x in zip(found, short, long, strict=True)]


def prediction(words: Words, found: list[str], short: list[str], long: list[str]) -> tuple[str, float, float]:
    if not any(any(map(str.isalpha, w)) for w in found):
        return UNKNOWN, 0.0, 1.0
    at = np.fromiter(map(words.__getitem__, short), np.int64, len(short))
    total = words.rows[at].sum(axis=0, dtype=np.float64)
    for w in long:
        ids = subwords(w)
        total[:-2] += np.bincount(ids & (BUCKETS - 1), minlength=BUCKETS) @ words.model.logits
        total[-2:] += len(ids), words.model.unknown(ids).sum()
    p = softmax((total[:-2] / total[-2] + words.model.bias) / words.model.temperature)
    best = int(p.argmax())
    return words.model.languages[best], float(p[best]), float(total[-1] / total[-2])


def predict(words: Words, text: str | None) -> tuple[str, float, float]:
    """Of one text; see predictions_of."""
    return predictions_of(words, [text])[0]


def some(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts, about four times AT_ONCE characters at a time."""
    part, size = [], 0
    for t in texts:
        part.append(t.as_py())
        size += len(part[-1] or "")
        if size >= 4 * AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


_WORDS: dict[str, Words] = {}


def identify(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred, score, rejected: `und`, score 0 and rejected for null texts and texts without a letter."""
    prepare(df.sparkSession)
    out, schema = extended(df.select(*map(quoted, keep)), "lang_pred string, score double, rejected boolean")
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS times the languages
    name = f"{id(shared)}-{model.logits[:64].sum()}-{np.abs(model.logits).sum()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("language", _WORDS.clear)
        if name not in _WORDS:
            _WORDS.clear()
            _WORDS[name] = Words(shared.value)
        words, lowest, most = _WORDS[name], shared.value.reject, shared.value.strange
        for batch in batches:
            found = [x for texts in some(batch.column(batch.num_columns - 1)) for x in predictions_of(words, texts)]
            rejected = [x == UNKNOWN or s < lowest or new > most for x, s, new in found]
            columns = (pa.array([x for x, _, _ in found], pa.string()), pa.array([s for _, s, _ in found], pa.float64()), pa.array(rejected, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], schema=schema)

    return plain_names(df.select(*map(quoted, keep), quoted(text))).mapInArrow(run, out)


def predictions(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, rejected; learned from df itself (see fit)."""
    rows = df.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    return identify(rows, fit(df, doc_id, text, lang)).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
