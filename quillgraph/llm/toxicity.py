"""Toxicity by a counterfactually regularised logistic classifier.

Features are the presence of words and of their character n-grams (with word bounds) that go with the label; how often a
feature repeats and how long a text is don't count. Terms for groups of people are swapped for others, and for neutral words, in
the labelled texts that have them; besides, every labelled text is taken once with such a term put in and once with a neutral one. The
loss takes the squared change of the score between the two, so that naming a group moves no score, by the word or its n-grams.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import crc_mod, extended, hold, learned, plain_names, prepare, quoted

WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows that are learned from at most, about: toxic ones and others.
SAMPLE = (2_000, 6_000)
#: What a feature needs: so many toxic texts, and so many times the share of other texts.
LEAST, TIMES = 3, 20.0
#: How many features, of all that are tried, may pass by chance (a Chernoff bound on how unevenly they are dealt).
CHANCE = 20.0
GRAMS = (4, 5, 6)
BOUND = 0.3
#: Words after which the cache of their features is emptied.
CACHE = 350_000
#: Letters above which a word isn't cached.
LONG = 38
STEPS, RATE, RIDGE, FAIR = 300, 0.08, 2e-5, 2.0

#: Sets of terms of one part of speech, by language; the first of each set is neutral.
IDENTITIES = {
    "en": (
        ("person", "woman", "man", "girl", "boy", "lesbian", "muslim", "christian", "jew", "hindu", "buddhist", "atheist", "immigrant", "refugee", "foreigner", "american", "african", "asian", "european", "mexican", "arab"),
        ("people", "women", "men", "girls", "boys", "lesbians", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "immigrants", "refugees", "foreigners", "americans", "africans", "asians", "europeans", "mexicans", "arabs"),
        ("other", "black", "white", "gay", "straight", "queer", "trans", "transgender", "bisexual", "jewish", "islamic", "disabled", "deaf", "blind", "old", "young", "female", "male"),
    ),
    "de": (
        ("person", "frau", "mann", "mädchen", "junge", "lesbe", "muslim", "muslima", "christ", "christin", "jude", "jüdin", "hindu", "buddhist", "atheist", "einwanderer", "flüchtling", "ausländer", "afrikaner", "asiat", "araber", "türke", "pole"),
        ("leute", "frauen", "männer", "lesben", "muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "einwanderer", "flüchtlinge", "ausländer", "afrikaner", "asiaten", "araber", "türken", "polen"),
        ("andere", "schwarze", "weiße", "schwule", "lesbische", "queere", "jüdische", "muslimische", "christliche", "behinderte", "gehörlose", "blinde", "alte", "junge", "weibliche", "männliche"),
    ),
    "fr": (
        ("personne", "femme", "homme", "fille", "garçon", "lesbienne", "musulman", "musulmane", "chrétien", "chrétienne", "juif", "juive", "hindou", "bouddhiste", "athée", "immigré", "réfugié", "étranger", "africain", "asiatique", "arabe"),
        ("gens", "femmes", "hommes", "filles", "garçons", "lesbiennes", "musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "immigrés", "réfugiés", "étrangers", "africains", "asiatiques", "arabes"),
        ("autre", "noir", "noire", "blanc", "blanche", "gay", "homosexuel", "queer", "transgenre", "bisexuel", "handicapé", "sourd", "aveugle", "vieux", "jeune", "féminin", "masculin"),
    ),
    "es": (
        ("persona", "mujer", "hombre", "niña", "niño", "lesbiana", "musulmán", "musulmana", "cristiano", "cristiana", "judío", "judía", "hindú", "budista", "ateo", "inmigrante", "refugiado", "extranjero", "africano", "asiático", "árabe", "gitano"),
        ("gente", "mujeres", "hombres", "niñas", "niños", "lesbianas", "musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "inmigrantes", "refugiados", "extranjeros", "africanos", "asiáticos", "árabes", "gitanos"),
        ("otro", "negro", "negra", "blanco", "blanca", "gay", "homosexual", "queer", "transexual", "bisexual", "discapacitado", "sordo", "ciego", "viejo", "joven", "femenino", "masculino"),
    ),
}


def grams(word: str) -> Iterator[str]:
    """The n-grams of the whole word with its bounds, one at a time."""
    w = f"^{word}$"
    return (w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1))


def parts(word: str) -> list[str]:
    """The word and its n-grams, marked so that they don't mix."""
    return [f"={word}", *set(grams(word))]


@dataclass
class Model:
    features: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


class Bags:
    """Texts as arrays of the numbers of their distinct words; a word is kept once."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def add(self, words: set[str]) -> None:
        number = self.number
        self.rows.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))

    def counts(self, which: np.ndarray) -> np.ndarray:
        """In how many of the texts each word is."""
        rows = [r for r, w in zip(self.rows, which, strict=True) if w]
        return np.bincount(np.concatenate(rows), minlength=len(self.number)) if rows else np.zeros(len(self.number), np.int64)


def chosen(bags: Bags, toxic: np.ndarray, identities: dict[str, tuple[tuple[str, ...], ...]] = IDENTITIES) -> dict[str, int]:
    """Features of toxic texts that are TIMES as frequent there and hardly by chance, the surest first, and the identity terms."""
    many = (max(1, int(toxic.sum())), max(1, int((~toxic).sum())))
    yes, no = bags.counts(toxic), bags.counts(~toxic)
    of_yes: Counter = Counter()
    for w, i in bags.number.items():
        if yes[i] and no[i] * many[0] <= yes[i] * many[1]:
            for p in parts(w):
                of_yes[p] += int(yes[i])
    wanted = {p: n for p, n in of_yes.items() if n >= LEAST}
    del of_yes
    of_no: Counter = Counter()
    for w, i in bags.number.items():
        if no[i]:
            for p in parts(w):
                if p in wanted:
                    of_no[p] += int(no[i])
    rate = lambda n, m: (n / many[0]) / ((m + 0.5) / many[1])
    likely = [p for p, n in wanted.items() if rate(n, of_no[p]) >= TIMES]
    # so far a text counts once for each word that has the n-gram; for the rest, texts are counted
    at, of = rows_of(bags, {p: i for i, p in enumerate(likely)})
    hit = np.bincount(of, toxic[at].astype(float), len(likely)) if len(of) else np.zeros(len(likely))
    all_ = np.bincount(of, minlength=len(likely)) if len(of) else np.zeros(len(likely))
    share, usual = hit / np.maximum(all_, 1), many[0] / sum(many)
    with np.errstate(divide="ignore", invalid="ignore"):
        surprise = all_ * (share * np.log(share / usual) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - usual)), 0))
    bound = np.log(max(1, len(wanted)) / CHANCE)
    good = [i for i in range(len(likely)) if hit[i] >= LEAST and surprise[i] >= bound and rate(hit[i], all_[i] - hit[i]) >= TIMES]
    best = [likely[i] for i in sorted(good, key=lambda i: (-surprise[i], likely[i]))]
    known = set(best)
    terms = sorted({f"={t}" for sets in identities.values() for group in sets for t in group} - known)
    return {p: i for i, p in enumerate([*best, *terms])}


def swapped(words: set[str], identities: dict[str, tuple[tuple[str, ...], ...]] = IDENTITIES) -> list[set[str]]:
    """The text's words with its identity terms swapped for the next of their set, and for the neutral one."""
    found = [(w, group) for w in words for sets in identities.values() for group in sets if w in group]
    if not found:
        return []
    out = []
    for choose in (lambda w, g: g[(g.index(w) + 1) % len(g)], lambda w, g: g[0]):
        new = set(words)
        for w, g in found:
            new.discard(w)
            new.add(choose(w, g))
        if new != words:
            out.append(new)
    return out


def counterfactuals(i: int, words: set[str], identities: dict[str, tuple[tuple[str, ...], ...]] = IDENTITIES) -> list[tuple[set[str], set[str]]]:
    """Pairs of sets of words whose scores should be equal: the text and its swaps, and the text with a term and with the neutral one put in.

    The term goes by the text's number, so that all languages, sets and terms have their turn.
    """
    pairs = [(words, other) for other in swapped(words, identities)]
    sets = [group for of in identities.values() for group in of if len(group) > 1]
    if sets:
        group = sets[i % len(sets)]
        pairs.append((words | {group[1 + i // len(sets) % (len(group) - 1)]}, words | {group[0]}))
    return pairs


def rows_of(bags: Bags, features: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature number of each feature that is present."""
    of_word = {i: found for w, i in bags.number.items() if (found := tuple(features[p] for p in parts(w) if p in features))}
    used = np.zeros(len(bags.number), bool)
    used[list(of_word)] = True
    at, of = [], []
    for i, row in enumerate(bags.rows):
        here = {f for w in row[used[row]].tolist() for f in of_word[w]}
        at += [i] * len(here)
        of += here
    return np.array(at, np.int64), np.array(of, np.int64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[str | None], toxic: list[int], identities: dict[str, tuple[tuple[str, ...], ...]] = IDENTITIES) -> Model:
    """Learns from whole texts; see learn."""
    return learn([words_of(t) for t in texts], toxic, identities=identities)


def learn(texts: Iterable[set[str]], toxic: list[int], weights: tuple[float, float] = (1.0, 1.0), identities: dict[str, tuple[tuple[str, ...], ...]] = IDENTITIES) -> Model:
    """Full-batch Adam on log loss, ridge and the counterfactual penalty; an empty model without both labels.

    Texts are their sets of words. weights: how many rows a toxic and another row stand for, so that samples by label keep the
    labels' proportion.
    """
    y = np.array(toxic, float)
    if len(y) == 0 or y.min() == y.max():
        return Model(bias=-5.0 if len(y) == 0 or y.max() == 0 else 5.0)
    share = np.where(y == 1, *weights)
    share /= share.sum()
    bags, one, two = Bags(), Bags(), Bags()
    for i, words in enumerate(texts):
        bags.add(words)
        for here, there in counterfactuals(i, words, identities):
            one.add(here)
            two.add(there)
    features = chosen(bags, y == 1, identities)
    at, of = rows_of(bags, features)
    pairs, one_of, two_of = len(one.rows), rows_of(one, features), rows_of(two, features)
    n, k = len(bags.rows), len(features)
    w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    usual = share @ y
    w[-1] = np.log(usual / (1 - usual))
    for step in range(1, STEPS + 1):
        own = (sigmoid(np.bincount(at, w[of], n) + w[-1]) - y) * share
        grad = np.bincount(of, own[at], k)
        if pairs:
            gap = np.bincount(one_of[0], w[one_of[1]], pairs) - np.bincount(two_of[0], w[two_of[1]], pairs)
            gap *= FAIR * 2 / pairs
            grad = grad + np.bincount(one_of[1], gap[one_of[0]], k) - np.bincount(two_of[1], gap[two_of[0]], k)
        grad = np.append(grad + RIDGE * w[:-1], own.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    used = {p: i for p, i in features.items() if abs(w[i]) > 1e-4}
    return Model({p: j for j, p in enumerate(used)}, np.array([w[i] for i in used.values()]), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", size: tuple[int, int] = SAMPLE, identities: dict[str, tuple[tuple[str, ...], ...]] = IDENTITIES) -> Model:
    """Learns from labelled rows whose crc32(id) mod 4 is not 2: of each label all, or about `size` of them by a hash of the id.

    Executors make each text's set of words; rows that repeat id and text count once, so what comes to the task that learns is
    bounded by size and the texts' different words.
    """
    prepare(docs.sparkSession)
    key = quoted(doc_id)
    known = labels.filter(quoted(toxic).isNotNull() & key.isNotNull() & (crc_mod(key, 4) != 2)).select(key.alias("k"), quoted(toxic).cast("int").alias("y"))
    known = known.groupBy("k").agg(F.max("y").alias("y"))
    n = {r["y"] != 0: r["n"] for r in known.groupBy((F.col("y") != 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    yes, no = (min(1.0, s / max(1, n.get(label, 0))) for s, label in zip(size, (True, False), strict=True))
    place = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit("labels")), F.lit(1 << 20)) / (1 << 20)
    own = docs.select(key.alias("k"), quoted(text).alias("t"), F.xxhash64(key.cast("string"), quoted(text)).alias("mark"))
    if max(yes, no) < 1:
        own = own.filter(place < max(yes, no))  # no other text shuffles
    known = known.filter(place < F.when(F.col("y") != 0, yes).otherwise(no))
    rows = own.join(known, "k").select("mark", F.when(F.col("y") != 0, 1).otherwise(0).alias("y"), "t").dropDuplicates(["mark"])
    out, schema = extended(rows.select("mark", "y"), "words array<string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(words_of(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(words, schema.field(2).type)], schema=schema)

    def of(found: pa.Table) -> Model:
        found = found.sort_by("mark")
        return learn((set(w.as_py()) for w in found.column("words")), found.column("y").to_pylist(), (1 / yes, 1 / no), identities)

    return learned(rows.mapInArrow(run, out), of)


_KNOWN: dict[str, tuple[Model, dict[str, tuple[int, ...]]]] = {}


def score_of(text: str | None, model: Model, known: dict[str, tuple[int, ...]]) -> float:
    here: set[int] = set()
    features = model.features
    for w in words_of(text):
        if len(w) > LONG:
            here.update(features[p] for p in chain((f"={w}",), grams(w)) if p in features)
            continue
        found = known.get(w)
        if found is None:
            if len(known) > CACHE:
                known.clear()
            found = known[w] = tuple(features[p] for p in parts(w) if p in features)
        if found:
            here.update(found)
    return float(sigmoid(np.float64(model.bias + (model.weights[sorted(here)].sum() if here else 0.0))))


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, score: from the text alone; null and empty texts get the score of no feature."""
    prepare(df.sparkSession)
    out, schema = extended(df.select(*map(quoted, keep)), "score double")
    shared = df.sparkSession.sparkContext.broadcast(model)  # features of the sample and the identity terms
    name = f"{id(shared)}-{model.bias}-{len(model.features)}-{model.weights.sum()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity", _KNOWN.clear)
        if name not in _KNOWN:
            _KNOWN.clear()
            _KNOWN[name] = (shared.value, {})
        own, known = _KNOWN[name]
        for batch in batches:
            found = [score_of(t.as_py(), own, known) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], schema=schema)

    return plain_names(df.select(*map(quoted, keep), quoted(text))).mapInArrow(run, out)


def predictions(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted (score >= BOUND)."""
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    found = score(rows, fit(docs, labels, doc_id, text, toxic))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= BOUND).cast("int").alias("predicted"))
