"""Queries over all documents against Python, on rows that the queries with SQL leave out."""

import re
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import pytest

from quillgraph.functions.text import EVENT_VERBS
from quillgraph.plans import basic  # noqa: F401  registers its queries
from quillgraph.plans.registry import QUERIES

TEXTS = [
    "# Title one\nThe **bold** service was started. It is `code` and [a link](http://x.y) here!\n## Sub part\nplain",
    "# \n  # Later title\nEl ni\u00f1o est\u00e1 aqu\u00ed, \u00c9NASA and NASA met Ada Lovelace in 2024-05-01 about 1.2.3 and 10.20.30",
    "First line without heading that is much longer than fifty characters\n2024/05/02 the job Ended\n2024-05-03 nothing\nno date started\n\u00e92024-01-02 it started\u00e9",
    "Acme Widget Works and Grand Old Duke went. Tag### words### are*** here... End? Yes indeed it is!",
    "die stra\u00dfe und gr\u00f6\u00dfe und stra\u00dfe, caf\u00e9cremes caf\u00e9cremes",
    "",
]
SIZES = [512, 1536, 1075, 1024 * 1024, 3 * 1024 * 1024 // 2, 1280]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("documents")
    rows = [(i, x, "en" if i % 2 else "de", "src", n) for i, (x, n) in enumerate(zip(TEXTS, SIZES, strict=True))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def title(x):
    for line in x.split("\n"):
        if line.strip().startswith("# "):
            return line.strip()[2:].strip()
    return x.split("\n")[0].strip()[:50] or "Untitled"


def keywords(x):
    n = Counter(w for w in re.split(r"\s+", re.sub(r"[^\w\s]", " ", x.lower(), flags=re.A)) if len(w) > 3)
    return sorted(n.items(), key=lambda p: (-p[1], p[0]))[:10]


def headings(x):
    return [(m[2], len(m[1])) for line in x.split("\n") if (m := re.match(r"(#+)\s+(.+)$", line.strip()))]


def sentences(x):
    for pattern, by in ((r"#+\s*", ""), (r"\*\*(.*?)\*\*", r"\1"), (r"\*(.*?)\*", r"\1"), (r"`(.*?)`", r"\1"), (r"\[(.*?)\]\(.*?\)", r"\1"), (r"\n+", " ")):
        x = re.sub(pattern, by, x)
    return [s.strip() for s in re.split("[.!?]+", x) if len(s.strip()) > 10]


def events(x):
    verb = re.compile(rf"\b({'|'.join(EVENT_VERBS)})\b", re.I | re.A)
    return [(line.strip(), m[1].replace("/", "-")) for line in x.split("\n") if (m := re.search(r"\b(\d{4}[-/]\d{2}[-/]\d{2})\b", line, re.A)) and verb.search(line)]


def entities(x):
    name = "[A-Z][a-z]+"
    kinds = {"person": f"{name} {name}", "organization": f"{name} {name} {name}", "acronym": "[A-Z][A-Z][A-Z]+", "date": r"\d{4}-\d{2}-\d{2}", "version": r"\d+\.\d+\.\d+"}
    return [(m, k) for k, p in kinds.items() for m in re.findall(rf"\b{p}\b", x, re.A)]


def label(n):
    unit = max(i for i in range(5) if i == 0 or n >= 1024**i)
    return f"{(Decimal(n) / 1024**unit).quantize(Decimal('0.1'), ROUND_HALF_UP)} {['B', 'KB', 'MB', 'GB', 'TB'][unit]}" if unit else f"{n} B"


def found(spark, folder, name, plain):
    return {r[0]: plain(r[1]) for r in QUERIES[name](spark, folder).collect()}


@pytest.mark.parametrize("given", ["fixture", "table"])
def test_all_documents(spark, small, folder, given):
    at = folder if given == "fixture" else small
    docs = {r["doc_id"]: (r["text"], r["n_chars"]) for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    each = lambda f: {k: f(x) for k, (x, _) in docs.items()}
    pairs = lambda v: [(a, str(b)) for a, b in v]
    assert found(spark, at, "f02_all_titles", str) == each(title)
    assert found(spark, at, "f05a_all_headings", lambda v: [tuple(h) for h in v]) == each(headings)
    assert found(spark, at, "f05b_all_sentences", list) == each(sentences)
    assert found(spark, at, "f05d_all_events", pairs) == each(events)
    assert found(spark, at, "f05e_all_entities", pairs) == each(entities)
    assert found(spark, at, "f24_all_byte_sizes", str) == {k: label(n) for k, (_, n) in docs.items()}
    words = {(r["id"], r["word"], r["n"]) for r in QUERIES["f04_all_keywords"](spark, at).collect()}
    assert words == {(k, w, n) for k, (x, _) in docs.items() for w, n in keywords(x)}
    previews = sorted((r["size"], r["headings"], r["sentences"]) for r in QUERIES["a32_all_previews"](spark, at).collect())
    assert previews == sorted((len(x), len(headings(x)), len(sentences(x))) for x, _ in docs.values())
