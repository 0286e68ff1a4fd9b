"""Numbers of tokens against the libraries, and the summaries of frequent pre-tokens."""

import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillgraph.llm import counts

FILES = [public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model")]
ODD = [
    None, "", " ", "\n", "a", "don't we're I'LL", "<|endoftext|> a<|startoftext|>b <|endoftext", "日本語 한국어 १२३", "a\x1cb\x85c\xa0d", "é Å ﬁ", "🎉🎉 👨‍👩‍👧 ___", "\x00\x01 ﻿",
    "q" * 3000, "  x \n\n y\t\t", "ab" * 300 + " " + "the" * 99, "the cat " * 4000, "a  b▁c </s><unk>", "İstanbul ΑΣ ΣΑΣ",
]


def some(n=150, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice("abehtnirs aeiou  '.,1é\n") for _ in range(r.randint(0, 200))) for _ in range(n)]


def library(path):
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    model = Tokenizer.from_file(path)
    return lambda t: len(model.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("path", FILES)
@pytest.mark.parametrize("kept,cache", [(counts.KEPT, counts.CACHE), (5, 3)])
def test_counts_are_the_library_s(spark, monkeypatch, path, kept, cache):
    monkeypatch.setattr(counts, "CACHE", cache)
    texts = ODD + some()
    df = spark.createDataFrame([(i // 2, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string, n_tokens int").repartition(40)
    known = counts.frequent(df.selectExpr("coalesce(text, '') AS text"), path, kept)
    assert len(known.sizes) == len(known.ends) == len(known.entries()) and (kept > 5 or len(known.sizes) == 5)
    size = library(path)
    want = sorted((i // 2, len((t or "").encode()), size(t or ""), size(t or "") > 100) for i, t in enumerate(texts))
    assert sorted(tuple(r) for r in counts.count(df, path, limit=100, known=known).collect()) == want
    if kept > 5:
        assert sorted(tuple(r) for r in counts.count(df, path, limit=100).collect()) == want


def test_summaries_hold_what_is_frequent_however_they_are_merged():
    r = random.Random(1)
    words = [f"w{int(r.paretovariate(1.1))}" for _ in range(40_000)]
    exact, kept = Counter(words), 50
    merged = Counter()
    for at in range(0, len(words), 1000):
        merged = counts.pruned(merged + counts.pruned(Counter(words[at : at + 1000]), kept), kept)
    assert len(merged) <= kept and all(w in merged for w, n in exact.items() if n > len(words) / 10)
    assert all(n <= exact[w] for w, n in merged.items())


def test_empty_tables_null_ids_and_other_names(spark):
    path = FILES[0]
    assert counts.count(spark.createDataFrame([], "doc_id long, text string"), path).collect() == []
    df = spark.createDataFrame([(None, "a b"), (None, None)], "`my.id` string, `the.text` string")
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in counts.count(df, path, "my.id", "the.text").collect()) == [(0, 0), (3, 2)]
