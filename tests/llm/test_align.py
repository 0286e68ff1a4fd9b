"""Alignment of two tokenizers against a plain version over whole texts."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillgraph.llm import align
from quillgraph.llm.bpe import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    None, "", " ", "  ", "a", "a ", "a\n", "\n", "a\n\n b\t c", "▁x y", "x<|endoftext|>y <s> </s> <0x41>", "日本語 한국어 १२३", "a　b  c", "don't we're I'LL", "🎉🎉 👨‍👩‍👧 é é",
    "\x00 \x1c a\x85b\r\n c;\r d", "q" * 3000, "the cat " * 500, "the cat " * 500, "antidisestablishmentarianism " * 3, " x ​ y", "tail ",
]


def some(n=120, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice("abehtnirs aeiou  '.,1é\n▁\t") for _ in range(r.randint(0, 150))) for _ in range(n)]


def plain(texts):
    """Whole texts, byte by byte; all pairs of occurrences."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {c: i for i, c in enumerate(byte_alphabet())}
    out, links = [], []
    for text in texts:
        x, y = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        xs = [bytes(back[c] for c in a.id_to_token(i)) for i in x]
        ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        want = (" " + (text or "")).encode()
        if not text or b"".join(xs) != want or b"".join(ys) != want:
            out.append([0, 0, 0, 0, ""])
            links.append(Counter())
            continue
        ends = [{0} | {sum(map(len, s[: k + 1])) for k in range(len(s))} for s in (xs, ys)] if len(want) < 4000 else [{0}, {0}]
        if len(want) >= 4000:
            for s, e in ((xs, ends[0]), (ys, ends[1])):
                at = 0
                for t in s:
                    at += len(t)
                    e.add(at)
        cuts, groups = sorted(ends[0] & ends[1]), []
        for ids, pieces, side in ((x, xs, 0), (y, ys, 1)):
            at, g = 0, 0
            for i, t in zip(ids, pieces):
                while at >= cuts[g + 1]:
                    g += 1
                if side == 0:
                    while len(groups) <= g:
                        groups.append(([], []))
                groups[g][side].append(i)
                at += len(t)
        pairs = Counter((p, q) for l, r in groups for p in l for q in r)
        shown = ";".join(f"{','.join(map(str, l))}|{','.join(map(str, r))}" for l, r in groups)
        out.append([len(x), len(y), len(groups), sum(pairs.values()), sha256(shown.encode()).hexdigest()])
        links.append(pairs)
    docs = Counter(p for c in links for p in c)
    best = {}
    for (p, _), n in docs.items():
        best[p] = max(best.get(p, 0), n)
    return [(*o[:4], sum(n for p, n in c.items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in c.items()), o[4]) for o, c in zip(out, links)]


def rows(df):
    return sorted(tuple(r[c] for c in NAMES) for r in df.collect())


@pytest.mark.parametrize("block,share,large", [(align.BLOCK, align.HOT_SHARE, align.LARGE), (30, 1 / 20, 3), (100, 1.0, 1)])
def test_documents_against_a_plain_version(spark, monkeypatch, block, share, large):
    monkeypatch.setattr(align, "HOT_SHARE", share)  # no, some or nearly all ids are split
    monkeypatch.setattr(align, "BLOCK", block)
    monkeypatch.setattr(align, "ADDED", block)
    monkeypatch.setattr(align, "LARGE", large)
    texts = ODD + some()
    df = spark.createDataFrame([(i // 2, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, row int, pairs string").repartition(5)
    want = sorted((i // 2, *w) for i, w in enumerate(plain(texts)))
    assert rows(align.align(df, A, B)) == want


def test_real_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    read = docs.select("doc_id", "text").collect()
    want = sorted((r["doc_id"], *w) for r, w in zip(read, plain([r["text"] for r in read])))
    assert rows(align.align(docs, A, B)) == want


def test_empty_tables_null_ids_and_other_names(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert rows(align.align(df, A, B)) == []
    df = spark.createDataFrame([(None, "a b"), (None, "a b")], "`my.id` string, `the.text` string")
    got = align.align(df, A, B, "my.id", "the.text").collect()
    assert [(r["doc_id"], r["n_a"], r["count_sum"]) for r in got] == [(None, 2, 4)] * 2


def test_groups_of_many_tokens_are_counted_by_distinct_ids(monkeypatch):
    for large in (align.LARGE, 3):
        monkeypatch.setattr(align, "LARGE", large)
        both = align.Aligner(A, B)
        ids = np.array([1, 1, 4]), np.array([2, 3, 4])
        both.align(*ids, np.array([5, 10, 11]), np.array([4, 10, 11]), np.array([2, 3]), np.array([2, 3]))  # a group of four links, and one of one
        assert both.stats.rows[:2, :4].tolist() == [[2, 2, 1, 4], [1, 1, 1, 1]] and both.shown == ["1,1|2,3", "4|4"]
        first, many = both.stats.rows[0, 4:].tolist()
        assert [(int(c) >> align.SHIFT, int(c) & 0xFFFFFF, int(n)) for c, n in both.pairs.rows[first : first + many]] == [(1, 2, 2), (1, 3, 2)]


def test_pair_table(spark):
    blocks = spark.createDataFrame([(1, 5, 1), (1, 5, 1), (1, 6, 1), (2, 6, 1), (2, 7, 1)], "a int, b int, docs int")
    assert sorted(tuple(r) for r in align.pair_counts(blocks).collect()) == [(1, 5, 2, True), (1, 6, 1, False), (2, 6, 1, True), (2, 7, 1, True)]


def test_both_byte_encoders_agree(tmp_path):
    import json

    spec = json.load(open(A))
    spec["pre_tokenizer"]["trim_offsets"] = False  # not the plain kind: goes by the library
    (tmp_path / "b.json").write_text(json.dumps(spec))
    fast, slow = align.ByteModel(A), align.ByteModel(str(tmp_path / "b.json"))
    texts = [t for t in ODD + some() if t]
    assert [fast.encode(t) for t in texts] == [slow.encode(t) for t in texts]
