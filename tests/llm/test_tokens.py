"""BPE and packing against the tokenizers library and plain rebuilds."""

import hashlib
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from quillgraph.llm import bpe, packing

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "a", "aaa aaaa aaaaaaaa", "ΑΣ ΣΑΣ όσος", "İstanbul ²³½ 10³", "don't we're I'LL 'SAID ''s", "<|endoftext|> a<|startoftext|>b <|endoftext", "日本語 한국어 ١٢٣", "a\x1cb\x85c\xa0d", "é Å ﬁ", "🎉🎉 👨‍👩‍👧 ___ __x_", "\x00\x01 \ufeff",
    "q" * 3000, "  x \n\n y\t\t", "ab" * 300 + " " + "the" * 99, "the cat " * 4000,
]


def some(n=150, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice("abehtnirs aeiou'.,1é\n") for _ in range(r.randint(0, 200))) for _ in range(n)]


def test_automaton_encodes_as_the_library():
    ours, theirs = bpe.WordBpe(WORD), Tokenizer.from_file(WORD)
    for text in ODD + some():
        want = theirs.encode(text, add_special_tokens=False).ids
        got = ours.encode(text)
        assert got == want, text[:80]
        assert ours.decode(got) == theirs.decode(got, skip_special_tokens=False)


def test_merging_a_symbol_with_itself_goes_left_to_right():
    a = bpe.Automaton({"a": 0, "aa": 1, "aaaa": 2}, [("a", "a"), ("aa", "aa")])
    assert [a.encode_word("a" * n) for n in range(1, 8)] == [[0], [1], [1, 0], [2], [2, 0], [2, 1], [2, 1, 0]]


def plain_gadgets(vocab, merges):
    """The automaton with all arcs written out: each gadget carried out on dicts of arcs."""
    made = {y + z for y, z in merges}
    arcs = {0: {t: 0 for s, t in vocab.items() if s not in made}}
    for left, right in merges:
        u, v, uv = vocab[left], vocab[right], vocab[left + right]
        targets = {a[u] for a in arcs.values() if u in a}
        if not targets:
            continue
        assert len(targets) == 1  # all arcs of a label lead to one state
        target = targets.pop()
        if v not in arcs[target]:
            continue
        led, new = arcs[target][v], len(arcs)
        arcs[new] = {t: s for t, s in arcs[target].items() if t != v}
        for a in arcs.values():
            if u in a and a is not arcs[new]:
                a[uv] = led
        if u in arcs[new]:
            arcs[new][uv] = led
        for a in arcs.values():
            if u in a:
                a[u] = new
    return arcs


def test_states_and_arcs_are_what_the_gadgets_say():
    r = random.Random(11)
    for _ in range(40):
        tokens, merges = ["a", "b", "c"], []
        while len(merges) < 12:
            left, right = r.choice(tokens), r.choice(tokens)
            if left + right not in tokens:
                merges.append((left, right))
                tokens.append(left + right)
        vocab = {t: i for i, t in enumerate(tokens)}
        a, want = bpe.Automaton(vocab, merges), plain_gadgets(vocab, merges)
        assert len(a.parent) == len(want)
        for state, arcs in want.items():
            assert {t: a.step(state, t) for t in vocab.values() if a.step(state, t) >= 0} == arcs
        assert {k: v for k, v in a.next.items() if v >= 0} == {s * a.n + t: to for s, arcs in want.items() for t, to in arcs.items()}
        for _ in range(50):
            word = "".join(r.choice("abc") for _ in range(r.randint(1, 14)))
            got, state = a.encode_word(word), 0
            assert got == plain_merges(word, merges, vocab), (word, merges)
            for t in got:
                state = a.step(state, t)
                assert state >= 0


def plain_merges(word, merges, vocab):
    parts = list(word)
    for left, right in merges:
        i = 0
        while i < len(parts) - 1:
            if (parts[i], parts[i + 1]) == (left, right):
                parts[i : i + 2] = [left + right]
            i += 1
    return [vocab[p] for p in parts]


def test_every_code_point_alone_and_between_letters():
    ours, theirs = bpe.WordBpe(WORD), Tokenizer.from_file(WORD)
    known = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    # of the large blocks of one kind (ideographs, syllables, private use) every 37th
    wanted = [c for c in known if c % 37 == 0 or not (0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4 or 0xE000 <= c < 0xF900 or 0x17000 <= c < 0x18D00 or 0x20000 <= c)]
    wanted += [c for c in known if c >= 0x20000 and unicodedata.category(chr(c)) == "Cn" and regex.match(r"[\p{L}\p{N}]", chr(c))]
    texts = [" ".join(f"{chr(c)} a{chr(c)}b" for c in wanted[i : i + 60]) for i in range(0, len(wanted), 60)]
    for text, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ours.encode(text) == e.ids, [hex(ord(c)) for c in set(text) if ours.encode(f"{c} a{c}b") != theirs.encode(f"{c} a{c}b", add_special_tokens=False).ids]


def test_long_words_are_not_kept():
    ours, other = bpe.WordBpe(WORD), packing.ByteTokens(BYTE)
    for text in ("q" * 5000, "w" * 100_000):
        ours.encode(text)
        other.encode([text])
    assert all(len(w) <= bpe.LONG for w in ours.words) and all(len(w) <= packing.LONG for w in other.known)


def rows(spark, texts, extra=True):
    data = [(i, t, "x", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, ids string, length int" if extra else "doc_id long, text string, a string, b int")


def test_digests(spark):
    theirs = Tokenizer.from_file(WORD)
    texts = [*ODD, None, "same", "same"]
    got = {r["doc_id"]: r for r in bpe.digests(rows(spark, texts), WORD).collect()}
    for i, t in enumerate(texts):
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(rows(spark, []), WORD).count() == 0


def test_decode_of_column(spark):
    df = spark.createDataFrame([(1, [320, 5]), (2, None)], "doc_id long, ids array<int>")
    got = dict(bpe.decode(df, WORD).collect())
    assert got[2] == "" and len(got[1].split(" ")) == 2


def test_byte_tokens_are_the_librarys():
    ours, theirs = packing.ByteTokens(BYTE), Tokenizer.from_file(BYTE)
    texts = ODD + some()
    want = [np.array(e.ids, "<u4").tobytes() for e in theirs.encode_batch(texts, add_special_tokens=False)]
    assert ours.encode(texts) == want


@pytest.mark.parametrize(("n", "want"), [(0, []), (1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (20, [(0, 4), (4, 8), (12, 8)])])
def test_cut(n, want):
    assert packing.cut(n, 8) == want


def sound(counts, n, runs, size):
    seen, bins = Counter(), {}
    for length, lo, hi, first, offset in runs:
        seen[length] += hi - lo
        for j in range(hi - lo):
            bins.setdefault(first + j, []).append((offset, length))
    assert seen == Counter({k: v for k, v in counts.items() if v}) and set(bins) == set(range(n))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size


def test_plans_hold_and_are_near_the_volume():
    r = random.Random(3)
    for _ in range(8):
        size = r.choice([16, 100, 2048])
        counts = {r.randint(1, size): r.choice([1, 2, 30, 1000]) for _ in range(r.choice([1, 4, 60]))}
        for parameters in ((40, 1 / 2), (5, 1 / 3), (8, 1 / 8)):
            sound(counts, *packing.plan(dict(counts), size, *parameters), size)
        n, runs = packing.best_plan(counts, size)
        sound(counts, n, runs, size)
        assert n >= -(-sum(k * c for k, c in counts.items()) // size)
    mixed = {k: 20 for k in range(20, 2049, 19)}
    n, _ = packing.best_plan(mixed)
    assert n <= 1.06 * sum(k * c for k, c in mixed.items()) / 2048
    assert packing.best_plan({}) == (0, [])


def test_configurations_reach_the_fractional_optimum():
    found = packing.configurations([6, 4], [10, 10], 10)
    assert abs(sum(x for _, x in found) - 10) < 1e-6  # 6 + 4 each


def test_pack(spark):
    theirs = Tokenizer.from_file(BYTE)
    texts = [*ODD, None, "same", "same", *some(40)]
    got = packing.pack(rows(spark, texts), BYTE, with_ids=True).toPandas()
    for doc, part in got.sort_values("piece").groupby("doc_id"):
        ids = [*theirs.encode(texts[doc] or "", add_special_tokens=False).ids, 0]
        assert [i for x in part["ids"] for i in x] == ids
        assert list(part["start"]) == [s for s, _ in packing.cut(len(ids), 2048)]
        for _, p in part.iterrows():
            assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert list(part["offset"]) == [0, *np.cumsum(part["length"])[:-1]] and part["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) + 2
    assert set(got["doc_id"]) == set(range(len(texts)))
    assert packing.pack(rows(spark, []), BYTE).count() == 0
    null_ids = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    assert packing.pack(null_ids, BYTE).count() == 2


def test_configurations_find_what_best_fit_misses():
    """400 each of 900, 700 and 448 fill 400 bins exactly; best fit by itself takes 450."""
    counts = {900: 400, 700: 400, 448: 400}
    assert packing.plan(counts, 2048, 1, 1.0)[0] == 450 and packing.best_plan(counts)[0] == 400
    # lengths that go on beyond a group begin the next one, and are not rounded up
    assert packing.groups_of(counts, 40) == [(900, [(900, 400)]), (700, [(700, 400)]), (448, [(448, 400)])]
    assert packing.groups_of({9: 3, 8: 3, 7: 10, 6: 1}, 4) == [(9, [(9, 3)]), (8, [(8, 3)]), (7, [(7, 10)]), (6, [(6, 1)])]


def test_plans_of_many_lengths_meet_the_volume_by_configurations_of_several_large_pieces():
    r = random.Random(4)
    counts = Counter(min(2048, int(r.lognormvariate(6.3, 0.8)) + 1) for _ in range(12_000))
    n, runs = packing.best_plan(counts)
    assert n <= packing.plan(dict(counts), 2048, 1, 1.0)[0] and n <= -(-sum(k * c for k, c in counts.items()) // 2048) + 3
    for share in (1.0, 0.25):
        many, rows = packing.plan(dict(counts), share=share)
        large = Counter()
        for length, lo, hi, first, _ in rows:
            if length > 2048 * packing.LARGE:
                for b in range(first, first + hi - lo):
                    large[b] += 1
        assert sum(n > 1 for n in large.values()) > many / 4


def test_column_generation_goes_on_to_the_best():
    """Many sizes and one after another that improves: the value is that of a plain linear program's bound."""
    r = random.Random(3)
    sizes = sorted(r.sample(range(130, 1500), 90), reverse=True)
    need = [r.randint(50, 400) for _ in sizes]
    used = packing.configurations(sizes, need, 2048)
    assert all(sum(s * n for s, n in zip(sizes, c)) <= 2048 for c, _ in used)
    for i, n in enumerate(need):
        assert sum(c[i] * x for c, x in used) >= n - 1e-3
    assert sum(x for _, x in used) <= sum(s * n for s, n in zip(sizes, need)) / 2048 * 1.01
