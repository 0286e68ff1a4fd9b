"""Language and toxicity classifiers: held-out accuracy on synthetic rows, edge cases and fairness."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from quillgraph.llm import language, toxicity

STEMS = {"xa": ["kor", "tav", "mel", "sut"], "xb": ["vlim", "prosk", "drun", "zhek"], "xc": ["aouie", "ieua", "oaio", "uiea"]}


def corpus(n=300, seed=2):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(STEMS))
        out.append((i, " ".join(r.choice(STEMS[lang]) + r.choice(STEMS[lang]) for _ in range(r.randint(3, 40))), lang))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 0.0) for r in rows], "doc_id long, text string, lang string, source string, score double")


def test_language_on_held_out(spark):
    rows = corpus() + [(1000, None, "xa"), (1001, "", "xa"), (1002, "12 34 ²", "xb"), (1003, "kor " * 30000, None), (1004, "x", "xa"), (None, "kortav", "xa"), (5, "kortav", "xa")]
    got = language.predictions(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {g["doc_id"]: g for g in got if g["doc_id"] not in (5, None)}
    held = [r for r in rows[:300] if r[0] != 5 and zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(by[i]["held_out"] for i, *_ in held) and np.mean([by[i]["lang_pred"] == lang for i, _, lang in held]) > 0.95
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and all(by[i]["rejected"] for i in (1000, 1001, 1002))
    assert by[1003]["lang_pred"] == "xa" and all(0 <= g["score"] <= 1 for g in got)
    assert {g["lang_pred"] for g in got} <= {"und", *STEMS}


def test_language_does_not_learn_from_held_out_rows_or_labels_of_others(spark):
    rows = [(i, "kortav meltav", "xa") if zlib.crc32(str(i).encode()) % 3 != 1 else (i, "kortav meltav", "zz") for i in range(60)]
    assert {g["lang_pred"] for g in language.predictions(frame(spark, rows)).collect()} == {"xa"}


def test_language_without_rows(spark):
    assert language.predictions(frame(spark, [])).count() == 0
    assert [g["lang_pred"] for g in language.predictions(frame(spark, [(1, "abc", None)])).collect()] == ["und"]


def test_rejection_is_where_it_is_wrong_more_often_than_right():
    model = language.train([t for _, t, _ in corpus()], [g for *_, g in corpus()])
    words = language.Words(model)
    right = sum(language.predict(words, t)[0] == g and language.predict(words, t)[1] > model.reject for _, t, g in corpus(200, 9))
    assert right >= 190


def toxic_rows(n=600, seed=3):
    r = random.Random(seed)
    neutral = [a + b for a in ("than", "ther", "inge", "ouse", "lyon") for b in ("ed", "er", "in", "on", "at")]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(neutral) for _ in range(r.randint(5, 60))]
        bad = r.random() < 0.3
        if bad:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), r.choice(["scumlike", "vequ" + r.choice(["an", "er", "il", "os"])]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out(spark):
    rows, labels = toxic_rows()
    extra = [(2000, None), (2001, ""), (2002, "thaned " * 40000 + "scumlike vequan"), (None, "scumlike vequan vequer"), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, "x") for r in rows + extra], "doc_id long, text string, toxic string")
    marks = spark.createDataFrame(labels + [(None, 1, 1), (7000, 1, 1), (4, 1, labels[4][2])], "doc_id long, quality int, toxic int")
    got = toxicity.predictions(docs, marks).collect()
    assert len(got) == len(rows) + len(extra)
    by = {g["doc_id"]: g for g in got}
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(by[i]["held_out"] for i, _ in held) and np.mean([by[i]["predicted"] == y for i, y in held]) > 0.97
    assert by[2000]["predicted"] == by[2001]["predicted"] == 0 and by[2002]["predicted"] == 1 and by[None]["predicted"] == 1
    assert all((g["score"] >= 0.3) == g["predicted"] for g in got)


def test_toxicity_learns_rare_labels_from_samples_by_label(spark):
    """At a hundredth of toxic rows a word of theirs is learned though as many clean rows have it, and clean rows stay clean."""
    r = random.Random(5)
    neutral = [a + b for a in ("than", "ther", "inge", "ouse", "lyon") for b in ("ed", "er", "in", "on", "at")]
    rows, labels = [], []
    for i in range(6000):
        bad = i % 100 == 0
        words = [r.choice(neutral) for _ in range(20)] + (["scumlike"] if bad or i % 97 == 1 else [])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for size in ((100_000, 100_000), (40, 1500)):
        model = toxicity.fit(docs, marks, size=size)
        assert "=scumlike" in model.features
        assert toxicity.score_of("thaned scumlike", model, {}) > 0.3 > toxicity.score_of("thaned thered", model, {})


def plain_score(text, model):
    """The sum over all features that a plain search finds in the text's marked words."""
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    marked = {f"^{w}$" for w in words}
    z = model.bias
    for p, i in model.features.items():
        if (p[1:] in words) if p.startswith("=") else any(p in m for m in marked):
            z += model.weights[i]
    return 1 / (1 + np.exp(-z))


def test_scores_against_a_plain_version():
    rows, labels = toxic_rows()
    model = toxicity.train([t for _, t in rows], [y for *_, y in labels])
    for text in [t for _, t in rows[:150]] + [None, "", "a" * 300 + "vequ" + "b" * 300, "Muslim SCUMLIKE women"]:
        assert abs(toxicity.score_of(text, model, {}) - plain_score(text, model)) < 1e-9


def plain_language(text, model):
    """The mean of the logits of all n-grams of all words, then a softmax."""
    total, n = np.zeros(len(model.languages)), 0
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        for k in language.GRAMS:
            for i in range(len(w) + 3 - k):
                total += model.logits[zlib.crc32(f"<{w}>"[i : i + k].encode()) % language.BUCKETS]
                n += 1
    z = np.exp((total / n + model.bias) / model.temperature)
    return model.languages[int(z.argmax())], float(z.max() / z.sum())


def test_languages_against_a_plain_version():
    model = language.train([t for _, t, _ in corpus()], [g for *_, g in corpus()])
    words = language.Words(model)
    for text in [t for _, t, _ in corpus(100, 9)] + ["x", "É" * 200, "kor vlim aouie"]:
        got, want = language.predict(words, text), plain_language(text, model)
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-4


def test_toxicity_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [g["predicted"] for g in toxicity.predictions(docs, none).collect()] == [0, 0]
    assert toxicity.predictions(docs.limit(0), none).count() == 0


def test_naming_a_group_is_not_held_against_a_text(monkeypatch):
    r = random.Random(6)
    neutral = [a + b for a in ("than", "ther", "inge") for b in ("ed", "er", "in", "on")]
    texts, y = [], []
    for i in range(800):
        words = [r.choice(neutral) for _ in range(20)]
        bad = i % 4 == 0
        if bad and i % 8 == 0:
            words.append("scumlike")
        if bad and r.random() < 0.7 or not bad and r.random() < 0.02:
            words.append("muslim")
        texts.append(" ".join(words))
        y.append(int(bad))
    fair = toxicity.train(texts, y)
    monkeypatch.setattr(toxicity, "FAIR", 0.0)
    plain = toxicity.train(texts, y)
    gap = lambda m: toxicity.score_of("thaned muslim", m, {}) - toxicity.score_of("thaned person", m, {})
    assert gap(plain) > 0.2 and abs(gap(fair)) < 0.3 * gap(plain)
    assert toxicity.score_of("scumlike thaned", fair, {}) > 0.3


def test_rejection_spares_what_is_right():
    r = np.random.default_rng(3)
    foreign = np.linspace(0.3, 0.7, 101)
    assert language.rejection(np.linspace(0.98, 1, 1001), foreign) == 0.5  # far apart: half of what is foreign goes
    logits = 3 + r.exponential(1.0, 400)
    logits[:40] = 3 - r.exponential(0.5, 40)
    bound = language.rejection(1 / (1 + np.exp(-logits)), foreign)
    many = np.append(3 - r.exponential(0.5, 100_000), 3 + r.exponential(1.0, 900_000))
    assert 0 < bound <= 0.5 and (1 / (1 + np.exp(-many)) < bound).mean() < 5 * language.WRONGED
    assert language.rejection(np.array([0.4, 0.9, 0.95]), foreign) <= 0.4
    assert language.rejection(np.array([]), foreign) == 0.0 == language.rejection(logits, np.array([]))


def test_training_stays_bounded_on_few_short_repetitive_rows():
    for texts in ([t for _, t, _ in corpus()], ["kor"] * 60 + ["vlim"] * 60, ["kor " * 5000] * 30 + ["vlim " * 5000] * 30):
        labels = ["xa" if t.startswith(("kor", "tav", "mel", "sut")) else "xb" for t in texts]
        model = language.train(texts, labels)
        assert np.isfinite(model.logits).all() and np.abs(model.logits).max() <= language.DIMENSIONS * language.WEIGHT**2
        assert np.abs(model.bias).max() < 100 and 1e-3 < model.temperature < 1e3 and 0 <= model.reject <= 1
        words = language.Words(model)
        assert np.mean([language.predict(words, t)[0] == g for t, g in zip(texts, labels)]) > 0.95


def test_temperature_is_the_likeliest():
    r = np.random.default_rng(2)
    z = r.normal(size=(4000, 3)) * 2
    right = np.array([r.choice(3, p=p) for p in language.softmax(z)])
    for t in (0.05, 1.0, 8.0):
        assert abs(np.log(language.calibrated(z * t, right) / t)) < 0.15
    apart = np.eye(2)[np.arange(100) % 2] * 4
    assert 1e-3 < language.calibrated(apart, np.arange(100) % 2) < 2  # all right: still inside


def test_rejection_takes_scripts_never_seen_and_dealt_letters():
    rows = corpus(900, 4)
    model = language.train([t for _, t, _ in rows], [g for *_, g in rows])
    words, gone = language.Words(model), lambda t: (lambda g: g[1] < model.reject or g[2] > model.strange)(language.predict(words, t))
    assert all(gone(t) for t in ("Это простой русский текст о погоде", "这是一个简单的中文句子关于天气", "qwx zzkp wbnm wertz plok", "Ω" * 100))
    assert np.mean([gone(language.shuffled(t)) for _, t, _ in corpus(300, 8)]) >= 0.5
    assert np.mean([gone(t) for _, t, _ in corpus(3000, 9)]) <= 0.002
    assert language.strangeness(np.zeros(0), np.ones(3)) == 1.0 == language.strangeness(np.zeros(3), np.zeros(0))
    assert language.strangeness(np.linspace(0, 0.1, 1000), np.full(50, 0.05)) >= 0.1  # not apart: right rows stay


def test_bags_and_samples_are_bounded(spark, monkeypatch):
    r = random.Random(1)
    text = " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(3000))
    ids, share = language.bag(text, {})
    assert len(ids) == len(share) == language.DRAWN and abs(share.sum() - 1) < 1e-3
    half = language.bag(text[len(text) // 2 :], {})[0]
    assert len(np.intersect1d(ids, half)) > language.DRAWN / 10  # drawn from all of the text
    monkeypatch.setattr(language, "ROWS", 100)
    monkeypatch.setattr(language, "LANGUAGES", 20)
    rows = [(i, f"kor{i}tav", f"l{i % 30:02}") for i in range(3000)]
    found, _ = language.sample(frame(spark, rows), "text", "lang", "doc_id")
    assert len({g for _, g in found}) <= 20 and len(found) < 300


def test_names_with_dots(spark):
    df = spark.createDataFrame([(i, "kortav meltav", "xa") for i in range(20)], "`my.id` long, `the.text` string, `the.lang` string")
    assert {g["lang_pred"] for g in language.predictions(df, "my.id", "the.text", "the.lang").collect()} == {"xa"}


def test_rejection_takes_texts_of_no_language_and_leaves_others(spark):
    """Of unseen letters dealt at random most go, of the learned languages nearly nothing."""
    rows = corpus(900, 4)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    strange = [(10_000 + i, language.shuffled(t), None) for i, t, _ in held]
    got = {g["doc_id"]: g["rejected"] for g in language.predictions(frame(spark, rows + strange)).collect()}
    assert np.mean([got[i] for i, *_ in held]) <= 0.02
    assert np.mean([got[i] for i, *_ in strange]) >= 0.5


def test_sample_is_bounded_by_rows_that_differ(spark):
    rows = [(1, "kortav meltav", "xa")] * 500 + [(i, f"kor{'tav' * (i % 7)}", "xa") for i in range(2, 60)]
    found, foreign = language.sample(frame(spark, rows), "text", "lang", "doc_id", 1000)
    assert len(found) <= 59 and len(foreign) < len(found)


def test_long_runs_are_read_whole():
    """What stands in the middle of a run of letters counts, and n-grams only join neighbours."""
    run = "a" * 60 + "badword" + "b" * 60
    model = toxicity.Model({"adwor": 0, "aaabbb": 1}, np.array([9.0, 9.0]), -5.0)
    assert toxicity.score_of(run, model, {}) > 0.9 and toxicity.score_of("a" * 30 + "c" + "b" * 30, model, {}) < 0.1
    assert "adwor" in toxicity.parts(run) and f"={run}" in toxicity.parts(run)
    assert len(language.subwords(run)) == sum(len(run) + 2 - n + 1 for n in language.GRAMS)
    logits = np.zeros((language.BUCKETS, 2), np.float32)
    logits[language.subwords("qz")[1] % language.BUCKETS, 1] = 5000
    words = language.Words(language.Model(["aa", "qq"], logits, np.array([1.0, 0.0]), 1.0, 0.0, np.zeros(language.KNOWN // 8, np.uint8), 1.0))
    assert language.predict(words, "a" * 101 + "qz" + "a" * 100)[0] == "qq" and language.predict(words, "a" * 203)[0] == "aa"
    assert not words


def test_every_fit_has_counterfactuals_in_all_languages():
    rows, labels = toxic_rows(200)
    seen = [pair for i, (_, t) in enumerate(rows) for pair in toxicity.counterfactuals(i, toxicity.words_of(t))]
    assert len(seen) == len(rows)  # no text names a group, yet each has a pair
    put = {w for one, two in seen for w in one - two}
    assert {"woman", "frau", "femme", "mujer"} <= put
    both = toxicity.counterfactuals(0, {"der", "muslim"})
    assert ({"der", "muslim"}, {"der", "person"}) in both and len(both) == 3
    assert toxicity.counterfactuals(0, {"a"}, {}) == []


def neutral_mentions(model):
    """Share of neutral sentences that name a group and are called toxic."""
    frames = {"en": "the {} went to the market", "de": "die {} ging zum markt", "fr": "la {} va au marché", "es": "la {} fue al mercado"}
    found = [toxicity.score_of(frames[lang].format(t), model, {}) >= toxicity.BOUND for lang, sets in toxicity.IDENTITIES.items() for group in sets for t in group]
    return np.mean(found)


def test_false_positives_on_neutral_mentions_with_and_without_the_penalty(monkeypatch):
    """Insults that share letters with groups' names, and texts that are toxic about groups: the penalty takes most false positives."""
    r = random.Random(8)
    neutral = [a + b for a in ("than", "ther", "inge") for b in ("ed", "er", "in", "on")]
    groups = ["muslims", "juden", "arabes", "gitanos", "immigrants", "schwule"]
    texts, y = [], []
    for i in range(900):
        words = [r.choice(neutral) for _ in range(20)]
        bad = i % 3 == 0
        if bad:
            words.append(r.choice(["scumlike", "musliminx", "judenqx", "arabesqx"]))
            if r.random() < 0.5:
                words.append(r.choice(groups))
        texts.append(" ".join(words))
        y.append(int(bad))
    fair = toxicity.train(texts, y)
    monkeypatch.setattr(toxicity, "FAIR", 0.0)
    plain = toxicity.train(texts, y)
    assert neutral_mentions(plain) > 0.03 and neutral_mentions(fair) <= 0.2 * neutral_mentions(plain)
    held = [(" ".join(r.choice(neutral) for _ in range(20)) + " scumlike", True) for _ in range(50)] + [(" ".join(r.choice(neutral) for _ in range(20)), False) for _ in range(50)]
    assert all((toxicity.score_of(t, fair, {}) >= toxicity.BOUND) == bad for t, bad in held)


def test_all_features_that_pass_are_kept():
    """More of them than any fixed number: each of 5,000 words of its own is in enough toxic texts."""
    words = [f"x{'abcdefghij'[i // 1000]}q{'abcdefghij'[i // 100 % 10]}z{'abcdefghij'[i // 10 % 10]}v{'abcdefghij'[i % 10]}k" for i in range(5000)]
    r = random.Random(1)
    texts = [" ".join(words[i] for i in r.sample(range(5000), 500)) for _ in range(100)] + ["than there ing"] * 900
    bags = toxicity.Bags()
    for t in texts:
        bags.add(toxicity.words_of(t))
    found = toxicity.chosen(bags, np.arange(1000) < 100)
    assert sum(f"={w}" in found for w in words) > 4500


def test_hashes_of_many_words_at_once():
    words = ["a", "bc", "aé", "日本語", "x😀y", "\ud800", "z" * 90, "Ω" * 40_000, "kortav"]
    ids, begins = language.hashes_of(words)
    plain = [[zlib.crc32(f"<{w}>"[i : i + n].encode("utf-8", "replace")) % language.KNOWN for n in language.GRAMS for i in range(len(w) + 3 - n)] for w in words]
    assert [x.tolist() for x in np.split(ids, begins[1:])] == plain
    text = " ".join(words[:1] * 3 + words[1:])
    n = Counter(h for w in language.WORD.findall(text.lower()) for h in language.subwords(w).tolist())
    ids, share = language.bag(text)
    assert len(ids) == language.DRAWN or dict(zip(ids.tolist(), (share * n.total()).round().astype(int).tolist())) == n


def test_new_words_are_worked_out_together_and_bags_come_packed(monkeypatch):
    r = random.Random(3)
    made = lambda: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(200))
    texts = [made() for _ in range(20)]
    model = language.train(texts, ["xa", "xb"] * 10)
    one = [language.predict(language.Words(model), t) for t in [*texts, None, "12", "a" * 200]]
    calls, real = [], language.hashes_of
    monkeypatch.setattr(language, "hashes_of", lambda words: calls.append(len(words)) or real(words))
    words = language.Words(model)
    many = language.predictions_of(words, [*texts, None, "12", "a" * 200])
    assert [m[0] for m in many] == [o[0] for o in one] and np.allclose([m[1:] for m in many], [o[1:] for o in one], atol=1e-5)
    assert len(calls) <= 4 and len(words) == 4000  # 4000 calls before
    for t in texts:
        ids, share = language.bag(t)
        found = language.unpacked(language.packed(t))
        assert (found[0] == ids).all() and (found[1] == share).all() and len(language.packed(t)) < 3.2 * len(ids)  # 8 bytes each before
