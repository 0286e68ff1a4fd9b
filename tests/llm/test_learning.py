"""What is learned from a sample is learned by one task, not on the driver."""

import os

import numpy as np
from pyspark.sql import functions as F

from quillgraph.llm import language, toxicity
from quillgraph.llm.common import crc_mod


def elsewhere(learn):
    driver = os.getpid()

    def run(*args, **named):
        assert os.getpid() != driver, "learned on the driver"
        return learn(*args, **named)

    return run


def test_language_is_learned_by_a_task(spark, monkeypatch):
    rows = [(i, " ".join(w + "aeiou"[(i + j) % 5] for j, w in enumerate(("kort", "melt", "salv") if i % 2 else ("unni", "wessa", "goro"))), ("xa", "yb")[i % 2]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    here = language.learn(*language.sample(docs.filter(crc_mod(F.col("doc_id"), 3) != 1), "text", "lang", "doc_id"))
    monkeypatch.setattr(language, "learn", elsewhere(language.learn))
    there = language.fit(docs)
    assert there.languages == here.languages == ["xa", "yb"] and np.array_equal(there.logits, here.logits)
    assert np.array_equal(there.known, here.known) and (there.temperature, there.reject, there.strange) == (here.temperature, here.reject, here.strange)


def test_toxicity_is_learned_by_a_task(spark, monkeypatch):
    rows = [(i, f"than{i % 7} ther inge" + " scumlike" * (i % 5 == 0), int(i % 5 == 0)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    monkeypatch.setattr(toxicity, "learn", elsewhere(toxicity.learn))
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), size=(50, 200))
    assert toxicity.score_of("than scumlike", model, {}) > 0.3 > toxicity.score_of("than ther", model, {})
