"""The pipeline's stages take effect, keep documents' columns and give what plain versions give."""

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillgraph.llm import queries


@pytest.fixture(scope="module")
def small():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, small):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).checkpoint()
        out.append(docs)
    return out


def test_order_and_columns(spark, small, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "exact dedup", "near dedup", "packing"]
    columns = spark.read.parquet(f"{small}/documents.parquet").columns
    assert all(s.columns == columns for s in stages[:-1])


def test_each_stage_keeps_and_drops_what_it_should(spark, small, stages):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    clean, spoken, once, apart, packed = stages
    labels = spark.read.parquet(f"{small}/labels.parquet")
    good = labels.filter("toxic = 0").join(docs, "doc_id")
    bad = labels.filter("toxic = 1").join(docs, "doc_id")
    assert good.join(clean, "doc_id", "left_semi").count() >= 0.97 * good.count()
    assert bad.join(clean, "doc_id", "left_semi").count() <= 0.2 * bad.count()
    assert spoken.count() >= 0.97 * clean.count()
    texts = {}
    for r in spoken.collect():
        texts.setdefault(" ".join(r["text"].split()) if r["text"].strip() else r["text"], []).append(r["doc_id"])
    assert {r["doc_id"] for r in once.collect()} == {min(v) for v in texts.values()}
    from test_dedup import plain_components, plain_fingerprint

    rows = sorted((r["doc_id"], r["text"]) for r in once.collect())
    ids = [i for i, _ in rows]
    assert {r["doc_id"] for r in apart.collect()} == set(plain_components(ids, [plain_fingerprint(t) for _, t in rows]))
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = {r["doc_id"]: len(tokens.encode(r["text"], add_special_tokens=False).ids) + 1 for r in apart.collect()}
    got = packed.groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in got} == n
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_run_is_the_stages(spark, small, stages):
    got = queries.pipeline(spark, small)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, stages[-1].select(*key).collect()))


def test_finished_stages_are_not_run_again(spark, small, monkeypatch, tmp_path):
    first = corpus_pipeline.run(spark, small, str(tmp_path / "run")).count()

    def fails(*_):
        raise AssertionError("run again")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, fails) for n, _ in corpus_pipeline.STAGES])
    assert corpus_pipeline.run(spark, small, str(tmp_path / "run")).count() == first


def test_columns_of_other_names_are_no_trouble(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for c in ("key", "row", "own", "maybe", "mark", "score", "block", "fingerprint", "piece", "__text", "rejected"):
        docs = docs.withColumn(c, docs.doc_id)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).checkpoint()
    assert docs.count() > 0


def test_odd_documents_pass_through(spark, small, tmp_path):
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "the cat and the dog", None, None, 1), (2, "the cat and the dog", None, None, 1), (3, "x " * 50000, "en", "s", 1)]
    df = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (df, df.limit(0)):
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path)).checkpoint()
        docs.count()
