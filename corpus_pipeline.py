"""A corpus from raw documents to packed sequences: each stage works on all that its predecessor kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import exact, language, packing, simhash, toxicity
from quillgraph.llm.common import remove, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic. It learns from the labels of these documents."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, keep=COLUMNS).filter(F.col("score") < toxicity.BOUND).select(*COLUMNS)


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: not those without a letter, nor those that look less like any learned language than nearly all known rows do."""
    return language.identify(docs, language.fit(docs), keep=COLUMNS).filter(~F.col("rejected")).select(*COLUMNS)


def once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact.distinct(docs.select(*COLUMNS))


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document, that with the smallest id."""
    return simhash.distinct(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents, each in its sequence."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", clean), ("language", in_a_language), ("exact dedup", once), ("near dedup", apart), ("packing", packed)]

#: Trained classifiers and SimHash are beyond SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def finished(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again as the next one's input.

    With a folder, a stage whose table is finished there is not run again, and all tables stay. Without one, a stage's table
    goes when the next one's is written. Rows that repeat an id are rows of their own in all stages but near dedup, which keeps
    one of each group of alike texts whatever their ids.
    """
    docs, own = spark.read.parquet(f"{sf_dir}/documents.parquet"), folder or f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        if not finished(spark, f"{own}/{i}"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{own}/{i}")
        docs = spark.read.parquet(f"{own}/{i}")
        if folder is None and i:
            remove(spark, f"{own}/{i - 1}")
    return docs
