"""Document corpora on disk: markdown files with frontmatter, source files, snapshots and migrations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T

FRONT = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?"


def front_map(text: Column) -> Column:
    """map<string,string> of the frontmatter's `key: value` lines."""
    pairs = F.filter(F.split(F.regexp_extract(text, FRONT, 1), r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z0-9_\-]+\s*:"))
    return F.map_from_entries(F.array_distinct(F.transform(pairs, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]+):(.*)$", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^([^:]+):(.*)$", 2)), "^[\"']|[\"']$", "").alias("v")))))


def relative(root: str) -> Column:
    """The file's path below root."""
    return F.regexp_replace(F.col("_metadata.file_path"), f"^.*?{re.escape(root.strip('/'))}/", "")


def read_markdown(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """path, content, metadata (JSON), category, size, modified of all files below root."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    rows = raw.select(relative(root).alias("path"), F.col("value").alias("raw"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))
    given = F.element_at(front_map(F.col("raw")), "category")
    return rows.select("path", F.regexp_replace("raw", FRONT, "").alias("content"), F.to_json(front_map(F.col("raw"))).alias("metadata"), F.coalesce(given, T.category(F.col("path"))).alias("category"), "size", "modified")


def read_one(docs: DataFrame, path: str) -> DataFrame:
    return docs.filter(F.col("path") == path)


def under(docs: DataFrame, prefix: str) -> DataFrame:
    return docs.filter(F.startswith("path", F.lit(prefix))).orderBy(F.desc("modified"), "path")


def put(docs: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """docs with new (path, content, metadata) in place of what had its path; lastUpdated and category are set."""
    stamped = new.withColumn("category", T.category(F.col("path"))).withColumn("size", F.octet_length("content").cast("long")).withColumn("modified", now)
    return docs.join(new.select("path"), "path", "left_anti").unionByName(stamped, allowMissingColumns=True)


def remove(docs: DataFrame, paths: DataFrame) -> DataFrame:
    return docs.join(paths.select("path"), "path", "left_anti")


def markdown_only(docs: DataFrame) -> DataFrame:
    return docs.filter(F.lower("path").rlike(r"\.(md|markdown)$"))


def category_edges(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Category nodes and BELONGS_TO edges of the documents."""
    edges = docs.select(F.col("path").alias("src"), F.concat(F.lit("category:"), "category").alias("dst"), F.lit("BELONGS_TO").alias("edge_type")).dropDuplicates(["src", "dst", "edge_type"])
    return edges.select(F.col("dst").alias("id"), F.lit("category").alias("node_type")).distinct(), edges


def write_snapshot(docs: DataFrame, path: str, fmt: str = "json") -> None:
    docs.write.mode("overwrite").format(fmt).save(path)


def read_snapshot(spark: SparkSession, path: str, fmt: str = "json", schema: str | None = None) -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def switch(spark: SparkSession, docs: DataFrame, path: str, fmt: str = "parquet", migrate: bool = True) -> DataFrame:
    """The documents of another store, after copying to it if asked."""
    if migrate:
        docs.write.mode("overwrite").format(fmt).save(path)
    return spark.read.format(fmt).load(path)


def new_version(docs: DataFrame, root: str, version: int, gone: DataFrame | None = None) -> None:
    """A snapshot folder for the version; what was deleted is kept in a folder beside it."""
    docs.withColumn("version", F.lit(version)).write.mode("errorifexists").parquet(f"{root}/version={version}")
    if gone is not None:
        gone.write.mode("overwrite").parquet(f"{root}/deleted={version}")


def read_sources(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("ts", "tsx", "js", "jsx", "py"), ignore: tuple[str, ...] = ("node_modules", "dist", ".git"), max_bytes: int = 5 * 1024 * 1024) -> DataFrame:
    """path, content, size, modified, language of source files; a scan names each path once; ignored folders and too large files are left out by metadata."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{" + ",".join(extensions) + "}")
    rows = raw.filter(F.col("_metadata.file_size") <= max_bytes).select(relative(root).alias("path"), F.col("value").alias("content"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))
    skip = F.lit(False)
    for folder in ignore:
        skip = skip | F.contains(F.concat(F.lit("/"), "path"), F.lit(f"/{folder}/"))
    return rows.filter(~skip).withColumn("language", T.language(F.col("path")))


def batch_plan(files: DataFrame) -> DataFrame:
    """files with the priority and estimated seconds of their analysis."""
    priority = F.when(F.col("path").rlike(r"(^|/)(index|main|app)\.[a-z]+$"), 3).when(F.contains("path", F.lit("test")), 1).otherwise(2)
    return files.withColumn("priority", priority).withColumn("seconds", F.greatest(F.lit(0.1), F.col("size") / 50_000.0))


def migrate(docs: DataFrame) -> DataFrame:
    """Nodes from documents: the document, its headings (concepts), factual sentences, dated events and named entities."""
    base = docs.select("path", "content")
    node = lambda kind, text, rank: (F.concat_ws("#", "path", F.lit(kind), rank.cast("string")).alias("id"), F.lit(kind).alias("node_type"), text.alias("content"), F.col("path").alias("source"))
    whole = base.select(*node("document", F.col("content"), F.lit(0)))
    each = lambda c: base.select("path", F.posexplode(c).alias("n", "x"))
    concepts = each(T.headings(F.col("content"))).select(*node("concept", F.col("x.text"), F.col("n")))
    facts = each(F.filter(T.sentences(F.col("content")), T.is_factual)).select(*node("fact", F.col("x"), F.col("n")))
    dated = each(T.events(F.col("content"))).select(*node("event", F.col("x.description"), F.col("n")))
    named = each(F.array_distinct(T.entities(F.col("content")))).select(*node("entity", F.col("x.name"), F.col("n")))
    return whole.unionByName(concepts).unionByName(facts).unionByName(dated).unionByName(named)


def migration_stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(F.count("*").alias("nodes"), F.count_distinct("source").alias("documents"))


def vectors(nodes: DataFrame) -> DataFrame:
    """Nodes that have a vector; all of them."""
    return nodes.filter(F.col("embedding").isNotNull())
