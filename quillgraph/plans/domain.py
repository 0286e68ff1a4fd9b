"""The library's frames (documents, nodes, edges, functions, audit events ...) as views of the test tables.

Each view is a table and a list of expressions that Spark and DuckDB both read; SECOND stands for whole seconds of a timestamp.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND = {"spark": r"unix_micros(CAST(\1 AS TIMESTAMP)) div 1000000", "duckdb": r"CAST(floor(epoch_us(\1) / 1000000) AS BIGINT)"}

VIEWS: dict[str, tuple[str, list[str]]] = {
    "docs": ("documents", [
        "doc_id AS id", "concat(source, '/', doc_id, '.md') AS path", "text AS content", "n_chars AS size", "lang", "source", "doc_id AS modified_s",
        "CASE doc_id % 7 WHEN 0 THEN 'active' WHEN 1 THEN 'completed' WHEN 2 THEN 'legacy' WHEN 3 THEN 'status' WHEN 4 THEN 'compliance' WHEN 5 THEN 'architecture' ELSE 'general' END AS category",
    ]),
    "functions": ("part", [
        "p_partkey AS id", "p_name AS name", "concat('src/', lower(replace(p_brand, '#', '_')), '.ts') AS file_path", "CAST(p_partkey % 997 AS INT) AS line", "p_size AS complexity", "CAST(p_partkey * 7 % 260 AS INT) AS line_count",
        "CASE p_partkey % 3 WHEN 0 THEN 'typescript' WHEN 1 THEN 'javascript' ELSE 'python' END AS language", "CASE WHEN p_partkey % 4 = 0 THEN 'private' ELSE 'public' END AS visibility",
        "concat(p_name, '(', lower(p_type), ')') AS signature", "CAST(p_partkey % 12 AS INT) AS param_count", "p_partkey % 3 <> 0 AS documented", "p_partkey % 97 AS class_id", "(p_partkey * 37 % 101) / 100e0 AS importance",
    ]),
    "classes": ("supplier", ["s_suppkey AS id", "s_name AS name", "CAST(s_suppkey * 31 % 2500 AS INT) AS line_count", "s_nationkey AS nation"]),
    "modules": ("customer", ["c_custkey AS id", "c_name AS name", "c_mktsegment AS segment", "c_nationkey AS nation"]),
    "nodes": ("part", [
        "p_partkey AS id", "CASE p_partkey % 8 WHEN 0 THEN 'concept' WHEN 1 THEN 'fact' WHEN 2 THEN 'event' WHEN 3 THEN 'entity' WHEN 4 THEN 'document' WHEN 5 THEN 'question' WHEN 6 THEN 'insight' ELSE 'memory' END AS node_type",
        "concat(p_name, CASE WHEN p_partkey % 5 = 0 THEN ' is not ' ELSE ' is ' END, lower(p_type)) AS content", "(p_partkey * 37 % 101) / 100e0 AS importance", "(p_partkey * 53 % 101) / 100e0 AS confidence", "CAST(p_size AS BIGINT) AS access_count",
        "1690000000 + p_partkey * 7919 % 5000000 AS created_s", "1695000000 + p_partkey * 3607 % 5000000 AS accessed_s", "p_partkey % 9 AS reinforcement", "0.1e0 AS decay_rate",
        "CASE p_partkey % 6 WHEN 0 THEN 'short_term' WHEN 1 THEN 'long_term' WHEN 2 THEN 'working' WHEN 3 THEN 'episodic' WHEN 4 THEN 'semantic' ELSE 'procedural' END AS memory_type",
    ]),
    "items": ("conversations", ["conv_id * 1000 + turn AS id", "conv_id AS session", "turn", "role", "text AS content", "1e0 / (1 + turn) AS priority", "(length(text) % 101) / 100e0 AS importance", "turn = 0 AS focused", "1700000000 + turn AS accessed_s"]),
    "audit": ("events", [
        "event_id", "SECOND(ts) AS second", "CASE event_type WHEN 'view' THEN 'data_access' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'auth' WHEN 'click' THEN 'authz' ELSE 'config_change' END AS event_type", "user_id", "event_type AS action",
        "props AS resource", "CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS result", "CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity", "value",
    ]),
    "samples": ("events", ["event_type AS name", "concat('u', user_id % 5) AS label", "value", "SECOND(ts) AS second", "event_id AS id", "user_id"]),
    "issues": ("orders", ["o_orderkey AS id", "o_custkey AS owner", "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity", "SECOND(o_orderdate) AS created_s", "o_orderstatus AS status", "o_totalprice AS cost"]),
    "vectors": ("embeddings", ["vec_id AS id", "embedding", "label", "concat('t', label) AS node_type"]),
}

#: One edge for each (src, dst, type) with its largest weight.
EDGE_TYPE = "CASE l_linenumber WHEN 1 THEN 'CALLS' WHEN 2 THEN 'IMPORTS' WHEN 3 THEN 'EXTENDS' WHEN 4 THEN 'DEFINES' WHEN 5 THEN 'CONTRADICTS' WHEN 6 THEN 'RELATED_TO' ELSE 'IMPLEMENTS' END"
#: Rows that a task which makes edges has at most, about; the session's number of partitions is raised where they would have more.
EDGE_ROWS = 250_000
EDGES = f"SELECT o_custkey AS src, l_partkey AS dst, {EDGE_TYPE} AS edge_type, max(round(1 - l_discount * 5, 2)) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey, {EDGE_TYPE}"


def expressions(view: str, engine: str) -> list[str]:
    return [re.sub(r"SECOND\((\w+)\)", SECOND[engine], e) for e in VIEWS[view][1]]


def duckdb(sql: str) -> str:
    """sql with @view as what the view is."""

    def view(m: re.Match) -> str:
        if m[1] == "edges":
            return f"({EDGES})"
        return f"(SELECT {', '.join(expressions(m[1], 'duckdb'))} FROM {VIEWS[m[1]][0]})"

    return re.sub(r"@(\w+)", view, sql)


class Tables:
    """The views over one folder, as attributes; `raw` gives a table as it is."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name == "edges":
            items, orders = self.raw("lineitem"), self.raw("orders")
            parts = -(-items.count() // EDGE_ROWS)
            many = parts > int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            if many:
                items, orders = items.repartition(parts, "l_orderkey"), orders.repartition(parts, "o_orderkey")
            joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            joined = joined.repartition(parts, "o_custkey", "l_partkey") if many else joined
            return joined.groupBy(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"), F.expr(EDGE_TYPE).alias("edge_type")).agg(F.max(F.round(1 - F.col("l_discount") * 5, 2)).alias("weight"))
        if name not in VIEWS:
            raise AttributeError(name)
        return self.raw(VIEWS[name][0]).selectExpr(*expressions(name, "spark"))


