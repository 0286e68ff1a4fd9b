"""Audit logs, metrics and graph exports as text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import schemas


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit events of JSON lines; malformed lines are skipped."""
    return spark.read.schema(schemas.AUDIT).option("mode", "DROPMALFORMED").json(path)


def append_audit(events: DataFrame, path: str, records_a_file: int = 1_000_000) -> None:
    """Append, a folder for each day and files of bounded length."""
    events.withColumn("event_date", F.substring("timestamp", 1, 10)).write.mode("append").option("maxRecordsPerFile", records_a_file).partitionBy("event_date").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Nested columns as JSON text, all values quoted."""
    flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def markdown_report(title: str, rows: DataFrame, limit: int = 100) -> str:
    """A table of the first rows; a report is for reading, so it is short."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    return f"# {title}\n\n{head}\n" + "\n".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.limit(limit).collect()) + "\n"


def prometheus(metrics: DataFrame) -> DataFrame:
    """One text line for each sample of (name, label, value)."""
    label = F.when(F.coalesce("label", F.lit("")) == "", "").otherwise(F.concat(F.lit('{label="'), F.replace("label", F.lit('"'), F.lit('\\"')), F.lit('"}')))
    return metrics.select(F.concat("name", label, F.lit(" "), F.col("value").cast("string")).alias("line"))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def graph_statements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """CREATE statements, one a line: nodes before edges by `part`."""
    n = nodes.select(F.lit(0).alias("part"), F.concat(F.lit("CREATE (:"), F.initcap("node_type"), F.lit(" {id: "), _quoted(F.col("id")), F.lit(", content: "), _quoted(F.col("content")), F.lit("})")).alias("line"))
    e = edges.select(F.lit(1).alias("part"), F.concat(F.lit("MATCH (a {id: "), _quoted(F.col("src")), F.lit("}), (b {id: "), _quoted(F.col("dst")), F.lit("}) CREATE (a)-[:"), "edge_type", F.lit("]->(b)")).alias("line"))
    return n.unionByName(e)


def graph_xml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML elements, one a line, in order of `part`: head, nodes, edges, foot."""
    spark = nodes.sparkSession
    escape = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    frame = spark.createDataFrame([(0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'), (3, "</graph></graphml>")], "part int, line string")
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), escape(F.col("id")), F.lit('"/>')).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), escape(F.col("src")), F.lit('" target="'), escape(F.col("dst")), F.lit('"/>')).alias("line"))
    return frame.unionByName(n).unionByName(e)


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def import_graph(spark: SparkSession, path: str, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Both frames with the given schemas."""
    return spark.read.schema(nodes).json(f"{path}/nodes"), spark.read.schema(edges).json(f"{path}/edges")
