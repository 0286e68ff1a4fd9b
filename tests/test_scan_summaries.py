"""Summaries of scans are few, whatever the number of keys."""

from pyspark.sql import functions as F

from quillgraph.operators import scan


def test_summaries_are_of_two_keys_a_chunk(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = scan.ended(scan.chunks(spark.range(4000).selectExpr("id % 1000 AS k", "id"), "k", ["id"]))
        chunks = held.select(scan.CHUNK).distinct().count()
        assert chunks > 1 and held.filter(scan.END).select(scan.KEY, scan.CHUNK).distinct().count() <= 2 * chunks
        assert scan.totals(held, ["id"], n=F.lit(1)).groupBy("k").agg(F.max("n").alias("n")).filter("n <> 4").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
