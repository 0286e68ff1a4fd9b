"""Parsing goes by many tasks, in Arrow batches."""

from pyspark.sql import functions as F

from quillgraph.plans import codes, more
from quillgraph.plans.domain import Tables
from quillgraph.sources import parse


def test_parsing_is_dealt_over_all_cores(spark, small):
    t = Tables(spark, small)
    assert t.functions.rdd.getNumPartitions() < 4
    for files in (codes.sources(t), more.kinds_of_source(t)):
        assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        each = parse.entities(files).groupBy(F.spark_partition_id()).count().collect()
        assert len(each) >= spark.sparkContext.defaultParallelism


def test_a_half_surrogate_in_a_docstring(spark):
    files = spark.createDataFrame([("a.py", "python", "def f():\n    '''\\ud800'''\n"), ("b.py", "python", None), (None, "ruby", "x")], "path string, language string, content string")
    assert [(r["file_path"], r["documentation"]) for r in parse.entities(files).collect()] == [("a.py", "?")]
