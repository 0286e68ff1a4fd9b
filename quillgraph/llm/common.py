"""What the operators of this subpackage share: batch limits, shared storage and joins that survive hot keys."""

from __future__ import annotations

import gc
import pickle
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillgraph.session import shared_dir, ship

T = TypeVar("T")

#: Rows an Arrow batch may hold, so that a batch of long documents fits a Python worker.
BATCH_ROWS = 1000

#: A key with more than this share of all rows is hot; there are at most 1/HOT_SHARE such keys.
HOT_SHARE = 1 / 1000


def prepare(spark: SparkSession) -> None:
    """Ship the code, bound Arrow batches, and make sure a checkpoint folder is set (the cluster's, or one of our own where it names none)."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    shared_dir(spark)


def quoted(name: str) -> Column:
    """The column of this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def plain_names(df: DataFrame) -> DataFrame:
    """The columns as c0, c1 and so on: for functions that take them by place, as mapInArrow takes no name with a dot."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def table(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read again: later passes read it, and a lost executor doesn't recompute it."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*tables: DataFrame) -> None:
    """Remove the files of tables that nothing reads any more."""
    for df in tables:
        rdd = df._jdf.queryExecution().logical().rdd()
        if rdd.getCheckpointFile().isDefined():
            remove(df.sparkSession, rdd.getCheckpointFile().get())


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder of the shared storage, wherever it is."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def extended(df: DataFrame, ddl: str) -> tuple[StructType, pa.Schema]:
    """The schema of df with more fields, for Spark and for Arrow."""
    out = StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])
    return out, to_arrow_schema(out)


_HELD: dict[str, Callable[[], object]] = {}


def hold(owner: str, clear: Callable[[], object]) -> None:
    """In a worker: caches of one operator at a time. `owner` uses its own from now on; what others hold is cleared."""
    for other in [k for k in _HELD if k != owner]:
        _HELD.pop(other)()
    _HELD[owner] = clear


def learned(sample: DataFrame, learn: Callable[[pa.Table], T]) -> T:
    """What learn makes of a bounded sample, worked out in one task: of sample and work the driver gets the result alone."""
    schema = to_arrow_schema(sample.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("learning", lambda: None)
        rows = pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, schema=schema) for b in batches], schema)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(learn(rows))], pa.binary())})

    found = sample.repartition(1).mapInArrow(run, "model binary").toArrow()
    return pickle.loads(found.column("model")[0].as_py()) if found.num_rows else learn(schema.empty_table())


def rows_of(batches: Iterator[pa.RecordBatch], work: Callable[..., list], schema: pa.Schema, slice_rows: int = 250) -> Iterator[pa.RecordBatch]:
    """Apply work to slices of each batch: it takes the columns as Python lists and returns the output columns."""
    gc.set_threshold(200_000, 50, 1000)  # caches hold many strings and no cycles
    for batch in batches:
        for at in range(0, batch.num_rows, slice_rows):
            part = batch.slice(at, slice_rows)
            columns = work(*(c.to_pylist() for c in part.columns))
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows inner join groups (one row per key, with its number of rows in `size`) on key, without a hot key landing in one task.

    Keys with more than HOT_SHARE of all rows are at most 1/HOT_SHARE, so they are broadcast whatever the input's size;
    the rest is joined by key, where no key has more than that share.
    """
    limit = max(8, int(total * HOT_SHARE))
    hot, cold = groups.filter(F.col(size) > limit), groups.filter(F.col(size) <= limit)
    by_hot = rows.join(F.broadcast(hot), key, "inner")
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return by_hot.unionByName(others.join(cold, key, "inner"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null ids: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
