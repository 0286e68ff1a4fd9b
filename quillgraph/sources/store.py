"""A document store behind one interface: a folder of Parquet or JSON snapshots that readers switch between."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import aggregates, search
from quillgraph.sources import corpus

COLUMNS = "path STRING, content STRING, metadata STRING, category STRING, size BIGINT, modified TIMESTAMP"


class Store(ABC):
    """What every backend offers; reads are DataFrames, writes replace the current snapshot."""

    @abstractmethod
    def docs(self) -> DataFrame: ...

    @abstractmethod
    def replace(self, docs: DataFrame) -> None: ...

    def read(self, path: str) -> DataFrame:
        """The document, which counts as an access (see accesses)."""
        return corpus.read_one(self.docs(), path)

    def write(self, new: DataFrame, now: Column) -> None:
        self.replace(corpus.put(self.docs(), new, now))

    def delete(self, paths: DataFrame) -> None:
        self.replace(corpus.remove(self.docs(), paths))

    def list(self, prefix: str = "") -> DataFrame:
        return corpus.under(self.docs(), prefix)

    def search(self, query: str, **options: object) -> DataFrame:
        return search.search_documents(self.docs(), query, **options)

    def stats(self) -> DataFrame:
        return aggregates.by_category(self.docs())

    def export(self, path: str) -> None:
        corpus.write_snapshot(self.docs(), path)

    def restore(self, path: str) -> None:
        self.replace(corpus.read_snapshot(self.docs().sparkSession, path, schema=COLUMNS))

    def health(self) -> dict[str, object]:
        """healthy below a second, degraded below ten, unhealthy otherwise or where it can't be read."""
        began = time.perf_counter()
        try:
            n = self.docs().limit(1).count()
        except Exception as e:  # noqa: BLE001  any failure is what is asked for
            return {"status": "unhealthy", "error": str(e)[:200]}
        ms = (time.perf_counter() - began) * 1000
        return {"status": "healthy" if ms < 1000 else "degraded" if ms < 10_000 else "unhealthy", "ms": ms, "empty": n == 0}


class FolderStore(Store):
    """Snapshots root/v=1, v=2, ...: a write makes the next one, so readers of the last aren't disturbed and old ones stay."""

    def __init__(self, spark: SparkSession, root: str, fmt: str = "parquet") -> None:
        self.spark, self.root, self.fmt = spark, root.rstrip("/"), fmt

    def versions(self) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        done = [n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in done)

    def docs(self) -> DataFrame:
        versions = self.versions()
        if not versions:
            return self.spark.createDataFrame([], COLUMNS)
        return self.spark.read.schema(COLUMNS).format(self.fmt).load(f"{self.root}/v={versions[-1]}")

    def replace(self, docs: DataFrame) -> None:
        number = (self.versions() or [0])[-1] + 1
        out = docs
        for name, kind in (f.strip().split(" ") for f in COLUMNS.split(",")):
            out = out.withColumn(name, (F.col(name) if name in docs.columns else F.lit(None)).cast(kind))
        out.select(*(f.strip().split(" ")[0] for f in COLUMNS.split(","))).write.format(self.fmt).save(f"{self.root}/v={number}")


def accesses(reads: DataFrame) -> DataFrame:
    """Reads (path, a row each) as touches for `writes.reinforce`."""
    return reads.select(F.col("path").alias("id"))
