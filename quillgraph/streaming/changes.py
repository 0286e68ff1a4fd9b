"""File changes as streams: debouncing, incremental re-analysis and the spread of deletions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillgraph.operators import scan
from quillgraph.schemas import CHANGE


def read_changes(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of change events from JSON files; so many files a batch bound the queue."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_a_batch).json(path)


def of_extensions(changes: DataFrame, *extensions: str) -> DataFrame:
    return changes.filter(F.col("is_dir") | F.regexp_extract("path", r"\.([^.]+)$", 1).isin(*extensions))


def debounce(changes: DataFrame, gap: str = "500 milliseconds", delay: str = "10 seconds", root: str | None = None) -> DataFrame:
    """One row for each path and burst: the last change, its batch id, start and end.

    A burst ends after a quiet gap. It is taken within a watched root (a column), so roots are independent; without one all
    changes are one sequence, as a single watcher's are. Works on streams (with the delay as watermark) and on batches.
    """
    rows = changes.withWatermark("ts", delay) if changes.isStreaming else changes
    key = F.col(root) if root else F.when(F.col("path").isNull(), "none").otherwise("all")  # a stream's sessions need a key that isn't constant
    event = F.struct("path", "ts", "change", "is_dir")
    bursts = rows.groupBy(F.session_window("ts", gap).alias("w"), key.alias("root")).agg(F.collect_list(event).alias("events"))
    # in order of path and time, a path's last change is the one before the next path
    ordered = F.array_sort("events")
    after = F.slice(ordered, 2, F.size("events"))
    marked = F.zip_with(ordered, after, lambda a, b: F.struct(a.alias("e"), F.coalesce(a["path"] != b["path"], F.lit(True)).alias("last")))
    out = bursts.select("root", "w", F.explode(marked).alias("m")).filter("m.last").select("root", "w", F.col("m.e").alias("e"), F.col("m.e.path").alias("path"))
    return out.select(F.sha2(F.concat_ws("|", "root", F.col("w.start").cast("string")), 256).alias("batch_id"), "path", F.col("e.change").alias("change"), F.col("e.is_dir").alias("is_dir"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))


def debounce_batch(changes: DataFrame, gap_s: float, by: list[str] | None = None) -> DataFrame:
    """The same over a table, by gaps: burst number within the key, path, last change. No list of events is held, and a key's (or, without one, all) events may lie in many tasks."""
    order = ["ts", "path"]
    held = scan.shifted(scan.chunks(changes, by or [F.lit(0)], order), order, __before=F.col("ts"))
    apart = F.coalesce((F.col("ts").cast("double") - F.col("__before").cast("double") >= gap_s).cast("int"), F.lit(0))
    numbered = scan.plain(scan.totals(held, order, burst=apart))
    return numbered.groupBy(*(by or []), "burst", "path").agg(F.max_by("change", F.struct("ts", "change")).alias("change"), F.count("*").alias("events"))


def content_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("hash", F.xxhash64("content"))


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """files (path, content) whose hash isn't the known one (path, hash)."""
    return content_hash(files).join(known.select("path", "hash"), ["path", "hash"], "left_anti")


def deleted(known: DataFrame, files: DataFrame) -> DataFrame:
    return known.join(files.select("path"), "path", "left_anti").select("path")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and change (add, change, unlink) between two snapshots of (path, hash)."""
    both = before.select("path", F.col("hash").alias("h1")).join(after.select("path", F.col("hash").alias("h2")), "path", "full")
    kind = F.when(F.col("h1").isNull(), "add").when(F.col("h2").isNull(), "unlink").when(F.col("h1") != F.col("h2"), "change")
    return both.select("path", kind.alias("change")).filter("change IS NOT NULL")


def incremental(stream: DataFrame, known: Callable[[], DataFrame], analyse: Callable[[DataFrame], None], checkpoint: str, trigger: dict | None = None):  # noqa: ANN201
    """Start re-analysis of each batch's files whose content changed. known gives the present (path, hash) table.

    analyse may be called again for a batch after a failure, so it must replace a file's rows, not add to them.
    """

    def each(batch: DataFrame, _: int) -> None:
        newest = batch.withColumn("n", F.row_number().over(W.partitionBy("path").orderBy(F.desc("modified")))).filter("n = 1").drop("n")
        analyse(changed(newest, known()))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def every(stream: DataFrame, work: Callable[[DataFrame], None], checkpoint: str, period: str = "5 minutes"):  # noqa: ANN201
    """Run work on each period's rows: consolidation, clean-up."""
    return stream.writeStream.foreachBatch(lambda b, _: work(b)).option("checkpointLocation", checkpoint).trigger(processingTime=period).start()
