"""Statistics and reports. Averages over nothing are 0, unguarded divisions by 0 are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the histogram, and quantiles of the summary.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
QUANTILES = (0.5, 0.9, 0.95, 0.99)
# Days that audit events of a type are kept.
RETENTION_DAYS = {"auth": 548, "authz": 365, "data_access": 365, "config_change": 2555, "security": 730, "error": 180}


def mean_or_zero(c: Column | str) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def beside(*rows: DataFrame) -> DataFrame:
    """Frames of one row each as one row."""
    out = rows[0].withColumn("__k", F.lit(1))
    for r in rows[1:]:
        out = out.join(r.withColumn("__k", F.lit(1)), "__k")
    return out.drop("__k")


def overall(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("total"), F.count_distinct("node_type").alias("kinds"), F.avg("importance").alias("avg_importance"), F.avg("confidence").alias("avg_confidence"))


def temporal(events: DataFrame, edges: DataFrame, second: str = "second", duration: str = "duration") -> DataFrame:
    own = events.agg(F.count("*").alias("events"), F.min(second).alias("first_s"), F.max(second).alias("last_s"), F.avg(duration).alias("avg_duration"), F.floor((F.max(second) - F.min(second)) / 86400).alias("span_days"))
    return beside(own, edges.agg(F.count("*").alias("edges")))


def working_memory(items: DataFrame, capacity: int = 20) -> DataFrame:
    """Per session: items, focused ones, mean priority, highest importance and the share of capacity in use."""
    return items.groupBy("session").agg(F.count("*").alias("items"), F.count_if("focused").alias("focused"), F.avg("priority").alias("avg_priority"), F.max("importance").alias("max_importance"), (F.count("*") / float(capacity)).alias("capacity_used"))


def vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """How many rows have a vector, and its mean size and length."""
    have = rows.filter(F.col(vector).isNotNull())
    length = F.sqrt(F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    return have.agg(F.count("*").alias("vectors"), F.avg(F.size(vector)).alias("avg_dimension"), F.avg(length).alias("avg_norm"))


def code_metrics(functions: DataFrame, classes: DataFrame, modules: DataFrame) -> DataFrame:
    own = functions.agg(F.count("*").alias("functions"), F.avg("complexity").alias("avg_complexity"), F.max("complexity").alias("max_complexity"), F.sum("line_count").alias("total_lines"))
    return beside(own, classes.agg(F.count("*").alias("classes")), modules.agg(F.count("*").alias("modules")))


def file_metrics(entities: DataFrame) -> DataFrame:
    """Per file: lines, functions, classes and 2 * functions + 3 * classes."""
    f, c = F.count_if(F.expr("entity_type = 'Function'")), F.count_if(F.expr("entity_type = 'Class'"))
    return entities.groupBy("file_path").agg(F.sum("line_count").alias("lines"), f.alias("functions"), c.alias("classes"), (2 * f + 3 * c).alias("score"))


def counts(rows: DataFrame, *by: str, name: str = "n") -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias(name))


def by_category(docs: DataFrame) -> DataFrame:
    return docs.groupBy("category").agg(F.count("*").alias("files"), F.sum("size").alias("size"))


def severities(issues: DataFrame) -> DataFrame:
    """One row with a column for each severity and the total."""
    return issues.agg(F.count("*").alias("total"), *(F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")))


def duplicates(functions: DataFrame, signature: Column) -> DataFrame:
    """Groups of functions of one normalised signature in two files or more: signature, members, files, lines, ids."""
    return functions.groupBy(signature.alias("normal")).agg(F.count("*").alias("members"), F.count_distinct("file_path").alias("files"), F.sum("line_count").alias("lines"), F.array_sort(F.collect_list("id")).alias("ids")).filter("members > 1 AND files > 1")


def distribution(functions: DataFrame) -> DataFrame:
    return functions.agg(F.count_if(F.expr("complexity <= 5")).alias("low"), F.count_if(F.expr("complexity > 5 AND complexity <= 15")).alias("medium"), F.count_if(F.expr("complexity > 15")).alias("high"))


def coupling(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Imports for each module."""
    both = beside(edges.filter("edge_type = 'IMPORTS'").agg(F.count("*").alias("imports")), modules.agg(F.count("*").alias("modules")))
    return both.withColumn("coupling", F.coalesce(F.try_divide(F.col("imports"), F.col("modules")), F.lit(0.0)))


def cohesion(members: DataFrame, calls: DataFrame) -> DataFrame:
    """Mean over classes of two members or more of calls within by n(n-1), in percent; 100 without such a class. members: id, class."""
    n = members.groupBy("class").agg(F.count("*").alias("n")).filter("n > 1")
    own = calls.select("src", "dst").distinct().filter("src <> dst")
    ends = own.join(members.select(F.col("id").alias("src"), F.col("class").alias("c1")), "src").join(members.select(F.col("id").alias("dst"), F.col("class").alias("c2")), "dst").filter("c1 = c2")
    inside = ends.groupBy(F.col("c1").alias("class")).agg(F.count("*").alias("calls"))
    each = n.join(inside, "class", "left").select((100 * F.coalesce("calls", F.lit(0)) / (F.col("n") * (F.col("n") - 1))).alias("x"))
    return each.agg(F.coalesce(F.avg("x"), F.lit(100.0)).alias("cohesion"))


def timing(samples: DataFrame, name: str = "name", ms: str = "ms") -> DataFrame:
    """Per name: total, mean, min, max, median, p95, p99 (elements at floor(n * p) of the sorted list) and runs a second.

    Ranks come from distinct values and their counts, which are combined before they shuffle, so a name's samples needn't fit a row.
    """
    from pyspark.sql.window import Window as W

    by = samples.groupBy(name, ms).agg(F.count("*").alias("c"))
    w = W.partitionBy(name)
    ranked = by.withColumn("upto", F.sum("c").over(w.orderBy(ms))).withColumn("n", F.sum("c").over(w))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col(ms)))
    out = ranked.groupBy(name).agg(F.sum("c").alias("n"), F.sum(F.col(ms) * F.col("c")).alias("total"), F.min(ms).alias("min"), F.max(ms).alias("max"), at(0.5).alias("median"), at(0.95).alias("p95"), at(0.99).alias("p99"))
    return out.withColumn("mean", F.col("total") / F.col("n")).withColumn("throughput", F.try_divide(F.lit(1000.0), F.col("mean")))


def suite(results: DataFrame) -> DataFrame:
    """Mean throughput over tests and its rating."""
    mean = F.avg("throughput")
    rating = F.when(mean > 100, "excellent").when(mean > 50, "good").when(mean > 20, "average").otherwise("poor")
    return results.agg(F.count("*").alias("tests"), mean.alias("avg_throughput"), rating.alias("rating"))


def error_rate(metrics: DataFrame) -> DataFrame:
    errors = F.coalesce(F.sum(F.when(F.col("name") == "errors", F.col("value"))), F.lit(0.0))
    return metrics.agg(errors.alias("errors"), F.coalesce(F.try_divide(errors, F.sum(F.when(F.col("name") == "operations", F.col("value")))), F.lit(0.0)).alias("error_rate"), F.coalesce(F.sum(F.when(F.col("name") == "auth_failures", F.col("value"))), F.lit(0.0)).alias("auth_failures"))


def status(phases: DataFrame, issues: DataFrame) -> DataFrame:
    return beside(phases.agg(F.round(F.avg("completion")).cast("long").alias("completion")), issues.agg(F.count_if(F.expr("severity = 'critical'")).alias("critical_issues")))


def expired(audit: DataFrame, now_s: Column, days: dict[str, int] | None = None) -> DataFrame:
    """Per event type: its period, and how many events are older."""
    table = audit.sparkSession.createDataFrame(sorted((days or RETENTION_DAYS).items()), "event_type string, days int")
    hit = audit.join(F.broadcast(table), "event_type")  # a row for each type
    return hit.groupBy("event_type", "days").agg(F.count("*").alias("events"), F.count_if(F.col("second") < now_s - F.col("days").cast("long") * 86400).alias("expired"))


def metric_registry(samples: DataFrame) -> DataFrame:
    """Per name and label: how many, sum, last, a cumulative histogram and quantiles by rank (the least value that so many reach)."""
    out = samples.groupBy("name", "label").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max_by("value", F.struct("second", "value")).alias("last"), *(F.count_if(F.col("value") <= b).alias(f"le_{str(b).replace('.', '_')}") for b in BUCKETS))
    return out


def quantile_summary(samples: DataFrame, accuracy: int = 10_000) -> DataFrame:
    return samples.groupBy("name").agg(F.percentile_approx("value", list(QUANTILES), accuracy).alias("quantiles"))


def documentation(functions: DataFrame) -> DataFrame:
    """Coverage, and the debt of what isn't documented."""
    n, bare = F.count("*"), F.count_if(~F.col("documented"))
    return functions.agg(n.alias("functions"), bare.alias("undocumented"), F.coalesce(F.try_divide(n - bare, n), F.lit(0.0)).alias("coverage"), F.ceil(bare / 2).alias("hours"), F.when(bare > n / 2, "medium").otherwise("low").alias("severity"))


def health(checks: DataFrame) -> DataFrame:
    worst = F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0))
    return checks.agg(F.when(worst == 2, "unhealthy").when(worst == 1, "degraded").otherwise("healthy").alias("status"), F.count("*").alias("checks"))


def preview(docs: DataFrame, text: str = "content") -> DataFrame:
    """Per document: size, headings and sentences, what a migration would make of it."""
    from quillgraph.functions import text as T

    return docs.select("path", F.length(text).alias("size"), F.size(T.headings(F.col(text))).alias("headings"), F.size(T.sentences(F.col(text))).alias("sentences"))


def grouped(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    return rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("items"))


def merged_batches(results: DataFrame) -> DataFrame:
    """Totals over batches: files, entities, mean time and all patterns."""
    return results.agg(F.sum("files").alias("files"), F.sum("entities").alias("entities"), F.avg("ms").alias("avg_ms"), F.flatten(F.collect_list("patterns")).alias("patterns"))


def compare(before: DataFrame, after: DataFrame, how: str = "full") -> DataFrame:
    """Tests of two runs by name: change in percent of the mean and what it means; missing on either side is told."""
    b, a = before.select("name", F.col("mean").alias("before")), after.select("name", F.col("mean").alias("after"))
    change = 100 * (F.col("after") - F.col("before")) / F.col("before")
    verdict = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "missing").when(change > 5, "slower").when(change < -5, "improved").otherwise("stable")
    return b.join(a, "name", how).select("name", "before", "after", F.coalesce(change, F.lit(None).cast("double")).alias("change"), verdict.alias("verdict"))
