"""Audit events: predicates, the hash chain, integrity, retention and personal fields."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from quillgraph.functions import security as S

#: What an event's hash covers, in this order.
HASHED = ("event_id", "timestamp", "event_type", "action", "resource", "result", "previous_hash")
GENESIS = "0"
#: Prefixes that a predicate holds at most; more are joined.
PREDICATE = 1000


def matching(events: DataFrame, event_type: str | None = None, user_id: str | None = None, resource: str | None = None, start: str | None = None, end: str | None = None, result: str | None = None, severity: str | None = None) -> DataFrame:
    """All given filters hold; resource is a substring, times are inclusive ISO texts."""
    out = events
    for column, value in (("event_type", event_type), ("user_id", user_id), ("result", result), ("severity", severity)):
        out = out.filter(F.col(column) == value) if value is not None else out
    out = out.filter(F.contains("resource", F.lit(resource))) if resource is not None else out
    out = out.filter(F.col("timestamp") >= start) if start is not None else out
    return out.filter(F.col("timestamp") <= end) if end is not None else out


def body_of() -> Column:
    """The event's own fields as JSON without its end; a null field is left out."""
    own = F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in HASHED[:-1])))
    return F.when(own == "{}", own.substr(F.lit(1), F.length(own) - 1)).otherwise(F.concat(own.substr(F.lit(1), F.length(own) - 1), F.lit(",")))


def ended(body, previous):  # noqa: ANN001, ANN201  texts or columns
    """What a hash covers: the fields and the hash before, which needs no escapes."""
    return (body, '"previous_hash":"', previous, '"}')


def hash_of(previous: Column | None = None) -> Column:
    """SHA-256 of the event's fields and the hash before as JSON."""
    parts = ended(body_of(), F.col("previous_hash") if previous is None else previous)
    return F.sha2(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)), 256)


def build_chain(events: DataFrame, log: str) -> DataFrame:
    """events with previous_hash and integrity_hash, chained within each log in order of time and id.

    Each hash needs the one before, so a log is one sequence: its rows stream in order through one worker. Logs are
    independent, so a deployment writes one for each service and day.
    """
    base = events.drop("previous_hash", "integrity_hash")
    schema = StructType([*base.schema.fields, *StructType.fromDDL("previous_hash string, integrity_hash string").fields])
    arrow, names = to_arrow_schema(schema), base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, GENESIS
        for batch in batches:
            before, own = [], []
            for name, body in zip(batch.column("__log").to_pylist(), batch.column("__body").to_pylist(), strict=True):
                if name != key:
                    key, last = name, GENESIS
                before.append(last)
                last = hashlib.sha256("".join(ended(body, last)).encode()).hexdigest()
                own.append(last)
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(before, pa.string()), pa.array(own, pa.string())], schema=arrow)

    made = base.withColumns({"__body": body_of(), "__log": F.coalesce(F.col(log).cast("string"), F.lit(""))})
    return made.repartition("__log").sortWithinPartitions("__log", "timestamp", "event_id").mapInArrow(run, schema)


def verify(events: DataFrame, log: str | None = None) -> DataFrame:
    """events with `issue`: content changed, link broken, or null. Each event is checked with its own previous_hash."""
    w = W.partitionBy(*([log] if log else [])).orderBy("timestamp", "event_id")
    expected = F.coalesce(F.lag("integrity_hash").over(w), F.lit(GENESIS))
    out = events.withColumn("__expected", expected)
    issue = F.when(F.col("integrity_hash") != hash_of(), "content changed").when(F.col("previous_hash") != F.col("__expected"), "link broken")
    return out.withColumn("issue", issue).drop("__expected")


def integrity(events: DataFrame, log: str | None = None) -> DataFrame:
    """One row: events, valid, invalid."""
    return verify(events, log).agg(F.count("*").alias("events"), F.count_if(F.expr("issue IS NULL")).alias("valid"), F.count_if(F.expr("issue IS NOT NULL")).alias("invalid"))


def retained(events: DataFrame, now: Column, days: dict[str, int]) -> DataFrame:
    """events that their type's period still covers; unknown types stay."""
    kept = F.lit(None).cast("int")
    for kind, n in days.items():
        kept = F.when(F.col("event_type") == kind, n).otherwise(kept)
    return events.filter(kept.isNull() | (F.to_timestamp("timestamp") >= now - F.make_dt_interval(kept)))


def without_personal(events: DataFrame, key: bytes, fields: tuple[str, ...] = ("ip_address", "user_agent")) -> DataFrame:
    """events with pii_fields named and moved into one encrypted column."""
    names = S.pii_fields(*fields)
    blob = F.when(F.size(names) > 0, S.encrypt(F.to_json(F.struct(*fields)), key))
    return events.withColumn("pii_fields", names).withColumn("pii", blob).withColumns({c: F.lit(None).cast("string") for c in fields})


def authorised(rows: DataFrame, roles: DataFrame, role: str, path: str = "path") -> DataFrame:
    """Rows whose path starts with one that the role may read; roles: role, prefix (a row each). Patterns ending in * cover all below."""
    mine = roles.filter((F.col("role") == role) & F.col("prefix").isNotNull()).select(F.regexp_replace("prefix", r"\*$", "").alias("prefix")).distinct()
    prefixes = [r[0] for r in mine.limit(PREDICATE + 1).collect()]
    if len(prefixes) > PREDICATE:  # a join with the prefixes instead: paths are cut at each length that a prefix has, 0 among them
        sizes = [r[0] for r in mine.select(F.length("prefix")).distinct().collect()]
        cuts = F.array_distinct(F.array(*(F.substring(F.col(path), 1, n) for n in sizes)))
        allowed = rows.select(path).distinct().select(path, F.explode(cuts).alias("prefix")).join(mine, "prefix", "left_semi").select(path).distinct()
        return rows.join(allowed, path, "left_semi")
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | F.startswith(F.col(path), F.lit(p))
    return rows.filter(cond)


def permitted(users: DataFrame, roles: DataFrame, permission: str) -> DataFrame:
    """users (user_id, role) with allowed: the role has the permission, one for all of its area (area.*), or *."""
    area = permission.split(".")[0]
    ok = roles.select("role", F.arrays_overlap("permissions", F.array(F.lit(permission), F.lit(f"{area}.*"), F.lit("*"))).alias("allowed"))
    return users.join(ok, "role", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))
