"""Record types (as DDL) and enumerations of the document, graph, code and audit models."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Closed enumerations of the data model.
CATEGORIES = ("active", "completed", "legacy", "status", "compliance", "architecture", "general")
NODE_TYPES = ("concept", "fact", "event", "entity", "document", "question", "insight", "memory")
MEMORY_TYPES = ("short_term", "long_term", "working", "episodic", "semantic", "procedural")
SEVERITIES = ("low", "medium", "high", "critical")
AUDIT_TYPES = ("auth", "authz", "data_access", "config_change", "error", "security")
AUDIT_RESULTS = ("success", "failure", "error")

DOCUMENT = "path STRING, content STRING, metadata STRING, category STRING, size BIGINT, modified TIMESTAMP, created TIMESTAMP"
NODE = "id STRING, node_type STRING, content STRING, created_at TIMESTAMP, updated_at TIMESTAMP, accessed_at TIMESTAMP, access_count BIGINT, importance DOUBLE, confidence DOUBLE, metadata STRING, embedding ARRAY<FLOAT>"
EDGE = "id STRING, edge_type STRING, src STRING, dst STRING, weight DOUBLE, created_at TIMESTAMP, updated_at TIMESTAMP, metadata STRING, bidirectional BOOLEAN"
TEMPORAL_EDGE = EDGE + ", valid_from TIMESTAMP, valid_to TIMESTAMP, confidence_over_time ARRAY<STRUCT<ts: TIMESTAMP, confidence: DOUBLE>>"
ENTITY = (
    "id STRING, entity_type STRING, name STRING, file_path STRING, line INT, end_line INT, column INT, language STRING, signature STRING, complexity INT, line_count INT, visibility STRING, "
    "is_static BOOLEAN, is_async BOOLEAN, documentation STRING, parameters ARRAY<STRING>, parent_class STRING, implements ARRAY<STRING>, extends STRING, content STRING"
)
RELATIONSHIP = "id STRING, rel_type STRING, src STRING, dst STRING, file_path STRING, line INT, metadata STRING"
AUDIT = (
    "event_id STRING, timestamp STRING, event_type STRING, user_id STRING, session_id STRING, action STRING, resource STRING, result STRING, ip_address STRING, user_agent STRING, severity STRING, "
    "trace_id STRING, span_id STRING, pii_fields ARRAY<STRING>, metadata STRUCT<integrity_hash: STRING, previous_hash: STRING, version: STRING, correlation_id: STRING>"
)
CHANGE = "path STRING, change STRING, is_dir BOOLEAN, ts TIMESTAMP"
METRIC = "name STRING, type STRING, value DOUBLE, labels MAP<STRING, STRING>, ts TIMESTAMP"


def fields(ddl: str) -> list[tuple[str, str]]:
    """Names and types of a record type."""
    return [tuple(f.strip().split(" ", 1)) for f in re.split(r",(?![^<]*>)", ddl)]


def ordinal(severity: Column) -> Column:
    """low 1 to critical 4; null for anything else."""
    out = F.lit(None).cast("int")
    for i, name in enumerate(SEVERITIES):
        out = F.when(severity == name, i + 1).otherwise(out)
    return out


def check(df: DataFrame, domains: dict[str, tuple[str, ...]] | None = None, unit: tuple[str, ...] = (), required: tuple[str, ...] = ()) -> DataFrame:
    """df with `_error`: why a row isn't valid (an unknown enumeration value, a number outside 0..1, a missing value), else null."""
    faults = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in required]
    faults += [F.when(~F.col(c).isin(*allowed), F.concat(F.lit(f"{c} is "), F.col(c))) for c, allowed in (domains or {}).items()]
    faults += [F.when(~F.col(c).between(0, 1), F.lit(f"{c} is outside 0..1")) for c in unit]
    return df.withColumn("_error", F.nullif(F.array_join(F.array_compact(F.array(*faults)), "; "), F.lit("")) if faults else F.lit(None).cast("string"))
