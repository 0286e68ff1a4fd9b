"""Questions in plain words as plans: an ordered table of rules picks an intent, which is compiled to one DataFrame expression."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import code, graph

# Keyword rules in order; the first that has a keyword in the question decides, so later ones may be shadowed.
RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("count", "functions", ("how many",)),
    ("callers", "functions", ("which functions call", "who calls", "callers of")),
    ("unused", "functions", ("never called", "unused function", "dead code")),
    ("parameters", "functions", ("parameters", "arguments")),
    ("complexity", "functions", ("complex", "complexity")),
    ("implementers", "classes", ("implement",)),
    ("hierarchy", "classes", ("hierarchy", "inherit", "extends")),
    ("most_methods", "classes", ("most methods",)),
    ("cycles", "modules", ("circular", "cycle")),
    ("unused_modules", "modules", ("unused module",)),
    ("most_imports", "modules", ("most imports", "coupling", "coupled")),
    ("dependencies", "modules", ("depend",)),
    ("duplicates", "functions", ("duplicate", "similar")),
    ("security", "functions", ("security", "vulnerab")),
    ("hotspots", "functions", ("hotspot", "bottleneck", "performance", "memory-intensive")),
    ("debt", "functions", ("debt", "refactor")),
    ("patterns", "functions", ("pattern", "singleton", "factory", "anti-pattern", "smell")),
    ("architecture", "modules", ("architecture", "concern")),
    ("list", "classes", ("class",)),
    ("list", "modules", ("module",)),
    ("list", "functions", ("function", "method")),
)
NUMBER = re.compile(r"(?:more than|over|above|greater than|>)\s*(\d+)")
NAME = re.compile(r"['\"`]([^'\"`]+)['\"`]|\b(?:call|calls|implement|implements|implementing|of|on)\s+([A-Za-z_$][\w$.#]*)\s*\??$")

SUGGESTIONS = (
    "What are the most complex functions?", "Which functions call X?", "Functions with more than 10 parameters", "Which functions are never called?", "Classes implementing X", "Hierarchy of X", "Classes with most methods",
    "Show circular dependencies", "What does X depend on?", "Modules with most imports", "Unused modules", "Show design patterns", "Technical debt issues", "Duplicate code", "Security issues", "Performance hotspots",
)


@dataclass
class Intent:
    type: str
    target: str
    filters: dict[str, object] = field(default_factory=dict)
    limit: int = 20


@dataclass
class Graph:
    """What questions are asked of: functions, classes, modules and typed edges."""

    functions: DataFrame
    classes: DataFrame
    modules: DataFrame
    edges: DataFrame
    entities: DataFrame | None = None


def understand(question: str) -> Intent:
    low = question.lower()
    kind, target = next(((k, t) for k, t, words in RULES if any(w in low for w in words)), ("list", "functions"))
    filters: dict[str, object] = {}
    if m := NUMBER.search(low):
        filters["more_than"] = int(m[1])
    if m := NAME.search(question):
        filters["name"] = m[1] or m[2]
    if m := re.search(r"\btop\s+(\d+)", low):
        return Intent(kind, target, filters, int(m[1]))
    return Intent(kind, target, filters)


def compile_(intent: Intent, g: Graph) -> DataFrame:
    """The plan of an intent; filters are part of it."""
    f, name, n = g.functions, intent.filters.get("name"), intent.filters.get("more_than")
    named = lambda rows: rows.filter(F.contains(F.lower("name"), F.lit(str(name).lower()))) if name else rows
    pointed = lambda kind, ends: g.edges.filter(F.col("edge_type") == kind).join(named(ends).select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    match intent.type:
        case "count":
            return named(f).agg(F.count("*").alias("n"))
        case "callers":
            return f.join(pointed("CALLS", f), "id").orderBy("id").limit(intent.limit)
        case "unused":
            return graph.without(f.filter("visibility <> 'private'"), g.edges, "dst", "CALLS").orderBy("id").limit(intent.limit)
        case "parameters":
            return f.filter(F.col("param_count") > (5 if n is None else n)).orderBy(F.desc("param_count"), "id").limit(intent.limit)
        case "complexity":
            return named(f).filter(F.col("complexity") > (0 if n is None else n)).orderBy(F.desc("complexity"), "id").limit(intent.limit)
        case "implementers":
            return g.classes.join(pointed("IMPLEMENTS", g.classes), "id").orderBy("id").limit(intent.limit)
        case "hierarchy":
            start = named(g.classes).select("id")
            return graph.distances(graph.of_type(g.edges, "EXTENDS"), start, 5).orderBy("depth", "id").limit(intent.limit)
        case "most_methods":
            return g.edges.filter("edge_type = 'DEFINES'").groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("methods")).orderBy(F.desc("methods"), "id").limit(intent.limit)
        case "cycles":
            return graph.cycles(graph.in_cycles(graph.of_type(g.edges, "IMPORTS")), 2, 10, intent.limit)
        case "unused_modules":
            return graph.without(g.modules, g.edges, "dst", "IMPORTS").orderBy("id").limit(intent.limit)
        case "most_imports":
            return g.edges.filter("edge_type = 'IMPORTS'").groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("imports")).orderBy(F.desc("imports"), "id").limit(intent.limit)
        case "dependencies":
            return g.edges.filter("edge_type = 'IMPORTS'").join(named(g.modules).select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().orderBy("id").limit(intent.limit)
        case "duplicates":
            return graph.first_same_signature(f, intent.limit)
        case "security":
            return code.security_scan(g.entities if g.entities is not None else f.withColumn("content", F.col("name"))).orderBy("id", "spot").limit(intent.limit)
        case "hotspots":
            return code.hotspots(f, g.edges.filter("edge_type = 'CALLS'"), intent.limit)
        case "debt":
            return code.complexity_debt(f).orderBy(F.desc("priority"), "id").limit(intent.limit)
        case "architecture":
            return g.edges.groupBy("edge_type").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))
        case "patterns" if g.entities is not None:
            rels = g.edges.withColumnRenamed("edge_type", "rel_type")
            return code.detect(g.entities, rels).orderBy("id").limit(intent.limit)
        case _:
            rows = {"classes": g.classes, "modules": g.modules}.get(intent.target, f)
            return named(rows).orderBy("id").limit(intent.limit)


def answer(question: str, g: Graph) -> DataFrame:
    return compile_(understand(question), g)


def suggest(part: str) -> list[str]:
    return [s for s in SUGGESTIONS if part.lower() in s.lower()]
