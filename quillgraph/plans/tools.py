"""The named tools over a store: each is a plan on its frames."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import aggregates, audit, code, graph, ranking, search
from quillgraph.plans import intents
from quillgraph.sources import corpus

#: Functions that run any code of the JVM.
CALLS_OUT = re.compile(r"\b(?:try_)?reflect\s*\(|\bjava_method\s*\(", re.I)
#: Nodes of a parsed statement that do more than read.
WRITES = re.compile(r"Insert|Write|Command|Merge|Delete|Update|Create|Replace|Drop|Alter|Truncate|Load|Set|Reset|Cache|Refresh|Overwrite|Append|ScriptTransformation|Script|Compound|Execute|Call|Declare|Add|Analyze|Repair|Comment|Use")


def reads_only(spark: SparkSession, sql: str) -> bool:
    """Whether the parser takes sql for one statement that only reads: a query, SHOW or DESCRIBE."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(re.sub(r"\{(\w+)\}", r"\1", sql))
    except Exception:  # noqa: BLE001  what can't be parsed isn't run
        return False
    command = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    name = lambda node: node.getClass().getSimpleName()
    if re.match(r"Show|Describe", name(plan)):
        return True
    todo = [plan]
    while todo:
        node = todo.pop()
        if command.isInstance(node) or name(node).endswith("Statement") or WRITES.match(name(node)):
            return False
        for group in (node.children(), node.innerChildren(), node.subqueries()):
            nodes = group.iterator()
            while nodes.hasNext():
                inner = nodes.next()
                if spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.QueryPlan").isInstance(inner):
                    todo.append(inner)
    return True


def query(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """A guarded pass-through: one statement that reads, over the given frames, named in braces."""
    if CALLS_OUT.search(sql) or not reads_only(spark, sql):
        raise PermissionError("only one reading statement is allowed")
    return spark.sql(sql, **frames)


@dataclass
class Store:
    docs: DataFrame
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    entities: DataFrame | None = None
    relations: DataFrame | None = None
    code: intents.Graph | None = None
    audit: DataFrame | None = None


def status_table(docs: DataFrame) -> DataFrame:
    """path, component, status, completion of `| component | status | n% |` lines."""
    rows = docs.select("path", F.explode(T.lines(F.col("content"))).alias("x")).filter(F.contains("x", F.lit("|")) & F.contains("x", F.lit("%")))
    cells = rows.select("path", F.filter(F.transform(F.split("x", r"\|"), lambda c: F.trim(c)), lambda c: c != "").alias("c")).filter("size(c) >= 3")
    return cells.select("path", F.col("c")[0].alias("component"), F.col("c")[1].alias("status"), F.regexp_extract(F.col("c")[2], r"(\d+)\s*%", 1).try_cast("int").alias("completion")).filter("completion IS NOT NULL")


def issue_list(docs: DataFrame) -> DataFrame:
    """path, n, title, severity (by the section's heading), description of `### title` blocks under `## section`."""
    from pyspark.sql.window import Window as W

    rows = docs.select("path", F.posexplode(T.lines(F.col("content"))).alias("n", "x"))
    w = W.partitionBy("path").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    section = F.last(F.when(F.startswith("x", F.lit("## ")), F.trim(F.expr("substring(x, 4)"))), ignorenulls=True).over(w)
    issue = F.last(F.when(F.startswith("x", F.lit("### ")), F.col("n")), ignorenulls=True).over(w)
    marked = rows.withColumn("section", section).withColumn("issue", issue).filter("issue IS NOT NULL")
    low = F.lower("section")
    severity = F.when(low.rlike("critical|blocker"), "critical").when(low.rlike("high|security"), "high").when(F.contains(low, F.lit("medium")), "medium").otherwise("low")
    body = F.transform(F.array_sort(F.collect_list(F.when((F.trim("x") != "") & ~F.startswith("x", F.lit("#")), F.struct("n", "x")))), lambda s: s["x"])
    return marked.groupBy("path", "issue").agg(F.max(F.when(F.col("n") == F.col("issue"), F.trim(F.expr("substring(x, 5)")))).alias("title"), F.max(F.when(F.col("n") == F.col("issue"), severity)).alias("severity"), F.array_join(body, " ").alias("description"))


#: Kinds of nodes that are code.
CODE_KINDS = ("Function", "Class", "Interface", "Module", "Component")


def debt_items(s: Store) -> DataFrame:
    """Debt of all sources: patterns where entities are known, complexity, duplication, import cycles and missing documentation."""
    f = s.code.functions
    out = code.complexity_debt(f).unionByName(code.duplication_debt(aggregates.duplicates(f, T.normal_signature(F.col("signature")))))
    if "documented" in f.columns:
        out = out.unionByName(code.documentation_debt(f))
    if s.entities is not None and s.relations is not None:
        own, rels = graph.keep(s.entities), graph.keep(s.relations)
        out = out.unionByName(code.pattern_debt(graph.keep(code.detect(own, rels)), own))
        imports = graph.in_cycles(rels.filter("rel_type = 'IMPORTS'").select("src", "dst"))
        out = out.unionByName(code.dependency_debt(graph.cycles(imports, 2, 10, None)))
    return out


def analysis(s: Store, phases: tuple[str, ...] = ("entities", "relations", "patterns", "metrics", "debt", "insights")) -> DataFrame:
    """phase, item, value: entities and relations by kind, findings by name, code metrics, debt by source and the number of insights of each kind."""
    own, rels = graph.keep(s.entities), graph.keep(s.relations)
    found: dict[str, DataFrame] = {}
    row = lambda df, phase, item, value: df.select(F.lit(phase).alias("phase"), item.alias("item"), value.cast("double").alias("value"))
    if "entities" in phases:
        found["entities"] = row(aggregates.counts(own, "entity_type"), "entities", F.col("entity_type"), F.col("n"))
    if "relations" in phases:
        found["relations"] = row(aggregates.counts(rels, "rel_type"), "relations", F.col("rel_type"), F.col("n"))
    if "patterns" in phases:
        found["patterns"] = row(aggregates.counts(code.detect(own, rels), "name"), "patterns", F.col("name"), F.col("n"))
    functions = own.filter(F.lower("entity_type").isin("function", "method"))
    if "metrics" in phases:
        one = functions.agg(F.count("*").alias("functions"), F.coalesce(F.avg("complexity"), F.lit(0.0)).alias("avg_complexity"), F.coalesce(F.max("complexity"), F.lit(0)).alias("max_complexity"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines"))
        found["metrics"] = one.select(F.explode(F.create_map(*(x for c in one.columns for x in (F.lit(c), F.col(c).cast("double"))))).alias("item", "value")).select(F.lit("metrics").alias("phase"), "item", "value")
    if "debt" in phases:
        found["debt"] = row(aggregates.counts(debt_items(s), "source"), "debt", F.col("source"), F.col("n"))
    if "insights" in phases:
        total = aggregates.beside(functions.agg(F.count("*").alias("functions"), F.avg("complexity").alias("avg_complexity")), own.agg(F.count("*").alias("entities"), F.count_if(F.lower("entity_type") == "class").alias("classes"), F.count_if(F.lower("entity_type") == "module").alias("modules")), rels.agg(F.count_if(F.col("rel_type") == "CALLS").alias("calls")))
        cycles = graph.cycle_edges(rels.filter("rel_type = 'IMPORTS'").select("src", "dst")).count()
        found["insights"] = row(aggregates.counts(code.insights(total, cycles), "type"), "insights", F.col("type"), F.col("n"))
    return reduce(DataFrame.unionByName, found.values())


def similar_code(s: Store, ident, threshold: float = 0.8, kinds: tuple[str, ...] = CODE_KINDS, k: int = 10) -> DataFrame:  # noqa: ANN001
    """The nodes of code most like one; where nodes have a type, others than code are left out before they are ranked."""
    nodes = s.nodes
    if "node_type" in nodes.columns:
        nodes = nodes.filter((F.col("id") == ident) | F.lower("node_type").isin(*(x.lower() for x in kinds)))
    return ranking.similar_to(nodes, ident, k=k, threshold=threshold)


TOOLS: dict[str, Any] = {
    "kb_read": lambda s, path: corpus.read_one(s.docs, path),
    "kb_list": lambda s, directory="": corpus.under(s.docs, directory),
    "kb_update": lambda s, new, now: corpus.put(s.docs, new, now),
    "kb_create": lambda s, new, now: corpus.put(s.docs, new.join(s.docs, "path", "left_anti"), now),
    "kb_delete": lambda s, paths: corpus.remove(s.docs, paths),
    "kb_search": lambda s, q, **o: search.search_documents(s.docs, q, **o),
    "kb_status": lambda s: status_table(s.docs),
    "kb_issues": lambda s: aggregates.severities(issue_list(s.docs)),
    "kb_export": lambda s, path: corpus.write_snapshot(s.docs, path),
    "kb_import": lambda s, path: corpus.read_snapshot(s.docs.sparkSession, path),
    "kb_backend_info": lambda s: aggregates.by_category(s.docs),
    "kb_backend_switch": lambda s, path, **o: corpus.switch(s.docs.sparkSession, s.docs, path, **o),
    "kb_backend_health": lambda s, checks: aggregates.health(checks),
    "kb_semantic_search": lambda s, vector, **o: ranking.nearest(s.nodes, vector, **o),
    "kb_graph_query": lambda s, sql: query(s.docs.sparkSession, sql, documents=s.docs, nodes=s.nodes, edges=s.edges),
    "analyze_codebase": lambda s, **o: analysis(s, **o),
    "query_code_graph": lambda s, question: intents.answer(question, s.code),
    "find_patterns": lambda s, **o: code.detect(s.entities, s.relations, **o),
    "track_technical_debt": lambda s: code.debt_report(debt_items(s)),
    "get_code_metrics": lambda s: aggregates.code_metrics(s.code.functions, s.code.classes, s.code.modules),
    "architectural_overview": lambda s: intents.answer("architecture", s.code),
    "find_function_calls": lambda s, function: graph.out_of(s.code.edges, s.code.functions, function, "CALLS"),
    "get_class_hierarchy": lambda s, class_id: graph.hierarchy(s.code.edges, class_id),
    "impact_analysis": lambda s, entity: graph.impact(s.code.edges, entity),
    "find_similar_code": lambda s, ident, **o: similar_code(s, ident, **o),
    "suggest_refactoring": lambda s: ranking.debt_plan(debt_items(s)),
    "find_usage": lambda s, entity: graph.into(s.code.edges, s.code.functions, entity, "CALLS"),
    "dependency_graph": lambda s: graph.of_type(s.code.edges, "IMPORTS"),
    "dead_code_detection": lambda s: graph.without(s.code.functions.filter("visibility <> 'private'"), s.code.edges, "dst", "CALLS"),
    "security_analysis": lambda s: code.security_scan(s.entities),
    "performance_hotspots": lambda s, **o: code.hotspots(s.code.functions, graph.of_type(s.code.edges, "CALLS"), **o),
}


def info(s: Store) -> DataFrame:
    """One row: documents, bytes, categories and when the last one changed."""
    cols = s.docs.columns
    return s.docs.agg(
        F.count("*").alias("documents"), (F.sum("size") if "size" in cols else F.sum(F.length("content"))).alias("bytes"),
        (F.count_distinct("category") if "category" in cols else F.lit(None).cast("long")).alias("categories"), (F.max("modified") if "modified" in cols else F.lit(None).cast("timestamp")).alias("modified"),
    )


def audited(s: Store, start: str | None = None, end: str | None = None, event_type: str | None = None, limit: int = 100) -> DataFrame:
    """The audit events that match, newest first, at most 1000 as the tool declares."""
    return audit.matching(s.audit, event_type=event_type, start=start, end=end).orderBy(F.desc("timestamp"), "event_id").limit(max(1, min(limit, 1000)))


HELP = {
    "getting-started": "Read with kb_read and kb_list, search with kb_search, write with kb_create and kb_update.",
    "security": "Paths and texts are checked before they are stored; every call is audited.",
    "search": "kb_search ranks documents by where the words stand; category and limit narrow it.",
    "markdown": "Documents are Markdown; tables of status and lists of issues are read from them.",
    "permissions": "kb.read, kb.write, kb.delete and kb.admin; a role may hold one, all of an area (kb.*), or *.",
}

#: Tools of the guarded set beside those above, and what each tool of that set asks of its caller; others ask nothing.
SECURE_TOOLS: dict[str, Any] = {
    "kb_info": info,
    "kb_help": lambda s, topic=None: s.docs.sparkSession.createDataFrame([(k, v) for k, v in HELP.items() if topic in (None, k)], "topic string, text string"),
    "kb_backup": lambda s, path, since=None: corpus.write_snapshot(s.docs if since is None else s.docs.filter(F.col("modified") > since), path),
    "kb_audit": audited,
}
PERMISSIONS = {"kb_read": "kb.read", "kb_list": "kb.read", "kb_search": "kb.read", "kb_create": "kb.write", "kb_update": "kb.write", "kb_delete": "kb.delete", "kb_backup": "kb.admin", "kb_audit": "kb.admin"}


def allowed(permissions: set[str], tool: str) -> bool:
    """Whether someone with these permissions may call the tool."""
    need = PERMISSIONS.get(tool)
    return need is None or bool(permissions & {need, f"{need.split('.')[0]}.*", "*"})


def run_secured(store: Store, permissions: set[str], tool: str, *args: Any, **options: Any) -> DataFrame:
    """A tool of the guarded set, if the permissions allow it."""
    found = SECURE_TOOLS.get(tool) or (TOOLS.get(tool) if tool in PERMISSIONS else None)
    if found is None:
        raise KeyError(f"no tool {tool!r}")
    if not allowed(permissions, tool):
        raise PermissionError(f"{tool} needs {PERMISSIONS[tool]}")
    return found(store, *args, **options)


def run(store: Store, tool: str, *args: Any, **options: Any) -> DataFrame:
    if tool not in TOOLS:
        raise KeyError(f"no tool {tool!r}")
    return TOOLS[tool](store, *args, **options)
