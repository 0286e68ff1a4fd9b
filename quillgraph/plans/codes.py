"""Queries: source-code rules, debt, insights, parsing and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import aggregates as A
from quillgraph.operators import code, graph
from quillgraph.plans import intents, tools
from quillgraph.plans.basic import r6
from quillgraph.plans.domain import Tables
from quillgraph.plans.registry import SQL, query
from quillgraph.sources import parse


def entities(t: Tables) -> DataFrame:
    """Functions of the part table with a class each, and those classes."""
    f = t.functions
    member = f.select(
        F.concat(F.lit("f"), "id").alias("id"), F.when(F.col("id") % 6 == 0, "Variable").otherwise("Function").alias("entity_type"), F.when(F.col("id") % 11 == 0, "constructor").when(F.col("id") % 11 == 1, "getInstance").when(F.col("id") % 11 == 2, "addObserver").when(F.col("id") % 11 == 3, "removeObserver").when(F.col("id") % 11 == 4, "notifyAll").otherwise(F.col("name")).alias("name"),
        F.concat(F.lit("src/c"), "class_id", F.lit(".ts")).alias("file_path"), "line", "line_count", "complexity", F.when(F.col("id") % 11 == 0, "private").otherwise(F.col("visibility")).alias("visibility"), (F.col("id") % 2 == 0).alias("is_static"),
        F.array_repeat(F.lit("x: Base"), F.col("param_count")).alias("parameters"), F.concat(F.lit("C"), "class_id").alias("parent_class"), F.array().cast("array<string>").alias("implements"), "signature",
    )
    cls = f.select("class_id").distinct().select(
        F.concat(F.lit("c"), "class_id").alias("id"), F.lit("Class").alias("entity_type"), F.concat(F.lit("C"), "class_id").alias("name"), F.concat(F.lit("src/c"), "class_id", F.lit(".ts")).alias("file_path"), F.lit(1).alias("line"), (F.col("class_id") * 31 % 2500).cast("int").alias("line_count"), F.lit(0).alias("complexity"),
        F.lit("public").alias("visibility"), F.lit(False).alias("is_static"), F.array().cast("array<string>").alias("parameters"), F.lit(None).cast("string").alias("parent_class"), F.array(F.lit("Base")).alias("implements"), F.lit(None).cast("string").alias("signature"),
    )
    return member.unionByName(cls)


MEMBERS = "(SELECT id, class_id, CASE WHEN id % 6 = 0 THEN 'Variable' ELSE 'Function' END AS kind, CASE id % 11 WHEN 0 THEN 'constructor' WHEN 1 THEN 'getInstance' WHEN 2 THEN 'addObserver' WHEN 3 THEN 'removeObserver' WHEN 4 THEN 'notifyAll' ELSE name END AS name, CASE WHEN id % 11 = 0 THEN 'private' ELSE visibility END AS visibility, id % 2 = 0 AS is_static, param_count, line_count, complexity FROM @functions)"


@query("j28_singleton", f"SELECT concat('c', class_id) AS id FROM {MEMBERS} GROUP BY class_id HAVING bool_or(name = 'constructor' AND visibility = 'private') AND bool_or(is_static AND contains(lower(name), 'instance') AND kind = 'Function') AND bool_or(is_static AND kind = 'Variable')")
def _(t: Tables) -> DataFrame:
    return code.singleton(entities(t), None).select(F.col("entities")[0].alias("id"))


@query("j28_observer", f"SELECT concat('c', class_id) AS id FROM {MEMBERS} GROUP BY class_id HAVING bool_or(starts_with(lower(name), 'add')) AND bool_or(starts_with(lower(name), 'remove') AND contains(lower(name), 'observer')) AND bool_or(contains(lower(name), 'notify') OR contains(lower(name), 'update'))")
def _(t: Tables) -> DataFrame:
    return code.observer(entities(t), None).select(F.col("entities")[0].alias("id"))


@query("j28_decorator", f"SELECT concat('c', class_id) AS id FROM {MEMBERS} WHERE name = 'constructor' GROUP BY class_id HAVING max(param_count) > 0")
def _(t: Tables) -> DataFrame:
    return code.decorator(entities(t), None).select(F.col("entities")[0].alias("id"))


@query("n10_god_class", f"""SELECT concat('c', class_id) AS id, CASE WHEN lines > 2000 OR methods > 50 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT class_id, class_id * 31 % 2500 AS lines, count(*) FILTER (WHERE kind = 'Function') AS methods, count(*) FILTER (WHERE kind = 'Variable') AS properties FROM {MEMBERS} GROUP BY class_id) WHERE lines > 1000 OR methods > 20 OR properties > 15""")
def _(t: Tables) -> DataFrame:
    return code.god_class(entities(t), None).select(F.col("entities")[0].alias("id"), "severity")


@query("n10_long_method", f"SELECT concat('f', id) AS id, CASE WHEN line_count > 200 OR complexity > 25 THEN 'high' ELSE 'medium' END AS severity FROM {MEMBERS} WHERE kind = 'Function' AND (line_count > 100 OR complexity > 15)")
def _(t: Tables) -> DataFrame:
    return code.long_method(entities(t), None).select(F.col("entities")[0].alias("id"), "severity")


@query("n10_large_class", "SELECT DISTINCT concat('c', class_id) AS id FROM @functions WHERE class_id * 31 % 2500 > 500 AND class_id * 31 % 2500 <= 1000")
def _(t: Tables) -> DataFrame:
    return code.large_class(entities(t), None).select(F.col("entities")[0].alias("id"))


@query("n10_long_parameters", f"SELECT concat('f', id) AS id, CASE WHEN param_count > 8 THEN 'medium' ELSE 'low' END AS severity FROM {MEMBERS} WHERE kind = 'Function' AND param_count > 5")
def _(t: Tables) -> DataFrame:
    return code.long_parameters(entities(t), None).select(F.col("entities")[0].alias("id"), "severity")


#: What each rule's own SQL finds; there are no interfaces, imports or names of factories among these entities.
ALL_RULES = " UNION ALL ".join(
    [f"SELECT '{name}' AS name, {level} AS severity FROM ({SQL[key]})" for name, key, level in (("Singleton", "j28_singleton", "'low'"), ("Observer", "j28_observer", "'low'"), ("Decorator", "j28_decorator", "'low'"), ("God Class", "n10_god_class", "severity"), ("Long Method", "n10_long_method", "severity"), ("Large Class", "n10_large_class", "'medium'"), ("Long Parameter List", "n10_long_parameters", "severity"))]
    + [
        "SELECT 'Duplicate Code', 'medium' FROM (SELECT regexp_replace(lower(signature), '[^a-z0-9]', '', 'g') AS normal FROM @functions WHERE id % 6 <> 0 GROUP BY 1 HAVING count(DISTINCT class_id) > 1 AND normal <> '')",
        f"SELECT 'Dead Code', 'low' FROM {MEMBERS} m WHERE kind = 'Function' AND visibility <> 'private' AND NOT EXISTS (SELECT 1 FROM @edges e WHERE e.edge_type = 'CALLS' AND e.dst = m.id)",
    ]
)


@query("e02_all_rules", f"SELECT name, severity, count(*) AS n FROM ({ALL_RULES}) GROUP BY name, severity")
def _(t: Tables) -> DataFrame:
    rels = t.edges.select(F.concat(F.lit("f"), "src").alias("src"), F.concat(F.lit("f"), "dst").alias("dst"), F.col("edge_type").alias("rel_type")).filter("rel_type <> 'IMPORTS'")
    return code.detect(graph.keep(entities(t)), rels).groupBy("name", "severity").agg(F.count("*").alias("n"))


PRIORITY = "CAST(floor((m + r + s + p) / 4e0 * 0.4e0 + CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 75 WHEN 'medium' THEN 50 ELSE 25 END * 0.4e0 + greatest(0, 100 - hours * 2) * 0.2e0 + 0.5e0) AS INT)"
COMPLEXITY = f"(SELECT *, {PRIORITY} AS priority FROM (SELECT concat('complexity_', id) AS id, 'complexity' AS type, CASE WHEN complexity > 20 THEN 'high' WHEN complexity > 15 THEN 'medium' ELSE 'low' END AS severity, ceil(complexity / 5e0) AS hours, greatest(0, 100 - complexity * 3) AS m, greatest(0, 100 - complexity * 4) AS r, greatest(0, 100 - complexity * 5) AS s, 80 AS p FROM @functions WHERE complexity > 10))"
DUPLICATION = f"(SELECT *, {PRIORITY} AS priority FROM (SELECT concat('duplication_', normal) AS id, 'duplication' AS type, CASE WHEN n > 3 THEN 'high' ELSE 'medium' END AS severity, ceil(lines / 50e0) AS hours, greatest(0, 100 - n * 15) AS m, 70 AS r, greatest(0, 100 - n * 10) AS s, 85 AS p FROM (SELECT regexp_replace(lower(signature), '[^a-z0-9]', '', 'g') AS normal, count(*) AS n, sum(line_count) AS lines FROM @functions GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT file_path) > 1)))"
DOCUMENTATION = f"(SELECT *, {PRIORITY} AS priority FROM (SELECT 'documentation' AS id, 'documentation' AS type, CASE WHEN bare > n / 2 THEN 'medium' ELSE 'low' END AS severity, ceil(bare / 2e0) AS hours, 60 AS m, 50 AS r, 80 AS s, 90 AS p FROM (SELECT count(*) AS n, count(*) FILTER (WHERE NOT documented) AS bare FROM @functions) WHERE bare > 0))"
DEBT = f"(SELECT id, type, severity, hours, priority FROM {COMPLEXITY} UNION ALL SELECT id, type, severity, hours, priority FROM {DUPLICATION} UNION ALL SELECT id, type, severity, hours, priority FROM {DOCUMENTATION})"


def debt(t: Tables) -> DataFrame:
    f = t.functions
    return code.complexity_debt(f).unionByName(code.duplication_debt(A.duplicates(f, T.normal_signature(F.col("signature"))))).unionByName(code.documentation_debt(f))


@query("f20_complexity_debt", f"SELECT id, severity, hours, priority FROM {COMPLEXITY}")
def _(t: Tables) -> DataFrame:
    return code.complexity_debt(t.functions).select("id", "severity", "hours", "priority")


@query("f20_duplication_debt", f"SELECT id, severity, hours, priority FROM {DUPLICATION}")
def _(t: Tables) -> DataFrame:
    return code.duplication_debt(A.duplicates(t.functions, T.normal_signature(F.col("signature")))).select("id", "severity", "hours", "priority")


@query("f20_pattern_debt", f"SELECT concat('pattern_long_method_f', id) AS id, 'complexity' AS type, greatest(1e0, least(40e0, ceil(line_count / 20e0))) AS hours FROM {MEMBERS} WHERE kind = 'Function' AND (line_count > 100 OR complexity > 15)")
def _(t: Tables) -> DataFrame:
    e = entities(t)
    return code.pattern_debt(code.long_method(e, None), e).select("id", "type", "hours")


@query("u05_debt_items", f"SELECT type, count(*) AS n FROM {DEBT} GROUP BY type")
def _(t: Tables) -> DataFrame:
    return debt(t).groupBy("type").agg(F.count("*").alias("n"))


@query("a13_debt_summary", f"SELECT count(*) AS items, sum(hours) AS hours, round(avg(priority), 6) AS avg_priority, least(1e0, sum(hours) / 1000e0) AS debt_ratio FROM {DEBT}")
def _(t: Tables) -> DataFrame:
    return code.debt_summary(debt(t)).withColumn("avg_priority", r6("avg_priority"))


@query("a13_debt_report", f"SELECT 'type' AS grouping, type AS value, count(*) AS items, sum(hours) AS hours, round(avg(priority), 6) AS avg_priority FROM {DEBT} GROUP BY type UNION ALL SELECT 'severity', severity, count(*), sum(hours), round(avg(priority), 6) FROM {DEBT} GROUP BY severity UNION ALL SELECT 'all', 'all', count(*), sum(hours), round(avg(priority), 6) FROM {DEBT}")
def _(t: Tables) -> DataFrame:
    return code.debt_report(debt(t)).withColumn("avg_priority", r6("avg_priority"))


@query("t16_quick_wins", f"SELECT id FROM {DEBT} WHERE hours <= 4 AND priority >= 40 ORDER BY priority DESC, id LIMIT 5")
def _(t: Tables) -> DataFrame:
    return debt(t).filter("hours <= 4 AND priority >= 40").orderBy(F.desc("priority"), "id").limit(5).select("id")


@query("t16_major_work", f"SELECT id FROM {DEBT} WHERE hours > 16 AND severity = 'high' ORDER BY priority DESC, id LIMIT 3")
def _(t: Tables) -> DataFrame:
    from quillgraph.operators import ranking

    return ranking.major(debt(t)).select("id")


def counts(t: Tables) -> DataFrame:
    own = t.functions.agg(F.count("*").alias("functions"), F.avg("complexity").alias("avg_complexity"))
    return A.beside(own, t.classes.agg(F.count("*").alias("classes")), t.modules.agg(F.count("*").alias("modules")), t.edges.agg(F.count_if(F.col("edge_type") == "CALLS").alias("calls"))).withColumn("entities", F.col("functions") + F.col("classes"))


INSIGHTS = """(SELECT * FROM (VALUES ('many_modules', 'architecture', 'warning', 'medium'), ('high_complexity', 'quality', 'warning', 'high'), ('many_functions', 'file', 'info', 'low'), ('many_classes', 'file', 'info', 'low'), ('high_coupling', 'file', 'warning', 'medium')) v(id, type, severity, magnitude),
    (SELECT (SELECT count(*) FROM @functions) AS f, (SELECT avg(complexity) FROM @functions) AS c, (SELECT count(*) FROM @classes) AS k, (SELECT count(*) FROM @modules) AS m, (SELECT count(*) FROM @edges WHERE edge_type = 'CALLS') AS e)
    WHERE (id = 'many_modules' AND m > 50) OR (id = 'high_complexity' AND c > 10) OR (id = 'many_functions' AND f > 50) OR (id = 'many_classes' AND k > 20) OR (id = 'high_coupling' AND e > 2 * (f + k)))"""


@query("n11_n12_insights", f"SELECT id, type, severity, magnitude FROM {INSIGHTS}")
def _(t: Tables) -> DataFrame:
    return code.insights(counts(t), 0).select("id", "type", "severity", "magnitude")


@query("t09_insights_order", f"SELECT id FROM {INSIGHTS} WHERE severity = 'warning'")
def _(t: Tables) -> DataFrame:
    from quillgraph.operators import ranking

    return ranking.insights(code.insights(counts(t), 0)).filter("severity = 'warning'").select("id")


@query("a17_insight_health", f"SELECT count(*) AS insights, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE type = 'architecture') AS architectural, CAST(floor((100 + 80 + CASE WHEN count(*) FILTER (WHERE type = 'architecture') = 0 THEN 100 ELSE greatest(0, 100 - 15 * count(*) FILTER (WHERE type = 'architecture')) END + greatest(0, 100 - 10 * count(*) FILTER (WHERE severity = 'warning')) + 75) / 5e0 + 0.5e0) AS INT) AS health FROM {INSIGHTS}")
def _(t: Tables) -> DataFrame:
    return code.insight_health(code.insights(counts(t), 0), F.lit(10))


@query("a18_overall_health", "SELECT CAST(floor((greatest(0e0, 100 - avg(complexity) * 5) + 80 + greatest(0e0, 100 - least(1e0, sum(line_count) / 1000000e0) * 100) + 60) / 4e0 + 0.5e0) AS INT) AS health FROM @functions")
def _(t: Tables) -> DataFrame:
    one = t.functions.agg(F.avg("complexity").alias("c"), F.least(F.lit(1.0), F.sum("line_count") / 1_000_000.0).alias("d"))
    return one.select(code.overall_health(F.col("c"), F.lit(1), F.col("d"), F.lit(60)).alias("health"))


@query("f19_content_hash", """WITH h AS (SELECT id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(name, ''), lambda c: unicode(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM @functions)
    SELECT id, lower(to_base(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END), 36)) AS hash FROM h""")
def _(t: Tables) -> DataFrame:
    return t.functions.select("id", T.hash36(F.col("name")).alias("hash"))


@query("f21_status_and_issues", "SELECT severity, count(*) AS n FROM @issues GROUP BY severity")
def _(t: Tables) -> DataFrame:
    section = F.when(F.col("severity") == "critical", "Critical problems").when(F.col("severity") == "high", "Security").when(F.col("severity") == "medium", "Medium").otherwise("Rest")
    docs = t.issues.select(F.concat("id", F.lit(".md")).alias("path"), F.concat(F.lit("## "), section, F.lit("\n### Issue "), "id", F.lit("\nbody text\n")).alias("content"))
    return tools.issue_list(docs).groupBy("severity").agg(F.count("*").alias("n"))


@query("f21_status_table", "SELECT name AS component, complexity AS completion FROM @functions")
def _(t: Tables) -> DataFrame:
    docs = t.functions.select(F.concat("id", F.lit(".md")).alias("path"), F.concat(F.lit("| Component | Status | Done |\n| "), "name", F.lit(" | open | "), "complexity", F.lit("% |")).alias("content"))
    return tools.status_table(docs).select("component", "completion")


def code_graph(t: Tables) -> intents.Graph:
    return intents.Graph(t.functions, t.classes, t.modules, t.edges)


ASKED = {
    "f22_ask_complex": ("What are the most complex functions with complexity more than 30?", "SELECT id, complexity FROM @functions WHERE complexity > 30 ORDER BY complexity DESC, id LIMIT 20", ("id", "complexity")),
    "f22_ask_callers": ("Which functions call 'red widget'?", "SELECT DISTINCT f.id FROM @functions f JOIN @edges e ON e.src = f.id WHERE e.edge_type = 'CALLS' AND e.dst IN (SELECT id FROM @functions WHERE contains(name, 'red widget')) ORDER BY f.id LIMIT 20", ("id",)),
    "f22_ask_unused": ("Which functions are never called?", "SELECT f.id FROM @functions f WHERE visibility <> 'private' AND NOT EXISTS (SELECT 1 FROM @edges e WHERE e.edge_type = 'CALLS' AND e.dst = f.id) ORDER BY f.id LIMIT 20", ("id",)),
    "f22_ask_parameters": ("Functions with more than 10 parameters", "SELECT id, param_count FROM @functions WHERE param_count > 10 ORDER BY param_count DESC, id LIMIT 20", ("id", "param_count")),
    "f22_ask_imports": ("Modules with most imports", "SELECT src AS id, count(DISTINCT dst) AS imports FROM @edges WHERE edge_type = 'IMPORTS' GROUP BY src ORDER BY imports DESC, id LIMIT 20", ("id", "imports")),
    "f22_ask_methods": ("Classes with most methods", "SELECT src AS id, count(DISTINCT dst) AS methods FROM @edges WHERE edge_type = 'DEFINES' GROUP BY src ORDER BY methods DESC, id LIMIT 20", ("id", "methods")),
    "f22_ask_unused_modules": ("Show unused modules", "SELECT id FROM @modules m WHERE NOT EXISTS (SELECT 1 FROM @edges e WHERE e.edge_type = 'IMPORTS' AND e.dst = m.id) ORDER BY id LIMIT 20", ("id",)),
    "f22_ask_count": ("How many functions are there?", "SELECT count(*) AS n FROM @functions", ("n",)),
    "f22_ask_duplicates": ("Find duplicate code", "SELECT a.id AS id1, b.id AS id2 FROM @functions a JOIN @functions b ON a.signature = b.signature AND a.id <> b.id AND a.file_path <> b.file_path ORDER BY a.line_count DESC, a.id, b.id LIMIT 20", ("id1", "id2")),
    "f22_ask_debt": ("What technical debt is there?", f"SELECT id, priority FROM {COMPLEXITY} ORDER BY priority DESC, id LIMIT 20", ("id", "priority")),
    "f22_ask_hotspots": ("Show performance hotspots", "SELECT id, complexity * (k + 1) AS heat FROM (SELECT f.id, f.complexity, count(DISTINCT e.src) AS k FROM @functions f LEFT JOIN @edges e ON e.dst = f.id AND e.edge_type = 'CALLS' GROUP BY f.id, f.complexity) ORDER BY heat DESC, id LIMIT 20", ("id", "heat")),
    "f22_ask_architecture": ("Give an architecture overview", "SELECT edge_type, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM @edges GROUP BY edge_type", ("edge_type", "edges", "sources", "targets")),
}
for _name, (_question, _sql, _columns) in ASKED.items():
    query(_name, _sql)(lambda t, q=_question, c=_columns: intents.answer(q, code_graph(t)).select(*c))


@query("e09_guarded_sql", "SELECT node_type, count(*) AS n FROM @nodes GROUP BY node_type")
def _(t: Tables) -> DataFrame:
    return tools.query(t.spark, "SELECT node_type, count(*) AS n FROM {nodes} GROUP BY node_type", nodes=t.nodes)


@query("tool_find_usage", "SELECT DISTINCT f.id FROM @functions f JOIN @edges e ON e.src = f.id WHERE e.edge_type = 'CALLS' AND e.dst = 10")
def _(t: Tables) -> DataFrame:
    return tools.run(tools.Store(t.docs, t.nodes, t.edges, code=code_graph(t)), "find_usage", 10).select("id")


@query("tool_dependency_graph", "SELECT src, dst FROM @edges WHERE edge_type = 'IMPORTS'")
def _(t: Tables) -> DataFrame:
    return tools.run(tools.Store(t.docs, t.nodes, t.edges, code=code_graph(t)), "dependency_graph").select("src", "dst")


@query("tool_security_scan", "SELECT id, 'eval' AS spot FROM @functions WHERE id % 9 = 0")
def _(t: Tables) -> DataFrame:
    rows = t.functions.select("id", "file_path", F.when(F.col("id") % 9 == 0, "return eval(x)").otherwise(F.col("name")).alias("content"))
    return tools.run(tools.Store(t.docs, entities=rows), "security_analysis").select("id", "spot")


def sources(t: Tables) -> DataFrame:
    """A generated source file for each function of the part table: one class with two methods, an import and an export."""
    body = F.concat(
        F.lit("import { Base } from './base';\n/** Makes things. */\nexport class K"), "id", F.lit(" extends Base implements Shape {\n  private static one: number = 1;\n  constructor(private a: Base) { this.make(a); }\n  async make(x: Base, y: number): Promise<void> {\n"),
        F.repeat(F.lit("    if (x && y) { run(x); }\n"), (F.col("complexity") % 5).cast("int")), F.lit("  }\n}\nexport function run(x: Base): void {\n  console.log(x);\n}\n"),
    )
    return parse.spread(t.functions.select("id", "complexity"), "id").select(F.concat(F.lit("src/k"), "id", F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"), body.alias("content"), "id", "complexity")


@query("n01_n05_entities", "SELECT k AS entity_type, count(*) * n AS n FROM @functions, (VALUES ('Class', 1), ('Function', 3), ('Variable', 1), ('Import', 1), ('Export', 2)) v(k, n) GROUP BY k, n")
def _(t: Tables) -> DataFrame:
    return parse.entities(sources(t)).groupBy("entity_type").agg(F.count("*").alias("n"))


@query("f16_complexity", "SELECT concat('src/k', id, '.ts') AS file_path, 1 + 2 * (complexity % 5) AS complexity, CAST(3 + complexity % 5 - 1 AS INT) AS line_count FROM @functions")
def _(t: Tables) -> DataFrame:
    return parse.entities(sources(t)).filter("name = 'make'").select("file_path", "complexity", "line_count")


@query("n06_calls", "SELECT count(*) AS n FROM @functions WHERE complexity % 5 > 0")
def _(t: Tables) -> DataFrame:
    calls = parse.raw_relations(sources(t)).filter("name = 'run' AND rel_type = 'CALLS'")
    return calls.select("file_path").distinct().agg(F.count("*").alias("n"))


@query("n07_imports", "SELECT concat('src/k', id, '.ts') AS file_path, 'Base' AS imported, './base' AS spec FROM @functions")
def _(t: Tables) -> DataFrame:
    return parse.imports(parse.entities(sources(t))).select("file_path", "imported", "spec")


@query("n08_inheritance", "SELECT concat('K', id) AS src, 'INHERITS' AS rel_type FROM @functions UNION ALL SELECT concat('K', id), 'IMPLEMENTS' FROM @functions")
def _(t: Tables) -> DataFrame:
    found = graph.keep(parse.entities(sources(t)).filter(F.col("entity_type").isin(*code.TYPES)).select("id", "file_path", "entity_type", "name", "extends", "implements"))
    extra = found.filter("entity_type = 'Class'").limit(1).withColumns({"name": F.lit("Base"), "id": F.lit("base"), "extends": F.lit(None).cast("string"), "implements": F.array().cast("array<string>")})
    shape = extra.withColumns({"name": F.lit("Shape"), "id": F.lit("shape"), "entity_type": F.lit("Interface")})
    return code.resolve_inheritance(found.unionByName(extra).unionByName(shape)).select(F.regexp_extract("src", r":(K\d+):", 1).alias("src"), "rel_type")


@query("n09_containment", "SELECT concat('src/k', id, '.ts') AS file_path, 2 AS methods FROM @functions")
def _(t: Tables) -> DataFrame:
    found = graph.keep(parse.entities(sources(t)).filter("entity_type IN ('Class', 'Function')").select("id", "file_path", "entity_type", "line", "end_line"))
    inside = graph.contained(found.filter("entity_type = 'Class'"), found.filter("entity_type = 'Function'"))
    return inside.join(found.select(F.col("id").alias("inner_id"), "file_path").hint("merge"), "inner_id").groupBy("file_path").agg(F.count("*").cast("int").alias("methods"))


@query("j22_type_usage", "SELECT concat('src/k', id, '.ts') AS file_path, 3 AS uses FROM @functions")
def _(t: Tables) -> DataFrame:
    found = graph.keep(parse.entities(sources(t)).filter(F.col("entity_type").isin("Function", *code.TYPES)).select("id", "file_path", "entity_type", "name", "signature"))
    base = found.filter("entity_type = 'Class'").limit(1).withColumns({"name": F.lit("Base"), "id": F.lit("base")})
    uses = code.resolve_types(found.unionByName(base)).filter("dst = 'base'")
    return uses.join(found.select(F.col("id").alias("src"), "file_path").hint("merge"), "src").groupBy("file_path").agg(F.count("*").cast("int").alias("uses"))
