"""Analytics over source code: rules, debt, insights, import and symbol resolution. Entities and relationships are frames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillgraph.functions import text as T
from quillgraph.operators import graph
from quillgraph.schemas import ordinal

FINDING = ("id", "name", "type", "category", "severity", "confidence", "file_path", "line", "entities")


def finding(rows: DataFrame, name: str, kind: str, category: str, severity: Column | str, confidence: float, entities: Column | None = None) -> DataFrame:
    """rows (id, file_path, line) as findings."""
    slug = name.lower().replace(" ", "_")
    level = severity if isinstance(severity, Column) else F.lit(severity)
    return rows.select(
        F.concat(F.lit(f"{slug}_"), F.col("id")).alias("id"), F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(category).alias("category"), level.alias("severity"), F.lit(confidence).alias("confidence"),
        "file_path", "line", (F.array(F.col("id").cast("string")) if entities is None else entities).alias("entities"),
    )


def of(entities: DataFrame, kind: str) -> DataFrame:
    return entities.filter(F.col("entity_type") == kind)


def members(entities: DataFrame) -> DataFrame:
    """Functions with a class: as parent, and with the class's counts of methods by kind. Grouped by file and class."""
    return of(entities, "Function").filter("parent_class IS NOT NULL")


#: Facts of entity frames that detect works on at the moment, made once for all of its rules.
_FACTS: dict[int, DataFrame] = {}


def class_facts(entities: DataFrame) -> DataFrame:
    """A row for each class with what rules ask of its members."""
    return _FACTS.get(id(entities)) or facts_of_classes(entities)


def facts_of_classes(entities: DataFrame) -> DataFrame:
    low = F.lower("name")
    # each aggregate is a conditional maximum or count, so one shuffle of the members serves all rules
    facts = entities.filter("parent_class IS NOT NULL").groupBy("file_path", F.col("parent_class").alias("name")).agg(
        F.count_if(F.expr("entity_type = 'Function'")).alias("methods"),
        F.count_if(F.expr("entity_type = 'Variable'")).alias("properties"),
        F.coalesce(F.bool_or((F.col("name") == "constructor") & (F.col("visibility") == "private")), F.lit(False)).alias("private_constructor"),
        F.coalesce(F.bool_or(F.col("is_static") & F.contains(low, F.lit("instance")) & (F.col("entity_type") == "Function")), F.lit(False)).alias("instance_method"),
        F.coalesce(F.bool_or(F.col("is_static") & (F.col("entity_type") == "Variable")), F.lit(False)).alias("static_field"),
        F.coalesce(F.bool_or(F.startswith(low, F.lit("add"))), F.lit(False)).alias("adds"),
        F.coalesce(F.bool_or(F.startswith(low, F.lit("remove")) & F.contains(low, F.lit("observer"))), F.lit(False)).alias("removes"),
        F.coalesce(F.bool_or(F.contains(low, F.lit("notify")) | F.contains(low, F.lit("update"))), F.lit(False)).alias("notifies"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("name") == "constructor", F.col("parameters"))))).alias("constructor_types"),
    )
    return of(entities, "Class").join(facts, ["file_path", "name"], "left")


def singleton(entities: DataFrame, rels: DataFrame) -> DataFrame:
    return finding(class_facts(entities).filter("private_constructor AND instance_method AND static_field"), "Singleton", "design_pattern", "creational", "low", 0.9)


def observer(entities: DataFrame, rels: DataFrame) -> DataFrame:
    return finding(class_facts(entities).filter("adds AND removes AND notifies"), "Observer", "design_pattern", "behavioral", "low", 0.85)


def decorator(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """A class whose constructor takes the type that it implements."""
    takes = F.exists("constructor_types", lambda p: F.exists(F.col("implements"), lambda i: F.contains(p, i)))
    return finding(class_facts(entities).filter(F.coalesce(takes, F.lit(False))), "Decorator", "design_pattern", "structural", "low", 0.75)


def god_class(entities: DataFrame, rels: DataFrame) -> DataFrame:
    rows = class_facts(entities).na.fill(0, ["methods", "properties"]).filter("line_count > 1000 OR methods > 20 OR properties > 15")
    return finding(rows, "God Class", "anti_pattern", "structural", F.when((F.col("line_count") > 2000) | (F.col("methods") > 50), "high").otherwise("medium"), 0.9)


def factory(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """Functions named so that call a constructor."""
    makes = of(entities, "Function").filter(F.lower("name").rlike("create|factory|make"))
    classes = of(entities, "Class").select(F.col("id").alias("dst"))
    calls = rels.filter("rel_type = 'CALLS'").join(classes, "dst", "left_semi").select(F.col("src").alias("id"))
    return finding(makes.join(calls, "id", "left_semi"), "Factory", "design_pattern", "creational", "low", 0.8)


def strategy(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """Interfaces with two implementers or more."""
    many = rels.filter("rel_type = 'IMPLEMENTS'").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n")).filter("n >= 2")
    return finding(of(entities, "Interface").join(many, "id"), "Strategy", "design_pattern", "behavioral", "low", 0.8)


def long_method(entities: DataFrame, rels: DataFrame) -> DataFrame:
    rows = of(entities, "Function").filter("line_count > 100 OR complexity > 15")
    return finding(rows, "Long Method", "code_smell", "complexity", F.when((F.col("line_count") > 200) | (F.col("complexity") > 25), "high").otherwise("medium"), 0.85)


def large_class(entities: DataFrame, rels: DataFrame) -> DataFrame:
    return finding(of(entities, "Class").filter("line_count > 500 AND line_count <= 1000"), "Large Class", "code_smell", "structural", "medium", 0.7)


def long_parameters(entities: DataFrame, rels: DataFrame) -> DataFrame:
    rows = of(entities, "Function").filter(F.size("parameters") > 5)
    return finding(rows, "Long Parameter List", "code_smell", "complexity", F.when(F.size("parameters") > 8, "medium").otherwise("low"), 0.8)


def duplicate_code(entities: DataFrame, rels: DataFrame) -> DataFrame:
    groups = of(entities, "Function").filter("signature IS NOT NULL").groupBy(T.normal_signature(F.col("signature")).alias("normal")).agg(
        F.min_by(F.struct("id", "file_path", "line"), F.struct("file_path", "line", "id")).alias("first"), F.count_distinct("file_path").alias("files"), F.array_sort(F.collect_set(F.col("id").cast("string"))).alias("ids")
    )
    rows = groups.filter("files > 1 AND normal <> ''").select("first.*", "ids")
    return finding(rows, "Duplicate Code", "code_smell", "duplication", "medium", 0.8, F.col("ids"))


def circular(entities: DataFrame, rels: DataFrame, max_length: int = 10) -> DataFrame:
    """Import cycles of up to max_length, once each (graph.cycle_edges has no bound); walks are made only of edges that can lie on one."""
    imports = graph.in_cycles(rels.filter("rel_type = 'IMPORTS'").select("src", "dst"))
    found = graph.cycles(imports, 2, max_length, None)
    rows = found.select(F.col("cycle")[0].alias("id"), F.col("cycle").cast("array<string>").alias("ids")).join(entities.select("id", "file_path", "line"), "id", "left")
    return finding(rows.withColumn("id", F.array_join("ids", "-")), "Circular Dependency", "anti_pattern", "architectural", "high", 0.95, F.col("ids"))


def dead_code(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """Functions that aren't called, aren't private and aren't exported by name from their file."""
    called = rels.filter("rel_type = 'CALLS'").select(F.col("dst").alias("id"))
    exported = of(entities, "Export").select("file_path", "name")
    rows = of(entities, "Function").filter("coalesce(visibility, 'public') <> 'private'").join(called, "id", "left_anti").join(exported, ["file_path", "name"], "left_anti")
    return finding(rows, "Dead Code", "code_smell", "maintainability", "low", 0.9)


Rule = Callable[[DataFrame, DataFrame], DataFrame]
#: name -> (type, rule); register more with `register`.
RULES: dict[str, tuple[str, Rule]] = {
    "singleton": ("design_pattern", singleton), "observer": ("design_pattern", observer), "decorator": ("design_pattern", decorator), "factory": ("design_pattern", factory), "strategy": ("design_pattern", strategy),
    "god_class": ("anti_pattern", god_class), "circular": ("anti_pattern", circular), "long_method": ("code_smell", long_method), "large_class": ("code_smell", large_class),
    "long_parameters": ("code_smell", long_parameters), "duplicate_code": ("code_smell", duplicate_code), "dead_code": ("code_smell", dead_code),
}


def register(name: str, kind: str, rule: Rule) -> None:
    RULES[name] = (kind, rule)


def detect(entities: DataFrame, rels: DataFrame, kinds: tuple[str, ...] | None = None, min_confidence: float = 0.5) -> DataFrame:
    """Findings of all rules, or those of some kinds. Keep entities and rels in a table first; every rule reads them. What rules ask of classes is worked out once."""
    chosen = [rule for kind, rule in RULES.values() if not kinds or kind in kinds]
    _FACTS[id(entities)] = graph.keep(facts_of_classes(entities))
    try:
        return findings_of(chosen, entities, rels, min_confidence)
    finally:
        del _FACTS[id(entities)]


def findings_of(chosen: list[Rule], entities: DataFrame, rels: DataFrame, min_confidence: float) -> DataFrame:
    return reduce(DataFrame.unionByName, [rule(entities, rels) for rule in chosen]).filter(F.col("confidence") >= min_confidence)


# ---------------------------------------------------------------- debt


def priority(rows: DataFrame) -> DataFrame:
    """rows (four impacts, severity, hours) with priority 0..100."""
    impact = (F.col("maintainability") + F.col("readability") + F.col("testability") + F.col("performance")) / 4
    level = ordinal(F.col("severity")) * 25
    return rows.withColumn("priority", F.floor(impact * 0.4 + level * 0.4 + F.greatest(F.lit(0), 100 - F.col("hours") * 2) * 0.2 + 0.5).cast("int"))


def complexity_debt(functions: DataFrame) -> DataFrame:
    c = F.col("complexity")
    left = lambda k: F.greatest(F.lit(0), 100 - c * k).cast("double")
    rows = functions.filter(c > 10).select(
        F.concat(F.lit("complexity_"), "id").alias("id"), F.lit("complexity").alias("type"), F.when(c > 20, "high").when(c > 15, "medium").otherwise("low").alias("severity"), F.ceil(c / 5).cast("double").alias("hours"),
        left(3).alias("maintainability"), left(4).alias("readability"), left(5).alias("testability"), F.lit(80.0).alias("performance"), F.when(c > 20, "hard").otherwise("medium").alias("difficulty"), F.lit("complexity").alias("source"),
    )
    return priority(rows)


def duplication_debt(groups: DataFrame) -> DataFrame:
    """groups: normal, members, lines."""
    n = F.col("members")
    left = lambda k: F.greatest(F.lit(0), 100 - n * k).cast("double")
    rows = groups.select(
        F.concat(F.lit("duplication_"), "normal").alias("id"), F.lit("duplication").alias("type"), F.when(n > 3, "high").otherwise("medium").alias("severity"), F.ceil(F.col("lines") / 50).cast("double").alias("hours"),
        left(15).alias("maintainability"), F.lit(70.0).alias("readability"), left(10).alias("testability"), F.lit(85.0).alias("performance"), F.lit("medium").alias("difficulty"), F.lit("duplication").alias("source"),
    )
    return priority(rows)


def pattern_debt(findings: DataFrame, entities: DataFrame) -> DataFrame:
    """Anti-patterns and smells as debt: effort from the lines of what they involve."""
    bad = findings.filter("type IN ('anti_pattern', 'code_smell')")
    involved = bad.select("id", F.explode("entities").alias("e")).join(entities.select(F.col("id").cast("string").alias("e"), F.coalesce("line_count", F.lit(10)).alias("lines")), "e").groupBy("id").agg(F.sum("lines").alias("lines"))
    times = F.when(F.col("severity") == "low", 0.8).when(F.col("severity") == "medium", 1.0).when(F.col("severity") == "high", 1.3).otherwise(1.6)
    part = lambda base: F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(float(base)) * times))
    hours = F.ceil(F.coalesce("lines", F.lit(0)) / 20) * F.when(F.col("type") == "anti_pattern", 1.5).otherwise(1.0) * F.when(F.col("category") == "architectural", 2.0).otherwise(1.0)
    low, kind = F.lower("name"), F.lit("complexity")
    for word, name in (("security", "security"), ("performance", "performance"), ("dependency", "dependencies"), ("duplicate", "duplication"), ("complex", "complexity")):
        kind = F.when(F.contains(low, F.lit(word)), name).otherwise(kind)
    rows = bad.join(involved, "id", "left").select(
        F.concat(F.lit("pattern_"), "id").alias("id"), kind.alias("type"), "severity", F.greatest(F.lit(1.0), F.least(F.lit(40.0), hours)).alias("hours"), part(70).alias("maintainability"), part(70).alias("readability"), part(70).alias("testability"), part(80).alias("performance"),
        F.when(F.col("category") == "architectural", "expert").when((F.col("type") == "anti_pattern") & (F.col("severity") == "critical"), "expert").when(F.col("type") == "anti_pattern", "hard").otherwise("medium").alias("difficulty"), F.lit("pattern").alias("source"),
    )
    return priority(rows)


def dependency_debt(cycles: DataFrame) -> DataFrame:
    """A high debt for each import cycle."""
    rows = cycles.select(
        F.concat(F.lit("dependency_"), F.array_join(F.col("cycle").cast("array<string>"), "-")).alias("id"), F.lit("dependencies").alias("type"), F.lit("high").alias("severity"), (F.col("length") * 4).cast("double").alias("hours"),
        F.lit(30.0).alias("maintainability"), F.lit(40.0).alias("readability"), F.lit(30.0).alias("testability"), F.lit(70.0).alias("performance"), F.lit("expert").alias("difficulty"), F.lit("dependency").alias("source"),
    )
    return priority(rows)


def documentation_debt(functions: DataFrame) -> DataFrame:
    """One item if anything is undocumented."""
    n, bare = F.count("*"), F.count_if(~F.col("documented"))
    one = functions.agg(n.alias("n"), bare.alias("bare")).filter("bare > 0")
    rows = one.select(
        F.lit("documentation").alias("id"), F.lit("documentation").alias("type"), F.when(F.col("bare") > F.col("n") / 2, "medium").otherwise("low").alias("severity"), F.ceil(F.col("bare") / 2).cast("double").alias("hours"),
        F.lit(60.0).alias("maintainability"), F.lit(50.0).alias("readability"), F.lit(80.0).alias("testability"), F.lit(90.0).alias("performance"), F.lit("easy").alias("difficulty"), F.lit("documentation").alias("source"),
    )
    return priority(rows)


def debt_summary(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("items"), F.coalesce(F.sum("hours"), F.lit(0.0)).alias("hours"), F.coalesce(F.avg("priority"), F.lit(0.0)).alias("avg_priority"), F.least(F.lit(1.0), F.coalesce(F.sum("hours"), F.lit(0.0)) / 1000).alias("debt_ratio"))


def debt_report(items: DataFrame) -> DataFrame:
    """By type, by severity and in all, from one pass: `grouping` tells which."""
    sets = items.groupingSets([[F.col("type")], [F.col("severity")], []], "type", "severity").agg(F.count("*").alias("items"), F.sum("hours").alias("hours"), F.avg("priority").alias("avg_priority"), F.grouping_id().alias("g"))
    return sets.select(F.when(F.col("g") == 1, "type").when(F.col("g") == 2, "severity").otherwise("all").alias("grouping"), F.coalesce("type", "severity", F.lit("all")).alias("value"), "items", "hours", "avg_priority")


# ---------------------------------------------------------------- insights and health


def insights(counts: DataFrame, cycles: int) -> DataFrame:
    """counts: one row of modules, avg_complexity, functions, classes, calls, entities; the insights that hold, a row each."""
    def when(cond: Column, name: str, kind: str, severity: str, confidence: float, magnitude: str, effort: str) -> Column:
        return F.when(cond, F.struct(F.lit(name).alias("id"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), F.lit(magnitude).alias("magnitude"), F.lit(effort).alias("effort")))

    rules = (
        when(F.col("modules") > 50, "many_modules", "architecture", "warning", 0.8, "medium", "significant"),
        when(F.lit(cycles) > 0, "circular_dependencies", "architecture", "critical", 0.95, "high", "significant"),
        when(F.col("avg_complexity") > 10, "high_complexity", "quality", "warning", 0.9, "high", "moderate"),
        when(F.col("functions") > 50, "many_functions", "file", "info", 0.7, "low", "moderate"),
        when(F.col("classes") > 20, "many_classes", "file", "info", 0.7, "low", "moderate"),
        when(F.col("calls") > 2 * F.col("entities"), "high_coupling", "file", "warning", 0.75, "medium", "moderate"),
    )
    return counts.select(F.explode(F.array_compact(F.array(*rules))).alias("i")).select("i.*")


def action_plan(rows: DataFrame) -> DataFrame:
    """rows with plan: immediate, short_term, long_term or none, each insight in the first that fits."""
    plan = (
        F.when((F.col("severity") == "critical") | ((F.col("severity") == "warning") & (F.col("magnitude") == "high")), "immediate")
        .when((F.col("severity") == "warning") & (F.col("effort") != "significant"), "short_term")
        .when(F.col("magnitude") == "high", "long_term")
        .otherwise("none")
    )
    return rows.withColumn("plan", plan)


def insight_health(insights_: DataFrame, debt_items: Column) -> DataFrame:
    """One row: counts and the rounded mean of five factors."""
    critical, arch, warn = F.count_if(F.expr("severity = 'critical'")), F.count_if(F.expr("type = 'architecture'")), F.count_if(F.expr("severity = 'warning'"))
    factors = F.greatest(F.lit(0), 100 - critical * 20) + F.greatest(F.lit(0), 100 - debt_items * 2) + F.when(arch == 0, 100).otherwise(F.greatest(F.lit(0), 100 - arch * 15)) + F.greatest(F.lit(0), 100 - warn * 10) + 75
    return insights_.agg(F.count("*").alias("insights"), critical.alias("critical"), arch.alias("architectural"), F.floor(factors / 5 + 0.5).cast("int").alias("health"))


def overall_health(avg_complexity: Column, critical_patterns: Column, debt_ratio: Column, insight: Column) -> Column:
    factors = F.greatest(F.lit(0.0), 100 - avg_complexity * 5) + F.greatest(F.lit(0), 100 - critical_patterns * 20) + F.greatest(F.lit(0.0), 100 - debt_ratio * 100) + insight
    return F.floor(factors / 4 + 0.5).cast("int")


# ---------------------------------------------------------------- resolution


def candidates(importer: Column, spec: Column) -> Column:
    """Paths that an import may mean, in order: as given, with an extension, an index file; relative, or from src/ by alias @/."""
    base = F.when(F.startswith(spec, F.lit(".")), T.relative_path(importer, spec)).when(F.startswith(spec, F.lit("@/")), F.concat(F.lit("src/"), F.substring(spec, F.lit(3), F.length(spec))))
    ends = ("", ".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.tsx", "/index.js", "/__init__.py")
    return F.array(*(F.concat(base, F.lit(e)) for e in ends))


def resolve_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (id, file_path, spec) with `module`: the first candidate that is a file, else null (a package)."""
    tried = imports.select("id", F.posexplode(candidates(F.col("file_path"), F.col("spec"))).alias("rank", "path")).filter("path IS NOT NULL")
    hit = tried.join(files.select("path").distinct(), "path").groupBy("id").agg(F.min_by("path", "rank").alias("module"))
    return imports.join(hit, "id", "left")


def resolve_imports(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """imports (id, file_path, module, imported) with the entity exported under that name, or by default; null where unresolved.; of several the one with the least id"""
    named = exports.select(F.col("file_path").alias("module"), F.col("name").alias("imported"), "entity_id", "is_default")
    by_name = named.groupBy("module", "imported").agg(F.min("entity_id").alias("by_name"))
    default = named.filter("is_default").groupBy("module").agg(F.min("entity_id").alias("by_default"))
    out = imports.join(by_name, ["module", "imported"], "left").join(default, "module", "left")
    return out.withColumn("entity_id", F.coalesce("by_name", F.when(F.col("imported") == "default", F.col("by_default")))).drop("by_name", "by_default")


def file_dependencies(imports: DataFrame) -> DataFrame:
    """DEPENDS_ON edges between files."""
    return imports.filter("module IS NOT NULL AND module <> file_path").select(F.col("file_path").alias("src"), F.col("module").alias("dst")).distinct().withColumn("edge_type", F.lit("DEPENDS_ON"))


def unresolved(imports: DataFrame) -> DataFrame:
    return imports.filter("entity_id IS NULL")


def resolve_calls(calls: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """calls (id, file_path, callee) with the imported entity they mean: by local name, else through a namespace import (ns.name)."""
    local = imports.filter("entity_id IS NOT NULL").select("file_path", F.col("local").alias("callee"), F.col("entity_id").alias("direct")).dropDuplicates(["file_path", "callee"])
    spaces = imports.filter("imported = '*'").select("file_path", F.col("local").alias("space"), "module").dropDuplicates(["file_path", "space"])
    names = exports.select(F.col("file_path").alias("module"), F.col("name").alias("member"), F.col("entity_id").alias("through")).dropDuplicates(["module", "member"])
    split = calls.withColumn("space", F.regexp_extract("callee", r"^(\w+)\.", 1)).withColumn("member", F.regexp_extract("callee", r"\.(\w+)$", 1))
    out = split.join(local, ["file_path", "callee"], "left").join(spaces, ["file_path", "space"], "left").join(names, ["module", "member"], "left")
    return out.select("id", "file_path", "callee", F.coalesce("direct", "through").alias("entity_id"))


#: Kinds of entities that are types, and how many names lookup takes as frequent.
TYPES, FREQUENT = ("Class", "Interface", "Type"), 1000


def lookup(uses: DataFrame, entities: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """uses (id, file_path, name) with entity_id: of that name in the same file, else the first anywhere by id.

    The second is one entity for each name, so a frequent name isn't joined to all of its bearers; it is broadcast for the FREQUENT
    names with most uses, as one task would get all of a name's. The rest is joined by key: what a parser yields is much more than
    Spark estimates from the table that was parsed, and would be broadcast whole.
    """
    named = entities.filter(F.col("entity_type").isin(*kinds)) if kinds else entities
    here = named.groupBy("file_path", "name").agg(F.min("id").alias("here"))
    anywhere = named.groupBy("name").agg(F.min("id").alias("anywhere"))
    often = uses.groupBy("name").agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), "name").limit(FREQUENT).select("name")
    tried = uses.join(here.hint("merge"), ["file_path", "name"], "left")
    frequent = tried.join(F.broadcast(anywhere.join(F.broadcast(often), "name", "right")), "name")
    others = tried.join(F.broadcast(often), "name", "left_anti").join(anywhere.hint("merge"), "name", "left")
    return frequent.unionByName(others).select(*uses.columns, F.coalesce("here", "anywhere").alias("entity_id"))


def resolve_inheritance(entities: DataFrame) -> DataFrame:
    """INHERITS and IMPLEMENTS edges from classes to what they name."""
    base = of(entities, "Class")
    up = base.filter("extends IS NOT NULL").select(F.col("id").alias("src"), "file_path", F.col("extends").alias("name"), F.lit("INHERITS").alias("rel_type"))
    does = base.select(F.col("id").alias("src"), "file_path", F.explode("implements").alias("name"), F.lit("IMPLEMENTS").alias("rel_type"))
    found = lookup(up.unionByName(does).withColumnRenamed("src", "id"), entities, TYPES)
    return found.filter("entity_id IS NOT NULL").select(F.col("id").alias("src"), F.col("entity_id").alias("dst"), "rel_type")


def resolve_types(entities: DataFrame) -> DataFrame:
    """USES edges from functions to the types in their signatures."""
    uses = of(entities, "Function").select("id", "file_path", F.explode(F.array_distinct(T.types_in(F.col("signature")))).alias("name"))
    return lookup(uses, entities, TYPES).filter("entity_id IS NOT NULL").select(F.col("id").alias("src"), F.col("entity_id").alias("dst"), F.lit("USES").alias("rel_type"))


def placeholders(names: DataFrame) -> DataFrame:
    """An external entity for each distinct name that nothing defines, under a key made of it."""
    return names.select(F.concat(F.lit("external:"), "name").alias("id"), "name", F.lit("External").alias("entity_type")).dropDuplicates(["id"])


def interface_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose set of exported names differs between two snapshots (file_path, name)."""
    one = lambda a, b: a.select("file_path", "name").distinct().exceptAll(b.select("file_path", "name").distinct())
    return one(before, after).unionByName(one(after, before)).select("file_path").distinct()


def dependents(changed: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Files that depend on a changed one."""
    return dependencies.join(changed.select(F.col("file_path").alias("dst")), "dst", "left_semi").select(F.col("src").alias("file_path")).distinct()


def hotspots(functions: DataFrame, calls: DataFrame, limit: int = 20) -> DataFrame:
    """Functions by complexity times one more than their callers."""
    callers = calls.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("callers"))
    out = functions.join(callers, "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    return out.withColumn("heat", F.col("complexity") * (F.col("callers") + 1)).orderBy(F.desc("heat"), "id").limit(limit)


def security_scan(entities: DataFrame) -> DataFrame:
    """Spots in code that deserve a look: dynamic evaluation, shell calls, markup injection, secrets."""
    spots = (("eval", r"\beval\s*\("), ("shell", r"\b(exec|execSync|spawn|system|popen)\s*\("), ("markup", r"innerHTML\s*="), ("secret", r"(?i)(password|secret|api_?key|token)\s*[:=]\s*['\"][^'\"]+['\"]"))
    hits = F.array_compact(F.array(*(F.when(F.col("content").rlike(p), F.lit(n)) for n, p in spots)))
    return entities.select("id", "file_path", F.explode(hits).alias("spot"))


def largest_classes(members_: DataFrame, limit: int = 20) -> DataFrame:
    """Classes with most methods."""
    return members_.groupBy("class").agg(F.count("*").alias("methods")).orderBy(F.desc("methods"), "class").limit(limit)


def first_rank(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("n = 1").drop("n")
