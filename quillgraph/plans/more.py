"""Queries: stores and logs written and read back, chains by value, parsers over several kinds of source, permissions and tools."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import security
from quillgraph.functions import text as T
from quillgraph.operators import audit, code, graph, index, writes
from quillgraph.plans import codes, tools
from quillgraph.plans.basic import COS, r6
from quillgraph.plans.codes import DEBT
from quillgraph.plans.domain import Tables
from quillgraph.plans.registry import query
from quillgraph.session import shared_dir
from quillgraph.sources import corpus, logs, parse, store
from quillgraph.streaming import changes, monitor


def folder(t: Tables) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_dir(t.spark)}/written-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- stores and logs


@query("s04_removed", "SELECT id FROM @docs WHERE size % 3 <> 0")
def _(t: Tables) -> DataFrame:
    return corpus.remove(t.docs, t.docs.filter("size % 3 = 0").select("path")).select("id")


@query("s02_read_one", "SELECT id, size FROM @docs WHERE path IN (SELECT min(path) FROM @docs)")
def _(t: Tables) -> DataFrame:
    first = t.docs.agg(F.min("path")).first()[0]
    return corpus.read_one(t.docs, first).select("id", "size")


@query("s05_export_and_restore", "SELECT category, count(*) AS n, sum(octet_length(encode(content))) AS bytes FROM @docs GROUP BY category")
def _(t: Tables) -> DataFrame:
    at = folder(t)
    docs = t.docs.select("path", "content", F.lit("{}").alias("metadata"), "category", "size", F.timestamp_seconds("modified_s").alias("modified"))
    first, second = store.FolderStore(t.spark, f"{at}/a"), store.FolderStore(t.spark, f"{at}/b")
    first.replace(docs)
    first.export(f"{at}/export")
    second.restore(f"{at}/export")
    return second.docs().groupBy("category").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes"))


@query("s10_markdown_only", "SELECT id FROM @docs WHERE size % 2 = 0")
def _(t: Tables) -> DataFrame:
    named = t.docs.withColumn("path", F.when(F.col("size") % 2 == 0, F.upper("path")).otherwise(F.concat("path", F.lit(".txt"))))
    return corpus.markdown_only(named).select("id")


def events_of(t: Tables) -> DataFrame:
    return t.audit.select(F.col("event_id").cast("string").alias("event_id"), F.lpad(F.col("second").cast("string"), 12, "0").alias("timestamp"), "event_type", "action", "resource", "result", F.col("user_id").cast("string").alias("user_id"), "severity", (F.col("user_id") % 8).alias("log"))


@query("s13_s14_audit_log", "SELECT event_type, severity, count(*) AS n, min(event_id) AS least FROM @audit GROUP BY event_type, severity")
def _(t: Tables) -> DataFrame:
    at = folder(t)
    logs.append_audit(events_of(t).drop("log"), at)
    return logs.read_audit(t.spark, at).groupBy("event_type", "severity").agg(F.count("*").alias("n"), F.min(F.col("event_id").cast("long")).alias("least"))


@query("s16_csv", "SELECT CAST(event_id AS VARCHAR) AS id, resource FROM @audit")
def _(t: Tables) -> DataFrame:
    at = folder(t)
    logs.write_csv(t.audit.select(F.col("event_id").alias("id"), "resource", F.struct("severity", "value").alias("more")), at)
    return t.spark.read.option("header", True).option("escape", '"').csv(at).select("id", "resource")


@query("s18_switch", "SELECT lang, count(*) AS n, sum(size) AS size FROM @docs GROUP BY lang")
def _(t: Tables) -> DataFrame:
    return corpus.switch(t.spark, t.docs, folder(t)).groupBy("lang").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


@query("s22_encrypted_and_back", "SELECT id, sha256(content) AS hash FROM @docs WHERE content IS NOT NULL")
def _(t: Tables) -> DataFrame:
    key = security.derive_key("a password", b"some salt")
    sealed = t.docs.select("id", "content", security.encrypt(F.col("content"), key).alias("sealed")).filter("content IS NOT NULL AND sealed <> encode(content, 'utf-8')")
    return sealed.select("id", F.sha2(security.decrypt(F.col("sealed"), key), 256).alias("hash"))


@query("s23_accesses", "SELECT id, count(*) AS reads FROM @docs GROUP BY id")
def _(t: Tables) -> DataFrame:
    return store.accesses(t.docs.select("path")).join(t.docs.select(F.col("path").alias("id"), F.col("id").alias("doc")), "id").groupBy(F.col("doc").alias("id")).agg(F.count("*").alias("reads"))


@query("s24_versions", "SELECT 1 AS version, count(*) AS n FROM @docs UNION ALL SELECT 2, count(*) FROM @docs WHERE size > 500")
def _(t: Tables) -> DataFrame:
    at = folder(t)
    corpus.new_version(t.docs.drop("version"), at, 1)
    corpus.new_version(t.docs.filter("size > 500"), at, 2, t.docs.filter("size <= 500"))
    both = t.spark.read.option("basePath", at).parquet(f"{at}/version=1", f"{at}/version=2")
    return both.groupBy("version").agg(F.count("*").alias("n"))


@query("s20_vector_sums", "SELECT id, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total, len(embedding) AS size FROM @vectors WHERE embedding IS NOT NULL")
def _(t: Tables) -> DataFrame:
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return corpus.vectors(t.vectors).select("id", F.round(total, 4).alias("total"), F.size("embedding").alias("size"))


# ---------------------------------------------------------------- chains and permissions

CHAIN = """e AS (SELECT *, lpad(CAST(second AS VARCHAR), 12, '0') AS ts, user_id % 8 AS log FROM @audit),
    b AS (SELECT event_id, log, row_number() OVER (PARTITION BY log ORDER BY ts, CAST(event_id AS VARCHAR)) AS i, concat('{"event_id":"', event_id, '","timestamp":"', ts, '","event_type":"', event_type, '","action":"', action, '","resource":', to_json(resource), ',"result":"', result, '",') AS body FROM e)"""


@query("w01_chain_heads", f"""WITH RECURSIVE {CHAIN},
    r AS (SELECT log, i, sha256(concat(body, '"previous_hash":"0"}}')) AS h FROM b WHERE i = 1 UNION ALL SELECT b.log, b.i, sha256(concat(b.body, '"previous_hash":"', r.h, '"}}')) FROM r JOIN b ON b.log = r.log AND b.i = r.i + 1)
    SELECT log, max_by(h, i) AS head, max(i) AS events FROM r GROUP BY log""")
def _(t: Tables) -> DataFrame:
    chained = audit.build_chain(events_of(t), "log")
    return chained.groupBy("log").agg(F.max_by("integrity_hash", F.struct("timestamp", "event_id")).alias("head"), F.count("*").alias("events"))


@query("a25_integrity", f"""WITH {CHAIN}, k AS (SELECT *, lag(event_id) OVER (PARTITION BY log ORDER BY i) AS before FROM b)
    SELECT count(*) AS events, count(*) FILTER (WHERE coalesce(before, 0) % 100 <> 50) AS valid, count(*) FILTER (WHERE coalesce(before, 0) % 100 = 50) AS invalid FROM k WHERE event_id % 100 <> 50""")
def _(t: Tables) -> DataFrame:
    chained = audit.build_chain(events_of(t), "log")
    return audit.integrity(chained.filter("CAST(event_id AS LONG) % 100 <> 50"), "log")


@query("e10_authorised", "SELECT id FROM @docs WHERE starts_with(path, concat(source, '/1')) OR starts_with(path, concat(source, '/27'))")
def _(t: Tables) -> DataFrame:
    sources = t.docs.select("source").distinct()
    roles = sources.select(F.lit("reader").alias("role"), F.concat("source", F.lit("/1*")).alias("prefix")).unionByName(sources.select(F.lit("reader").alias("role"), F.concat("source", F.lit("/27")).alias("prefix")))
    return audit.authorised(t.docs, roles, "reader").select("id")


# ---------------------------------------------------------------- memory, changes, metrics


@query("d02_created_edges", "SELECT src, dst, edge_type, max(weight) AS weight FROM @edges WHERE src IN (SELECT id FROM @nodes) AND dst IN (SELECT id FROM @nodes) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    new = t.edges.withColumn("edge_type", F.lower("edge_type")).unionByName(t.edges.withColumn("weight", F.col("weight") - 1))
    return graph.create_edges(new, t.nodes).select("src", "dst", "edge_type", "weight")


@query("x07_ttl", """SELECT id FROM @nodes n WHERE (1695000000 - created_s > 3600 AND importance < 0.3 AND memory_type = 'working') OR (importance < 0.1 AND 1695000000 - created_s > 604800)
    OR (1695000000 - created_s > 86400 AND NOT EXISTS (SELECT 1 FROM @edges e WHERE e.src = n.id OR e.dst = n.id))""")
def _(t: Tables) -> DataFrame:
    return writes.ttl(t.nodes, t.edges, F.lit(1695000000)).filter("expired").select("id")


@query("x03_changed_texts", "SELECT id FROM @docs WHERE contains(content, 'the ')")
def _(t: Tables) -> DataFrame:
    files = t.docs.filter("content IS NOT NULL").select("id", "path", "content")
    known = changes.content_hash(files.withColumn("content", F.replace("content", F.lit("the "), F.lit("The "))))
    return changes.changed(files, known).select("id")


@query("x05_text_snapshots", "SELECT path, CASE WHEN size % 5 = 1 THEN 'add' WHEN size % 5 = 2 THEN 'unlink' ELSE 'change' END AS change FROM @docs WHERE content IS NOT NULL AND (size % 5 IN (1, 2) OR length(content) > 60)")
def _(t: Tables) -> DataFrame:
    d = t.docs.filter("content IS NOT NULL")
    before = changes.content_hash(d.filter("size % 5 <> 1").select("path", F.substring("content", 1, 60).alias("content")))
    return changes.snapshot_diff(before, changes.content_hash(d.filter("size % 5 <> 2").select("path", "content")))


@query("x09_progress", "SELECT id, round(line / 997e0, 6) AS share, round(CASE WHEN line > 0 THEN complexity * (997 - line) / CAST(line AS DOUBLE) END, 6) AS eta_s FROM @functions")
def _(t: Tables) -> DataFrame:
    p = monitor.progress(F.col("line"), F.lit(997), F.col("complexity"))
    return t.functions.select("id", p.alias("p")).select("id", F.round("p.share", 6).alias("share"), F.round("p.eta_s", 6).alias("eta_s"))


@query("e07_rules", "SELECT id, rule, CASE rule WHEN 'high' THEN value > 90 WHEN 'low' THEN value <= 5 ELSE value = 50 END AS triggered FROM @samples, (VALUES ('high'), ('low'), ('even')) r(rule) WHERE name = 'view'")
def _(t: Tables) -> DataFrame:
    rules = monitor.rules_table(t.spark, {"high": ("view > 90", "high"), "low": ("view <= 5", "low"), "even": ("view == 50", "low"), "other": ("nothing > 1", "low")})
    return monitor.evaluate(t.samples.select("id", "name", "value"), rules).select("id", "rule", "triggered")


@query("f19_hash_values", """SELECT id, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) AS hash FROM (SELECT id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(signature, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM @functions)""")
def _(t: Tables) -> DataFrame:
    return t.functions.select("id", F.conv(T.hash36(F.col("signature")), 36, 10).cast("long").alias("hash"))


# ---------------------------------------------------------------- source code of several kinds

#: Source files by id % 3: interfaces, type aliases and arrow functions; nested classes, template strings and generators; Python.
TEMPLATES = (
    ("typescript", "ts", "export interface Shape@ {\n  area(): number;\n}\nexport type Alias@ = string | number;\nexport const arrow@ = async (a: string, b?: number): Promise<void> => {\n  if (a && b) { go(a); }\n};\nconst LIMIT@ = 10;\nexport abstract class Base@ implements Shape@ {\n  area(): number { return 1; }\n}\n"),
    ("javascript", "js", "// class Ghost@ {}\nclass Outer@ {\n  inner(x) {\n    return `class Text@ { if (x) }`;\n  }\n}\nfunction* gen@(x) { for (const y of x) { yield y; } }\nconst two@ = x => x * 2;\n"),
    ("python", "py", "import os\n\n\nclass P@(Base):\n    def m@(self, x: int) -> int:\n        return x if x else 0\n\n\nasync def f@(a, *b, **c):\n    while a:\n        a = os.path(a)\n"),
)
EXPECTED = (
    (0, "Interface", "Shape@"), (0, "Type", "Alias@"), (0, "Function", "arrow@"), (0, "Constant", "LIMIT@"), (0, "Class", "Base@"), (0, "Function", "area"),
    (1, "Class", "Outer@"), (1, "Function", "inner"), (1, "Function", "gen@"), (1, "Function", "two@"),
    (2, "Class", "P@"), (2, "Function", "m@"), (2, "Function", "f@"), (2, "Import", "os"), (2, "Variable", "a"),
)


def kinds_of_source(t: Tables) -> DataFrame:
    body, language, ending = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, end, text) in enumerate(TEMPLATES):
        here = F.col("id") % len(TEMPLATES) == i
        body, language, ending = F.when(here, F.replace(F.lit(text), F.lit("@"), F.col("id").cast("string"))).otherwise(body), F.when(here, name).otherwise(language), F.when(here, end).otherwise(ending)
    return parse.spread(t.functions.select("id"), "id").select(F.concat(F.lit("src/"), "id", F.lit("."), ending).alias("path"), language.alias("language"), body.alias("content"))


_VALUES = ", ".join(f"({i}, '{kind}', '{name}')" for i, kind, name in EXPECTED)


@query("n02_n03_kinds_of_source", f"SELECT f.id AS file, k AS entity_type, replace(n, '@', CAST(f.id AS VARCHAR)) AS name FROM @functions f JOIN (VALUES {_VALUES}) v(i, k, n) ON f.id % 3 = v.i")
def _(t: Tables) -> DataFrame:
    found = parse.entities(kinds_of_source(t)).filter("entity_type <> 'Export'")
    return found.select(F.regexp_extract("file_path", r"(\d+)\.", 1).cast("long").alias("file"), "entity_type", "name")


@query("f16_complexity_by_kind", """SELECT f.id AS file, replace(n, '@', CAST(f.id AS VARCHAR)) AS name, CAST(c AS INT) AS complexity, CAST(l AS INT) AS line FROM @functions f
    JOIN (VALUES (0, 'arrow@', 3, 5), (0, 'area', 1, 10), (1, 'inner', 1, 3), (1, 'gen@', 2, 7), (1, 'two@', 1, 8), (2, 'm@', 2, 5), (2, 'f@', 2, 9)) v(i, n, c, l) ON f.id % 3 = v.i""")
def _(t: Tables) -> DataFrame:
    found = parse.entities(kinds_of_source(t)).filter("entity_type = 'Function'")
    return found.select(F.regexp_extract("file_path", r"(\d+)\.", 1).cast("long").alias("file"), "name", F.col("complexity").cast("int").alias("complexity"), "line")


@query("u03_files_and_entities", f"SELECT l.language, count(*) AS entities FROM @functions f JOIN (VALUES {_VALUES}) v(i, k, n) ON f.id % 3 = v.i JOIN (VALUES (0, 'typescript'), (1, 'javascript'), (2, 'python')) l(i, language) ON l.i = v.i GROUP BY l.language")
def _(t: Tables) -> DataFrame:
    return parse.entities(kinds_of_source(t)).filter("entity_type <> 'Export'").groupBy("language").agg(F.count("*").alias("entities"))


def shallow(entities: DataFrame, rels: DataFrame) -> DataFrame:
    return code.finding(code.of(entities, "Function").filter("line_count < 20"), "Shallow Function", "style", "size", "low", 0.7)


@query("p13_e03_registered_rule", "SELECT concat('f', id) AS id FROM @functions WHERE id % 6 <> 0 AND line_count < 20")
def _(t: Tables) -> DataFrame:
    code.register("shallow", "style", shallow)
    try:
        return code.detect(codes.entities(t), None, ("style",)).select(F.col("entities")[0].alias("id"))
    finally:
        code.RULES.pop("shallow")


# ---------------------------------------------------------------- vectors


@query("t05_index_search")
def _(t: Tables) -> DataFrame:
    """Queries are all rows whose id is divisible by 50."""
    centres = index.fit(t.vectors)
    built = index.build(t.vectors, centres)
    return index.search(built, centres, t.vectors.filter("id % 50 = 0"), 10, index.tune(built, centres, t.vectors)).select("query", "key", "rank", r6("similarity").alias("similarity"))


@query("t05_exact_search", f"""SELECT query, key, rank, similarity FROM (SELECT q.id AS query, v.id AS key, round({COS}, 6) AS similarity, CAST(row_number() OVER (PARTITION BY q.id ORDER BY round({COS}, 9) DESC, v.id) AS INT) AS rank
    FROM @vectors v JOIN @vectors q ON v.id <> q.id WHERE q.id % 50 = 0) WHERE rank <= 10""")
def _(t: Tables) -> DataFrame:
    centres = index.fit(t.vectors)
    return index.search(index.build(t.vectors, centres), centres, t.vectors.filter("id % 50 = 0"), 10, len(centres)).select("query", "key", "rank", r6("similarity").alias("similarity"))


# ---------------------------------------------------------------- tools


def held(t: Tables) -> tools.Store:
    return tools.Store(t.docs.withColumn("modified", F.timestamp_seconds("modified_s")), t.nodes, t.edges, code=codes.code_graph(t), audit=events_of(t))


@query("tool_kb_info", "SELECT count(*) AS documents, sum(size) AS bytes, count(DISTINCT category) AS categories FROM @docs")
def _(t: Tables) -> DataFrame:
    return tools.run_secured(held(t), set(), "kb_info").drop("modified")


@query("tool_kb_audit", "SELECT CAST(event_id AS VARCHAR) AS event_id FROM @audit WHERE event_type = 'auth' ORDER BY lpad(CAST(second AS VARCHAR), 12, '0') DESC, CAST(event_id AS VARCHAR) LIMIT 50")
def _(t: Tables) -> DataFrame:
    return tools.run_secured(held(t), {"kb.admin"}, "kb_audit", event_type="auth", limit=50).select("event_id")


@query("tool_kb_list", "SELECT id FROM @docs WHERE starts_with(path, 'src1')")
def _(t: Tables) -> DataFrame:
    return tools.run(held(t), "kb_list", "src1").select("id")


@query("tool_find_function_calls", "SELECT DISTINCT f.id FROM @functions f JOIN @edges e ON e.dst = f.id WHERE e.edge_type = 'CALLS' AND e.src = 10")
def _(t: Tables) -> DataFrame:
    return tools.run(held(t), "find_function_calls", 10).select("id")


@query("tool_dead_code", "SELECT id FROM @functions f WHERE visibility <> 'private' AND NOT EXISTS (SELECT 1 FROM @edges e WHERE e.edge_type = 'CALLS' AND e.dst = f.id)")
def _(t: Tables) -> DataFrame:
    return tools.run(held(t), "dead_code_detection").select("id")


@query("tool_hotspots", "SELECT id, complexity * (k + 1) AS heat FROM (SELECT f.id, f.complexity, count(DISTINCT e.src) AS k FROM @functions f LEFT JOIN @edges e ON e.dst = f.id AND e.edge_type = 'CALLS' GROUP BY f.id, f.complexity) ORDER BY heat DESC, id LIMIT 20")
def _(t: Tables) -> DataFrame:
    return tools.run(held(t), "performance_hotspots").select("id", "heat")


@query("tool_track_debt", f"SELECT 'type' AS grouping, type AS value, count(*) AS items, sum(hours) AS hours, round(avg(priority), 6) AS avg_priority FROM {DEBT} GROUP BY type UNION ALL SELECT 'severity', severity, count(*), sum(hours), round(avg(priority), 6) FROM {DEBT} GROUP BY severity UNION ALL SELECT 'all', 'all', count(*), sum(hours), round(avg(priority), 6) FROM {DEBT}")
def _(t: Tables) -> DataFrame:
    return tools.run(held(t), "track_technical_debt").withColumn("avg_priority", r6("avg_priority"))


@query("tool_similar_code", """WITH s AS (SELECT v.id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS c FROM @vectors v, (SELECT embedding FROM @vectors WHERE id = 7) q WHERE v.id <> 7 AND v.label IN (SELECT label FROM @vectors WHERE id < 3))
    SELECT id, round(c, 6) AS similarity FROM s WHERE c >= 0.05 ORDER BY round(c, 9) DESC, id LIMIT 10""")
def _(t: Tables) -> DataFrame:
    kinds = tuple(r[0] for r in t.vectors.filter("id < 3").select("node_type").distinct().collect())
    found = tools.run(tools.Store(t.docs, nodes=t.vectors), "find_similar_code", 7, threshold=0.05, kinds=kinds)
    return found.select("id", r6("similarity").alias("similarity"))
