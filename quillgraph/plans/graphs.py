"""Queries: joins, traversals, resolution and similarity joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import blocks, code, graph, ranking, search
from quillgraph.plans.basic import r6
from quillgraph.plans.domain import Tables
from quillgraph.plans.registry import query

UNDIRECTED = "(SELECT src, dst, edge_type, weight FROM @edges UNION ALL SELECT dst, src, edge_type, weight FROM @edges)"


@query("a01_graph_stats", "SELECT n AS total_nodes, e AS total_edges, round(e / n, 6) AS avg_connections, round(e / (n * (n - 1)), 9) AS density, nt AS node_types, et AS edge_types FROM (SELECT count(*) AS n, array_to_string(list_sort(list(DISTINCT node_type)), ',') AS nt FROM @nodes), (SELECT count(*) AS e, array_to_string(list_sort(list(DISTINCT edge_type)), ',') AS et FROM @edges)")
def _(t: Tables) -> DataFrame:
    return graph.stats(t.nodes, t.edges).select("total_nodes", "total_edges", r6("avg_connections").alias("avg_connections"), F.round("density", 9).alias("density"), *(F.array_join(c, ",").alias(c) for c in ("node_types", "edge_types")))


@query("j01_neighbours", f"SELECT u.dst AS id, u.edge_type, u.weight, n.node_type FROM {UNDIRECTED} u JOIN @nodes n ON n.id = u.dst WHERE u.src = 5 AND u.weight >= 0.6 ORDER BY u.weight DESC, u.dst, u.edge_type LIMIT 25")
def _(t: Tables) -> DataFrame:
    return graph.neighbours(t.edges, t.nodes, 5, 0.6, 25).select("id", "edge_type", "weight", "node_type")


@query("j02_hits_with_neighbours", f"""WITH h AS (SELECT id, score FROM (SELECT id, (CAST(contains(lower(content), 'red') AS INT) + CAST(contains(lower(content), 'ring') AS INT)) / 2e0 AS score FROM @nodes) WHERE score >= 0.5 ORDER BY score DESC, id LIMIT 20)
    SELECT h.id, h.score, count(DISTINCT u.dst) AS neighbours FROM h LEFT JOIN {UNDIRECTED} u ON u.src = h.id GROUP BY h.id, h.score""")
def _(t: Tables) -> DataFrame:
    hits = t.nodes.select("id", search.term_score(F.col("content"), "red ring").alias("score")).filter("score >= 0.5").orderBy(F.desc("score"), "id").limit(20)
    near = graph.undirected(t.edges.select("src", "dst")).withColumnRenamed("src", "id")
    return hits.join(near, "id", "left").groupBy("id", "score").agg(F.count_distinct("dst").alias("neighbours"))


@query("j03_file_view", "SELECT f.id, count(DISTINCT CASE WHEN e.dst IS NOT NULL THEN concat(e.edge_type, ':', e.dst) END) AS relations FROM @functions f LEFT JOIN @edges e ON e.src = f.id WHERE f.file_path = 'src/brand_3.ts' GROUP BY f.id")
def _(t: Tables) -> DataFrame:
    return graph.with_relations(t.functions.filter("file_path = 'src/brand_3.ts'"), t.edges).select("id", F.size("relationships").cast("long").alias("relations"))


@query("j04_callees", "SELECT DISTINCT f.id, f.name FROM @edges e JOIN @functions f ON f.id = e.dst WHERE e.edge_type = 'CALLS' AND e.src = 10")
def _(t: Tables) -> DataFrame:
    return graph.out_of(t.edges, t.functions, 10, "CALLS").select("id", "name")


@query("j04_callers", "SELECT DISTINCT f.id, f.name FROM @edges e JOIN @functions f ON f.id = e.src WHERE e.edge_type = 'CALLS' AND e.dst = 10")
def _(t: Tables) -> DataFrame:
    return graph.into(t.edges, t.functions, 10, "CALLS").select("id", "name")


@query("j04_imports", "SELECT DISTINCT m.id, m.name FROM @edges e JOIN @modules m ON m.id = e.dst WHERE e.edge_type = 'IMPORTS' AND e.src = 20")
def _(t: Tables) -> DataFrame:
    return graph.out_of(t.edges, t.modules, 20, "IMPORTS").select("id", "name")


@query("j04_implementers", "SELECT DISTINCT c.id, c.name FROM @edges e JOIN @classes c ON c.id = e.src WHERE e.edge_type = 'IMPLEMENTS' AND e.dst = 4")
def _(t: Tables) -> DataFrame:
    return graph.into(t.edges, t.classes, 4, "IMPLEMENTS").select("id", "name")


@query("j05_unused_functions", "SELECT f.id FROM @functions f WHERE visibility <> 'private' AND NOT EXISTS (SELECT 1 FROM @edges e WHERE e.edge_type = 'CALLS' AND e.dst = f.id)")
def _(t: Tables) -> DataFrame:
    return graph.without(t.functions.filter("visibility <> 'private'"), t.edges, "dst", "CALLS").select("id")


@query("j05_isolated", "SELECT n.id FROM @nodes n WHERE NOT EXISTS (SELECT 1 FROM @edges e WHERE e.edge_type = 'EXTENDS' AND (e.dst = n.id OR e.src = n.id))")
def _(t: Tables) -> DataFrame:
    return graph.without(t.nodes, t.edges, "both", "EXTENDS").select("id")


@query("j06_same_signature", "SELECT a.id AS id1, b.id AS id2 FROM @functions a JOIN @functions b ON a.signature = b.signature AND a.id <> b.id AND a.file_path <> b.file_path")
def _(t: Tables) -> DataFrame:
    return graph.same_signature(t.functions).select("id1", "id2")


@query("j07_overridden", """WITH d AS (SELECT e.src AS c, f.id, f.name, f.signature FROM @edges e JOIN @functions f ON f.id = e.dst WHERE e.edge_type = 'DEFINES')
    SELECT DISTINCT x.src AS child, x.dst AS parent, a.id AS method, b.id AS overrides FROM @edges x JOIN d a ON a.c = x.src JOIN d b ON b.c = x.dst AND a.name = b.name AND a.signature = b.signature WHERE x.edge_type = 'EXTENDS'""")
def _(t: Tables) -> DataFrame:
    return graph.overridden(t.edges, t.functions).distinct()


@query("j08_wedges", f"""WITH k AS (SELECT id FROM @nodes WHERE node_type IN ('fact', 'event')), u AS (SELECT DISTINCT src, dst FROM {UNDIRECTED} WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k))
    SELECT x.src AS a, x.dst AS b, y.dst AS c FROM u x JOIN u y ON x.dst = y.src WHERE x.src < y.dst AND x.src <> x.dst AND y.src <> y.dst ORDER BY 1, 2, 3 LIMIT 20""")
def _(t: Tables) -> DataFrame:
    return graph.wedges(t.edges, t.nodes)


@query("j09_contradictions", """WITH p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM @edges WHERE edge_type = 'CONTRADICTS' AND src <> dst)
    SELECT p.a, p.b, CASE WHEN x.confidence - y.confidence > 0.2 THEN p.a WHEN y.confidence - x.confidence > 0.2 THEN p.b WHEN x.created_s > y.created_s THEN p.a WHEN y.created_s > x.created_s THEN p.b END AS keep
    FROM p JOIN @nodes x ON x.id = p.a JOIN @nodes y ON y.id = p.b WHERE x.confidence > 0.3 AND y.confidence > 0.3""")
def _(t: Tables) -> DataFrame:
    return graph.resolve_contradictions(graph.contradictions(t.edges, t.nodes, 0.3)).select("a", "b", "keep")


@query("j10_line_containment", """WITH o AS (SELECT id, file_path, line, line + line_count AS e FROM @functions WHERE id % 5 = 0), i AS (SELECT id, file_path, line, line + 2 AS e FROM @functions WHERE id % 5 <> 0)
    SELECT inner_id, outer_id FROM (SELECT i.id AS inner_id, o.id AS outer_id, row_number() OVER (PARTITION BY i.id ORDER BY o.e - o.line, o.line DESC, o.id) AS n FROM i JOIN o ON i.file_path = o.file_path AND o.line <= i.line AND i.e <= o.e) WHERE n = 1""")
def _(t: Tables) -> DataFrame:
    f = t.functions
    outer = f.filter("id % 5 = 0").withColumn("end_line", F.col("line") + F.col("line_count"))
    return graph.contained(outer, f.filter("id % 5 <> 0").withColumn("end_line", F.col("line") + 2))


BFS = """WITH RECURSIVE u AS (SELECT DISTINCT src, dst FROM {edges}), r AS (SELECT CAST({start} AS BIGINT) AS id, 0 AS depth UNION SELECT u.dst, r.depth + 1 FROM r JOIN u ON u.src = r.id WHERE r.depth < {most})"""
HEAVY = "(SELECT src, dst FROM @edges WHERE weight >= 0.95 UNION ALL SELECT dst, src FROM @edges WHERE weight >= 0.95)"


@query("j11_neighbourhood", BFS.format(edges=HEAVY, start=1, most=3) + " SELECT id, min(depth) AS depth FROM r GROUP BY id HAVING min(depth) > 0 ORDER BY depth, id LIMIT 50")
def _(t: Tables) -> DataFrame:
    start = t.spark.createDataFrame([(1,)], "id long")
    return graph.distances(t.edges.filter("weight >= 0.95"), start, 3).filter("depth > 0").orderBy("depth", "id").limit(50)


@query("j12_distances", BFS.format(edges=HEAVY, start=2, most=6) + " SELECT id, min(depth) AS depth FROM r GROUP BY id")
def _(t: Tables) -> DataFrame:
    return graph.distances(t.edges.filter("weight >= 0.95"), t.spark.createDataFrame([(2,)], "id long"), 6)


@query("j12_shortest_path", BFS.format(edges=HEAVY, start=2, most=6) + " SELECT coalesce(min(depth), -1) AS hops FROM r WHERE id = 77")
def _(t: Tables) -> DataFrame:
    path = graph.shortest_path(t.edges.filter("weight >= 0.95"), 2, 77, 6)
    return t.spark.createDataFrame([(len(path) - 1,)], "hops int")


@query("j13_multi_hop", """WITH RECURSIVE u AS (SELECT src, dst, max(weight) AS weight FROM (SELECT src, dst, weight FROM @edges UNION ALL SELECT dst, src, weight FROM @edges) WHERE weight >= 0.95 GROUP BY src, dst),
    r AS (SELECT CAST(1 AS BIGINT) AS id, [CAST(1 AS BIGINT)] AS path, 0 AS depth, CAST(1 AS DOUBLE) AS confidence UNION ALL SELECT u.dst, list_append(r.path, u.dst), r.depth + 1, r.confidence * u.weight FROM r JOIN u ON u.src = r.id WHERE r.depth < 3 AND NOT list_contains(r.path, u.dst) AND r.confidence * u.weight >= 0.9)
    SELECT r.id, array_to_string(path, '>') AS trail, r.depth, round(r.confidence, 6) AS confidence FROM r JOIN @nodes n ON n.id = r.id WHERE r.depth > 0 AND n.node_type IN ('fact', 'concept') ORDER BY round(r.confidence, 9) DESC, r.depth, trail LIMIT 50""")
def _(t: Tables) -> DataFrame:
    return graph.multi_hop(t.edges, t.nodes, 1, ("fact", "concept"), 3, 0.95, 0.9, 50).select("id", "trail", "depth", r6("confidence").alias("confidence"))


@query("j14_hierarchy", """WITH RECURSIVE x AS (SELECT DISTINCT src, dst FROM @edges WHERE edge_type = 'EXTENDS' AND weight >= 0.8), up AS (SELECT CAST(3 AS BIGINT) AS id, 0 AS depth UNION SELECT x.dst, up.depth + 1 FROM up JOIN x ON x.src = up.id WHERE up.depth < 5),
    down AS (SELECT CAST(3 AS BIGINT) AS id, 0 AS depth UNION SELECT x.src, down.depth + 1 FROM down JOIN x ON x.dst = down.id WHERE down.depth < 5)
    SELECT id, min(depth) AS depth, 'up' AS direction FROM up GROUP BY id HAVING min(depth) > 0 UNION ALL SELECT id, min(depth), 'down' FROM down GROUP BY id HAVING min(depth) > 0 UNION ALL SELECT 3, 0, 'self'""")
def _(t: Tables) -> DataFrame:
    return graph.hierarchy(t.edges.filter("weight >= 0.8"), 3).select("id", "depth", "direction")


CYCLES = """WITH RECURSIVE x AS (SELECT DISTINCT src, dst FROM @edges WHERE edge_type = 'IMPORTS' AND weight >= 0.8 AND src <> dst),
    w AS (SELECT src AS s, dst AS at, [src, dst] AS walk FROM x WHERE src < dst UNION ALL SELECT w.s, x.dst, list_append(w.walk, x.dst) FROM w JOIN x ON x.src = w.at WHERE x.dst > w.s AND NOT list_contains(w.walk, x.dst) AND len(w.walk) < 4)"""


@query("j15_import_cycles", CYCLES + " SELECT array_to_string(walk, '>') AS cycle, len(walk) AS length FROM w JOIN x ON x.src = w.at AND x.dst = w.s WHERE len(walk) >= 3")
def _(t: Tables) -> DataFrame:
    found = graph.cycles(t.edges.filter("edge_type = 'IMPORTS' AND weight >= 0.8"), 3, 4, None)
    return found.select(F.array_join(F.col("cycle").cast("array<string>"), ">").alias("cycle"), F.col("length").cast("long").alias("length"))


@query("j16_cycle_edges", """WITH RECURSIVE i AS (SELECT DISTINCT src, dst FROM @edges WHERE edge_type = 'IMPORTS'), r AS (SELECT src, dst FROM i UNION SELECT r.src, i.dst FROM r JOIN i ON r.dst = i.src)
    SELECT i.src, i.dst FROM i JOIN r ON r.src = i.dst AND r.dst = i.src""")
def _(t: Tables) -> DataFrame:
    """Imports of every weight that lie on a cycle of any length, one module included."""
    return graph.cycle_edges(graph.of_type(t.edges, "IMPORTS")).select("src", "dst")


@query("j15_all_import_cycles")
def _(t: Tables) -> DataFrame:
    """All of length 3 to 10 on imports of every weight; the SQL of j15_import_cycles ends at 4 and at weight 0.8."""
    found = graph.cycles(graph.in_cycles(graph.of_type(t.edges, "IMPORTS")), 3, 10, None)
    return found.select(F.array_join(F.col("cycle").cast("array<string>"), ">").alias("cycle"), F.col("length").cast("long").alias("length"))


@query("j17_impact", """WITH RECURSIVE x AS (SELECT DISTINCT src, dst FROM @edges WHERE edge_type = 'CALLS'), r AS (SELECT CAST(10 AS BIGINT) AS id, 0 AS depth UNION SELECT x.src, r.depth + 1 FROM r JOIN x ON x.dst = r.id WHERE r.depth < 3), d AS (SELECT id, min(depth) AS depth FROM r GROUP BY id)
    SELECT direct, indirect, dependencies, CASE WHEN direct + indirect > 20 THEN 'high' WHEN direct + indirect > 5 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT count(*) FILTER (WHERE depth = 1) AS direct, count(*) FILTER (WHERE depth > 1) AS indirect FROM d), (SELECT count(DISTINCT dst) AS dependencies FROM x WHERE src = 10 AND dst <> 10)""")
def _(t: Tables) -> DataFrame:
    return graph.impact(t.edges.filter("edge_type = 'CALLS'"), 10)


@query("j18_chain", "SELECT id, turn AS position FROM @items WHERE session = 3")
def _(t: Tables) -> DataFrame:
    items = t.items.filter("session = 3")
    return graph.chain(graph.build_chain(items, ["turn"], partition=["session"]), 3000, "NEXT", 100)


@query("w07_build_chain", "SELECT src, dst, edge_type FROM (SELECT id AS src, lead(id) OVER (PARTITION BY session ORDER BY turn) AS dst, 'NEXT' AS edge_type FROM @items WHERE turn <> 1) WHERE dst IS NOT NULL UNION ALL SELECT dst, src, 'PREV' FROM (SELECT id AS src, lead(id) OVER (PARTITION BY session ORDER BY turn) AS dst FROM @items WHERE turn <> 1) WHERE dst IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return graph.build_chain(t.items.filter("turn <> 1"), ["turn"], partition=["session"]).select("src", "dst", "edge_type")


@query("j34_deep_calls", """WITH RECURSIVE x AS (SELECT DISTINCT src, dst FROM @edges WHERE edge_type = 'CALLS'), r AS (SELECT src, dst AS id, 1 AS depth FROM x WHERE src IN (SELECT id FROM @functions WHERE complexity > 10) UNION SELECT r.src, x.dst, r.depth + 1 FROM r JOIN x ON x.src = r.id WHERE r.depth < 4), d AS (SELECT src, id, min(depth) AS depth FROM r GROUP BY src, id)
    SELECT d.src, d.id, d.depth FROM d WHERE d.depth BETWEEN 2 AND 4 AND d.id IN (SELECT id FROM @functions) ORDER BY d.depth DESC, d.src, d.id LIMIT 50""")
def _(t: Tables) -> DataFrame:
    starts = t.functions.filter("complexity > 10").select("id")
    return graph.first_reached(t.edges.filter("edge_type = 'CALLS'"), starts, t.functions, 2, 4, 50)


@query("j24_create_edges", "SELECT DISTINCT e.src, e.dst, e.edge_type FROM @edges e WHERE e.src IN (SELECT id FROM @nodes) AND e.dst IN (SELECT id FROM @nodes)")
def _(t: Tables) -> DataFrame:
    return graph.create_edges(t.edges.withColumn("edge_type", F.lower("edge_type")), t.nodes).select("src", "dst", "edge_type")


@query("j25_contradicting_pairs", """WITH v AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM @vectors a JOIN @vectors b ON a.id < b.id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.3)
    SELECT v.a, v.b, round(v.s, 5) AS similarity FROM v JOIN @nodes x ON x.id = v.a JOIN @nodes y ON y.id = v.b WHERE contains(x.content, ' is not ') OR contains(y.content, ' is not ')""")
def _(t: Tables) -> DataFrame:
    near = ranking.similar_pairs(t.vectors, 0.3)
    text = lambda k, c: t.nodes.select(F.col("id").alias(k), F.col("content").alias(c))
    return near.join(text("a", "x"), "a").join(text("b", "y"), "b").filter(T.contradicts(F.col("x"), F.col("y"))).select("a", "b", F.round("similarity", 5).alias("similarity"))


@query("j26_near_duplicates", "SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS similarity FROM @vectors a JOIN @vectors b ON a.id < b.id AND a.label = b.label WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.3")
def _(t: Tables) -> DataFrame:
    return ranking.similar_pairs(t.vectors, 0.3, within="label").select("a", "b", F.round("similarity", 5).alias("similarity"))


@query("j27_similar_edges", """WITH p AS (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 7) DESC, b.id) AS n FROM @vectors a JOIN @vectors b ON a.id <> b.id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.3)
    SELECT src, dst, 0.7e0 AS weight FROM p WHERE n <= 5""")
def _(t: Tables) -> DataFrame:
    return blocks.nearest(t.vectors.filter("embedding IS NOT NULL"), "id", "embedding", 0.3, 5).withColumn("weight", F.lit(0.7))


@query("j29_strategy", "SELECT dst AS id, count(DISTINCT src) AS n FROM @edges WHERE edge_type = 'IMPLEMENTS' GROUP BY dst HAVING count(DISTINCT src) >= 2")
def _(t: Tables) -> DataFrame:
    rels = t.edges.withColumnRenamed("edge_type", "rel_type")
    entities = t.functions.select("id", "name", "file_path", "line", F.lit("Interface").alias("entity_type"))
    n = t.edges.filter("edge_type = 'IMPLEMENTS'").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n"))
    return code.strategy(entities, rels).select(F.col("entities")[0].cast("long").alias("id")).join(n, "id")


@query("j30_factory", "SELECT DISTINCT f.id FROM @functions f JOIN @edges e ON e.src = f.id WHERE f.id % 3 = 0 AND e.edge_type = 'CALLS' AND e.dst IN (SELECT id FROM @classes)")
def _(t: Tables) -> DataFrame:
    made = t.functions.select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("create "), "name")).otherwise(F.col("name")).alias("name"), "file_path", "line", F.lit("Function").alias("entity_type"))
    classes = t.classes.select("id", "name", F.lit("src/x.ts").alias("file_path"), F.lit(0).alias("line"), F.lit("Class").alias("entity_type"))
    return code.factory(made.unionByName(classes), t.edges.withColumnRenamed("edge_type", "rel_type")).select(F.col("entities")[0].cast("long").alias("id"))


@query("j31_dead_code", "SELECT f.id FROM @functions f WHERE visibility <> 'private' AND id % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM @edges e WHERE e.edge_type = 'CALLS' AND e.dst = f.id) AND NOT EXISTS (SELECT 1 FROM @functions g WHERE g.id % 10 = 0 AND g.file_path = f.file_path AND g.name = f.name)")
def _(t: Tables) -> DataFrame:
    f = t.functions.select("id", "name", "file_path", "line", "visibility")
    rows = f.filter("id % 10 <> 0").withColumn("entity_type", F.lit("Function")).unionByName(f.filter("id % 10 = 0").withColumn("entity_type", F.lit("Export")))
    return code.dead_code(rows, t.edges.withColumnRenamed("edge_type", "rel_type")).select(F.col("entities")[0].cast("long").alias("id"))


@query("j32_finding_entities", "SELECT normal AS finding, id AS entity FROM (SELECT *, regexp_replace(lower(signature), '[^a-z0-9]', '', 'g') AS normal FROM @functions) WHERE normal IN (SELECT regexp_replace(lower(signature), '[^a-z0-9]', '', 'g') FROM @functions GROUP BY 1 HAVING count(DISTINCT file_path) > 1)")
def _(t: Tables) -> DataFrame:
    rows = t.functions.select("id", "name", "file_path", "line", "signature", F.lit("Function").alias("entity_type"))
    found = code.duplicate_code(rows, t.edges).select(F.explode("entities").alias("e"))
    return found.join(rows.select(F.col("id").cast("string").alias("e"), "id", "signature"), "e").select(T.normal_signature(F.col("signature")).alias("finding"), F.col("id").alias("entity"))


@query("j33_lookups", "SELECT m.segment, i.severity, count(*) AS n FROM @issues i JOIN @modules m ON m.id = i.owner GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return t.issues.join(t.modules.select(F.col("id").alias("owner"), "segment"), "owner").groupBy("segment", "severity").agg(F.count("*").alias("n"))


@query("j19_resolve_modules", "SELECT id, CASE WHEN id % 2 = 0 THEN concat('src/brand_', 1 + id % 25, '.ts') END AS module FROM @functions WHERE id % 2 = 1 OR concat('src/brand_', 1 + id % 25, '.ts') IN (SELECT file_path FROM @functions)")
def _(t: Tables) -> DataFrame:
    target = F.concat(F.when(F.col("id") % 2 == 0, F.lit("./brand_")).otherwise("pkg_"), 1 + F.col("id") % 25)
    imports = t.functions.select("id", "file_path", target.alias("spec"))
    out = code.resolve_modules(imports, t.functions.select(F.col("file_path").alias("path")))
    return out.filter("id % 2 = 1 OR module IS NOT NULL").select("id", "module")


EXPORTS = "(SELECT file_path, name, min(id) AS entity_id FROM @functions GROUP BY file_path, name)"


def exports(t: Tables) -> DataFrame:
    return t.functions.groupBy("file_path", "name").agg(F.min("id").alias("entity_id")).withColumn("is_default", F.lit(False))


def imported(t: Tables) -> DataFrame:
    return t.functions.select("id", "file_path", F.concat(F.lit("src/brand_"), 1 + F.col("id") % 25, F.lit(".ts")).alias("module"), F.col("name").alias("imported"), F.col("name").alias("local"))


@query("j20_resolve_imports", f"SELECT f.id, x.entity_id FROM @functions f LEFT JOIN {EXPORTS} x ON x.file_path = concat('src/brand_', 1 + f.id % 25, '.ts') AND x.name = f.name")
def _(t: Tables) -> DataFrame:
    return code.resolve_imports(imported(t), exports(t)).select("id", "entity_id")


@query("j20_file_dependencies", "SELECT DISTINCT file_path AS src, concat('src/brand_', 1 + id % 25, '.ts') AS dst FROM @functions WHERE file_path <> concat('src/brand_', 1 + id % 25, '.ts')")
def _(t: Tables) -> DataFrame:
    return code.file_dependencies(imported(t)).select("src", "dst")


@query("j21_resolve_calls", f"SELECT f.id, m.entity_id FROM @functions f LEFT JOIN (SELECT f2.file_path, f2.name, min_by(x.entity_id, f2.id) AS entity_id FROM @functions f2 JOIN {EXPORTS} x ON x.file_path = concat('src/brand_', 1 + f2.id % 25, '.ts') AND x.name = f2.name WHERE f2.id = (SELECT min(f3.id) FROM @functions f3 WHERE f3.file_path = f2.file_path AND f3.name = f2.name) GROUP BY 1, 2) m ON m.file_path = f.file_path AND m.name = f.name")
def _(t: Tables) -> DataFrame:
    first = t.functions.groupBy("file_path", "name").agg(F.min("id").alias("id"))
    imports = code.resolve_imports(imported(t).join(first.select("id"), "id", "left_semi"), exports(t))
    calls = t.functions.select("id", "file_path", F.col("name").alias("callee"))
    return code.resolve_calls(calls, imports, exports(t)).select("id", "entity_id")


@query("j23_symbol_lookup", "SELECT f.id, coalesce((SELECT min(g.id) FROM @functions g WHERE g.file_path = 'src/brand_3.ts' AND g.name = f.name), (SELECT min(g.id) FROM @functions g WHERE g.name = f.name)) AS entity_id FROM @functions f")
def _(t: Tables) -> DataFrame:
    uses = t.functions.select("id", F.lit("src/brand_3.ts").alias("file_path"), "name")
    return code.lookup(uses, t.functions).select("id", "entity_id")


@query("j35_placeholders", "SELECT DISTINCT concat('external:', name) AS id, 'External' AS entity_type FROM @functions")
def _(t: Tables) -> DataFrame:
    return code.placeholders(t.functions.select("name")).select("id", "entity_type")
