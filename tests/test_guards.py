"""Guards, audit chains, permissions and ties: cases that must neither pass through nor depend on partitions."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import audit, code, graph, windows
from quillgraph.plans import intents, tools
from quillgraph.sources import parse

READS = ["SELECT 1 AS a", "WITH x AS (SELECT 1 AS a) SELECT * FROM x", "SELECT (SELECT max(id) FROM {d}) AS a", "FROM {d} SELECT id", "SHOW TABLES", "SELECT 'insert into x; drop table y' AS a", "SELECT id FROM {d};", "VALUES (1), (2)"]
WRITES = [
    "FROM {d} INSERT INTO victim SELECT id", "WITH x AS (SELECT 1 AS id) INSERT INTO victim SELECT id FROM x", "INSERT OVERWRITE victim SELECT 1", "CREATE TABLE v AS SELECT 1", "SET spark.sql.ansi.enabled=false", "CACHE TABLE victim", "USE default",
    "SELECT TRANSFORM(id) USING 'cat' FROM {d}", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT java_method('java.lang.System', 'getenv')", "ADD JAR 'x.jar'", "select 1; drop table x", "EXPLAIN SELECT 1", "DELETE FROM victim", "not sql",
    "FROM {d} INSERT INTO victim SELECT id INSERT INTO victim SELECT id + 1", "TRUNCATE TABLE victim", "ALTER TABLE victim RENAME TO v", "BEGIN INSERT INTO victim SELECT 1; END",
]


@pytest.fixture
def victim(spark):
    spark.sql("DROP TABLE IF EXISTS victim")
    spark.range(1).write.saveAsTable("victim")
    yield
    spark.sql("DROP TABLE IF EXISTS victim")


def test_only_reading_statements_pass(spark, victim):
    d = spark.range(3)
    for sql in READS:
        assert tools.query(spark, sql, **({"d": d} if "{d}" in sql else {})).count() >= 0, sql
    for sql in WRITES:
        with pytest.raises(PermissionError):
            tools.query(spark, sql, **({"d": d} if "{d}" in sql else {})).count()
    assert spark.table("victim").count() == 1


def test_untouched_events_verify_whatever_they_hold(spark):
    odd = ["plain", "bell \x07 escape \x1b", 'quote " and \\ slash /', "é 漢字 🎉", "line\nbreak\ttab", "<a&b>", " ", "", None]
    rows = [(2**60 + i, f"2024-01-0{i + 1}T00:00:00", "auth", t, t, "success", "log", None if i % 2 else 2**61 + i) for i, t in enumerate(odd)]
    events = spark.createDataFrame(rows, "event_id long, timestamp string, event_type string, action string, resource string, result string, log string, n long")
    chained = audit.build_chain(events, "log")
    assert chained.columns[-2:] == ["previous_hash", "integrity_hash"]
    assert audit.integrity(chained, "log").first()["invalid"] == 0
    assert {r["event_id"]: r["n"] for r in chained.collect()} == {r[0]: r[-1] for r in rows}
    touched = chained.withColumn("action", F.when(F.col("event_id") == 2**60 + 1, F.lit("other")).otherwise(F.col("action")))
    assert [r["event_id"] for r in audit.verify(touched, "log").filter("issue = 'content changed'").collect()] == [2**60 + 1]


@pytest.mark.parametrize("bound", [1000, 0])
def test_prefixes_are_one_meaning_however_many(spark, monkeypatch, bound):
    monkeypatch.setattr(audit, "PREDICATE", bound)
    rows = spark.createDataFrame([("a/b.md",), ("a/c/d.md",), ("ab.md",), ("",), (None,)], "path string")
    roles = spark.createDataFrame([("all", "*"), ("some", "a/*"), ("some", "a/c"), ("exact", "ab.md"), ("none", None)], "role string, prefix string")
    seen = lambda role: sorted(r["path"] for r in audit.authorised(rows, roles, role).collect())
    assert seen("all") == ["", "a/b.md", "a/c/d.md", "ab.md"] and seen("some") == ["a/b.md", "a/c/d.md"]
    assert seen("exact") == ["ab.md"] and seen("none") == [] and seen("other") == []


def test_many_prefixes(spark):
    rows = spark.createDataFrame([("a/b.md",), ("p77/x",)], "path string")
    roles = spark.range(1200).select(F.lit("r").alias("role"), F.concat(F.lit("p"), "id", F.lit("/")).alias("prefix"))
    assert [r["path"] for r in audit.authorised(rows, roles, "r").collect()] == ["p77/x"]
    assert audit.authorised(rows, roles.union(spark.createDataFrame([("r", "*")], roles.schema)), "r").count() == 2


def test_ties_do_not_depend_on_partitions(spark):
    nodes = spark.range(3)
    new = spark.createDataFrame([(0, 1, "calls", 0.2, "z"), (0, 1, "CALLS", 0.9, "a"), (0, 1, "Calls", 0.9, "b"), (1, 7, "calls", 1.0, "x")], "src long, dst long, edge_type string, weight double, note string")
    for n in (1, 4):
        assert [tuple(r) for r in graph.create_edges(new.repartition(n), nodes).select(*new.columns).collect()] == [(0, 1, "CALLS", 0.9, "b")]
    exports = spark.createDataFrame([("m.ts", "f", "e2", True), ("m.ts", "f", "e1", False), ("m.ts", "g", "e0", True)], "file_path string, name string, entity_id string, is_default boolean")
    imports = spark.createDataFrame([(1, "a.ts", "m.ts", "f"), (2, "a.ts", "m.ts", "default"), (3, "a.ts", "m.ts", "h")], "id long, file_path string, module string, imported string")
    for n in (1, 4):
        assert sorted((r["id"], r["entity_id"]) for r in code.resolve_imports(imports, exports.repartition(n)).collect()) == [(1, "e1"), (2, "e0"), (3, None)]


def test_entities_hold_their_whole_text():
    body = "function big() {\n" + "  work(1);\n" * 2000 + "  eval(input);\n}\n"
    found, _ = parse.parse_script("a.ts", body)
    big = next(e for e in found if e["name"] == "big")
    assert "eval(input)" in big["content"] and (big["line"], big["end_line"]) == (1, 2003)


def test_lines_are_found_in_little_time():
    body = "".join(f"function f{i}() {{ g{i}(); }}\n" for i in range(8000))
    start = time.process_time()
    found, raw = parse.parse_script("a.ts", body)
    assert time.process_time() - start < 10
    assert {e["name"]: e["line"] for e in found if e["entity_type"] == "Function"}["f7999"] == 8000 and raw[-1][-1] == 8000


def test_late_calls_are_held_against_their_own_window():
    held, ok = windows.admitted([], [0, 1, 2, 3], 3, 60)
    assert ok == [True, True, True, False]
    held, ok = windows.admitted(held, [70.0], 3, 60)
    assert ok == [True]
    held, ok = windows.admitted(held, [1.5, 61.5], 3, 60)  # late: two were accepted before it; then 2, 61.5's window holds 2 and 1.5 no more
    assert ok == [True, True] and held == [0, 1, 1.5, 2, 61.5, 70.0]


@pytest.fixture
def store(spark):
    t0 = dt.datetime(2024, 1, 1)
    docs = spark.createDataFrame([("a.md", "x", "general", 1, t0), ("b/c.md", "yy", "status", 2, t0)], "path string, content string, category string, size long, modified timestamp")
    nodes = spark.createDataFrame([(1, [1.0, 0.0], "Function"), (2, [1.0, 0.01], "fact"), (3, [1.0, 0.1], "Class"), (4, [0.0, 1.0], "Function")], "id long, embedding array<double>, node_type string")
    events = spark.createDataFrame([(i, f"2024-01-0{i}", "auth" if i % 2 else "error") for i in range(1, 6)], "event_id long, timestamp string, event_type string")
    return tools.Store(docs, nodes=nodes, audit=events)


def test_similar_code_is_code(store):
    assert [r["id"] for r in tools.run(store, "find_similar_code", 1).collect()] == [3]


def test_secured_tools(spark, store, tmp_path):
    call = lambda tool, *permissions, **o: tools.run_secured(store, set(permissions), tool, **o)
    assert call("kb_info").first().asDict() == {"documents": 2, "bytes": 3, "categories": 2, "modified": dt.datetime(2024, 1, 1)}
    assert call("kb_help").count() == 5 and call("kb_help", topic="search").count() == 1
    assert [r["event_id"] for r in call("kb_audit", "kb.admin", start="2024-01-02", event_type="auth").collect()] == [5, 3]
    assert call("kb_audit", "*", limit=2).count() == 2
    for tool in ("kb_audit", "kb_backup", "kb_read", "kb_delete"):
        with pytest.raises(PermissionError):
            call(tool, "kb.write")
    call("kb_backup", "kb.*", path=str(tmp_path / "backup"))
    assert (tmp_path / "backup").exists()
    with pytest.raises(KeyError):
        call("find_patterns", "*")


def test_debt_and_analysis_use_all_sources(spark):
    source = "import { b } from './b';\nexport class Big {\n" + "".join(f"  m{i}(a, b, c, d, e, f, g) {{ if (a) {{ return {i}; }} }}\n" for i in range(25)) + "}\n" + "function twin(x) { return x; }\n"
    files = spark.createDataFrame([("a.ts", "typescript", source), ("b.ts", "typescript", "import { Big } from './a';\nfunction twin(x) { return x; }\n")], "path string, language string, content string")
    entities = graph.keep(parse.entities(files))
    relations = spark.createDataFrame([("a.ts", "b.ts", "IMPORTS"), ("b.ts", "a.ts", "IMPORTS")], "src string, dst string, rel_type string")
    functions = spark.createDataFrame([(1, "f", "f(x)", 30, 40, "a.ts"), (2, "g", "g(y)", 3, 10, "b.ts")], "id long, name string, signature string, complexity int, line_count int, file_path string")
    s = tools.Store(spark.range(1), entities=entities, relations=relations, code=intents.Graph(functions=functions, classes=None, modules=None, edges=None))
    sources = {r["source"] for r in tools.debt_items(s).select("source").distinct().collect()}
    assert {"pattern", "complexity", "dependency"} <= sources
    assert tools.run(s, "suggest_refactoring").count() > 0 and tools.run(s, "track_technical_debt").count() > 0
    got = {(r["phase"], r["item"]): r["value"] for r in tools.run(s, "analyze_codebase").collect()}
    assert got["relations", "IMPORTS"] == 2 and got["patterns", "Circular Dependency"] >= 1 and got["entities", "Class"] == 1 and got["metrics", "functions"] >= 25
    assert {p for p, _ in got} >= {"entities", "relations", "patterns", "metrics", "debt"}


def test_chains_double_and_branches_fall_back(spark):
    rows = [(i, i + 1, "NEXT") for i in range(300)] + [(500, 501, "NEXT"), (501, 502, "NEXT"), (502, 500, "NEXT")]
    edges = spark.createDataFrame(rows, "src long, dst long, edge_type string")
    at = lambda e, start, n=1000: {r["id"]: r["position"] for r in graph.chain(e, start, max_length=n).collect()}
    assert at(edges, 0) == {i: i for i in range(301)} and at(edges, 290, 5) == {290 + i: i for i in range(6)}
    assert at(edges, 501) == {501: 0, 502: 1, 500: 2} and at(edges, 9999) == {9999: 0} and at(edges, 0, 1) == {0: 0, 1: 1}
    assert at(edges.unionByName(spark.createDataFrame([(298, 7000, "NEXT")], edges.schema)), 297) == {297: 0, 298: 1, 299: 2, 7000: 2, 300: 3}
