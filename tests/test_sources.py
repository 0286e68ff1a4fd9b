"""Reading, writing and parsing of files."""

import json

from pyspark.sql import functions as F

from quillgraph.operators import code
from quillgraph.sources import config, corpus, logs, parse


def test_markdown_corpus(spark, tmp_path):
    root = tmp_path / "kb"
    (root / "active").mkdir(parents=True)
    (root / "active/a.md").write_text("---\ntitle: A thing\ncategory: legacy\n---\n# Head\nbody", encoding="utf-8")
    (root / "b.md").write_text("plain", encoding="utf-8")
    (root / "c.txt").write_text("no", encoding="utf-8")
    docs = corpus.read_markdown(spark, str(root))
    rows = {r["path"]: r for r in docs.collect()}
    assert set(rows) == {"active/a.md", "b.md"}
    assert rows["active/a.md"]["content"] == "# Head\nbody" and rows["active/a.md"]["category"] == "legacy" and json.loads(rows["active/a.md"]["metadata"])["title"] == "A thing"
    assert rows["b.md"]["category"] == "general" and rows["b.md"]["size"] == 5
    nodes = corpus.migrate(docs)
    assert nodes.filter("node_type = 'document'").count() == 2 and nodes.filter("node_type = 'concept'").count() == 1


def test_snapshots_and_versions(spark, tmp_path):
    docs = spark.createDataFrame([("a.md", "x"), ("b.md", "y")], "path string, content string")
    corpus.write_snapshot(docs, f"{tmp_path}/s")
    back = corpus.read_snapshot(spark, f"{tmp_path}/s", schema="path string, content string")
    assert sorted(back.collect()) == sorted(docs.collect())
    assert corpus.switch(spark, docs, f"{tmp_path}/p").count() == 2
    corpus.new_version(docs, f"{tmp_path}/v", 1, docs.limit(1))
    assert spark.read.parquet(f"{tmp_path}/v/version=1").count() == 2
    now = F.lit("2024-01-01").cast("timestamp")
    after = corpus.put(docs, spark.createDataFrame([("a.md", "new"), ("c.md", "z")], "path string, content string"), now)
    assert {r["path"]: r["content"] for r in after.collect()} == {"a.md": "new", "b.md": "y", "c.md": "z"}
    assert corpus.remove(after, docs.filter("path = 'b.md'")).count() == 2 and corpus.markdown_only(docs).count() == 2 and corpus.read_one(docs, "a.md").count() == 1


def test_audit_log_skips_malformed_lines(spark, tmp_path):
    line = json.dumps({"event_id": "1", "timestamp": "2024-01-01T00:00:00Z", "event_type": "auth", "pii_fields": ["a"], "metadata": {"integrity_hash": "h"}})
    (tmp_path / "a.jsonl").write_text(line + "\n{broken\n" + line.replace('"1"', '"2"') + "\n")
    events = logs.read_audit(spark, str(tmp_path / "a.jsonl"))
    assert sorted(r["event_id"] for r in events.collect()) == ["1", "2"]
    logs.append_audit(events, f"{tmp_path}/out")
    logs.append_audit(events, f"{tmp_path}/out")
    assert logs.read_audit(spark, f"{tmp_path}/out").count() == 4
    logs.write_csv(events.coalesce(1), f"{tmp_path}/csv")
    text = next((tmp_path / "csv").glob("*.csv")).read_text()
    assert text.replace('"', "").startswith("event_id,timestamp,event_type")
    assert logs.markdown_report("T", events.select("event_id").orderBy("event_id")).startswith("# T\n\n| event_id |")


def test_graph_exports(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "fact", "it's <x>")], "id string, node_type string, content string")
    edges = spark.createDataFrame([("a", "a", "KNOWS")], "src string, dst string, edge_type string")
    assert "CREATE (:Fact {id: 'a', content: 'it\\'s <x>'})" in {r["line"] for r in logs.graph_statements(nodes, edges).collect()}
    assert [r["line"][:6] for r in logs.graph_xml(nodes, edges).orderBy("part").collect()] == ["<graph", "<node ", "<edge ", "</grap"]
    logs.export_graph(nodes, edges, f"{tmp_path}/g")
    n, e = logs.import_graph(spark, f"{tmp_path}/g", "id string, node_type string, content string", "src string, dst string, edge_type string")
    assert n.collect() == nodes.collect() and e.count() == 1


def test_config_layers(tmp_path):
    (tmp_path / "c.json").write_text('{"storage": {"path": "x"}, "list": [1]}')
    got = config.load(str(tmp_path / "c.json"), {"QUILLGRAPH_STORAGE__TYPE": "graph", "QUILLGRAPH_SEARCH__LIMIT": "7"})
    assert got["storage"] == {"type": "graph", "path": "x"} and got["search"] == {"limit": 7, "threshold": 0.5} and got["list"] == [1]
    assert config.recommended(8, 1000) == {"workers": 6, "cache_mb": 400}


SCRIPT = """import def, { a as b, c } from './lib';
import * as ns from '../x';
/** Doc of K. */
export class K extends Base implements I, J<T> {
  private static one = 1;
  count: number = 0;
  constructor(private readonly lib: Base) { super(); this.go(1); }
  /** Goes. */
  static async go(x: number, f: (a: string, b: Map<string, X>) => void): Promise<void> {
    if (x > 1 && x < 5) { b(); } else if (x) { ns.run(x); }
    for (const i of [1]) { "if (x) {"; }
    // if (comment) {
  }
}
export const arrow = async (p: Base, q = 2) => { return new K(p); };
function inner(z) { return z ? 1 : 2; }
export interface Shape { area(): number; }
type Name = string;
const LIMIT: number = 5;
export { inner };
"""


def test_script_parser():
    found, calls, fault = parse.parse("src/k.ts", "typescript", SCRIPT)
    assert fault is None
    by = {(e["entity_type"], e["name"]): e for e in found}
    k, go = by["Class", "K"], by["Function", "go"]
    assert (k["extends"], k["implements"], k["documentation"], k["line"], k["end_line"]) == ("Base", ["I", "J"], "Doc of K.", 4, 14)
    assert (go["parent_class"], go["is_static"], go["is_async"], len(go["parameters"]), go["complexity"], go["documentation"]) == ("K", True, True, 2, 5, "Goes.")
    assert by["Function", "arrow"]["is_async"] and by["Function", "inner"]["complexity"] == 2 and by["Function", "arrow"]["parameters"] == ["p: Base", "q = 2"]
    assert {("Interface", "Shape"), ("Type", "Name"), ("Constant", "LIMIT"), ("Variable", "one"), ("Variable", "count"), ("Export", "K"), ("Export", "inner"), ("Import", "b"), ("Import", "ns"), ("Import", "def")} <= set(by)
    assert {(c[1], c[2]) for c in calls} >= {("CALLS", "b"), ("CALLS", "ns.run"), ("CALLS", "K"), ("CALLS", "go")}


def test_python_parser_and_faults():
    found, calls, fault = parse.parse("a.py", "python", "import os\nfrom .b import c as d\nclass A(B):\n    def f(self, x):\n        return d(x) if x and os.path else 0\nN = 1\n")
    by = {(e["entity_type"], e["name"]): e for e in found}
    assert by["Function", "f"]["parent_class"] == "A" and by["Function", "f"]["complexity"] == 3 and by["Class", "A"]["extends"] == "B" and by["Import", "d"]["signature"] == "c|d|.b" and ("Constant", "N") in by
    assert ("CALLS", "d") in {(c[1], c[2]) for c in calls}
    assert parse.parse("a.py", "python", "def (")[2].startswith("SyntaxError") and parse.parse("x.rb", "ruby", "x") == ([], [], None) and parse.parse("a.ts", "typescript", "class A {")[2] is None


def test_project_from_files_to_resolved_calls(spark, tmp_path):
    root = tmp_path / "proj"
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "src/lib.ts").write_text("export function run(x: number) { return x; }\nexport default function main() { }\n")
    (root / "src/use.ts").write_text("import start, { run } from './lib';\nimport * as lib from './lib';\nimport { z } from 'pkg';\nexport function go() { run(1); lib.main(); }\n")
    (root / "node_modules/x.ts").write_text("export function hidden() {}\n")
    files = corpus.read_sources(spark, str(root))
    assert {r["path"] for r in files.collect()} == {"src/lib.ts", "src/use.ts"}
    ents = parse.entities(files).persist()
    imports = code.resolve_modules(parse.imports(ents), files)
    exports = parse.exports(ents)
    resolved = code.resolve_imports(imports, exports)
    assert {(r["local"], (r["entity_id"] or "").split(":")[2] if r["entity_id"] else None) for r in resolved.collect()} == {("run", "run"), ("start", "main"), ("lib", None), ("z", None)}
    calls = parse.raw_relations(files).selectExpr("concat(src, name) AS id", "file_path", "name AS callee").distinct()
    got = {r["callee"]: r["entity_id"] for r in code.resolve_calls(calls, resolved, exports).collect()}
    assert got["run"].split(":")[2] == "run" and got["lib.main"].split(":")[2] == "main"
    assert [(r["src"], r["dst"]) for r in code.file_dependencies(imports).collect()] == [("src/use.ts", "src/lib.ts")]
    ents.unpersist()


def test_long_comments_and_titles_are_whole(spark):
    from quillgraph.plans import tools
    from quillgraph.sources import parse

    comment = "word " * 2000
    found, _ = parse.parse_script("a.ts", f"/** first */\nconst x = 1;\n/** {comment}*/\nfunction f(a) {{ return a }}\n")
    assert [e["documentation"] for e in found if e["name"] == "f"] == [comment.strip()]
    title = "t" * 700
    docs = spark.createDataFrame([("a.md", f"## high {title}\n### {title}\nbody\n")], "path string, content string")
    assert [(r["title"], r["severity"]) for r in tools.issue_list(docs).collect()] == [(title, "high")]


def test_what_is_forgotten_has_no_bound(spark):
    from quillgraph.operators import writes

    nodes = spark.createDataFrame([(10_000_010,), (10_000_011,)], "id long")
    edges = spark.createDataFrame([(10_000_010, 1), (1, 2)], "src long, dst long")
    kept, links = writes.forget(nodes, edges, nodes.filter("id % 10 = 0"))
    assert [r[0] for r in kept.collect()] == [10_000_011] and [tuple(r) for r in links.collect()] == [(1, 2)]
