"""Hand-made rows for text, masking, rules, debt, graph and memory operators."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import security as S
from quillgraph.functions import text as T
from quillgraph.functions import vector as V
from quillgraph.operators import aggregates as A
from quillgraph.operators import audit, code, graph, ranking, search, windows, writes
from quillgraph.plans import graphs, intents, tools  # noqa: F401  graphs registers its queries
from quillgraph.plans.domain import Tables
from quillgraph.plans.registry import QUERIES


def one(spark, column, **values):
    row = tuple(values.values()) or (1,)
    schema = ", ".join(f"{n} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for n, v in values.items()) or "x int"
    return spark.createDataFrame([row], schema).select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Does it scale?", "question"), ("It failed because the disk was full", "insight"), ("2024-05-01 service started", "event"), ("Ada Lovelace", "entity"), ("The cache is warm", "fact"), ("warm cache", "concept"), ("x" * 201, "document"), ("", "concept"),
    ],
)
def test_node_kinds(spark, text, kind):
    assert one(spark, T.node_type(F.col("t")), t=text) == kind


def test_headings_title_summary(spark):
    text = "# Title\n\ntext one\n## Sub\ntext two\n\ntext three\ntext four"
    assert [tuple(h) for h in one(spark, T.headings(F.col("t")), t=text)] == [("Title", 1), ("Sub", 2)]
    assert one(spark, T.title(F.col("t")), t=text) == "Title" and one(spark, T.title(F.col("t")), t="") == "Untitled" and one(spark, T.title(F.col("t")), t="y" * 80) == "y" * 50
    assert one(spark, T.summary(F.col("t")), t=text) == "text one text two text three" and one(spark, T.summary(F.col("t")), t="z" * 300) == "z" * 200 + "..."


def test_sentences_events_entities(spark):
    assert one(spark, T.sentences(F.col("t")), t="# Head\n**Bold** text is here. Short. `code` and [a link](http://x) too!") == ["Head Bold text is here", "code and a link too"]
    assert [(e[0], str(e[1])) for e in one(spark, T.events(F.col("t")), t="2024-05-01 service started\nno date started\n2024/06/02 it Ended\n2024-01-01 nothing")] == [("2024-05-01 service started", "2024-05-01"), ("2024/06/02 it Ended", "2024-06-02")]
    found = {tuple(e) for e in one(spark, T.entities(F.col("t")), t="Ada Lovelace met NASA in 2024-05-01 about 1.2.3")}
    assert {("Ada Lovelace", "person"), ("NASA", "acronym"), ("2024-05-01", "date"), ("1.2.3", "version")} <= found


def test_snippet(spark):
    text = "a" * 100 + "needle" + "b" * 294
    s = one(spark, T.snippet(F.col("t"), "NEEDLE"), t=text)
    assert s.startswith("...") and s.endswith("...") and "needle" in s and len(s) == 206 + 6
    assert one(spark, T.snippet(F.col("t"), "absent"), t=text) == text[:200]


@pytest.mark.parametrize(("a", "b", "want"), [("The cache is warm", "The cache is not warm", True), ("They can swim", "They cannot swim", True), ("A is b", "C was d", False)])
def test_contradiction(spark, a, b, want):
    assert one(spark, T.contradicts(F.col("a"), F.col("b")), a=a, b=b) is want


@pytest.mark.parametrize(
    ("text", "last", "want"),
    [("1234567890", 4, "******7890"), ("john.doe@example.com", 4, "****************.com"), ("555-123-4567", 4, "********4567"), ("short", 4, "*hort"), ("", 4, ""), ("123", 4, "***"), ("12345", 0, "*****")],
)
def test_mask(spark, text, last, want):
    assert one(spark, S.mask(F.col("t"), last), t=text) == want


@pytest.mark.parametrize(
    ("ip", "want"),
    [("192.168.1.100", "192.168.1.0"), ("8.8.8.8", "8.8.8.0"), ("2001:0db8:85a3:0000:0000:8a2e:0370:7334", "2001:db8:85a3:0::"), ("fe80::1ff:fe23:4567:890a", "fe80:0:0:0::"), ("not-an-ip", "anonymous"), ("", "anonymous"), ("999.999.999.999", "anonymous"), ("::1", "0:0:0:0::")],
)
def test_anonymous_ip(spark, ip, want):
    # fe80::1ff:... has four groups after the gap, so the first four are fe80 and three zeros
    assert one(spark, S.anonymous_ip(F.col("t")), t=ip) == want


@pytest.mark.parametrize("path", ["../../../etc/passwd", "docs/../../../etc/passwd", "~/root/.ssh/id_rsa", "/etc/passwd", "\\\\server\\share\\file", "docs%2F..%2Fetc", "docs/a\x00.md", "docs/<script>alert(1)</script>.md", "a" * 256 + ".md", "docs/file.txt", "docs/file", "malicious.md.exe", ""])
def test_refused_paths(spark, path):
    assert one(spark, S.path_fault(F.col("t")), t=path) is not None


@pytest.mark.parametrize("path", ["docs/guide.md", "notes/2024-01-15-meeting.md", "deeply/nested/path/to/file.markdown", "file_with_underscore.md"])
def test_accepted_paths(spark, path):
    assert one(spark, S.path_fault(F.col("t")), t=path) is None


@pytest.mark.parametrize(("name", "want"), [("file<script>.md", "file_script_.md"), ("file/with/slash.md", "file_with_slash.md"), ("file|with|pipe.md", "file_with_pipe.md")])
def test_safe_names(spark, name, want):
    assert one(spark, S.safe_filename(F.col("t")), t=name) == want


def test_content_and_tags(spark):
    assert one(spark, S.content_fault(F.col("t")), t="x <SCRIPT src=1>") == "malicious pattern" and one(spark, S.content_fault(F.col("t")), t="fine") is None
    assert one(spark, S.strip_tags(F.col("t")), t="<p>a<script>b</script>c</p>") == "ac"


def test_encryption_round_trip(spark):
    key = S.derive_key("k", b"s", 1000)
    assert one(spark, S.decrypt(S.encrypt(F.col("t"), key), key), t="secret é") == "secret é"
    assert one(spark, S.decrypt(S.encrypt(F.col("t"), key), S.derive_key("j", b"s", 1000)), t="secret") is None


def test_small_functions(spark):
    assert one(spark, T.relative_path(F.lit("src/a/b.ts"), F.lit("../c/./d"))) == "src/c/d"
    assert one(spark, T.duration_seconds(F.lit("15m"))) == 900 and one(spark, T.duration_seconds(F.lit("x"))) is None
    assert one(spark, T.hash36(F.lit("abc"))) == "22ci" and one(spark, T.hash36(F.lit("The quick brown fox jumps"))) == hash36("The quick brown fox jumps")
    assert one(spark, T.byte_size(F.lit(1536))) == "1.5 KB" and one(spark, T.is_iso8601(F.lit("2024-01-01T00:00:00Z")))
    assert one(spark, T.csv_field(F.lit('a"b,c'))) == '"a""b,c"' and one(spark, T.category(F.lit("docs/Active/x.md"))) == "active" and one(spark, T.language(F.lit("a/b.TSX"))) == "typescript"
    assert abs(one(spark, V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) - 0.5**0.5) < 1e-12
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0 and one(spark, V.euclid(F.array(F.lit(0.0)), F.array(F.lit(3.0)))) == 0.25


def hash36(text):
    h = 0
    for c in text:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    h = abs(h - (1 << 32) if h >= 1 << 31 else h)
    out = ""
    while h:
        h, d = divmod(h, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out or "0"


# ---------------------------------------------------------------- search


def test_line_search_clips_context(spark):
    docs = spark.createDataFrame([("a.md", "hit one\nb\nc\nd\nlast HIT")], "path string, content string")
    rows = search.search_lines(docs, "hit").orderBy("line").collect()
    assert [(r["line"], r["context"]) for r in rows] == [(1, "hit one\nb\nc"), (5, "c\nd\nlast HIT")]
    assert search.search_lines(docs, "hit", max_hits=1, line_width=3).collect()[0]["content"] == "hit"


def test_fuzzy_score_and_directory(spark):
    docs = spark.createDataFrame([("d/a.md", "alpha beta", "general"), ("e/b.md", "alpha", "general")], "path string, content string, category string")
    rows = search.search_documents(docs, "alpha beta gamma", fuzzy=True).collect()
    assert [(r["path"], r["score"]) for r in rows] == [("d/a.md", 2), ("e/b.md", 1)]
    assert search.search_documents(docs, "alpha", directory="e").count() == 1


# ---------------------------------------------------------------- graph


@pytest.fixture(scope="module")
def chain(spark):
    return spark.createDataFrame([("a", "b", "IMPORTS", 0.9), ("b", "c", "IMPORTS", 0.8), ("c", "d", "IMPORTS", 1.0), ("c", "a", "IMPORTS", 0.5)], "src string, dst string, edge_type string, weight double")


def test_paths_and_distances(spark, chain):
    best = {r["id"]: round(r["confidence"], 6) for r in graph.paths(chain, "a", 3, directed=True).collect()}
    assert best == {"b": 0.9, "c": 0.72, "d": 0.72}
    assert graph.shortest_path(chain, "a", "d") == ["a", "c", "d"] and graph.shortest_path(chain, "a", "d", directed=True) == ["a", "b", "c", "d"]
    assert graph.shortest_path(chain, "a", "zz") == [] and graph.shortest_path(chain, "a", "a") == ["a"]


def test_cycles_once_each(spark, chain):
    assert [(r["cycle"], r["length"]) for r in graph.cycles(chain, 3, 5).collect()] == [(["a", "b", "c"], 3)]
    assert {(r["src"], r["dst"]) for r in graph.in_cycles(chain).collect()} == {("a", "b"), ("b", "c"), ("c", "a")}


def test_long_cycles(spark):
    ring = [(i, (i + 1) % 12) for i in range(12)]
    edges = spark.createDataFrame([*ring, (5, 0), (20, 21), (21, 20), (3, 20), (30, 30), (40, 41)], "src long, dst long")
    assert {(r["src"], r["dst"]) for r in graph.cycle_edges(edges).collect()} == {*ring, (5, 0), (20, 21), (21, 20), (30, 30)}
    assert sorted(r["length"] for r in graph.cycles(edges, 2, 12, None).collect()) == [2, 6, 12]
    assert [r["length"] for r in graph.cycles(edges, 2, 12, 2).collect()] == [2, 6]
    assert graph.cycle_edges(edges.filter("src >= 40")).count() == 0


def test_import_cycles_are_whole(spark, small):
    """Against a search by hand over all imports of the table."""
    t = Tables(spark, small)
    edges = {(r["src"], r["dst"]) for r in graph.of_type(t.edges, "IMPORTS").select("src", "dst").collect()}
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    want, stack = [], [(a, (a,)) for a in out]
    while stack:
        at, walk = stack.pop()
        for b in out.get(at, ()):
            if b == walk[0] and len(walk) >= 3:
                want.append(">".join(map(str, walk)))
            if b > walk[0] and b not in walk and len(walk) < 7:
                stack.append((b, (*walk, b)))
    rows = QUERIES["j15_all_import_cycles"](spark, small).cache()
    assert sorted(r["cycle"] for r in rows.filter("length <= 7").collect()) == sorted(want)
    assert rows.agg(F.max("length")).first()[0] == 10

    def reached(a):
        seen, todo = set(), [a]
        while todo:
            new = out.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        return seen

    got = {(r["src"], r["dst"]) for r in QUERIES["j16_cycle_edges"](spark, small).collect()}
    assert got == {(a, b) for a, b in edges if a in reached(b) or a == b}


def test_ring(spark):
    nodes, edges = graph.ring(spark, 30)
    assert [r["length"] for r in graph.cycles(edges, 3, 30, None).collect()] == [30] if False else graph.in_cycles(edges).count() == 30
    assert graph.distances(edges, spark.range(1), 40).agg(F.max("depth")).first()[0] == 10 + 5 and nodes.count() == 30


def test_create_edges_needs_both_ends(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    new = spark.createDataFrame([(1, 2, "calls", True), (1, 9, "calls", False), (1, 2, "CALLS", False)], "src long, dst long, edge_type string, bidirectional boolean")
    assert sorted((r["src"], r["dst"], r["edge_type"]) for r in graph.create_edges(new, nodes).collect()) == [(1, 2, "CALLS"), (2, 1, "CALLS")]


def test_resolution_symmetric_and_not(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9, 0.5, 10, 20), (1, 2, 0.5, 0.5, 10, 20), (1, 2, 0.5, 0.5, 20, 10)], "a long, b long, a_confidence double, b_confidence double, a_created_s long, b_created_s long")
    assert [r["keep"] for r in graph.resolve_contradictions(pairs).collect()] == [1, 2, 1] and [r["keep"] for r in graph.resolve_contradictions(pairs, symmetric=False).collect()] == [1, None, 1]


# ---------------------------------------------------------------- memory


def test_state_changes(spark):
    n = spark.createDataFrame([(1, 0.5, 1.0, 100), (2, 0.1, 1.0, 100), (3, 0.95, 1.0, 900)], "id long, importance double, confidence double, created_s long")
    got = {r["id"]: (round(r["importance"], 6), round(r["confidence"], 6)) for r in writes.decay_old(n, F.lit(500)).collect()}
    assert got == {1: (0.45, 0.95), 2: (0.1, 1.0), 3: (0.95, 1.0)}
    up = writes.reinforce(n, spark.createDataFrame([(3,), (3,)], "id long")).collect()
    assert {r["id"]: round(r["importance"], 6) for r in up} == {1: 0.5, 2: 0.1, 3: 1.0}
    items = spark.createDataFrame([(1, "s", 0.7, False), (2, "s", 0.8, False), (3, "s", 0.5, True), (4, "t", 0.5, True)], "id long, session string, priority double, focused boolean")
    assert {r["id"]: (r["priority"], r["focused"]) for r in writes.focus(items, "s", [1, 2]).collect()} == {1: (0.9, True), 2: (1.0, True), 3: (0.5, False), 4: (0.5, True)}


def test_eviction_and_attention(spark):
    items = spark.range(20).selectExpr("id", "'s' AS session", "id / 20 AS importance", "id = 0 AS focused", "0.5 AS priority")
    assert {r["id"] for r in windows.evict(items).filter("evicted").collect()} == {1, 2, 3, 4}
    assert abs(windows.attention(items).agg(F.sum("attention")).first()[0] - 1) < 1e-9
    assert windows.evict(items.filter("id < 19")).filter("evicted").count() == 0


@pytest.mark.parametrize("preset", [(3, 100, 1000), (5, 300, 900)])
def test_limiters_match_a_plain_loop(spark, preset):
    calls = [(u, i, float((i * 37 + u * 11) % 4000)) for u in range(3) for i in range(120)]
    df = spark.createDataFrame(calls, "u long, i long, t double")
    got = {(r["u"], r["i"]): r["allowed"] for r in windows.block_limiter(df, "u", ("t", "i"), preset).collect()}
    points, duration, block = preset
    for u in range(3):
        start, used, until = None, 0, -1.0
        for _, i, t in sorted((c for c in calls if c[0] == u), key=lambda c: (c[2], c[1])):
            if t < until:
                ok = False
            else:
                if start is None or t >= start + duration:
                    start, used = t, 0
                used += 1
                ok = used <= points
                if not ok:
                    start, until = None, t + block
            assert got[u, i] is ok
    got = {(r["u"], r["i"]): r["allowed"] for r in windows.sliding_limiter(df, "u", ("t", "i"), 3, 200).collect()}
    for u in range(3):
        kept = []
        for _, i, t in sorted((c for c in calls if c[0] == u), key=lambda c: (c[2], c[1])):
            ok = sum(k > t - 200 for k in kept) < 3
            kept += [t] * ok
            assert got[u, i] is ok


# ---------------------------------------------------------------- audit

EVENTS = [("1", "t1", "auth", "login", "a", "success"), ("2", "t2", "auth", "login", "a", "failure"), ("3", "t3", "data_access", "read", "b", "success"), ("4", "t4", "data_access", "write", "b", "success"), ("5", "t5", "error", "process", "c", "error")]


def test_audit_chain(spark):
    e = spark.createDataFrame([(*r, "u", "low", "L") for r in EVENTS], "event_id string, timestamp string, event_type string, action string, resource string, result string, user_id string, severity string, log string")
    assert audit.matching(e, event_type="auth").count() == 2 and ranking.page(e, "timestamp", False, 1, 2).count() == 2 and audit.matching(e, result="error", severity="low").count() == 1
    c = audit.build_chain(e, "log")
    rows = c.orderBy("timestamp").collect()
    assert rows[0]["previous_hash"] == "0" and all(len(r["integrity_hash"]) == 64 for r in rows) and rows[1]["previous_hash"] == rows[0]["integrity_hash"]
    assert audit.integrity(c, "log").first()["invalid"] == 0
    changed = c.withColumn("action", F.when(F.col("event_id") == "3", "x").otherwise(F.col("action")))
    assert audit.integrity(changed, "log").first()["invalid"] == 1
    assert audit.integrity(c.filter("event_id <> '3'"), "log").first()["invalid"] == 1


def test_permissions(spark):
    roles = spark.createDataFrame([("admin", ["kb.*"]), ("viewer", ["kb.read"])], "role string, permissions array<string>")
    users = spark.createDataFrame([("a", "admin"), ("b", "viewer"), ("c", "none")], "user_id string, role string")
    assert {r["user_id"]: r["allowed"] for r in audit.permitted(users, roles, "kb.write").collect()} == {"a": True, "b": False, "c": False}


def test_personal_fields(spark):
    e = spark.createDataFrame([("1", "1.2.3.4", None), ("2", None, None)], "event_id string, ip_address string, user_agent string")
    rows = {r["event_id"]: r for r in audit.without_personal(e, S.derive_key("k", b"s", 10)).collect()}
    assert rows["1"]["pii_fields"] == ["ip_address"] and rows["1"]["pii"] and rows["1"]["ip_address"] is None and rows["2"]["pii"] is None


# ---------------------------------------------------------------- code


def fn(i, **k):
    base = {"id": f"f{i}", "entity_type": "Function", "name": f"n{i}", "file_path": "a.ts", "line": 1, "line_count": 10, "complexity": 1, "visibility": "public", "is_static": False, "parameters": [], "parent_class": None, "implements": [], "signature": f"n{i}()"}
    return base | k


SCHEMA = "id string, entity_type string, name string, file_path string, line int, line_count int, complexity int, visibility string, is_static boolean, parameters array<string>, parent_class string, implements array<string>, signature string"


def entities(spark, rows):
    names = [p.split()[0] for p in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def rels(spark, rows=()):
    return spark.createDataFrame(list(rows), "src string, dst string, rel_type string")


@pytest.mark.parametrize(("lines", "complexity", "want"), [(100, 15, []), (101, 1, ["medium"]), (1, 16, ["medium"]), (201, 1, ["high"]), (1, 26, ["high"]), (200, 25, ["medium"])])
def test_long_method(spark, lines, complexity, want):
    got = code.long_method(entities(spark, [fn(1, line_count=lines, complexity=complexity)]), rels(spark)).collect()
    assert [r["severity"] for r in got] == want and all(r["confidence"] == 0.85 for r in got)


@pytest.mark.parametrize(("n", "want"), [(5, []), (6, ["low"]), (8, ["low"]), (9, ["medium"])])
def test_long_parameters(spark, n, want):
    assert [r["severity"] for r in code.long_parameters(entities(spark, [fn(1, parameters=["p"] * n)]), rels(spark)).collect()] == want


@pytest.mark.parametrize(("lines", "methods", "fields", "want"), [(1000, 20, 15, []), (1001, 0, 0, ["medium"]), (1, 21, 0, ["medium"]), (1, 0, 16, ["medium"]), (2001, 0, 0, ["high"]), (1, 51, 0, ["high"]), (1, 50, 0, ["medium"])])
def test_god_class(spark, lines, methods, fields, want):
    rows = [fn(0, id="c", entity_type="Class", name="C", line_count=lines)] + [fn(i, parent_class="C") for i in range(1, methods + 1)] + [fn(1000 + i, entity_type="Variable", parent_class="C") for i in range(fields)]
    assert [r["severity"] for r in code.god_class(entities(spark, rows), rels(spark)).collect()] == want


@pytest.mark.parametrize(("lines", "n"), [(500, 0), (501, 1), (1000, 1), (1001, 0)])
def test_large_class(spark, lines, n):
    assert code.large_class(entities(spark, [fn(0, entity_type="Class", line_count=lines)]), rels(spark)).count() == n


def test_design_patterns(spark):
    cls = lambda name, **k: fn(name, id=name, entity_type="Class", name=name, **k)
    rows = [
        cls("One"), fn(1, parent_class="One", name="constructor", visibility="private"), fn(2, parent_class="One", name="getInstance", is_static=True), fn(3, parent_class="One", entity_type="Variable", is_static=True),
        cls("Subject"), fn(4, parent_class="Subject", name="addObserver"), fn(5, parent_class="Subject", name="removeObserver"), fn(6, parent_class="Subject", name="notifyAll"),
        cls("Wrap", implements=["Shape"]), fn(7, parent_class="Wrap", name="constructor", parameters=["inner: Shape"]), cls("Plain"),
        fn(8, name="createThing"), fn(9, name="other"), fn(10, id="i", entity_type="Interface", name="Shape"),
    ]
    e = entities(spark, rows)
    r = rels(spark, [("f8", "Plain", "CALLS"), ("f9", "Plain", "CALLS"), ("Wrap", "i", "IMPLEMENTS"), ("Plain", "i", "IMPLEMENTS")])
    found = {(x["name"], x["entities"][0]) for x in code.detect(e, r, ("design_pattern",)).collect()}
    assert found == {("Singleton", "One"), ("Observer", "Subject"), ("Decorator", "Wrap"), ("Factory", "f8"), ("Strategy", "i")}


def test_dead_and_duplicate_code(spark):
    rows = [fn(1), fn(2), fn(3, visibility="private"), fn(4, name="out"), fn(5, entity_type="Export", name="out"), fn(6, signature="n1( )", file_path="b.ts")]
    e, r = entities(spark, rows), rels(spark, [("f1", "f2", "CALLS")])
    assert {x["entities"][0] for x in code.dead_code(e, r).collect()} == {"f1", "f6"}
    assert [x["entities"] for x in code.duplicate_code(e, r).collect()] == [["f1", "f6"]]


def test_circular(spark):
    e, r = entities(spark, [fn(i) for i in range(1, 5)]), rels(spark, [("f1", "f2", "IMPORTS"), ("f2", "f3", "IMPORTS"), ("f3", "f1", "IMPORTS"), ("f3", "f4", "IMPORTS")])
    got = code.circular(e, r).collect()
    assert [(x["entities"], x["severity"], x["confidence"]) for x in got] == [(["f1", "f2", "f3"], "high", 0.95)]


def test_complexity_debt_row(spark):
    f = spark.createDataFrame([("x", 22), ("y", 10), ("z", 11)], "id string, complexity int")
    rows = {r["id"]: r for r in code.complexity_debt(f).collect()}
    x = rows["complexity_x"]
    assert (x["severity"], x["hours"], x["maintainability"], x["readability"], x["testability"], x["performance"], x["priority"]) == ("high", 5.0, 34.0, 12.0, 0.0, 80.0, 61)
    assert set(rows) == {"complexity_x", "complexity_z"} and rows["complexity_z"]["severity"] == "low"


def test_pattern_debt_and_report(spark):
    e = entities(spark, [fn(i) for i in range(3)])
    cyc = code.finding(e.filter("id = 'f0'"), "Circular Dependency", "anti_pattern", "architectural", "high", 0.95, F.array(F.lit("f0"), F.lit("f1")))
    item = code.pattern_debt(cyc, e).first()
    assert (item["hours"], item["type"], item["difficulty"], item["maintainability"]) == (3.0, "dependencies", "expert", 91.0)
    report = {(r["grouping"], r["value"]): r["items"] for r in code.debt_report(code.pattern_debt(cyc, e)).collect()}
    assert report == {("type", "dependencies"): 1, ("severity", "high"): 1, ("all", "all"): 1}


def test_timing_uses_floor_index(spark):
    t = A.timing(spark.range(1, 21).selectExpr("'a' AS name", "cast(id AS double) AS ms")).first()
    assert (t["median"], t["p95"], t["p99"], t["mean"]) == (11.0, 20.0, 20.0, 10.5)


# ---------------------------------------------------------------- questions and tools


@pytest.mark.parametrize(("question", "kind"), [("most complex functions", "complexity"), ("which functions call X?", "callers"), ("functions with more than 10 parameters", "parameters"), ("classes implementing an interface", "implementers"), ("how many functions", "count"), ("circular dependencies", "cycles"), ("what does X depend on?", "dependencies"), ("security issues", "security"), ("anything", "list")])
def test_intents(question, kind):
    assert intents.understand(question).type == kind


def test_intent_filters():
    assert intents.understand("functions with complexity over 12").filters["more_than"] == 12 and intents.understand('which functions call "run it"?').filters["name"] == "run it" and "Duplicate code" in intents.suggest("dup")


def test_guard(spark):
    for bad in ("DROP TABLE x", "insert into x values (1)", "select 1; drop table x"):
        with pytest.raises(PermissionError):
            tools.query(spark, bad)
    assert tools.query(spark, "SELECT 1 AS a").first()["a"] == 1
    with pytest.raises(KeyError):
        tools.run(tools.Store(spark.range(1)), "nope")


def test_declared_tools_are_there():
    names = "kb_read kb_list kb_update kb_create kb_delete kb_search kb_status kb_issues kb_export kb_import kb_backend_info kb_backend_switch kb_backend_health kb_semantic_search kb_graph_query analyze_codebase query_code_graph find_patterns track_technical_debt get_code_metrics architectural_overview find_function_calls get_class_hierarchy impact_analysis find_similar_code suggest_refactoring find_usage dependency_graph dead_code_detection security_analysis performance_hotspots"
    assert set(names.split()) == set(tools.TOOLS)
