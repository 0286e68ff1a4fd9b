"""Queries: predicates, search, sorts and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import security as S
from quillgraph.functions import text as T
from quillgraph.operators import aggregates as A
from quillgraph.operators import audit, ranking, search
from quillgraph.plans.domain import Tables
from quillgraph.plans.registry import SQL, query
from quillgraph.schemas import ordinal

RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# ---------------------------------------------------------------- predicates


@query("p01_node_types", "SELECT id, node_type FROM @nodes WHERE node_type IN ('fact', 'event')")
def _(t: Tables) -> DataFrame:
    return t.nodes.filter(F.col("node_type").isin("fact", "event")).select("id", "node_type")


@query("p02_minimum", "SELECT id, importance, confidence FROM @nodes WHERE confidence >= 0.5 AND importance >= 0.7")
def _(t: Tables) -> DataFrame:
    return t.nodes.filter("confidence >= 0.5 AND importance >= 0.7").select("id", "importance", "confidence")


@query("p03_substring", "SELECT id, name, importance FROM @functions WHERE contains(name, 'ring') ORDER BY importance DESC, id LIMIT 50")
def _(t: Tables) -> DataFrame:
    return t.functions.filter(F.contains("name", F.lit("ring"))).orderBy(F.desc("importance"), "id").limit(50).select("id", "name", "importance")


@query("p04_newest_with_text", "SELECT path, modified_s FROM @docs WHERE contains(lower(content), 'the') AND category = 'active' ORDER BY modified_s DESC, path LIMIT 50")
def _(t: Tables) -> DataFrame:
    return search.search_newest(t.docs.withColumn("modified", F.col("modified_s")), "THE", "active").select("path", "modified_s")


@query("p05_phrase_search", "SELECT path, 1 AS score FROM @docs WHERE contains(lower(content), 'of the') ORDER BY path LIMIT 50")
def _(t: Tables) -> DataFrame:
    return search.search_documents(t.docs, "of the").select("path", "score")


@query("p05_fuzzy_search", "SELECT path, score FROM (SELECT path, CAST(contains(lower(content), 'mit') AS INT) + CAST(contains(lower(content), 'license') AS INT) + CAST(contains(lower(content), 'version') AS INT) AS score FROM @docs) WHERE score > 0 ORDER BY score DESC, path LIMIT 50")
def _(t: Tables) -> DataFrame:
    return search.search_documents(t.docs, "MIT license version", fuzzy=True).select("path", "score")


@query("p06_path_prefix", "SELECT path FROM @docs WHERE starts_with(path, 'src1/')")
def _(t: Tables) -> DataFrame:
    return t.docs.filter(F.startswith("path", F.lit("src1/"))).select("path")


@query("p07_time_range", "SELECT event_id, event_type FROM @audit WHERE second BETWEEN 1704153600 AND 1704240000 ORDER BY second DESC, event_id LIMIT 100")
def _(t: Tables) -> DataFrame:
    return t.audit.filter(F.col("second").between(1704153600, 1704240000)).orderBy(F.desc("second"), "event_id").limit(100).select("event_id", "event_type")


@query("p08_similar_functions", "SELECT id, complexity, abs(complexity - 20) AS gap FROM @functions WHERE complexity BETWEEN 15 AND 25 AND language = 'python' AND id <> 2 ORDER BY gap, id LIMIT 20")
def _(t: Tables) -> DataFrame:
    return t.functions.filter("complexity BETWEEN 15 AND 25 AND language = 'python' AND id <> 2").select("id", "complexity", F.abs(F.col("complexity") - 20).alias("gap")).orderBy("gap", "id").limit(20)


@query("p09_high_complexity", "SELECT id, complexity FROM @functions WHERE complexity > 40 ORDER BY complexity DESC, id LIMIT 50")
def _(t: Tables) -> DataFrame:
    return t.functions.filter("complexity > 40").orderBy(F.desc("complexity"), "id").limit(50).select("id", "complexity")


@query("p10_intent_filters", "SELECT id FROM @functions WHERE contains(lower(name), 'red') AND language = 'javascript' AND complexity > 10 AND complexity < 30")
def _(t: Tables) -> DataFrame:
    return t.functions.filter(F.contains(F.lower("name"), F.lit("red")) & (F.col("language") == "javascript") & (F.col("complexity") > 10) & (F.col("complexity") < 30)).select("id")


@query("p11_severity_at_least", f"SELECT id, severity FROM @issues WHERE {RANK} >= 3")
def _(t: Tables) -> DataFrame:
    return t.issues.filter(ordinal(F.col("severity")) >= 3).select("id", "severity")


@query("p12_confidence_at_least", "SELECT id FROM @nodes WHERE confidence >= 0.5")
def _(t: Tables) -> DataFrame:
    return t.nodes.filter("confidence >= 0.5").select("id")


@query("p14_audit_filters", "SELECT event_id FROM @audit WHERE event_type = 'error' AND result = 'failure' AND severity = 'high' AND contains(resource, '7') AND second >= 1704153600")
def _(t: Tables) -> DataFrame:
    rows = t.audit.withColumn("timestamp", F.col("second"))
    return audit.matching(rows, event_type="error", resource="7", result="failure", severity="high", start=1704153600).select("event_id")


@query("p15_category_of_path", "SELECT id, CASE WHEN contains(p, '/active/') OR starts_with(p, 'active/') THEN 'active' WHEN contains(p, '/status/') OR starts_with(p, 'status/') THEN 'status' ELSE 'general' END AS category FROM (SELECT id, lower(concat(CASE id % 3 WHEN 0 THEN 'Active/' WHEN 1 THEN 'docs/Status/' ELSE 'misc/' END, path)) AS p FROM @docs)")
def _(t: Tables) -> DataFrame:
    path = F.concat(F.when(F.col("id") % 3 == 0, "Active/").when(F.col("id") % 3 == 1, "docs/Status/").otherwise("misc/"), "path")
    return t.docs.select("id", T.category(path).alias("category"))


@query("p16_language_of_path", "SELECT file_path, 'typescript' AS language, count(*) AS n FROM @functions GROUP BY file_path")
def _(t: Tables) -> DataFrame:
    return t.functions.groupBy("file_path", T.language(F.col("file_path")).alias("language")).agg(F.count("*").alias("n"))


@query("p17_name_heuristics", r"SELECT id, regexp_matches(name, '(?i)(^test|test$|_test|\.test|^it_|^should|spec$)') AS is_test, CASE WHEN regexp_matches(name, '^[A-Z]') THEN 'constructor' ELSE 'function' END AS kind FROM @functions")
def _(t: Tables) -> DataFrame:
    return t.functions.select("id", T.is_test_name(F.col("name")).alias("is_test"), T.call_kind(F.col("name")).alias("kind"))


NODE_KIND = r"CASE WHEN ends_with(x, '?') THEN 'question' WHEN contains(x, 'because') OR contains(x, 'therefore') THEN 'insight' WHEN regexp_matches(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}') OR contains(x, 'happened') OR contains(x, 'occurred') THEN 'event' WHEN regexp_matches(x, '^[A-Z][a-z]+ [A-Z][a-z]+$') THEN 'entity' WHEN length(x) > 200 THEN 'document' WHEN contains(x, ' is ') OR contains(x, ' are ') THEN 'fact' ELSE 'concept' END"


@query("p18_node_kind", f"SELECT id, {NODE_KIND} AS kind FROM (SELECT id, concat(CASE id % 6 WHEN 0 THEN 'because ' WHEN 1 THEN 'on 2024-05-01 ' ELSE '' END, content, CASE WHEN id % 5 = 0 THEN '?' ELSE '' END) AS x FROM @docs)")
def _(t: Tables) -> DataFrame:
    text = F.concat(F.when(F.col("id") % 6 == 0, "because ").when(F.col("id") % 6 == 1, "on 2024-05-01 ").otherwise(""), "content", F.when(F.col("id") % 5 == 0, "?").otherwise(""))
    return t.docs.select("id", T.node_type(text).alias("kind"))


@query("p19_kind_fields", "SELECT id, CASE WHEN node_type = 'fact' THEN false END AS verified, CASE WHEN node_type = 'memory' THEN 0.1e0 END AS decay FROM @nodes")
def _(t: Tables) -> DataFrame:
    from quillgraph.operators.writes import with_kind_fields

    return with_kind_fields(t.nodes.drop("decay_rate")).select("id", "verified", F.col("decay_rate").alias("decay"))


@query("p20_file_priority", "SELECT path, 2 AS priority, greatest(0.1e0, size / 50000e0) AS seconds FROM @docs")
def _(t: Tables) -> DataFrame:
    from quillgraph.sources.corpus import batch_plan

    return batch_plan(t.docs).select("path", "priority", "seconds")


@query("p22_row_filter", "SELECT path FROM @docs WHERE starts_with(path, 'src1/') OR starts_with(path, 'src2/')")
def _(t: Tables) -> DataFrame:
    roles = t.spark.createDataFrame([("editor", "src1/*"), ("editor", "src2/*"), ("viewer", "src3/*")], "role string, prefix string")
    return audit.authorised(t.docs, roles, "editor").select("path")


@query("p23_findings_by_name", "SELECT id FROM (SELECT *, importance AS conf FROM @nodes) WHERE contains(lower(content), 'widget') AND conf >= 0.8")
def _(t: Tables) -> DataFrame:
    return ranking.findings(t.nodes.select("id", F.col("content").alias("name"), F.col("importance").alias("confidence"), F.lit("low").alias("severity")), 0.8, name="widget").select("id")


@query("p24_list_filters", "SELECT id FROM @issues WHERE severity = 'critical' AND status = 'O'")
def _(t: Tables) -> DataFrame:
    return t.issues.filter("severity = 'critical' AND status = 'O'").select("id")


@query("p25_ttl", """SELECT id FROM @nodes n WHERE (1698000000 - created_s > 3600 AND importance < 0.3 AND memory_type = 'working') OR (importance < 0.1 AND 1698000000 - created_s > 604800)
    OR (1698000000 - created_s > 86400 AND NOT EXISTS (SELECT 1 FROM @edges e WHERE e.src = n.id) AND NOT EXISTS (SELECT 1 FROM @edges e WHERE e.dst = n.id))""")
def _(t: Tables) -> DataFrame:
    from quillgraph.operators.writes import ttl

    return ttl(t.nodes, t.edges, F.lit(1698000000)).filter("expired").select("id")


# ---------------------------------------------------------------- search and text


@query("w06_line_search", """WITH l AS (SELECT path, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM @docs)
    SELECT a.path, a.i AS line, a.x AS content, string_agg(b.x, chr(10) ORDER BY b.i) AS context FROM l a JOIN l b ON a.path = b.path AND b.i BETWEEN a.i - 2 AND a.i + 2 WHERE contains(lower(a.x), 'license') GROUP BY a.path, a.i, a.x""")
def _(t: Tables) -> DataFrame:
    return search.search_lines(t.docs, "license")


@query("f01_snippet", """SELECT id, CASE WHEN p < 0 THEN substr(content, 1, 200) ELSE concat(CASE WHEN greatest(0, p - 50) > 0 THEN '...' ELSE '' END, substr(content, greatest(0, p - 50) + 1, least(length(content), p + 157) - greatest(0, p - 50)), CASE WHEN least(length(content), p + 157) < length(content) THEN '...' ELSE '' END) END AS snippet
    FROM (SELECT id, content, position('license' IN lower(content)) - 1 AS p FROM @docs)""")
def _(t: Tables) -> DataFrame:
    return t.docs.select("id", T.snippet(F.col("content"), "license").alias("snippet"))


@query("f02_title", r"SELECT id, coalesce(nullif(trim(regexp_extract(content, '(?m)^[^\S\n]*# [^\S\n]*(\S.*)$', 1)), ''), nullif(substr(trim(string_split(content, chr(10))[1]), 1, 50), ''), 'Untitled') AS title FROM @docs")
def _(t: Tables) -> DataFrame:
    return t.docs.select("id", T.title(F.col("content")).alias("title"))


@query("f03_summary", """WITH s AS (SELECT id, array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#'))[1:3], ' ') AS j FROM @docs)
    SELECT id, CASE WHEN length(j) > 200 THEN concat(substr(j, 1, 200), '...') ELSE j END AS summary FROM s""")
def _(t: Tables) -> DataFrame:
    return t.docs.select("id", T.summary(F.col("content")).alias("summary"))


@query("f04_keywords", r"""WITH w AS (SELECT id, unnest(regexp_split_to_array(regexp_replace(lower(content), '[^A-Za-z0-9_\s]', ' ', 'g'), '\s+')) AS word FROM @docs), c AS (SELECT id, word, count(*) AS n FROM w WHERE length(word) > 3 GROUP BY id, word)
    SELECT id, word, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, word) AS k FROM c) WHERE k <= 10""")
def _(t: Tables) -> DataFrame:
    return search.keywords(t.docs, "id", "content", by=" ").select("id", "word", "n")


HEADINGS = r"(SELECT id, path, regexp_extract(x, '^(#+)\s+(.+)$', 2) AS text, CAST(length(regexp_extract(x, '^(#+)', 1)) AS INT) AS level FROM (SELECT id, path, trim(unnest(string_split(content, chr(10)))) AS x FROM @docs) WHERE regexp_matches(x, '^#+\s+.+$'))"


@query("f05a_headings", "SELECT id, text, level FROM " + HEADINGS.replace("FROM @docs", "FROM (SELECT id, path, concat(repeat('#', CAST(1 + id % 3 AS INT)), ' ', content) AS content FROM @docs WHERE content IS NOT NULL)"))
def _(t: Tables) -> DataFrame:
    """The documents have no headings of their own, so each one's first line is made one; all other lines are its text."""
    text = F.concat(F.repeat(F.lit("#"), (1 + F.col("id") % 3).cast("int")), F.lit(" "), "content")
    return t.docs.filter("content IS NOT NULL").select("id", F.inline(T.headings(text)))


PLAIN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '#+\s*', '', 'g'), '\*\*(.*?)\*\*', '\1', 'g'), '\*(.*?)\*', '\1', 'g'), '`(.*?)`', '\1', 'g'), '\[(.*?)\]\(.*?\)', '\1', 'g'), '\n+', ' ', 'g')"
SENTENCES = f"list_filter(list_transform(regexp_split_to_array({PLAIN}, '[.!?]+'), lambda x: trim(x)), lambda x: length(x) > 10)"


@query("f05b_sentences", f"SELECT id, len({SENTENCES}) AS n, sha256(array_to_string({SENTENCES}, '|')) AS hash FROM @docs WHERE content IS NOT NULL")
def _(t: Tables) -> DataFrame:
    found = T.sentences(F.col("content"))
    return t.docs.filter("content IS NOT NULL").select("id", F.size(found).cast("long").alias("n"), F.sha2(F.array_join(found, "|"), 256).alias("hash"))


@query("f05c_factual", r"SELECT id, regexp_matches(lower(content), '(^|[^a-z0-9_])(is|are|was|were|has|have|can|will|must|should)($|[^a-z0-9_])') AS factual FROM @nodes")
def _(t: Tables) -> DataFrame:
    return t.nodes.select("id", T.is_factual(F.col("content")).alias("factual"))


@query("f05d_events", "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus IN ('O', 'F')")
def _(t: Tables) -> DataFrame:
    verb = F.when(F.col("o_orderstatus") == "O", "started").when(F.col("o_orderstatus") == "F", "Ended").otherwise("rested")
    text = F.concat(F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit(" order of "), "o_totalprice", F.lit(" "), verb, F.lit("\nno date started"))
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), F.explode(T.events(text)).alias("e")).select("id", F.col("e.date").cast("string").alias("day"))


ENTITIES = {"person": r"[A-Z][a-z]+ [A-Z][a-z]+", "organization": r"[A-Z][a-z]+ [A-Z][a-z]+ [A-Z][a-z]+", "acronym": r"[A-Z][A-Z][A-Z]+", "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "version": r"[0-9]+\.[0-9]+\.[0-9]+"}


@query("f05e_entities", "SELECT id, " + ", ".join(rf"len(regexp_extract_all(content, '\b{p}\b')) AS {k}" for k, p in ENTITIES.items()) + " FROM @docs WHERE content IS NOT NULL")
def _(t: Tables) -> DataFrame:
    found = t.docs.filter("content IS NOT NULL").select("id", T.entities(F.col("content")).alias("e"))
    kinds = lambda k: F.size(F.filter("e", lambda x: x["type"] == k)).cast("long").alias(k)
    return found.select("id", *map(kinds, ENTITIES))


@query("f06_normal_signature", "SELECT id, regexp_replace(lower(signature), '[^a-z0-9]', '', 'g') AS normal FROM @functions")
def _(t: Tables) -> DataFrame:
    return t.functions.select("id", T.normal_signature(F.col("signature")).alias("normal"))


@query("f07_contradiction", r"SELECT a.id AS a, b.id AS b FROM @nodes a JOIN @nodes b ON a.id + 1 = b.id WHERE (regexp_matches(a.content, 'is\s+(\w+)') AND regexp_matches(b.content, 'is\s+not\s+(\w+)')) OR (regexp_matches(a.content, 'is\s+not\s+(\w+)') AND regexp_matches(b.content, 'is\s+(\w+)'))")
def _(t: Tables) -> DataFrame:
    a = t.nodes.select(F.col("id").alias("a"), F.col("content").alias("x"), (F.col("id") + 1).alias("b"))
    return a.join(t.nodes.select(F.col("id").alias("b"), F.col("content").alias("y")), "b").filter(T.contradicts(F.col("x"), F.col("y"))).select("a", "b")


@query("f08_insight_text", "SELECT id, CASE node_type WHEN 'event' THEN concat('Sequence of events detected: ', content, ' → ', content, ' → ', content) WHEN 'fact' THEN 'Related facts suggest a pattern or principle connecting these concepts' END AS insight FROM @nodes")
def _(t: Tables) -> DataFrame:
    k, c = F.col("node_type"), F.col("content")
    return t.nodes.select("id", T.insight_text(k, c, k, c, k, c).alias("insight"))


@query("f09_sanitise", r"SELECT id, substr(regexp_replace(regexp_replace(concat(path, '<', lang, '>'), '[^a-zA-Z0-9\-_.]', '_', 'g'), '_{2,}', '_', 'g'), 1, 255) AS name, trim(substr(regexp_replace(concat('<b>', path), '[<>]', '', 'g'), 1, 1000)) AS query FROM @docs")
def _(t: Tables) -> DataFrame:
    return t.docs.select("id", S.safe_filename(F.concat("path", F.lit("<"), "lang", F.lit(">"))).alias("name"), S.safe_query(F.concat(F.lit("<b>"), "path")).alias("query"))


@query("f10_path_faults", "SELECT id, CASE id % 4 WHEN 0 THEN 'parent folder' WHEN 1 THEN 'absolute path' WHEN 2 THEN 'not an allowed name' END AS fault FROM @docs")
def _(t: Tables) -> DataFrame:
    n = F.col("id") % 4
    return t.docs.select("id", S.path_fault(F.concat(F.when(n == 0, "../").when(n == 1, "/").otherwise(""), "path", F.when(n == 2, ".exe").otherwise(""))).alias("fault"))


@query("f11_masking", "SELECT id, CASE WHEN length(name) <= 4 THEN repeat('*', length(name)) ELSE concat(repeat('*', length(name) - 4), substr(name, length(name) - 3, 4)) END AS masked, CASE WHEN id < 256 THEN concat('10.1.', id, '.0') ELSE 'anonymous' END AS ip FROM @functions")
def _(t: Tables) -> DataFrame:
    return t.functions.select("id", S.mask(F.col("name")).alias("masked"), S.anonymous_ip(F.concat(F.lit("10.1."), "id", F.lit(".7"))).alias("ip"))


@query("f12_encryption", "SELECT id, name, strlen(name) + 28 AS size, CAST(NULL AS VARCHAR) AS by_other_key, CAST(NULL AS VARCHAR) AS when_changed FROM @functions")
def _(t: Tables) -> DataFrame:
    key, other = S.derive_key("secret", b"salt"), S.derive_key("another", b"salt")
    data = F.col("sealed")
    sealed = t.functions.select("id", S.encrypt(F.col("name"), key).alias("sealed"))
    changed = F.concat(data, F.lit(b"x"))
    return sealed.select("id", S.decrypt(data, key).alias("name"), F.octet_length(data).alias("size"), S.decrypt(data, other).alias("by_other_key"), S.decrypt(changed, key).alias("when_changed"))


@query("f13_pii_fields", "SELECT id, CASE WHEN id % 2 = 0 THEN 'name,email' ELSE 'name' END AS fields FROM @functions")
def _(t: Tables) -> DataFrame:
    rows = t.functions.withColumn("email", F.when(F.col("id") % 2 == 0, "a@b.c"))
    return rows.select("id", F.array_join(S.pii_fields("name", "email", "language"), ",").alias("fields"))


@query("f15_vector_norm", "SELECT id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm, 1e0 AS unit FROM @vectors")
def _(t: Tables) -> DataFrame:
    from quillgraph.functions import vector as V

    return t.vectors.select("id", r6(V.norm(F.col("embedding"))).alias("norm"), r6(V.norm(V.normalise(F.col("embedding")))).alias("unit"))


@query("f17_signature_types", "SELECT id, 'Widget,Ring' AS types FROM @functions")
def _(t: Tables) -> DataFrame:
    return t.functions.select("id", F.array_join(T.types_in(F.concat("name", F.lit("(a: Widget, b: number): Ring"))), ",").alias("types"))


@query("f18_relative_path", "SELECT id, concat('lib/', name, '.ts') AS path FROM @functions")
def _(t: Tables) -> DataFrame:
    return t.functions.select("id", T.relative_path(F.col("file_path"), F.concat(F.lit("./../lib/x/../"), "name", F.lit(".ts"))).alias("path"))


@query("f23_durations", "SELECT id, CASE id % 3 WHEN 0 THEN id * 60 WHEN 1 THEN id * 3600 ELSE id * 86400 END AS seconds FROM @functions")
def _(t: Tables) -> DataFrame:
    n = F.col("id") % 3
    return t.functions.select("id", T.duration_seconds(F.concat("id", F.when(n == 0, "m").when(n == 1, "h").otherwise("d"))).alias("seconds"))


@query("f24_byte_sizes", "SELECT id, CASE WHEN size >= 1048576 THEN format('{:.1f} MB', floor(size * 10 / 1048576e0 + 0.5e0) / 10) WHEN size >= 1024 THEN format('{:.1f} KB', floor(size * 10 / 1024e0 + 0.5e0) / 10) ELSE concat(size, ' B') END AS label FROM (SELECT id, size * (1 + id % 2 * 999) AS size FROM @docs)")
def _(t: Tables) -> DataFrame:
    return t.docs.select("id", T.byte_size(F.col("size") * (1 + F.col("id") % 2 * 999)).alias("label"))


@query("f26_result_confidence", "SELECT id, round(least(1e0, 0.5e0 + CASE WHEN importance > 0.5 THEN 0.3e0 ELSE 0e0 END + CASE WHEN access_count > 25 THEN 0.15e0 ELSE 0e0 END + CASE WHEN confidence > 0.5 THEN 0.05e0 ELSE 0e0 END), 6) AS score FROM @nodes")
def _(t: Tables) -> DataFrame:
    part = lambda cond, x: F.when(cond, x).otherwise(0.0)
    return t.nodes.select("id", r6(F.least(F.lit(1.0), 0.5 + part(F.col("importance") > 0.5, 0.3) + part(F.col("access_count") > 25, 0.15) + part(F.col("confidence") > 0.5, 0.05))).alias("score"))


@query("f27_csv_fields", """SELECT id, concat('"', replace(content, '"', '""'), '"') AS field FROM @docs WHERE regexp_matches(content, '[",\\n\\r]')""")
def _(t: Tables) -> DataFrame:
    return t.docs.filter(F.col("content").rlike('[",\n\r]')).select("id", T.csv_field(F.col("content")).alias("field"))


@query("f28_call_kinds", "SELECT id, CASE id % 3 WHEN 0 THEN 'method' WHEN 1 THEN 'constructor' ELSE 'function' END AS kind FROM @functions")
def _(t: Tables) -> DataFrame:
    n = F.col("id") % 3
    return t.functions.select("id", T.call_kind(F.when(n == 0, "a.b").when(n == 1, "Widget").otherwise("run")).alias("kind"))


@query("f30_metadata_json", "SELECT event_id, CAST(json_extract(resource, '$.k') AS BIGINT) AS k FROM @audit")
def _(t: Tables) -> DataFrame:
    return t.audit.select("event_id", F.variant_get(F.parse_json("resource"), "$.k", "bigint").alias("k"))


@query("f32_conditions", "SELECT id FROM @samples WHERE value > 100.5")
def _(t: Tables) -> DataFrame:
    from quillgraph.streaming.monitor import holds

    return t.samples.filter(holds("value > 100.5")).select("id")


@query("f25_impact_levels", "SELECT dst AS id, CASE WHEN n = 0 THEN 'none' WHEN n <= 3 THEN 'low' ELSE 'high' END AS level, CASE WHEN n > 20 THEN 'high' WHEN n > 5 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT dst, count(DISTINCT src) AS n FROM @edges WHERE edge_type = 'CALLS' GROUP BY dst)")
def _(t: Tables) -> DataFrame:
    from quillgraph.operators import graph

    n = t.edges.filter("edge_type = 'CALLS'").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n"))
    return n.select("id", graph.impact_level(F.col("n")).alias("level"), graph.risk(F.col("n")).alias("risk"))


# ---------------------------------------------------------------- sorts and top-k


@query("t01_by_type", "SELECT id, importance FROM @nodes WHERE node_type = 'fact' ORDER BY importance DESC, created_s DESC, id LIMIT 100")
def _(t: Tables) -> DataFrame:
    return ranking.by_type(t.nodes, "fact").select("id", "importance")


@query("t02_working_context", "SELECT id, priority FROM @items WHERE session = 3 ORDER BY focused DESC, priority DESC, accessed_s DESC, id LIMIT 10")
def _(t: Tables) -> DataFrame:
    return ranking.working_context(t.items, 3).select("id", "priority")


RANK_SCORE = "0.3e0 * importance + 0.2e0 * confidence + 0.2e0 * (accessed_s / 1700000000e0) + 0.1e0 * least(access_count / 100e0, 1e0) + CASE WHEN node_type IN ('fact', 'insight', 'memory') THEN 0.2e0 ELSE 0e0 END"


@query("t03_hybrid_rank", f"SELECT id, round({RANK_SCORE}, 6) AS score FROM @nodes ORDER BY score DESC, id LIMIT 50")
def _(t: Tables) -> DataFrame:
    return search.hybrid_rank(t.nodes, F.lit(1700000000.0), 50).select("id", r6("rank_score").alias("score"))


COS = "list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))))"


@query("t04_vector_top_k", f"SELECT v.id, round({COS}, 6) AS similarity FROM @vectors v, (SELECT embedding FROM @vectors WHERE id = 7) q WHERE {COS} >= 0.1 ORDER BY round({COS}, 9) DESC, v.id LIMIT 10")
def _(t: Tables) -> DataFrame:
    return ranking.nearest(t.vectors, ranking.query_vector(t.vectors, 7), 10, 0.1).select("id", r6("similarity").alias("similarity"))


@query("t05_candidates_then_cut", f"SELECT id, similarity FROM (SELECT v.id, round({COS}, 6) AS similarity, round({COS}, 9) AS s9 FROM @vectors v, (SELECT embedding FROM @vectors WHERE id = 11) q ORDER BY s9 DESC, v.id LIMIT 20) WHERE similarity >= 0.1 ORDER BY s9 DESC, id LIMIT 10")
def _(t: Tables) -> DataFrame:
    return ranking.candidates_then_cut(t.vectors, ranking.query_vector(t.vectors, 11), 10, 0.1).select("id", r6("similarity").alias("similarity"))


@query("t06_similar_to_node", f"SELECT v.id, round({COS}, 6) AS similarity FROM @vectors v, (SELECT embedding FROM @vectors WHERE id = 7) q WHERE v.id <> 7 AND {COS} >= 0.1 ORDER BY round({COS}, 9) DESC, v.id LIMIT 10")
def _(t: Tables) -> DataFrame:
    return ranking.similar_to(t.vectors, 7, 10, 0.1).select("id", r6("similarity").alias("similarity"))


@query("t07_semantic_with_type", f"SELECT v.id, round({COS}, 6) AS similarity FROM @vectors v, (SELECT embedding FROM @vectors WHERE id = 7) q WHERE v.node_type IN ('t1', 't2') AND {COS} >= 0.0 ORDER BY round({COS}, 9) DESC, v.id LIMIT 10")
def _(t: Tables) -> DataFrame:
    return ranking.nearest(t.vectors, ranking.query_vector(t.vectors, 7), 10, 0.0, types=("t1", "t2")).select("id", r6("similarity").alias("similarity"))


@query("t08_findings_order", f"SELECT id, severity FROM (SELECT id, severity, cost / 1000000e0 AS confidence FROM @issues) ORDER BY {RANK} DESC, confidence DESC, id LIMIT 40")
def _(t: Tables) -> DataFrame:
    return ranking.findings(t.issues.select("id", "severity", (F.col("cost") / 1000000.0).alias("confidence")), 0.0, limit=40).select("id", "severity")


@query("t10_debt_phases", "SELECT id, CASE WHEN k <= 5 THEN 1 WHEN k <= 10 THEN 2 ELSE 3 END AS phase FROM (SELECT id, row_number() OVER (ORDER BY priority DESC, hours, id) AS k FROM (SELECT id, complexity AS priority, line_count AS hours FROM @functions))")
def _(t: Tables) -> DataFrame:
    return ranking.debt_plan(t.functions.select("id", F.col("complexity").alias("priority"), F.col("line_count").alias("hours"))).select("id", "phase")


@query("t11_issues_order", f"SELECT id, severity FROM @issues ORDER BY {RANK} DESC, created_s DESC, id LIMIT 50")
def _(t: Tables) -> DataFrame:
    return ranking.issues(t.issues, 50).select("id", "severity")


@query("t12_audit_page", "SELECT event_id FROM @audit ORDER BY second DESC, event_id LIMIT 100 OFFSET 50")
def _(t: Tables) -> DataFrame:
    return ranking.page(t.audit, "second", True, 50, 100).select("event_id")


@query("t13_debt_flags", "SELECT id, debt_score FROM (SELECT id, complexity, CAST(complexity > 10 AS INT) + CAST(line_count > 100 AS INT) AS debt_score FROM @functions) WHERE debt_score > 0 ORDER BY debt_score DESC, complexity DESC, id LIMIT 50")
def _(t: Tables) -> DataFrame:
    return ranking.debt_flags(t.functions).select("id", "debt_score")


@query("t15_slowest", "SELECT id, value FROM @samples ORDER BY value DESC, id LIMIT 5")
def _(t: Tables) -> DataFrame:
    return ranking.top(t.samples, "value", "id").select("id", "value")


# ---------------------------------------------------------------- aggregates


@query("a02_overall", "SELECT count(*) AS total, count(DISTINCT node_type) AS kinds, round(avg(importance), 6) AS avg_importance, round(avg(confidence), 6) AS avg_confidence FROM @nodes")
def _(t: Tables) -> DataFrame:
    return A.overall(t.nodes).select("total", "kinds", r6("avg_importance").alias("avg_importance"), r6("avg_confidence").alias("avg_confidence"))


@query("a03_temporal", "SELECT count(*) AS events, min(second) AS first_s, max(second) AS last_s, round(avg(value), 6) AS avg_duration, CAST(floor((max(second) - min(second)) / 86400) AS BIGINT) AS span_days, (SELECT count(*) FROM @edges WHERE edge_type = 'CALLS') AS edges FROM @audit")
def _(t: Tables) -> DataFrame:
    return A.temporal(t.audit, t.edges.filter("edge_type = 'CALLS'"), "second", "value").withColumn("avg_duration", r6("avg_duration"))


@query("a04_working_memory", "SELECT session, count(*) AS items, count(*) FILTER (WHERE focused) AS focused, round(avg(priority), 6) AS avg_priority, max(importance) AS max_importance, count(*) / 20e0 AS capacity_used FROM @items GROUP BY session")
def _(t: Tables) -> DataFrame:
    return A.working_memory(t.items).withColumn("avg_priority", r6("avg_priority"))


@query("a05_vectors", "SELECT count(*) AS vectors, avg(len(embedding)) AS avg_dimension, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6) AS avg_norm FROM @vectors")
def _(t: Tables) -> DataFrame:
    return A.vectors(t.vectors).withColumn("avg_norm", r6("avg_norm"))


@query("a06_code_metrics", "SELECT count(*) AS functions, round(avg(complexity), 6) AS avg_complexity, max(complexity) AS max_complexity, CAST(sum(line_count) AS BIGINT) AS total_lines, (SELECT count(*) FROM @classes) AS classes, (SELECT count(*) FROM @modules) AS modules FROM @functions")
def _(t: Tables) -> DataFrame:
    return A.code_metrics(t.functions, t.classes, t.modules).withColumn("avg_complexity", r6("avg_complexity"))


@query("a07_file_metrics", "SELECT file_path, CAST(sum(line_count) AS BIGINT) AS lines, count(*) FILTER (WHERE id % 5 <> 0) AS functions, count(*) FILTER (WHERE id % 5 = 0) AS classes, 2 * count(*) FILTER (WHERE id % 5 <> 0) + 3 * count(*) FILTER (WHERE id % 5 = 0) AS score FROM @functions GROUP BY file_path")
def _(t: Tables) -> DataFrame:
    return A.file_metrics(t.functions.withColumn("entity_type", F.when(F.col("id") % 5 == 0, "Class").otherwise("Function")))


@query("a08_target_metrics", "SELECT language, count(*) AS n, round(coalesce(avg(complexity) FILTER (WHERE visibility = 'private'), 0), 6) AS private_complexity FROM @functions GROUP BY language")
def _(t: Tables) -> DataFrame:
    return t.functions.groupBy("language").agg(F.count("*").alias("n"), r6(A.mean_or_zero(F.when(F.col("visibility") == "private", F.col("complexity")))).alias("private_complexity"))


@query("a09_type_counts", "SELECT edge_type, count(*) AS n FROM @edges GROUP BY edge_type")
def _(t: Tables) -> DataFrame:
    return A.counts(t.edges, "edge_type")


@query("a10_by_category", "SELECT category, count(*) AS files, CAST(sum(size) AS BIGINT) AS size FROM @docs GROUP BY category")
def _(t: Tables) -> DataFrame:
    return A.by_category(t.docs)


@query("a11_severities", "SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low FROM @issues")
def _(t: Tables) -> DataFrame:
    return A.severities(t.issues)


@query("a12_duplicates", "SELECT normal, count(*) AS members, count(DISTINCT file_path) AS files, CAST(sum(line_count) AS BIGINT) AS lines, min(id) AS first_id FROM (SELECT *, regexp_replace(lower(signature), '[^a-z0-9]', '', 'g') AS normal FROM @functions) GROUP BY normal HAVING count(*) > 1 AND count(DISTINCT file_path) > 1")
def _(t: Tables) -> DataFrame:
    return A.duplicates(t.functions, T.normal_signature(F.col("signature"))).select("normal", "members", "files", "lines", F.col("ids")[0].alias("first_id"))


@query("a14_distribution", "SELECT count(*) FILTER (WHERE complexity <= 5) AS low, count(*) FILTER (WHERE complexity > 5 AND complexity <= 15) AS medium, count(*) FILTER (WHERE complexity > 15) AS high FROM @functions")
def _(t: Tables) -> DataFrame:
    return A.distribution(t.functions)


@query("a15_coupling", "SELECT i.n AS imports, m.n AS modules, round(i.n / m.n, 6) AS coupling FROM (SELECT count(*) AS n FROM @edges WHERE edge_type = 'IMPORTS') i, (SELECT count(*) AS n FROM @modules) m")
def _(t: Tables) -> DataFrame:
    return A.coupling(t.edges, t.modules).withColumn("coupling", r6("coupling"))


@query("a16_cohesion", """WITH m AS (SELECT id, class_id FROM @functions), n AS (SELECT class_id, count(*) AS n FROM m GROUP BY class_id HAVING count(*) > 1),
    c AS (SELECT a.class_id, count(*) AS k FROM (SELECT DISTINCT src, dst FROM @edges WHERE edge_type = 'CALLS' AND src <> dst) e JOIN m a ON e.src = a.id JOIN m b ON e.dst = b.id AND a.class_id = b.class_id GROUP BY a.class_id)
    SELECT round(coalesce(avg(100 * coalesce(k, 0) / (n * (n - 1))), 100), 6) AS cohesion FROM n LEFT JOIN c USING (class_id)""")
def _(t: Tables) -> DataFrame:
    return A.cohesion(t.functions.select("id", F.col("class_id").alias("class")), t.edges.filter("edge_type = 'CALLS'")).select(r6("cohesion").alias("cohesion"))


@query("a20_pattern_counts", "SELECT concat(language, ':', visibility) AS pattern, count(*) AS n FROM @functions GROUP BY 1 ORDER BY n DESC, pattern LIMIT 10")
def _(t: Tables) -> DataFrame:
    return A.counts(t.functions.select(F.concat("language", F.lit(":"), "visibility").alias("pattern")), "pattern").orderBy(F.desc("n"), "pattern").limit(10)


@query("a21_timing", """WITH r AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM @samples)
    SELECT name, max(n) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, max(value) FILTER (WHERE i = floor(n * 0.5e0)) AS median, max(value) FILTER (WHERE i = floor(n * 0.95e0)) AS p95, max(value) FILTER (WHERE i = floor(n * 0.99e0)) AS p99 FROM r GROUP BY name""")
def _(t: Tables) -> DataFrame:
    return A.timing(t.samples, "name", "value").select("name", "n", F.round("total", 4).alias("total"), r6("mean").alias("mean"), "min", "max", "median", "p95", "p99")


@query("a22_suite", "SELECT count(*) AS tests, round(avg(x), 6) AS avg_throughput, CASE WHEN avg(x) > 100 THEN 'excellent' WHEN avg(x) > 50 THEN 'good' WHEN avg(x) > 20 THEN 'average' ELSE 'poor' END AS rating FROM (SELECT name, 1000 / avg(value) AS x FROM @samples GROUP BY name)")
def _(t: Tables) -> DataFrame:
    return A.suite(A.timing(t.samples, "name", "value")).withColumn("avg_throughput", r6("avg_throughput"))


@query("a23_error_rate", "SELECT round(sum(value) FILTER (WHERE name = 'error'), 4) AS errors, round(sum(value) FILTER (WHERE name = 'error') / sum(value) FILTER (WHERE name = 'view'), 6) AS error_rate, round(sum(value) FILTER (WHERE name = 'signup'), 4) AS auth_failures FROM @samples")
def _(t: Tables) -> DataFrame:
    names = F.create_map(*(F.lit(x) for p in {"error": "errors", "view": "operations", "signup": "auth_failures"}.items() for x in p))
    return A.error_rate(t.samples.withColumn("name", names[F.col("name")])).select(F.round("errors", 4).alias("errors"), r6("error_rate").alias("error_rate"), F.round("auth_failures", 4).alias("auth_failures"))


@query("a24_status", "SELECT (SELECT CAST(round(avg(complexity)) AS BIGINT) FROM @functions) AS completion, (SELECT count(*) FROM @issues WHERE severity = 'critical') AS critical_issues")
def _(t: Tables) -> DataFrame:
    return A.status(t.functions.select(F.col("complexity").alias("completion")), t.issues)


@query("a26_retention", "SELECT event_type, days, count(*) AS events, count(*) FILTER (WHERE second < 1760000000 - days * 86400) AS expired FROM @audit JOIN (VALUES ('auth', 548), ('authz', 365), ('data_access', 365), ('config_change', 2555), ('security', 730), ('error', 180)) r(event_type, days) USING (event_type) GROUP BY event_type, days")
def _(t: Tables) -> DataFrame:
    return A.expired(t.audit, F.lit(1760000000))


@query("a27_metrics", "SELECT name, label, count(*) AS n, round(sum(value), 4) AS total, count(*) FILTER (WHERE value <= 0.1) AS le_0_1, count(*) FILTER (WHERE value <= 10) AS le_10_0 FROM @samples GROUP BY name, label")
def _(t: Tables) -> DataFrame:
    return A.metric_registry(t.samples).select("name", "label", "n", F.round("total", 4).alias("total"), "le_0_1", "le_10_0")


@query("a28_documentation", "SELECT count(*) AS functions, count(*) FILTER (WHERE NOT documented) AS undocumented, round(count(*) FILTER (WHERE documented) / count(*), 6) AS coverage, CAST(ceil(count(*) FILTER (WHERE NOT documented) / 2) AS BIGINT) AS hours, CASE WHEN count(*) FILTER (WHERE NOT documented) > count(*) / 2 THEN 'medium' ELSE 'low' END AS severity FROM @functions")
def _(t: Tables) -> DataFrame:
    return A.documentation(t.functions).withColumn("coverage", r6("coverage"))


@query("a29_distinct", "SELECT DISTINCT src FROM @edges WHERE edge_type = 'EXTENDS'")
def _(t: Tables) -> DataFrame:
    return t.edges.filter("edge_type = 'EXTENDS'").select("src").distinct()


@query("a30_health", "SELECT CASE max(CASE status WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END) WHEN 2 THEN 'unhealthy' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS status, count(*) AS checks FROM @issues")
def _(t: Tables) -> DataFrame:
    return A.health(t.issues.select(F.when(F.col("status") == "F", "fail").when(F.col("status") == "P", "warn").otherwise("ok").alias("status")))


@query("a31_issue_types", "SELECT status, count(*) AS n FROM @issues GROUP BY status ORDER BY n DESC")
def _(t: Tables) -> DataFrame:
    return A.counts(t.issues, "status").orderBy(F.desc("n"))


@query("a32_preview", f"SELECT d.path, length(content) AS size, CAST(coalesce(h.n, 0) AS INT) AS headings, CAST(len({SENTENCES}) AS INT) AS sentences FROM @docs d LEFT JOIN (SELECT path, count(*) AS n FROM {HEADINGS} GROUP BY path) h ON h.path = d.path WHERE content IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return A.preview(t.docs.filter("content IS NOT NULL")).select("path", F.col("size").cast("long").alias("size"), "headings", "sentences")


@query("a33_grouped", "SELECT category, count(*) AS n, min(path) AS first_path FROM @docs GROUP BY category")
def _(t: Tables) -> DataFrame:
    return A.grouped(t.docs, "category", "path").select("category", F.size("items").cast("long").alias("n"), F.col("items")[0]["path"].alias("first_path"))


@query("j36_compare_runs", """WITH b AS (SELECT concat(name, label) AS name, avg(value) AS m FROM @samples WHERE id % 2 = 0 GROUP BY 1), a AS (SELECT concat(name, label) AS name, avg(value) AS m FROM @samples WHERE id % 2 = 1 GROUP BY 1)
    SELECT name, round(b.m, 6) AS before, round(a.m, 6) AS after, round(100 * (a.m - b.m) / b.m, 6) AS change, CASE WHEN 100 * (a.m - b.m) / b.m > 5 THEN 'slower' WHEN 100 * (a.m - b.m) / b.m < -5 THEN 'improved' ELSE 'stable' END AS verdict FROM a JOIN b USING (name)""")
def _(t: Tables) -> DataFrame:
    run = lambda k: t.samples.filter(F.col("id") % 2 == k).groupBy(F.concat("name", "label").alias("name")).agg(F.avg("value").alias("mean"))
    return A.compare(run(0), run(1), "inner").select("name", *(r6(c).alias(c) for c in ("before", "after", "change")), "verdict")


@query("a19_batches", "SELECT CAST(sum(f) AS BIGINT) AS files, CAST(sum(e) AS BIGINT) AS entities, round(avg(m), 6) AS avg_ms FROM (SELECT user_id, count(DISTINCT label) AS f, count(*) AS e, avg(value) AS m FROM @samples GROUP BY user_id)")
def _(t: Tables) -> DataFrame:
    batches = t.samples.groupBy("user_id").agg(F.count_distinct("label").alias("files"), F.count("*").alias("entities"), F.avg("value").alias("ms"), F.collect_set("name").alias("patterns"))
    return A.merged_batches(batches).select("files", "entities", r6("avg_ms").alias("avg_ms"))


# Queries over all documents that return whole lists and titles; tested against Python as well.


@query("f02_all_titles")
def _(t: Tables) -> DataFrame:
    return t.docs.select("id", T.title(F.col("content")).alias("title"))


@query("f04_all_keywords")
def _(t: Tables) -> DataFrame:
    return search.keywords(t.docs, "id", "content", by=" ").select("id", "word", "n")


@query("f05a_all_headings")
def _(t: Tables) -> DataFrame:
    return t.docs.select("id", T.headings(F.col("content")).alias("headings"))


@query("f05b_all_sentences")
def _(t: Tables) -> DataFrame:
    return t.docs.select("id", T.sentences(F.col("content")).alias("sentences"))


@query("f05d_all_events")
def _(t: Tables) -> DataFrame:
    return t.docs.select("id", T.events(F.col("content")).alias("events"))


@query("f05e_all_entities")
def _(t: Tables) -> DataFrame:
    return t.docs.select("id", T.entities(F.col("content")).alias("entities"))


@query("f24_all_byte_sizes", "SELECT id, CASE WHEN size >= 1048576 THEN format('{:.1f} MB', floor(size * 10 / 1048576e0 + 0.5e0) / 10) WHEN size >= 1024 THEN format('{:.1f} KB', floor(size * 10 / 1024e0 + 0.5e0) / 10) ELSE concat(size, ' B') END AS label FROM @docs")
def _(t: Tables) -> DataFrame:
    return t.docs.select("id", T.byte_size(F.col("size")).alias("label"))


@query("a32_all_previews")
def _(t: Tables) -> DataFrame:
    return A.preview(t.docs)


SQL["f02_all_titles"], SQL["f04_all_keywords"] = SQL["f02_title"], SQL["f04_keywords"]
