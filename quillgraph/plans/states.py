"""Queries: state changes, ordered operators, set operations and audit chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import audit, search, windows, writes
from quillgraph.plans.basic import RANK_SCORE, r6
from quillgraph.plans.domain import Tables
from quillgraph.plans.registry import query
from quillgraph.streaming import changes, monitor

# ---------------------------------------------------------------- writes


@query("d01_create_nodes", "SELECT id, CASE WHEN id % 3 = 0 THEN 'fact' WHEN contains(content, ' is ') THEN 'fact' ELSE 'concept' END AS node_type, 0.5e0 AS importance, CASE WHEN id % 7 = 0 THEN 'confidence is outside 0..1' END AS fault FROM @nodes")
def _(t: Tables) -> DataFrame:
    new = t.nodes.select("id", "content", F.when(F.col("id") % 3 == 0, "fact").alias("node_type"), F.when(F.col("id") % 7 == 0, 1.5).alias("confidence"))
    return writes.create_nodes(new, F.lit("2024-01-01").cast("timestamp")).select("id", "node_type", "importance", F.col("_error").alias("fault"))


@query("d03_patch", "SELECT id, CASE WHEN id % 2 = 0 THEN 0.25e0 ELSE importance END AS importance, confidence FROM @nodes")
def _(t: Tables) -> DataFrame:
    changed = t.nodes.filter("id % 2 = 0").select("id", F.lit(0.25).alias("importance"), F.lit(None).cast("double").alias("confidence"))
    return writes.patch(t.nodes, changed).select("id", "importance", "confidence")


@query("d04_forget", "SELECT count(*) AS edges, (SELECT count(*) FROM @nodes WHERE id % 10 <> 0) AS nodes FROM @edges WHERE src % 10 <> 0 AND dst % 10 <> 0")
def _(t: Tables) -> DataFrame:
    from quillgraph.operators.aggregates import beside

    gone = t.nodes.select("id").filter("id % 10 = 0").unionByName(t.edges.selectExpr("explode(array(src, dst)) AS id").filter("id % 10 = 0")).distinct()
    nodes, edges = writes.forget(t.nodes, t.edges, gone)
    return beside(edges.agg(F.count("*").alias("edges")), nodes.agg(F.count("*").alias("nodes")))


@query("d05_reinforce", "SELECT n.id, round(least(1e0, n.importance + 0.1e0 * coalesce(k, 0)), 6) AS importance, n.access_count + coalesce(k, 0) AS access_count FROM @nodes n LEFT JOIN (SELECT user_id AS id, count(*) AS k FROM @audit GROUP BY user_id) t ON t.id = n.id")
def _(t: Tables) -> DataFrame:
    return writes.reinforce(t.nodes, t.audit.select(F.col("user_id").alias("id"))).select("id", r6("importance").alias("importance"), "access_count")


@query("d06_decay_idle", "SELECT id, round(CASE WHEN memory_type IN ('short_term', 'working') AND accessed_s + 86400 < 1698000000 THEN importance * 0.9e0 ELSE importance END, 6) AS importance FROM @nodes")
def _(t: Tables) -> DataFrame:
    return writes.decay_idle(t.nodes, F.lit(1698000000), 86400).select("id", r6("importance").alias("importance"))


@query("d07_decay_old", "SELECT id, round(CASE WHEN created_s < 1693000000 AND importance > 0.1 THEN importance * 0.9e0 ELSE importance END, 6) AS importance, round(CASE WHEN created_s < 1693000000 AND importance > 0.1 THEN confidence * 0.95e0 ELSE confidence END, 6) AS confidence FROM @nodes")
def _(t: Tables) -> DataFrame:
    return writes.decay_old(t.nodes, F.lit(1693000000)).select("id", r6("importance").alias("importance"), r6("confidence").alias("confidence"))


@query("d08_consolidate", "SELECT id, CASE WHEN memory_type = 'short_term' AND reinforcement >= 5 THEN 'long_term' ELSE memory_type END AS memory_type, round(CASE WHEN memory_type = 'short_term' AND reinforcement >= 5 THEN least(1e0, importance * 1.5e0) ELSE importance END, 6) AS importance FROM @nodes")
def _(t: Tables) -> DataFrame:
    return writes.consolidate(t.nodes).select("id", "memory_type", r6("importance").alias("importance"))


@query("d09_promote", "SELECT id, CASE WHEN memory_type = 'working' AND id < 100 THEN 'long_term' ELSE memory_type END AS memory_type FROM @nodes")
def _(t: Tables) -> DataFrame:
    return writes.promote(t.nodes, t.spark.range(100)).select("id", "memory_type")


@query("d10_focus", "SELECT id, CASE WHEN session = 3 THEN id IN (3001, 3002) ELSE focused END AS focused, round(CASE WHEN id IN (3001, 3002) THEN least(1e0, priority + 0.2e0) ELSE priority END, 6) AS priority FROM @items")
def _(t: Tables) -> DataFrame:
    return writes.focus(t.items, 3, [3001, 3002]).select("id", "focused", r6("priority").alias("priority"))


@query("d11_clear_and_touch", "SELECT id, CASE WHEN role = 'user' THEN 1800000000 ELSE accessed_s END AS accessed_s FROM @items WHERE session <> 3")
def _(t: Tables) -> DataFrame:
    rows = writes.clear_session(t.items.withColumn("access_count", F.lit(0)), 3)
    return writes.touch(rows, F.col("role") == "user", F.lit(1800000000)).select("id", "accessed_s")


@query("d13_set_importance", "SELECT id, CASE WHEN id % 4 = 0 THEN 0.9e0 ELSE importance END AS importance FROM @nodes")
def _(t: Tables) -> DataFrame:
    new = t.nodes.filter("id % 4 = 0").select("id", F.lit(0.9).alias("importance"))
    return writes.set_importance(t.nodes.withColumn("updated_s", F.lit(0)), new, F.lit(1)).select("id", "importance")


@query("d14_remove_file", "SELECT id FROM @functions WHERE file_path NOT IN ('src/brand_1.ts', 'src/brand_2.ts')")
def _(t: Tables) -> DataFrame:
    return writes.remove_file(t.functions, t.spark.createDataFrame([("src/brand_1.ts",), ("src/brand_2.ts",)], "file_path string")).select("id")


@query("d15_batch", "SELECT id, CASE WHEN id % 5 = 1 THEN 1e0 ELSE importance END AS importance FROM @nodes WHERE id % 5 <> 0")
def _(t: Tables) -> DataFrame:
    changed = t.nodes.filter("id % 5 = 1").select("id", F.lit(1.0).alias("importance"))
    return writes.apply_batch(t.nodes, t.edges, changed=changed, gone=t.nodes.filter("id % 5 = 0"))[0].select("id", "importance")


@query("d12_embed", "SELECT id, 16 AS size FROM @functions")
def _(t: Tables) -> DataFrame:
    from quillgraph.functions.vector import hashed_embedding

    return writes.embed_missing(t.functions, hashed_embedding(16), "name").select("id", F.size("embedding").alias("size"))


@query("s03_put_and_remove", "SELECT path, CASE WHEN id % 2 = 0 THEN 'new' ELSE content END AS content FROM @docs WHERE id % 3 <> 0")
def _(t: Tables) -> DataFrame:
    from quillgraph.sources import corpus

    docs = t.docs.select("id", "path", "content", "category", "size", F.lit(0).alias("modified"))
    new = docs.filter("id % 2 = 0").select("id", "path", F.lit("new").alias("content"))
    return corpus.remove(corpus.put(docs, new, F.lit(1)), docs.filter("id % 3 = 0")).select("path", "content")


@query("s06_category_edges", "SELECT path AS src, concat('category:', category) AS dst FROM @docs")
def _(t: Tables) -> DataFrame:
    from quillgraph.sources import corpus

    return corpus.category_edges(t.docs)[1].select("src", "dst")


@query("s07_list_newest", "SELECT path FROM @docs WHERE starts_with(path, 'src1')")
def _(t: Tables) -> DataFrame:
    from quillgraph.sources import corpus

    return corpus.under(t.docs.withColumn("modified", F.col("modified_s")), "src1").select("path")


@query("s09_statements", "SELECT concat('MATCH (a {id: ''', src, '''}), (b {id: ''', dst, '''}) CREATE (a)-[:', edge_type, ']->(b)') AS line FROM @edges UNION ALL SELECT concat('CREATE (:', upper(substr(node_type, 1, 1)), substr(node_type, 2), ' {id: ''', id, ''', content: ''', content, '''})') FROM @nodes")
def _(t: Tables) -> DataFrame:
    from quillgraph.sources import logs

    return logs.graph_statements(t.nodes, t.edges).select("line")


@query("s11_tree", "SELECT '' AS dir, source AS entry, true AS is_dir FROM @docs GROUP BY source UNION ALL SELECT source, concat(id, '.md'), false FROM @docs")
def _(t: Tables) -> DataFrame:
    return search.tree(t.docs)


@query("s17_prometheus", "SELECT name, count(*) AS lines FROM @samples GROUP BY name")
def _(t: Tables) -> DataFrame:
    from quillgraph.sources import logs

    return logs.prometheus(t.samples).groupBy(F.regexp_extract("line", r"^(\w+)\{", 1).alias("name")).agg(F.count("*").alias("lines"))


@query("s19_migration", "SELECT 'document' AS node_type, count(*) AS nodes FROM @docs UNION ALL SELECT 'concept', count(*) FROM @docs")
def _(t: Tables) -> DataFrame:
    from quillgraph.sources import corpus

    docs = t.docs.select("path", F.concat(F.lit("# Part "), "id", F.lit("\nplain")).alias("content"))
    return corpus.migration_stats(corpus.migrate(docs)).filter("node_type IN ('document', 'concept')").select("node_type", "nodes")


@query("s20_vectors", "SELECT id FROM @vectors WHERE embedding IS NOT NULL")
def _(t: Tables) -> DataFrame:
    from quillgraph.sources import corpus

    return corpus.vectors(t.vectors).select("id")


# ---------------------------------------------------------------- ordered operators


@query("w01_verify_chain", "SELECT event_id, CASE event_id WHEN '17' THEN 'content changed' END AS issue, row_number() OVER (PARTITION BY log ORDER BY second, event_id) = 1 AS first FROM (SELECT CAST(event_id AS VARCHAR) AS event_id, second, user_id % 8 AS log FROM @audit)")
def _(t: Tables) -> DataFrame:
    events = t.audit.select(F.col("event_id").cast("string").alias("event_id"), F.lpad(F.col("second").cast("string"), 12, "0").alias("timestamp"), "event_type", "action", "resource", "result", (F.col("user_id") % 8).alias("log"))
    chained = audit.build_chain(events, "log")
    changed = chained.withColumn("action", F.when(F.col("event_id") == "17", "changed").otherwise(F.col("action")))
    return audit.verify(changed, "log").select("event_id", "issue", (F.col("previous_hash") == audit.GENESIS).alias("first"))


@query("w01_hashes", """WITH e AS (SELECT event_id, second, lag(event_id) OVER (PARTITION BY user_id ORDER BY second, event_id) AS before FROM @audit) SELECT event_id, sha256(concat(event_id, '|', second, '|', coalesce(before, 0))) AS hash FROM e""")
def _(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window as W

    before = F.coalesce(F.lag("event_id").over(W.partitionBy("user_id").orderBy("second", "event_id")), F.lit(0))
    return t.audit.select("event_id", F.sha2(F.concat_ws("|", "event_id", "second", before), 256).alias("hash"))


@query("w02_moving_average", "SELECT name, round(sum(value * power(0.8e0, n - i) * CASE WHEN i = 1 THEN 1e0 ELSE 0.2e0 END), 5) AS ema FROM (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY second, id) AS i, count(*) OVER (PARTITION BY name) AS n FROM @samples) GROUP BY name")
def _(t: Tables) -> DataFrame:
    return windows.moving_average(t.samples, "name", ["second", "id"], "value").select("name", F.round("ema", 5).alias("ema"))


@query("w03_running", "SELECT event_id, round(avg(value) OVER w, 9) AS running_mean, round(avg(CASE WHEN result = 'success' THEN 1e0 ELSE 0e0 END) OVER w, 6) AS success_rate FROM @audit WINDOW w AS (PARTITION BY user_id ORDER BY second, event_id ROWS UNBOUNDED PRECEDING)")
def _(t: Tables) -> DataFrame:
    # sums of decimals don't depend on where chunks end; means of cents over up to 255 rows have no ties at nine digits
    rows = t.audit.withColumn("ok", F.col("result") == "success").withColumn("value", F.col("value").cast("decimal(28, 8)"))
    return windows.running(rows, "user_id", ["second", "event_id"], "value", "ok").select("event_id", F.round("running_mean", 9).alias("running_mean"), r6("success_rate").alias("success_rate"))


@query("w04_sliding_limiter", """WITH RECURSIVE o AS (SELECT user_id, event_id, second, row_number() OVER (PARTITION BY user_id ORDER BY second, event_id) AS i FROM @audit),
    r AS (SELECT user_id, event_id, i, true AS allowed, [second] AS acc FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.event_id, o.i, len(list_filter(r.acc, lambda a: a > o.second - 86400)) < 3, CASE WHEN len(list_filter(r.acc, lambda a: a > o.second - 86400)) < 3 THEN list_append(list_filter(r.acc, lambda a: a > o.second - 86400), o.second) ELSE list_filter(r.acc, lambda a: a > o.second - 86400) END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
    SELECT event_id, allowed FROM r""")
def _(t: Tables) -> DataFrame:
    return windows.sliding_limiter(t.audit, "user_id", ("second", "event_id"), 3, 86400).select("event_id", "allowed")


@query("w05_block_limiter", """WITH RECURSIVE o AS (SELECT user_id, event_id, second AS t, row_number() OVER (PARTITION BY user_id ORDER BY second, event_id) AS i FROM @audit),
    r AS (SELECT user_id, event_id, i, t AS start, 1 AS used, CAST(0 AS BIGINT) AS until, true AS allowed FROM o WHERE i = 1
    UNION ALL SELECT o.user_id, o.event_id, o.i,
        CASE WHEN o.t < r.until THEN r.start WHEN r.start < 0 OR o.t >= r.start + 86400 THEN o.t WHEN r.used + 1 > 3 THEN -1 ELSE r.start END,
        CASE WHEN o.t < r.until THEN r.used WHEN r.start < 0 OR o.t >= r.start + 86400 THEN 1 ELSE r.used + 1 END,
        CASE WHEN o.t < r.until THEN r.until WHEN NOT (r.start < 0 OR o.t >= r.start + 86400) AND r.used + 1 > 3 THEN o.t + 172800 ELSE r.until END,
        CASE WHEN o.t < r.until THEN false WHEN r.start < 0 OR o.t >= r.start + 86400 THEN true ELSE r.used + 1 <= 3 END
    FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
    SELECT event_id, allowed FROM r""")
def _(t: Tables) -> DataFrame:
    return windows.block_limiter(t.audit, "user_id", ("second", "event_id"), (3, 86400, 172800)).select("event_id", "allowed")


@query("w08_attention", "SELECT id, round(coalesce(w / nullif(sum(w) OVER (PARTITION BY session), 0), 0), 6) AS attention FROM (SELECT id, session, priority * importance * CASE WHEN focused THEN 2e0 ELSE 1e0 END AS w FROM @items)")
def _(t: Tables) -> DataFrame:
    return windows.attention(t.items).select("id", r6("attention").alias("attention"))


@query("w09_evict", "SELECT id FROM (SELECT id, focused, row_number() OVER (PARTITION BY session ORDER BY focused, importance, id) AS k, count(*) OVER (PARTITION BY session) AS n FROM @items) WHERE n >= 5 AND NOT focused AND k <= 1")
def _(t: Tables) -> DataFrame:
    return windows.evict(t.items, 5).filter("evicted").select("id")


@query("w10_lru", "SELECT id FROM @nodes WHERE created_s + 4000000 > 1695000000 ORDER BY accessed_s DESC, id LIMIT 100")
def _(t: Tables) -> DataFrame:
    rows = t.nodes.select(F.col("id").alias("key"), F.col("accessed_s").alias("last_s"), "created_s")
    return windows.lru(rows, 100, F.lit(1695000000), 4000000).filter("kept").select(F.col("key").alias("id"))


@query("w11_transitions", "SELECT id, CASE WHEN hit AND NOT coalesce(was, false) THEN 'fired' ELSE 'resolved' END AS transition FROM (SELECT id, value > 50 AS hit, lag(value > 50) OVER (PARTITION BY name ORDER BY second, id) AS was FROM @samples) WHERE hit <> coalesce(was, false)")
def _(t: Tables) -> DataFrame:
    return windows.transitions(t.samples, "name", ["second", "id"], F.col("value") > 50).select("id", "transition")


@query("w12_trend", """WITH r AS (SELECT * FROM @samples WHERE second > 1705000000 - 864000 AND second <= 1705000000), f AS (SELECT name, count(*) AS n, (max_by(value, second * 1000000 + value) - min_by(value, second * 1000000 + value)) / (max(second) - min(second)) AS rate FROM r GROUP BY name)
    SELECT name, n, round(rate, 9) AS rate, CASE WHEN abs(rate) < 0.00001 THEN 'stable' WHEN rate > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM f""")
def _(t: Tables) -> DataFrame:
    return windows.trend(t.samples, "name", "second", "value", F.lit(1705000000), 864000, 0.00001).select("name", "n", F.round("rate", 9).alias("rate"), "direction")


@query("w13_first_match", "SELECT name, min(id) AS id FROM @functions GROUP BY name")
def _(t: Tables) -> DataFrame:
    return windows.first_of(t.functions, ["name"], ["id"]).select("name", "id")


@query("w14_run_trend", "SELECT day, n, CASE WHEN b IS NULL THEN 'stable' WHEN n > b * 1.1 THEN 'increasing' WHEN n < b * 0.9 THEN 'decreasing' ELSE 'stable' END AS trend FROM (SELECT day, n, lag(n) OVER (ORDER BY day) AS b FROM (SELECT CAST(floor(second / 86400) AS BIGINT) AS day, count(*) AS n FROM @audit GROUP BY 1))")
def _(t: Tables) -> DataFrame:
    days = t.audit.groupBy(F.floor(F.col("second") / 86400).alias("day")).agg(F.count("*").alias("n"))
    return windows.run_trend(days, ["day"], "n")


# ---------------------------------------------------------------- set operations


@query("u01_hybrid_search", f"""WITH h AS (SELECT *, 0 AS source FROM @nodes WHERE contains(content, 'red') UNION ALL SELECT *, 1 FROM @nodes WHERE importance > 0.8 UNION ALL SELECT *, 2 FROM @nodes WHERE created_s > 1694000000), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source DESC) AS k FROM h) WHERE k = 1)
    SELECT id, source, round({RANK_SCORE}, 6) AS score FROM d ORDER BY score DESC, id LIMIT 50""")
def _(t: Tables) -> DataFrame:
    n = t.nodes
    hits = [n.filter(F.contains("content", F.lit("red"))), n.filter("importance > 0.8"), n.filter("created_s > 1694000000")]
    return search.hybrid_search(hits, F.lit(1700000000.0), 50).select("id", "source", r6("rank_score").alias("score"))


@query("u02_hits_and_neighbours", "SELECT id FROM @nodes WHERE node_type = 'question' AND importance > 0.9 UNION SELECT dst FROM @edges WHERE edge_type = 'CALLS' AND src IN (SELECT id FROM @nodes WHERE node_type = 'question' AND importance > 0.9)")
def _(t: Tables) -> DataFrame:
    hits = t.nodes.filter("node_type = 'question' AND importance > 0.9").select("id")
    near = t.edges.filter("edge_type = 'CALLS'").join(hits.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    return hits.unionByName(near).distinct()


@query("u04_distinct_files", "SELECT DISTINCT file_path FROM @functions")
def _(t: Tables) -> DataFrame:
    return t.functions.select("file_path").distinct()


@query("u06_action_plan", "SELECT id, CASE WHEN severity = 'critical' OR (severity = 'warning' AND magnitude = 'high') THEN 'immediate' WHEN severity = 'warning' AND effort <> 'significant' THEN 'short_term' WHEN magnitude = 'high' THEN 'long_term' ELSE 'none' END AS plan FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, CASE id % 4 WHEN 0 THEN 'high' ELSE 'low' END AS magnitude, CASE id % 5 WHEN 0 THEN 'significant' ELSE 'minimal' END AS effort FROM @functions)")
def _(t: Tables) -> DataFrame:
    from quillgraph.operators.code import action_plan

    rows = t.functions.selectExpr("id", "CASE id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity", "CASE id % 4 WHEN 0 THEN 'high' ELSE 'low' END AS magnitude", "CASE id % 5 WHEN 0 THEN 'significant' ELSE 'minimal' END AS effort")
    return action_plan(rows).select("id", "plan")


@query("u07_interface_changed", "SELECT DISTINCT file_path FROM @functions WHERE name IN (SELECT name FROM @functions WHERE id = 3)")
def _(t: Tables) -> DataFrame:
    from quillgraph.operators.code import interface_changed

    gone = t.functions.filter("id = 3").select("name")
    return interface_changed(t.functions, t.functions.join(gone, "name", "left_anti"))


@query("u08_dependents", "SELECT DISTINCT src AS file_path FROM @edges WHERE edge_type = 'IMPORTS' AND dst IN (1, 2, 3)")
def _(t: Tables) -> DataFrame:
    from quillgraph.operators.code import dependents

    return dependents(t.spark.createDataFrame([(1,), (2,), (3,)], "file_path long"), t.edges.filter("edge_type = 'IMPORTS'"))


# ---------------------------------------------------------------- streams, over tables


@query("x01_debounce", """WITH e AS (SELECT event_id, user_id, second, event_type, props, CASE WHEN second - lag(second) OVER (PARTITION BY user_id ORDER BY ts, props) >= 3600 THEN 1 ELSE 0 END AS apart, ts FROM (SELECT *, epoch_us(ts) / 1000000e0 AS second FROM events)),
    b AS (SELECT *, sum(apart) OVER (PARTITION BY user_id ORDER BY ts, props ROWS UNBOUNDED PRECEDING) AS burst FROM e) SELECT user_id, CAST(burst AS BIGINT) AS burst, props AS path, count(*) AS events FROM b GROUP BY 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    rows = t.raw("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("path"), F.col("event_type").alias("change"))
    return changes.debounce_batch(rows, 3600, ["user_id"]).select("user_id", "burst", "path", "events")


@query("x01_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY user_id""")
def _(t: Tables) -> DataFrame:
    rows = t.raw("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return monitor.sessions(rows).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


@query("x03_changed_files", "SELECT id FROM @docs WHERE id % 10 = 0")
def _(t: Tables) -> DataFrame:
    files = t.docs.select("id", "path", "content")
    known = changes.content_hash(files.withColumn("content", F.when(F.col("id") % 10 == 0, "old").otherwise(F.col("content"))))
    return changes.changed(files, known).select("id")


@query("x05_snapshot_diff", "SELECT path, CASE WHEN id % 10 = 0 THEN 'change' WHEN id % 10 = 1 THEN 'add' ELSE 'unlink' END AS change FROM @docs WHERE id % 10 IN (0, 1, 2)")
def _(t: Tables) -> DataFrame:
    d = t.docs
    before = d.filter("id % 10 <> 1").select("path", F.lit(1).alias("hash"))
    after = d.filter("id % 10 <> 2").select("path", F.when(F.col("id") % 10 == 0, 2).otherwise(1).alias("hash"))
    return changes.snapshot_diff(before, after)


@query("x08_alert_values", "SELECT w, name, n, round(high, 6) AS high, high > 100 AS triggered FROM (SELECT CAST(floor(second / 3600) AS BIGINT) AS w, name, count(*) AS n, max(value) AS high FROM @samples GROUP BY 1, 2)")
def _(t: Tables) -> DataFrame:
    rows = t.raw("events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("name"), "value")
    values = monitor.windows(rows, "1 hour").select(F.floor(F.unix_timestamp("w.start") / 3600).alias("w"), "name", "n", F.col("high").alias("value"))
    rules = values.select("name").distinct().select(F.col("name").alias("rule"), F.col("name").alias("metric"), F.lit(">").alias("op"), F.lit(100.0).alias("bound"), F.lit("high").alias("severity"))
    return monitor.evaluate(values, rules).select("w", "name", "n", r6("value").alias("high"), "triggered")
