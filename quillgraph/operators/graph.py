"""Property-graph operators over an edge table (src, dst, edge_type, weight) and node tables with an id.

Bounded enumeration of paths prunes inside each step; reachability, distances and cycles at scale use frontiers, which carry
each vertex once. Frontiers are cut by checkpoints in the folder that the session names.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillgraph.operators import circuits, scan
from quillgraph.session import shared_dir


def keep(df: DataFrame) -> DataFrame:
    """df written once to the folder that driver and executors share."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def of_type(edges: DataFrame, *types: str) -> DataFrame:
    return edges.filter(F.col("edge_type").isin(*(t.upper() for t in types)))


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    swapped = edges.select(*(F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns))
    return edges.unionByName(swapped)


def neighbours(edges: DataFrame, nodes: DataFrame, start, min_weight: float = 0.0, limit: int = 10) -> DataFrame:
    """One hop either way from start: the nodes with edge_type and weight, heaviest first."""
    near = undirected(edges.filter((F.col("weight") >= min_weight) & ((F.col("src") == start) | (F.col("dst") == start)))).filter(F.col("src") == start)
    return near.select(F.col("dst").alias("id"), "edge_type", "weight").join(nodes, "id").orderBy(F.desc("weight"), "id", "edge_type").limit(limit)


def out_of(edges: DataFrame, nodes: DataFrame, start, edge_type: str) -> DataFrame:
    """Nodes that start points to: callees, imports."""
    return of_type(edges, edge_type).filter(F.col("src") == start).select(F.col("dst").alias("id")).distinct().join(nodes, "id")


def into(edges: DataFrame, nodes: DataFrame, end, edge_type: str) -> DataFrame:
    """Nodes that point to end: callers, implementers."""
    return of_type(edges, edge_type).filter(F.col("dst") == end).select(F.col("src").alias("id")).distinct().join(nodes, "id")


def without(nodes: DataFrame, edges: DataFrame, side: str, edge_type: str | None = None) -> DataFrame:
    """Nodes that are no edge's src, dst or, with side `both`, either."""
    used = of_type(edges, edge_type) if edge_type else edges
    ends = used.select(F.col(side).alias("id")) if side != "both" else used.select(F.col("src").alias("id")).union(used.select("dst"))
    return nodes.join(ends, "id", "left_anti")


def with_relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node with the sorted list of its outgoing (edge_type, dst)."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set(F.struct("edge_type", "dst"))).alias("relationships"))
    return nodes.join(out, "id", "left").withColumn("relationships", F.coalesce("relationships", F.array().cast(out.schema["relationships"].dataType)))


#: Members that a chunk of one signature and file has about, in same_signature.
MEMBERS = 1000


def same_signature(functions: DataFrame) -> DataFrame:
    """Pairs of functions of one signature in different files, both orders.

    Members of a signature and file are put in chunks of about MEMBERS; chunks of one signature are joined, their pairs are dealt
    over several tasks a core and are expanded there. So neither a signature nor the few tasks of a small table have all the work.
    Generated code holds all rows that it makes of one, so a member and its partners are expanded in two stages of code: coalesce,
    which moves nothing here, parts them, and a task holds a member's pairs in place of a chunk's.
    """
    rows = functions.select("signature", "file_path", "id", "line_count").filter("signature IS NOT NULL AND file_path IS NOT NULL")
    own = ["signature", "file_path"]
    large = rows.groupBy(*own).agg(F.ceil(F.count("*") / MEMBERS).alias("parts")).filter("parts > 1")  # a row for each MEMBERS rows at most
    placed = rows.join(F.broadcast(large), own, "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))))
    held = placed.groupBy(*own, "part").agg(F.collect_list(F.struct("id", "line_count")).alias("members"))
    part = lambda n: (F.col(c).alias(f"{c}{n}") for c in ("file_path", "part"))
    left = held.select("signature", *part(1), F.col("members.id").alias("ids1"), F.col("members.line_count").alias("lines1"))  # apart, so that what isn't asked for isn't sent
    right = held.select("signature", *part(2), F.col("members.id").alias("ids2"))
    pairs = left.join(right.hint("merge"), "signature").filter("file_path1 <> file_path2")
    tasks = 8 * functions.sparkSession.sparkContext.defaultParallelism
    dealt = pairs.repartition(tasks, "signature", "file_path1", "part1", "file_path2", "part2")
    one = dealt.select("signature", "file_path1", "file_path2", "ids2", "lines1", F.posexplode("ids1").alias("n", "id1"))
    one = one.select("signature", "id1", "file_path1", F.col("lines1")[F.col("n")].alias("line_count1"), "ids2", "file_path2").coalesce(tasks)
    both = one.select("signature", "id1", "file_path1", "line_count1", F.explode("ids2").alias("id2"), "file_path2")
    return both.filter("id1 <> id2")


def first_same_signature(functions: DataFrame, limit: int) -> DataFrame:
    """The first rows of same_signature by line_count1 (longest first), id1 and id2, without the others.

    Each function with a partner has one row at least, so these are rows of the first such functions, as many as the limit.
    """
    rows = functions.select("signature", "file_path", "id", "line_count")
    files = rows.groupBy("signature", F.col("file_path").alias("file_path2")).agg(F.min("id").alias("least"), F.max("id").alias("most"))
    other = (F.col("a.signature") == F.col("b.signature")) & (F.col("file_path") != F.col("file_path2")) & ((F.col("least") != F.col("id")) | (F.col("most") != F.col("id")))
    first = rows.alias("a").join(files.alias("b"), other, "left_semi").orderBy(F.desc("line_count"), "id").limit(limit)
    a = first.select("signature", *(F.col(c).alias(f"{c}1") for c in ("id", "file_path", "line_count")))
    b = rows.select("signature", F.col("id").alias("id2"), F.col("file_path").alias("file_path2"))
    pairs = b.join(F.broadcast(a), "signature").filter("id1 <> id2 AND file_path1 <> file_path2")  # as many rows as the limit
    return pairs.orderBy(F.desc("line_count1"), "id1", "id2").limit(limit).select("signature", "id1", "file_path1", "line_count1", "id2", "file_path2")


def overridden(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """child, parent and the ids of two functions of one name and signature that they define."""
    defines = of_type(edges, "DEFINES").select(F.col("src").alias("class"), F.col("dst").alias("id")).join(functions.select("id", "name", "signature"), "id")
    pairs = of_type(edges, "EXTENDS").select(F.col("src").alias("child"), F.col("dst").alias("parent")).distinct()
    own = defines.select(F.col("class").alias("child"), F.col("id").alias("method"), "name", "signature")
    other = defines.select(F.col("class").alias("parent"), F.col("id").alias("overrides"), "name", "signature")
    return pairs.join(own, "child").join(other, ["parent", "name", "signature"]).select("child", "parent", "method", "overrides")


def wedges(edges: DataFrame, nodes: DataFrame, types: tuple[str, ...] = ("fact", "event"), limit: int = 20) -> DataFrame:
    """a - b - c with a < c, all of the given kinds, the first by ids.

    Of b's neighbours only the first limit + 1 can be in these: with more, the least of them as a gives enough rows alone. So
    a hub's pairs are bounded by the limit, not by its degree.
    """
    kinds = nodes.filter(F.col("node_type").isin(*types)).select("id", "node_type", "content")
    ends = undirected(edges.select("src", "dst")).distinct().join(kinds.select(F.col("id").alias("src")), "src", "left_semi").join(kinds.select(F.col("id").alias("dst")), "dst", "left_semi")
    place = F.row_number().over(W.partitionBy("dst").orderBy("src"))
    first = ends.filter("src <> dst").withColumn("place", place).filter(F.col("place") <= limit + 1)
    one = first.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    two = first.select(F.col("dst").alias("b"), F.col("src").alias("c"))
    return one.join(two, "b").filter("a < c").orderBy("a", "b", "c").limit(limit).select("a", "b", "c")


def contradictions(edges: DataFrame, facts: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Pairs of facts (a < b) that an edge says contradict each other."""
    pairs = of_type(edges, "CONTRADICTS").filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    sure = facts.filter(F.col("confidence") > min_confidence)
    side = lambda k: sure.select(*(F.col(c).alias(f"{k}{'' if c == 'id' else '_' + c}") for c in ("id", "confidence", "created_s")))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def resolve_contradictions(pairs: DataFrame, gap: float = 0.2, symmetric: bool = True) -> DataFrame:
    """Which of two facts stays: the surer by more than gap, else the newer, else neither is dropped."""
    newer = F.when(F.col("a_created_s") > F.col("b_created_s"), F.col("a"))
    newer = newer.when(F.col("b_created_s") > F.col("a_created_s"), F.col("b")) if symmetric else newer
    winner = F.when(F.col("a_confidence") - F.col("b_confidence") > gap, F.col("a")).when(F.col("b_confidence") - F.col("a_confidence") > gap, F.col("b")).otherwise(newer)
    return pairs.withColumn("keep", winner)


def contained(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """For each inner row the innermost other outer row of the same file whose lines hold it: inner_id, outer_id.

    Innermost: of fewest lines, then the latest start, then the least id. An outer row is put in the dyadic block of each size that
    its start lies in; the starts up to an inner row's are a few such blocks, one for each bit of its line. In a block, rows go by
    their ends from the last on, and an inner row gets the least of what came before, by scans whose chunks split large files. So
    rows grow with the number of bits of a line, and no file's rows meet all in all. Rows without lines are in nothing.
    """
    o = outer.select("file_path", F.col("id").alias("outer_id"), F.col("line").cast("long").alias("o1"), F.col("end_line").cast("long").alias("o2")).filter("o1 >= 0 AND o2 IS NOT NULL").distinct()
    i = inner.select("file_path", F.col("id").alias("inner_id"), F.col("line").cast("long").alias("i1"), F.col("end_line").cast("long").alias("i2")).filter("i1 >= 0 AND i2 IS NOT NULL")
    bits = ((i.agg(F.max("i1")).first()[0] or 0) + 1).bit_length()
    level = F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("level")
    held = o.select("*", level).select("file_path", "level", F.expr("shiftright(o1, level)").alias("block"), (-F.col("o2")).alias("from_end"), F.lit(0).alias("kind"), "outer_id", F.lit(None).cast(i.schema["inner_id"].dataType).alias("inner_id"), F.struct((F.col("o2") - F.col("o1")).alias("lines"), (-F.col("o1")).alias("later"), "outer_id").alias("it"))
    asked = i.select("*", level).filter("shiftright(i1 + 1, level) % 2 = 1").select("file_path", "level", F.expr("shiftright(i1 + 1, level) - 1").alias("block"), (-F.col("i2")).alias("from_end"), F.lit(1).alias("kind"), F.lit(None).cast(o.schema["outer_id"].dataType).alias("outer_id"), "inner_id", F.lit(None).cast(held.schema["it"].dataType).alias("it"))
    order = ["from_end", "kind", "outer_id", "inner_id"]
    both = scan.chunks(held.unionByName(asked), ["file_path", "level", "block"], order)
    least = scan.totals(both, order, smallest=("least",), least=F.col("it"))
    # the second least of a stream is the least of what each member or the least before it was, whichever is greater
    prior = scan.shifted(least, order, prior=F.col("least"))
    second = scan.totals(prior, order, smallest=("second",), second=F.when(F.col("prior").isNotNull() & F.col("it").isNotNull(), F.greatest("it", "prior")))
    found = second.filter("kind = 1").select("inner_id", F.explode(F.array("least", "second")).alias("it")).filter("it IS NOT NULL AND it.outer_id <> inner_id")
    return found.groupBy("inner_id").agg(F.min("it").alias("it")).select("inner_id", "it.outer_id")


def reach(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """src, id, depth: for every start (a frame of id) all vertices that edges lead to in max_depth steps at most, by the fewest of at least one.

    All starts go on together, a join by vertex a round; a pair of start and vertex is followed once.
    """
    links = keep(edges.select("src", "dst").distinct())
    front = keep(starts.select(F.col("id").alias("src")).distinct().join(links, "src").select("src", F.col("dst").alias("id"), F.lit(1).alias("depth")))
    rounds = [front]
    for depth in range(2, max_depth + 1):
        found = front.select(F.col("src").alias("from"), F.col("id").alias("src")).join(links, "src").select(F.col("from").alias("src"), F.col("dst").alias("id")).distinct()
        seen = reduce(DataFrame.unionByName, rounds).select("src", "id")
        front = keep(found.join(seen, ["src", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        rounds.append(front)
    return reduce(DataFrame.unionByName, rounds)


#: Starts of the first and the second round of first_reached; a third has the rest.
STARTS = (1_000, 100_000)


def first_reached(edges: DataFrame, starts: DataFrame, ends: DataFrame, min_depth: int, max_depth: int, limit: int) -> DataFrame:
    """The first rows of reach that end in ends (a frame of id), from min_depth on, by depth (deepest first), src and id, without the others.

    Rows of one depth go by src, so the least starts with enough rows at the greatest depth hold the first ones. Starts are taken
    in their order, more each round, until these rows are found or no start is left.
    """
    links = keep(edges.select("src", "dst").distinct())
    todo, taken = keep(starts.select("id").distinct().join(links.select(F.col("src").alias("id")), "id", "left_semi")), []
    for most in (*STARTS, None):
        last = todo.orderBy("id").limit(most).agg(F.max("id")).first()[0] if most else None
        now = todo.filter(F.col("id") <= F.lit(last)) if most else todo
        found = reach(links, now, max_depth).filter(F.col("depth") >= min_depth).join(ends.select("id"), "id", "left_semi")
        taken.append(keep(found.orderBy(F.desc("depth"), "src", "id").limit(limit)))
        first = reduce(DataFrame.unionByName, taken).orderBy(F.desc("depth"), "src", "id").limit(limit).select("src", "id", "depth")
        todo = todo.filter(F.col("id") > F.lit(last))
        if first.filter(F.col("depth") == max_depth).count() == limit or todo.isEmpty():
            break
    return first


def distances(edges: DataFrame, starts: DataFrame, max_depth: int = 10, directed: bool = False, with_parent: bool = False) -> DataFrame:
    """id, depth (and parent) of every vertex within max_depth of a start (a frame of id); each vertex is expanded once.

    What a round found is held against all earlier rounds; without directions against the last two, as a neighbour of a vertex
    is at most one round older.
    """
    links = keep((edges if directed else undirected(edges)).select("src", "dst").distinct())
    parent = F.lit(None).cast(links.schema["src"].dataType)
    front = keep(starts.select("id").distinct().withColumn("depth", F.lit(0)).withColumn("parent", parent))
    rounds, recent = [front], [front]
    for depth in range(1, max_depth + 1):
        found = front.select(F.col("id").alias("src")).join(links, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        seen = reduce(DataFrame.unionByName, rounds if directed else recent).select("id")
        front = keep(found.join(seen, "id", "left_anti").select("id", F.lit(depth).alias("depth"), "parent"))
        if front.isEmpty():
            break
        rounds.append(front)
        recent = [*recent, front][-2:]
        if len(rounds) > 8:  # so that plans stay short
            rounds = [keep(reduce(DataFrame.unionByName, rounds))]
    seen = reduce(DataFrame.unionByName, rounds)
    return seen if with_parent else seen.drop("parent")


def shortest_path(edges: DataFrame, start, end, max_depth: int = 10, directed: bool = False) -> list:
    """The vertices of one shortest path, start and end included; empty if there is none. Only the path comes to the driver."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType
    tree = distances(edges, spark.createDataFrame([(start,)], "x string").select(F.col("x").cast(kind).alias("id")) if not isinstance(start, int) else spark.createDataFrame([(start,)], "id long"), max_depth, directed, with_parent=True)
    path, at = [], end
    for _ in range(max_depth + 1):
        row = tree.filter(F.col("id") == at).select("parent", "depth").first()
        if row is None:
            return []
        path.append(at)
        if row["depth"] == 0:
            return path[::-1]
        at = row["parent"]
    return []


def paths(edges: DataFrame, start, max_hops: int = 3, min_weight: float = 0.0, min_confidence: float = 0.0, directed: bool = False) -> DataFrame:
    """Simple paths from start: id, path, depth, confidence (the product of weights); pruned as they grow.

    Meant for pruned or short walks; use distances for reachability.
    """
    usable = (edges if directed else undirected(edges)).filter(F.col("weight") >= min_weight).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    step = keep(usable)
    kind = edges.schema["src"].dataType
    first = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("id"), F.array(F.lit(start).cast(kind)).alias("path"), F.lit(0).alias("depth"), F.lit(1.0).alias("confidence"))
    front, out = first, None
    for _ in range(max_hops):
        longer = front.withColumnRenamed("id", "src").join(step, "src").filter(~F.array_contains("path", F.col("dst")))
        longer = longer.select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"), (F.col("depth") + 1).alias("depth"), (F.col("confidence") * F.col("weight")).alias("confidence"))
        front = keep(longer.filter(F.col("confidence") >= min_confidence))
        out = front if out is None else out.unionByName(front)
    return out


def multi_hop(edges: DataFrame, nodes: DataFrame, start, target_types: tuple[str, ...], max_hops: int = 3, min_weight: float = 0.5, min_confidence: float = 0.5, limit: int = 20) -> DataFrame:
    """The surest paths from start to nodes of the given kinds."""
    ends = nodes.filter(F.col("node_type").isin(*target_types)).select("id", "node_type")
    found = paths(edges, start, max_hops, min_weight, min_confidence)
    return found.join(ends, "id").withColumn("trail", F.array_join(F.col("path").cast("array<string>"), ">")).orderBy(F.desc(F.round("confidence", 9)), "depth", "trail").limit(limit)


def hierarchy(edges: DataFrame, start, edge_type: str = "EXTENDS", max_depth: int = 5) -> DataFrame:
    """id, direction (up: what start extends; down: what extends it; self), depth."""
    links = of_type(edges, edge_type)
    one = edges.sparkSession.range(1).select(F.lit(start).cast(edges.schema["src"].dataType).alias("id"))
    up = distances(links, one, max_depth, directed=True).filter("depth > 0").withColumn("direction", F.lit("up"))
    down = distances(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")), one, max_depth, directed=True).filter("depth > 0").withColumn("direction", F.lit("down"))
    return up.unionByName(down).unionByName(one.select("id", F.lit(0).alias("depth"), F.lit("self").alias("direction")))


#: Walks of half a cycle that a round of cycles has about, the most rounds, and the most edges that each task holds whole.
WALKS, ROUNDS, LINKS = 4_000_000, 64, 32_000_000


def cycles(edges: DataFrame, min_length: int = 3, max_length: int = 5, limit: int | None = 20) -> DataFrame:
    """Simple directed cycles once each, from their least vertex: cycle (array), length; shortest first.

    Least vertices are dealt over rounds of about WALKS walks of half a cycle. Up to LINKS edges between whole numbers go to
    each task (8 bytes an edge; see circuits), and their rounds are one stage of whoever reads the cycles. Otherwise a cycle is
    met in the middle by joins: a walk ahead of its least vertex and one that ends there, both over vertices above it; a round
    keeps the cycles it found, and its shuffles go when it ends. With a limit, longer cycles are only looked for while shorter
    ones don't fill it.
    """
    links = keep(edges.filter("src <> dst").select("src", "dst").distinct())
    held = circuits.load(links) if circuits.fits(links, LINKS) else None
    shared = held and edges.sparkSession.sparkContext.broadcast(held)
    kind = links.schema["src"].dataType.simpleString()
    out = [edges.sparkSession.createDataFrame([], f"cycle array<{kind}>, length int")]
    found = 0
    for lengths in [[n] for n in range(min_length, max_length + 1)] if limit else [range(min_length, max_length + 1)]:
        rounds = cycle_rounds(links, lengths, shared)
        out += rounds
        found += reduce(DataFrame.unionByName, rounds).count() if limit else 0
        if limit and found >= limit:
            break
    every = reduce(DataFrame.unionByName, out)
    return every.orderBy("length", "cycle").limit(limit) if limit else every


def cycle_rounds(links: DataFrame, lengths: Iterable[int], shared=None) -> list[DataFrame]:
    """The simple cycles of the given lengths, by rounds: of the shared graph of circuits, or kept one after the other."""
    spark, longest = links.sparkSession, max(lengths, default=0)
    half = (longest + 1) // 2 + 1
    if shared:
        total = circuits.walks(*shared.value[1:3], (longest + 1) // 2).sum()
        return circuits.rounds(links, shared, lengths, min(ROUNDS, max(1, ceil(total / half / WALKS))))
    step = links.select(F.col("src").alias("from"), F.col("dst").alias("to"))
    walks = links.select(F.col("dst").alias("from"), F.lit(1.0).alias("n"))
    for _ in range((longest + 1) // 2 - 1):  # how many walks end in each vertex
        walks = walks.groupBy("from").agg(F.sum("n").alias("n")).join(step, "from").select(F.col("to").alias("from"), "n")
    rounds = min(ROUNDS, max(1, ceil((walks.agg(F.sum("n")).first()[0] or 0) / half / WALKS)))  # one vertex of each walk is its least
    out, setting = [], "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    for r in range(rounds):
        mine = lambda end: F.pmod(F.xxhash64(end), F.lit(rounds)) == r  # noqa: B023, E731
        ahead = {1: links.filter((F.col("src") < F.col("dst")) & mine("src")).select(F.col("src").alias("start"), F.col("dst").alias("at"))}
        back = {1: links.filter((F.col("dst") < F.col("src")) & mine("dst")).select(F.col("dst").alias("start"), F.col("src").alias("at"))}
        for n in range(2, (longest + 1) // 2 + 1):
            ahead[n] = longer(ahead[n - 1], step, "a", n)
            back[n] = longer(back[n - 1], step.select(F.col("to").alias("from"), F.col("from").alias("to")), "b", n)
        closed = []
        for length in lengths:
            one, two = [f"a{i}" for i in range(1, (length + 1) // 2)], [f"b{i}" for i in range(1, length // 2)]
            apart = [F.col(x) != F.col(y) for x in one for y in two]
            both = ahead[len(one) + 1].join(back[len(two) + 1], ["start", "at"])
            both = both.filter(reduce(Column.__and__, apart)) if apart else both
            closed.append(both.select(F.array("start", *one, "at", *two[::-1]).alias("cycle"), F.lit(length).alias("length")))
        if closed:
            spark.conf.set(setting, "true")
            try:
                out.append(keep(reduce(DataFrame.unionByName, closed)))
            finally:
                spark.conf.set(setting, before)
    return out


def longer(walks: DataFrame, step: DataFrame, name: str, n: int) -> DataFrame:
    """walks (start, the vertices between, at) with one edge more, simple and over vertices above start."""
    between = [f"{name}{i}" for i in range(1, n)]
    grown = walks.withColumnRenamed("at", between[-1]).join(step, F.col(between[-1]) == F.col("from")).filter(F.col("to") > F.col("start"))
    for c in between[:-1]:
        grown = grown.filter(F.col("to") != F.col(c))
    return grown.select("start", *between, F.col("to").alias("at"))


def in_cycles(edges: DataFrame) -> DataFrame:
    """Edges that may lie on a directed cycle: vertices without incoming or outgoing edges are trimmed until none is left."""
    links = keep(edges.select("src", "dst").distinct())
    n = links.count()
    while True:
        links = links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(links.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        links = keep(links.select("src", "dst"))
        m = links.count()
        if m == n:
            return links
        n = m


def cycle_edges(edges: DataFrame) -> DataFrame:
    """Edges that lie on a directed cycle of any length: those inside one strongly connected component, loops included.

    Each round colours every vertex by the least one that reaches it; what reaches back to a colour's least vertex within the
    colour is that vertex's component. Settled vertices and edges between colours leave, and the rest is trimmed again.
    """
    links, out = in_cycles(edges), None
    while not links.isEmpty():
        colours = keep(links.select(F.col("src").alias("id")).distinct().withColumn("colour", F.col("id")))
        front = colours
        while not front.isEmpty():
            seen = front.withColumnRenamed("id", "src").join(links, "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("new"))
            after = keep(colours.join(seen, "id", "left").select("id", F.least("colour", "new").alias("colour"), (F.col("new") < F.col("colour")).alias("moved")))
            colours, front = after.drop("moved"), after.filter("moved").drop("moved")
        of = lambda end, name: colours.select(F.col("id").alias(end), F.col("colour").alias(name))  # noqa: B023, E731
        inside = keep(links.join(of("src", "a"), "src").join(of("dst", "b"), "dst").filter("a = b").select("src", "dst"))
        front = keep(colours.filter("id = colour").select("id"))
        settled = front
        while not front.isEmpty():
            before = inside.join(front.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id")).distinct()
            front = keep(before.join(settled, "id", "left_anti"))
            settled = keep(settled.unionByName(front))
        end = lambda name: settled.withColumnRenamed("id", name)  # noqa: B023, E731
        found = keep(inside.join(end("src"), "src", "left_semi").join(end("dst"), "dst", "left_semi"))
        out = found if out is None else out.unionByName(found)
        links = in_cycles(inside.join(end("src"), "src", "left_anti").join(end("dst"), "dst", "left_anti"))
    return links if out is None else out


def impact(edges: DataFrame, target) -> DataFrame:
    """One row: direct dependents (1 hop), indirect (2 to 3), dependencies (1 hop out), risk by the dependents' number."""
    one = edges.sparkSession.range(1).select(F.lit(target).cast(edges.schema["src"].dataType).alias("id"))
    back = distances(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), one, 3, directed=True)
    counts = back.agg(F.count_if(F.expr("depth = 1")).alias("direct"), F.count_if(F.expr("depth > 1")).alias("indirect"))
    needs = edges.filter((F.col("src") == target) & (F.col("dst") != target)).agg(F.count_distinct("dst").alias("dependencies"))
    both = counts.withColumn("k", F.lit(1)).join(needs.withColumn("k", F.lit(1)), "k").drop("k")
    return both.withColumn("risk", risk(F.col("direct") + F.col("indirect")))


def risk(dependents: Column) -> Column:
    return F.when(dependents > 20, "high").when(dependents > 5, "medium").otherwise("low")


def impact_level(dependents: Column) -> Column:
    return F.when(dependents == 0, "none").when(dependents <= 3, "low").otherwise("high")


def chain(edges: DataFrame, start, edge_type: str = "NEXT", max_length: int = 1000) -> DataFrame:
    """id, position along the edges of one type from start to the end of the chain, or to max_length.

    Where every vertex has one successor at most, what is known doubles each round by jumps that double too, so a chain takes as
    many rounds as its length has binary digits; where some have more, positions are distances.
    """
    one = edges.sparkSession.range(1).select(F.lit(start).cast(edges.schema["src"].dataType).alias("id"))
    links = keep(of_type(edges, edge_type).select("src", "dst").distinct())
    if not links.groupBy("src").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return distances(links, one, max_length, directed=True).withColumnRenamed("depth", "position")
    known, jump, size, n = keep(one.withColumn("position", F.lit(0))), links, 1, 1
    while size <= max_length:
        further = known.join(jump.withColumnRenamed("src", "id"), "id").select(F.col("dst").alias("id"), (F.col("position") + size).alias("position")).filter(F.col("position") <= max_length)
        known = keep(known.unionByName(further).groupBy("id").agg(F.min("position").alias("position")))
        before, n = n, known.count()
        if n == before:  # the end, or a circle closed
            break
        second = jump.select(F.col("src").alias("dst"), F.col("dst").alias("end"))
        jump, size = keep(jump.join(second, "dst").select("src", F.col("end").alias("dst"))), 2 * size
    return known


def build_chain(items: DataFrame, order: list[Column | str], key: str = "id", partition: list[str] | None = None) -> DataFrame:
    """NEXT and PREV edges between neighbours in order; rebuild after a delete to bridge it."""
    w = W.partitionBy(*(partition or [])).orderBy(*order)
    pairs = items.select(F.col(key).alias("src"), F.lead(key).over(w).alias("dst")).filter("dst IS NOT NULL")
    return pairs.withColumn("edge_type", F.lit("NEXT")).unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("PREV").alias("edge_type")))


def create_edges(new: DataFrame, nodes: DataFrame) -> DataFrame:
    """New edges whose both ends exist, types in upper case, two-way ones as two rows, one row for each (src, dst, type): the heaviest, of equal ones the last by its other columns."""
    ids = nodes.select("id").distinct()
    valid = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").withColumn("edge_type", F.upper("edge_type"))
    if "bidirectional" in new.columns:
        valid = valid.unionByName(valid.filter("bidirectional").select(*(F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in valid.columns)))
    own = ["src", "dst", "edge_type"]
    more = [c for c in valid.columns if c not in own]
    if not more:
        return valid.distinct()
    order = F.struct(*sorted(more, key=lambda c: c != "weight"))
    return valid.groupBy(*own).agg(F.max(order).alias("__most")).select(*(F.col(c) if c in own else F.col(f"__most.{c}").alias(c) for c in valid.columns))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, distinct kinds, average connections and density."""
    n = nodes.agg(F.count("*").alias("total_nodes"), F.array_sort(F.collect_set("node_type")).alias("node_types")).withColumn("k", F.lit(1))
    e = edges.agg(F.count("*").alias("total_edges"), F.array_sort(F.collect_set("edge_type")).alias("edge_types")).withColumn("k", F.lit(1))
    both = n.join(e, "k").drop("k")
    return both.withColumn("avg_connections", F.try_divide(F.col("total_edges").cast("double"), F.col("total_nodes"))).withColumn("density", F.try_divide(F.col("total_edges").cast("double"), F.col("total_nodes") * (F.col("total_nodes") - 1)))


def ring(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    """A generated graph with known answers: n typed nodes in a ring, weights and complexity by a hash of the number."""
    h = lambda m, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m))
    kinds = F.when(F.col("id") % 3 == 0, "Function").when(F.col("id") % 3 == 1, "Class").otherwise("Module")
    nodes = spark.range(n).select("id", kinds.alias("node_type"), F.concat(F.lit("TestEntity"), "id").alias("name"), h(20, 1).alias("complexity"), h(1000, 2).alias("line"))
    edges = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"), F.when(F.col("id") % 2 == 0, "CALLS").otherwise("DEPENDS_ON").alias("edge_type"), (h(101, 3) / 100).alias("weight"))
    return nodes, edges
