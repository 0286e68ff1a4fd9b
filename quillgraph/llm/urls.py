"""URL filters: rules first, and for the rest the ratio of two character language models, with DataFrame operations only.

URLs that rules allow or block train a model each, of variable order: a context of two symbols counts where it was seen often
enough, else one of one symbol, else none, and what a context has seen is smoothed by the shorter one in proportion to how
many different symbols followed it. A URL's score is the mean over its characters of the difference of the two
log-likelihoods; the threshold is the one that separates the two classes best on URLs that were left out of training. Symbols
are A, so a model has A^3 entries whatever the input; it is one array, and each URL is scored within its own row: scoring
shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillgraph.llm.common import table

#: (verdict, host, path): the longest rule whose host is the url's or a parent of it and whose path starts the url's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789:/.-_%?=&#~+@,;"
#: 0 is the start, then come the symbols, other characters of ASCII, and all others.
A = len(SYMBOLS) + 3
#: How often a context must have been seen to count; scores have so many decimals and are calibrated in steps of 1/STEPS within +-RANGE.
LEAST, DECIMALS, STEPS, RANGE = 4, 6, 100, 5
#: The quarter of the urls, by the first digit of their MD5, that is left out of training and sets the threshold.
HELD_OUT = ("0", "1", "2", "3")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else null; of equally long ones a block wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def codes_of(url: Column) -> Column:
    """For each character of the url the number of its symbol and the two before it, as one; an empty url has none."""
    plain = F.translate(url, UPPER, LOWER)
    chars = F.filter(F.split(plain, ""), lambda c: c != "")
    known = F.transform(chars, lambda c: F.when(F.instr(F.lit(SYMBOLS), c) > 0, F.instr(F.lit(SYMBOLS), c)).when(F.ascii(c) < 128, len(SYMBOLS) + 1).otherwise(len(SYMBOLS) + 2))
    start = F.array(F.lit(0), F.lit(0))
    codes = F.zip_with(F.zip_with(F.concat(start, known), F.concat(F.lit([0]), known), lambda a, b: a * A + b), known, lambda ab, c: ab * A + c)
    return F.filter(codes, lambda c: c.isNotNull())  # the two places past the end


def model(ruled: DataFrame) -> DataFrame:
    """One row, one array `llr`: at each code the log-likelihood of its last symbol after its first two, if allowed less if blocked."""
    each = ruled.select("verdict", F.explode(codes_of(F.col("url"))).alias("code"))
    counts = each.groupBy("code").agg(F.count_if(F.col("verdict") == "allow").alias("allow"), F.count_if(F.col("verdict") == "block").alias("block"))
    grid = ruled.sparkSession.range(A**3).select(F.col("id").cast("int").alias("code")).join(counts, "code", "left").fillna(0)
    grid = grid.select("code", F.expr(f"code div {A * A}").alias("a"), F.expr(f"code div {A} % {A}").alias("b"), F.expr(f"code % {A}").alias("c"), "allow", "block")
    # each sum gets its own name before the next is taken, so that windows of one partitioning share an exchange
    for by in (("c",), ("b", "c"), ("b",), ("a", "b")):
        for kind in ("allow", "block"):
            w, name = W.partitionBy(*by), "".join(by)
            grid = grid.withColumn(f"{kind}_{name}", F.sum(kind).over(w))
            if by == ("b",):
                # as many rows of the pair as there are first symbols
                grid = grid.withColumn(f"{kind}_kinds_b", F.count_if((F.col("a") == 0) & (F.col(f"{kind}_bc") > 0)).over(w))
            if by == ("a", "b"):
                grid = grid.withColumn(f"{kind}_kinds_ab", F.count_if(F.col(kind) > 0).over(w))
    for kind in ("allow", "block"):
        grid = grid.withColumn(f"{kind}_all", F.sum(kind).over(W.partitionBy()))  # A^3 rows

    def likelihood(kind: str) -> Column:
        one = (F.col(f"{kind}_c") + 1) / (F.col(f"{kind}_all") + A)
        two = F.when(F.col(f"{kind}_b") >= LEAST, (F.col(f"{kind}_bc") + F.col(f"{kind}_kinds_b") * one) / (F.col(f"{kind}_b") + F.col(f"{kind}_kinds_b"))).otherwise(one)
        return F.when(F.col(f"{kind}_ab") >= LEAST, (F.col(kind) + F.col(f"{kind}_kinds_ab") * two) / (F.col(f"{kind}_ab") + F.col(f"{kind}_kinds_ab"))).otherwise(two)

    rows = grid.select("code", (F.log(likelihood("allow")) - F.log(likelihood("block"))).alias("llr"))
    return rows.agg(F.array_sort(F.collect_list(F.struct("code", "llr"))).alias("all")).select(F.col("all.llr").alias("llr"))


def scored(pages: DataFrame, llr: DataFrame) -> DataFrame:
    """pages with `score`: the mean of llr over the url's characters; an empty url scores 0."""
    held = pages.withColumn("codes", codes_of(F.col("url"))).withColumn("llr", llr.scalar())  # one array of A^3 numbers
    total = F.expr("aggregate(codes, 0D, (s, c) -> s + llr[c])")
    score = F.when(F.size("codes") > 0, F.round(total / F.size("codes"), DECIMALS)).otherwise(0.0)
    return held.withColumn("score", score).drop("codes", "llr")


def threshold(ruled: DataFrame) -> float:
    """The bound of score with the best mean of both classes' shares on their side; 0 without both classes.

    It lies in the middle of the gap below the lowest score that it lets through.
    """
    bucket = F.floor(F.greatest(F.least(F.col("score"), F.lit(float(RANGE))), F.lit(float(-RANGE))) * STEPS)
    by = ruled.groupBy(bucket.alias("bucket")).agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("allow", "block")))  # 2 * RANGE * STEPS rows at most
    up = W.orderBy("bucket")
    all_ = W.partitionBy()
    right = 1 - (F.sum("allow").over(up) - F.col("allow")) / F.sum("allow").over(all_) + (F.sum("block").over(up) - F.col("block")) / F.sum("block").over(all_)
    sums = by.withColumn("both", (F.sum("allow").over(all_) > 0) & (F.sum("block").over(all_) > 0)).filter("both")
    ranked = sums.select("bucket", right.alias("right"), F.lag("bucket").over(up).alias("below"))
    best = ranked.orderBy(F.desc("right"), "bucket").limit(1).collect()
    if not best:
        return 0.0
    top, below = best[0]["bucket"], best[0]["below"]
    return (top if below is None else (top + below + 1) / 2) / STEPS


def judge(df: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple = RULES) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, score. A null url counts as empty (no host, no path, no rule); rows are independent."""
    pages = df.select(F.col(f"`{page_id}`").alias("page_id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    split = pages.withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("verdict", verdict)
    ruled = split.filter("verdict IS NOT NULL")
    held_out = F.substring(F.md5(F.col("url").cast("binary")), 1, 1).isin(*HELD_OUT)
    llr = table(model(ruled.filter(~held_out)))
    bound = threshold(scored(ruled.filter(held_out), llr))
    method = F.when(F.col("score") >= bound, "allow").otherwise("block")
    return scored(split, llr).select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "score")


def _rules_sql(rules: tuple) -> str:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"(VALUES {values}) AS r(verdict, host, path)"


#: DuckDB: the rules by a join, the models by grouped counts, scores by sums over unnested characters.
SQL = rf"""
WITH p AS (SELECT row_number() OVER () AS n, page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT n, page_id, url, translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM p),
fits AS (SELECT h.n, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY h.n ORDER BY length(r.host || r.path) DESC, r.verdict DESC) AS k
  FROM h JOIN {_rules_sql(RULES)} ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)),
ruled AS (SELECT h.*, f.rule, f.verdict, substr(md5(h.url), 1, 1) IN ('0', '1', '2', '3') AS held FROM h LEFT JOIN fits f ON f.n = h.n AND f.k = 1),
letters AS (SELECT n, i, translate(substr(url, i::INT, 1), '{UPPER}', '{LOWER}') AS ch FROM (SELECT n, url, unnest(range(1, length(url) + 1)) AS i FROM p)),
coded AS (SELECT n, i, CASE WHEN instr('{SYMBOLS}', ch) > 0 THEN instr('{SYMBOLS}', ch) WHEN unicode(ch) < 128 THEN {len(SYMBOLS) + 1} ELSE {len(SYMBOLS) + 2} END AS c FROM letters),
grams AS (SELECT n, i, c, lag(c, 1, 0) OVER w AS b, lag(c, 2, 0) OVER w AS a FROM coded WINDOW w AS (PARTITION BY n ORDER BY i)),
seen AS (SELECT verdict AS kind, a, b, c, count(*) AS m FROM grams JOIN ruled USING (n) WHERE verdict IS NOT NULL AND NOT held GROUP BY ALL),
kinds AS (SELECT * FROM (VALUES ('allow'), ('block')) AS k(kind)),
asked AS (SELECT DISTINCT kind, a, b, c FROM grams, kinds),
s_all AS (SELECT kind, sum(m) AS m FROM seen GROUP BY kind),
s_c AS (SELECT kind, c, sum(m) AS m FROM seen GROUP BY kind, c),
s_bc AS (SELECT kind, b, c, sum(m) AS m FROM seen GROUP BY kind, b, c),
s_b AS (SELECT kind, b, sum(m) AS m, count(*) AS t FROM s_bc GROUP BY kind, b),
s_ab AS (SELECT kind, a, b, sum(m) AS m, count(*) AS t FROM seen GROUP BY kind, a, b),
one AS (SELECT q.*, (coalesce(s_c.m, 0) + 1) / (coalesce(s_all.m, 0) + {A}) AS p FROM asked q LEFT JOIN s_c USING (kind, c) LEFT JOIN s_all USING (kind)),
two AS (SELECT o.kind, a, b, c, CASE WHEN s_b.m >= {LEAST} THEN (coalesce(s_bc.m, 0) + s_b.t * p) / (s_b.m + s_b.t) ELSE p END AS p FROM one o LEFT JOIN s_bc USING (kind, b, c) LEFT JOIN s_b USING (kind, b)),
three AS (SELECT t.kind, a, b, c, CASE WHEN s_ab.m >= {LEAST} THEN (coalesce(seen.m, 0) + s_ab.t * p) / (s_ab.m + s_ab.t) ELSE p END AS p FROM two t LEFT JOIN seen USING (kind, a, b, c) LEFT JOIN s_ab USING (kind, a, b)),
llr AS (SELECT a, b, c, sum(CASE WHEN kind = 'allow' THEN ln(p) ELSE -ln(p) END) AS v FROM three GROUP BY a, b, c),
means AS (SELECT n, round(avg(v), {DECIMALS}) AS score FROM grams JOIN llr USING (a, b, c) GROUP BY n),
scores AS (SELECT r.*, coalesce(m.score, 0) AS score FROM ruled r LEFT JOIN means m USING (n)),
by_bucket AS (SELECT floor(greatest(least(score, {RANGE}.0), -{RANGE}.0) * {STEPS}) AS bucket, count(*) FILTER (verdict = 'allow') AS allow, count(*) FILTER (verdict = 'block') AS block FROM scores WHERE held AND verdict IS NOT NULL GROUP BY 1),
sums AS (SELECT bucket, 1 - (sum(allow) OVER up - allow) / sum(allow) OVER () + (sum(block) OVER up - block) / sum(block) OVER () AS share, lag(bucket) OVER up AS below, sum(allow) OVER () AS allows, sum(block) OVER () AS blocks
  FROM by_bucket WINDOW up AS (ORDER BY bucket)),
best AS (SELECT CASE WHEN below IS NULL THEN bucket ELSE (bucket + below + 1) / 2 END / {STEPS} AS bound FROM sums WHERE allows > 0 AND blocks > 0 ORDER BY share DESC, bucket LIMIT 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN score >= coalesce((SELECT bound FROM best), 0) THEN 'allow' ELSE 'block' END) AS verdict, score FROM scores
"""
