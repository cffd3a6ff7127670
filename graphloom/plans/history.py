"""Change history, ownership, contracts, rules and event logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import identifiers as ids
from graphloom.operators import ranges
from graphloom.plans.query import query
from graphloom.sources.fixture import edges, nodes, read


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS f FROM lineitem), s AS (SELECT c FROM c GROUP BY c HAVING count(*) BETWEEN 2 AND 40), t AS (SELECT f, count(*) AS touches FROM c GROUP BY f),
p AS (SELECT a.f AS file_a, b.f AS file_b, count(*) AS n FROM c a JOIN c b ON a.c = b.c AND a.f < b.f JOIN s ON s.c = a.c GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT file_a, file_b, n, round(least(1.0, n / sqrt(x.touches * y.touches)), 6) AS score FROM p JOIN t x ON x.f = file_a JOIN t y ON y.f = file_b""")
def co_change(spark, sf):
    """Parts of one order change together; an order of more than 40 parts makes no pairs, so pairs stay within 780 an order."""
    c = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("c"), F.col("l_partkey").alias("f")).distinct()
    groups = c.groupBy("c").agg(F.sort_array(F.collect_list("f")).alias("fs")).where(F.size("fs").between(2, 40))
    one = groups.select("fs", F.posexplode("fs").alias("i", "file_a"))
    pairs = one.select("file_a", F.explode(F.slice("fs", F.col("i") + 2, F.size("fs"))).alias("file_b")).groupBy("file_a", "file_b").agg(F.count("*").alias("n")).where("n >= 2")
    t = c.groupBy("f").agg(F.count("*").alias("touches"))
    x, y = t.select(F.col("f").alias("file_a"), F.col("touches").alias("ta")), t.select(F.col("f").alias("file_b"), F.col("touches").alias("tb"))
    return pairs.join(x, "file_a").join(y, "file_b").select("file_a", "file_b", "n", F.round(F.least(F.lit(1.0), F.col("n") / F.sqrt(F.col("ta") * F.col("tb"))), 6).alias("score"))


@query("""SELECT c_mktsegment AS owner, count(*) AS symbols, count(DISTINCT o_custkey) AS files, min(o_orderdate) AS oldest, max(o_orderdate) AS newest FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def ownership(spark, sf):
    j = read(spark, sf, "orders").select("o_custkey", "o_orderdate").join(read(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("c_mktsegment").alias("owner")).agg(F.count("*").alias("symbols"), F.count_distinct("o_custkey").alias("files"), F.min("o_orderdate").alias("oldest"), F.max("o_orderdate").alias("newest"))


@query("""WITH m AS (SELECT max(o_orderdate) AS today FROM orders), c AS (SELECT o_custkey AS id, max(o_orderdate) AS last FROM orders GROUP BY 1) SELECT id, date_diff('day', CAST(last AS DATE), CAST(today AS DATE)) AS age_days FROM c, m WHERE date_diff('day', CAST(last AS DATE), CAST(today AS DATE)) > 180""")
def stale_code(spark, sf):
    o = read(spark, sf, "orders")
    today = o.agg(F.max("o_orderdate")).first()[0]
    by = o.groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("last"))
    return by.select("id", F.datediff(F.lit(today), "last").cast("long").alias("age_days")).where("age_days > 180")


@query("""WITH c AS (SELECT p_partkey AS id, p_brand AS dir, p_size * 2.0::DOUBLE AS pct FROM part) SELECT dir, count(*) AS symbols, round(avg(pct), 6) AS average, count(*) FILTER (WHERE pct >= 80) AS covered, count(*) FILTER (WHERE pct >= 20 AND pct < 80) AS partial, count(*) FILTER (WHERE pct < 20) AS uncovered FROM c GROUP BY dir""")
def coverage_summary(spark, sf):
    pct = F.col("p_size") * 2.0
    return read(spark, sf, "part").groupBy(F.col("p_brand").alias("dir")).agg(F.count("*").alias("symbols"), F.round(F.avg(pct), 6).alias("average"), F.count_if(pct >= 80).alias("covered"), F.count_if((pct >= 20) & (pct < 80)).alias("partial"), F.count_if(pct < 20).alias("uncovered"))


@query("""SELECT p_partkey AS id, p_size * 2.0::DOUBLE AS pct FROM part WHERE p_size * 2 >= 20 AND p_size * 2 < 70""")
def coverage_gaps(spark, sf):
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 2.0).alias("pct")).where("pct >= 20 and pct < 70")


@query("""SELECT event_type AS tool, count(*) AS calls, round(avg(CASE WHEN value < 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS zero_rate, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type""")
def retrieval_log(spark, sf):
    e = read(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("calls"), F.round(F.avg((F.col("value") < 10).cast("double")), 6).alias("zero_rate"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


@query("""SELECT CAST(ts AS DATE) AS day, event_type AS tool, count(*) AS n, round(sum(value), 4) AS saved, CASE WHEN count(*) >= 10 THEN 'many' WHEN count(*) >= 3 THEN 'some' ELSE 'few' END AS bucket FROM events GROUP BY 1, 2""")
def telemetry_rollup(spark, sf):
    by = read(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("tool")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("saved"))
    return by.withColumn("bucket", F.when(F.col("n") >= 10, "many").when(F.col("n") >= 3, "some").otherwise("few"))


@query("""WITH m AS (SELECT max(ts) AS now FROM events) SELECT user_id, round(least(1.5, sum(exp(-ln(2) / 3 * (epoch(now) - epoch(ts)) / 86400))), 6) AS boost FROM events, m GROUP BY user_id""")
def frecency(spark, sf):
    e = read(spark, sf, "events")
    now = e.agg(F.max("ts")).first()[0]
    days = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000.0
    return e.groupBy("user_id").agg(F.round(F.least(F.lit(1.5), F.sum(ids.half_life(days, 3.0))), 6).alias("boost"))


@query("""WITH p AS (SELECT DISTINCT s_nationkey AS ws, l_partkey AS id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), c AS (SELECT DISTINCT c_nationkey AS ws, l_partkey AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT coalesce(p.ws, c.ws) AS workspace, count(*) FILTER (WHERE p.id IS NOT NULL AND c.id IS NOT NULL) AS matched, count(*) FILTER (WHERE c.id IS NULL) AS orphan_providers, count(*) FILTER (WHERE p.id IS NULL) AS orphan_consumers FROM p FULL JOIN c ON p.ws = c.ws AND p.id = c.id GROUP BY 1""")
def contract_match(spark, sf):
    """Providers and consumers of a contract (a part) within a workspace (a nation), and who has no counterpart."""
    line = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    own = read(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("ws"))
    use = read(spark, sf, "orders").select("o_orderkey", "o_custkey").join(read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("ws")), F.col("o_custkey") == F.col("c_custkey"))
    p = line.join(own, F.col("l_suppkey") == F.col("s_suppkey")).select("ws", F.col("l_partkey").alias("id"), F.lit(1).alias("p"), F.lit(0).alias("c"))
    c = line.join(use, F.col("l_orderkey") == F.col("o_orderkey")).select("ws", F.col("l_partkey").alias("id"), F.lit(0).alias("p"), F.lit(1).alias("c"))
    both = p.unionByName(c).groupBy("ws", "id").agg(F.max("p").alias("p"), F.max("c").alias("c"))
    return both.groupBy(F.col("ws").alias("workspace")).agg(F.count_if(F.expr("p = 1 and c = 1")).alias("matched"), F.count_if(F.expr("c = 0")).alias("orphan_providers"), F.count_if(F.expr("p = 0")).alias("orphan_consumers"))


@query("""SELECT a.file_path AS source_path, count(*) AS violations, min(e.dst) AS first_target FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE starts_with(a.file_path, 'EUROPE/') AND starts_with(b.file_path, 'parts/') AND e.kind IN ('calls', 'references') GROUP BY a.file_path""", graph=True)
def boundary_guard(spark, sf):
    n = nodes(spark, sf).select("id", "file_path")
    a = n.where(F.col("file_path").startswith("EUROPE/")).select(F.col("id").alias("src"), F.col("file_path").alias("source_path"))
    b = n.where(F.col("file_path").startswith("parts/")).select(F.col("id").alias("dst"))
    e = edges(spark, sf).where(F.col("kind").isin("calls", "references")).select("src", "dst")
    return e.join(a, "src").join(b, "dst", "left_semi").groupBy("source_path").agg(F.count("*").alias("violations"), F.min("dst").alias("first_target"))


@query("""WITH o AS (SELECT l_suppkey AS who, count(DISTINCT l_partkey) AS files FROM lineitem GROUP BY 1), a AS (SELECT s_suppkey AS who, count(*) AS symbols FROM supplier JOIN customer ON s_nationkey = c_nationkey GROUP BY 1)
SELECT coalesce(o.who, a.who) AS reviewer, 3 * coalesce(files, 0) + 2 * coalesce(symbols, 0) AS score FROM o FULL JOIN a ON o.who = a.who""")
def reviewer_ranking(spark, sf):
    o = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("who")).agg(F.count_distinct("l_partkey").alias("files"))
    people = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("symbols"))
    a = read(spark, sf, "supplier").join(people, F.col("s_nationkey") == F.col("nation")).select(F.col("s_suppkey").alias("author"), "symbols")
    return o.join(a, F.col("who") == F.col("author"), "full_outer").select(F.coalesce("who", "author").alias("reviewer"), (3 * F.coalesce("files", F.lit(0)) + 2 * F.coalesce("symbols", F.lit(0))).alias("score"))


@query("""SELECT n.id, count(*) AS hunks FROM nodes n JOIN (SELECT p_partkey * 10 + 3 AS line, 'parts/' || p_brand AS path FROM part) h ON h.path = n.file_path AND h.line BETWEEN n.start_line AND n.end_line WHERE n.kind = 'method' GROUP BY n.id""", graph=True)
def range_grounding(spark, sf):
    """Lines of changes to the symbols around them: an equal path and bin, then the range."""
    h = read(spark, sf, "part").select((F.col("p_partkey") * 10 + 3).alias("line"), F.concat(F.lit("parts/"), F.col("p_brand")).alias("path"))
    n = nodes(spark, sf).where("kind = 'method'").select(F.col("file_path").alias("path"), "id", F.col("start_line").alias("start"), F.col("end_line").alias("stop"))
    return ranges.around(n, h.groupBy("path", "line").agg(F.count("*").alias("n"))).groupBy("id").agg(F.sum("n").alias("hunks"))


@query("""WITH g AS (SELECT event_type, count(*) FILTER (WHERE value >= 50) AS sends, count(*) FILTER (WHERE value < 50) AS receives FROM events GROUP BY event_type) SELECT event_type AS channel, sends, receives, CASE WHEN sends = 0 THEN 'skip' WHEN sends >= 2 AND receives > 0 THEN 'high' WHEN receives > 0 THEN 'medium' ELSE 'low' END AS risk FROM g""")
def channel_ops(spark, sf):
    by = read(spark, sf, "events").groupBy(F.col("event_type").alias("channel")).agg(F.count_if(F.col("value") >= 50).alias("sends"), F.count_if(F.col("value") < 50).alias("receives"))
    return by.withColumn("risk", F.when(F.col("sends") == 0, "skip").when((F.col("sends") >= 2) & (F.col("receives") > 0), "high").when(F.col("receives") > 0, "medium").otherwise("low"))


@query("""WITH a AS (SELECT event_type, count(DISTINCT user_id) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1) SELECT coalesce(a.event_type, b.event_type) AS path, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n <> b.n THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b ON a.event_type = b.event_type""")
def merkle_diff(spark, sf):
    """Two states of a tree by path and number of distinct users, as its SQL has it; merkle_content_diff compares contents."""
    e = read(spark, sf, "events")
    state = lambda df, c: df.groupBy(F.col("event_type").alias(f"path_{c}")).agg(F.count_distinct("user_id").alias(c))
    a, b = state(e.where("event_id % 2 = 0"), "a"), state(e, "b")
    j = a.join(b, F.col("path_a") == F.col("path_b"), "full_outer")
    return j.select(F.coalesce("path_a", "path_b").alias("path"), F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same").alias("state"))


def content_digest(df, path: str, name: str):
    """(path_name, name): for each path the number of its rows and the order-free sum of their hashes over all columns; a null is told from a value."""
    row = F.xxhash64(*[c for n in sorted(df.columns) for c in (F.col(f"`{n}`"), F.col(f"`{n}`").isNull())]).cast("decimal(38,0)")
    return df.groupBy(F.col(path).alias(f"path_{name}")).agg(F.struct(F.count("*").alias("rows"), F.sum(row).alias("hashes")).alias(name))


def tree_diff(a, b, path: str):
    """(path, state): what state b has added, removed, changed or left the same since state a; the null path is one path."""
    j = content_digest(a, path, "a").join(content_digest(b, path, "b"), F.col("path_a").eqNullSafe(F.col("path_b")), "full_outer")
    return j.select(F.coalesce("path_a", "path_b").alias("path"), F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same").alias("state"))


@query("""WITH a AS (SELECT event_type AS path, count(*) AS n, sum(hash(e)::HUGEINT) AS h FROM events e WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS path, count(*) AS n, sum(hash(e)::HUGEINT) AS h FROM events e GROUP BY 1)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n <> b.n OR a.h <> b.h THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b ON a.path IS NOT DISTINCT FROM b.path""")
def merkle_content_diff(spark, sf):
    """The two states of merkle_diff by path and content digest."""
    e = read(spark, sf, "events")
    return tree_diff(e.where("event_id % 2 = 0"), e, "event_type")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_windows(spark, sf):
    from graphloom.streaming.windows import tumbling

    return tumbling(read(spark, sf, "events"))


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, session""")
def session_windows(spark, sf):
    from graphloom.streaming.windows import sessions

    return sessions(read(spark, sf, "events"))
