"""Analyses with a formula of their own: audits, risks, gaps, concurrency, history and log roll-ups.

Kinds of edges that the commerce tables lack are projected: orders with status F hold a lock, customers of
the segment MACHINERY are tests, an event is a send, a receive or a close by its number.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import identifiers as ids
from graphloom.operators import centrality, dataflow, traverse
from graphloom.plans.query import query
from graphloom.plans.relational import RANK_SQL
from graphloom.sources.fixture import edges, nodes, read, trade


@query(f"""t AS (SELECT kind, origin, {RANK_SQL} AS rank, count(*) AS n FROM edges GROUP BY ALL)
SELECT kind, sum(n)::BIGINT AS edges, count(*) AS tiers, round(100.0 * sum(n) FILTER (WHERE rank >= 3) / sum(n), 6)::DOUBLE AS high_pct, coalesce(sum(n) FILTER (WHERE rank = 1), 0)::BIGINT AS weak FROM t GROUP BY ROLLUP (kind)""", graph=True)
def edge_audit(spark, sf):
    """Edges by confidence, for each kind and for all."""
    t = edges(spark, sf).groupBy("kind", "origin").agg(F.count("*").alias("n")).withColumn("rank", ids.origin_rank(F.col("origin")))
    high, weak = F.sum(F.when(F.col("rank") >= 3, F.col("n"))), F.sum(F.when(F.col("rank") == 1, F.col("n")))
    return t.rollup("kind").agg(F.sum("n").alias("edges"), F.count("*").alias("tiers"), F.round(100.0 * high / F.sum("n"), 6).alias("high_pct"), F.coalesce(weak, F.lit(0)).alias("weak"))


@query("""SELECT n.id FROM nodes n WHERE n.kind = 'module' AND n.id NOT IN (SELECT e.dst FROM edges e JOIN nodes m ON m.id = e.src WHERE e.kind = 'member_of' AND m.kind = 'type')""", graph=True)
def unimplemented_interfaces(spark, sf):
    n = nodes(spark, sf)
    types = n.where("kind = 'type'").select(F.col("id").alias("src"))
    used = edges(spark, sf).where("kind = 'member_of'").join(types, "src", "left_semi").select(F.col("dst").alias("id"))
    return n.where("kind = 'module'").select("id").join(used, "id", "left_anti")


@query("""t AS (SELECT id FROM nodes WHERE kind = 'function' AND language = 'MACHINERY'), c AS (SELECT e.dst AS id, bool_and(e.src IN (SELECT id FROM t)) AS only_tests, count(*) AS calls FROM edges e WHERE e.kind = 'calls' AND e.src LIKE 'customer/%' GROUP BY 1) SELECT id, calls FROM c WHERE only_tests""", graph=True)
def test_only_targets(spark, sf):
    """What nothing but tests calls."""
    tests = nodes(spark, sf).where("kind = 'function' and language = 'MACHINERY'").select(F.col("id").alias("t"))
    calls = edges(spark, sf).where("kind = 'calls' and src like 'customer/%'").join(tests, F.col("src") == F.col("t"), "left")
    return calls.groupBy(F.col("dst").alias("id")).agg(F.bool_and(F.col("t").isNotNull()).alias("only"), F.count("*").alias("calls")).where("only").select("id", "calls")


@query("""t AS (SELECT id FROM nodes WHERE kind = 'function' AND language = 'MACHINERY'), r AS (SELECT DISTINCT q.dst AS symbol, p.src AS test FROM edges p JOIN t ON t.id = p.src JOIN edges q ON q.src = p.dst AND q.kind = 'calls' WHERE p.kind = 'calls')
SELECT symbol, count(*) AS tests, md5(string_agg(test, ',' ORDER BY test)) AS tests_md5 FROM r GROUP BY symbol""", graph=True)
def tests_as_edges(spark, sf):
    """The tests of each symbol, two calls away, distinct and in order."""
    e = edges(spark, sf).where("kind = 'calls'").select("src", "dst")
    tests = nodes(spark, sf).where("kind = 'function' and language = 'MACHINERY'").select(F.col("id").alias("src"))
    first = e.join(tests, "src", "left_semi").select(F.col("src").alias("test"), F.col("dst").alias("via"))
    by = first.join(e.select(F.col("src").alias("via"), F.col("dst").alias("symbol")), "via").groupBy("symbol").agg(F.sort_array(F.collect_set("test")).alias("t"))
    return by.select("symbol", F.size("t").cast("long").alias("tests"), F.md5(F.array_join("t", ",")).alias("tests_md5"))


@query("""o AS (SELECT n.file_path AS module, e.dst, e.src FROM edges e JOIN nodes n ON n.id = e.src WHERE e.kind = 'calls' AND e.dst LIKE 'part/%')
SELECT module, count(*) AS calls, count(DISTINCT dst) AS symbols, count(DISTINCT src) AS callers FROM o GROUP BY module""", graph=True)
def external_calls(spark, sf):
    """Calls that leave for the parts catalogue, by the file they come from."""
    n = nodes(spark, sf).select(F.col("id").alias("src"), F.col("file_path").alias("module"))
    out = edges(spark, sf).where("kind = 'calls' and dst like 'part/%'").join(n, "src")
    return out.groupBy("module").agg(F.count("*").alias("calls"), F.count_distinct("dst").alias("symbols"), F.count_distinct("src").alias("callers"))


@query("""WITH f AS (SELECT o_custkey AS file, o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT'), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM f)
SELECT file, count(*) AS fixes, max(o_orderdate) AS last, string_agg(CASE WHEN n <= 5 THEN 'fix: ' || o_orderkey END, ',' ORDER BY n) AS subjects FROM r GROUP BY file""")
def fixes_history(spark, sf):
    """Urgent orders are commits that fix: their number by file, and the five latest subjects."""
    f = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("file"), "o_orderdate", "o_orderkey")
    latest = Window.partitionBy("file").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    by = f.withColumn("n", F.row_number().over(latest)).groupBy("file").agg(F.count("*").alias("fixes"), F.max("o_orderdate").alias("last"), F.sort_array(F.collect_list(F.when(F.col("n") <= 5, F.struct("n", "o_orderkey")))).alias("s"))
    return by.select("file", "fixes", "last", F.array_join(F.transform("s", lambda x: F.concat(F.lit("fix: "), x["o_orderkey"].cast("string"))), ",").alias("subjects"))


@query("""WITH m AS (SELECT CAST(max(o_orderdate) AS DATE) AS today FROM orders), c AS (SELECT o_custkey AS id, count(*) AS commit_count, date_diff('day', CAST(min(o_orderdate) AS DATE), any_value(today)) AS age_days FROM orders, m GROUP BY 1)
SELECT id, commit_count, age_days, round(commit_count / CAST(greatest(age_days, 1) AS DOUBLE), 6) AS churn_rate FROM c ORDER BY churn_rate DESC, commit_count DESC, id LIMIT 100""")
def churn_rate(spark, sf):
    o = read(spark, sf, "orders")
    today = o.agg(F.max("o_orderdate")).first()[0]
    by = o.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("commit_count"), F.datediff(F.lit(today), F.min("o_orderdate")).cast("long").alias("age_days"))
    rate = F.round(F.col("commit_count") / F.greatest("age_days", F.lit(1)), 6)
    return by.withColumn("churn_rate", rate).orderBy(F.col("churn_rate").desc(), F.col("commit_count").desc(), "id").limit(100)


@query("""s AS (SELECT DISTINCT src AS a, dst AS b FROM edges WHERE kind = 'calls'), w AS (SELECT id FROM nodes WHERE id LIKE 'customer/%7' UNION SELECT s.b FROM w JOIN s ON s.a = w.id), x AS (SELECT e.dst AS field, e.src AS writer, o_orderstatus = 'F' AS locked FROM edges e JOIN w ON w.id = e.src JOIN orders ON e.src = 'order/' || o_orderkey WHERE e.kind = 'calls')
SELECT field, count(DISTINCT writer) AS writers, count(DISTINCT writer) FILTER (WHERE NOT locked) AS unlocked FROM x GROUP BY field HAVING count(DISTINCT writer) >= 2 AND count(DISTINCT writer) FILTER (WHERE NOT locked) >= 1""", graph=True)
def race_writes(spark, sf):
    """Parts that several orders reached from spawned customers write, some of them without the lock."""
    e, n = edges(spark, sf), nodes(spark, sf)
    reached = traverse.closure(spark, e, n.where("id like 'customer/%7'"), ("calls",)).select(F.col("id").alias("src"))
    lock = read(spark, sf, "orders").select(F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("src"), (F.col("o_orderstatus") == "F").alias("locked"))
    writes = e.where("kind = 'calls' and src like 'order/%'").select("src", "dst").distinct().join(reached, "src", "left_semi").join(lock, "src")
    by = writes.groupBy(F.col("dst").alias("field")).agg(F.count("*").alias("writers"), F.count_if(~F.col("locked")).alias("unlocked"))
    return by.where("writers >= 2 and unlocked >= 1")


@query("""WITH c AS (SELECT user_id AS channel, count(*) FILTER (WHERE event_id % 5 IN (0, 1)) AS sends, count(*) FILTER (WHERE event_id % 5 IN (2, 3)) AS recvs, count(*) FILTER (WHERE event_id % 5 = 4) AS closers FROM events GROUP BY 1)
SELECT channel, sends, recvs, CASE WHEN sends >= 2 AND recvs > 0 THEN 'high' WHEN sends >= 1 AND recvs > 0 THEN 'medium' ELSE 'low' END AS risk FROM c WHERE closers = 0 AND sends > 0""")
def unclosed_channels(spark, sf):
    m = F.col("event_id") % 5
    c = read(spark, sf, "events").groupBy(F.col("user_id").alias("channel")).agg(F.count_if(m.isin(0, 1)).alias("sends"), F.count_if(m.isin(2, 3)).alias("recvs"), F.count_if(m == 4).alias("closers"))
    risk = F.when((F.col("sends") >= 2) & (F.col("recvs") > 0), "high").when(F.col("recvs") > 0, "medium").otherwise("low")
    return c.where("closers = 0 and sends > 0").select("channel", "sends", "recvs", risk.alias("risk"))


@query("""SELECT origin AS pass, kind, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edges WHERE origin IN ('ast_inferred', 'text_matched') GROUP BY 1, 2""", graph=True)
def synthesizers(spark, sf):
    made = edges(spark, sf).where(F.col("origin").isin("ast_inferred", "text_matched"))
    return made.groupBy(F.col("origin").alias("pass"), "kind").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


@query("""d AS (SELECT name, count(*) AS defs, count(DISTINCT language) AS langs, min(language) AS lang FROM nodes WHERE kind = 'method' GROUP BY name), r AS (SELECT DISTINCT p_brand AS lang, p_name || CASE WHEN p_partkey % 10 = 0 THEN '?' ELSE '' END AS name FROM part)
SELECT r.lang, r.name, CASE WHEN d.name IS NULL THEN 'no_definition' WHEN d.langs = 1 AND d.lang <> r.lang THEN 'cross_language_only' WHEN d.defs >= 2 THEN 'ambiguous_multi_match' ELSE 'candidate_out_of_scope' END AS outcome FROM r LEFT JOIN d ON d.name = r.name""", graph=True)
def resolution_outcomes(spark, sf):
    """Why a name used in a language has no single target, by the definitions of that name."""
    d = nodes(spark, sf).where("kind = 'method'").groupBy(F.col("name").alias("known")).agg(F.count("*").alias("defs"), F.count_distinct("language").alias("langs"), F.min("language").alias("l"))
    used = read(spark, sf, "part").select(F.col("p_brand").alias("lang"), F.concat("p_name", F.when(F.col("p_partkey") % 10 == 0, "?").otherwise("")).alias("name")).distinct()
    outcome = F.when(F.col("known").isNull(), "no_definition").when((F.col("langs") == 1) & (F.col("l") != F.col("lang")), "cross_language_only").when(F.col("defs") >= 2, "ambiguous_multi_match").otherwise("candidate_out_of_scope")
    return used.join(d, F.col("name") == F.col("known"), "left").select("lang", "name", outcome.alias("outcome"))


@query("""i AS (SELECT dst AS id, count(*) AS fan_in FROM edges WHERE kind = 'calls' GROUP BY 1) SELECT n.id, 'uncovered_hotspot' AS gap, fan_in FROM nodes n JOIN i ON i.id = n.id JOIN part ON n.id = 'part/' || p_partkey WHERE p_size * 2 < 20 AND fan_in >= 20
UNION ALL SELECT n.id, 'disconnected', 0 FROM nodes n WHERE n.kind = 'function' AND n.id NOT IN (SELECT src FROM edges WHERE kind = 'calls')""", graph=True)
def knowledge_gaps(spark, sf):
    """Much called symbols with little coverage, and functions that call nothing."""
    e = edges(spark, sf).where("kind = 'calls'")
    fan = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in")).where("fan_in >= 20")
    low = read(spark, sf, "part").where("p_size * 2 < 20").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("id"))
    hot = fan.join(low, "id").select("id", F.lit("uncovered_hotspot").alias("gap"), "fan_in")
    alone = nodes(spark, sf).where("kind = 'function'").select("id").join(e.select(F.col("src").alias("id")), "id", "left_anti")
    return hot.unionByName(alone.select("id", F.lit("disconnected").alias("gap"), F.lit(0).cast("long").alias("fan_in")))


@query("""p AS (SELECT DISTINCT src, dst FROM trade WHERE src <> dst AND weight >= 2), w AS (SELECT src AS a, dst AS b FROM p UNION SELECT w.a, p.dst FROM w JOIN p ON p.src = w.b), c AS (SELECT u.a AS id, least(u.a, min(u.b)) AS component FROM w u JOIN w v ON v.a = u.b AND v.b = u.a GROUP BY u.a)
SELECT component, count(*) AS size, string_agg(id, ',' ORDER BY id) AS members, CASE WHEN count(DISTINCT n_regionkey) > 1 THEN 2 ELSE 1 END AS severity FROM c JOIN nation ON n_nationkey = id GROUP BY component HAVING count(*) >= 2""", graph=True)
def cycles(spark, sf):
    """Cyclic groups of at least two nations; those across regions are the more severe."""
    pairs = trade(spark, sf).where("src <> dst and weight >= 2").select("src", "dst")
    home = read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), "n_regionkey")
    by = centrality.scc(spark, pairs).join(home, "id").groupBy("component").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("id")).alias("m"), F.count_distinct("n_regionkey").alias("r")).where("size >= 2")
    return by.select("component", "size", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("members"), F.when(F.col("r") > 1, 2).otherwise(1).alias("severity"))


@query("""f AS (SELECT DISTINCT src, dst FROM edges WHERE kind IN ('calls', 'references')), d1 AS (SELECT dst AS id, src AS a FROM f WHERE dst LIKE 'supplier/%'), d2 AS (SELECT DISTINCT d1.id, f.src AS a FROM d1 JOIN f ON f.dst = d1.a), d3 AS (SELECT DISTINCT d2.id, f.src AS a FROM d2 JOIN f ON f.dst = d2.a),
c AS (SELECT id, count(*) FILTER (WHERE d = 1) AS direct, count(*) FILTER (WHERE d = 2) AS second, count(*) FILTER (WHERE d = 3) AS third, count(*) AS total FROM (SELECT id, 1 AS d FROM d1 UNION ALL SELECT id, 2 FROM d2 UNION ALL SELECT id, 3 FROM d3) GROUP BY id)
SELECT n.id, coalesce(direct, 0) AS direct, coalesce(second, 0) AS second, coalesce(third, 0) AS third, coalesce(total, 0) AS total, CASE WHEN direct >= 10 THEN 'CRITICAL' WHEN direct >= 5 THEN 'HIGH' WHEN direct >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM nodes n LEFT JOIN c ON c.id = n.id WHERE n.kind = 'type'""", graph=True)
def impact(spark, sf):
    """How many depend on each supplier, by distance, and the risk of a change."""
    e = edges(spark, sf).where(F.col("kind").isin("calls", "references"))
    return dataflow.impact(spark, e, nodes(spark, sf).where("kind = 'type'"))


@query("""WITH e AS (SELECT CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS tool, 'm' || (user_id % 3) AS model, CAST(ts AS DATE) AS day, value FROM events), g AS (SELECT coalesce(nullif(tool, ''), '(unknown)') AS tool, model, day, value FROM e)
SELECT CASE WHEN grouping(tool) = 0 THEN 'tool' WHEN grouping(model) = 0 THEN 'model' ELSE 'day' END AS axis, coalesce(tool, model, CAST(day AS VARCHAR)) AS key, count(*) AS calls, round(sum(value), 4) AS saved FROM g GROUP BY GROUPING SETS ((tool), (model), (day))""")
def savings(spark, sf):
    """What was saved by tool, by model and by day, from one scan."""
    tool = F.when(F.col("event_type") == "error", "(unknown)").otherwise(F.col("event_type"))
    e = read(spark, sf, "events").select(tool.alias("tool"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.to_date("ts").cast("string").alias("day"), "value")
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("key")) for a in ("tool", "model", "day")])).alias("a")
    return e.select("value", axes).groupBy("a.axis", "a.key").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("saved"))


@query("""WITH o AS (SELECT p_partkey AS id, p_brand, p_type, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'team-one' END AS r1, CASE WHEN p_type = 'ECONOMY' THEN 'team-economy' END AS r2, CASE WHEN p_brand = 'Brand#12' THEN 'team-twelve' END AS r3 FROM part)
SELECT coalesce(r3, r2, r1, '(none)') AS owner, count(*) AS files FROM o GROUP BY 1""")
def codeowners(spark, sf):
    """Rules in order, of which the last that matches a path names its owner."""
    path = F.concat_ws("/", F.lit("parts"), "p_brand", "p_type")
    rules = [("parts/Brand#1*/**", "team-one"), ("**/ECONOMY", "team-economy"), ("parts/Brand#12/**", "team-twelve")]
    owner = F.coalesce(*[F.when(path.rlike(ids.glob_regex(g)), o) for g, o in reversed(rules)], F.lit("(none)"))
    return read(spark, sf, "part").groupBy(owner.alias("owner")).agg(F.count("*").alias("files"))


@query("""WITH s AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank, vec_id % 4 = 0 AS hit FROM embeddings), q AS (SELECT label, count(*) FILTER (WHERE hit) AS relevant, count(*) FILTER (WHERE hit AND rank <= 10) AS found, sum(1.0::DOUBLE / log2(rank + 1)) FILTER (WHERE hit AND rank <= 10) AS dcg, max(1.0::DOUBLE / rank) FILTER (WHERE hit) AS rr FROM s GROUP BY label)
SELECT label, round(found / 10.0::DOUBLE, 6) AS p_10, round(least(1.0, found / CAST(relevant AS DOUBLE)), 6) AS r_10, round(coalesce(dcg, 0) / (SELECT sum(1.0::DOUBLE / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= relevant), 6) AS ndcg_10, round(rr, 6) AS rr FROM q WHERE relevant > 0""")
def ranking_quality(spark, sf):
    """Precision, recall, nDCG and reciprocal rank at ten; every fourth vector counts as relevant."""
    s = read(spark, sf, "embeddings").select("label", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("rank"), (F.col("vec_id") % 4 == 0).alias("hit"))
    top = F.col("hit") & (F.col("rank") <= 10)
    q = s.groupBy("label").agg(F.count_if("hit").alias("relevant"), F.count_if(top).alias("found"), F.sum(F.when(top, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"), F.max(F.when(F.col("hit"), 1.0 / F.col("rank"))).alias("rr")).where("relevant > 0")
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.col("relevant").cast("int"))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    return q.select("label", F.round(F.col("found") / 10.0, 6).alias("p_10"), F.round(F.least(F.lit(1.0), F.col("found") / F.col("relevant")), 6).alias("r_10"), F.round(F.col("dcg") / best, 6).alias("ndcg_10"), F.round("rr", 6).alias("rr"))


@query("""WITH m AS (SELECT max(ts) AS now FROM events) SELECT user_id, round(least(1.5, sum(pow(0.5::DOUBLE, date_diff('second', ts, now) / 86400.0::DOUBLE / 10))), 4) AS frecency, round(greatest(0.0, least(1.0, 1 - date_diff('second', max(ts), any_value(now)) / 86400.0::DOUBLE / 30)), 4) AS novelty FROM events, m GROUP BY 1""")
def frecency_and_novelty(spark, sf):
    """Half-life of ten days, boost of 1.5 at most; novelty falls from one to none within thirty days."""
    e = read(spark, sf, "events")
    now = e.agg(F.max(F.unix_timestamp("ts"))).first()[0]
    days = (F.lit(now) - F.unix_timestamp("ts")) / 86400.0
    by = e.groupBy("user_id").agg(F.sum(F.pow(F.lit(0.5), days / 10)).alias("f"), F.min(days).alias("d"))
    return by.select("user_id", F.round(F.least(F.lit(1.5), "f"), 4).alias("frecency"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("d") / 30)), 4).alias("novelty"))
