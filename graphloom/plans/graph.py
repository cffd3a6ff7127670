"""Traversal and centrality."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import identifiers as ids
from graphloom.operators import centrality, traverse
from graphloom.operators.components import by_number, connected_components
from graphloom.plans.query import query
from graphloom.sources.fixture import clicks, edges, links, nodes, read, trade


def _nations(spark, sf):
    return read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"))


RANK_SQL = """n AS (SELECT n_nationkey AS id FROM nation), o AS (SELECT src, sum(weight) AS total FROM trade GROUP BY src),
l AS (SELECT t.src, t.dst, t.weight / o.total AS share FROM trade t JOIN o ON o.src = t.src), b AS (SELECT id, {base} AS base FROM n),
r AS (SELECT 0 AS i, id, base AS score FROM b UNION ALL (
  SELECT i + 1, id, base * (0.15 + 0.85 * (1 - total)) + 0.85 * flow FROM (
    SELECT i, id, base, flow, sum(flow) OVER () AS total FROM (
      SELECT any_value(r.i) AS i, b.id, any_value(b.base) AS base, sum(coalesce(r.score * l.share, 0)) AS flow FROM r JOIN b ON true LEFT JOIN l ON l.src = r.id AND l.dst = b.id WHERE r.i < 40 GROUP BY b.id))))
SELECT id, round(score, 6) AS score FROM r WHERE i = 40"""


@query(RANK_SQL.format(base="1.0::DOUBLE / (SELECT count(*) FROM n)"), graph=True)
def pagerank(spark, sf):
    return centrality.pagerank(spark, _nations(spark, sf), trade(spark, sf)).select("id", F.round("score", 6).alias("score"))


@query(RANK_SQL.format(base="CASE WHEN id IN (3, 7) THEN 0.5::DOUBLE ELSE 0::DOUBLE END"), graph=True)
def personalized_pagerank(spark, sf):
    seeds = _nations(spark, sf).where(F.col("id").isin(3, 7))
    return centrality.pagerank(spark, _nations(spark, sf), trade(spark, sf), seeds=seeds).select("id", F.round("score", 6).alias("score"))


@query()
def hits(spark, sf):
    return centrality.hits(spark, trade(spark, sf)).select("id", F.round("authority", 6).alias("authority"), F.round("hub", 6).alias("hub"))


@query()
def kcore(spark, sf):
    """Over the edges of all kinds."""
    return centrality.kcore(spark, links(spark, sf))


@query("""f AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'references'), p AS (SELECT src AS a, dst AS b FROM f UNION SELECT dst, src FROM f),
w AS (SELECT a AS id, a AS root FROM p UNION SELECT p.b, w.root FROM w JOIN p ON p.a = w.id) SELECT id, min(root) AS component FROM w GROUP BY id""", graph=True)
def wcc(spark, sf):
    e = edges(spark, sf).where("kind = 'references'").select("src", "dst")
    return by_number(spark, e, lambda n: connected_components(spark, n, "src", "dst").withColumnRenamed("node", "id"))


@query("""p AS (SELECT src, dst FROM clicks WHERE src <> dst), w AS (SELECT src AS a, dst AS b FROM p UNION SELECT w.a, p.dst FROM w JOIN p ON p.src = w.b), n AS (SELECT src AS id FROM clicks UNION SELECT dst FROM clicks)
SELECT n.id, least(n.id, min(x.b)) AS component FROM n LEFT JOIN (SELECT u.a, u.b FROM w u JOIN w v ON v.a = u.b AND v.b = u.a) x ON x.a = n.id GROUP BY n.id""", graph=True)
def scc(spark, sf):
    return centrality.scc(spark, clicks(spark, sf))


def calls(spark, sf):
    """(src, dst, weight): calls and references of the commerce graph, weighted by where they are known from."""
    e = edges(spark, sf).where(F.col("kind").isin("calls", "references"))
    return e.select("src", "dst", ids.provenance_weight(F.col("origin")).alias("weight"))


@query()
def commerce_pagerank(spark, sf, iterations=40):
    return centrality.pagerank(spark, nodes(spark, sf).select("id"), calls(spark, sf), iterations)


@query()
def commerce_personalized_pagerank(spark, sf, iterations=40):
    n = nodes(spark, sf).select("id")
    return centrality.pagerank(spark, n, calls(spark, sf), iterations, seeds=n.where("id like 'customer/1_'"))


@query()
def commerce_hits(spark, sf, iterations=40):
    return centrality.hits(spark, calls(spark, sf), iterations)


@query()
def commerce_scc(spark, sf):
    return by_number(spark, calls(spark, sf).select("src", "dst"), lambda n: centrality.scc(spark, n))


BFS_SQL = """s AS (SELECT DISTINCT {a} AS a, {b} AS b, kind FROM edges {where}), w AS (SELECT id, 0 AS depth FROM nodes WHERE {seed} UNION SELECT s.b, w.depth + 1 FROM w JOIN s ON s.a = w.id WHERE w.depth < {depth}), m AS (SELECT id, min(depth) AS depth FROM w GROUP BY id)"""


@query(BFS_SQL.format(a="src", b="dst", where="", seed="id = 'customer/1'", depth=4) + """, f AS (SELECT m.id, m.depth, s.a AS parent, s.kind, row_number() OVER (PARTITION BY m.id ORDER BY s.a, s.kind) AS n FROM m LEFT JOIN (s JOIN m p ON p.id = s.a) ON s.b = m.id AND p.depth = m.depth - 1)
SELECT id, depth, parent, kind FROM f WHERE n = 1""", graph=True)
def bfs(spark, sf):
    n = nodes(spark, sf).select("id")
    return traverse.bfs(spark, links(spark, sf), n.where("id = 'customer/1'"), 4, nodes=n)


@query(BFS_SQL.format(a="src", b="dst", where="WHERE kind IN ('calls', 'references')", seed="id LIKE 'customer/1_'", depth=99) + " SELECT id FROM m", graph=True)
def reachable_forward(spark, sf):
    return traverse.closure(spark, links(spark, sf), nodes(spark, sf).where("id like 'customer/1_'"), ("calls", "references"))


@query(BFS_SQL.format(a="dst", b="src", where="WHERE kind IN ('calls', 'references')", seed="id = 'supplier/1'", depth=3) + """ SELECT depth, count(*) AS n, md5(string_agg(id, ',' ORDER BY id)) AS ids_md5 FROM m WHERE depth > 0 GROUP BY depth""", graph=True)
def reach_tiers(spark, sf):
    out = traverse.reach_tiers(spark, links(spark, sf), nodes(spark, sf).where("id = 'supplier/1'"), ("calls", "references"))
    return out.select("depth", "n", F.md5(F.array_join("ids", ",")).alias("ids_md5"))


@query("""k AS (SELECT n_nationkey FROM nation), c AS (SELECT id FROM nodes WHERE kind = 'function' AND lower(language) = 'building' ORDER BY id LIMIT 1000),
o AS (SELECT DISTINCT e.dst AS id FROM edges e JOIN c ON c.id = e.src WHERE e.kind = 'calls'), o2 AS (SELECT id FROM nodes WHERE id IN (SELECT id FROM o) ORDER BY id LIMIT 1000),
p AS (SELECT DISTINCT e.dst AS id FROM edges e JOIN o2 ON o2.id = e.src WHERE e.kind = 'calls'), p2 AS (SELECT id, name FROM nodes WHERE id IN (SELECT id FROM p) ORDER BY id LIMIT 1000) SELECT id, name FROM p2""", graph=True)
def graph_query(spark, sf):
    out = traverse.graph_query(spark, nodes(spark, sf), edges(spark, sf), "nodes kind=function lang=building | traverse calls out | traverse calls out")
    return out.select("id", "name")


@query("""g AS (SELECT src, dst, max(confidence) AS c FROM edges GROUP BY src, dst),
w AS (SELECT ['customer/1'] AS p, 'customer/1' AS spot, 1.0::DOUBLE AS c UNION ALL SELECT list_append(w.p, g.dst), g.dst, w.c * g.c FROM w JOIN g ON g.src = w.spot WHERE NOT list_contains(w.p, g.dst) AND len(w.p) <= 5 AND w.spot <> 'region/' || (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey = 1))
SELECT array_to_string(p, ' > ') AS path, CAST(len(p) - 1 AS INT) AS length, round(c, 6) AS confidence FROM w WHERE spot = 'region/' || (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey = 1) AND len(p) = 3 ORDER BY length, confidence DESC, path LIMIT 1""", graph=True)
def shortest_path(spark, sf):
    region = read(spark, sf, "customer").where("c_custkey = 1").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    return traverse.shortest_paths(spark, edges(spark, sf), "customer/1", f"region/{region}", 1, 5)


@query("""s AS (SELECT DISTINCT id FROM nodes WHERE kind = 'function' AND repo_prefix = 'EUROPE'), o AS (SELECT DISTINCT e.dst AS id FROM edges e JOIN s ON s.id = e.src WHERE e.kind = 'calls'), p AS (SELECT DISTINCT e.dst AS id FROM edges e JOIN o ON o.id = e.src WHERE e.kind = 'calls')
SELECT id, name FROM nodes n WHERE kind = 'method' AND id NOT IN (SELECT id FROM p)""", graph=True)
def untested_symbols(spark, sf):
    """Methods that no function of the European repository reaches by calls."""
    n = nodes(spark, sf)
    covered = traverse.closure(spark, links(spark, sf), n.where("kind = 'function' and repo_prefix = 'EUROPE'"), ("calls",))
    return n.where("kind = 'method'").join(covered, "id", "left_anti").select("id", "name")


@query("""x AS (SELECT max(src) AS a, min(src) AS b FROM clicks), w AS (SELECT b AS id FROM x UNION SELECT c.dst FROM w JOIN clicks c ON c.src = w.id) SELECT bool_or(w.id = x.a) AS would_cycle FROM w, x""", graph=True)
def would_create_cycle(spark, sf):
    """Whether an edge from the last event type to the first would close a cycle: is the one reachable from the other?"""
    e = clicks(spark, sf).withColumn("kind", F.lit("calls"))
    a, b = e.agg(F.max("src"), F.min("src")).first()
    seeds = e.where(F.col("src") == b).select(F.col("src").alias("id")).limit(1)
    return traverse.closure(spark, e, seeds, ("calls",)).agg(F.bool_or(F.col("id") == a).alias("would_cycle"))
