"""Usages, callers, hierarchies, bounded walks and look-ups by name."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import traverse
from graphloom.plans.graph import BFS_SQL
from graphloom.plans.query import query
from graphloom.sources.fixture import edges, links, nodes, read

USES = ("calls", "references")
CUT_SQL = ", r AS (SELECT id, depth, row_number() OVER (ORDER BY depth, id) AS n, count(*) OVER () AS total FROM m WHERE depth > 0) SELECT id, depth, total > {limit} AS truncated FROM r WHERE n <= {limit}"


def _cut(found, limit):
    """The first rows by depth and id, with a flag that others were left out."""
    met = found.where("depth > 0").select("id", "depth")
    total = met.count()
    return met.orderBy("depth", "id").limit(limit).withColumn("truncated", F.lit(total > limit))


@query(BFS_SQL.format(a="dst", b="src", where="WHERE kind IN ('calls', 'references')", seed="id = 'supplier/2'", depth=2) + CUT_SQL.format(limit=50), graph=True)
def get_callers(spark, sf):
    return _cut(traverse.bfs(spark, links(spark, sf), nodes(spark, sf).where("id = 'supplier/2'"), 2, "in", USES, anew=True), 50)


@query(BFS_SQL.format(a="src", b="dst", where="WHERE kind = 'calls'", seed="id LIKE 'customer/2_'", depth=3) + CUT_SQL.format(limit=200), graph=True)
def get_call_chain(spark, sf):
    return _cut(traverse.bfs(spark, links(spark, sf), nodes(spark, sf).where("id like 'customer/2_'"), 3, "out", ("calls",), anew=True), 200)


@query(BFS_SQL.format(a="src", b="dst", where="WHERE kind IN ('calls', 'references', 'member_of')", seed="id = 'order/1'", depth=3) + CUT_SQL.format(limit=500), graph=True)
def get_dependencies(spark, sf):
    return _cut(traverse.bfs(spark, links(spark, sf), nodes(spark, sf).where("id = 'order/1'"), 3, "out", (*USES, "member_of"), anew=True), 500)


@query(BFS_SQL.format(a="dst", b="src", where="WHERE kind IN ('calls', 'references', 'member_of')", seed="id = 'nation/3'", depth=2) + CUT_SQL.format(limit=500), graph=True)
def get_dependents(spark, sf):
    return _cut(traverse.bfs(spark, links(spark, sf), nodes(spark, sf).where("id = 'nation/3'"), 2, "in", (*USES, "member_of"), anew=True), 500)


@query("""SELECT e.dst AS target, e.src AS used_by, e.kind, e.line, n.file_path FROM edges e JOIN nodes n ON n.id = e.src JOIN nodes t ON t.id = e.dst WHERE t.kind IN ('method', 'type') AND e.kind IN ('calls', 'references', 'reads', 'writes', 'imports')""", graph=True)
def find_usages(spark, sf):
    """One step back over the kinds that use something; repeated sites stay apart."""
    n = nodes(spark, sf)
    target = n.where("kind in ('method', 'type')").select(F.col("id").alias("dst"))
    site = n.select(F.col("id").alias("src"), "file_path")
    use = edges(spark, sf).where(F.col("kind").isin(*USES, "reads", "writes", "imports"))
    return use.join(target, "dst", "left_semi").join(site, "src").select(F.col("dst").alias("target"), F.col("src").alias("used_by"), "kind", "line", "file_path")


@query("""g AS (SELECT e.dst AS target, n.file_path, count(*) AS uses, md5(string_agg(e.src || ':' || e.line, ',' ORDER BY e.src, e.line)) AS sites_md5 FROM edges e JOIN nodes n ON n.id = e.src WHERE e.kind = 'references' GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY target ORDER BY uses DESC, file_path) AS place FROM g""", graph=True)
def usage_files(spark, sf):
    """Usages by file with the list of sites, files with most first."""
    n = nodes(spark, sf).select(F.col("id").alias("src"), "file_path")
    by = edges(spark, sf).where("kind = 'references'").join(n, "src").groupBy(F.col("dst").alias("target"), "file_path").agg(F.count("*").alias("uses"), F.sort_array(F.collect_list(F.struct("src", "line"))).alias("sites"))
    listed = F.array_join(F.transform("sites", lambda s: F.concat_ws(":", s["src"], s["line"].cast("string"))), ",")
    return by.select("target", "file_path", "uses", F.md5(listed).alias("sites_md5"), F.row_number().over(Window.partitionBy("target").orderBy(F.col("uses").desc(), "file_path")).alias("place"))


@query("""SELECT e.dst AS interface, e.src AS implementor, n.name, n.file_path FROM edges e JOIN nodes n ON n.id = e.src WHERE e.kind = 'member_of' AND n.kind = 'type'""", graph=True)
def find_implementations(spark, sf):
    """Types that are members of a module stand for those that implement an interface."""
    types = nodes(spark, sf).where("kind = 'type'").select(F.col("id").alias("src"), "name", "file_path")
    return edges(spark, sf).where("kind = 'member_of'").join(types, "src").select(F.col("dst").alias("interface"), F.col("src").alias("implementor"), "name", "file_path")


@query("""s AS (SELECT DISTINCT src AS a, dst AS b FROM edges WHERE kind = 'member_of'), w AS (SELECT id AS seed, id, 0 AS depth, id AS path FROM nodes WHERE kind = 'type' UNION ALL SELECT w.seed, s.b, w.depth + 1, w.path || ' > ' || s.b FROM w JOIN s ON s.a = w.id WHERE w.depth < 4)
SELECT seed, id, depth, path FROM w WHERE depth > 0""", graph=True)
def class_hierarchy(spark, sf):
    """Every type's ancestors with the path that leads to them."""
    return traverse.ancestors(spark, edges(spark, sf).where("kind = 'member_of'"), nodes(spark, sf).where("kind = 'type'"), 4)


@query("""f AS (SELECT id FROM nodes WHERE kind = 'module'), x AS (SELECT e.src AS id, e.kind, count(*) AS links FROM edges e JOIN f ON f.id = e.dst WHERE e.kind = 'member_of' GROUP BY 1, 2)
SELECT x.id, x.kind, links FROM x JOIN nodes n ON n.id = x.id ORDER BY x.id LIMIT 100""", graph=True)
def expand_frontier(spark, sf):
    """The neighbours of a set of nodes, a number at most, smallest ids first."""
    n = nodes(spark, sf)
    step = edges(spark, sf).where("kind = 'member_of'").join(n.where("kind = 'module'").select(F.col("id").alias("dst")), "dst", "left_semi")
    met = step.groupBy(F.col("src").alias("id"), "kind").agg(F.count("*").alias("links"))
    return met.join(n.select("id"), "id", "left_semi").orderBy("id").limit(100)


@query(BFS_SQL.format(a="src", b="dst", where="", seed="id = 'customer/2'", depth=4) + """, r AS (SELECT m.id, depth, sum((length(m.id) + length(n.name) + 28) * 10 // 35) OVER (ORDER BY depth, m.id) AS tokens FROM m JOIN nodes n ON n.id = m.id)
SELECT id, depth, CAST(tokens AS BIGINT) AS tokens FROM r WHERE tokens <= 400""", graph=True)
def walk_budgeted(spark, sf):
    """A walk that ends where the estimate of what it shows passes 400 tokens; a node costs 28 bytes beside its names."""
    n = nodes(spark, sf).select("id", "name")
    met = traverse.bfs(spark, links(spark, sf), n.where("id = 'customer/2'"), 4, nodes=n).join(n, "id")
    cost = F.expr("(length(id) + length(name) + 28) * 10 div 35")
    return met.select("id", "depth", F.sum(cost).over(Window.orderBy("depth", "id")).alias("tokens")).where("tokens <= 400")


@query(BFS_SQL.format(a="src", b="dst", where="WHERE kind IN ('calls', 'references') AND dst NOT LIKE 'part/%7'", seed="id LIKE 'customer/1_'", depth=6) + """, r AS (SELECT id, depth FROM m ORDER BY depth, id LIMIT 400), e AS (SELECT s.a AS id, count(*) AS links FROM s JOIN r ON r.id = s.a WHERE r.depth < 6 GROUP BY 1)
SELECT r.id, depth AS distance, coalesce(links, 0) AS links FROM r LEFT JOIN e ON e.id = r.id""", graph=True)
def import_closure(spark, sf):
    """What some customers need, the nearest first, with the links met at each; parts whose number ends in 7 are out of scope."""
    n = nodes(spark, sf).where("id not like 'part/%7'")
    met, links, _ = traverse.nearest(spark, n, edges(spark, sf), n.where("id like 'customer/1_'"))
    by = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("links"))
    return met.join(by, "id", "left").fillna(0, ["links"])


@query("""t AS (SELECT n.file_path, e.kind, CASE WHEN n.file_path = m.file_path THEN 'inner' ELSE 'out' END AS side FROM edges e JOIN nodes n ON n.id = e.src JOIN nodes m ON m.id = e.dst UNION ALL SELECT m.file_path, e.kind, 'in' FROM edges e JOIN nodes n ON n.id = e.src JOIN nodes m ON m.id = e.dst WHERE n.file_path <> m.file_path),
c AS (SELECT file_path, count(*) FILTER (WHERE side = 'inner') AS inner_edges, count(*) FILTER (WHERE side = 'in') AS in_edges, count(*) FILTER (WHERE side = 'out') AS out_edges FROM t GROUP BY 1), k AS (SELECT file_path, count(*) AS nodes FROM nodes GROUP BY 1)
SELECT k.file_path, nodes, coalesce(inner_edges, 0) AS inner_edges, coalesce(in_edges, 0) AS in_edges, coalesce(out_edges, 0) AS out_edges FROM k LEFT JOIN c ON c.file_path = k.file_path""", graph=True)
def file_subgraph_counts(spark, sf):
    n = nodes(spark, sf).select("id", "file_path")
    ends = edges(spark, sf).select("src", "dst").join(n.select(F.col("id").alias("src"), F.col("file_path").alias("f")), "src").join(n.select(F.col("id").alias("dst"), F.col("file_path").alias("t")), "dst")
    by = ends.groupBy("f", "t").agg(F.count("*").alias("c"))  # few rows, so both sides of an edge are counted from it
    inner, none = F.when(F.col("f") == F.col("t"), F.col("c")), F.lit(0)
    out = by.select(F.col("f").alias("at"), F.coalesce(inner, none).alias("inner_edges"), none.alias("in_edges"), F.when(F.col("f") != F.col("t"), F.col("c")).otherwise(none).alias("out_edges"))
    into = by.where("f <> t").select(F.col("t").alias("at"), none.alias("inner_edges"), F.col("c").alias("in_edges"), none.alias("out_edges"))
    sums = out.unionByName(into).groupBy("at").agg(*[F.sum(c).alias(c) for c in ("inner_edges", "in_edges", "out_edges")])
    return n.groupBy("file_path").agg(F.count("*").alias("nodes")).join(sums, F.col("file_path") == F.col("at"), "left").drop("at").fillna(0, ["inner_edges", "in_edges", "out_edges"])


@query("""r AS (SELECT id, name, CASE WHEN lower(name) = 'red ring' THEN 0 WHEN starts_with(lower(name), 'red ring') THEN 1 WHEN contains(lower(name), 'red') THEN 2 WHEN contains(lower(id), 'red') THEN 3 END AS tier FROM nodes WHERE kind NOT IN ('file', 'import') AND strlen(lower(name)) = strlen(name))
SELECT id, name, tier, row_number() OVER (ORDER BY tier, strlen(name), id) AS place FROM r WHERE tier IS NOT NULL ORDER BY place LIMIT 100""", graph=True)
def substring_rank(spark, sf):
    """Exact name, prefix, part of the name, part of the id; ties by bytes of the name, then id. Names that folding lengthens don't match."""
    low = F.lower("name")
    tier = F.when(low == "red ring", 0).when(low.startswith("red ring"), 1).when(low.contains("red"), 2).when(F.lower("id").contains("red"), 3)
    rows = nodes(spark, sf).where(~F.col("kind").isin("file", "import") & (F.octet_length(low) == F.octet_length("name"))).select("id", "name", tier.alias("tier")).where("tier is not null")
    by = ["tier", F.octet_length("name"), "id"]
    return rows.orderBy(*by).limit(100).withColumn("place", F.row_number().over(Window.orderBy(*by)))


@query("""r AS (SELECT id, file_path, row_number() OVER (ORDER BY name, id) AS place FROM nodes WHERE kind = 'method' ORDER BY name, id LIMIT 200), k AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY place) AS nth FROM r)
SELECT id, row_number() OVER (ORDER BY place + 3 * greatest(0, nth - 2), place) AS place FROM k""", graph=True)
def file_diversity(spark, sf):
    """From the third row of a file on, a row falls three places for each earlier one; the order is stable."""
    top = nodes(spark, sf).where("kind = 'method'").orderBy("name", "id").limit(200).select("id", "file_path", F.row_number().over(Window.orderBy("name", "id")).alias("place"))
    nth = F.row_number().over(Window.partitionBy("file_path").orderBy("place"))
    return top.withColumn("low", F.col("place") + 3 * F.greatest(F.lit(0), nth - 2)).select("id", F.row_number().over(Window.orderBy("low", "place")).alias("place"))


@query("""SELECT 'CREATE (:' || kind || ' {id: ''' || id || ''', name: ''' || replace(name, '''', '\\''') || '''})' AS statement FROM nodes WHERE kind <> 'variable'
UNION ALL SELECT 'MATCH (a {id: ''' || src || '''}), (b {id: ''' || dst || '''}) CREATE (a)-[:' || upper(kind) || ' {line: ' || line || '}]->(b)' FROM edges WHERE kind = 'member_of'""", graph=True)
def export_cypher(spark, sf):
    n = nodes(spark, sf).where("kind <> 'variable'").select(F.format_string("CREATE (:%s {id: '%s', name: '%s'})", "kind", "id", F.replace("name", F.lit("'"), F.lit("\\'"))).alias("statement"))
    e = edges(spark, sf).where("kind = 'member_of'").select(F.format_string("MATCH (a {id: '%s'}), (b {id: '%s'}) CREATE (a)-[:%s {line: %d}]->(b)", "src", "dst", F.upper("kind"), "line").alias("statement"))
    return n.unionByName(e)


@query("""SELECT '  ' || replace(src, '/', '_') || ' -->|' || kind || '| ' || replace(dst, '/', '_') AS line FROM edges WHERE kind IN ('member_of', 'references')""", graph=True)
def export_mermaid(spark, sf):
    flat = lambda c: F.replace(c, F.lit("/"), F.lit("_"))
    return edges(spark, sf).where("kind in ('member_of', 'references')").select(F.concat(F.lit("  "), flat("src"), F.lit(" -->|"), "kind", F.lit("| "), flat("dst")).alias("line"))


@query("""SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n, count(DISTINCT user_id) AS users, max(ts) AS last FROM events GROUP BY 1""")
def jsonl_events(spark, sf):
    """Fields of JSON records, parsed by a schema."""
    e = read(spark, sf, "events").select("user_id", "ts", F.from_json("props", "k int").alias("p"))
    return e.groupBy(F.col("p.k").alias("k")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.max("ts").alias("last"))
