"""Scans, filters, joins, aggregates, windows, top-k and set operations over the graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import identifiers as ids
from graphloom.operators import community
from graphloom.plans.query import query
from graphloom.sources.fixture import edges, nodes, read

HOME = "regexp_extract({0}, '^[^/]*(/[^/]*)?')"


@query("""SELECT kind, count(*) AS nodes, count(DISTINCT language) AS languages, min(start_line) AS first_line, max(end_line) AS last_line FROM nodes GROUP BY kind""", graph=True)
def node_scan(spark, sf):
    return nodes(spark, sf).groupBy("kind").agg(F.count("*").alias("nodes"), F.count_distinct("language").alias("languages"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))


@query("""SELECT n.id, n.name, e.kind, e.dst FROM nodes n JOIN edges e ON e.src = n.id WHERE n.kind = 'type' OR n.id LIKE 'nation/%'""", graph=True)
def adjacency_lookup(spark, sf):
    some = nodes(spark, sf).where((F.col("kind") == "type") | F.col("id").startswith("nation/")).select("id", "name")
    return some.join(edges(spark, sf).select("src", "kind", "dst"), F.col("id") == F.col("src")).select("id", "name", "kind", "dst")


@query("""r AS (SELECT src, dst, kind, line, row_number() OVER (PARTITION BY src ORDER BY dst, kind, line) AS n, count(*) OVER (PARTITION BY src) AS c FROM edges WHERE kind IN ('calls', 'references'))
SELECT src, dst, kind, line FROM r WHERE c <= 4""", graph=True)
def bounded_adjacency(spark, sf):
    """Keys with more than four rows return none."""
    rows = edges(spark, sf).where(F.col("kind").isin("calls", "references")).select("src", "dst", "kind", "line")
    over = rows.groupBy(F.col("src").alias("s")).agg(F.count("*").alias("c")).where("c > 4")
    return rows.join(over, F.col("src") == F.col("s"), "left_anti")


@query("""u AS (SELECT id, name || '!' AS name, 2 AS v FROM nodes WHERE kind IN ('module', 'type') UNION ALL SELECT id, name, 1 FROM nodes WHERE kind IN ('module', 'type', 'package')),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC) AS n FROM u) SELECT id, name, v FROM r WHERE n = 1""", graph=True)
def node_upsert(spark, sf):
    base = nodes(spark, sf).where(F.col("kind").isin("module", "type", "package")).select("id", "name", F.lit(1).alias("v"))
    batch = nodes(spark, sf).where(F.col("kind").isin("module", "type")).select("id", F.concat("name", F.lit("!")).alias("name"), F.lit(2).alias("v"))
    return batch.unionByName(base).groupBy("id").agg(F.max_by("name", "v").alias("name"), F.max("v").alias("v"))


@query("""SELECT src, dst, kind, count(*) AS sites FROM (SELECT src, dst, kind, line FROM edges UNION SELECT src, dst, kind, line FROM edges WHERE kind = 'calls') GROUP BY 1, 2, 3 HAVING count(*) > 1""", graph=True)
def edge_insert_ignore(spark, sf):
    key = ["src", "dst", "kind", "line"]
    e = edges(spark, sf).select(*key)
    return e.unionByName(e.where("kind = 'calls'")).repartition("src", "dst", "kind").dropDuplicates(key).groupBy("src", "dst", "kind").agg(F.count("*").alias("sites")).where("sites > 1")


@query("""SELECT id, name FROM nodes WHERE repo_prefix IN ('EUROPE', 'ASIA') AND lower(language) = 'building' AND contains(lower(file_path), 'customer')""", graph=True)
def scope_filter(spark, sf):
    n = nodes(spark, sf).where(F.col("repo_prefix").isin("EUROPE", "ASIA") & (F.lower("language") == "building") & F.lower("file_path").contains("customer"))
    return n.select("id", "name")


RANK_SQL = "CASE origin WHEN 'lsp_resolved' THEN 5 WHEN 'lsp_dispatch' THEN 4 WHEN 'ast_resolved' THEN 3 WHEN 'ast_inferred' THEN 2 WHEN 'text_matched' THEN 1 ELSE 0 END"


@query(f"""SELECT kind, count(*) AS kept, min({RANK_SQL}) AS least_rank, max({RANK_SQL}) AS best_rank FROM edges WHERE {RANK_SQL} >= 3 GROUP BY kind""", graph=True)
def min_tier_filter(spark, sf):
    rank = ids.origin_rank(F.col("origin"))
    return edges(spark, sf).withColumn("r", rank).where("r >= 3").groupBy("kind").agg(F.count("*").alias("kept"), F.min("r").alias("least_rank"), F.max("r").alias("best_rank"))


@query(f"""b AS (SELECT *, max({RANK_SQL}) OVER (PARTITION BY dst) AS best FROM edges WHERE kind = 'calls')
SELECT dst, count(*) FILTER (WHERE NOT (origin = 'text_matched' AND best > 1)) AS kept, count(*) FILTER (WHERE origin = 'text_matched' AND best > 1) AS suppressed FROM b GROUP BY dst""", graph=True)
def text_match_suppression(spark, sf):
    """A text match counts only where a target has nothing better."""
    calls = edges(spark, sf).where("kind = 'calls'")
    text = F.count_if(F.col("origin") == "text_matched")
    by = calls.groupBy("dst").agg(F.count("*").alias("n"), text.alias("t"), F.max(ids.origin_rank(F.col("origin"))).alias("best"))
    hidden = F.when(F.col("best") > 1, F.col("t")).otherwise(F.lit(0))
    return by.select("dst", (F.col("n") - hidden).alias("kept"), hidden.alias("suppressed"))


@query("""i AS (SELECT dst AS id, count(*) AS fan_in FROM edges GROUP BY dst), o AS (SELECT src AS id, count(*) AS fan_out FROM edges GROUP BY src)
SELECT n.id, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM nodes n LEFT JOIN i ON i.id = n.id LEFT JOIN o ON o.id = n.id""", graph=True)
def degrees(spark, sf):
    e = edges(spark, sf)
    ends = e.select(F.col("dst").alias("at"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(e.select(F.col("src").alias("at"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    by = ends.groupBy("at").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return nodes(spark, sf).select("id").join(by, F.col("id") == F.col("at"), "left").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


@query("""SELECT kind, origin, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM edges GROUP BY kind, origin""", graph=True)
def edge_histogram(spark, sf):
    by = edges(spark, sf).groupBy("kind", "origin").agg(F.count("*").alias("n"))
    return by.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


COUPLING_SQL = """u AS (SELECT id, regexp_extract(file_path, '^[^/]*/[^/]*') AS unit FROM nodes),
p AS (SELECT DISTINCT a.unit AS f, b.unit AS t FROM edges e JOIN u a ON a.id = e.src JOIN u b ON b.id = e.dst WHERE e.kind IN ('calls', 'references') AND a.unit <> b.unit),
c AS (SELECT unit, count(*) FILTER (WHERE d = 'in') AS ca, count(*) FILTER (WHERE d = 'out') AS ce FROM (SELECT t AS unit, 'in' AS d FROM p UNION ALL SELECT f, 'out' FROM p) GROUP BY unit)"""


@query(COUPLING_SQL + " SELECT unit, ca, ce, round(ce / CAST(ca + ce AS DOUBLE), 6) AS instability FROM c", graph=True)
def coupling(spark, sf):
    """Afferent and efferent units and instability of each package of two levels."""
    unit = nodes(spark, sf).select("id", F.regexp_extract("file_path", "^[^/]*/[^/]*", 0).alias("unit"))
    e = edges(spark, sf).where(F.col("kind").isin("calls", "references")).select("src", "dst")
    a, b = unit.select(F.col("id").alias("src"), F.col("unit").alias("f")), unit.select(F.col("id").alias("dst"), F.col("unit").alias("t"))
    pairs = e.join(a, "src").join(b, "dst").where("f <> t").select("f", "t").distinct()
    ends = pairs.select(F.col("t").alias("unit"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(pairs.select(F.col("f").alias("unit"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    by = ends.groupBy("unit").agg(F.sum("i").alias("ca"), F.sum("o").alias("ce"))
    return by.withColumn("instability", F.round(F.col("ce") / (F.col("ca") + F.col("ce")), 6))


@query("""i AS (SELECT DISTINCT dst AS id FROM edges), o AS (SELECT DISTINCT src AS id FROM edges),
c AS (SELECT n.kind, i.id IS NOT NULL AS has_in, o.id IS NOT NULL AS has_out FROM nodes n LEFT JOIN i ON i.id = n.id LEFT JOIN o ON o.id = n.id)
SELECT kind, count(*) AS nodes, count(*) FILTER (WHERE NOT has_in AND NOT has_out) AS isolated, count(*) FILTER (WHERE has_out AND NOT has_in) AS source_only, count(*) FILTER (WHERE has_in AND NOT has_out) AS sink_only FROM c GROUP BY kind""", graph=True)
def connectivity_health(spark, sf):
    e = edges(spark, sf)
    ends = e.select(F.col("dst").alias("at"), F.lit(True).alias("i"), F.lit(False).alias("o")).unionByName(e.select(F.col("src").alias("at"), F.lit(False).alias("i"), F.lit(True).alias("o")))
    by = ends.groupBy("at").agg(F.bool_or("i").alias("i"), F.bool_or("o").alias("o"))
    all_ = nodes(spark, sf).select("id", "kind").join(by, F.col("id") == F.col("at"), "left").fillna(False, ["i", "o"])
    return all_.groupBy("kind").agg(F.count("*").alias("nodes"), F.count_if(~F.col("i") & ~F.col("o")).alias("isolated"), F.count_if(F.col("o") & ~F.col("i")).alias("source_only"), F.count_if(F.col("i") & ~F.col("o")).alias("sink_only"))


@query("""SELECT g.kind AS src_kind, h.kind AS dst_kind, e.kind, count(*) AS n FROM edges e JOIN nodes g ON g.id = e.src JOIN nodes h ON h.id = e.dst GROUP BY GROUPING SETS ((g.kind, h.kind, e.kind), (e.kind), ())""", graph=True)
def hierarchy_rollup(spark, sf):
    n = nodes(spark, sf).select("id", "kind")
    e = edges(spark, sf).select("src", "dst", "kind").join(n.select(F.col("id").alias("src"), F.col("kind").alias("src_kind")), "src").join(n.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind")), "dst")
    return e.groupingSets([["src_kind", "dst_kind", "kind"], ["kind"], []], "src_kind", "dst_kind", "kind").agg(F.count("*").alias("n"))


@query("""p AS (SELECT a.repo_prefix AS from_repo, b.repo_prefix AS to_repo, e.kind FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.repo_prefix <> '' AND b.repo_prefix <> '' AND a.repo_prefix <> b.repo_prefix)
SELECT from_repo, to_repo, kind, count(*) AS n FROM p GROUP BY 1, 2, 3
UNION ALL SELECT a.region, b.region, 'trade', CAST(sum(weight) AS BIGINT) FROM trade JOIN place a ON a.nationkey = src JOIN place b ON b.nationkey = dst WHERE a.region <> b.region GROUP BY 1, 2""", graph=True)
def cross_repo(spark, sf):
    from graphloom.sources.fixture import places, trade

    n = nodes(spark, sf).select("id", "repo_prefix").where("repo_prefix <> ''")
    e = edges(spark, sf).select("src", "dst", "kind").join(n.select(F.col("id").alias("src"), F.col("repo_prefix").alias("from_repo")), "src").join(n.select(F.col("id").alias("dst"), F.col("repo_prefix").alias("to_repo")), "dst")
    by = e.where("from_repo <> to_repo").groupBy("from_repo", "to_repo", "kind").agg(F.count("*").alias("n"))
    p = places(spark, sf)
    t = trade(spark, sf).join(p.select(F.col("nationkey").alias("src"), F.col("region").alias("from_repo")), "src").join(p.select(F.col("nationkey").alias("dst"), F.col("region").alias("to_repo")), "dst")
    return by.unionByName(t.where("from_repo <> to_repo").groupBy("from_repo", "to_repo").agg(F.sum("weight").cast("long").alias("n")).select("from_repo", "to_repo", F.lit("trade").alias("kind"), "n"))


@query("""c AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'calls'), g AS (SELECT id, CAST(string_split(id, '/')[2] AS BIGINT) % 3 AS c FROM nodes),
i AS (SELECT dst AS id, count(*) AS c, bool_or(a.c <> b.c) AS foreign_ FROM c JOIN g a ON a.id = c.src JOIN g b ON b.id = c.dst GROUP BY dst), o AS (SELECT src AS id, count(*) AS c, bool_or(a.c <> b.c) AS foreign_ FROM c JOIN g a ON a.id = c.src JOIN g b ON b.id = c.dst GROUP BY src)
SELECT n.id, CASE WHEN i.c IS NULL AND o.c IS NULL THEN 'dead' WHEN i.c IS NULL THEN 'entry' WHEN o.c IS NULL THEN 'leaf' WHEN i.foreign_ AND o.foreign_ THEN 'adapter' WHEN i.c >= 3 AND o.c <= 2 AND n.end_line - n.start_line + 1 BETWEEN 1 AND 30 THEN 'utility' ELSE 'core' END AS role
FROM nodes n LEFT JOIN i ON i.id = n.id LEFT JOIN o ON o.id = n.id WHERE n.kind IN ('function', 'method', 'variable')""", graph=True)
def role(spark, sf):
    """Numbers modulo three stand for communities, which SQL has no way to find."""
    n = nodes(spark, sf)
    part = n.select("id", (F.split_part("id", F.lit("/"), F.lit(2)).cast("long") % 3).alias("community"))
    return community.roles(n.where(F.col("kind").isin("function", "method", "variable")), edges(spark, sf), part)


@query("""SELECT n.id, n.name FROM nodes n WHERE n.kind IN ('method', 'type', 'function') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = n.id AND e.kind IN ('calls', 'references', 'implements'))""", graph=True)
def dead_code(spark, sf):
    used = edges(spark, sf).where(F.col("kind").isin("calls", "references", "implements")).select(F.col("dst").alias("at"))
    return nodes(spark, sf).where(F.col("kind").isin("method", "type", "function")).join(used, F.col("id") == F.col("at"), "left_anti").select("id", "name")


@query("""d AS (SELECT n.id, count(e.src) AS fan_in FROM nodes n LEFT JOIN edges e ON e.dst = n.id WHERE n.kind = 'method' GROUP BY n.id), s AS (SELECT avg(fan_in) AS m, stddev_pop(fan_in) AS sd FROM d)
SELECT id, fan_in, round((fan_in - m) / nullif(sd, 0), 6) AS z FROM d, s WHERE fan_in > m + 2 * sd""", graph=True)
def hotspots(spark, sf):
    counts = edges(spark, sf).groupBy(F.col("dst").alias("at")).agg(F.count("*").alias("fan_in"))
    d = nodes(spark, sf).where("kind = 'method'").select("id").join(counts, F.col("id") == F.col("at"), "left").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"))
    m, sd = d.agg(F.avg("fan_in"), F.stddev_pop("fan_in")).first()
    return d.where(F.col("fan_in") > m + 2 * sd).withColumn("z", F.round((F.col("fan_in") - m) / F.nullif(F.lit(sd), F.lit(0.0)), 6))


@query("""k AS (SELECT kind, count(*) * 100.0 / sum(count(*)) OVER () AS share FROM edges GROUP BY kind), i AS (SELECT dst AS id, count(*) AS c FROM edges GROUP BY dst),
s AS (SELECT e.src, e.dst, e.kind, e.line, round(CASE WHEN a.repo_prefix <> b.repo_prefix THEN 0.3 ELSE 0 END + CASE WHEN a.language <> b.language THEN 0.2 ELSE 0 END + CASE WHEN coalesce(i.c, 0) <= 2 AND j.c >= 10 THEN 0.2 ELSE 0 END + CASE WHEN k.share <= 5 THEN 0.15 ELSE 0 END + CASE WHEN (a.language = 'MACHINERY') <> (b.language = 'MACHINERY') THEN 0.15 ELSE 0 END, 3) AS score
FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst LEFT JOIN i ON i.id = e.src LEFT JOIN i j ON j.id = e.dst JOIN k ON k.kind = e.kind)
SELECT src, dst, kind, line, CAST(score AS DOUBLE) AS score FROM s WHERE score >= 0.6""", graph=True)
def surprising_connections(spark, sf):
    """Edges across repositories, languages, from the periphery to a hub, of a rare kind, or between tests (segment MACHINERY) and the rest."""
    n, e = nodes(spark, sf).select("id", "repo_prefix", "language"), edges(spark, sf).select("src", "dst", "kind", "line")
    fan = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("c"))
    kinds = {r["kind"]: r["count"] for r in e.groupBy("kind").count().collect()}  # one row a kind
    total = sum(kinds.values())
    rare = [k for k, c in kinds.items() if c * 100.0 / total <= 5]
    n = n.join(fan, "id", "left")
    a, b = (n.select(F.col("id").alias(end), F.col("repo_prefix").alias(f"r_{end}"), F.col("language").alias(f"l_{end}"), F.col("c").alias(f"c_{end}")) for end in ("src", "dst"))
    part = lambda test, w: F.when(test, w).otherwise(0.0)
    score = part(F.col("r_src") != F.col("r_dst"), 0.3) + part(F.col("l_src") != F.col("l_dst"), 0.2) + part((F.coalesce("c_src", F.lit(0)) <= 2) & (F.col("c_dst") >= 10), 0.2) + part(F.col("kind").isin(*rare), 0.15) + part((F.col("l_src") == "MACHINERY") != (F.col("l_dst") == "MACHINERY"), 0.15)
    return e.join(a, "src").join(b, "dst").select("src", "dst", "kind", "line", F.round(score, 3).alias("score")).where("score >= 0.6")


@query("""c AS (SELECT n.id, n.end_line - n.start_line + 1 AS lines, count(DISTINCT e.src) AS callers FROM nodes n JOIN edges e ON e.dst = n.id AND e.kind = 'calls' WHERE n.kind = 'method' GROUP BY ALL), o AS (SELECT src AS id, count(DISTINCT dst) AS fan_out FROM edges GROUP BY src)
SELECT c.id, lines, callers, fan_out, round(ln(1 + lines) * ln(1 + callers) * ln(1 + fan_out), 6) AS score FROM c JOIN o ON o.id = c.id WHERE lines >= 20 AND callers >= 2 AND fan_out >= 5""", graph=True)
def extraction_candidates(spark, sf):
    e = edges(spark, sf)
    callers = e.where("kind = 'calls'").select("src", "dst").repartition("dst").groupBy(F.col("dst").alias("at")).agg(F.count_distinct("src").alias("callers"))
    out = e.select("src", "dst").repartition("src").groupBy(F.col("src").alias("of")).agg(F.count_distinct("dst").alias("fan_out"))
    n = nodes(spark, sf).where("kind = 'method'").select("id", (F.col("end_line") - F.col("start_line") + 1).alias("lines")).where("lines >= 20")
    j = n.join(callers, F.col("id") == F.col("at")).join(out, F.col("id") == F.col("of")).where("callers >= 2 and fan_out >= 5")
    return j.select("id", "lines", "callers", "fan_out", F.round(F.log1p("lines") * F.log1p("callers") * F.log1p("fan_out"), 6).alias("score"))


@query("""r AS (SELECT id, repo_prefix, row_number() OVER (PARTITION BY repo_prefix ORDER BY length(name), id) - 1 AS repo_rank FROM nodes WHERE kind = 'function') SELECT id, repo_prefix, repo_rank FROM r""", graph=True)
def repo_rank(spark, sf):
    w = Window.partitionBy("repo_prefix").orderBy(F.length("name"), "id")
    return nodes(spark, sf).where("kind = 'function'").select("id", "repo_prefix", (F.row_number().over(w) - 1).alias("repo_rank"))


@query("""r AS (SELECT id, file_path, end_line - start_line AS size, row_number() OVER (PARTITION BY file_path ORDER BY end_line - start_line DESC, id) AS nth FROM nodes WHERE kind = 'method')
SELECT id, file_path, size, row_number() OVER (ORDER BY CASE WHEN nth > 3 THEN 1 ELSE 0 END, size DESC, id) AS place FROM r QUALIFY place <= 100""", graph=True)
def diversify_by_file(spark, sf):
    w = Window.partitionBy("file_path").orderBy(F.col("size").desc(), "id")
    rows = nodes(spark, sf).where("kind = 'method'").select("id", "file_path", (F.col("end_line") - F.col("start_line")).alias("size")).withColumn("late", (F.row_number().over(w) > 3).cast("int"))
    top = rows.orderBy("late", F.col("size").desc(), "id").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy("late", F.col("size").desc(), "id"))).drop("late")


@query("""SELECT id, name FROM nodes WHERE kind = 'function' ORDER BY name DESC, id LIMIT 20 OFFSET 40""", graph=True)
def paging(spark, sf):
    return nodes(spark, sf).where("kind = 'function'").select("id", "name").orderBy(F.col("name").desc(), "id").offset(40).limit(20)


@query("""a AS (SELECT DISTINCT src FROM edges WHERE origin = 'lsp_resolved'), b AS (SELECT DISTINCT src FROM edges WHERE origin = 'text_matched')
SELECT 'both' AS part, count(*) AS n FROM (SELECT src FROM a INTERSECT SELECT src FROM b) UNION ALL SELECT 'added', count(*) FROM (SELECT src FROM a EXCEPT SELECT src FROM b) UNION ALL SELECT 'removed', count(*) FROM (SELECT src FROM b EXCEPT SELECT src FROM a) UNION ALL SELECT 'any', count(*) FROM (SELECT src FROM a UNION SELECT src FROM b)""", graph=True)
def set_difference(spark, sf):
    by = edges(spark, sf).groupBy("src").agg(F.bool_or(F.col("origin") == "lsp_resolved").alias("a"), F.bool_or(F.col("origin") == "text_matched").alias("b")).where("a or b")
    t = by.agg(F.count_if(F.expr("a and b")).alias("both"), F.count_if(F.expr("a and not b")).alias("added"), F.count_if(F.expr("b and not a")).alias("removed"), F.count("*").alias("any"))
    return t.selectExpr("stack(4, 'both', both, 'added', added, 'removed', removed, 'any', any) as (part, n)")


@query("""SELECT n.file_path, count(*) AS uses, count(DISTINCT e.dst) AS targets, string_agg(DISTINCT e.kind, ',' ORDER BY e.kind) AS kinds FROM edges e JOIN nodes n ON n.id = e.src WHERE e.kind IN ('calls', 'references') GROUP BY n.file_path""", graph=True)
def usages_by_file(spark, sf):
    e = edges(spark, sf).where(F.col("kind").isin("calls", "references")).select("src", "dst", "kind")
    j = e.join(nodes(spark, sf).select(F.col("id").alias("src"), "file_path"), "src")
    return j.groupBy("file_path").agg(F.count("*").alias("uses"), F.count_distinct("dst").alias("targets"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


@query("""SELECT p_name AS name, CAST(CASE WHEN lower(p_name) = 'part 1' THEN 100 WHEN starts_with(lower(p_name), 'part') THEN 70 WHEN contains(lower(p_name), 'part') THEN 50 ELSE 0 END AS INT) AS score FROM part""")
def filename_score(spark, sf):
    name = F.lower("p_name")
    return read(spark, sf, "part").select(F.col("p_name").alias("name"), F.when(name == "part 1", 100).when(name.startswith("part"), 70).when(name.contains("part"), 50).otherwise(0).alias("score"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', ''), '[?#].*$', '') AS path,
'/' || array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', ''), '[?#].*$', ''), '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+') THEN '{p1}' ELSE s END), '/') AS route FROM pages""")
def route_normalisation(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-zA-Z]+://[^/?#]*", ""), r"[?#].*$", "")
    return read(spark, sf, "pages").select("page_id", path.alias("path"), ids.route(F.col("url")).alias("route"))


TARGETS_SQL = "CASE WHEN kind = 'references' THEN 'repo::unresolved::' || dst WHEN kind = 'member_of' THEN 'builtin::' || dst WHEN origin = 'text_matched' THEN 'unresolved::' || dst WHEN origin = 'ast_inferred' THEN 'external::' || dst WHEN origin = 'lsp_resolved' THEN 'repo::stdlib::' || dst ELSE dst END"


@query(rf"""t AS (SELECT {TARGETS_SQL} AS target, kind FROM edges),
r AS (SELECT *, regexp_extract(target, '^([^:]+::)?(stdlib|external_call|builtin|module)::', 2) AS stub FROM t)
SELECT kind, CASE WHEN starts_with(target, 'unresolved::') OR contains(target, '::unresolved::') THEN 'dynamic_dispatch' WHEN starts_with(target, 'external::') THEN 'external_boundary' WHEN stub <> '' THEN 'stub' ELSE '' END AS reason, stub, count(*) AS edges, count(DISTINCT CASE WHEN stub <> '' THEN regexp_replace(target, '^([^:]+::)?(stdlib|external_call|builtin|module)::', '') ELSE '' END) AS rests FROM r GROUP BY 1, 2, 3""", graph=True)
def dropped_targets(spark, sf):
    """Why a walk can't go on at the targets of edges, named by kind and tier, with kinds and tails of stubs."""
    at = lambda start: F.concat(F.lit(start), F.col("dst"))
    target = F.when(F.col("kind") == "references", at("repo::unresolved::")).when(F.col("kind") == "member_of", at("builtin::")).when(F.col("origin") == "text_matched", at("unresolved::")).when(F.col("origin") == "ast_inferred", at("external::"))
    t = edges(spark, sf).select("kind", target.when(F.col("origin") == "lsp_resolved", at("repo::stdlib::")).otherwise(F.col("dst")).alias("target"))
    by = t.groupBy("kind", ids.dropped_target(F.col("target")).alias("reason"), ids.stub_kind(F.col("target")).alias("stub"))
    return by.agg(F.count("*").alias("edges"), F.count_distinct(ids.stub_rest(F.col("target"))).alias("rests"))
