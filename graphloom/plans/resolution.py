"""Binding of names over calls between the parts of consecutive lines of orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import resolve
from graphloom.plans.query import query
from graphloom.sources.fixture import read
from graphloom.sources.storage import save

#: Parts are members of their type in a file for each brand and type. A line's part calls the next line's by name: alone, of its type, or of any.
#: The first lines of large quantity import the file of the next one.
SITES_SQL = """s AS (SELECT DISTINCT 'part/' || p_partkey AS id, p_name AS name, 'parts/' || p_brand || '/' || p_type AS file, 'parts/' || p_brand AS folder, p_type AS owner FROM part),
l AS (SELECT l_partkey AS a, lead(l_partkey) OVER w AS b, l_linenumber AS line, l_returnflag AS flag, l_quantity AS quantity FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
j AS (SELECT x.id AS src, x.file AS src_file, x.folder AS src_folder, y.*, line, flag, quantity FROM l JOIN s x ON x.id = 'part/' || a JOIN s y ON y.id = 'part/' || b),
e AS (SELECT DISTINCT src, src_file, src_folder, 'calls' AS kind, line, name, CASE flag WHEN 'R' THEN '' WHEN 'A' THEN owner ELSE '*' END AS owner, CASE flag WHEN 'R' THEN name WHEN 'A' THEN owner || '::' || name ELSE '*.' || name END AS tail FROM j),
i AS (SELECT DISTINCT src, src_file, line, file AS far FROM j WHERE line = 1 AND quantity >= 49),
c AS (SELECT e.*, s.id, CASE WHEN s.file = src_file THEN 1 WHEN s.folder = src_folder THEN 2 WHEN (src_file, s.file) IN (SELECT (src_file, far) FROM i) THEN 3 ELSE 4 END AS rank FROM e JOIN s ON s.name = e.name AND (e.owner IN ('', '*') OR e.owner = s.owner)),
m AS (SELECT src, tail, line, min(rank) AS best FROM c GROUP BY ALL),
b AS (SELECT c.src, c.tail, c.line, best, min(c.id) AS dst FROM c JOIN m ON m.src = c.src AND m.tail = c.tail AND m.line = c.line AND c.rank = m.best GROUP BY ALL HAVING count(*) = 1)"""


def sites(spark, sf):
    """(nodes, edges) of the projection."""
    p = read(spark, sf, "part")
    file = F.concat_ws("/", F.lit("parts"), "p_brand", "p_type")
    row = lambda df, id_, kind, name, owner: df.select(id_.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), file.alias("file_path"), F.lit("").alias("language"), F.lit("").alias("repo_prefix"), owner.alias("owner"))
    part = F.concat(F.lit("part/"), F.col("p_partkey").cast("string"))
    nodes = row(p, part, "method", F.col("p_name"), F.col("p_type")).distinct().unionByName(row(p.select("p_brand", "p_type").distinct(), file, "file", file, F.lit("")))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    line = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(order).alias("b"), F.col("l_linenumber").alias("line"), "l_returnflag", "l_quantity")
    met = line.join(p.select(F.col("p_partkey").alias("b"), "p_name", "p_type", file.alias("far")), "b").join(p.select(F.col("p_partkey").alias("a")), "a", "left_semi")
    flag = F.col("l_returnflag")
    name = F.when(flag == "R", F.col("p_name")).when(flag == "A", F.concat_ws("::", "p_type", "p_name")).otherwise(F.concat(F.lit("*."), "p_name"))
    edge = lambda rest, kind: F.struct(F.concat(F.lit("part/"), F.col("a").cast("string")).alias("src"), F.concat(F.lit(resolve.MARK), rest).alias("dst"), F.lit(kind).alias("kind"), "line")
    imports = F.when((F.col("line") == 1) & (F.col("l_quantity") >= 49), edge(F.concat(F.lit("import::"), "far"), "imports"))
    both = met.select(F.explode(F.array_compact(F.array(edge(name, "calls"), imports))).alias("e")).select("e.*").distinct()  # both kinds of one pass over the lines
    return nodes, both.withColumn("origin", F.lit("text_matched")).withColumn("confidence", F.lit(0.4))


@query(f"""WITH {SITES_SQL} SELECT src, 'unresolved::' || tail AS target, line, dst, ['file', 'folder', 'import', 'repo'][best] AS scope FROM b""")
def bind_names(spark, sf):
    """The calls that could be bound, to what and by which scope."""
    nodes, edges = sites(spark, sf)
    # the target is kept in the origin to be shown beside what it was bound to
    bound = resolve.bind(spark, nodes, edges.withColumn("line", F.struct("line", F.col("dst").alias("target"))))
    return bound.where("kind = 'calls' and scope is not null").select("src", "line.target", "line.line", "dst", "scope")


CENSUS_SQL = """t AS (SELECT 'calls' AS kind, CASE WHEN starts_with(tail, '*.') THEN 'wildcard_member' WHEN contains(tail, '::') THEN 'qualified_symbol' ELSE 'bare_symbol' END AS target_class, src, tail, line FROM e UNION ALL SELECT 'imports', 'import', src, far, line FROM i)"""


@query(f"""WITH {SITES_SQL}, {CENSUS_SQL} SELECT kind, target_class, count(*) AS bucket_count, CAST(sum(count(*)) OVER () AS BIGINT) AS pending_total, count(*) OVER () AS group_count FROM t GROUP BY 1, 2""")
def unresolved_frontier(spark, sf):
    """What isn't bound yet, by kind and class."""
    return resolve.census(sites(spark, sf)[1])


@query(f"""WITH {SITES_SQL}, {CENSUS_SQL}, o AS (SELECT * FROM t WHERE kind = 'calls' AND NOT EXISTS (SELECT 1 FROM b WHERE b.src = t.src AND b.tail = t.tail AND b.line = t.line)) SELECT kind, target_class, count(*) AS bucket_count, CAST(sum(count(*)) OVER () AS BIGINT) AS pending_total, count(*) OVER () AS group_count FROM o GROUP BY 1, 2""")
def unresolved_after_binding(spark, sf):
    nodes, edges = sites(spark, sf)
    return resolve.census(resolve.bind(spark, nodes, edges))


@query(f"""WITH {SITES_SQL}, v AS (SELECT dst, count(*) AS verified FROM b GROUP BY 1), o AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.src = e.src AND b.tail = e.tail AND b.line = e.line))
SELECT s.id, coalesce(any_value(verified), 0) AS verified, count(*) AS candidates FROM s JOIN o ON o.name = s.name AND (o.owner IN ('', '*') OR o.owner = s.owner) LEFT JOIN v ON v.dst = s.id GROUP BY s.id""")
def name_only_candidates(spark, sf):
    """Parts with calls that are sure, and with open ones that name them."""
    nodes, edges = sites(spark, sf)
    return resolve.name_only(nodes, save(spark, resolve.bind(spark, nodes, edges), "resolve-out"))  # it is read twice
