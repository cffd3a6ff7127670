"""The commerce tables as property graphs: nodes and edges frames, and their DuckDB spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nationkey, nation, region)."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, name, file_path, language, repo_prefix, start_line, end_line)."""
    place = places(spark, sf_dir)
    customer, supplier, part, order = (read(spark, sf_dir, t) for t in ("customer", "supplier", "part", "orders"))

    def row(df, kind, id_, name, path, language, repo, start, end):
        return df.select(id_.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), path.alias("file_path"), language.alias("language"), repo.alias("repo_prefix"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"))

    home = lambda what: F.concat_ws("/", "region", "nation", F.lit(what))
    one, empty = F.lit(1), F.lit("")
    regions = row(read(spark, sf_dir, "region"), "package", _id("region", "r_regionkey"), F.col("r_name"), F.concat(F.col("r_name"), F.lit("/region")), empty, F.col("r_name"), one, one)
    nations = row(place, "module", _id("nation", "nationkey"), F.col("nation"), home("nation"), empty, F.col("region"), one, one)
    customers = customer.join(place, F.col("c_nationkey") == F.col("nationkey"))
    people = row(customers, "function", _id("customer", "c_custkey"), F.col("c_name"), home("customer"), F.col("c_mktsegment"), F.col("region"), F.col("c_custkey") * 10, F.col("c_custkey") * 10 + 9)
    makers = row(supplier.join(place, F.col("s_nationkey") == F.col("nationkey")), "type", _id("supplier", "s_suppkey"), F.col("s_name"), home("supplier"), empty, F.col("region"), F.col("s_suppkey") * 10, F.col("s_suppkey") * 10 + 9)
    parts = row(part, "method", _id("part", "p_partkey"), F.col("p_name"), F.concat(F.lit("parts/"), F.col("p_brand")), F.col("p_brand"), empty, F.col("p_partkey") * 10, F.col("p_partkey") * 10 + F.col("p_size"))
    orders = row(order.join(customers, F.col("o_custkey") == F.col("c_custkey")), "variable", _id("order", "o_orderkey"), _id("order", "o_orderkey"), home("order"), empty, F.col("region"), one, one)
    out = regions
    for df in (nations, people, makers, parts, orders):
        out = out.unionByName(df)
    return out


#: Where a line's edge is known from, by name.
TIERS = ("ast_inferred", "ast_resolved", "lsp_resolved", "text_matched")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, kind, line, origin, confidence): one row for each identity (src, dst, kind, line).

    Keys of lines are nearly all different, so the rows are dealt by them first: a task then holds its share of them, not all that it scans.
    """
    line = read(spark, sf_dir, "lineitem")
    place = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 0).when(F.col("l_linestatus") == "F", 1).otherwise(2)  # among TIERS: the least number is the least name
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, so that few bytes of numbers aren't put together into tasks of many rows
    used = line.select("l_orderkey", "l_partkey", "l_linenumber", place.alias("place")).repartition(tasks, "l_orderkey", "l_partkey", "l_linenumber").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.min("place").alias("place"))
    made = line.select("l_partkey", "l_suppkey").repartition(tasks, "l_partkey", "l_suppkey").distinct()
    out = _sites(spark, sf_dir, used, made)
    return out.withColumn("confidence", F.when(F.col("origin") == "text_matched", 0.4).when(F.col("origin") == "ast_inferred", 0.7).otherwise(1.0))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, kind) of the edges, with repeats: for walks, which meet a node once however many edges lead there.

    Rows come as they are scanned; nothing is dealt or aggregated, so no task holds more the more lines there are.
    """
    line = read(spark, sf_dir, "lineitem")
    return _sites(spark, sf_dir, line.withColumn("place", F.lit(0)), line).select("src", "dst", "kind")


def _sites(spark: SparkSession, sf_dir: str, used: DataFrame, made: DataFrame) -> DataFrame:
    """Edges without their confidence, from lines as uses of parts (with `place`) and as parts of suppliers."""
    order, customer, supplier, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "supplier", "nation"))

    def row(df, src, dst, kind, at, origin):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), at.cast("int").alias("line"), origin.alias("origin"))

    sure, one = F.lit("ast_resolved"), F.lit(1)
    out = row(order, _id("customer", "o_custkey"), _id("order", "o_orderkey"), "calls", one, sure)
    tier = F.array(*map(F.lit, TIERS))[F.col("place")]
    out = out.unionByName(row(used, _id("order", "l_orderkey"), _id("part", "l_partkey"), "calls", F.col("l_linenumber"), tier))
    out = out.unionByName(row(made, _id("part", "l_partkey"), _id("supplier", "l_suppkey"), "references", one, sure))
    out = out.unionByName(row(customer, _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "member_of", one, sure))
    out = out.unionByName(row(supplier, _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "member_of", one, sure))
    return out.unionByName(row(nation, _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "member_of", one, sure))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation to nation: (src, dst, weight), an edge for each line of an order, summed."""
    line, order, customer, supplier = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    joined = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").cast("double").alias("weight"))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event type to the user's next event type: (src, dst, weight)."""
    from pyspark.sql import Window

    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = read(spark, sf_dir, "events").select(F.col("event_type").alias("src"), following.alias("dst")).where("dst is not null")
    return steps.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


#: The same frames for DuckDB, to stand before a query.
GRAPH_SQL = """
place AS (SELECT n_nationkey AS nationkey, n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (
  SELECT 'region/' || r_regionkey AS id, 'package' AS kind, r_name AS name, r_name || '/region' AS file_path, '' AS language, r_name AS repo_prefix, 1 AS start_line, 1 AS end_line FROM region
  UNION ALL SELECT 'nation/' || nationkey, 'module', nation, region || '/' || nation || '/nation', '', region, 1, 1 FROM place
  UNION ALL SELECT 'customer/' || c_custkey, 'function', c_name, region || '/' || nation || '/customer', c_mktsegment, region, CAST(c_custkey * 10 AS INT), CAST(c_custkey * 10 + 9 AS INT) FROM customer JOIN place ON c_nationkey = nationkey
  UNION ALL SELECT 'supplier/' || s_suppkey, 'type', s_name, region || '/' || nation || '/supplier', '', region, CAST(s_suppkey * 10 AS INT), CAST(s_suppkey * 10 + 9 AS INT) FROM supplier JOIN place ON s_nationkey = nationkey
  UNION ALL SELECT 'part/' || p_partkey, 'method', p_name, 'parts/' || p_brand, p_brand, '', CAST(p_partkey * 10 AS INT), CAST(p_partkey * 10 + p_size AS INT) FROM part
  UNION ALL SELECT 'order/' || o_orderkey, 'variable', 'order/' || o_orderkey, region || '/' || nation || '/order', '', region, 1, 1 FROM orders JOIN customer ON o_custkey = c_custkey JOIN place ON c_nationkey = nationkey
),
edges0 AS (
  SELECT 'customer/' || o_custkey AS src, 'order/' || o_orderkey AS dst, 'calls' AS kind, 1 AS line, 'ast_resolved' AS origin FROM orders
  UNION ALL SELECT 'order/' || l_orderkey, 'part/' || l_partkey, 'calls', l_linenumber, min(CASE WHEN l_returnflag = 'R' THEN 'text_matched' WHEN l_returnflag = 'A' THEN 'ast_inferred' WHEN l_linestatus = 'F' THEN 'ast_resolved' ELSE 'lsp_resolved' END) FROM lineitem GROUP BY l_orderkey, l_partkey, l_linenumber
  UNION ALL SELECT DISTINCT 'part/' || l_partkey, 'supplier/' || l_suppkey, 'references', 1, 'ast_resolved' FROM lineitem
  UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey, 'member_of', 1, 'ast_resolved' FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 'member_of', 1, 'ast_resolved' FROM supplier
  UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey, 'member_of', 1, 'ast_resolved' FROM nation
),
edges AS (SELECT *, CASE origin WHEN 'text_matched' THEN 0.4::DOUBLE WHEN 'ast_inferred' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM edges0),
trade AS (
  SELECT c_nationkey AS src, s_nationkey AS dst, count(*)::DOUBLE AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
),
clicks AS (
  SELECT src, dst, count(*)::DOUBLE AS weight FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL GROUP BY 1, 2
)
"""
