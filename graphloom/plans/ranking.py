"""Queries of the second stage of search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import identifiers as ids
from graphloom.operators import rerank as second
from graphloom.plans.query import query
from graphloom.sources.fixture import edges, nodes, read

QUERY, BATCH = "ring", 200


@query("""SELECT id, name, CASE WHEN lower(name) = 'order/1' THEN 0 WHEN starts_with(lower(name), 'order/1') THEN 1 WHEN contains(lower(name), 'order/1') THEN 2 ELSE 3 END AS rank FROM nodes WHERE kind NOT IN ('file', 'import') AND (contains(lower(name), 'order/1') OR contains(lower(id), 'order/1')) ORDER BY rank, strlen(name), id LIMIT 50""", graph=True)
def substring_search(spark, sf):
    return second.substring_search(nodes(spark, sf), "ORDER/1", 50)


def _batch(spark, sf):
    """The best of the parts named after the query by text, with what the signals need; part sizes stand for a vector channel."""
    best = second.substring_search(nodes(spark, sf).where("kind = 'method'"), QUERY, BATCH).select("id", F.col("rank").alias("tier"), F.octet_length("name").alias("size"))
    ranked = best.select("id", (F.row_number().over(Window.orderBy("tier", "size", "id")) - 1).alias("text_rank"))
    part = read(spark, sf, "part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_type").alias("cluster"), F.concat_ws(" ", "p_name", "p_type").alias("signature"), "p_size")
    rows = ranked.join(nodes(spark, sf).where("kind = 'method'").select("id", "kind", "name", "file_path"), "id").join(part, "id")
    rows = rows.withColumn("v", F.row_number().over(Window.orderBy(F.col("p_size").desc(), "id")) - 1).withColumn("vector_rank", F.when(F.col("v") < 50, F.col("v")))
    e = edges(spark, sf)
    use = F.col("kind").isin("calls", "references")
    into = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"), F.avg(F.when(use, ids.provenance_weight(F.col("origin")))).alias("provenance"))
    out = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    line = read(spark, sf, "lineitem")
    now = line.agg(F.max(F.unix_timestamp("l_shipdate"))).first()[0]
    past = line.groupBy(F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("id")).agg(F.count_if(F.col("l_returnflag") == "R").alias("churn"), ((F.lit(now) - F.max(F.unix_timestamp("l_shipdate"))) / 86400.0).alias("days"))
    return rows.join(into, "id", "left").join(out, "id", "left").join(past, "id", "left").fillna(0, ["fan_in", "fan_out", "churn"])


WEIGHT_SQL = "CASE origin WHEN 'ast_resolved' THEN 1.0 WHEN 'lsp_resolved' THEN 0.9 WHEN 'lsp_dispatch' THEN 0.8 WHEN 'ast_inferred' THEN 0.6 WHEN 'text_matched' THEN 0.25 ELSE 0.6 END::DOUBLE"
BATCH_SQL = f"""c AS (SELECT id, kind, name, file_path, row_number() OVER (ORDER BY CASE WHEN lower(name) = '{QUERY}' THEN 0 WHEN starts_with(lower(name), '{QUERY}') THEN 1 ELSE 2 END, strlen(name), id) - 1 AS text_rank FROM nodes WHERE kind = 'method' AND contains(lower(name), '{QUERY}') QUALIFY text_rank < {BATCH}),
i AS (SELECT dst AS id, count(*) AS fan_in, avg(CASE WHEN kind IN ('calls', 'references') THEN {WEIGHT_SQL} END) AS provenance FROM edges GROUP BY 1), o AS (SELECT src AS id, count(*) AS fan_out FROM edges GROUP BY 1),
h AS (SELECT 'part/' || l_partkey AS id, count(*) FILTER (WHERE l_returnflag = 'R') AS churn, date_diff('second', max(l_shipdate), (SELECT max(l_shipdate) FROM lineitem)) / 86400.0::DOUBLE AS days FROM lineitem GROUP BY 1),
b AS (SELECT c.*, p_type AS cluster, p_name || ' ' || p_type AS signature, row_number() OVER (ORDER BY p_size DESC, c.id) - 1 AS v, coalesce(fan_in, 0) AS fan_in, provenance, coalesce(fan_out, 0) AS fan_out, coalesce(churn, 0) AS churn, days FROM c JOIN part ON c.id = 'part/' || p_partkey LEFT JOIN i ON i.id = c.id LEFT JOIN o ON o.id = c.id LEFT JOIN h ON h.id = c.id),
f AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY file_path) >= 2 THEN sum(1.0::DOUBLE / (text_rank + 1)) OVER (PARTITION BY file_path) ELSE 0 END AS fs, count(*) OVER (PARTITION BY cluster) AS here FROM b),
m AS (SELECT max(fan_in) AS mi, max(fan_out) AS mo, max(churn) AS mc, max(fs) AS mf, max(here) AS mh FROM f),
s AS (SELECT id, file_path, round(61.0::DOUBLE / (61 + text_rank) + 0.8 * CASE WHEN v < 50 THEN 61.0::DOUBLE / (61 + v) ELSE 0 END + 0.6 * coalesce(ln(1 + fan_in) / nullif(ln(1 + mi), 0), 0) + 0.2 * coalesce(ln(1 + fan_out) / nullif(ln(1 + mo), 0), 0) + 0.3 * coalesce(ln(1 + churn) / nullif(ln(1 + mc), 0), 0)
  + 0.3 * here / mh + 0.45 * CASE WHEN contains(lower(signature), '{QUERY}') THEN 1 ELSE 0 END + 0.3 * coalesce(pow(0.5::DOUBLE, days / 30), 0) + 0.3 * coalesce(fs / nullif(mf, 0), 0) + 0.4 + 0.6 * CASE WHEN lower(name) = '{QUERY}' THEN 1 WHEN starts_with(lower(name), '{QUERY}') THEN 0.4 ELSE 0 END + 0.15 * greatest(0, least(1, coalesce((provenance - 0.25) / 0.75, 0))), 6) AS score FROM f, m)"""
PLACE_SQL = f"""r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, id) - 1 AS above FROM s)"""


@query(f"""{BATCH_SQL}, {PLACE_SQL} SELECT id, score, rank, row_number() OVER (ORDER BY rank + CASE WHEN above >= {second.ALLOWED} THEN {second.STEP} * (above - {second.ALLOWED - 1}) ELSE 0 END, rank) - 1 AS place FROM r""", graph=True)
def rerank(spark, sf):
    """Twelve signals by their published weights over the text channel's best, then diversity of files."""
    return second.rerank(_batch(spark, sf), QUERY).select("id", "score", "rank", "place")


def _greedy_sql(name, order):
    return f"""{name}o AS (SELECT brand, id, tokens, row_number() OVER (PARTITION BY brand ORDER BY {order}) AS n FROM t), {name} AS (SELECT brand, 0::BIGINT AS n, 0::BIGINT AS used, NULL::BIGINT AS id FROM (SELECT DISTINCT brand FROM t) UNION ALL
SELECT p.brand, o.n, p.used + CASE WHEN p.used + o.tokens <= 60 THEN o.tokens ELSE 0 END, CASE WHEN p.used + o.tokens <= 60 THEN o.id END FROM {name} p JOIN {name}o o ON o.brand = p.brand AND o.n = p.n + 1)"""


@query(f"""WITH RECURSIVE t AS (SELECT p_brand AS brand, p_partkey AS id, p_type AS file, p_retailprice AS score, p_size AS tokens, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 50), g AS (SELECT *, round(sum(score) OVER (PARTITION BY brand, file), 9) AS total FROM t),
{_greedy_sql("a", "rank")}, {_greedy_sql("b", "score / tokens DESC, rank")}, {_greedy_sql("c", "(SELECT total FROM g WHERE g.brand = t.brand AND g.id = t.id) DESC, file, rank")}
SELECT strategy, brand, id, row_number() OVER (PARTITION BY strategy, brand ORDER BY n) - 1 AS place FROM (SELECT 'top-k' AS strategy, * FROM a UNION ALL SELECT 'density', * FROM b UNION ALL SELECT 'file-grouped', * FROM c) WHERE id IS NOT NULL""")
def pack_strategies(spark, sf):
    """What of each brand's fifty dearest parts fits sixty tokens, by three strategies; a part's size is its cost."""
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey"))
    t = read(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.col("p_type").alias("file_path"), F.col("p_retailprice").alias("score"), F.col("p_size").alias("tokens"), rank.alias("rank")).where("rank <= 50")
    return reduce(lambda a, b: a.unionByName(b), [second.pack(t, "brand", s, 60).withColumn("strategy", F.lit(s)) for s in ("top-k", "density", "file-grouped")])
