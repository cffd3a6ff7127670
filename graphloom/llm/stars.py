"""Connected components by alternating large-star and small-star.

Edges are kept as (hi, lo), hi above lo. A large-star joins all larger neighbours of a node to the
least node that it knows; a small-star does so with a node and all smaller ones. When
neither moves an edge, every component is one star around its least node. A node's least
neighbour is an aggregate that is combined before the shuffle, and goes back to the edges
by a join whose large side adaptive execution can split: a hub is never one task's work. Each
state is written to the shared folder and replaces the one before.

Defined cases: edges without one of their ends, loops and repeated edges count for nothing;
no edges, no components; nodes may be of any type that has an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.storage import reclaim, save


def least(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("hi").alias("of")).agg(F.min("lo").alias("m"))


def once(edges: DataFrame) -> DataFrame:
    return edges.groupBy("hi", "lo").agg(F.max("moved").alias("moved"))


def large_star(edges: DataFrame) -> DataFrame:
    near = edges.join(least(edges), edges["lo"] == F.col("of"), "left")
    return once(near.select("hi", F.coalesce("m", "lo").alias("lo"), F.col("m").isNotNull().alias("moved")))


def small_star(edges: DataFrame) -> DataFrame:
    near = edges.join(least(edges), edges["hi"] == F.col("of")).select("hi", "lo", "m", (F.col("lo") != F.col("m")).alias("moved"))
    ends = F.when(F.col("moved"), F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).otherwise(F.array(F.struct("hi", "lo")))
    return once(near.select("moved", F.explode(ends).alias("e")).select("e.hi", "e.lo", "moved"))


def components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component), stored, for every end of an edge; component is the smallest node reachable."""
    a, b = F.col(a), F.col(b)
    pairs = edges.where((a != b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    state, still = save(spark, pairs.distinct(), "star-edges"), 0
    steps = [large_star, small_star]
    while still < 2:
        new = save(spark, steps[0](state), "star-edges")
        reclaim(spark, state)
        state, steps = new, steps[::-1]
        still = 0 if new.where("moved").limit(1).count() else still + 1
    out = save(spark, state.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(state.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()), "star-labels")
    reclaim(spark, state)
    return out


def merged(spark: SparkSession, labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after the components of links(a, b) are joined: only the ends' labels take part in the stars."""
    ends = links
    for end in ("a", "b"):
        known = labels.select(F.col("node").alias(f"node_{end}"), F.col("component").alias(f"c_{end}"))
        ends = ends.join(known, F.col(end) == F.col(f"node_{end}"), "left").withColumn(f"c_{end}", F.coalesce(f"c_{end}", end))
    new = ends.select(F.col("a").alias("node"), F.col("c_a").alias("component")).union(ends.select(F.col("b"), F.col("c_b"))).distinct()
    every = labels.unionByName(new.join(labels.select(F.col("node").alias("known")), F.col("node") == F.col("known"), "left_anti"))
    up = components(spark, ends, "c_a", "c_b").withColumnsRenamed({"node": "from", "component": "to"})
    return save(spark, every.join(up, F.col("component") == F.col("from"), "left").select("node", F.coalesce("to", "component").alias("component")), "star-merged")
