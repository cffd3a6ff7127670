"""Bounded walks over edge frames (src, dst, kind, ...), as loops of joins that the driver only counts.

Every level is written to the shared folder, so plans stay one join deep and a lost
executor repeats one level. Order of discovery is fixed by depth and then id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.sources.storage import reclaim, save

KINDS = (  # fixed values: edge kinds that walks accept
    "imports defines calls instantiates implements extends references member_of provides consumes matches annotated tests reads writes throws returns typed_as "
    "captures spawns sends recvs queries reads_config reads_env executes_process accesses_field emits overrides depends_on composes produces_topic consumes_topic"
).split()


def directed(edges: DataFrame, direction: str = "out") -> DataFrame:
    """Edges as (a, b, kind): out along them, in against them, both ways for both."""
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "kind")
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "kind")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def bfs(spark: SparkSession, edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out", kinds: tuple | None = None, nodes: DataFrame | None = None, anew: bool = False) -> DataFrame:
    """(id, depth, parent, kind): the edge that found a node is the one of least depth, then parent, then kind.

    With `anew`, for edges that are a mere projection, each level makes them again and none are stored.
    """
    steps = directed(edges if kinds is None else edges.where(F.col("kind").isin(*kinds)), direction)
    if nodes is not None:
        steps = steps.join(nodes.select(F.col("id").alias("b")), "b", "left_semi")
    steps = save(spark, steps, "steps") if depth > 1 and not anew else steps  # built once, read at each level; a step met twice finds its node once
    start = seeds.select("id").distinct().select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("kind"))
    seen = frontier = save(spark, start, "bfs")
    first = Window.partitionBy("id").orderBy("parent", "kind")
    for level in range(1, depth + 1):
        met = frontier.select(F.col("id").alias("a")).join(steps, "a").select(F.col("b").alias("id"), F.lit(level).alias("depth"), F.col("a").alias("parent"), "kind")
        new = met.join(seen.select("id"), "id", "left_anti").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
        frontier = save(spark, new, "bfs")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def ancestors(spark: SparkSession, edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, id, depth, path) of all that lies within `depth` edges of each seed, each once: of its shortest ways the first by its ids."""
    steps = save(spark, edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), "steps")
    at = seen = save(spark, seeds.select(F.col("id").alias("seed"), "id", F.array("id").alias("way")).distinct(), "ways")
    found = None
    for level in range(1, depth + 1):
        met = at.join(steps, F.col("id") == F.col("a")).groupBy("seed", F.col("b").alias("id")).agg(F.min(F.concat("way", F.array("b"))).alias("way"))
        at = save(spark, met.join(seen.select("seed", "id"), ["seed", "id"], "left_anti"), "ways")
        here = at.select("seed", "id", F.lit(level).alias("depth"), F.array_join("way", " > ").alias("path"))
        found = here if found is None else found.unionByName(here)
        if not at.limit(1).count():
            break
        seen = seen.unionByName(at)
    return found


def closure(spark: SparkSession, edges: DataFrame, seeds: DataFrame, kinds: tuple, direction: str = "out") -> DataFrame:
    """(id): everything reachable, seeds included; targets need not be nodes; no kinds, only the seeds."""
    return bfs(spark, edges, seeds, 1 << 30 if kinds else 0, direction, kinds or None).select("id")


def reach_tiers(spark: SparkSession, edges: DataFrame, seeds: DataFrame, kinds: tuple, depth: int = 3) -> DataFrame:
    """(depth, n, ids): who depends on the seeds, by distance."""
    return bfs(spark, edges, seeds, depth, "in", kinds).where("depth > 0").groupBy("depth").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))


def shortest_paths(spark: SparkSession, edges: DataFrame, source: str, target: str, k: int, depth: int, kinds: tuple | None = None) -> DataFrame:
    """(path, length, confidence) of the k best simple paths: shortest first, then surest, then by name."""
    steps = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    steps = steps.groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.max("confidence").alias("c"))
    paths = spark.range(1).select(F.array(F.lit(source)).alias("path"), F.lit(source).alias("at"), F.lit(1.0).alias("confidence"))
    found, have = None, 0
    for _ in range(depth):
        longer = paths.join(steps, F.col("at") == F.col("a")).where(~F.array_contains("path", F.col("b")))
        paths = save(spark, longer.select(F.concat("path", F.array("b")).alias("path"), F.col("b").alias("at"), (F.col("confidence") * F.col("c")).alias("confidence")), "paths")
        hits = paths.where(F.col("at") == target)
        found = hits if found is None else found.unionByName(hits)
        have += hits.count()
        paths = paths.where(F.col("at") != target)
        if have >= k or not paths.limit(1).count():
            break
    out = found.select(F.concat_ws(" > ", "path").alias("path"), (F.size("path") - 1).alias("length"), F.round("confidence", 6).alias("confidence"))
    return out.orderBy("length", F.col("confidence").desc(), "path").limit(k)


def graph_query(spark: SparkSession, nodes: DataFrame, edges: DataFrame, text: str, limit: int = 1000) -> DataFrame:
    """Runs `nodes F* | traverse KINDS DIR | filter F+` (five stages at most) and returns the last set of nodes.

    Filters: kind=x, name~regex, path=prefix, lang=x. A stage keeps the `limit` smallest ids.
    """
    stages = [s.split() for s in text.split("|")]
    if not 1 <= len(stages) <= 5 or not stages[0] or stages[0][0] != "nodes":
        raise ValueError("a query starts with `nodes` and has five stages at most")

    def keep(df: DataFrame, filters: list[str]) -> DataFrame:
        for f in filters:
            if f.startswith("kind="):
                df = df.where(F.col("kind") == f[5:])
            elif f.startswith("name~"):
                df = df.where(F.col("name").rlike(f[5:]))
            elif f.startswith("path="):
                df = df.where(F.col("file_path").startswith(f[5:]))
            elif f.startswith("lang="):
                df = df.where(F.lower("language") == f[5:].lower())
            else:
                raise ValueError(f"unknown filter {f}")
        return df.orderBy("id").limit(limit)

    current = keep(nodes, stages[0][1:])
    for verb, *rest in stages[1:]:
        if verb == "filter":
            current = keep(current, rest)
        elif verb == "traverse":
            kinds, direction = rest[0].split(","), (rest[1] if len(rest) > 1 else "out")
            if not set(kinds) <= set(KINDS):
                raise ValueError(f"unknown kinds {kinds}")
            step = directed(edges.where(F.col("kind").isin(*kinds)), direction)
            ids = current.select(F.col("id").alias("a")).join(step, "a").select(F.col("b").alias("id")).distinct()
            current = nodes.join(ids, "id", "left_semi").orderBy("id").limit(limit)
        else:
            raise ValueError(f"unknown stage {verb}")
        current = save(spark, current, "graph-query")
    return current


#: Edges that a closure follows unless told otherwise, bytes that a walked node is worth, bytes in ten tokens.
NEEDS, NODE_BYTES, TEN_TOKENS = ("imports", "calls", "references", "depends_on"), 28, 35


def nodes_for(tokens: int) -> int:
    """How many nodes of a walk fit in a number of tokens; their sum is rounded down once."""
    return ((tokens + 1) * TEN_TOKENS - 1) // (NODE_BYTES * 10)


def nearest(
    spark: SparkSession, nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 6, most: int = 400, kinds: tuple | None = NEEDS, direction: str = "out", part: DataFrame | None = None, community: str | None = None
) -> tuple[DataFrame, DataFrame, dict]:
    """((id, distance), (src, dst, kind) met on the way, statistics): the `most` nodes nearest to any seed, ties by id.

    Seeds count whatever their number. What isn't in `nodes` (give those in scope) or isn't resolved is not
    entered, nor, with `part` (id, community), what is known to be of another community. Edges are those out of each node that is
    expanded, once each, also to nodes met before or beyond the cap. A level asks for no more nodes than are left, so the walk holds `most` rows.
    """
    inside = nodes.select("id").where("not (id like 'unresolved::%' or id like 'external::%')")
    steps = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    out = steps.select(F.col("src").alias("a"), F.col("dst").alias("b"), "src", "dst", "kind")
    back = steps.select(F.col("dst").alias("a"), F.col("src").alias("b"), "src", "dst", "kind")
    steps = {"out": out, "in": back, "both": out.unionByName(back)}[direction].join(inside.withColumnRenamed("id", "b"), "b", "left_semi")
    if part is not None and community is not None:
        steps = steps.join(part.where(F.col("community") != community).select(F.col("id").alias("b")), "b", "left_anti")
    steps = save(spark, steps.distinct(), "steps")
    seen = at = save(spark, inside.join(seeds.select("id").distinct(), "id", "left_semi").select("id", F.lit(0).alias("distance")), "nearest")
    stats, met = {"nodes": at.count(), "truncated": False, "depth": 0}, None
    for level in range(1, depth + 1):
        links = save(spark, steps.join(at.select(F.col("id").alias("a")), "a"), "nearest-edges")
        met = links if met is None else met.unionByName(links)
        new = links.select(F.col("b").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        room = max(most - stats["nodes"], 0)
        found = new.orderBy("id").limit(room + 1).select("id", F.lit(level).alias("distance"))
        found = save(spark, found, "nearest")
        n = found.count()
        stats["truncated"] |= n > room
        at = found.orderBy("id").limit(room) if n > room else found
        n = min(n, room)
        if not n:
            break
        stats["nodes"], stats["depth"] = stats["nodes"] + n, level
        seen = seen.unionByName(at)
    edges_met = spark.createDataFrame([], "src string, dst string, kind string") if met is None else met.select("src", "dst", "kind").distinct()
    reclaim(spark, steps)
    return seen, edges_met, stats
