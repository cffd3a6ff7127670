"""Communities that are connected by construction: local moves, refinement inside them, merging of the refined parts; upkeep of a stored partition."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.community import settle, undirected
from graphloom.operators.components import connected_components
from graphloom.sources.storage import reclaim, save

#: Above this part of changed packages the whole graph is done again.
MOST_CHANGED = 0.5


def _refine(spark: SparkSession, links: DataFrame, degree: DataFrame, part: DataFrame, fixed: DataFrame | None, total: float, resolution: float) -> DataFrame:
    """(id, r): nodes on their own join the neighbouring part of their community where they gain most, until none would gain.

    A node moves only while it is alone and only to a part that stays where it is in that round, so every part is connected.
    """
    ends = [part.select(F.col("id").alias(x), F.col("c").alias(f"c{x}")) for x in "ab"]
    inside = save(spark, links.where("a <> b").join(ends[0], "a").join(ends[1], "b").where("ca = cb").select("a", "b", "w"), "leiden-inside")
    sub = save(spark, degree.select("id", F.col("id").alias("r"), "k"), "leiden-sub")
    for turn in count():
        parts = sub.groupBy("r").agg(F.sum("k").alias("t"), F.count("*").alias("n"))
        alone = sub.join(parts.where("n = 1").select("r"), "r", "left_semi").select("id", "k")
        if fixed is not None:
            alone = alone.join(fixed, "id", "left_anti")
        to = inside.join(alone, F.col("a") == F.col("id")).join(sub.select(F.col("id").alias("b"), "r"), "b").groupBy("id", "k", "r").agg(F.sum("w").alias("w"))
        gain = F.col("w") - resolution * F.col("k") * F.col("t") / total
        rated = to.join(parts, "r").select("id", "r", F.round(gain, 9).alias("g")).where("g > 0")
        wish = save(spark, rated.groupBy("id").agg(F.min(F.struct((-F.col("g")).alias("g"), "r"))["r"].alias("best")), "leiden-wish")
        if not wish.limit(1).count():
            reclaim(spark, inside, wish)
            return sub
        movers = wish.where(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0)
        go = movers.join(movers.select(F.col("id").alias("best")), "best", "left_anti")
        new = save(spark, sub.join(go, "id", "left").select("id", F.coalesce("best", "r").alias("r"), "k"), "leiden-sub")
        reclaim(spark, sub, wish)
        sub = new


def _levels(spark: SparkSession, links: DataFrame, part: DataFrame, fixed: DataFrame | None, resolution: float) -> DataFrame:
    """(id, c) from the stored tables links (a, b, w), part (id, c) and fixed (id), nodes that neither move nor merge with each other.

    It ends when no two refined parts of a community gain by being one: then the parts are the answer,
    with no less modularity than the communities that they make up.
    """
    total = links.agg(F.sum("w")).first()[0]
    belongs, turn, base, given = save(spark, part.select("id", F.col("id").alias("c")), "leiden-nodes"), 0, links, fixed
    while total:
        degree = save(spark, links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")), "leiden-degree")
        part, _, _, turn = settle(spark, links, degree, part, total, resolution, turn, fixed)
        refined = _refine(spark, links, degree, part, fixed, total, resolution)
        sizes = refined.agg(F.count("*").alias("n"), F.count_distinct("r").alias("parts")).first()
        if sizes["n"] == sizes["parts"]:
            reclaim(spark, degree, refined)
            break
        up = refined.select(F.col("id").alias("was"), F.col("r").alias("next"))
        new = save(spark, belongs.join(up, F.col("c") == F.col("was")).select("id", F.col("next").alias("c")), "leiden-nodes")
        a, b = (refined.select(F.col("id").alias(x), F.col("r").alias(f"r{x}")) for x in "ab")
        merged = save(spark, links.join(a, "a").join(b, "b").groupBy(F.col("ra").alias("a"), F.col("rb").alias("b")).agg(F.sum("w").alias("w")), "leiden-links")
        lifted = save(spark, part.join(up, F.col("id") == F.col("was")).select(F.col("next").alias("id"), "c").distinct(), "leiden-part")
        if fixed is not None:
            was = fixed
            fixed = save(spark, fixed.join(up, F.col("id") == F.col("was")).select(F.col("next").alias("id")).distinct(), "leiden-fixed")
            if was is not given:
                reclaim(spark, was)
        reclaim(spark, belongs, part, degree, refined, *([] if links is base else [links]))
        belongs, links, part = new, merged, lifted
    reclaim(spark, part, *([] if links is base else [links]), *([] if fixed is given else [fixed]))
    return belongs


def leiden(spark: SparkSession, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(id, community) for every end of an edge (src, dst, weight), a community named by its smallest node.

    Unlike in `louvain`, communities are connected without being split at the end. Null ends and weights that
    aren't positive are left out. Levels and rounds are stored tables; the driver sees numbers only.
    """
    links = save(spark, undirected(edges), "leiden-links")
    start = save(spark, links.select(F.col("a").alias("id")).distinct().select("id", F.col("id").alias("c")), "leiden-part")
    out = _named(_levels(spark, links, start, None, resolution))
    reclaim(spark, links)
    return out


def _named(part: DataFrame) -> DataFrame:
    return part.join(part.groupBy("c").agg(F.min("id").alias("community")), "c").select("id", "community")


def fingerprints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(package, n, mark) of nodes (id, package): what a package holds and links to, whatever the order of rows."""
    out = edges.join(nodes.select(F.col("id").alias("src"), "package"), "src").select("package", F.xxhash64("src", "dst", "weight").alias("h"), F.lit(0).alias("one"))
    own = nodes.select("package", F.xxhash64("id").alias("h"), F.lit(1).alias("one"))
    return own.unionByName(out).groupBy("package").agg(F.sum("one").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("mark"))


def leiden_incremental(spark: SparkSession, nodes: DataFrame, edges: DataFrame, stored: DataFrame | None = None, marks: DataFrame | None = None, resolution: float = 1.0) -> tuple[DataFrame, DataFrame, dict]:
    """((id, community), fingerprints, statistics) from the last run's partition and fingerprints.

    Only nodes of packages whose fingerprint changed, and their neighbours, choose again. All others of a
    community are one fixed node, so that the rounds work on what changed and its surroundings. Communities
    that lost a member are checked for connection. ids are strings. Without a stored partition, or when more
    than MOST_CHANGED of the packages are new, gone or different, all is done again, and the statistics say why.
    """
    now = save(spark, fingerprints(nodes, edges), "leiden-marks")
    stats = {"incremental": False, "reason": None, "changed": 0, "packages": now.count(), "repartitioned": 0}
    changed = None
    if stored is None or marks is None:
        stats["reason"] = "nothing stored"
    else:
        old = marks.select("package", F.col("n").alias("n0"), F.col("mark").alias("mark0"))
        differs = ~(F.col("n").eqNullSafe(F.col("n0")) & F.col("mark").eqNullSafe(F.col("mark0")))
        changed = save(spark, now.join(old, "package", "full").where(differs).select("package"), "leiden-changed")
        stats["changed"] = changed.count()
        if stats["changed"] > MOST_CHANGED * max(stats["packages"], 1):
            stats["reason"] = "too much has changed"
    if stats["reason"]:
        return leiden(spark, edges, resolution), now, stats
    stats["incremental"] = True
    links = save(spark, undirected(edges), "leiden-links")
    ends = links.select(F.col("a").alias("id")).distinct()
    new = nodes.join(changed, "package", "left_semi").select("id").unionByName(ends.join(stored, "id", "left_anti")).distinct()
    near = links.join(new.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"))
    gone = stored.join(ends, "id", "left_anti")
    lost = near.unionByName(new).join(stored, "id").select("community").unionByName(gone.select("community")).distinct()
    # a node is n:id while free and c:community of its fixed members otherwise
    touched = near.unionByName(new).distinct().withColumn("free", F.lit(True))
    fresh = new.withColumn("fresh", F.lit(True))
    known = ends.join(stored, "id", "left").join(touched, "id", "left").join(fresh, "id", "left")
    known = save(spark, known.select("id", "community", F.when(F.col("free"), F.concat(F.lit("n:"), "id")).otherwise(F.concat(F.lit("c:"), "community")).alias("at"), F.col("free").isNotNull().alias("free"), F.col("fresh").isNotNull().alias("fresh")), "leiden-known")
    stats["repartitioned"] = known.where("free").count()
    if not stats["repartitioned"] and not gone.limit(1).count():
        return known.select("id", "community"), now, stats
    a, b = (known.select(F.col("id").alias(x), F.col("at").alias(f"at{x}"), F.col("free").alias(f"free{x}")) for x in "ab")
    met = links.join(a, "a").join(b, "b")
    # links between fixed nodes never change sides: they count as the node's own weight
    small = save(spark, met.select(F.col("ata").alias("a"), F.when(F.col("freea") | F.col("freeb"), F.col("atb")).otherwise(F.col("ata")).alias("b"), "w").groupBy("a", "b").agg(F.sum("w").alias("w")), "leiden-links")
    start = save(spark, known.groupBy("at").agg(F.min(F.when(F.col("fresh"), F.col("at")).otherwise(F.concat(F.lit("c:"), "community"))).alias("c")).select(F.col("at").alias("id"), "c"), "leiden-part")
    fixed = save(spark, known.where("not free").select(F.col("at").alias("id")).distinct(), "leiden-fixed")
    found = _levels(spark, small, start, fixed, resolution)
    part = save(spark, known.join(found.withColumnRenamed("id", "at"), "at").select("id", "c", "community"), "leiden-nodes")
    # only where members left can the fixed ones have come apart
    loose = part.join(lost, "community", "left_semi").select("c").distinct()
    checked = part.join(loose, "c", "left_semi")
    a, b = (checked.select(F.col("id").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
    pieces = connected_components(spark, links.join(a, "a").join(b, "b").where("ca = cb and a < b").select("a", "b"))
    whole = part.join(loose.withColumn("loose", F.lit(True)), "c", "left").join(pieces, F.col("id") == F.col("node"), "left")
    out = save(spark, _named(whole.select("id", F.when(F.col("loose"), F.concat(F.lit("p:"), F.coalesce("component", "id"))).otherwise(F.col("c")).alias("c"))), "leiden-out")
    reclaim(spark, links, known, small, part, fixed, found, changed, pieces)
    return out, now, stats
