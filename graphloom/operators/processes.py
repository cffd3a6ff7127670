"""Processes: what likely entry points call, in the order of a depth-first walk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.sources.storage import reclaim, save

#: Processes, depth of calls, steps of one process, steps of all.
PROCESSES, DEPTH, STEPS, ALL_STEPS = 50, 15, 2048, 16384


def processes(spark: SparkSession, entries: DataFrame, calls: DataFrame, most: int = PROCESSES, depth: int = DEPTH, steps: int = STEPS, total: int = ALL_STEPS) -> DataFrame:
    """(process, entry, score, step, id, depth, truncated) for the best entries (id, score) over calls (src, dst).

    Callees are visited in order of their ids, each once a process, `depth` calls deep at most. In that order a node's
    way from the entry is the smallest, as a list of ids, that extends the way of one of its callers. So all
    processes are walked at once: a round builds every way anew from the ways of the round before, and the rounds end when
    none differs. A process keeps its first steps + 1 ways, so a round holds most * (steps + 1) rows. Entries come by score, then id;
    they share `total` steps, and one that reaches nothing else, or for which two steps aren't left, is no process. `truncated`: more could be
    reached than was kept. Null ends and calls of oneself are left out.
    """
    rank = F.row_number().over(Window.orderBy(F.col("score").desc(), "id"))
    first = save(spark, entries.select("id", "score").orderBy(F.col("score").desc(), "id").limit(most).select((rank - 1).alias("process"), F.col("id").alias("entry"), "score"), "process-entries")
    arcs = save(spark, calls.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), "process-calls")
    roots = first.select("process", F.col("entry").alias("id"), F.array("entry").alias("way"))
    at = save(spark, roots, "process-ways")
    order = Window.partitionBy("process").orderBy("way")
    while True:
        grown = at.where(F.size("way") <= depth).join(arcs, F.col("id") == F.col("a")).where(~F.array_contains("way", F.col("b")))
        ways = grown.select("process", F.col("b").alias("id"), F.concat("way", F.array("b")).alias("way")).unionByName(roots)
        least = ways.groupBy("process", "id").agg(F.min("way").alias("way")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= steps + 1).drop("n")
        new = save(spark, least, "process-ways")
        same = new.join(at, ["process", "id", "way"], "left_semi").count()
        done = same == new.count() == at.count()
        reclaim(spark, at)
        at = new
        if done:
            break
    reclaim(spark, arcs)
    before = F.coalesce(F.sum(F.when(F.col("n") >= 2, F.least("n", F.lit(steps))).otherwise(0)).over(Window.orderBy("process").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = at.groupBy("process").agg(F.count("*").alias("n")).withColumn("left", F.lit(total) - before).where("n >= 2 and left >= 2")
    room = room.select("process", "n", F.least("left", F.lit(steps)).alias("cap"))
    rows = at.join(room, "process").withColumn("step", F.row_number().over(order)).where("step <= cap").join(first, "process")
    return rows.select("process", "entry", "score", "step", "id", (F.size("way") - 1).alias("depth"), (F.col("n") > F.col("cap")).alias("truncated"))
