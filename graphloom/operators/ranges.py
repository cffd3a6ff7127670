"""Lines to the innermost symbol around them, by an equi-join on bins of many sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes of bins: 2 to the power of 0 to LEVELS - 1 lines; a longer symbol takes as many of the largest as it covers.
LEVELS = 24


def around(symbols: DataFrame, hits: DataFrame) -> DataFrame:
    """hits(path, line, ...) with each of symbols(path, id, start, stop) around them: a row for each such pair.

    A symbol lies in bins of about its own length, three at most; a line looks into one bin of each size. So
    a symbol as long as its file costs no more rows than a short one, and nothing is joined by a range
    alone.
    """
    span = F.greatest(F.col("stop") - F.col("start") + 1, F.lit(1))
    level = F.least(F.ceil(F.log2(span.cast("double"))), F.lit(LEVELS - 1)).cast("int")
    bins = F.explode(F.sequence(F.floor(F.col("start") / F.pow(F.lit(2.0), F.col("level"))), F.floor(F.col("stop") / F.pow(F.lit(2.0), F.col("level")))))
    binned = symbols.where("stop >= start").select("path", "id", "start", "stop", level.alias("level")).withColumn("bin", bins)
    looks = hits.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))).withColumn("bin", F.floor(F.col("line") / F.pow(F.lit(2.0), F.col("level"))))
    return looks.join(binned, ["path", "level", "bin"]).where(F.col("line").between(F.col("start"), F.col("stop"))).drop("level", "bin")


def innermost(symbols: DataFrame, hits: DataFrame) -> DataFrame:
    """hits(path, line, ...) with the id of the innermost of symbols(path, id, start, stop) around each; null if there is none.

    Innermost is the shortest, then the one that begins last, then the smallest id.
    """
    named = hits.withColumn("__hit", F.monotonically_increasing_id())
    by = F.min(F.struct((F.col("stop") - F.col("start")).alias("span"), (-F.col("start")).alias("late"), "id"))
    best = around(symbols, named.select("__hit", "path", "line")).groupBy("__hit").agg(by.alias("b")).select("__hit", F.col("b.id").alias("symbol"))
    return named.join(best, "__hit", "left").drop("__hit")
