"""Exact dedup with a heavy-hitter split.

1. Every row gets the SHA-256 of its text, A-Z lower-cased, and a row number; that
   narrow table is written to the shared folder.
2. Each task keeps a Misra-Gries summary of k counters over its digests. The sums of
   the summaries' counts undercount a digest by N/(k+1) at most, so every digest with
   more than 2N/(k+1) rows is among those whose sum is above N/(k+1), of which there
   are k at most.
3. The true count and winner of these candidates come from one exact aggregation
   (combined on the map side). That verified table has k rows at most, and is broadcast.
4. Rows of verified digests are settled on the map side. All other rows are shuffled
   by digest; no group among them has more than 2N/(k+1) rows.

Defined cases: a null text counts as empty; of rows with equal text the largest id
stays, null ids rank lowest; of rows equal in id and text, exactly one stays; an empty
table gives an empty result; other columns pass through untouched whatever their names.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower, field, table, unpack, whole_row
from graphloom.sources.storage import save

#: Counters of a Misra-Gries summary; also the bound on what is broadcast.
COUNTERS = 1024


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


def misra_gries(batches, counters: int):
    """The summary of a stream of digests: what is in it undercounts by n/(counters+1) at most."""
    held: Counter = Counter()
    for batch in batches:
        held.update(batch.column(0).to_pylist())
        if len(held) > counters:
            cut = sorted(held.values(), reverse=True)[counters]
            held = Counter({d: n - cut for d, n in held.items() if n > cut})
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["digest", "seen"])


def digests(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, uid, digest) of every row, stored: uid tells apart rows that are equal in all else."""
    narrow = docs.select(docs[f"`{id_col}`"].alias("id"), digest(docs[f"`{text_col}`"]).alias("digest"))
    return save(spark, narrow.withColumn("uid", F.monotonically_increasing_id()), "digests")


def heavy_winners(spark: SparkSession, rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, best, n) of every digest that many rows share; at most `counters` rows."""
    total = rows.count()
    summaries = rows.select("digest").mapInArrow(lambda it: misra_gries(it, counters), "digest binary, seen long")
    frequent = summaries.groupBy("digest").agg(F.sum("seen").alias("seen")).where(F.col("seen") > F.lit(total / (counters + 1)))
    exact = rows.join(F.broadcast(frequent.select("digest")), "digest").groupBy("digest").agg(F.max(F.struct("id", "uid")).alias("best"), F.count("*").alias("n"))
    return save(spark, exact.where("n > 1"), "heavy")


def annotate(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """(id, keep_id, group_size, kept, digest): one row for each row of docs."""
    rows = digests(spark, docs, id_col, text_col)
    heavy = F.broadcast(heavy_winners(spark, rows, counters))
    settled = rows.join(heavy, "digest").select("id", "uid", "digest", "best", "n")
    group = Window.partitionBy("digest")
    rest = rows.join(heavy.select("digest"), "digest", "left_anti").select(
        "id", "uid", "digest", F.max(F.struct("id", "uid")).over(group).alias("best"), F.count("*").over(group).alias("n")
    )
    return settled.unionByName(rest).select("id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("uid") == F.col("best.uid")).alias("kept"), "digest")


def dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows that stay, with all their columns."""
    heavy = F.broadcast(heavy_winners(spark, digests(spark, docs, id_col, text_col), counters))
    rows = whole_row(docs).withColumn("digest", digest(field(text_col)))
    winners = rows.join(heavy, "digest").where(field(id_col).eqNullSafe(F.col("best.id"))).groupBy("digest").agg(F.first("row").alias("row")).select("row")
    first = Window.partitionBy("digest").orderBy(field(id_col).desc_nulls_last())
    rest = rows.join(heavy.select("digest"), "digest", "left_anti").withColumn("nth", F.row_number().over(first)).where("nth = 1").select("row")
    return unpack(winners.unionByName(rest), docs.columns)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotate(spark, table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), r AS (
  SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) AS nth FROM d
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
