"""Ranked retrieval: inverted index with BM25, trigram filter, vectors and fusion."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.storage import save

#: Ours: the reference values are not published.
K1, B = 1.2, 0.75


#: Folders that a stored index spreads its terms over.
FOLDERS = 64


def postings(docs: DataFrame, id_col: str, tokens) -> DataFrame:
    """(id, len, term, tf)."""
    words = docs.select(F.col(id_col).alias("id"), tokens.alias("t")).select("id", F.size("t").alias("len"), F.explode("t").alias("term"))
    return words.groupBy("id", "len", "term").agg(F.count("*").alias("tf"))


def scan_postings(spark: SparkSession, docs: DataFrame, id_col: str, tokens, terms: list[str]) -> tuple[DataFrame, int, float]:
    """Postings of a few terms, the number of documents and their mean length, from one pass over the texts.

    For a search without an index: each document gives its length and those of its words that are asked for, stored once.
    """
    t = docs.select(F.col(id_col).alias("id"), tokens.alias("t"))
    seen = save(spark, t.select("id", F.size("t").alias("len"), F.filter("t", lambda w: w.isin(*terms)).alias("has")), "bm25-scan")
    n, mean = seen.agg(F.count("*"), F.avg("len")).first()
    return seen.where("size(has) > 0").select("id", "len", F.explode("has").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf")), n, mean


def write_index(docs: DataFrame, id_col: str, tokens, path: str) -> None:
    """Stores postings in folders by a hash of the term, sorted by term, and lengths of documents beside them."""
    folder = F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int")
    post = postings(docs, id_col, tokens).withColumn("folder", folder)
    post.repartition("folder", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("folder", "term").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings")
    docs.select(F.col(id_col).alias("id"), F.size(tokens).alias("len")).write.mode("overwrite").parquet(f"{path}/lengths")


def search_index(spark: SparkSession, path: str, terms: list[str], limit: int) -> DataFrame:
    """bm25 over a stored index: of its folders only those of the query's terms are read."""
    n, mean = spark.read.parquet(f"{path}/lengths").agg(F.count("*"), F.avg("len")).first()
    asked = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in terms])).alias("term"))
    folders = [r[0] for r in asked.select(F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int")).distinct().collect()]  # one for each term at most
    return bm25(spark.read.parquet(f"{path}/postings").where(F.col("folder").isin(*folders)), n, mean, terms, limit)


def bm25(index: DataFrame, docs: int, mean: float, terms: list[str], limit: int) -> DataFrame:
    """(id, score): the query's terms are pushed down; document frequency comes from the same few rows."""
    some = index.where(F.col("term").isin(*terms))
    df = some.groupBy(F.col("term").alias("t")).agg(F.count("*").alias("df"))
    idf = F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    scored = some.join(df, F.col("term") == F.col("t")).groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))
    return scored.orderBy(F.col("score").desc(), "id").limit(limit)


def grams(text: str | None) -> set[str]:
    """Distinct three-letter pieces of a text."""
    return set(map("".join, zip(text, text[1:], text[2:]))) if text else set()


def trigram_postings(docs: DataFrame, id_col: str, text: str, only: set[str] | None = None) -> DataFrame:
    """(id, gram) for each distinct gram of each document, or for those in `only`."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                found = [sorted(grams(t) if only is None else (g for g in only if t and g in t)) for t in part.column(1).to_pylist()]
                row = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), pa.array([g for x in found for g in x], pa.string())], ["id", "gram"])

    return narrow.mapInArrow(run, f"id {dict(narrow.dtypes)['id']}, gram string")


def trigram_candidates(docs: DataFrame, id_col: str, text: str, literal: str) -> DataFrame:
    """docs whose id has all of the literal's grams in the postings; all docs if the literal is too short for a gram."""
    wanted = grams(literal)
    if not wanted:
        return docs
    full = trigram_postings(docs, id_col, text, wanted).groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted))
    return docs.join(full.select(F.col("id").alias("with_all")), F.col(id_col).eqNullSafe(F.col("with_all")), "left_semi")


def trigram_search(docs: DataFrame, id_col: str, text: str, literal: str) -> DataFrame:
    """(id): documents that hold all of the literal's pieces, verified; a short literal looks at all."""
    found = trigram_candidates(docs.select(id_col, text), id_col, text, literal).where(F.col(text).contains(literal))
    return found.select(F.col(id_col).alias("id"))


def cosine(a, b):
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def fuse(text: DataFrame, vector: DataFrame, alpha: float, k: int = 60) -> DataFrame:
    """(id, score) from ranks counted from 0: (1 - a) / (k + rank + 1) by text and a / (k + rank + 1) by vector."""
    part = lambda r, w: F.coalesce(F.lit(w) / (k + F.col(r) + 1), F.lit(0.0))
    both = text.select(F.col("id").alias("ti"), F.col("rank").alias("tr")).join(vector.select(F.col("id").alias("vi"), F.col("rank").alias("vr")), F.col("ti") == F.col("vi"), "full_outer")
    return both.select(F.coalesce("ti", "vi").alias("id"), F.round(part("tr", 1 - alpha) + part("vr", alpha), 9).alias("score"))
