"""From raw documents to token ids: language ID, exact dedup, near-duplicate join, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
parquet and read again as the next stage's docs. All but the last return the columns of
documents. Near duplicates are of five-word shingles at a similarity of 0.8. The mix
repeats or leaves out documents to meet its targets, so a document may occur twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, exact_dedup, language_id, mixing, ngram_join
from graphloom.sources.storage import release, save

NEAR = ngram_join.Join(words=5, num=4, den=5)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter go."""
    return language_id.keep_identified(spark, docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    release(spark)
    return exact_dedup.dedup(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays."""
    release(spark)
    return ngram_join.keep_one(spark, docs, NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    release(spark)
    return mixing.mix(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to."""
    release(spark)
    return bpe.digest_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", identify), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("mixing", mix_sources), ("byte_bpe", encode)]

#: Profiles, rate rounding and BPE have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(spark, stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
