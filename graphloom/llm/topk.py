"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

Vectors are dealt to candidate blocks and queries to query blocks; each pair of blocks
is one task of bounded size. In a task every dimension has its list of candidates in
order of that component. A query walks all lists together, from the large end where its
own component is positive and from the small end where it is negative, scores every
candidate it meets for the first time in full, and stops when the sum of what the next
entries could still add is below its k-th score. The blocks' best are merged by query.

Defined cases: ids are integers; a vector that is null or holds a null or non-finite component takes no
part; vectors of different lengths are never candidates of one another; an empty vector
scores 0; ties go to the smaller id; a row repeated under one id is the query's own row
and is no candidate of it, but counts as often as it occurs for other queries; a query
repeated under one id is answered once for each row; components beyond the exact range
of long arithmetic are computed with unbounded integers and scores held to that range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import table

#: Rows of a block: bounds on what one task holds.
CANDIDATES, QUERIES = 8192, 1024
SCALE = 1024


def threshold_topk(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """(query row, candidate row, score) of each query's k best, by score and then id; own: ids to leave out."""
    n, dims = vectors.shape
    exact = vectors.dtype == object
    ascending = np.argsort(vectors, axis=0, kind="stable") if dims else np.zeros((n, 0), dtype=np.int64)
    ends = np.take_along_axis(vectors, ascending, axis=0) if dims else vectors
    for i, q in enumerate(queries):
        used = np.flatnonzero(q != 0)
        seen = ids == own[i]
        if not len(used):
            some = np.flatnonzero(~seen)
            best = some[np.argsort(ids[some], kind="stable")[:k]]
            yield from ((i, c, 0) for c in best.tolist())
            continue
        up = q[used] > 0
        best, scores, at, step = np.zeros(0, dtype=np.int64), q[:0], 0, max(16, 2 * k)
        while at < n:
            to = min(n, at + step)
            top, low = ascending[n - to : n - at, used[up]], ascending[at:to, used[~up]]
            met = np.zeros(n, dtype=bool)
            met[top.ravel()] = True
            met[low.ravel()] = True
            new = np.flatnonzero(met & ~seen)
            if len(new):
                seen[new] = True
                best, scores = np.concatenate((best, new)), np.concatenate((scores, vectors[new] @ q))
                if len(best) > k:
                    order = np.lexsort((ids[best], -scores))[:k]
                    best, scores = best[order], scores[order]
            bound = (ends[n - to, used[up]] * q[used[up]]).sum() + (ends[to - 1, used[~up]] * q[used[~up]]).sum()
            if len(best) >= k and min(scores) > bound:
                break
            at, step = to, 2 * step
        if exact:
            scores = np.array([max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in scores], dtype=object)
        yield from zip([i] * len(best), best.tolist(), scores.tolist())


def integers(rows) -> np.ndarray:
    """A matrix of floor(scale * x), as long where sums can't overflow and as unbounded integers else."""
    m = np.stack([np.asarray(r, dtype=np.float64) for r in rows]) if len(rows) else np.zeros((0, 0))
    if not m.size or np.abs(m).max() < float(1 << 28) / max(1, m.shape[1]) ** 0.5:
        return m.astype(np.int64)
    return np.array([[int(x) for x in r] for r in m], dtype=object)


def search(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block: int = CANDIDATES, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query's k best among all other rows."""
    vec = vectors[f"`{vector_col}`"]
    usable = vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(vectors[f"`{id_col}`"].alias("id"), F.transform(vec, lambda x: _floor(x, scale)).alias("v"), is_query.alias("asks"), F.monotonically_increasing_id().alias("uid")).where(usable & F.col("id").isNotNull())
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-asked // query_block))
    size = F.size("v")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    cand = rows.select("id", "v", size.alias("dims"), F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("cb"), all_of(query_blocks).alias("qb"))
    asks = rows.where("asks").select("id", "uid", "v", size.alias("dims"), F.pmod(F.xxhash64("uid", F.lit(3)), F.lit(query_blocks)).cast("int").alias("qb"), all_of(blocks).alias("cb"))

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"uid": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        both = integers(list(q["v"]) + list(c["v"]))
        qm, cm = both[: len(q)], both[len(q) :]
        ids, own, uid = c["id"].to_numpy(), q["id"].to_numpy(), q["uid"].to_numpy()
        found = [(uid[i], own[i], ids[j], s) for i, j, s in threshold_topk(qm, own, cm, ids, k)]
        return pd.DataFrame(found, columns=["uid", "query_id", "vec_id", "score"]).astype("int64")

    keys = ("dims", "cb", "qb")
    parts = asks.groupBy(*keys).cogroup(cand.groupBy(*keys)).applyInPandas(best, "uid long, query_id long, vec_id long, score long")
    order = Window.partitionBy("uid").orderBy(F.col("score").desc(), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _floor(x: Column, scale: int) -> Column:
    """floor(scale * x) as a double, which holds it exactly; floor() itself would overflow a long."""
    y = x.cast("double") * float(scale)
    return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""
