"""Sharding by sampled splitters, under the law `bytes`: shards nearly equal in size.

DataFrame operations only; the driver sees tables whose row number is a parameter.

1. A record's key is a hash of its text, so equal texts lie side by side.
2. Size-weighted samples of the keys (a hash of the record decides, so reruns agree)
   give quantile boundaries; a boundary that is drawn more than once, a hot key, gets
   a range to itself.
3. Exact bytes and rows of each range are summed. Overfull ranges that hold several
   keys are sampled again and subdivided; a single text larger than a whole shard's
   fair share is subdivided by a hash of the record's id; every other group of equal
   texts stays in one shard.
4. The ranges are dealt to the shards, largest first, each to the emptiest shard.
   Ranges with many rows are numbered in pieces, so no task numbers a hot group alone.

Defined cases: a null text has no bytes (size 1) and the checksum of the empty text;
null ids share one piece of a hot group; repeated rows get a slot each; an empty table
gives no rows; other columns pass through untouched whatever their names.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import field, table, unpack, whole_row
from graphloom.sources.storage import save

SHARDS = 16
#: Key ranges aimed at, and size-weighted draws for each: bounds on what the driver sees.
RANGES, DRAWS = 1024, 64


def _longs(values) -> str:
    return f"array({','.join(f'{int(v)}L' for v in values)})" if len(values) else "cast(array() as array<bigint>)"


def _uniform(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c) for c in cols], F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def range_of(key: str, splitters: list[int]) -> Column:
    """How many splitters are at most the key: two short searches instead of one long one."""
    if not splitters:
        return F.lit(0).cast("long")
    step = max(1, int(len(splitters) ** 0.5))
    blocks = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    block = f"size(filter({_longs([b[0] for b in blocks])}, s -> s <= {key}))"
    inner = f"array({','.join(_longs(b) for b in blocks)})"
    return F.expr(f"CASE WHEN {key} < {splitters[0]}L THEN 0L ELSE cast(({block} - 1) * {step} + size(filter(element_at({inner}, {block}), s -> s <= {key})) AS bigint) END")


def draw(base: DataFrame, by: list[str], per_byte: float, quantiles: int) -> list:
    """Size-weighted key quantiles of each group of `by`: rows of (by..., array of keys)."""
    weighted = base.withColumn("drawn", F.floor(F.col("size") * F.lit(per_byte) + _uniform("id", "key"))).where("drawn > 0")
    at = ",".join(f"{i / quantiles!r}D" for i in range(1, quantiles)) or "0.5D"
    return weighted.groupBy(*by).agg(F.expr(f"percentile(key, array({at}), drawn)").alias("keys")).collect()


def boundaries(keys: list[float]) -> set[int]:
    """Splitters at the quantiles; a key that spans a whole quantile is cut off on both sides."""
    cut = [int(k) for k in keys]
    hot = {a for a, b in zip(cut, cut[1:]) if a == b}
    return set(cut) | {k + 1 for k in hot}


def plan(spark: SparkSession, base: DataFrame, shards: int = SHARDS, ranges: int = RANGES, draws: int = DRAWS):
    """(splitters, pieces of each range, {(range, piece): (shard, first slot)}) for a stored base(id, size, key)."""
    total, count = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not count:
        return [], [1], {}
    fair = total / shards
    splitters = sorted(boundaries(next(iter(draw(base, [], ranges * draws / total, ranges)), {"keys": []})["keys"] or []))
    while True:  # each pass cuts every overfull range, so in the end each is full of one key or small enough
        stats = base.withColumn("r", range_of("key", splitters)).groupBy("r").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        over = {s["r"]: s for s in stats if s["b"] > 4 * total / ranges and s["lo"] < s["hi"]}
        if not over:
            break
        part = base.withColumn("r", range_of("key", splitters)).where(F.col("r").isin(list(over)))
        finer = draw(part, ["r"], ranges * draws / total, 16)
        more = set().union(*(boundaries(x["keys"] or []) for x in finer)) - set(splitters)
        if not more:
            break
        splitters = sorted(set(splitters) | more)
    pieces = [1] * (len(splitters) + 1)
    loose = set()
    for s in stats:
        if s["b"] > fair and s["lo"] == s["hi"]:  # a group that no shard can hold whole
            loose.add(s["r"])
            pieces[s["r"]] = max(2, -int(-s["b"] // (fair / 8)))
        pieces[s["r"]] = max(pieces[s["r"]], -int(-s["n"] // max(64, 4 * count / ranges)))
    sizes = base.withColumn("r", range_of("key", splitters)).withColumn("p", piece_of("r", pieces)).groupBy("r", "p").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    items: dict = {}
    for x in sizes:
        items.setdefault((x["r"], x["p"]) if x["r"] in loose else (x["r"],), []).append(x)
    heap = [(0, shard, 0) for shard in range(shards)]
    placed = {}
    for _, parts in sorted(items.items(), key=lambda kv: (-sum(x["b"] for x in kv[1]), kv[0])):
        filled, shard, slot = heapq.heappop(heap)
        for x in sorted(parts, key=lambda x: x["p"]):
            placed[x["r"], x["p"]] = (shard, slot)
            slot, filled = slot + x["n"], filled + x["b"]
        heapq.heappush(heap, (filled, shard, slot))
    return splitters, pieces, placed


def piece_of(r: str, pieces: list[int]) -> Column:
    return F.pmod(F.xxhash64(F.col("id"), F.lit(29)), F.expr(f"element_at({_longs(pieces)}, cast({r} + 1 AS int))"))


def place(rows: DataFrame, planned, order: list[Column]) -> DataFrame:
    """rows(id, key, ...) with shard and slot."""
    splitters, pieces, placed = planned
    first = [0]
    for n in pieces:
        first.append(first[-1] + n)
    shard, slot = [0] * first[-1], [0] * first[-1]
    for (r, p), (s, at) in placed.items():
        shard[first[r] + p], slot[first[r] + p] = s, at
    cell = rows.withColumn("_r", range_of("key", splitters)).withColumn("_p", piece_of("_r", pieces))
    cell = cell.withColumn("_cell", F.expr(f"element_at({_longs(first)}, cast(_r + 1 AS int)) + _p"))
    nth = F.row_number().over(Window.partitionBy("_cell").orderBy(*order))
    cell = cell.withColumn("_nth", nth)
    return cell.withColumn("shard", F.expr(f"cast(element_at({_longs(shard)}, cast(_cell + 1 AS int)) AS int)")).withColumn(
        "slot", F.expr(f"element_at({_longs(slot)}, cast(_cell + 1 AS int))") + F.col("_nth") - 1
    ).drop("_r", "_p", "_cell", "_nth")


def measures(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [(F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).cast("long").alias("crc"), F.shiftrightunsigned(F.xxhash64(text), 12).alias("key")]


def assign(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """docs with (size, text_crc32, shard, slot) in a struct column `placed` beside all their own columns in `row`."""
    narrow = docs.select(docs[f"`{id_col}`"].alias("id"), *measures(docs[f"`{text_col}`"]))
    planned = plan(spark, save(spark, narrow, "shard-base"), shards)
    rows = whole_row(docs).withColumn("id", field(id_col)).select("row", "id", *measures(field(text_col)))
    out = place(rows, planned, [F.col("id"), F.col("crc"), F.col("size")])
    return out.select("row", F.struct("size", F.col("crc").alias("text_crc32"), "shard", "slot").alias("placed"))


def write_shards(spark: SparkSession, docs: DataFrame, path: str, **kw) -> None:
    """One folder of parquet for each shard, rows in slot order within each file."""
    out = assign(spark, docs, **kw)
    flat = out.select("row", F.col("placed.shard").alias("shard"), F.col("placed.slot").alias("slot"))
    flat.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = save(spark, docs.select(F.col("doc_id").alias("id"), *measures(docs["text"])), "shard-base")
    out = place(base, plan(spark, base), [F.col("id"), F.col("crc"), F.col("size")])
    return out.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
