"""Lines that match a regular expression, found through stored trigram postings.

The index is a folder: postings (gram, ids, batch), parted by batch and by a hash of the gram, and owners (id,
batch). A row of the postings has the ids of one block of documents, so that there are as many rows as blocks have
grams, not as documents have. Adding documents writes a new batch; of a document only its last batch counts, so that Add
replaces and an empty text removes. A search reads the parts of the grams that its expression
needs and no others, then the texts of the candidates, which the expression itself decides on.
"""

from __future__ import annotations

import re
from re import _constants as rc
from re import _parser as rp

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.storage import save

#: Folders of a batch's postings, and files that each is written in, so that a frequent gram isn't one task's.
PARTS, FILES = 64, 4
#: Alternatives that an expression's grams are kept for; beyond, a part of it is left to the texts.
MOST = 16
#: Characters of a block of documents, unless one alone has more.
CHARS = 2_000_000

Needs = list[frozenset[str]]  # one of these sets of grams is in every text that matches; an empty set: any text can


def part_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def blocks(batches, chars: int):
    """(gram, ids): the documents, (id, text), of each block of so many characters that hold a gram."""

    def block(docs):
        texts, n = docs.column(1).to_pylist(), len(docs)
        letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        known = np.flatnonzero(np.bincount(letters))  # the block's letters, numbered
        if n > 1 and len(known) ** 3 * n >= 1 << 63:
            yield from block(docs.slice(0, n // 2))
            yield from block(docs.slice(n // 2))
            return
        doc = np.repeat(np.arange(n), [len(t) for t in texts])
        number = np.zeros(known[-1] + 1, np.int64)
        number[known] = np.arange(len(known))
        at = number[letters]
        gram = (at[:-2] * len(known) + at[1:-1]) * len(known) + at[2:]
        pairs = np.sort((gram * n + doc[2:])[doc[:-2] == doc[2:]])
        gram, doc = np.divmod(pairs[np.diff(pairs, prepend=-1) != 0], n)
        if len(gram):
            starts = np.flatnonzero(np.append(True, np.diff(gram) != 0))
            first, last = np.divmod(gram[starts], len(known) ** 2), len(known)
            three = known[np.stack([first[0], first[1] // last, first[1] % last], 1)].astype(np.uint32).tobytes().decode("utf-32-le")
            ids = pa.ListArray.from_arrays(pa.array(np.append(starts, len(gram)), pa.int32()), docs.column(0).take(pa.array(doc)))
            yield pa.RecordBatch.from_arrays([pa.array([three[i : i + 3] for i in range(0, len(three), 3)], pa.string()), ids], ["gram", "ids"])

    for batch in batches:
        batch = batch.filter(pc.greater(pc.utf8_length(batch.column(1)), 2))  # no null either
        if len(batch):
            part = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy(), dtype=np.int64) // chars
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(batch)]
            for a, b in zip(cuts, cuts[1:]):
                yield from block(batch.slice(a, b - a))


def batches(spark: SparkSession, index: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{index}/owners")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return len(fs.listStatus(p)) if fs.exists(p) else 0


def add(spark: SparkSession, index: str, docs: DataFrame, id_col: str = "id", text_col: str = "text") -> None:
    """Puts documents into the index, in place of what it has of them; ids are unique, null ones and null texts aren't found."""
    n = batches(spark, index)
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text")).where("id is not null")
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chars = CHARS
    made = rows.select("id", low.alias("text")).mapInArrow(lambda texts: blocks(texts, chars), f"gram string, ids array<{dict(rows.dtypes)['id']}>")
    flat = made.withColumn("part", part_of(F.col("gram"))).repartition("part", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(FILES))).sortWithinPartitions("part", "gram")
    flat.write.mode("overwrite").partitionBy("part").parquet(f"{index}/postings/batch={n}")
    rows.select("id").write.mode("overwrite").parquet(f"{index}/owners/batch={n}")  # last: a batch without owners doesn't exist


def both(a: Needs, b: Needs) -> Needs:
    """What a text needs that needs either of a and either of b; b is let go where that would be too many."""
    out = {x | y for x in a for y in b}
    return list(out) if len(out) <= MOST else a


def needs(pattern: str) -> Needs:
    """The grams, lower-cased, that a text must hold to match, in alternatives."""

    def literal(run: list[str]) -> Needs:
        text = "".join(run).lower()
        return [frozenset(map("".join, zip(text, text[1:], text[2:])))]

    def sequence(items) -> Needs:
        got, run = [frozenset()], []

        def end():
            nonlocal got
            got, run[:] = both(got, literal(run)), []

        for op, arg in items:
            if op is rc.LITERAL and arg < 128:
                run.append(chr(arg))
            elif op is rc.AT:
                continue  # a place has no width
            else:
                end()
                if op is rc.SUBPATTERN:
                    got = both(got, sequence(arg[-1]))
                elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT) and arg[0] > 0:
                    got = both(got, sequence(arg[2]))
                elif op is rc.ATOMIC_GROUP:
                    got = both(got, sequence(arg))
                elif op is rc.BRANCH:
                    ways = list({x for branch in arg[1] for x in sequence(branch)})
                    got = both(got, ways if len(ways) <= MOST else [frozenset()])
        end()
        return got

    if re.search(r"\(\?[a-z]*u", pattern):
        return [frozenset()]  # letters beyond ASCII may stand for those in it
    try:
        ways = sequence(rp.parse(pattern))
        return ways if all(ways) else [frozenset()]
    except re.error:  # an expression that only the engine knows: every text is looked at
        return [frozenset()]


def candidates(spark: SparkSession, index: str, pattern: str) -> DataFrame | None:
    """(id) of the documents that hold the grams of one of the alternatives; None if any document could match."""
    ways = needs(pattern)
    if not all(ways):
        return None
    wanted = sorted(set().union(*ways))
    parts = [r["p"] for r in spark.createDataFrame([(g,) for g in wanted], "gram string").select(part_of(F.col("gram")).alias("p")).distinct().collect()]
    owners = spark.read.parquet(f"{index}/owners").groupBy("id").agg(F.max("batch").alias("last"))
    hits = spark.read.parquet(f"{index}/postings").where(F.col("part").isin(parts) & F.col("gram").isin(wanted))
    held = [F.count_if(F.col("gram").isin(sorted(way))).alias(f"w{i}") for i, way in enumerate(ways)]  # a gram has an id once
    has = hits.select("gram", F.explode("ids").alias("id"), "batch").groupBy("id", "batch").agg(*held)
    full = F.lit(False)
    for i, way in enumerate(ways):
        full = full | (F.col(f"w{i}") >= len(way))
    return has.where(full).join(owners, "id").where("batch = last").select("id")


def search(spark: SparkSession, index: str | None, docs: DataFrame, pattern: str, id_col: str = "id", text_col: str = "text", limit: int | None = None) -> DataFrame:
    """(id, line, text) of the lines that match, counted from 1, by id and line; without an index all texts are looked at."""
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    some = candidates(spark, index, pattern) if index else None
    if some is not None:
        rows = rows.join(save(spark, some, "candidates"), "id", "left_semi")  # of known size, so that texts aren't dealt for a few ids
    lines = rows.select("id", F.posexplode(F.split("text", "\n", -1)).alias("at", "text")).where(F.col("text").rlike(pattern))
    out = lines.select("id", (F.col("at") + 1).alias("line"), "text")
    return out if limit is None else out.orderBy("id", "line").limit(limit)
