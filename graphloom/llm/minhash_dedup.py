"""Near-duplicate detection by MinHash with banding, signature verification and large-star/small-star components.

A document is the set of 64-bit hashes of its word n-grams. Documents link when the Jaccard
similarity of their sets is at least num/den; classes are the connected components.

1. Signatures: the minima of `hashes` multiply-add hash functions over the set. `rows` of them
   make a band's key. A byte of each minimum is the signature kept.
2. Of documents with equal sets (met by a digest, frequent ones without a shuffle) one
   goes on. A set too small to link with any but an equal one sends no keys.
3. Buckets are aggregated by key (count, smallest id, sum of hashes of the ids), combined before
   the shuffle; of buckets with the same members one is kept, and its members are found by a
   join. Each member is held against the bucket centre (smallest id) that it shares most bands with.
4. A pair passes if its signatures agree as often as linked sets' do but for SIGMAS standard
   deviations, then if its full sets link.
5. Components come from large-star and small-star. Then only buckets that hold several components are
   looked at, in rounds: members outside the bucket's largest component are held against all of it,
   in blocks, by parity sketches of their sets, whose distance is a lower bound of the sets' difference, so
   that hardly any pair below the threshold goes on. Each component sends its nearest pairs to step
   4. What links merges components. Buckets that held pairs back come again with more, until none does.

At the threshold of 0.8 a linked pair shares no band with a probability of 5e-8, at 0.85 of 6e-11, and fails
the signature test with about 1e-12; no other step loses a pair, however large its bucket.

Defined cases: a document with fewer words than n is its whole sequence as one n-gram; without
words or text its set is empty and links with nothing; ids may be of any type that has an order;
a null id is in no component (null), and stays; rows that share an id are one node; ties and
repeated rows need no care; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import stars
from graphloom.llm.common import give_back, table
from graphloom.llm.ngram_join import BASE, FURTHER, HELD, REACH, Join, both_ends, by_groups, equal_sets, flat_sketches, marked, mix, nearest, numbered, picked, runs, sets_of, verified
from graphloom.sources.storage import reclaim, save

#: Shingles hashed together.
BLOCK = 1 << 15
#: Members of a bucket on either side of a comparison.
PART = 4096
#: Standard deviations below the expected agreement at which a signature still passes.
SIGMAS = 7


@dataclass(frozen=True)
class Near:
    """What links, and the signature: `hashes` minima, a multiple of 64, in bands of `rows`."""

    words: int = 5
    num: int = 4
    den: int = 5
    hashes: int = 128
    rows: int = 4

    @property
    def join(self) -> Join:
        return Join(self.words, self.num, self.den)

    @property
    def passing(self) -> int:
        """How many bytes of two signatures agree at least."""
        agree = self.num / self.den + (1 - self.num / self.den) / 256
        return math.floor(self.hashes * agree - SIGMAS * math.sqrt(self.hashes * agree * (1 - agree)))

    def alone(self, n: int) -> bool:
        """Whether a set of n links with equal sets only."""
        return n * (self.den - self.num) < self.num

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """Odd factors and addends of the hash functions."""
        k = np.arange(1, 2 * self.hashes + 1, dtype=np.uint64)
        drawn = mix(mix(k * BASE))
        return drawn[: self.hashes] | np.uint64(1), drawn[self.hashes :]


def minima(sets: list[np.ndarray], near: Near) -> np.ndarray:
    """(sets x hashes) minima of sets that aren't empty; large ones are hashed in several blocks."""
    factors, addends = near.functions()
    flat, first = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets])
    out = np.full((len(sets), near.hashes), np.iinfo(np.uint64).max, np.uint64)
    hashed = np.empty(BLOCK, np.uint64)
    for at in range(0, len(flat), BLOCK):
        x = flat[at : at + BLOCK]
        h = hashed[: len(x)]
        a, b = np.searchsorted(first, at, side="right") - 1, np.searchsorted(first, at + len(x))
        cuts = np.maximum(first[a:b] - at, 0)
        for k in range(near.hashes):
            np.multiply(x, factors[k], out=h)
            np.add(h, addends[k], out=h)
            out[a:b, k] = np.minimum(out[a:b, k], np.minimum.reduceat(h, cuts))
    return out


def keys_of(least: np.ndarray, near: Near) -> np.ndarray:
    """(sets x bands) keys; a band's number is mixed in."""
    parts = least.reshape(len(least), -1, near.rows)
    key = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(near.rows):
        key = mix(key * BASE + parts[:, :, k])
    return key.view(np.int64)


def scan(docs: DataFrame, near: Near) -> DataFrame:
    """(id, n, digest, signature, keys) of each row of docs(id, text); the last two are null for sets without keys."""
    names = ["id", "n", "digest", "signature", "keys"]

    def run(batches):
        for part in runs(batches):
            sets = sets_of(part.column(1).to_pylist(), near.join)
            ns = [len(s) for s in sets]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            signed, keyed = [None] * len(sets), [None] * len(sets)
            send = [i for i, n in enumerate(ns) if not near.alone(n)]
            if send:
                least = minima([sets[i] for i in send], near)
                bytes_ = (least >> np.uint64(8)).astype(np.uint8)
                for i, a, b in zip(send, bytes_, keys_of(least, near)):
                    signed[i], keyed[i] = a.tobytes(), b
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(signed, pa.binary()), pa.array(keyed, pa.list_(pa.int64()))], names)
        give_back()

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, n long, digest binary, signature binary, keys array<long>")


def buckets(keyed: DataFrame) -> DataFrame:
    """(key, center, bands) of the buckets of keyed(key, id) that several share; of those with the same members one, which counts for all."""
    h = F.xxhash64("id")
    halves = [F.sum(h.bitwiseAND(F.lit((1 << 31) - 1))).alias("s1"), F.sum(F.shiftrightunsigned(h, 33)).alias("s2")]
    full = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("center"), *halves).where("m > 1")
    return full.groupBy("m", "center", "s1", "s2").agg(F.min("key").alias("key"), F.count("*").alias("bands")).select("key", "center", "bands")


def agreeing(pairs: DataFrame, signatures: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow a link."""
    most = near.passing

    def test(n: int, a: bytes, m: int, b: bytes) -> bool:
        return min(n, m) * near.den >= max(n, m) * near.num and int((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).sum()) >= most

    full = both_ends(pairs.select("a", "b"), signatures, []).select("a", "b", "n_a", "signature_a", "n_b", "signature_b")
    return picked(full, dict(pairs.dtypes)["a"], test)


def linking(spark: SparkSession, pairs: DataFrame, signatures: DataFrame, marks: DataFrame, near: Near) -> DataFrame:
    """The linked ones of pairs(a, b), stored."""
    passed = save(spark, agreeing(pairs, signatures, near), "minhash-passed")
    links = save(spark, verified(passed, marks, near.join).distinct(), "minhash-links")
    reclaim(spark, passed)
    return links


def across(members: DataFrame, labels: DataFrame, sketches: DataFrame, join: Join, reach: int) -> DataFrame:
    """(a, b, key, more): near pairs of different components in the buckets of members(key, id) that hold several.

    From each block come the nearest `reach` of each component, ties to smaller ids; more says that it held others back.
    """
    kind = dict(members.dtypes)["id"]
    rows = members.join(labels, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    sizes = rows.groupBy("key", "c").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("m"), F.count("*").alias("several")).where("several > 1")
    blocks = F.ceil((F.col("m") - F.col("top.k")) / PART)
    mixed = mixed.select(F.col("key").alias("at"), F.col("top.c").alias("largest"), F.ceil(F.col("m") / PART).alias("parts"), blocks.alias("blocks"))
    rows = rows.join(mixed, F.col("key") == F.col("at")).join(sketches.withColumnRenamed("id", "of"), F.col("id") == F.col("of"))
    place, kept = F.xxhash64("id"), ["key", "band", "id", "c", "n", "bits"]
    outer = rows.where("c <> largest").withColumns({"outer": F.lit(True), "block": F.pmod(place, "blocks"), "part": F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))})
    whole = rows.withColumns({"outer": F.lit(False), "part": F.pmod(place, "parts"), "block": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))})

    def compared(group: pa.Table):
        n, outer = group.column("n").to_numpy(), np.asarray(group.column("outer").to_pylist(), bool)
        (ids, at), (_, c) = numbered(group.column("id")), numbered(group.column("c"))
        bits = np.frombuffer(b"".join(group.column("bits").to_pylist()), np.uint32).reshape(len(at), -1)
        us, them = np.flatnonzero(outer), np.flatnonzero(~outer)
        mine = np.zeros(len(ids), bool)
        mine[at[us]] = True
        held, size, more = [], 0, False
        step = max(1, (1 << 21) // max(1, bits.shape[1] * len(them)))
        for start in range(0, len(us), step):
            some = us[start : start + step]
            far = np.bitwise_count(bits[some, None] ^ bits[None, them]).sum(axis=2, dtype=np.int64)
            i, j = np.nonzero((far <= join.difference(n[some, None], n[None, them])) & (c[some, None] != c[None, them]))
            far, i, j = far[i, j], some[i], them[j]
            use = ~(mine[at[j]] & (at[j] < at[i]))  # two of this block come once
            far, i, j = far[use], i[use], j[use]
            turn = at[i] > at[j]
            i, j = np.where(turn, j, i), np.where(turn, i, j)
            held.append(np.stack((far, at[i], at[j], c[i], c[j])))
            size += len(i)
            if size > HELD:
                held = [nearest(np.concatenate(held, axis=1), reach)]
                more, size = more or held[0].shape[1] < size, held[0].shape[1]
        if size:
            found = nearest(np.concatenate(held, axis=1), reach)
            more = more or found.shape[1] < size
            of = group.column("id").type
            yield pa.RecordBatch.from_arrays([pa.array(ids[found[1]], of), pa.array(ids[found[2]], of), pa.array(np.full(found.shape[1], group.column("key")[0].as_py())), pa.array(np.full(found.shape[1], more))], ["a", "b", "key", "more"])

    both = outer.select("block", "part", "outer", *kept).unionByName(whole.select("block", "part", "outer", *kept))
    groups = ["key", "band", "block", "part"]
    return both.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(by_groups(groups, compared), f"a {kind}, b {kind}, key long, more boolean")


def components(spark: SparkSession, docs: DataFrame, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, component) of every row of docs."""
    narrow = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    found = save(spark, scan(narrow, near), "minhash-found")
    equal = equal_sets(spark, found.select("id", F.lit(1).alias("need"), "n", "digest"))
    spare = equal.select(F.col("b").alias("of")).distinct()
    one = save(spark, found.where("keys is not null and id is not null").join(spare, F.col("id") == F.col("of"), "left_anti"), "minhash-one")
    keyed = one.select("id", F.explode("keys").alias("key"))
    shared = save(spark, buckets(keyed), "minhash-buckets")
    members = save(spark, keyed.join(shared, "key").select("key", "id", "center", "bands").distinct(), "minhash-members")
    ids = save(spark, members.select(F.col("id").alias("of")).distinct(), "minhash-ids")  # its size is known, so that a small one spares the texts a shuffle
    marks = save(spark, marked(narrow, ids, near.join), "minhash-marks")
    signatures = save(spark, one.select("id", "n", "signature").join(ids, F.col("id") == F.col("of"), "left_semi").distinct(), "minhash-signatures")
    reclaim(spark, shared, ids, one)
    most = members.where("id <> center").groupBy("id", "center").agg(F.sum("bands").alias("bands")).groupBy("id").agg(F.max(F.struct("bands", "center")).alias("s"))
    links = linking(spark, most.select(F.col("s.center").alias("a"), F.col("id").alias("b")), signatures, marks, near)
    labels = stars.components(spark, links.unionByName(equal))
    reclaim(spark, links)
    left, reach = members.select("key", "id"), REACH
    while True:
        pairs = save(spark, across(left, labels, flat_sketches(marks, "fine"), near.join, reach), "minhash-near")
        links = linking(spark, pairs.select("a", "b").distinct(), signatures, marks, near)
        if links.limit(1).count():
            old, labels = labels, stars.merged(spark, labels, links)
            reclaim(spark, old)
        again = save(spark, pairs.where("more").select(F.col("key").alias("again")).distinct(), "minhash-again")
        reclaim(spark, pairs, links)
        if not again.limit(1).count():
            break
        left, reach = left.join(again, F.col("key") == F.col("again"), "left_semi"), reach * FURTHER
    return found.select("id", "n").join(labels, F.col("id") == F.col("node"), "left").select("id", "n", F.coalesce("component", "id").alias("component"))


def keep_one(spark: SparkSession, docs: DataFrame, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the smallest id of each component alone; rows without an id stay."""
    gone = components(spark, docs, near, id_col, text_col).where("id <> component").select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, docs[f"`{id_col}`"] == gone["__gone"], "left_anti")


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at a similarity of 0.85."""
    out = components(spark, table(spark, sf_dir, "documents"), Near(num=17, den=20))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
