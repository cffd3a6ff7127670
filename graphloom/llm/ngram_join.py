"""N-gram Jaccard join by parity sketches.

A document is the set of 64-bit hashes of its word n-grams. Documents link when the Jaccard
similarity of their sets is at least num/den; classes are the connected components. All
tests, the last one included, are made on those hashes, never on the words themselves.

Sketches. In the band of its size (a factor of 1.3 wide) a set has S words: each n-gram picks a
word by its hash and flips bits of it. In the parity sketch an n-gram flips one bit of its
word, so the Hamming distance of two sketches is at most the size of the sets' symmetric
difference, which for linked sets of a band is at most d. In the join key an n-gram flips
all bits of its hash, so that words of different n-grams differ. S is d plus a spare, so two linked
sets agree in `spare` words at least (pigeonhole). Words without n-grams are never sent: a set
with e of them shares spare - e sent words with each partner, which is what it `needs`. Where
that is none, two such sets could agree in empty words alone; then both also send the
n-grams of their prefixes (the smallest hashes), of which linked sets share one.
Sets too small to link with anything but an equal set send nothing. Equal sets meet by a digest.

Candidates. Words that one set alone has go in the one shuffle of all words. Of what is left, a
document stays only if it shares as many words as it needs, a bucket only if two documents
stay in it, and of buckets with equal members one. Documents that stay get their sketches and
their sets stored, once.

Pairs. Each document is first held against the centre (smallest id) that it shares most words
with. Then only buckets that hold more than one component are looked at, in rounds: their pairs
across components are compared by a small sketch within the bucket, and of those that pass each
component sends its nearest; a wider sketch and then the full sets decide. What links
merges components, so that most other pairs need no look. Only buckets that held pairs back
come again, with more for each component, until none holds any back: no link is lost.

Defined cases: a document with fewer words than n is its whole sequence as one n-gram; without
words or text, its set is empty and links with nothing; ids may be of any type that has an order;
a null id is in no component (null); rows that share an id are one node; ties and repeated
rows need no care; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import stars
from graphloom.llm.common import give_back, table
from graphloom.llm.exact_dedup import heavy_winners
from graphloom.sources.storage import reclaim, save

#: Bytes of text hashed at once.
PIECE = 1 << 20
#: Buckets larger than this are compared in parts.
PART = 4096
#: Pairs that a component sends from a bucket in the first round, and how many times as many in each next one.
REACH, FURTHER = 4, 16
#: Pairs that a bucket's task holds before it sorts out the nearest.
HELD = 1 << 20
#: Bits of a parity word: of the sketch compared inside buckets, and of the one compared pair by pair.
COARSE, FINE = 8, 32
P = 0x9E3779B97F4A7C15
BASE = np.uint64(P)
INVERSE = np.uint64(pow(P, -1, 1 << 64))
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWERED = np.arange(256, dtype=np.uint64)
LOWERED[65:91] += 32
LOWERED += 1


@dataclass(frozen=True)
class Join:
    """What links: n-grams of `words` words, similarity of num/den."""

    words: int = 3
    num: int = 9
    den: int = 10

    def linked(self, a: int, b: int, both: int) -> bool:
        return a > 0 and b > 0 and self.den * both >= self.num * (a + b - both)

    def difference(self, a, b):
        """The largest symmetric difference of linked sets of sizes a and b."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def bands(self, most: int) -> list[tuple[int, int]]:
        """(first size, last size) of each band up to a size; sets below the first band link with equals only."""
        out, first = [], -(-self.den // (self.den - self.num))
        while first <= most:
            then = max(first + 1, -(-first * 13 // 10))
            out.append((first, then - 1))
            first = then
        return out

    def of(self, size: int) -> list[tuple[int, int]]:
        """(band, words of its sketch, spare) that a set of this size sends to: its own, and those of larger linked sets."""
        return _bands_of(self, size)


@lru_cache(maxsize=20_000)
def _bands_of(join: Join, size: int) -> list[tuple[int, int, int]]:
    found = []
    for k, (lo, hi) in enumerate(join.bands(size * join.den // join.num + 1)):
        if hi >= size and lo * join.num <= size * join.den:
            d = int(join.difference(hi, hi))
            spare = 2 + d // 8
            found.append((k, d + spare, spare))
    return found


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + 4096)
        _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, f)))) for f in (BASE, INVERSE)]
    return _POWERS[0], _POWERS[1]


def hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of each word, A-Z lower-cased: differences of one running polynomial, shifted to the word's start."""
    b = np.frombuffer(raw, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], SPACE[b], [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(b) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(LOWERED[b] * up[: len(b)])))
    return mix((total[ends] - total[starts]) * down[starts] ^ mix((ends - starts).astype(np.uint64))), starts


def word_hashes(texts: list[bytes]):
    """Arrays of word hashes, one for each text; texts are hashed together, long ones in pieces that end between words."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    held, size = [], 0

    def flush():
        raw = b"\n".join(p for _, p in held)
        hashes, places = hash_words(raw)
        offsets = np.cumsum([0] + [len(p) + 1 for _, p in held])
        cuts = np.searchsorted(places, offsets)
        for (i, _), a, b in zip(held, cuts, cuts[1:]):
            out[i].append(hashes[a:b])

    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(len(text), at + PIECE)
            while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
                end += 1
            held.append((i, text[at:end]))
            size += end - at
            at = end
            if size >= PIECE:
                flush()
                held, size = [], 0
    if held:
        flush()
    return [np.concatenate(x) if len(x) != 1 else x[0] if x else np.zeros(0, np.uint64) for x in ([*x] or [np.zeros(0, np.uint64)] for x in out)]


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The sorted set of n-gram hashes."""
    if not len(words):
        return words
    if len(words) < n:
        value = np.full(1, len(words), np.uint64)
        for w in words:
            value = mix(value * BASE + w)
        return value
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total = mix(total * BASE + words[i : len(words) - n + 1 + i])
    return np.unique(total)


def word_of(grams: np.ndarray, size: int) -> np.ndarray:
    """The word that each n-gram picks; ascending, as the n-grams are."""
    return ((grams >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def sketch(grams: np.ndarray, size: int) -> tuple[bytes, bytes]:
    """Parity words, coarse and fine: each n-gram flips one bit of the word that it picks. The coarse one fills whole 64-bit numbers."""
    hits = np.bincount(word_of(grams, size) * FINE + (grams & np.uint64(FINE - 1)).astype(np.int64), minlength=size * FINE)
    fine = np.packbits((hits & 1).astype(np.uint8), bitorder="little")
    coarse = np.zeros(-(-size // 8) * 8, np.uint8)
    coarse[:size] = np.bitwise_xor.reduce(fine.reshape(size, FINE // COARSE), axis=1)
    return coarse.tobytes(), fine.tobytes()


def sent(grams: np.ndarray, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """(bucket keys, how many of its keys a set needs to share): for each word of each of its bands the XOR of its n-grams' hashes; the band in the last byte."""
    keys, needs = [], []
    for band, size, spare in join.of(len(grams)):
        word = word_of(grams, size)
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        key = mix(np.bitwise_xor.reduceat(grams, first) ^ mix(word[first].astype(np.uint64) + np.uint64(band << 32)))
        need = spare - (size - len(first))
        if need < 1:
            prefix = grams[: len(grams) - -(-len(grams) * join.num // join.den) + 1]
            key = np.concatenate((key, mix(prefix ^ mix(np.uint64(1 << 31) + np.uint64(band << 32)))))
        keys.append(key & ~np.uint64(255) | np.uint64(band))
        needs.append(np.full(len(key), max(1, need), np.int32))
    return (np.concatenate(keys).view(np.int64), np.concatenate(needs)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int32))


def sets_of(texts: list[str | None], join: Join) -> list[np.ndarray]:
    return [shingles(w, join.words) for w in word_hashes([(t or "").encode() for t in texts])]


def runs(batches, most: int = 4 << 20):
    """Slices of a few MB of text (column 1)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def scan(docs: DataFrame, join: Join) -> DataFrame:
    """A row (id, need, n, digest) for each document, its key never met twice, and a row (key, id, need) for each word that a set sends.

    Of rows in a slice with equal sets, the first with an id alone sends words; in a document's row, need is 1 if it does.
    """
    names = ["key", "id", "need", "n", "digest"]

    def run(batches):
        at = 0
        for part in runs(batches):
            ns, digests, sends, owners, keys, needs, seen = [], [], [], [], [], [], set()
            for i, (known, grams) in enumerate(zip(part.column(0).is_valid().to_pylist(), sets_of(part.column(1).to_pylist(), join))):
                digest = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
                sends.append(known and len(grams) > 0 and digest not in seen)
                if sends[-1]:
                    seen.add(digest)
                    key, need = sent(grams, join)
                    owners.append(np.full(len(key), i))
                    keys.append(key)
                    needs.append(need)
                ns.append(len(grams))
                digests.append(digest)
            rows = part.num_rows
            own = mix(np.arange(at, at + rows, dtype=np.uint64) ^ np.frombuffer(b"".join(d[:8] for d in digests), np.uint64)).view(np.int64)
            at += rows
            yield pa.RecordBatch.from_arrays([pa.array(own), part.column(0), pa.array(sends, pa.bool_()).cast(pa.int32()), pa.array(ns, pa.int64()), pa.array(digests, pa.binary())], names)
            if keys:
                key = np.concatenate(keys)
                yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0).take(pa.array(np.concatenate(owners))), pa.array(np.concatenate(needs)), pa.nulls(len(key), pa.int64()), pa.nulls(len(key), pa.binary())], names)
        give_back()

    return docs.mapInArrow(run, f"key long, id {dict(docs.dtypes)['id']}, need int, n long, digest binary")


def with_same(rows: DataFrame) -> DataFrame:
    """rows(key, id, ...) of keys that several have, and `same`, which buckets with equal members have in common."""
    bucket, h = Window.partitionBy("key"), F.xxhash64("id")
    rows = rows.withColumn("m", F.count("*").over(bucket)).where("m > 1 or n is not null")
    parts = [F.sum(h.bitwiseAND(F.lit((1 << 31) - 1))).over(bucket), F.sum(F.shiftrightunsigned(h, 33)).over(bucket)]
    return rows.withColumn("same", F.xxhash64("m", *parts)).drop("m")


def settle(rows: DataFrame) -> DataFrame:
    """rows(key, id, need, words, same) without documents that share fewer words than they need, and of equal buckets one."""
    one = rows.repartition("id").groupBy("id", band_of(F.col("key")).alias("band"), "same").agg(F.min("key").alias("key"), F.sum("words").alias("words"), F.min("need").alias("need"))
    own = Window.partitionBy("id", "band")
    return one.withColumn("all", F.sum("words").over(own)).withColumn("least", F.min("need").over(own)).where("all >= least").select("key", "id", "need", "words")


def marked(docs: DataFrame, ids: DataFrame, join: Join) -> DataFrame:
    """(id, n, grams, bands, coarse, fine): sets and sketches of the documents in ids(of)."""

    def run(batches):
        for part in runs(batches):
            ns, grams, bands, coarse, fine = [], [], [], [], []
            for g in sets_of(part.column(1).to_pylist(), join):
                both = [(band, *sketch(g, size)) for band, size, _ in join.of(len(g))]
                ns.append(len(g))
                grams.append(g.tobytes())
                for held, k in ((bands, 0), (coarse, 1), (fine, 2)):
                    held.append([x[k] for x in both])
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (ns, grams, bands, coarse, fine), kinds)], ["id", "n", "grams", "bands", "coarse", "fine"])
        give_back()

    kept = docs.join(ids, F.col("id") == F.col("of"), "left_semi")
    return kept.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, n long, grams binary, bands array<int>, coarse array<binary>, fine array<binary>")


def both_ends(pairs: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
    """pairs(a, b, ...) with the columns of side(id, ...) for either end; on: what must be equal besides the id."""
    for end in ("a", "b"):
        one = side.select(*[F.col(c).alias(f"{c}_{end}") for c in side.columns])
        same = F.col(end) == F.col(f"id_{end}")
        for c in on:
            same = same & (F.col(c) == F.col(f"{c}_{end}"))
        pairs = pairs.join(one, same).drop(f"id_{end}", *[f"{c}_{end}" for c in on])
    return pairs


def picked(pairs: DataFrame, kind: str, test) -> DataFrame:
    """The pairs whose other columns pass the test."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keep = [test(*row.values()) for row in part.select(part.schema.names[2:]).to_pylist()]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, f"a {kind}, b {kind}")


def flat_sketches(marks: DataFrame, kind: str) -> DataFrame:
    """(id, n, band, bits): a row for each band of a set."""
    return marks.select("id", "n", F.explode(F.arrays_zip(F.col("bands").alias("band"), F.col(kind).alias("bits"))).alias("s")).select("id", "n", F.col("s.band").alias("band"), F.col("s.bits").alias("bits"))


def close(pairs: DataFrame, marks: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b, band) whose fine sketches allow a link."""

    def near(a: int, bits_a: bytes, b: int, bits_b: bytes) -> bool:
        if min(a, b) * join.den < max(a, b) * join.num:
            return False
        return int(np.bitwise_count(np.frombuffer(bits_a, np.uint32) ^ np.frombuffer(bits_b, np.uint32)).sum()) <= join.difference(a, b)

    full = both_ends(pairs, flat_sketches(marks, "fine"), ["band"]).select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    return picked(full, dict(pairs.dtypes)["a"], near).distinct()


def verified(pairs: DataFrame, marks: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) whose full sets link."""

    def exact(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        joined = np.concatenate((x, y))
        joined.sort()
        return join.linked(len(x), len(y), int((joined[1:] == joined[:-1]).sum()))

    full = both_ends(pairs, marks.select("id", "grams"), []).select("a", "b", "grams_a", "grams_b")
    return picked(full, dict(pairs.dtypes)["a"], exact)


def linking(spark: SparkSession, pairs: DataFrame, marks: DataFrame, join: Join) -> DataFrame:
    """The linked ones of pairs(a, b, band), stored."""
    near = save(spark, close(pairs, marks, join), "ngram-close")
    links = save(spark, verified(near, marks, join).distinct(), "ngram-links")
    reclaim(spark, near)
    return links


def nearest(found: np.ndarray, reach: int) -> np.ndarray:
    """Of the columns of found (distance, a, b, component of a, of b; each pair once) those among the nearest `reach` of either component."""
    use = np.zeros(found.shape[1], dtype=bool)
    both = np.concatenate((found[3], found[4]))
    order = np.lexsort((np.tile(found[2], 2), np.tile(found[1], 2), np.tile(found[0], 2), both))
    first = np.flatnonzero(np.diff(both[order], prepend=both[order[:1]] - 1))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
    use[order[rank < reach] % len(use)] = True
    return found[:, use]


def numbered(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, the place of each row's value among them), of any type that has an order."""
    whole = pa.types.is_integer(column.type)
    return np.unique(column.to_numpy() if whole else np.array(column.to_pylist(), dtype=object), return_inverse=True)


def by_groups(cols: list[str], emit):
    """Calls emit for each run of equal group columns, however batches cut it."""

    def run(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            held = held.combine_chunks()
            group = np.stack([held.column(c).to_numpy() for c in cols])
            cuts = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts[:-1]], cuts):
                yield from emit(held.slice(a, b - a))
            held = held.slice(int(cuts[-1])) if len(cuts) else held
        if held is not None and held.num_rows:
            yield from emit(held)

    return run


def across(members: DataFrame, labels: DataFrame, marks: DataFrame, join: Join, reach: int) -> DataFrame:
    """(a, b, key, more): near pairs of different components in the buckets of members(key, id) that hold several.

    From each bucket come the nearest `reach` of each component, ties to smaller ids; more says that the bucket held others back.
    """
    kind = dict(members.dtypes)["id"]
    rows = members.join(labels.select("node", "component"), F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    bucket = Window.partitionBy("key")
    rows = rows.withColumn("lo", F.min("c").over(bucket)).withColumn("hi", F.max("c").over(bucket)).where("lo <> hi").withColumn("m", F.count("*").over(bucket))

    def sketched(group: pa.Table):
        n, part = group.column("n").to_numpy(), group.column("part").to_numpy()
        (ids, at), (_, c) = numbered(group.column("id")), numbered(group.column("c"))
        bits = np.frombuffer(b"".join(group.column("bits").to_pylist()), np.uint64).reshape(len(at), -1)
        alone = group.column("pa")[0].as_py() == group.column("pb")[0].as_py()
        outer = np.flatnonzero(c != np.bincount(c).argmax())  # a pair across components has an end outside the largest one
        rank = np.full(len(at), -1)
        rank[outer] = np.arange(len(outer))
        step = max(1, (1 << 21) // max(1, bits.size))
        held, size, more = [], 0, False
        for start in range(0, len(outer), step):
            some = outer[start : start + step]
            far = np.bitwise_count(bits[some, None, :] ^ bits[None, :, :]).sum(axis=2, dtype=np.int64)
            i, j = np.nonzero(far <= join.difference(n[some, None], n[None, :]))
            far, i = far[i, j], some[i]
            use = (c[i] != c[j]) & ((part[i] != part[j]) | alone) & (rank[j] < rank[i])  # each pair once
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
            k, kept = group.column("key")[0].as_py(), found.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(ids[found[1]], group.column("id").type), pa.array(ids[found[2]], group.column("id").type), pa.array(np.full(kept, k)), pa.array(np.full(kept, more))], ["a", "b", "key", "more"])

    parts = F.ceil(F.col("m") / PART)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("key", "id", "c", "part", F.least("part", "other").alias("pa"), F.greatest("part", "other").alias("pb"))
    light = flat_sketches(marks, "coarse").select(F.col("id").alias("of"), "n", "band", "bits")
    rows = rows.join(light, (F.col("id") == F.col("of")) & (band_of(F.col("key")) == F.col("band"))).select("key", "pa", "pb", "id", "c", "part", "n", "bits")
    return rows.repartition("key", "pa", "pb").sortWithinPartitions("key", "pa", "pb").mapInArrow(by_groups(["key", "pa", "pb"], sketched), f"a {kind}, b {kind}, key long, more boolean")


def equal_sets(spark: SparkSession, sets: DataFrame) -> DataFrame:
    """(a, b): of each set that several documents have, one that sends words, and each of the others; frequent sets are settled without a shuffle."""
    rows = sets.where("n > 0 and id is not null").select(F.struct("need", "id").alias("id"), F.lit(0).alias("uid"), "digest")
    heavy = heavy_winners(spark, rows)
    often = rows.join(F.broadcast(heavy), "digest").select(F.col("best.id.id").alias("a"), F.col("id.id").alias("b"))
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(F.max("id").over(Window.partitionBy("digest"))["id"].alias("a"), F.col("id.id").alias("b"))
    return save(spark, often.unionByName(rest).where("a <> b").distinct(), "ngram-equal")


def band_of(key):
    return key.bitwiseAND(F.lit(255)).cast("int")


def components(spark: SparkSession, docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, component) of every row of docs."""
    narrow = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    found = save(spark, with_same(scan(narrow, join)), "ngram-found")
    reclaim(spark)
    sets = found.where("n is not null").select("id", "need", "n", "digest")
    equal = equal_sets(spark, sets)
    words = found.where("n is null").select("key", "id", "need", "same", F.lit(1).cast("long").alias("words"))
    words = words.join(equal.select(F.col("b").alias("of")).distinct(), F.col("id") == F.col("of"), "left_anti")
    bucket = Window.partitionBy("key")
    again = with_same(settle(words).withColumn("n", F.lit(None).cast("long"))).drop("n")
    members = settle(again).withColumn("center", F.min("id").over(bucket)).withColumn("m", F.count("*").over(bucket)).where("m > 1")
    members = save(spark, members.select("key", "id", "words", "center"), "ngram-buckets")
    ids = save(spark, members.select(F.col("id").alias("of")).distinct(), "ngram-ids")  # its size is known, so that a small one spares the texts a shuffle
    marks = save(spark, marked(narrow, ids, join), "ngram-marks")
    reclaim(spark, ids)
    most = members.where("id <> center").groupBy("id", "center", band_of(F.col("key")).alias("band")).agg(F.sum("words").alias("words"))
    nearest_centres = most.groupBy("id").agg(F.max(F.struct("words", "center", "band")).alias("s")).select(F.col("s.center").alias("a"), F.col("id").alias("b"), F.col("s.band").alias("band"))
    links, reach = linking(spark, nearest_centres, marks, join).unionByName(equal), REACH
    labels = stars.components(spark, links)
    left = members.select("key", "id")
    while True:
        reclaim(spark)
        near = save(spark, across(left, labels, marks, join, reach), "ngram-near")
        more = linking(spark, near.select("a", "b", band_of(F.col("key")).alias("band")).distinct(), marks, join)
        if more.limit(1).count():
            old, labels = labels, stars.merged(spark, labels, more)
            reclaim(spark, old)
        held = near.where("more")
        if not held.limit(1).count():
            break
        left, reach = left.join(held.select(F.col("key").alias("again")).distinct(), F.col("key") == F.col("again"), "left_semi"), reach * FURTHER
    return sets.join(labels.select("node", "component"), F.col("id") == F.col("node"), "left").select("id", "n", F.coalesce("component", "id").alias("component"))


def keep_one(spark: SparkSession, docs: DataFrame, join: Join, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the smallest id of each component alone; rows without an id stay."""
    gone = components(spark, docs, join, id_col, text_col).where("id <> component").select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, docs[f"`{id_col}`"] == gone["__gone"], "left_anti")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = components(spark, table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
