"""Byte-level BPE by a hierarchical-bitmap rank queue.

The tokens of a pre-token form a linked list over its bytes. Every adjacent pair that
can merge is put, by the position of its left token, into the bucket of its merge rank;
a bitmap of two levels marks the buckets in use, and find-first-set on both levels gives
the lowest rank. A bucket gives its leftmost position first. Entries whose pair has
changed meanwhile are skipped when they come up, so nothing is searched or deleted and
a pre-token of n bytes costs about n log n, however long it is.

The ranks are read from a file whose name is a parameter and are never stored here.
Defined cases: a null text counts as empty; an empty text has no ids; special tokens'
names are ordinary text; lone surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import give_back, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens whose ids a worker keeps before it starts afresh.
KEPT = 200_000
HASH = np.int64(0x1E3779B97F4A7C15)
#: For texts of these characters alone, the pattern can be spelt without Unicode classes.
PLAIN = re.compile(r"[^\t-\r -~À-ÖØ-öø-ž]")
PLAIN_PATTERN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-zÀ-ÖØ-öø-ž]+| ?[0-9]+| ?[^\s0-9A-Za-zÀ-ÖØ-öø-ž]+|\s+(?!\S)|\s+")


class RankQueueBPE:
    """Encoder and decoder for one vocabulary of byte strings and ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = KEPT):
        self.ranks, self.kept = ranks, kept
        self.bytes = {i: b for b, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.width = (max(self.bytes, default=0) + 2).bit_length()
        pairs = self.pairs = {}
        for whole, rank in ranks.items():
            for cut in range(1, len(whole)):
                a, b = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if a is not None and b is not None:
                    pairs[a << self.width | b] = rank
        self.find = regex.compile(pattern).findall
        self.plain = pattern == public_tokenizers.PATTERN
        self.ids: list[tuple[int, ...]] = []
        self.index, self.kept_chars = Numbered(), 0
        size = 1 << (4 * len(pairs) + 64).bit_length()
        self.mask, self.none = size - 1, (1 << self.width) - 1
        self.slots, self.values = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        waiting = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        ranked = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))
        slot = (waiting * HASH >> 40) & self.mask
        while len(waiting):
            free = self.slots[slot] == -1
            self.slots[slot[free]] = waiting[free]
            took = self.slots[slot] == waiting
            self.values[slot[took]] = ranked[took]
            waiting, ranked, slot = waiting[~took], ranked[~took], (slot[~took] + 1) & self.mask

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        n = len(piece)
        single, pairs, width = self.single, self.pairs, self.width
        token = [single[b] for b in piece]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets: dict[int, list[int]] = {}
        low: dict[int, int] = {}
        top = 0
        for at in range(n - 1):
            rank = pairs.get(token[at] << width | token[at + 1])
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(at)  # ascending, so a heap already
                else:
                    buckets[rank] = [at]
                    word = rank >> 8
                    low[word] = low.get(word, 0) | 1 << (rank & 255)
                    top |= 1 << word
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = word << 8 | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            at = heappop(bucket)
            if not bucket:
                del buckets[rank]
                bits &= bits - 1
                low[word] = bits
                if not bits:
                    top ^= 1 << word
            here = token[at]
            if here < 0:
                continue
            then = right[at]
            if then >= n or pairs.get(here << width | token[then]) != rank:
                continue
            token[at], token[then] = rank, -1
            after = right[at] = right[then]
            before = left[at]
            if after < n:
                left[after] = at
                new = pairs.get(rank << width | token[after])
                if new is not None:
                    if new in buckets:
                        heappush(buckets[new], at)
                    else:
                        buckets[new] = [at]
                        word = new >> 8
                        low[word] = low.get(word, 0) | 1 << (new & 255)
                        top |= 1 << word
            if before >= 0:
                new = pairs.get(token[before] << width | rank)
                if new is not None:
                    if new in buckets:
                        heappush(buckets[new], before)
                    else:
                        buckets[new] = [before]
                        word = new >> 8
                        low[word] = low.get(word, 0) | 1 << (new & 255)
                        top |= 1 << word
        return [t for t in token if t >= 0]

    def merge_all(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of many pre-tokens through one queue: a bucket's positions, in all of them, merge together.

        Pre-tokens don't touch each other in the linked list, and of neighbouring
        positions in a bucket every other one merges, from the left, so this is what
        merge() does for each. Should a merge ever make a pair of a lower or equal rank,
        order within its pre-token would matter: those go through merge() instead.
        """
        raw = b"".join(pieces)
        n = len(raw)
        starts = np.cumsum([0, *map(len, pieces)])[:-1]
        token = np.append(np.array(self.single, dtype=np.int64)[np.frombuffer(raw, dtype=np.uint8)], self.none)
        right, left = np.arange(1, n + 2), np.arange(-1, n)
        left[starts] = n
        right[starts[1:] - 1] = n
        right[n - 1 : n + 1] = n
        rank_at = self.lookup(token[:n], token[right[:n]])
        order = np.argsort(rank_at, kind="stable")
        order = order[np.searchsorted(rank_at[order], 0) :]
        buckets: dict[int, list[np.ndarray]] = {}
        low: dict[int, int] = {}
        top = 0
        late: list[np.ndarray] = []
        ranks, positions = rank_at[order], order
        rank = -1
        while True:
            if len(ranks):
                cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                for r, part in zip(ranks[np.append(0, cut)].tolist(), np.split(positions, cut) if len(cut) else [positions]):
                    held = buckets.get(r)
                    if held is None:
                        buckets[r] = [part]
                        word = r >> 8
                        low[word] = low.get(word, 0) | 1 << (r & 255)
                        top |= 1 << word
                    else:
                        held.append(part)
            if not top:
                break
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = word << 8 | (bits & -bits).bit_length() - 1
            bits &= bits - 1
            low[word] = bits
            if not bits:
                top ^= 1 << word
            bucket = buckets.pop(rank)
            at = bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))
            at = at[rank_at[at] == rank]  # the others are stale
            ranks = positions = at[:0]
            if not len(at):
                continue
            if len(at) > 1:
                chained = right[at[:-1]] == at[1:]
                if chained.any():
                    begins = np.where(np.append(False, chained), 0, np.arange(len(at)))
                    at = at[(np.arange(len(at)) - np.maximum.accumulate(begins)) % 2 == 0]
            then = right[at]
            after = right[then]
            token[at], token[then], rank_at[then] = rank, -1, -1
            right[at] = after
            left[after] = at
            before = left[at]
            left[n] = n
            inner = before < n
            before = before[inner]
            spots = np.concatenate((at, before))
            found = self.lookup(np.concatenate((token[at], token[before])), np.concatenate((token[after], token[at[inner]])))
            rank_at[spots] = found
            good = found >= 0
            if good.any():
                ranks, positions = found[good], spots[good]
                if ranks.min() <= rank:
                    late.append(positions[ranks <= rank])
                if len(ranks) > 1:
                    order = np.argsort(ranks, kind="stable")
                    ranks, positions = ranks[order], positions[order]
        live = np.flatnonzero(token[:n] >= 0)
        ids = token[live].tolist()
        cuts = np.searchsorted(live, np.append(starts, n)).tolist()
        out = [tuple(ids[a:b]) for a, b in zip(cuts, cuts[1:])]
        if late:
            for i in np.unique(np.searchsorted(starts, np.concatenate(late), side="right") - 1).tolist():
                out[i] = tuple(self.merge(pieces[i]))
        return out

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, -1 where they don't merge: open addressing, linear probing."""
        key = a << self.width | b
        slot = (key * HASH >> 40) & self.mask
        held = self.slots[slot]
        out = np.where(held == key, self.values[slot], -1)
        going = np.flatnonzero((held != key) & (held != -1))
        while len(going):
            slot[going] = (slot[going] + 1) & self.mask
            held = self.slots[slot[going]]
            hit = held == key[going]
            out[going[hit]] = self.values[slot[going[hit]]]
            going = going[~hit & (held != -1)]
        return out

    def pieces(self, text: str) -> list[str]:
        return PLAIN_PATTERN.findall(text) if self.plain and not PLAIN.search(text) else self.find(text)

    def learn(self, new: list[str]) -> list[tuple[int, ...]]:
        """The ids of pre-tokens, which the tokenizer library looks up whole first."""
        raws = [p.encode() for p in new]
        out: list = [self.ranks.get(r) for r in raws]
        rest = [i for i, x in enumerate(out) if x is None]
        many = len(rest) > 4000
        merged = self.merge_all([raws[i] for i in rest]) if many else [tuple(self.merge(raws[i])) for i in rest]
        out = [x if x is None else (x,) for x in out]
        for i, ids in zip(rest, merged):
            out[i] = ids
        return out

    def encode_all(self, texts: list[str | None]) -> tuple[list[array], list[tuple[int, ...]]]:
        """For each text its pre-tokens, numbered; and the ids of each number."""
        if len(self.ids) > self.kept or self.kept_chars > 40 * self.kept:
            self.ids, self.index, self.kept_chars = [], Numbered(), 0
        index, ids = self.index, self.ids
        numbered = [array("i", map(index.__getitem__, self.pieces(t))) if t else array("i") for t in texts]
        new = list(islice(index, len(ids), None))
        if new:
            self.kept_chars += sum(map(len, new))
            ids += self.learn(new)
        return numbered, ids

    def encode(self, text: str) -> list[int]:
        (numbered,), ids = self.encode_all([text])
        return list(chain.from_iterable(map(ids.__getitem__, numbered)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Numbered(dict):
    """Numbers its keys as they are asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


@lru_cache(maxsize=2)
def tokenizer(name: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> RankQueueBPE:
    """One for each worker; name is of a rank file of public_tokenizers, or a path."""
    with open(name if "/" in name else public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return RankQueueBPE(ranks, pattern)


def slices(batches, most: int = 6_000_000):
    """The batches' rows in runs of about `most` bytes of text (column 1): a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of every row's whole text."""
    narrow = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))

    def run(batches):
        bpe = tokenizer(vocabulary)
        for part in slices(batches):
            numbered, ids = bpe.encode_all(part.column(1).to_pylist())
            rows = [list(chain.from_iterable(map(ids.__getitem__, x))) for x in numbered]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.int32()))], ["id", "ids"])
        give_back()

    return narrow.mapInArrow(run, f"id {dict(narrow.dtypes)['id']}, ids array<int>")


def digest_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes the ids, and keeps the digests of both."""
    narrow = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))

    def run(batches):
        bpe = tokenizer(vocabulary)
        names = {i: str(i) for i in bpe.bytes}
        sha = hashlib.sha256
        for part in slices(batches):
            numbered, of = bpe.encode_all(part.column(1).to_pylist())
            counts, of_ids, of_bytes = [], [], []
            for pieces in numbered:
                ids = list(chain.from_iterable(map(of.__getitem__, pieces)))
                counts.append(len(ids))
                of_ids.append(sha(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(sha(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    return narrow.mapInArrow(run, f"id {dict(narrow.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
