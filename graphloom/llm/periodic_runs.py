"""Periodic run detection by Main-Lorentz divide and conquer.

A run is a stretch of words that repeats its first `period` words at least `exponent` times
(4 or more) and that neither neighbouring word continues. Words become interned ids. The
ids of a slice of documents lie in one row with marks between documents that equal nothing, and
are halved over and over; all midpoints of one segment length are treated at once.

At a midpoint m a run of period p and exponent 4 or more has two whole periods before it or
behind it. So the Z-function of what follows m, at p, is p or more, or that of what
precedes m, read backwards, is. Z-values are decided in steps: most are 0, 1 or 2, which direct
comparison shows; only where the first words agree they are found by bisection over
prefix hashes. What passes is extended beyond m both ways. Intervals that several midpoints or
periods give are kept once, with their smallest period. Each is then held against the ids
themselves; should one not hold (a hash collision), the slice is done again without hashes.

Each run lies in a segment whose midpoint it crosses, so none is missed. The work is
n log n comparisons; memory is bounded by a slice's size, PIECE bytes or one text.

Defined cases: null, empty and blank texts have no words and no runs; a null id is kept as
null; repeated rows give equal results; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from graphloom.llm.common import give_back, table
from graphloom.llm.ngram_join import mix, powers, runs as slices

#: Least number of periods in a run, and of words.
EXPONENT, SHORTEST = 4, 6
#: Bytes of text that become words at once; words that are written at once.
PIECE = 1 << 20
#: Words compared before hashes are.
FEW = 6
#: Candidates looked at together.
MANY = 1 << 18


class Agreement:
    """How far stretches of a row of ids agree."""

    def __init__(self, s: np.ndarray, longest: int, hashed: bool = True):
        self.s, self.longest, self.hashed = s, max(1, longest), hashed
        if hashed:
            up, self.down = powers(len(s) + 1)
            self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(s.view(np.uint64)) * up[: len(s)])))

    def equal(self, i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
        """Whether `size` words from i on equal those from j on."""
        if not self.hashed:
            return np.array([np.array_equal(self.s[a : a + size], self.s[b : b + size]) for a, b in zip(i, j)], dtype=bool)
        t, d = self.total, self.down
        return (t[i + size] - t[i]) * d[i] == (t[j + size] - t[j]) * d[j]

    def words(self, i: np.ndarray, j: np.ndarray, ahead: bool) -> np.ndarray:
        """The words from i on that equal those from j on, i < j; or, not ahead, those before i and before j."""
        got = np.zeros(len(i), np.int64)
        most = np.minimum(len(self.s) - j if ahead else i, self.longest)
        step = 1 << (self.longest.bit_length() - 1)
        while step and len(i):
            fits = np.flatnonzero(got + step <= most)
            if len(fits):
                a, b = i[fits], j[fits]
                a, b = (a + got[fits], b + got[fits]) if ahead else (a - got[fits] - step, b - got[fits] - step)
                got[fits] += step * self.equal(a, b, step)
            step >>= 1
        return got


def joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of all documents with different marks between them and up to a power of two, where each begins)."""
    starts = np.cumsum([0] + [len(d) + 1 for d in docs])
    size = 1 << max(3, int(starts[-1]).bit_length())
    s = -1 - np.arange(size, dtype=np.int64)
    for at, d in zip(starts, docs):
        s[at : at + len(d)] = d
    return s, starts[:-1]


def crossing(s: np.ndarray, longest: int, exponent: int, shortest: int, hashed: bool) -> np.ndarray:
    """(start, end, period) of the runs, each interval once, with its smallest period."""
    z = Agreement(s, longest, hashed)
    found = [np.zeros((0, 3), np.int64)]
    for k in range(3, len(s).bit_length()):
        size, half = 1 << k, 1 << (k - 1)
        most = min(size, longest) // exponent
        if not most:
            break
        grid = s.reshape(-1, size)
        for ahead in (True, False):
            same = grid[:, half + 1 : half + 1 + most] == grid[:, half : half + 1] if ahead else (grid[:, half - 1 - most : half - 1] == grid[:, half - 1 : half])[:, ::-1]
            node, p = np.nonzero(same)
            for at in range(0, len(node), MANY):
                found.append(extended(s, z, node[at : at + MANY] * size + half, p[at : at + MANY] + 1, ahead, exponent, shortest))
        if len(found) > 1:
            found = [smallest(np.concatenate(found))]
    return smallest(np.concatenate(found))


def extended(s: np.ndarray, z: Agreement, m: np.ndarray, p: np.ndarray, ahead: bool, exponent: int, shortest: int) -> np.ndarray:
    """(start, end, period) of the runs that midpoints m begin (ahead) or end two periods of."""
    for t in range(1, FEW):
        keep = (p <= t) | (np.take(s, m + t if ahead else m - 1 - t, mode="clip") == np.take(s, m + p + t if ahead else m - 1 - p - t, mode="clip"))
        m, p = m[keep], p[keep]
    i, j = (m, m + p) if ahead else (m - p, m)
    value = z.words(i, j, ahead)
    keep = value >= p
    i, j, p, value = i[keep], j[keep], p[keep], value[keep]
    other = z.words(i, j, not ahead)
    start, end = (i - other, j + value) if ahead else (i - value, j + other)
    keep = (end - start >= exponent * p) & (end - start >= shortest)
    return np.stack((start, end, p), axis=1)[keep]


def smallest(found: np.ndarray) -> np.ndarray:
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    return found[np.flatnonzero(np.concatenate(([True], (found[1:, :2] != found[:-1, :2]).any(axis=1)))[: len(found)])]


def runs_of(docs: list[np.ndarray], exponent: int = EXPONENT, shortest: int = SHORTEST, hashed: bool = True) -> list[np.ndarray]:
    """For each document (ids of 0 or more) its runs (start, length, period), by start and then period."""
    if exponent < 4:
        raise ValueError("runs of fewer than four periods can lack two whole ones on either side of a midpoint")
    s, starts = joined(docs)
    longest = max(map(len, docs), default=0)
    found = crossing(s, longest, exponent, shortest, hashed)
    if hashed and not all(np.array_equal(s[a : b - p], s[a + p : b]) for a, b, p in found.tolist()):
        return runs_of(docs, exponent, shortest, hashed=False)
    owner = np.searchsorted(starts, found[:, 0], side="right") - 1
    rows = np.stack((found[:, 0] - starts[owner], found[:, 1] - found[:, 0], found[:, 2]), axis=1) if len(found) else found
    order = np.lexsort((rows[:, 2], rows[:, 0], owner))
    cuts = np.searchsorted(owner[order], np.arange(len(docs) + 1))
    return [rows[order[a:b]] for a, b in zip(cuts, cuts[1:])]


def interned(texts: list[bytes | None]) -> tuple[list[np.ndarray], list[bytes]]:
    """(word ids of each text, the words); long texts are cut between words."""
    vocabulary: dict[bytes, int] = {}
    put, out = vocabulary.setdefault, []
    for text in texts:
        text, at, parts = text or b"", 0, []
        while at < len(text):
            end = min(len(text), at + PIECE)
            while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
                end += 1
            parts.append(np.array([put(w, len(vocabulary)) for w in text[at:end].split()], np.int64))
            at = end
        out.append(parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.int64), *parts]))
    return out, list(vocabulary)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: those in no run after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth)[:n] == 0


def pieces(ids: np.ndarray, words: list[bytes]):
    """The words of ids joined by one space, in pieces."""
    for at in range(0, len(ids), PIECE):
        yield (b" " if at else b"") + b" ".join(map(words.__getitem__, ids[at : at + PIECE].tolist()))


Order = Callable[[str | None, int], np.ndarray | None]


def scanned(docs: DataFrame, id_col: str, text_col: str, emit, fields: str, order: Order | None, exponent: int, shortest: int) -> DataFrame:
    """(id, fields) of every row: emit makes the fields of (ids, words, runs). order, if given, says which original word stands where."""
    narrow = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].cast("binary").alias("text"))
    out = StructType([narrow.schema["id"], *StructType.fromDDL(fields)])
    kinds = to_arrow_schema(StructType(out.fields[1:]))

    def run(batches):
        for part in slices(batches):
            texts, words = interned(part.column(1).to_pylist())
            if order is not None:
                given = [None if i is None else str(i) for i in part.column(0).to_pylist()]
                places = [order(i, len(t)) for i, t in zip(given, texts)]
                texts = [t if at is None else t[at] for t, at in zip(texts, places)]
            rows = [emit(t, words, r) for t, r in zip(texts, runs_of(texts, exponent, shortest))]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows), kinds))], ["id", *kinds.names])
        give_back()

    return narrow.mapInArrow(run, out)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, shortest: int = SHORTEST) -> DataFrame:
    """(id, n_words, runs, collapsed): the runs of each text by start and then period, and the text with each run cut to its first period."""

    def emit(ids, words, runs):
        collapsed = b"".join(pieces(ids[kept_words(len(ids), runs)], words)).decode()
        return len(ids), [dict(zip(("start", "length", "period"), r)) for r in runs.tolist()], collapsed

    return scanned(docs, id_col, text_col, emit, "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string", None, exponent, shortest)


def longest_run(runs: np.ndarray) -> tuple[int | None, int | None, int | None, int | None]:
    """(start, length, period, floor(1000 * length / period)) of the longest run; ties go to the smaller start, then period."""
    if not len(runs):
        return None, None, None, None
    start, length, period = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
    return start, length, period, 1000 * length // period


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: Order | None = None) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each text."""

    def emit(ids, words, runs):
        listed = hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs.tolist()).encode())
        collapsed = hashlib.sha256()
        for piece in pieces(ids[kept_words(len(ids), runs)], words):
            collapsed.update(piece)
        return len(runs), *longest_run(runs), listed.hexdigest(), collapsed.hexdigest()

    return scanned(docs, id_col, text_col, emit, "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string", order, EXPONENT, SHORTEST)


def looped(doc_id: str | None, n: int) -> np.ndarray | None:
    """A tenth of the documents, chosen by id, repeat a stretch of their words from some word on."""
    h = zlib.crc32((doc_id or "").encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((np.arange(a), a + np.arange(n - a) % p))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_runs(table(spark, sf_dir, "documents"), order=looped).withColumnRenamed("id", "doc_id")
