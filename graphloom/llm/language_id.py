"""Language identification by rank-order profiles of n-grams.

A profile is a language's PROFILE most frequent n-grams (n from 1 to 3, letters only,
words padded by a space) in order of frequency. A document's own most frequent n-grams,
counted over its whole text, are compared with each profile: an n-gram adds the distance
between its two ranks, or PROFILE if the profile lacks it; the language with the least
sum wins, ties going to the smaller name.

Profiles are learnt from at most about TRAIN documents a language, those with the
smallest hashes, so what is learnt from is bounded and reruns agree. Counting is
combined in each task and summed by n-gram; only the finished profiles, PROFILE rows a
language, reach the driver and are shipped to the workers.

Defined cases: a null text, or one without letters, is `und` with score 0; a null id is
neither held out nor learnt from; without any labelled document everything is `und`;
texts longer than CHUNK characters are counted in pieces that end between words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.llm.common import field, give_back, table, unpack, whole_row

PROFILE = 300
#: Bound on the documents that a language is learnt from, met in expectation.
TRAIN = 8_000
#: Characters counted at once.
CHUNK = 400_000
#: Languages that profiles are made for at most; more is an error, never a silent cut.
MOST_LANGUAGES = 2_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def chunks(texts: list[str | None]):
    """Lists of (document, text) of about CHUNK characters; long texts are cut between words."""
    held, size = [], 0
    for i, text in enumerate(texts):
        text = (text or "").lower()
        at = 0
        while at < len(text):
            end = at + CHUNK
            if end < len(text):
                while end < len(text) and text[end].isalpha():
                    end += 1
            piece = text[at:end]
            at = end
            held.append((i, piece))
            size += len(piece) + 2
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def count(held) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, times): an n-gram packs up to three code points, 21 bits each."""
    owner = [i for i, _ in held]
    joined = " ".join(t for _, t in held)
    codes = np.frombuffer(f" {joined} ".encode("utf-32-le"), dtype=np.uint32)
    lengths = np.fromiter((len(t) + 1 for _, t in held), dtype=np.int64, count=len(held))
    doc = np.repeat(np.arange(len(held)), lengths)
    doc = np.concatenate((doc[:1], doc, doc[-1:]))[: len(codes)]  # a leading space, and one after each text
    alpha = letters()[codes]
    keep = alpha | np.concatenate(([True], alpha[:-1]))  # letters, and the first separator after one
    codes, alpha, doc = codes[keep], alpha[keep], doc[keep]
    if not alpha.any():
        return (np.zeros(0, np.int64),) * 3
    present = np.zeros(0x110000, dtype=bool)
    present[codes[alpha]] = True
    alphabet = np.flatnonzero(present)
    place = np.zeros(0x110000, dtype=np.int64)
    place[alphabet] = np.arange(2, len(alphabet) + 2)
    size = np.int64(len(alphabet) + 2)
    symbol = np.where(alpha, place[codes], 1)  # 0: none, 1: a word's edge
    one = alpha
    two = alpha[:-1] | alpha[1:]
    three = alpha[1:-1]
    at2 = np.where(alpha[:-1], doc[:-1], doc[1:])
    keys = np.concatenate((
        ((doc[one] * size + symbol[one]) * size) * size,
        ((at2[two] * size + symbol[:-1][two]) * size + symbol[1:][two]) * size,
        ((doc[1:-1][three] * size + symbol[:-2][three]) * size + symbol[1:-1][three]) * size + symbol[2:][three],
    ))
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    times = np.diff(np.concatenate((first, [len(keys)])))
    keys = keys[first]
    points = np.concatenate(([0, 32], alphabet)).astype(np.int64)
    keys, c = np.divmod(keys, size)
    keys, b = np.divmod(keys, size)
    d, a = np.divmod(keys, size)
    return np.asarray(owner, dtype=np.int64)[d], points[a] << 42 | points[b] << 21 | points[c], times


def counted(texts: list[str | None]):
    """(document, n-gram, times) of all texts, in one or several parts; a document's n-grams come together."""
    parts = []
    for held in chunks(texts):
        got = count(held)
        if not len(got[0]):
            continue  # a document's earlier part waits for what comes after a stretch without letters
        if parts and parts[-1][0][-1] == got[0][0]:
            parts[-1] = tuple(map(np.concatenate, zip(parts[-1], got)))
            d, g, n = parts[-1]
            order = np.lexsort((g, d))
            d, g, n = d[order], g[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (g[1:] != g[:-1]))))
            parts[-1] = d[first], g[first], np.add.reduceat(n, first)
        else:
            yield from parts
            parts = [got]
    yield from parts


def ranked(d: np.ndarray, g: np.ndarray, n: np.ndarray, most: int):
    """(document, n-gram, rank) of each document's `most` most frequent n-grams, ties by n-gram."""
    if not len(d):
        return d, g, n
    order = np.argsort((d - d.min()) << 32 | (np.int64(0xFFFFFFFF) - np.minimum(n, 0xFFFFFFFF)), kind="stable")
    d, g = d[order], g[order]
    first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
    rank = np.arange(len(d)) - np.repeat(first, np.diff(np.concatenate((first, [len(d)]))))
    top = rank < most
    return d[top], g[top], rank[top]


class Profiles:
    """Ranks of every profiled n-gram in each language."""

    def __init__(self, ranks: dict[str, list[int]], most: int = PROFILE):
        self.languages, self.most = sorted(ranks), most
        grams = sorted({g for p in ranks.values() for g in p})
        self.grams = np.array(grams, dtype=np.int64)
        self.ranks = np.full((len(grams) + 1, len(self.languages)), -1, dtype=np.int64)
        at = {g: i for i, g in enumerate(grams)}
        for j, language in enumerate(self.languages):
            for r, g in enumerate(ranks[language]):
                self.ranks[at[g], j] = r

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        for part in counted(texts):
            d, g, rank = ranked(*part, self.most)
            if not len(d):
                continue
            at = np.searchsorted(self.grams, g)
            at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != g)] = len(self.grams)
            first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
            sizes = np.diff(np.concatenate((first, [len(d)])))
            away = np.empty((len(first), len(self.languages)), dtype=np.int64)
            for j in range(len(self.languages)):
                known = self.ranks[at, j]
                away[:, j] = np.add.reduceat(np.where(known < 0, self.most, np.abs(known - rank)), first)
            best = away.argmin(axis=1)
            for doc, b, x, size in zip(d[first].tolist(), best.tolist(), away.min(axis=1).tolist(), sizes.tolist()):
                names[doc], scores[doc] = self.languages[b], 1.0 - x / (self.most * size)
        return names, scores


def in_training(id_col):
    return F.crc32(F.encode(id_col.cast("string"), "utf-8")) % 3 != 1


def learn(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train: int = TRAIN, most: int = PROFILE) -> Profiles:
    """Profiles from documents that aren't held out and have a language."""
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{lang_col}`"].alias("lang"), docs[f"`{text_col}`"].alias("text")).where(in_training(F.col("id")) & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Profiles({}, most)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, train / n))]), F.col("lang"))
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

    def tally(batches):
        held: dict[str, list] = {}
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for language in sorted(set(names)):
                for _, g, n in counted([" ".join(t for x, t in zip(names, texts) if x == language and t)]):
                    held.setdefault(language, []).append((g, n))
        for language, parts in held.items():
            g, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(g), pa.string()), pa.array(g), pa.array(n)], ["lang", "gram", "n"])

    totals = drawn.mapInArrow(tally, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by = [F.col("n").desc(), F.col("gram")]
    part = totals.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(16)))
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by))).where(F.col("r") <= most)
    top = part.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "gram"))), 1, most).getField("gram").alias("grams"))
    return Profiles({r["lang"]: list(r["grams"]) for r in top.collect()}, most)


def predict(spark: SparkSession, docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; only the text is looked at."""
    narrow = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                names, scores = profiles.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])
        give_back()

    return narrow.mapInArrow(run, f"id {dict(narrow.dtypes)['id']}, lang_pred string, score double")


def keep_identified(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without those that have no language: null texts and texts without letters."""
    profiles = learn(spark, docs, id_col, text_col, lang_col)
    columns = docs.columns
    rows = whole_row(docs).withColumn("text", field(text_col))
    schema = StructType([rows.schema["row"]])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                names, _ = profiles.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0)], ["row"]).filter(pa.array([n != UNKNOWN for n in names], pa.bool_()))
        give_back()

    return unpack(rows.mapInArrow(run, schema), columns)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(spark, docs, learn(spark, docs))
    held_out = F.coalesce(F.crc32(F.encode(F.col("id").cast("string"), "utf-8")) % 3 == 1, F.lit(False))
    return found.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score")
