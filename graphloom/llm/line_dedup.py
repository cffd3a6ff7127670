"""Substring dedup by hashing lines and the sentences in them.

A unit is a line, cut further after each of `. ! ?`, with the mark or line break that ends
it. It is normalised (lower case, white space collapsed) and hashed; digests are grouped over
all documents, and of equal units the earliest, by document id and then position, stays. A
run of neighbouring units that all repeat earlier ones is removed as one; a caller may ask that
it have `min_words` words in all, of which a short unit's count with its neighbours'. What was
removed is kept as spans of the original text, in code points, end exclusive.

Units are made once and stored. Frequent digests are found by Misra-Gries summaries; their
verified first occurrences, COUNTERS rows at most, are broadcast, and their units settled
on the map side. Only the rest is shuffled by digest, in groups of 2N/(COUNTERS + 1) units at most.

Defined cases: null and empty texts have no units, nor has white space alone (within a
removed run it goes too); null ids rank before all others; rows that share id and text
are one document, rows that share an id alone are not; a removed unit takes its mark or
line break with it; other columns pass through untouched whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import field, table, whole_row
from graphloom.llm.exact_dedup import COUNTERS, misra_gries
from graphloom.sources.storage import save

#: Words that a run of repeats has at least to be removed: every repeat goes.
MIN_WORDS = 1
UNIT = re.compile(r"[^.!?\n]*[.!?\n]|[^.!?\n]+")


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, digest, nth, words, start, stop) of every unit; id and h, a hash of the text, tell documents apart."""
    text = docs[f"`{text_col}`"]
    narrow = docs.select(docs[f"`{id_col}`"].alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    names = ["id", "h", "digest", "nth", "words", "start", "stop"]

    def packed(part, rows, *columns):
        kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        at = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *map(pa.array, columns, kinds)], names)

    def run(batches):
        md5 = hashlib.md5
        for part in batches:
            rows, digests, nths, counts, starts, stops = held = [], [], [], [], [], []
            for i, text in enumerate(part.column(2)):
                nth = 0
                for m in UNIT.finditer(text.as_py() or ""):
                    words = m[0].lower().split()
                    if words:
                        rows.append(i)
                        digests.append(md5(" ".join(words).encode()).digest())
                        nths.append(nth)
                        counts.append(len(words))
                        starts.append(m.start())
                        stops.append(m.end())
                        nth += 1
                if len(rows) >= 20_000:
                    yield packed(part, *held)
                    for column in held:
                        column.clear()
            yield packed(part, *held)

    return narrow.mapInArrow(run, f"id {dict(narrow.dtypes)['id']}, h long, digest binary, nth int, words int, start int, stop int")


def repeats(spark: SparkSession, found: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(id, h, nth, words, start, stop) of the stored units that repeat an earlier one."""
    place, out = F.struct("id", "h", "start"), ["id", "h", "nth", "words", "start", "stop"]
    total = found.count()
    summaries = found.select("digest").mapInArrow(lambda it: misra_gries(it, counters), "digest binary, seen long")
    frequent = summaries.groupBy("digest").agg(F.sum("seen").alias("seen")).where(F.col("seen") > F.lit(total / (counters + 1))).select("digest")
    heavy = save(spark, found.join(F.broadcast(frequent), "digest").groupBy("digest").agg(F.min(place).alias("first")), "line-heavy")
    often = found.join(F.broadcast(heavy), "digest").where(place != F.col("first")).select(out)
    rest = found.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    rest = rest.withColumn("place", F.rank().over(Window.partitionBy("digest").orderBy("id", "h", "start"))).where("place > 1").select(out)
    return often.unionByName(rest).distinct()


def removals(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, counters: int = COUNTERS) -> DataFrame:
    """(id, h, spans, removed, words): the spans of each document's runs of repeats, their code points and words."""
    extra = repeats(spark, save(spark, units(docs, id_col, text_col), "line-units"), counters)
    run = F.col("nth") - F.row_number().over(Window.partitionBy("id", "h").orderBy("nth"))
    runs = extra.withColumn("run", run).groupBy("id", "h", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("words")).where(F.col("words") >= min_words)
    spans = runs.groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")))).alias("spans"), F.sum(F.col("stop") - F.col("start")).alias("removed"), F.sum("words").alias("words"))
    return spans


def dedup_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, counters: int = COUNTERS) -> DataFrame:
    """docs with the repeats cut from their texts, and a column `removed_spans` of original offsets (renamed if taken)."""
    cut = removals(spark, docs, id_col, text_col, min_words, counters).select(F.col("id").alias("of"), F.col("h").alias("of_h"), "spans")
    rows = whole_row(docs).withColumn("at", field(id_col)).withColumn("h", F.xxhash64(field(text_col)))
    joined = rows.join(cut, F.col("at").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_h")), "left")
    text = field(text_col)
    acc = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), lambda a, s: F.struct(s["stop"].alias("at"), F.concat(a["out"], text.substr((a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))).alias("out")))
    kept = F.when(F.col("spans").isNull(), text).otherwise(F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), F.char_length(text))))
    spare = "removed_spans" if "removed_spans" not in {c.lower() for c in docs.columns} else f"removed_spans_{len(docs.columns)}"
    return joined.select(*[kept.alias(c) if c == text_col else field(c).alias(c) for c in docs.columns], F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias(spare))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_chars is the length of what is kept."""
    docs = table(spark, sf_dir, "documents")
    cut = removals(spark, docs).select(F.col("id").alias("of"), F.col("h").alias("of_h"), "spans", "removed", "words")
    length = F.char_length(F.coalesce("text", F.lit(""))).cast("long")
    out = docs.select("doc_id", length.alias("original_chars"), F.xxhash64("text").alias("h")).join(cut, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_h")), "left")
    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    none = F.lit(0).cast("long")
    return out.select("doc_id", (F.col("original_chars") - F.coalesce("removed", none)).alias("n_chars"), "original_chars", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("words", none).alias("removed_words"), F.coalesce(shown, F.lit("")).alias("removed_spans"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^.!?\n]*[.!?\n]|[^.!?\n]+') AS parts FROM documents
), l AS (
  SELECT doc_id, i, unit, coalesce(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT doc_id, unnest(parts) AS unit, generate_subscripts(parts, 1) AS i FROM d)
), n AS (
  SELECT doc_id, i, start, start + length(unit) AS stop, list_filter(regexp_split_to_array(lower(unit), '[\s\x1c-\x1f\x85\xA0]+'), lambda w: w <> '') AS words FROM l
), u AS (
  SELECT doc_id, start, stop, len(words) AS n_words, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS nth, row_number() OVER (PARTITION BY array_to_string(words, ' ') ORDER BY doc_id, start) AS place
  FROM n WHERE len(words) > 0
), x AS (
  SELECT doc_id, min(start) AS start, max(stop) AS stop, sum(n_words) AS n_words
  FROM (SELECT *, nth - row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS run FROM u WHERE place > 1)
  GROUP BY doc_id, run HAVING sum(n_words) >= 1
), s AS (
  SELECT doc_id, count(*) AS n_removed, sum(stop - start) AS cut, sum(n_words) AS n_words, string_agg(CAST(start AS BIGINT) || '-' || CAST(stop AS BIGINT), ',' ORDER BY start) AS spans FROM x GROUP BY doc_id
)
SELECT d.doc_id, CAST(length(coalesce(d.text, '')) - coalesce(s.cut, 0) AS BIGINT) AS n_chars, CAST(length(coalesce(d.text, '')) AS BIGINT) AS original_chars, coalesce(s.n_removed, 0) AS n_removed,
       CAST(coalesce(s.n_words, 0) AS BIGINT) AS removed_words, coalesce(s.spans, '') AS removed_spans
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""
