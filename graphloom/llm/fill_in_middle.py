"""Fill-in-middle transformation over a sparse checkpoint index.

A text is read once, in pieces, to count its units (code points, words or lines). While
counting, the byte and the code-point offset of every STEP-th unit are recorded. A cut at a
unit is found by a binary search of these checkpoints and a short rescan from the one
before it, so that no text is decoded and no offset is kept for each unit.

Which form a text takes and where it is cut is drawn from a digest of its id alone: reruns
and any partitioning agree, and no row moves.

Defined cases: a null text counts as empty; an empty text, or one that contains one of the
sentinels, stays plain; a null id draws as the empty id does; texts of any length are counted
in pieces of PIECE bytes; repeated rows give equal results; other columns, whatever their
names, pass through `rewrite` and are never looked at.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.llm.common import field, give_back, table

#: Units between two checkpoints.
STEP = 1024
#: Bytes of a text that are counted at once.
PIECE = 1 << 20
#: Marks before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Percentages: of texts that are transformed, and of those that come with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
UNITS = ("char", "word", "line")
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def beginnings(b: np.ndarray, before: int | None, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """(where units begin, where code points begin) in bytes that come after the byte `before`; None at the start of a text."""
    points = (b & 0xC0) != 0x80
    if unit == "char" or not len(b):
        return points, points
    last = np.concatenate((np.array([10 if before is None else before], np.uint8), b[:-1]))
    marks = last == 10 if unit == "line" else SPACE[last] & ~SPACE[b]
    if before is None:
        marks[0] = True  # white space before the first word is a unit
    return marks, points


class Checkpoints:
    """The units of a UTF-8 text: their number, and where each begins."""

    def __init__(self, raw: bytes, unit: str = "char", step: int = STEP):
        self.raw, self.unit, self.step = raw, unit, step
        self.numbers, self.bytes, self.points = [0], [0], [0]
        units = points = 0
        for at in range(0, len(raw), PIECE):
            b = np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - at), at)
            marks, leads = beginnings(b, raw[at - 1] if at else None, unit)
            found = np.flatnonzero(marks)
            first = -units % step
            picked = found[first::step]
            if not at:
                first, picked = first + step, picked[1:]  # the first unit has its checkpoint
            if len(picked):
                self.numbers += range(units + first, units + len(found), step)
                self.bytes += (picked + at).tolist()
                before = np.arange(first, len(found), step) if unit == "char" else np.cumsum(leads)[picked] - 1
                self.points += (before + points).tolist()
            units += len(found)
            points += int(np.count_nonzero(leads))
        self.units, self.length = units, points

    def locate(self, unit: int) -> tuple[int, int]:
        """(byte, code point) at which a unit begins; at the count of units, the text's end."""
        if unit >= self.units:
            return len(self.raw), self.length
        k = bisect_right(self.numbers, unit) - 1
        at, end = self.bytes[k], self.bytes[k + 1] if k + 1 < len(self.bytes) else len(self.raw)
        if self.unit == "char":
            end = min(end, at + 4 * (unit - self.numbers[k] + 1))
        b = np.frombuffer(self.raw, np.uint8, end - at, at)
        marks, leads = beginnings(b, self.raw[at - 1] if at else None, self.unit)
        here = int(np.flatnonzero(marks)[unit - self.numbers[k]])
        return at + here, self.points[k] + int(np.count_nonzero(leads[:here]))


def draws(id_: Column, seed: int = 1, n: int = 4) -> list[Column]:
    """n numbers of 32 bits from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def split(raw: bytes, h: list[int], marks: list[bytes], unit: str = "char", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, step: int = STEP):
    """(units, form, bytes of prefix and of middle, code points of prefix and of middle, output)."""
    index = Checkpoints(raw, unit, step)
    n = index.units
    if not n or h[2] % 100 >= rate or any(m in raw for m in marks):
        return n, "plain", None, None, None, None, raw
    (a, pa_), (b, pb) = (index.locate(u) for u in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    p, s, m = marks
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    form, parts = ("spm", (s, suffix, p, prefix, m, middle)) if h[3] % 100 < suffix_first else ("psm", (p, prefix, s, suffix, m, middle))
    return n, form, a, b - a, pa_, pb - pa_, b"".join(parts)


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = 1, sentinels: tuple[str, str, str] = SENTINELS, step: int = STEP, carry: bool = False,
) -> DataFrame:
    """(id, n, form, prefix_bytes, middle_bytes, prefix_chars, middle_chars, output), and with `carry` the whole `row`, of each row of docs.

    n counts units; the spans are null where the form is plain; output is the text as it is to be trained on.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    row = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if carry else []
    narrow = docs.select(docs[f"`{id_col}`"].alias("id"), text.alias("text"), *[h.alias(f"h{k}") for k, h in enumerate(draws(docs[f"`{id_col}`"], seed), 1)], *row)
    marks = [s.encode() for s in sentinels]
    names = ["id", "n", "form", "prefix_bytes", "middle_bytes", "prefix_chars", "middle_chars", "output"] + ["row"] * carry
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.binary()]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).cast(pa.binary())
                drawn = zip(*(part.column(k).to_pylist() for k in range(2, 6)))
                rows = [split(t.as_py(), h, marks, unit, rate, suffix_first, step) for t, h in zip(texts, drawn)]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                columns[-1] = columns[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, *([part.column(6)] if carry else [])], names)
        give_back()

    out = StructType.fromDDL("n long, form string, prefix_bytes long, middle_bytes long, prefix_chars long, middle_chars long, output string")
    return narrow.mapInArrow(run, StructType([narrow.schema["id"], *out, *([narrow.schema["row"]] if carry else [])]))


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with their texts transformed and a column `fim_form` (renamed if taken)."""
    spare = "fim_form" if "fim_form" not in {c.lower() for c in docs.columns} else f"fim_form_{len(docs.columns)}"
    out = transform(docs, id_col, text_col, carry=True, **options)
    return out.select(*[F.col("output").alias(c) if c == text_col else field(c).alias(c) for c in docs.columns], F.col("form").alias(spare))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text that a form's output was made from."""
    p, s, m = map(F.lit, sentinels)

    def parts(first: Column, second: Column) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.char_length(first) + 1, F.char_length(output))
        after = F.split_part(rest, second, F.lit(2))
        return F.split_part(rest, second, F.lit(1)), F.split_part(after, m, F.lit(1)), F.split_part(after, m, F.lit(2))

    prefix, suffix, middle = parts(p, s)
    suffix2, prefix2, middle2 = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP13_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), r AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d
), f AS (
  SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM r
), o AS (
  SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM o
"""
