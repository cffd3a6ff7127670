"""Regular expressions over stored postings against a scan."""

import os
import random
import re
import shutil

import pytest

from graphloom.operators import textsearch


def test_what_expressions_need():
    def need(p):
        return sorted(sorted(x) for x in textsearch.needs(p))

    assert need("abcd") == [["abc", "bcd"]] and need("(?i)ABC") == [["abc"]] and need("^abc$") == [["abc"]]
    assert need("(abc|xyz)q") == [["abc"], ["xyz"]] and need("foo(bar)+baz?") == [["bar", "foo"]]
    assert need("ab.cd") == need("a|bcd|") == need("(abc)?") == need("[abc]def*") == need("(unclosed") == need(r"\p{L}abc") == need("(?iu)kelvin") == [[]]
    assert need("[abc]defg*") == [["def"]] and need("naïve") == [[]] and len(need("(abc|bcd|cde|def|efg)(fgh|ghi|hij|ijk|jkl)")) == 5


PATTERNS = [r"err(or|no)\b", r"(?i)WARN.*disk", r"fail(ed|ure) to (read|write)", r"a.c", r"x{3,}", r"^open", r"(disk|read)+ ?(full|only)", r"not there at all", r"\p{Lu}{2}", r"é+rror", r"(?!disk)di.k"]


def test_search_against_a_scan(spark, tmp_path):
    rng = random.Random(3)
    words = "error errno Warning WARN disk full read only failed failure to write open abc xxx aéc érror XY".split()

    def text():
        return "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(5)))

    docs = {i: text() for i in range(120)} | {120: None, 121: "", 122: "ab"}
    index = str(tmp_path / "index")
    textsearch.add(spark, index, spark.createDataFrame(list(docs.items()), "id long, text string"))
    changed = {i: text() for i in range(0, 120, 7)} | {5: None, 200: "brand new error\nabc"}
    docs |= changed
    textsearch.add(spark, index, spark.createDataFrame(list(changed.items()), "id long, text string"))
    frame = spark.createDataFrame(list(docs.items()), "id long, text string")
    for p in PATTERNS:
        like = re.compile(p.replace(r"\p{Lu}", "[A-Z]"), re.A)
        want = {(i, k, line) for i, t in docs.items() for k, line in enumerate((t or "").split("\n"), 1) if t is not None and like.search(line)}
        assert {tuple(r) for r in textsearch.search(spark, index, frame, p).collect()} == want, p
    first = [(r["id"], r["line"]) for r in textsearch.search(spark, index, frame, "error", limit=3).collect()]
    assert first == sorted((i, k) for i, t in docs.items() for k, line in enumerate((t or "").split("\n"), 1) if "error" in line)[:3]
    assert 5 not in {r["id"] for r in textsearch.candidates(spark, index, "disk").collect()}  # replaced by nothing


def test_only_asked_parts_are_read(spark, tmp_path):
    index = str(tmp_path / "index")
    docs = spark.createDataFrame([(1, "some words to find"), (2, "other ones")], "doc string, body string")
    textsearch.add(spark, index, docs, "doc", "body")
    asked = {r["p"] for r in spark.createDataFrame([("wor",), ("ord",), ("rds",)], "g string").select(textsearch.part_of(textsearch.F.col("g")).alias("p")).collect()}
    batch = f"{index}/postings/batch=0"
    for name in os.listdir(batch):
        if name.startswith("part=") and int(name.removeprefix("part=")) not in asked:
            shutil.rmtree(f"{batch}/{name}")
    assert [r["id"] for r in textsearch.search(spark, index, docs, "words", "doc", "body").collect()] == ["1"]


@pytest.mark.parametrize("limit", [None, 0])
def test_search_without_documents(spark, tmp_path, limit):
    none = spark.createDataFrame([], "id long, text string")
    textsearch.add(spark, str(tmp_path / "i"), none)
    assert textsearch.search(spark, None, none, "abc", limit=limit).count() == 0


def test_postings_by_block(spark, tmp_path, monkeypatch):
    """A gram has one row for each block that holds it, and all its documents there; blocks are cut anywhere between texts."""
    import pyarrow as pa

    from graphloom.operators.search import grams

    rng = random.Random(9)
    letters = "abc é\U0001f600\n\x00中"
    docs = [(f"d{i}", None if i % 17 == 3 else "".join(rng.choice(letters) for _ in range(rng.randrange(30)))) for i in range(80)]
    want = {(g, i) for i, t in docs for g in grams(t)}
    whole = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs], pa.string())], ["id", "text"])
    for chars in (1, 50, 1 << 20):
        out = [r for b in textsearch.blocks((whole.slice(0, 40), whole.slice(40)), chars) for r in b.to_pylist()]
        assert sorted((r["gram"], i) for r in out for i in r["ids"]) == sorted(want), chars
    same = spark.createDataFrame([(i, "the very same text") for i in range(200)], "id long, text string").coalesce(1)
    textsearch.add(spark, str(tmp_path / "i"), same)
    rows = spark.read.parquet(str(tmp_path / "i/postings"))
    assert rows.count() == len(grams("the very same text")) and rows.selectExpr("min(size(ids))").first()[0] == 200
    assert textsearch.candidates(spark, str(tmp_path / "i"), "very same").count() == 200
