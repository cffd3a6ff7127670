"""Query classes, substring ranks, path multipliers, diversity and packing."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import rerank


@pytest.mark.parametrize(
    "query, want",
    [("validateToken", "symbol"), ("pkg.Type", "symbol"), ("internal/auth/token.go", "path"), ("func(ctx) error", "signature"), ("map[string]int => T", "signature"), ("how does auth refresh", "concept"), ("", "concept")],
)
def test_query_class(query, want):
    assert rerank.query_class(query) == want


def test_field_query():
    assert rerank.field_query("kind:method Lang:go parse url: http://x") == ({"kind": "method", "lang": "go"}, "parse url: http://x")


def test_substring_ranks(spark):
    names = [("f:1", "Parse"), ("f:2", "ParseAll"), ("f:3", "ReParse"), ("parse:4", "other"), ("f:5", "none"), ("f:6", "Kparse"), ("f:7", None)]
    df = spark.createDataFrame([(i, n, "function", "a") for i, n in names], "id string, name string, kind string, file_path string")
    got = [(r["id"], r["rank"]) for r in rerank.substring_search(df, "parse", 10).collect()]
    assert got == [("f:1", 0), ("f:2", 1), ("f:3", 2), ("f:6", 2), ("parse:4", 3)]
    assert rerank.substring_search(df, "kparse", 10).count() == 0  # a fold that changes the length matches nothing


def test_path_penalty(spark):
    want = {"pkg/a_test.go": 0.3, "tests/examples/x.go": 0.3, "examples/x.go": 0.5, "legacy/x.go": 0.5, "a/b.d.ts": 0.7, "p/__init__.py": 0.7, "src/lib.rs": 0.9, "src/contest.go": 1.0, "": 1.0}
    got = {r["p"]: r["v"] for r in spark.createDataFrame([(p,) for p in want], "p string").select("p", rerank.path_penalty(F.col("p")).alias("v")).collect()}
    assert got == want


def test_definition_bias(spark):
    df = spark.createDataFrame([("FooBar", "a/x.go"), ("other", "a/FooBar.go"), ("foobaz", "a/x.go"), ("zzz", "a/x.go")], "n string, p string")
    got = [r[0] for r in df.select(rerank.definition_bias(F.col("n"), F.col("p"), "FooBar")).collect()]
    assert got == [1.0, 0.6, 0.4, 0.0]
    assert {r[0] for r in df.select(rerank.definition_bias(F.col("n"), F.col("p"), "how foo bar")).collect()} == {0.0}


def test_diversity_equals_plain_reordering(spark):
    files = "aaabacaabb"
    df = spark.createDataFrame([(i, f, float(-i)) for i, f in enumerate(files)], "id long, file_path string, score double")
    got = [r["id"] for r in rerank.diversify(df, [F.col("score").desc()]).orderBy("place").collect()]
    seen, held = {}, []
    for i, f in enumerate(files):
        above = seen[f] = seen.get(f, -1) + 1
        held.append((i + (3 * (above - 1) if above >= 2 else 0), i))
    assert got == [i for _, i in sorted(held)]


@pytest.mark.parametrize("strategy, want", [("top-k", [1, 3, 4]), ("density", [4, 3, 1]), ("file-grouped", [1, 3, 4])])
def test_packing_goes_on_after_a_large_row(spark, strategy, want):
    rows = [("q", 1, "x", 1, 9.0, 5), ("q", 2, "y", 2, 8.0, 9), ("q", 3, "x", 3, 7.0, 3), ("q", 4, "y", 4, 6.0, 0)]
    df = spark.createDataFrame(rows, "q string, id long, file_path string, rank int, score double, tokens int")
    assert [r["id"] for r in rerank.pack(df, "q", strategy, 8).orderBy("place").collect()] == want
    assert rerank.pack(df, "q", strategy, 0).count() == 4
