"""Operators on tiny graphs with known facts."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import identifiers as ids
from graphloom.operators import centrality, clones, traverse
from graphloom.operators.components import connected_components
from graphloom.streaming import windows


def graph(spark, pairs, kind="calls"):
    return spark.createDataFrame([(a, b, kind, 1.0, 1.0) for a, b in pairs], "src string, dst string, kind string, confidence double, weight double")


def test_call_chain_tiers(spark):
    e = graph(spark, [(f"fn-{i}", f"fn-{i + 1}") for i in range(4)])
    tiers = {r["depth"]: r["ids"] for r in traverse.reach_tiers(spark, e, spark.createDataFrame([("fn-4",)], "id string"), ("calls",)).collect()}
    assert tiers == {1: ["fn-3"], 2: ["fn-2"], 3: ["fn-1"]}


def test_shortest_paths(spark):
    e = graph(spark, [("A", "B"), ("B", "D"), ("A", "C"), ("C", "D"), ("D", "A")])
    got = [r["path"] for r in traverse.shortest_paths(spark, e, "A", "D", 2, 5).collect()]
    assert got == ["A > B > D", "A > C > D"]


def test_kcore_and_scc(spark):
    e = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")])
    assert {r["id"]: r["k"] for r in centrality.kcore(spark, e).collect()} == {"a": 2, "b": 2, "c": 2, "d": 1, "e": 1}
    assert {r["id"]: r["component"] for r in centrality.scc(spark, e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}


def test_pagerank_sums_to_one_with_dangling(spark):
    e = graph(spark, [("a", "b"), ("c", "b")])
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    s = {r["id"]: r["score"] for r in centrality.pagerank(spark, n, e, iterations=5).collect()}
    assert abs(sum(s.values()) - 1) < 1e-9 and s["b"] > s["a"]


def test_components_random(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark, spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in got} and set(got) == {x for a, b in pairs if a != b for x in (a, b)}


def test_components_empty(spark):
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


BODIES = {
    "a": "func Sum(items []int) int { total := 0; for _, item := range items { if item > 10 { total += item } else { total -= 1 } } return total }",
    "b": "func Add(rows []int) int { acc := 5; for _, row := range rows { if row > 99 { acc += row } else { acc -= 7 } } return acc }",
    "c": "class Shop: def open(self, key): while not self.ready(key, 'x'): await self.wait(key); self.log('opened', key); raise Closed(self, key) or None",
}


def test_lexing_and_published_hash():
    assert clones.lex('If (x1 == 0x1F) { "a\\"b" } é') == ["if", "(", "v", "==", "0", ")", "{", "s", "}", "v"]
    assert clones.lex("'open to the end") == ["s"] and clones.lex(None) == []
    assert clones.fnv(()) == 0xCBF29CE484222325
    h = 0xCBF29CE484222325
    for byte in b"if\0v\0":
        h = (h ^ byte) * 0x100000001B3 & (1 << 64) - 1
    assert clones.fnv(("if", "v")) == h


def test_clone_pair(spark):
    df = spark.createDataFrame([*BODIES.items(), ("d", BODIES["a"]), ("e", None), ("f", "too short")], "id string, t string")
    signed = clones.signatures(clones.shingles(df, "id", "t"))
    got = {(r["a"], r["b"]): r["similarity"] for r in clones.pairs(spark, signed).collect()}
    assert got == {("a", "b"): 1.0, ("a", "d"): 1.0}  # renamed variables and numbers change nothing
    params = clones.parameters()
    for r in signed.collect():
        tokens = clones.lex(dict(df.collect())[r["id"]])
        grams = {clones.fnv(g) for g in zip(tokens, tokens[1:], tokens[2:])}
        assert r["sig"] == [min((a * (g % clones.PRIME) + b) % clones.PRIME for g in grams) for a, b in params]


def test_clone_clusters(spark):
    found = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 1.0), ("x", "y", 0.85)], "a string, b string, similarity double")
    got = {tuple(r) for r in clones.clusters(spark, found).collect()}
    assert got == {("a", 3, 0.95), ("x", 2, 0.85)}


def test_boilerplate_goes(spark):
    grams = spark.createDataFrame([(1, 30, 7), (2, 30, 7), (3, 30, 7), (1, 30, 8), (2, 30, 9), (2, 30, 10)], "id long, tokens long, h long")
    got = {tuple(r) for r in clones.without_boilerplate(spark, grams, 2, 2).collect()}
    assert got == {(2, 30, 9), (2, 30, 10)}


def test_identifiers(spark):
    row = spark.range(1).select(
        ids.route(F.lit("https://x.org/users/:id/posts/42?x=1")).alias("route"), ids.package_of(F.lit("a/b/c.go"), 3).alias("package"), ids.directory_of(F.lit("c.go")).alias("root"),
        F.array_join(ids.tokens(F.lit("parseHTTPRequest_v2 x")), " ").alias("tokens"), ids.filename_score(F.lit("src/Main.go"), "mg").alias("fuzzy"), ids.has_prefix(F.lit("a\\bc"), "a/b").alias("prefix"),
    ).first()
    assert tuple(row) == ("/users/{p1}/posts/{p2}", "a/b", "(root)", "parse http request v2", 10, False)


def test_graph_query_rejects(spark):
    e = graph(spark, [("a", "b")])
    with pytest.raises(ValueError):
        traverse.graph_query(spark, e, e, "traverse calls out")


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts").coalesce(1).withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    src = spark.read.parquet(str(tmp_path / "in"))
    q = windows.tumbling(windows.stream(spark, str(tmp_path / "in"), src.schema)).writeStream.format("memory").queryName("tumbled").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("tumbled").collect()))
    assert got == sorted(map(tuple, windows.tumbling(src).collect()))


def test_maintain(spark):
    base = spark.createDataFrame([("f1", 1), ("f2", 2), ("f3", 3)], "file_path string, v int")
    batch = spark.createDataFrame([("f2", 20)], "file_path string, v int")
    gone = spark.createDataFrame([("f3", 0)], "file_path string, v int")
    assert sorted(map(tuple, windows.maintain(base, batch, gone).collect())) == [("f1", 1), ("f2", 20)]


def test_tree_diff_by_content(spark):
    """Every change here leaves the number of distinct users of its path equal."""
    from graphloom.plans import history

    kind = "path string, user_id long, note string"
    a = [("value", 1, "x"), ("value", 2, "y"), ("row", 1, "x"), ("swap", 1, "x"), ("swap", 2, "y"), ("null", 1, None), ("gone", 1, "x"), ("same", 1, "x"), ("same", 2, None), ("twice", 1, "x"), ("twice", 1, "x"), (None, 1, "x")]
    b = [("value", 1, "x"), ("value", 2, "z"), ("row", 1, "x"), ("row", 1, "w"), ("swap", 1, "y"), ("swap", 2, "x"), ("null", 1, ""), ("new", 1, "x"), ("same", 2, None), ("same", 1, "x"), ("twice", 1, "x"), (None, 1, "x")]
    got = {r["path"]: r["state"] for r in history.tree_diff(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind).repartition(3), "path").collect()}
    assert got == {"value": "changed", "row": "changed", "swap": "changed", "null": "changed", "twice": "changed", "gone": "removed", "new": "added", "same": "same", None: "same"}


def test_merkle_content_diff_sees_equal_user_counts(spark, sf):
    """All five types have equal numbers of distinct users in both states here, and about half of the rows in the first."""
    from graphloom.plans import catalog

    assert {r["state"] for r in catalog.queries()["merkle_diff"](spark, sf).collect()} == {"same"}
    assert [r["state"] for r in catalog.queries()["merkle_content_diff"](spark, sf).collect()] == ["changed"] * 5


def test_commerce_centrality_against_plain_loops(spark, sf):
    """The loops over the whole commerce graph; four iterations, as each writes its state."""
    from graphloom.plans import catalog
    from graphloom.sources import fixture

    rank = {"ast_resolved": 1.0, "lsp_resolved": 0.9, "ast_inferred": 0.6, "text_matched": 0.25}
    links = [(r["src"], r["dst"], rank[r["origin"]]) for r in fixture.edges(spark, sf).collect() if r["kind"] in ("calls", "references")]
    all_ids = [r["id"] for r in fixture.nodes(spark, sf).select("id").collect()]
    total = dict.fromkeys(all_ids, 0.0)
    for a, _, w in links:
        total[a] += w
    assert len(all_ids) > 1000 and len({w for *_, w in links}) > 2

    def plain(seeds):
        base = {i: (i in seeds) / len(seeds) for i in all_ids}
        score = base
        for _ in range(4):
            flow = dict.fromkeys(all_ids, 0.0)
            for a, b, w in links:
                flow[b] += score[a] * w / total[a]
            lost = 1 - sum(flow.values())
            score = {i: base[i] * (0.15 + 0.85 * lost) + 0.85 * flow[i] for i in all_ids}
        return score

    found = catalog.queries()
    for name, seeds in (("commerce_pagerank", set(all_ids)), ("commerce_personalized_pagerank", {i for i in all_ids if i.startswith("customer/1") and len(i) == 11})):
        got = {r["id"]: r["score"] for r in found[name](spark, sf, iterations=4).collect()}
        assert got == pytest.approx(plain(seeds), abs=1e-12)

    hub = {a: 1.0 for a, *_ in links}
    for _ in range(4):
        auth, new = {}, dict.fromkeys(hub, 0.0)
        for a, b, w in links:
            auth[b] = auth.get(b, 0.0) + hub[a] * w
        for a, b, w in links:
            new[a] += auth[b] * w
        hub = new
    unit = lambda d: {i: v / sum(x * x for x in d.values()) ** 0.5 for i, v in d.items() if v > 1e-9 * max(d.values())}
    rows = found["commerce_hits"](spark, sf, iterations=4).collect()
    for c, want in (("authority", unit(auth)), ("hub", unit(hub))):
        got = {r["id"]: r[c] for r in rows}
        assert {i: got[i] for i in want} == pytest.approx(want, rel=1e-6)

    got = {r["id"]: r["component"] for r in found["commerce_scc"](spark, sf).collect()}
    assert got == {i: i for a, b, _ in links for i in (a, b)}  # customers, orders, parts, suppliers: no way back


def test_trigram_postings_then_verified(spark):
    from graphloom.operators import search

    rows = [(1, "the abcde fits"), (2, "bcde abcd"), (3, "abc cde"), (4, None), (5, ""), (None, "xabcdex"), (7, "abcd"), (7, "bcde"), (8, "ABCDE"), (9, "é漢😀é漢😀")]
    df = spark.createDataFrame(rows, "id long, t string")
    got = lambda f, literal: sorted((r["id"] for r in f(df, "id", "t", literal).collect()), key=str)
    assert got(search.trigram_candidates, "abcde") == [1, 2, 7, 7, None]
    assert got(search.trigram_search, "abcde") == [1, None]
    assert got(search.trigram_search, "漢😀é") == [9] and got(search.trigram_search, "de") == [1, 2, 3, 7, None] and got(search.trigram_search, "nowhere") == []
    post = {tuple(r) for r in search.trigram_postings(df.where("id < 4"), "id", "t").collect()}
    assert post == {(i, t[k : k + 3]) for i, t in rows[:3] for k in range(len(t) - 2)}


def test_hits_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    weight = {(f"n{a}", f"n{b}"): float(rng.integers(1, 5)) for a in range(8) for b in range(8) if a != b and rng.random() < 0.4}
    got = {r["id"]: (r["authority"], r["hub"]) for r in centrality.hits(spark, spark.createDataFrame([(a, b, w) for (a, b), w in weight.items()], "src string, dst string, weight double"), 60).collect()}
    names = sorted({x for e in weight for x in e})
    m = np.array([[weight.get((a, b), 0.0) for b in names] for a in names])
    _, _, v = np.linalg.svd(m)
    for k, want in ((0, np.abs(v[0])), (1, np.abs(m @ v[0]))):  # the first singular vectors, up to scale
        mine = np.array([got[x][k] for x in names])
        assert np.allclose(mine / np.linalg.norm(mine), want / np.linalg.norm(want), atol=1e-4)
