"""Refined communities and their upkeep against invariants, processes and nearest walks against plain loops."""

import random
from itertools import combinations

import pytest

from graphloom.operators import community, leiden, processes, traverse
from graphloom.sources import storage


def frame(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")


def clique(prefix, n):
    return list(combinations([f"{prefix}{i}" for i in range(n)], 2))


def connected(members, pairs):
    todo, seen = [next(iter(members))], set()
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += [b if a == v else a for a, b in pairs if v in (a, b) and {a, b} <= members]
    return seen == members


def groups(part):
    out = {}
    for i, c in part.items():
        out.setdefault(c, set()).add(i)
    return out


def as_dict(df):
    return {r["id"]: r["community"] for r in df.collect()}


def score(spark, pairs, part):
    return community.modularity(community.undirected(frame(spark, pairs)), spark.createDataFrame(list(part.items()), "id string, c string"))


def noisy(seed):
    rng = random.Random(seed)
    return [(f"n{a:02}", f"n{b:02}") for a, b in combinations(range(40), 2) if rng.random() < (0.5 if a // 10 == b // 10 else 0.04)]


GRAPHS = {
    "cliques": clique("a", 6) + clique("b", 6) + [("a0", "b0")],
    "ring": [p for k in range(6) for p in clique(f"k{k}-", 4)] + [(f"k{k}-0", f"k{(k + 1) % 6}-1") for k in range(6)],
    "noisy": noisy(3),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_connected_and_not_below_louvain(spark, name):
    pairs = GRAPHS[name]
    part = as_dict(leiden.leiden(spark, frame(spark, pairs)))
    assert set(part) == {x for p in pairs for x in p}
    assert all(c == min(m) and connected(m, pairs) for c, m in groups(part).items())
    plain = as_dict(community.louvain(spark, frame(spark, pairs)))
    assert score(spark, pairs, part) >= score(spark, pairs, plain) - 1e-9


def test_refinement_parts_a_community_without_links_inside(spark):
    pairs = clique("a", 3) + clique("b", 3) + [("a0", "z"), ("b0", "z")]
    links = storage.save(spark, community.undirected(frame(spark, pairs)), "t")
    degree = storage.save(spark, links.groupBy(links.a.alias("id")).agg({"w": "sum"}).toDF("id", "k"), "t")
    part = spark.createDataFrame([(f"{x}{i}", "one") for x in "ab" for i in range(3)] + [("z", "two")], "id string, c string")
    got = {r["id"]: r["r"] for r in leiden._refine(spark, links, degree, part, None, 2.0 * len(pairs), 1.0).collect()}
    assert sorted(map(sorted, groups(got).values())) == [["a0", "a1", "a2"], ["b0", "b1", "b2"], ["z"]]


def test_no_edges(spark):
    assert leiden.leiden(spark, frame(spark, [])).count() == 0


def clustered(clusters=5, size=6, grow=()):
    """Rings with chords, a package each, one link to the next; packages in `grow` have one node more."""
    pairs, nodes = [], []
    for c in range(clusters):
        ids = [f"m{c}-{i}" for i in range(size + (c in grow))]
        nodes += [(i, f"pkg{c}") for i in ids]
        pairs += [(ids[i], ids[(i + d) % len(ids)]) for i in range(len(ids)) for d in (1, 2)]
    return nodes, pairs + [(f"m{c}-0", f"m{c + 1}-0") for c in range(clusters - 1)]


def step(spark, nodes, pairs, *stored):
    return leiden.leiden_incremental(spark, spark.createDataFrame(nodes, "id string, package string"), frame(spark, pairs), *stored)


def test_upkeep(spark, monkeypatch):
    nodes, pairs = clustered()
    part, marks, stats = step(spark, nodes, pairs)
    assert not stats["incremental"] and stats["reason"] == "nothing stored"
    part = storage.save(spark, part, "t")
    before = as_dict(part)
    again, _, stats = step(spark, nodes[::-1], pairs[::-1], part, marks)
    assert stats["incremental"] and stats["changed"] == stats["repartitioned"] == 0 and as_dict(again) == before

    nodes2, pairs2 = clustered(grow={2})
    got, _, stats = step(spark, nodes2, pairs2, part, marks)
    after = as_dict(got)
    assert stats["incremental"] and stats["changed"] == 1 and 0 < stats["repartitioned"] < len(after) == 31
    for a, b in combinations([i for i, p in nodes if p != "pkg2"], 2):
        assert (before[a] == before[b]) == (after[a] == after[b])
    assert all(connected(m, pairs2) for m in groups(after).values())

    monkeypatch.setattr(leiden, "leiden", lambda *a: "all again")
    other = [(i.replace("m", "x"), p.replace("pkg", "svc")) for i, p in nodes], [(a.replace("m", "x"), b.replace("m", "x")) for a, b in pairs]
    for graph in (clustered(grow={0, 1, 2, 3}), other):
        found, _, stats = step(spark, *graph, part, marks)
        assert found == "all again" and not stats["incremental"] and stats["reason"] == "too much has changed"


def test_upkeep_splits_what_a_removed_node_held_together(spark):
    pairs = clique("a", 4) + clique("b", 4) + [(f"{x}{i}", "h") for x in "ab" for i in range(4)] + clique("c", 5) + [("c0", "a0")]
    nodes = [(i, i[0]) for i in {x for p in pairs for x in p}]
    part = spark.createDataFrame([(i, "c0" if p == "c" else "a0") for i, p in nodes], "id string, community string")
    marks = leiden.fingerprints(spark.createDataFrame(nodes, "id string, package string"), frame(spark, [p if "h" not in p else p[::-1] for p in pairs]))
    left = [p for p in pairs if "h" not in p]
    got, _, stats = step(spark, [n for n in nodes if n[0] != "h"], left, part, marks)
    assert stats["incremental"] and sorted(map(len, groups(as_dict(got)).values())) == [4, 4, 5]


def plain_processes(entries, pairs, most, depth, steps, total):
    """One recursive walk after another, as the definition reads."""
    out, used, children = [], 0, {}
    for a, b in sorted(set(pairs)):
        children.setdefault(a, []).append(b)
    for k, (entry, s) in enumerate(sorted(entries, key=lambda e: (-e[1], e[0]))[:most]):
        if total - used < 2:
            break
        way, seen = [], set()

        def visit(v, d):
            if v in seen or d > depth:
                return
            seen.add(v)
            way.append((v, d))
            for w in children.get(v, []):
                visit(w, d + 1)

        visit(entry, 0)
        if len(way) < 2:
            continue
        cap = min(steps, total - used)
        out += [(k, entry, s, n + 1, v, d, len(way) > cap) for n, (v, d) in enumerate(way[:cap])]
        used += min(len(way), cap)
    return out


@pytest.mark.parametrize("seed, depth, steps, total", [(1, 15, 50, 500), (2, 2, 50, 500), (3, 3, 5, 500), (4, 4, 7, 18)])
def test_processes_equal_plain_walks(spark, seed, depth, steps, total):
    rng = random.Random(seed)
    ids = [f"f{i}" for i in range(14)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(30)] + [("lone", "lone"), (None, "f1")]
    entries = [(i, float(rng.randint(1, 3))) for i in ids[:5]] + [("lone", 2.0)]
    got = processes.processes(spark, spark.createDataFrame(entries, "id string, score double"), frame(spark, pairs), 5, depth, steps, total)
    want = plain_processes(entries, [p for p in pairs if None not in p], 5, depth, steps, total)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and want


def test_processes_of_nothing(spark):
    none = spark.createDataFrame([], "id string, score double")
    assert processes.processes(spark, none, frame(spark, [("a", "b")])).count() == 0


def walked(spark, pairs, seeds, ids=None, **more):
    edges = spark.createDataFrame([(a, b, "calls") for a, b in pairs], "src string, dst string, kind string")
    nodes = spark.createDataFrame([(i,) for i in ids or sorted({x for p in pairs for x in p})], "id string")
    near, links, stats = traverse.nearest(spark, nodes, edges, spark.createDataFrame([(s,) for s in seeds], "id string"), **more)
    return {r["id"]: r["distance"] for r in near.collect()}, {(r["src"], r["dst"]) for r in links.collect()}, stats


WEB = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("c", "b"), ("x", "d"), ("d", "unresolved::q"), ("d", "e"), ("e", "f")]


def test_nearest_of_several_seeds_with_cross_edges(spark):
    near, links, stats = walked(spark, WEB, ["a", "x", "nowhere", "external::y"])
    assert near == {"a": 0, "x": 0, "b": 1, "c": 1, "d": 1, "e": 2, "f": 3}
    assert links == set(WEB) - {("d", "unresolved::q")} and stats == {"nodes": 7, "truncated": False, "depth": 3}


def test_nearest_keeps_to_caps_scope_and_community(spark):
    near, links, stats = walked(spark, WEB, ["a"], most=3)
    assert near == {"a": 0, "b": 1, "c": 1} and stats["truncated"] and ("b", "d") in links and ("d", "e") not in links
    assert walked(spark, WEB, ["a"], most=2)[0] == {"a": 0, "b": 1}
    assert walked(spark, WEB, ["a"], ids=list("abcef"))[0] == {"a": 0, "b": 1, "c": 1}
    assert walked(spark, WEB, ["e"], direction="in")[0] == {"e": 0, "d": 1, "b": 2, "c": 2, "x": 2, "a": 3}
    assert walked(spark, WEB, ["f"], direction="both", depth=1)[0] == {"f": 0, "e": 1}
    part = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "id string, community string")
    near, links, _ = walked(spark, WEB, ["a"], part=part, community="1")
    assert "b" not in near and near["d"] == 2 and ("a", "b") not in links


def test_nodes_for_tokens():
    assert [traverse.nodes_for(t) for t in (0, 7, 8, 15, 16, 400)] == [0, 0, 1, 1, 2, 50]
    assert all(n * 280 // 35 <= t < (n + 1) * 280 // 35 for t in range(100) for n in [traverse.nodes_for(t)])
