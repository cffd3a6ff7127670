"""k-cores of the whole graph, against peeling one node at a time."""

from graphloom.operators import centrality
from graphloom.plans import catalog
from graphloom.sources.fixture import links


def peeled(pairs):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    rest, out, k = {n: len(m) for n, m in near.items()}, {}, 0
    while rest:
        node = min(rest, key=rest.get)
        k = max(k, rest.pop(node))
        out[node] = k
        for m in near[node]:
            if m in rest:
                rest[m] -= 1
    return out


def test_kcore_over_edges_of_all_kinds(spark, sf):
    want = peeled({(r["src"], r["dst"]) for r in links(spark, sf).select("src", "dst").distinct().collect()})
    got = {r["id"]: r["k"] for r in catalog.queries()["kcore"](spark, sf).collect()}
    assert got == want and {i.split("/")[0] for i in got} == {"customer", "order", "part", "supplier", "nation", "region"}


def test_kcore_falls_far(spark):
    """A chain of triangles on a hub, repeats, both directions and loops."""
    pairs = [("hub", f"n{i}") for i in range(40)] + [(f"n{i}", f"n{i + 1}") for i in range(30)] + [(f"n{i + 1}", f"n{i}") for i in range(10)] + [("n0", "n0"), ("x", "y"), ("y", "z")]
    got = {r["id"]: r["k"] for r in centrality.kcore(spark, spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got == peeled(pairs)
