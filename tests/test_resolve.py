"""Binding of names against a plain search of the scopes, the census and what is named only."""

import random

from graphloom.operators import resolve

NODES = "id string, kind string, name string, file_path string, language string, repo_prefix string, owner string"
EDGES = "src string, dst string, kind string, line int, origin string, confidence double"


def plain(nodes, edges):
    """{edge: (id, scope)} by the rules of bind."""
    syms = {n for n in nodes if n[0] is not None}
    files = {n[0]: n[3] for n in syms}
    at = {n[0]: n for n in syms}
    out = {}

    def folder(f):
        return f.rsplit("/", 1)[0] if f and "/" in f else "(root)"

    def look(e, links):
        rest, me = e[1].split("unresolved::", 1)[1], at.get(e[0])
        if me is None:
            return None
        if rest.startswith("import::"):
            hits = {n[0] for n in syms if n[1] == "file" and n[3] == rest[8:] and n[5] == me[5]}
            return (min(hits), "import") if len(hits) == 1 else None
        any_, rest = (True, rest[2:]) if rest.startswith("*.") else (False, rest)
        owner, name = rest.split("::")[-2:] if "::" in rest else ("", rest)
        found = [n for n in syms if n[1] != "file" and n[2] and n[2] == name and n[4:6] == me[4:6] and (bool(n[6]) if any_ else not owner or n[6] == owner)]
        for scope, near in (("file", lambda n: n[3] == me[3]), ("folder", lambda n: folder(n[3]) == folder(me[3])), ("import", lambda n: (me[3], n[3]) in links), ("repo", lambda n: True)):
            hits = {n[0] for n in found if near(n)}
            if hits:
                return (min(hits), scope) if len(hits) == 1 else None
        return None

    def links():
        pairs = [(e[0], out[e][0]) if e in out else (e[0], e[1]) for e in edges if e[2] == "imports"]
        return {(files[a], files[b]) for a, b in pairs if a in files and b in files}

    open_ = [e for e in edges if "unresolved::" in e[1]]
    for mine in ([e for e in open_ if "import::" in e[1]], [e for e in open_ if e[2] == "imports" and "import::" not in e[1]], [e for e in open_ if e[2] != "imports" and "import::" not in e[1]]):
        while True:
            now = links()
            new = {e: hit for e in mine if e not in out and (hit := look(e, now))}
            out |= new
            if not new:
                break
    return out


def frames(spark, nodes, edges):
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame([(*e, "text_matched", 0.1) for e in edges], EDGES)


def test_against_a_plain_search(spark):
    seen = set()
    for seed in (1, 2):
        rnd = random.Random(seed)
        paths = [f"{d}/{f}" for d in ("a", "b", "b/c") for f in "xyz"] + ["top"]
        nodes = [(p, "file", p, p, "go", "r", "") for p in paths]
        nodes += [(f"n{i}", "method", rnd.choice(["get", "set", "run", "f1", "f2", "f3", "f4", "f5", "f6"]), rnd.choice(paths), rnd.choice(["go", "go", "py"]), rnd.choice(["r", "r", "q"]), rnd.choice(["", "T", "U"])) for i in range(45)]
        names = [n[2] for n in nodes[10:]]
        edges = {(f"n{rnd.randrange(45)}", "unresolved::" + rnd.choice(["", "", "T::", "p::U::", "*."]) + rnd.choice(names), rnd.choice(["calls", "calls", "imports"]), i % 7) for i in range(160)}
        edges |= {(f"n{rnd.randrange(45)}", "unresolved::import::" + rnd.choice(paths + ["none"]), "imports", i) for i in range(25)}
        edges |= {("n1", "n2", "calls", 1), (rnd.choice(paths), rnd.choice(paths), "imports", 1)}
        want = plain(nodes, edges)
        n, e = frames(spark, nodes, sorted(edges))
        got = resolve.bind(spark, n, e).cache()
        rows = got.collect()
        assert len(rows) == len(edges)
        assert sorted((r["src"], r["dst"], r["kind"], r["line"], r["scope"] or "") for r in rows) == sorted((x[0], want[x][0] if x in want else x[1], x[2], x[3], want[x][1] if x in want else "") for x in edges)
        assert all((r["origin"], r["confidence"]) == (resolve.SCOPES[r["scope"]] if r["scope"] else ("text_matched", 0.1)) for r in rows)
        seen |= {s for _, s in want.values()}
        again = resolve.bind(spark, n, got.drop("scope")).where("scope is not null").count()
        assert again == 0
    assert seen == set(resolve.SCOPES)


def test_census_and_odd_rows(spark):
    tails = ["", "import::a", "pyrel::.b", "grpc::S", "razor_using::N", "*.f", "T::f", "f"]
    e = spark.createDataFrame([("s", f"unresolved::{t}", "calls", i, "x", 0.1) for i, t in enumerate(tails)] + [("s", "r::unresolved::f", "calls", 9, "x", 0.1), ("s", "known", "calls", 1, "x", 0.1), ("s", None, "calls", 1, "x", 0.1)], EDGES)
    got = {tuple(r) for r in resolve.census(e).collect()}
    assert got == {("calls", c, n, 9, 8) for c, n in (("empty", 1), ("import", 1), ("relative_import", 1), ("grpc", 1), ("razor_using", 1), ("wildcard_member", 1), ("qualified_symbol", 1), ("bare_symbol", 2))}
    nodes = spark.createDataFrame([("s", "method", "s", None, None, None, None), ("t", "method", "f", "p", None, None, "T"), ("t", "method", "f", "p", None, None, "T"), (None, "method", "f", "p", None, None, None), ("u", "method", None, "p", None, None, None)], NODES)
    rows = {(r["line"], r["dst"], r["scope"]) for r in resolve.bind(spark, nodes.withColumn("n", nodes.name), e.withColumn("owner", e.src)).collect()}
    assert {r for r in rows if r[2]} == {(5, "t", "repo"), (6, "t", "repo"), (7, "t", "repo"), (9, "t", "repo")} and (1, None, None) in rows and (0, "unresolved::", None) in rows
    assert {tuple(r) for r in resolve.name_only(nodes, e).collect()} == {("t", 0, 4)}
    none = spark.createDataFrame([], EDGES)
    assert resolve.bind(spark, nodes, none).count() == resolve.census(none).count() == resolve.name_only(nodes, none).count() == 0


def test_sites_read_the_lines_once_and_steps_read_stored_edges(spark, sf, monkeypatch):
    from graphloom.plans import resolution

    nodes, edges = resolution.sites(spark, sf)
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("l_returnflag") and edges._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    stored, save = [], resolve.save
    monkeypatch.setattr(resolve, "save", lambda s, df, label, *a: stored.append((label, df._jdf.queryExecution().optimizedPlan().toString().count("lineitem"), "Window [" in df._jdf.queryExecution().optimizedPlan().toString())) or save(s, df, label, *a))
    assert resolve.name_only(nodes, resolve.bind(spark, nodes, edges)).count() > 0
    assert [label for label, _, lines in stored if lines] == ["resolve-edges"]
