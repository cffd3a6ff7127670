"""The budget counts names."""


def test_walk_budgeted_counts_names(spark, sf):
    from graphloom.plans import catalog
    from graphloom.sources.fixture import nodes

    name = {r["id"]: r["name"] for r in nodes(spark, sf).select("id", "name").collect()}
    rows = sorted((r["tokens"], r["id"]) for r in catalog.queries()["walk_budgeted"](spark, sf).collect())
    assert len(rows) > 5
    for (was, _), (now, i) in zip([(0, None), *rows], rows):
        assert now - was == (len(i) + len(name[i]) + 28) * 10 // 35
