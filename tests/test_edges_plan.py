"""How the edges of lines are made."""


def test_bfs_and_edges_make_no_sort_of_lines(spark, sf):
    """The edges of lines are aggregated by hash after they are dealt; a sort or a partial aggregate would hold a whole scan."""
    from graphloom.sources.fixture import edges

    plan = edges(spark, sf).where("kind = 'calls'")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("REPARTITION_BY_NUM") >= 1


def test_insert_ignore_deals_edges_once(spark, sf):
    """Edges are dealt before repeats go, so that no task keeps a table of all the edges it makes."""
    from graphloom.plans import catalog

    plan = catalog.queries()["edge_insert_ignore"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(src" in plan and "hashpartitioning(src#" in plan.split("REPARTITION_BY_COL")[0]


def test_walks_from_few_seeds_hold_no_lines(spark, sf, monkeypatch):
    """The walk's steps are scanned rows: no exchange and no table of lines, and no copy of all steps is stored."""
    from graphloom.operators import traverse
    from graphloom.plans import catalog
    from graphloom.sources.fixture import edges, links

    plan = links(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    assert not links(spark, sf).distinct().exceptAll(edges(spark, sf).select("src", "dst", "kind").distinct()).count()
    assert not edges(spark, sf).select("src", "dst", "kind").exceptAll(links(spark, sf)).count()
    stored, save = [], traverse.save
    monkeypatch.setattr(traverse, "save", lambda s, df, label: stored.append(label) or save(s, df, label))
    for name in ("get_callers", "get_dependencies"):
        assert catalog.queries()[name](spark, sf).count()
    assert "steps" not in stored
