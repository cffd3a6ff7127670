"""Ranges are joined by bins."""


def test_range_grounding_joins_by_bins(spark, sf):
    from graphloom.plans import catalog

    plan = catalog.queries()["range_grounding"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join" in line and "path" in line and "line" in line)
    assert "bin" in join
