"""How often winnow reads its tables."""

from graphloom.plans import catalog, retrieval


def test_winnow_makes_its_rows_once(spark, sf, monkeypatch):
    """The maxima and the scores are of one stored table; the graph isn't made again for each."""
    made, save = [], retrieval.save
    monkeypatch.setattr(retrieval, "save", lambda s, df, label: made.append(df) or save(s, df, label))
    out = catalog.queries()["winnow"](spark, sf)
    assert "lineitem" not in "".join(out.inputFiles()) and len(made) == 1
