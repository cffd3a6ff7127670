"""Rounds of the n-gram join add new links to the components known, and don't begin again with all links."""

from graphloom.llm import ngram_join, stars


def test_merged_takes_only_the_ends_of_new_links(spark, monkeypatch):
    labels = spark.createDataFrame([(b, a * 10) for a in range(6) for b in range(a * 10, a * 10 + 5)], "node long, component long")
    met, plain = [], stars.components

    def counted(s, edges, *ends):
        met.append(edges.count())
        return plain(s, edges, *ends)

    monkeypatch.setattr(stars, "components", counted)
    got = {r["node"]: r["component"] for r in stars.merged(spark, labels, spark.createDataFrame([(14, 33), (33, 52), (99, 53)], "a long, b long")).collect()}
    to = {30: 10, 50: 10}
    assert got == {**{b: to.get(a * 10, a * 10) for a in range(6) for b in range(a * 10, a * 10 + 5)}, 99: 10}
    assert met == [3]
    assert ngram_join.stars is stars
