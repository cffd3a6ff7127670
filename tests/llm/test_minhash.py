"""MinHash near-dedup and the star components against brute force."""

import random

import numpy as np
import pytest
from test_operators import DOCS, EDGE, brute_components

from graphloom.llm import minhash_dedup, stars
from graphloom.llm.minhash_dedup import Near


def families(rng, n, base_words=150):
    base = [f"w{rng.randrange(400)}" for _ in range(base_words)]
    for i in range(n):
        if i % 3 == 0:  # one family that drifts, a third of all rows
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(9999)}"
            if i % 30 == 0:
                base[rng.randrange(len(base))] = f"y{i}"
        elif i % 4 == 1:
            w = [f"v{i // 12}_{k}" for k in range(60)]
            w[rng.randrange(60)] = "X"
        elif i % 4 == 2:
            w = ["a", "b", "c", "d", "e", "f"][: rng.randrange(7)]
        else:
            w = [f"u{rng.randrange(5000)}" for _ in range(rng.randrange(1, 40))]
        yield i, " ".join(w) if i % 5 else " ".join(w).upper()


@pytest.mark.parametrize("near,part", [(Near(num=17, den=20), 4096), (Near(), 8)])
def test_components_against_brute_force(spark, monkeypatch, near, part):
    monkeypatch.setattr(minhash_dedup, "PART", part)
    monkeypatch.setattr(minhash_dedup, "REACH", 1)
    docs = list(families(random.Random(near.num), 240))
    got = minhash_dedup.components(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(5), near).collect()
    assert {r["id"]: (r["n"], r["component"]) for r in got} == brute_components(docs, near.words, near.num, near.den) and len(got) == len(docs)


def test_op12_on_the_small_tables(spark, sf):
    from graphloom.llm.common import table

    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    want = brute_components(docs, 5, 17, 20)
    got = minhash_dedup.op12_minhash_dedup(spark, sf).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd_rows(spark):
    docs = spark.createDataFrame(EDGE, DOCS)
    got = minhash_dedup.components(spark, docs).collect()
    assert len(got) == len(EDGE) and {(r["id"], r["component"]) for r in got} == {(1, 1), (2, 2), (3, 3), (None, None), (5, 5), (6, 5), (7, 7), (8, 8)}
    kept = minhash_dedup.keep_one(spark, docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "5", "7", "8", "None"]
    assert minhash_dedup.components(spark, spark.createDataFrame([], DOCS)).count() == 0
    named = spark.createDataFrame([(f"d{i}", t) for i, t in families(random.Random(2), 60)], "doc_id string, text string")
    assert len({r["component"] for r in minhash_dedup.components(spark, named).collect()}) < 60


def test_minima_of_large_sets():
    near, rng = Near(), np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 100_000, 7, 32768, 3)]
    a, b = near.functions()
    want = np.array([[int((s * a[k] + b[k]).min()) for k in range(near.hashes)] for s in sets], np.uint64)
    assert (minhash_dedup.minima(sets, near) == want).all()


def test_stars(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(1, 60)] + [(rng.randrange(200, 320), rng.randrange(200, 320)) for _ in range(70)] + [(5, 5), (None, 3), (7, None), (0, 1)]
    got = {r["node"]: r["component"] for r in stars.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert stars.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0
