"""Periodic runs and the fill-in-middle transformation against brute force and round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import fill_in_middle, periodic_runs

ODD = "doc_id long, text string, id int, `row` int, n long, output string, `a.b` int, runs string"
ODD_ROWS = [(1, None, 1, 1, 1, "x", 1, "y"), (2, "", 1, 1, 1, None, 1, "y"), (3, "a " * 50_000, 1, None, 1, "x", 1, "y"), (3, "a " * 50_000, 1, None, 1, "x", 1, "y"), (None, "ab ab ab ab ab ab <P>", 1, 1, None, "x", 1, "y"), (5, "é𝄞z\n" * 9_000, 1, 1, 1, "x", 1, "y"), (6, " \n ", 1, 1, 1, "x", 1, None)]


def brute_runs(words):
    """Every maximal stretch of each period, the smallest period first."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - at
            if length >= max(6, 4 * q):
                found.setdefault((at, length), q)
            at = end + 1
    return sorted((a, length, q) for (a, length), q in found.items())


def texts_with_runs(rng, many):
    for k in range(many):
        w = [f"w{rng.randrange(3 if k % 4 == 0 else 40)}" for _ in range(rng.randrange(120))]
        if k % 3 == 0 and w:
            at, p = rng.randrange(len(w)), 1 + rng.randrange(9)
            w[at:at] = (w[at : at + p] or ["x"]) * rng.randrange(2, 12)
        if k % 7 == 0:
            w = ["a"] * k
        yield w


@pytest.mark.parametrize("hashed", [True, False])
def test_runs_against_brute_force(hashed):
    for seed in range(6):
        docs = list(texts_with_runs(random.Random(seed), 60))
        ids, _ = periodic_runs.interned([" ".join(w).encode() for w in docs])
        got = periodic_runs.runs_of(ids, hashed=hashed)
        assert [[tuple(r) for r in x.tolist()] for x in got] == [brute_runs(w) for w in docs]


def test_runs_of_hash_defeating_and_long_texts():
    thue = np.array([bin(i).count("1") % 2 for i in range(1 << 13)])
    assert all(len(r) == 0 for r in periodic_runs.runs_of([thue]))  # free of cubes, though its halves have equal polynomial hashes
    flat = np.zeros(200_000, np.int64)
    assert periodic_runs.runs_of([flat])[0].tolist() == [[0, 200_000, 1]]
    deep = np.tile(np.tile(np.array([1, 2, 3]), 8).tolist() + [9], 50)
    assert len(periodic_runs.runs_of([deep])[0]) == 51
    with pytest.raises(ValueError):
        periodic_runs.runs_of([flat], exponent=3)


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words) if len(set(words)) > 1 or n < 6 else [(0, n, 1)]
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_op11_against_brute_force(spark, sf):
    from graphloom.llm.common import table

    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect() if len(r["text"] or "") < 12_000]
    rows += [(10_000 + k, " ".join(w)) for k, w in enumerate(texts_with_runs(random.Random(9), 80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in periodic_runs.digest_runs(docs, order=periodic_runs.looped).collect()}
    assert got == {i: expected(i, t) for i, t in rows}


def test_runs_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD_ROWS, ODD)
    got = [tuple(r)[1:] for r in periodic_runs.digest_runs(docs, order=periodic_runs.looped).collect()]
    assert sorted(map(str, got)) == sorted(str(expected(r[0], r[1])) for r in ODD_ROWS)
    found = {r["id"]: r for r in periodic_runs.find_runs(docs).collect()}
    assert [tuple(x) for x in found[3]["runs"]] == [(0, 50_000, 1)] and found[3]["collapsed"] == "a" and found[None]["collapsed"] == "ab <P>" and found[1]["n_words"] == 0
    assert periodic_runs.find_runs(spark.createDataFrame([], ODD)).count() == 0


@pytest.mark.parametrize("unit", fill_in_middle.UNITS)
def test_checkpoints(unit):
    rng = random.Random(3)
    for size in (0, 1, 7, 500, 9_000):
        text = "".join(rng.choice("ab é𝄞\n  z") for _ in range(size))
        starts = [i for i, c in enumerate(text) if i == 0 or unit == "char" or (text[i - 1] == "\n" if unit == "line" else c not in " \n" and text[i - 1] in " \n")]
        for step in (1, 3, 64, 1 << 20):
            index = fill_in_middle.Checkpoints(text.encode(), unit, step)
            assert (index.units, index.length) == (len(starts), size)
            for u in {0, len(starts), len(starts) // 2, *(rng.randrange(len(starts) + 1) for _ in range(20))}:
                at = starts[u] if u < len(starts) else size
                assert index.locate(u) == (len(text[:at].encode()), at)


def test_checkpoints_across_pieces(monkeypatch):
    monkeypatch.setattr(fill_in_middle, "PIECE", 5)
    text = "aé𝄞 b\n" * 200
    for unit in fill_in_middle.UNITS:
        whole = [fill_in_middle.Checkpoints(text.encode(), unit, 4).locate(u) for u in range(0, 1201)]
        monkeypatch.setattr(fill_in_middle, "PIECE", 1 << 20)
        assert whole == [fill_in_middle.Checkpoints(text.encode(), unit, 4).locate(u) for u in range(0, 1201)]
        monkeypatch.setattr(fill_in_middle, "PIECE", 5)


@pytest.mark.parametrize("unit", fill_in_middle.UNITS)
def test_fill_round_trip(spark, unit):
    rows = [(i, t) for i, t in enumerate(["", None, "<S", "x<P", "a<M", "one two\nthree\n", "has <M> inside", "é𝄞 " * 3_000] + [f"line {k}\nend<" for k in range(150)])]
    out = fill_in_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"), unit=unit, step=16).withColumn("back", fill_in_middle.restore(F.col("output"), F.col("form"))).collect()
    assert {r["id"]: r["back"] for r in out} == {i: t or "" for i, t in rows} and {r["form"] for r in out} == {"plain", "psm", "spm"}
    for r in out:
        text = rows[r["id"]][1] or ""
        if r["form"] == "plain":
            assert r["prefix_chars"] is None and r["output"] == text
        else:
            a, b = r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]
            assert r["output"] == (f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}" if r["form"] == "psm" else f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")
            assert (r["prefix_bytes"], r["middle_bytes"]) == (len(text[:a].encode()), len(text[a:b].encode()))


def test_fill_keeps_odd_columns(spark):
    docs = spark.createDataFrame(ODD_ROWS, ODD)
    got = fill_in_middle.rewrite(docs)
    assert got.columns == [*docs.columns, "fim_form"] and fill_in_middle.rewrite(got.drop("n")).columns[-1].startswith("fim_form_")
    assert sorted(str(tuple(r)[2:-1]) for r in got.collect()) == sorted(str(r[2:]) for r in ODD_ROWS)
    assert fill_in_middle.rewrite(spark.createDataFrame([], ODD)).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle.transform(docs, unit="page")
