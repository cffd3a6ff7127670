"""Every corpus operator, and the pipeline, over nulls, ties, repeats, long texts, odd column names, ids of text and empty tables."""

import pytest

from graphloom.llm import bpe, exact_dedup, language_id, line_dedup, mixing, ngram_join, sharding

PROSE = "the quick brown fox jumps over the lazy dog and then runs away from all the other animals in the wood "
TEXTS = [None, "", " \n ", PROSE, PROSE, PROSE.upper(), PROSE + "twice", "12 34", "z" * 200_000, PROSE * 300, "ein kurzer satz über den wald", None]
NAMES = ["doc_id", "text", "lang", "source", "n_chars", "my-col", "a.b", "row", "size", "digest", "id", "key"]


def rows(ids):
    return [(i, t, "en" if k % 2 else None, "s" if k % 3 else None, len(t or ""), "x", k, None, 1, "d", 2, "k") for k, (i, t) in enumerate(zip(ids, TEXTS))]


def schema(kind):
    return ", ".join(f"`{n}` {t}" for n, t in zip(NAMES, [kind, "string", "string", "string", "long", "string", "int", "string", "int", "string", "int", "string"]))


@pytest.fixture(scope="module", params=["long", "string", "empty"])
def docs(spark, request):
    if request.param == "empty":
        return spark.createDataFrame([], schema("long"))
    ids = [1, 2, 3, 4, 4, 5, 6, 7, 8, 9, None, None]
    if request.param == "string":
        return spark.createDataFrame(rows([None if i is None else f"d-{i}" for i in ids]), schema("string"))
    return spark.createDataFrame(rows(ids), schema("long"))


ALL = {
    "mixing": lambda spark, d: mixing.copies_of(spark, d),
    "exact_dedup": lambda spark, d: exact_dedup.annotate(spark, d),
    "ngram_join": lambda spark, d: ngram_join.components(spark, d, ngram_join.Join(5, 4, 5)),
    "bpe": lambda spark, d: bpe.digest_documents(d),
    "language_id": lambda spark, d: language_id.predict(spark, d, language_id.learn(spark, d)),
    "line_dedup": lambda spark, d: line_dedup.dedup_lines(spark, d),
    "sharding": lambda spark, d: sharding.assign(spark, d),
}
KEPT = {
    "mixing": lambda spark, d: mixing.mix(spark, d),
    "exact_dedup": lambda spark, d: exact_dedup.dedup(spark, d),
    "ngram_join": lambda spark, d: ngram_join.keep_one(spark, d, ngram_join.Join(5, 4, 5)),
    "language_id": lambda spark, d: language_id.keep_identified(spark, d),
}


@pytest.mark.parametrize("name", ALL)
def test_a_row_for_each_document(spark, docs, name):
    assert len(ALL[name](spark, docs).collect()) == docs.count()


@pytest.mark.parametrize("name", KEPT)
def test_columns_pass_through(spark, docs, name):
    out = KEPT[name](spark, docs)
    assert out.columns == docs.columns and len(out.collect()) <= 2 * docs.count()


def test_near_copies_by_ids_of_text(spark):
    d = spark.createDataFrame(rows([f"d{k:02d}" for k in range(12)]), schema("string"))
    got = {r["id"]: r["component"] for r in ngram_join.components(spark, d, ngram_join.Join(5, 4, 5)).collect()}
    near = ["d03", "d04", "d05", "d06", "d09"]  # d09 repeats the passage: 16 of 20 shingles in common, 0.8 exactly
    assert {got[i] for i in near} == {"d03"} and all(got[i] == i for i in got if i not in near)


@pytest.mark.parametrize("size", ["some", "none"])
def test_pipeline_over_odd_tables(spark, tmp_path, size):
    import corpus_pipeline

    ids = [1, 2, 3, 4, 4, 5, 6, 7, 8, 9, None, None]
    spark.createDataFrame(rows(ids) if size == "some" else [], schema("long")).write.parquet(f"{tmp_path}/documents.parquet")
    got = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert set(got) <= {4, 5, 8, 9, None} and (size == "none") == (not got)
