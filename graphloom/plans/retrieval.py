"""Search, ranking, clones and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import identifiers as ids
from graphloom.operators import clone_index as clone_store
from graphloom.operators import clones, ranges, search, textsearch
from graphloom.plans.query import query
from graphloom.sources.fixture import edges, nodes, read
from graphloom.sources.storage import save, shared_dir

WORDS = r"regexp_extract_all(lower(text), '[a-z0-9]+')"
TERMS = ("the", "edge", "worthless", "license", "and", "token")


@query("""SELECT p_partkey AS id, array_to_string(list_filter(string_split_regex(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda t: len(t) >= 2), ' ') AS tokens FROM part""")
def tokenize(spark, sf):
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(ids.tokens(F.concat_ws(" ", "p_name", F.lower("p_type"))), " ").alias("tokens"))


BM25_SQL = f"""WITH w AS (SELECT doc_id AS id, {WORDS} AS t FROM documents), l AS (SELECT id, len(t) AS len FROM w), s AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM w) WHERE term IN {TERMS} GROUP BY id, term), d AS (SELECT term, count(*) AS df FROM p GROUP BY term)
SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM p JOIN d USING (term) JOIN l USING (id), s GROUP BY id ORDER BY score DESC, id LIMIT 50"""


def _words():
    return F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))


@query(BM25_SQL)
def bm25(spark, sf):
    """Without an index, in one pass over the texts."""
    found, n, mean = search.scan_postings(spark, read(spark, sf, "documents"), "doc_id", _words(), list(TERMS))
    return search.bm25(found, n, mean, list(TERMS), 50)


@query(BM25_SQL)
def bm25_indexed(spark, sf):
    """The same from a stored index, made here first."""
    path = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}-tables/index-{uuid.uuid4().hex[:12]}"
    search.write_index(read(spark, sf, "documents"), "doc_id", _words(), path)
    return search.search_index(spark, path, list(TERMS), 50)


@query("SELECT doc_id AS id FROM documents WHERE contains(text, 'General Public License')")
def trigram_search(spark, sf):
    return search.trigram_search(read(spark, sf, "documents"), "doc_id", "text", "General Public License")


#: An expression that both engines read alike.
LICENCES = "(?i)(released|licensed) under the (mit|apache|gnu).*licen[sc]e"


@query(rf"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), l AS (SELECT doc_id, unnest(lines) AS text, generate_subscripts(lines, 1) AS line FROM d)
SELECT doc_id, line, text, 'doc/' || doc_id || '#' || (line - 1) // 10 AS symbol FROM l WHERE regexp_matches(text, '{LICENCES}')""")
def regexp_search(spark, sf):
    """Lines that match, through stored postings, each with the block of ten lines around it."""
    docs = read(spark, sf, "documents")
    index = f"{shared_dir(spark)}/trigrams-{uuid.uuid4().hex[:12]}"
    textsearch.add(spark, index, docs, "doc_id")
    found = save(spark, textsearch.search(spark, index, docs, LICENCES, "doc_id"), "found")
    lines = docs.join(found.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.size(F.split("text", "\n", -1)).alias("n"))
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    blocks = lines.select(path.alias("path"), "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 10))).alias("k"))
    symbols = blocks.select("path", F.concat_ws("#", "path", F.col("k").cast("string")).alias("id"), (F.col("k") * 10 + 1).alias("start"), F.least(F.col("k") * 10 + 10, "n").alias("stop"))
    whole = lines.select(path.alias("path"), path.alias("id"), F.lit(1).cast("long").alias("start"), (F.col("n") + 1).cast("long").alias("stop"))
    hits = found.select(F.col("id").alias("doc_id"), "line", "text", F.concat(F.lit("doc/"), F.col("id").cast("string")).alias("path"))
    return ranges.innermost(symbols.unionByName(whole), hits).select("doc_id", "line", "text", "symbol")


@query("""WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, qe), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(qe, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS score
FROM embeddings, q WHERE vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 20""")
def vector_search(spark, sf):
    """The query vector is one row, read first and sent along as a literal."""
    e = read(spark, sf, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in e.where("vec_id = 0").first()["embedding"]])
    return e.where("vec_id <> 0").select("vec_id", F.round(search.cosine(F.col("embedding"), q), 6).alias("score")).orderBy(F.col("score").desc(), "vec_id").limit(20)


@query("""WITH t AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS rank FROM part QUALIFY rank < 200), v AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS rank FROM part QUALIFY rank < 200)
SELECT coalesce(t.id, v.id) AS id, round(coalesce(0.4::DOUBLE / (60 + t.rank + 1), 0) + coalesce(0.6::DOUBLE / (60 + v.rank + 1), 0), 9) AS score FROM t FULL JOIN v ON t.id = v.id""")
def rank_fusion(spark, sf):
    """Each channel is cut to its 200 best before ranks are counted."""
    part = read(spark, sf, "part")

    def channel(c):
        top = part.select(F.col("p_partkey").alias("id"), F.col(c).alias("v")).orderBy(F.col("v").desc(), "id").limit(200)
        return top.select("id", (F.row_number().over(Window.orderBy(F.col("v").desc(), "id")) - 1).alias("rank"))

    return search.fuse(channel("p_retailprice"), channel("p_size"), 0.6)


#: The weights of winnow's axes.
WINNOW = {"text_match": 1.0, "fan_in": 0.7, "fan_out": 0.3, "churn": 0.5}


@query("""i AS (SELECT dst AS id, count(*) AS fan_in FROM edges GROUP BY dst), o AS (SELECT src AS id, count(*) AS fan_out FROM edges GROUP BY src), h AS (SELECT 'part/' || l_partkey AS id, count(*) AS churn FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
f AS (SELECT n.id, n.name, CASE WHEN starts_with(lower(n.name), 'red') THEN 2 WHEN contains(lower(n.name), 'ring') THEN 1 ELSE 0 END AS txt, fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(churn, 0) AS churn FROM nodes n JOIN i ON i.id = n.id LEFT JOIN o ON o.id = n.id LEFT JOIN h ON h.id = n.id WHERE n.kind = 'method' AND fan_in >= 2),
m AS (SELECT max(txt) AS t, max(fan_in) AS i, max(fan_out) AS o, max(churn) AS c FROM f)
SELECT id, round(coalesce(1.0::DOUBLE * txt / nullif(t, 0), 0) + coalesce(0.7::DOUBLE * fan_in / nullif(i, 0), 0) + coalesce(0.3::DOUBLE * fan_out / nullif(o, 0), 0) + coalesce(0.5::DOUBLE * churn / nullif(c, 0), 0), 6) AS score FROM f, m ORDER BY score DESC, length(name), id LIMIT 100""", graph=True)
def winnow(spark, sf):
    """Constraint chain: kind and least fan-in, then text match, fan-in, fan-out and churn, each by its maximum, with fixed weights."""
    side = lambda end, i, o: F.struct(F.col(end).alias("e_id"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    ends = edges(spark, sf).select(F.explode(F.array(side("dst", 1, 0), side("src", 0, 1))).alias("x")).select("x.*")  # one pass for both counts
    fans = ends.groupBy("e_id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out")).where("fan_in >= 2")
    churn = read(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("h_id")).agg(F.count("*").alias("churn"))
    text = F.when(F.lower("name").startswith("red"), 2).when(F.lower("name").contains("ring"), 1).otherwise(0)
    rows = nodes(spark, sf).where("kind = 'method'").select("id", "name", text.alias("text_match"))
    rows = rows.join(fans, F.col("id") == F.col("e_id")).join(churn, F.col("id") == F.col("h_id"), "left").fillna(0, ["churn"])
    rows = save(spark, rows.select("id", "name", *WINNOW), "winnow")  # read twice, made once
    tops = rows.agg(*[F.max(c).alias(c) for c in WINNOW]).first()  # four numbers
    score = sum((F.lit(w) * F.col(c) / F.lit(tops[c]) for c, w in WINNOW.items() if tops[c]), F.lit(0.0))
    scored = rows.select("id", "name", F.round(score, 6).alias("score"))
    return scored.orderBy(F.col("score").desc(), F.length("name"), "id").limit(100).select("id", "score")


@query("""WITH t AS (SELECT DISTINCT p_partkey AS id, unnest(string_split_regex(lower(p_name || ' ' || p_type), '[^a-z0-9]+')) AS token FROM part), u AS (SELECT * FROM t WHERE len(token) >= 3),
c AS (SELECT a.token, b.token AS sibling, count(*) AS n FROM u a JOIN u b ON a.id = b.id AND a.token <> b.token GROUP BY 1, 2 HAVING count(*) >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY n DESC, sibling) AS k FROM c) SELECT token, sibling, n FROM r WHERE k <= 6""")
def auto_concepts(spark, sf):
    t = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), "[^a-z0-9]+"))).alias("token")).where("length(token) >= 3")
    pairs = t.join(t.select(F.col("id").alias("other"), F.col("token").alias("sibling")), (F.col("id") == F.col("other")) & (F.col("token") != F.col("sibling")))
    by = pairs.groupBy("token", "sibling").agg(F.count("*").alias("n")).where("n >= 3")
    return by.withColumn("k", F.row_number().over(Window.partitionBy("token").orderBy(F.col("n").desc(), "sibling"))).where("k <= 6").drop("k")


PARAMS = ", ".join(f"({i}, {a}::HUGEINT, {b}::HUGEINT)" for i, (a, b) in enumerate(clones.parameters()))
KEPT = ", ".join(f"'{w}'" for w in sorted(clones.KEYWORDS))
LEX = clones.LEX.replace("'", "''")


@query(rf"""WITH w AS (SELECT item_id AS id, list_transform(regexp_extract_all(text, '(?s)(?:{LEX})'), lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z_$\x{{80}}-\x{{10FFFF}}]') THEN CASE WHEN lower(t) IN ({KEPT}) THEN lower(t) ELSE 'v' END WHEN t[1] BETWEEN '0' AND '9' THEN '0' WHEN t[1] IN ('"', '`', chr(39)) THEN 's' ELSE t END) AS t FROM benchmark),
g AS (SELECT DISTINCT id, len(t) AS tokens, hex(t[i]) || '00' || hex(t[i + 1]) || '00' || hex(t[i + 2]) || '00' AS x FROM (SELECT id, t, unnest(range(1, len(t) - 1)) AS i FROM w WHERE len(t) >= {clones.LEAST_TOKENS})),
f AS (SELECT x, list_reduce(list_transform(range(0, len(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::HUGEINT), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616, 14695981039346656037::HUGEINT) % {clones.PRIME} AS h FROM (SELECT DISTINCT x FROM g)),
p(i, a, b) AS (VALUES {PARAMS}), s AS (SELECT id, tokens, i, min((a * h + b) % {clones.PRIME}) AS s FROM g JOIN f USING (x), p GROUP BY ALL)
SELECT id, any_value(tokens) AS tokens, md5(string_agg(s::VARCHAR, ',' ORDER BY i)) AS signature_md5 FROM s GROUP BY id""")
def minhash_signatures(spark, sf):
    signed = clones.signatures(clones.shingles(read(spark, sf, "benchmark"), "item_id", "text"))
    return signed.select("id", "tokens", F.md5(F.array_join("sig", ",")).alias("signature_md5"))


def _passages(spark, sf):
    """The benchmark's passages and copies of them under new ids, with a tail."""
    b = read(spark, sf, "benchmark")
    both = b.select("item_id", "text").unionByName(b.select((F.col("item_id") + 1_000_000).alias("item_id"), F.concat("text", F.lit(" tail")).alias("text")))
    return save(spark, clones.signatures(clones.shingles(both, "item_id", "text")), "signatures")


@query()
def clone_pairs(spark, sf):
    return clones.pairs(spark, _passages(spark, sf))


@query()
def clone_clusters(spark, sf):
    """Clusters of clones, the larger ones first."""
    found = clones.clusters(spark, clones.pairs(spark, _passages(spark, sf)))
    return found.select("cluster", "size", F.round("similarity", 6).alias("similarity")).orderBy(F.col("size").desc(), "cluster")


@query(rf"""WITH held AS (SELECT doc_id AS id, CASE WHEN source IN ('src1', 'src2', 'src3') THEN text || ' if' ELSE text END AS text FROM documents WHERE coalesce(lang, '') <> 'fr' UNION ALL SELECT -1 - item_id, text FROM benchmark),
w AS (SELECT id, list_transform(regexp_extract_all(text, '(?s)(?:{LEX})'), lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z_$\x{{80}}-\x{{10FFFF}}]') THEN CASE WHEN lower(t) IN ({KEPT}) THEN lower(t) ELSE 'v' END WHEN t[1] BETWEEN '0' AND '9' THEN '0' WHEN t[1] IN ('"', '`', chr(39)) THEN 's' ELSE t END) AS t FROM held),
g AS (SELECT DISTINCT id, len(t) AS tokens, hex(t[i]) || '00' || hex(t[i + 1]) || '00' || hex(t[i + 2]) || '00' AS x FROM (SELECT id, t, unnest(range(1, len(t) - 1)) AS i FROM w WHERE len(t) >= {clones.LEAST_TOKENS})),
f AS (SELECT x, list_reduce(list_transform(range(0, len(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::HUGEINT), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616, 14695981039346656037::HUGEINT) % {clones.PRIME} AS h FROM (SELECT DISTINCT x FROM g)),
p(i, a, b) AS (VALUES {PARAMS}), slots AS (SELECT id, tokens, i, min((a * h + b) % {clones.PRIME})::BIGINT AS s FROM g JOIN f USING (x), p GROUP BY ALL),
m AS (SELECT id, tokens, list(s ORDER BY i) AS sig FROM slots GROUP BY ALL), c AS (SELECT sig, tokens, min(id) AS rep FROM m GROUP BY ALL),
k AS (SELECT rep, sig, z, j, list_slice(sig, 4 * j + 1, 4 * j + 4) AS key FROM c, (VALUES {", ".join(f"({z}, {low}, {high})" for z, (low, high) in enumerate(clones.CLASSES))}) v(z, low, high), range(0, {clones.BANDS}) r(j) WHERE tokens >= low AND tokens < high),
met AS (SELECT DISTINCT x.rep AS a, y.rep AS b, x.sig AS sa, y.sig AS sb FROM k x JOIN k y USING (z, j, key) WHERE x.rep < y.rep),
near AS (SELECT a, b, len(list_filter(list_zip(sa, sb), lambda q: q[1] = q[2])) / {clones.SLOTS}::DOUBLE AS similarity FROM met)
SELECT a, b, similarity FROM near WHERE similarity >= {clones.LEAST_SIMILARITY} UNION ALL SELECT c.rep, m.id, 1.0::DOUBLE FROM m JOIN c USING (sig, tokens) WHERE m.id <> c.rep""")
def clone_index(spark, sf):
    """Pairs of an index after all documents, then the benchmark's passages and an edit of what three sources gave, then without French."""
    index = f"{shared_dir(spark)}/clone-index-{uuid.uuid4().hex[:12]}"
    docs, asked = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    row = lambda df, id_, text: df.select(id_.alias("id"), F.lit(1).alias("seq"), text.alias("text"))
    same, gone = F.col("text"), F.lit(None).cast("string")
    clone_store.apply(spark, index, row(docs, F.col("doc_id"), same))
    edits = row(docs.where("source in ('src1', 'src2', 'src3')"), F.col("doc_id"), F.concat("text", F.lit(" if")))
    clone_store.apply(spark, index, row(asked, -1 - F.col("item_id"), same).unionByName(edits))
    clone_store.apply(spark, index, row(docs.where("lang = 'fr'"), F.col("doc_id"), gone))
    return clone_store.pairs(spark, index)


@query()
def clone_boilerplate(spark, sf):
    """Lengths and sizes of what remains of each passage without shingles that more than three in ten share."""
    b = read(spark, sf, "benchmark")
    left = clones.without_boilerplate(spark, clones.shingles(b, "item_id", "text"), max(1, b.count() * 3 // 10), 8)
    return left.groupBy("id", "tokens").agg(F.count("*").alias("shingles"))


@query("""WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM embeddings)
SELECT label, count(*) AS n, round(avg(CASE WHEN pos <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(1.0::DOUBLE / pos), 6) AS mrr, round(sum(1.0::DOUBLE / log2(pos + 1)), 6) AS dcg FROM r GROUP BY label""")
def retrieval_metrics(spark, sf):
    r = read(spark, sf, "embeddings").select("label", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("pos"))
    return r.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pos") <= 5).cast("double")), 6).alias("recall_5"), F.round(F.avg(1.0 / F.col("pos")), 6).alias("mrr"), F.round(F.sum(1.0 / F.log2(F.col("pos") + 1)), 6).alias("dcg"))
