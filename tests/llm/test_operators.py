"""The corpus operators against brute force, round trips and their edge cases."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import oracle
import public_tokenizers
import pytest
import tiktoken

from graphloom.llm import bpe, chat, exact_dedup, html, language_id, line_dedup, mixing, ngram_join, registry, sharding, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, `row` int, digest string, id int"
EDGE = [
    (1, None, "en", "a", 0, "x", 1, "d", 9), (2, "", "en", None, 0, "x", 1, "d", 9), (3, "Word", None, "a", 4, None, None, None, None), (None, "word", "en", "b", 4, "x", 1, "d", 9),
    (5, "one two three four five six " * 400, "en", "b", 1, "x", 1, "d", 9), (6, "one two three four five six " * 400, "fr", "b", 1, "x", 1, "d", 9), (6, "one two three four five six " * 400, "fr", "b", 1, "x", 1, "d", 9),
    (7, "123 456", "de", "c", 7, "x", 1, "d", 9), (8, "x" * 300_000, "de", "c", 7, "x", 1, "d", 9),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf, name):
    assert oracle.differences(spark, oracle.connection(sf), registry.queries()[name], registry.oracle_sql()[name], sf) is None


def test_exact_dedup_edges(spark, edge, empty):
    got = exact_dedup.annotate(spark, edge, counters=2).collect()
    assert len(got) == len(EDGE) and sum(r["kept"] for r in got) == 5
    kept = exact_dedup.dedup(spark, edge, counters=2)
    assert kept.columns == edge.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "6", "7", "8"]
    assert exact_dedup.annotate(spark, empty).count() == 0 == exact_dedup.dedup(spark, empty).count()


def test_exact_dedup_heavy_split(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2}") for i in range(900)]
    got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.annotate(spark, spark.createDataFrame(rows, "doc_id long, text string"), counters=4).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    assert got == {i: (max(groups[t]), len(groups[t]), i == max(groups[t])) for i, t in rows}


def test_sharding(spark, edge, empty):
    rows = [(i, "hot " * 50 if i % 3 == 0 else f"text {i} " * (i % 40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["row"]["doc_id"], r["placed"]) for r in sharding.assign(spark, df).collect()]
    assert sorted(i for i, _ in got) == list(range(3000))
    slots, sizes = defaultdict(list), Counter()
    for _, p in got:
        slots[p["shard"]].append(p["slot"])
        sizes[p["shard"]] += p["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(sizes.values()) < 1.1 * min(sizes.values())
    assert sorted((i, p["shard"], p["slot"]) for i, p in got) == sorted((r["row"]["doc_id"], r["placed"]["shard"], r["placed"]["slot"]) for r in sharding.assign(spark, df.repartition(7)).collect())
    assert sharding.assign(spark, edge).count() == len(EDGE) and sharding.assign(spark, empty).count() == 0


def test_mixing(spark, edge, empty):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 200), None if i % 11 == 0 else "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies_of(spark, df).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r["skey"]] += r["size"]
        taken[r["skey"]] += r["size"] * r["copies"]
        target[r["skey"]] = r["target"]
        assert r["copies"] in (0, 1, 2)
    order = sorted(sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 2 * sizes[s]}
        want |= {s: 2.0 * sizes[s] for s in over} if over else {s: weight[s] * level for s in free}
        left -= sum(2 * sizes[s] for s in over)
        free = free - over if over else set()
    assert all(abs(want[s] - target[s]) < 1e-6 * want[s] and abs(taken[s] - want[s]) < 0.002 * want[s] for s in order)
    again = mixing.copies_of(spark, df.repartition(5)).collect()
    assert sorted((r["id"], r["copies"]) for r in got) == sorted((r["id"], r["copies"]) for r in again)
    assert mixing.mix(spark, df).count() == sum(r["copies"] for r in got)
    assert mixing.copies_of(spark, edge).count() == len(EDGE) and mixing.copies_of(spark, empty).count() == 0
    assert mixing.mix(spark, edge).columns == edge.columns


def brute_components(docs, words, num, den):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("words,num,den", [(3, 9, 10), (5, 4, 5)])
def test_ngram_join(spark, words, num, den):
    rng = random.Random(7)
    docs, base = [], [f"w{rng.randrange(400)}" for _ in range(150)]
    for i in range(160):  # one large family of near copies with drift, small ones, and short texts
        if i % 4 == 0:
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(9999)}"
        elif i % 4 == 1:
            w = [f"v{i // 8}_{k}" for k in range(60)]
            w[rng.randrange(60)] = "X"
        elif i % 4 == 2:
            w = ["a", "b", "c"][: rng.randrange(4)]
        else:
            w = [f"u{rng.randrange(5000)}" for _ in range(rng.randrange(1, 40))]
        docs.append((i, " ".join(w) if i % 3 else " ".join(w).upper()))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["id"]: (r["n"], r["component"]) for r in ngram_join.components(spark, df, ngram_join.Join(words, num, den)).collect()}
    assert got == brute_components(docs, words, num, den)


def test_ngram_join_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART", 3)
    test_ngram_join(spark, 5, 4, 5)


def test_ngram_join_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "REACH", 1)
    monkeypatch.setattr(ngram_join, "FURTHER", 2)
    test_ngram_join(spark, 5, 4, 5)


def test_ngram_nearest():
    rng = random.Random(3)
    rows = sorted((rng.randrange(6), a, b, a % 7, 7 + b % 5) for a in range(20) for b in range(100, 115) if rng.random() < 0.5)
    for reach in (1, 3, 10, 1000):
        want = set()
        for side in (3, 4):
            for c in {r[side] for r in rows}:
                want |= set([r for r in rows if r[side] == c][:reach])
        shuffled = rng.sample(rows, len(rows))
        got = ngram_join.nearest(np.array(shuffled).T, reach)
        assert set(map(tuple, got.T.tolist())) == want and got.shape[1] == len(want)


def test_ngram_edges(spark, edge, empty):
    got = {(r["id"], r["n"], r["component"]) for r in ngram_join.components(spark, edge).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 1, 3), (None, 1, None), (5, 6, 5), (6, 6, 5)} <= got
    assert ngram_join.components(spark, empty).count() == 0
    assert ngram_join.keep_one(spark, edge, ngram_join.Join(5, 4, 5)).columns == edge.columns


def test_ngram_null_id_before_equal_sets(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(None, " ".join(words)), (3, " ".join(words)), (4, " ".join(words)), (1, " ".join([*words[:-1], "other"])), (None, " ".join(words)), (9, "far from all of these")]
    got = {(r["id"], r["component"]) for r in ngram_join.components(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {(None, None), (1, 1), (3, 1), (4, 1), (9, 9)}


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, sf, reference):
    k = bpe.tokenizer()
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rng = random.Random(2)
    texts += ["", " ", "aaaa" * 500, "ab" * 5000, "hello'll  w\n\n x", "\x1c\x85  é ﬁ²½١٢漢字", "<|endoftext|>", "".join(rng.choice("abAB \n'12é漢.,") for _ in range(3000))]
    numbered, ids = k.encode_all(texts)
    want = [reference.encode_ordinary(t) for t in texts]
    assert [[i for p in x for i in ids[p]] for x in numbered] == want
    assert all(k.decode(w).decode() == t for w, t in zip(want, texts))
    pieces = [p.encode() for p in {p for t in texts for p in k.pieces(t)}]
    assert k.merge_all(pieces) == [tuple(k.merge(p)) for p in pieces]


def test_bpe_query(spark, sf, edge, empty, reference):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in registry.queries()["op5_byte_bpe"](spark, sf).collect():
        ids = reference.encode_ordinary(text[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text[r["doc_id"]].encode()).hexdigest())
    assert bpe.encode_documents(edge).count() == len(EDGE) and bpe.digest_documents(empty).count() == 0


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [-3.0, 0.0]), (7, [0.0, 0.0]), (8, [1.0]), (9, []), (10, [1e30, 1e30]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk.search(spark, df, df["vec_id"] == 0, 10).orderBy("rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got[0] == [(10, (1 << 63) - 1), (1, 5 << 20), (1, 5 << 20), (7, 0), (6, -3 << 20)]
    assert topk.search(spark, df.limit(0), df["vec_id"] == 0, 10).count() == 0


def test_topk_threshold_stops_right():
    rng = np.random.default_rng(0)
    v = rng.integers(-50, 50, (500, 6))
    ids = np.arange(500)
    got = [(i, c, s) for i, c, s in topk.threshold_topk(v[:20], ids[:20], v, ids, 5)]
    want = []
    for i in range(20):
        s = v @ v[i]
        want += [(i, c, int(s[c])) for c in sorted((c for c in range(500) if c != i), key=lambda c: (-s[c], c))[:5]]
    assert got == want


def test_language(spark, sf, edge, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = [r for r in registry.queries()["op8_language_id"](spark, sf).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in got) >= 0.97 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    profiles = language_id.learn(spark, docs)
    pred = {r["id"]: r["lang_pred"] for r in language_id.predict(spark, edge, profiles).collect()}
    assert pred[1] == pred[2] == pred[7] == "und" and pred[5] != "und"
    assert language_id.keep_identified(spark, edge).columns == edge.columns and language_id.keep_identified(spark, empty).count() == 0


def test_language_counts_brute_force(monkeypatch):
    monkeypatch.setattr(language_id, "CHUNK", 40)
    texts = ["The cat, the DOG 12 été", None, "", "a b", "wörter und wörter " * 30]
    for d, g, n in language_id.counted(texts):
        for doc in set(d.tolist()):
            words = "".join(c if c.isalpha() else " " for c in texts[doc].lower()).split()
            want = Counter(x for w in words for k in (1, 2, 3) for p in [f" {w} "] for x in (p[i : i + k] for i in range(len(p) - k + 1)) if x != " ")
            mine = {"".join(chr(x >> s & 0x1FFFFF) for s in (42, 21, 0) if x >> s & 0x1FFFFF): c for x, c in zip(g[d == doc].tolist(), n[d == doc].tolist())}
            assert mine == dict(want)


def test_language_counts_across_chunks_without_letters(monkeypatch):
    monkeypatch.setattr(language_id, "CHUNK", 40)
    texts = ["the cat and the dog " * 9 + "12 34 " * 40 + "un chien", "7 " * 90, "12 " * 50 + "one end", None, "b c " * 30 + "0 " * 200 + "b c " * 3 + "0 " * 200 + "d"]
    parts = [(set(d.tolist()), d, g, n) for d, g, n in language_id.counted(texts)]
    assert sorted(x for docs, *_ in parts for x in docs) == [0, 2, 4]
    monkeypatch.setattr(language_id, "CHUNK", 1 << 20)
    whole = {(x, y): z for d, g, n in language_id.counted(texts) for x, y, z in zip(d.tolist(), g.tolist(), n.tolist())}
    assert {(x, y): z for _, d, g, n in parts for x, y, z in zip(d.tolist(), g.tolist(), n.tolist())} == whole


def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies, really, a lot of them.</div><div id=content><h1>Big &amp; small</h1><p>First  para, with <b>bo</b>ld.<p>Second&nbsp;one.<br>More, text. And more, of it.
    <div class="ad">Buy this now, please.</div><blockquote>Quoted, words.</blockquote><section class=comments><p>Nice, post. I liked it, very much.</section></div><aside>Related</aside><form><p>Mail?</p></form><footer>(c) me, 2020.</footer>"""
    assert html.extract(page) == "Big & small First para, with bold. Second one. More, text. And more, of it. Quoted, words."
    assert html.extract(None) == html.extract("") == html.extract("<nav><a>x</a></nav>") == "" and html.extract("just text") == "just text"
    assert html.extract("<p>" * 3000 + "deep") == "deep"


def test_html_keeps_what_stands_around_the_bulk():
    bulk = "".join(f"<p>Long paragraph {i}, with words, marks, and more of them. It goes on, and on.</p>" for i in range(9))
    text = " ".join(f"Long paragraph {i}, with words, marks, and more of them. It goes on, and on." for i in range(9))
    whole = f"Title intro {text} closing"
    for tag in ("div", "section"):
        page = f"<div class=c><h1>Title</h1><p>intro</p><{tag}>{bulk}</{tag}><p>closing</p></div>"
        assert html.extract(f"<body><nav>Menu</nav>{page}<footer>Legal</footer></body>") == html.extract(f"<body><main>{page}</main></body>") == whole
    assert html.extract(f"<body><main><h1>Title</h1><p>intro</p><article>{bulk}</article><p>closing</p></main></body>") == whole
    assert html.extract(f"<body><article><h1>Title</h1><p>intro</p><article>{bulk}</article><p>closing</p></article><p>outside</p></body>") == whole
    items = "".join(f"<li>Entry {i}, of a long list, with words.</li>" for i in range(30))
    entries = " ".join(f"Entry {i}, of a long list, with words." for i in range(30))
    assert html.extract(f"<body><div><h1>Title</h1><p>What the list holds, in short.</p><ul>{items}</ul><p>closing</p></div></body>") == f"Title What the list holds, in short. {entries} closing"


@pytest.mark.parametrize("attributes", ['href="/the-hidden-valley"', 'title="A hidden gem"', "title='class=ad'", "href=/x?id=related&hidden", 'data-hidden="false"', 'data-id="related"', 'x-class = "ad" data-role=menu', 'title="say id=comments" lang=en', "data-x=hidden", 'title="" hidden-at="5"'])
def test_html_reads_no_attribute_inside_another(attributes):
    assert html.extract(f"<body><div {attributes}><p>Some words, and <a {attributes}>linked ones</a>, go on.</p></div></body>") == "Some words, and linked ones, go on."


@pytest.mark.parametrize("attributes", ["hidden", 'HIDDEN=""', 'title="x"hidden', "title=x hidden", 'data-id="a" id="related"', "class = 'ad'", "id=comments", 'aria-hidden="true"', "lang=en style='color:red; display : none'", 'role="navigation"', 'title="a > b" class="ad"'])
def test_html_still_leaves_out_what_its_own_attributes_name(attributes):
    assert html.extract(f"<body><p>Some words, and more, go on.</p><div {attributes}><p>Left out, as it says.</p></div><p>And an end.</p></body>") == "Some words, and more, go on. And an end."


@pytest.mark.parametrize("head", ['<header class="entry-header"><h1>Title</h1></header>', '<div class="post-header"><h1>Title</h1></div>', "<header><h1>Title</h1></header>", '<h1 class="social">Title</h1>'])
def test_html_keeps_titles_and_named_paragraphs(head):
    body = "".join(f'<p class="{c}">A paragraph named so, with words, marks, and more of them.</p>' for c in ("social", "tags", "copyright-law", "x"))
    text = " ".join(["Title"] + ["A paragraph named so, with words, marks, and more of them."] * 4)
    for tag in ("article", "div"):
        assert html.extract(f"<body><nav>Menu</nav><{tag}>{head}{body}<p class='copyright'>(c)</p><div class='share'><p>Share it</p></div></{tag}><footer>Legal</footer></body>") == text


WRAPPERS = "page has-sidebar|content-with-sidebar|layout sidebar-right|no-sidebar|hentry tag-economy category-news|col header-fixed|wrapper menu-open|single comments-open|article ad-free|share-price-report|related-work|section discussion|form-wrapper|sidebar|comments|siteHeader".split("|")
PARAGRAPHS = "".join(f"<p>Paragraph {i} of the article, with words, and marks. It goes on, and on.</p>" for i in range(6))
ARTICLE = " ".join(f"Paragraph {i} of the article, with words, and marks. It goes on, and on." for i in range(6))
COMMENTS = "".join(f"<p>Comment {i} that somebody wrote, with words. And more, of it, too.</p>" for i in range(14))


@pytest.mark.parametrize("name", WRAPPERS)
def test_html_keeps_pages_with_named_wrappers(name):
    assert html.extract(f'<body><nav>Menu</nav><div class="{name}"><h1>Title</h1>{PARAGRAPHS}</div><footer>x</footer></body>') == f"Title {ARTICLE}"
    inside = '<div class="comment-list"><p>Nice, I like it.</p><p>Me too.</p></div><div id=sidebar><p>Read also, this.</p></div>'
    assert html.extract(f'<body><div class=top><a href=x>Home</a> <a href=y>News</a></div><div class="{name}">{PARAGRAPHS}{inside}</div><div class="site-footer">Legal, c.</div></body>') == ARTICLE


def test_html_forms_comments_headers_and_inline_marks():
    assert html.extract(f"<body><form><h1>Title</h1>{PARAGRAPHS}</form></body>") == f"Title {ARTICLE}" and html.extract(f"<body><form>{PARAGRAPHS}</form></body>") == ARTICLE
    for page in (f'<div class=post>{PARAGRAPHS}</div><div class="comments">{COMMENTS}</div>', f'<div>{PARAGRAPHS}<div id="comments">{COMMENTS}</div></div>', f'<article>{PARAGRAPHS}<section class="comments-area">{COMMENTS}</section></article>'):
        assert html.extract(f"<body>{page}</body>") == ARTICLE  # comments longer than the article
    assert html.extract(f"<body><div><header><h1>Title</h1></header>{PARAGRAPHS}</div></body>") == f"Title {ARTICLE}"
    assert html.extract(f"<body><div id=page><header><h1>Site</h1></header><div id=c>{PARAGRAPHS}</div></div></body>") == ARTICLE
    assert html.extract("<p>super<wbr>cali fra<img src=x>gil</p>") == "supercali fragil"
    assert html.extract('<body><div class="ad">Buy this thing.\nNow, please.</div><article><h1>Ah.</h1><p><b>Ah.<br></article></body>') == "Ah. Ah."


def plain_top(parts):
    """The element whose texts' distances from the threshold add up highest, each sum made anew from the definition."""
    full = [x for x in parts if x[3]]
    paths = [x[0].path for x in full]
    ratio = {}
    for p in set(paths):
        own = [x for x in full if x[0].path == p]
        n, size = len(own), sum(x[3] for x in own)
        ratio[p] = size / n * (1 + sum(len(html.PUNCTUATION.findall(x[2])) for x in own) / n) * (1 - sum(x[4] for x in own) / size)
    weight = []
    for x in full:
        w, e = 1.0, x[0]
        while e is not None:
            w, e = w * e.factor, e.up
        weight.append(w)
    near = [[(np.exp(-((d / html.SIGMA) ** 2) / 2), i + d) for d in range(-2, 3) if 0 <= i + d < len(full) and weight[i + d] == weight[i]] for i in range(len(full))]
    smooth = [weight[i] * sum(g * ratio[paths[j]] ** 0.5 for g, j in x) / sum(g for g, _ in x) for i, x in enumerate(near)]
    mean = sum(s * x[3] for s, x in zip(smooth, full)) / sum(x[3] for x in full)
    fused = {p: np.mean([s for s, q in zip(smooth, paths) if q == p]) for p in set(paths)}
    best = {}
    for x in full:
        links = sum(y[4] for y in full if y[1] == x[1]) >= html.COVER * sum(y[3] for y in full if y[1] == x[1])
        gain, e = -mean if links else 0 if x[4] else min(fused[x[0].path], mean) - html.THRESHOLD * mean, x[0]
        while e is not None:
            best.setdefault(id(e), [e, 0.0])[1] += gain
            e = e.up
    return max(best.values(), key=lambda x: (round(x[1], 9), x[0].depth))[0]


def test_html_container_against_the_definition():
    rng = random.Random(8)

    def piece(depth):
        kind = rng.random()
        if depth > 3 or kind < 0.4:
            return "<p>" + " ".join(rng.choice(["word", "more, of it.", "<a href=x>link</a>", "a longer piece of text, with marks."]) for _ in range(rng.randrange(1, 9))) + "</p>"
        name = rng.choice(["div", "section", 'div class="sidebar"', 'div class="related-work"', "ul", "form", "header"])
        return f"<{name}>" + "".join(piece(depth + 1) for _ in range(rng.randrange(4))) + f"</{name.split()[0]}>"

    for _ in range(300):
        parts = html.blocks("<body>" + "".join(piece(0) for _ in range(rng.randrange(1, 6))) + "</body>")
        top = html.content(parts)[0]
        assert top is (plain_top(parts) if any(x[3] for x in parts) else None)


def test_html_names_do_not_decide(spark):
    """With neutral names for its elements and classes, the text of every page stays."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    neutral = [p.replace('class="ad"', 'class="k1"').replace("<nav>", "<div>").replace("</nav>", "</div>").replace("<footer", "<div").replace("</footer", "</div").replace("<article", "<div").replace("</article", "</div") for p in pages]
    assert sum(html.extract(a) != html.extract(b) for a, b in zip(pages, neutral)) <= 0


def test_html_pages(spark):
    deep = "<div>" * 50_000 + "<p>deep, text.</p>"
    rows = [(1, "u", None, "a"), (2, None, "", "b"), (None, "u", "<p>one &lt; two</p><p> 3\n4</p>", "c"), (4, "u", deep, "d"), (4, "u", deep, "d"), (5, "u", "<b>" * 20_000 + "x", "e")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html.extract_pages(df).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "u", "one < two 3 4", 13), (4, "u", "deep, text.", 11), (4, "u", "deep, text.", 11), (5, "u", "x", 1)], key=str)
    assert html.extract_pages(df.limit(0)).count() == 0


def test_line_dedup(spark, edge, empty):
    line = "a passage of seven words right here"
    rows = [(1, f"start\n{line}\nend"), (2, f"{line.upper()}\nother"), (3, f"x\n{line}"), (4, None), (5, f"Own. {line.title()}. No! Own words. Yes."), (6, "no! \n yes. Own"), (7, f"{line}\n"), (7, "two texts of one id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for counters in (1, 1024):  # with a split of frequent digests and without
        got = {(r["doc_id"], r["text"], str([tuple(s) for s in r["removed_spans"]])) for r in line_dedup.dedup_lines(spark, df, min_words=5, counters=counters).collect()}
        n = len(line)
        assert got == {(1, rows[0][1], "[]"), (2, "other", f"[(0, {n + 1})]"), (3, "x\n", f"[(2, {2 + n})]"), (4, None, "[]"), (5, rows[4][1], "[]"), (6, rows[5][1], "[]"), (7, "", f"[(0, {n + 1})]"), (7, rows[7][1], "[]")}
    assert line_dedup.dedup_lines(spark, spark.createDataFrame([(1, "One two three. Four five.\nOwn"), (2, "a\none  two THREE. four five.\n\nb")], "doc_id long, text string"), min_words=5).where("doc_id = 2").first()["text"] == "a\n\n\nb"
    every = {(r["doc_id"], r["text"]): r["text"] for r in line_dedup.dedup_lines(spark, spark.createDataFrame([(1, "a b\na b\nc"), (2, "x\nA  b\nc. y"), (3, "c\n\nd")], "doc_id long, text string")).collect()}
    assert set(every.values()) == {"a b\nc", "x\nc. y", "\nd"}  # a unit keeps its mark, so that `c.` isn't `c`; a last line without break ends like one with it
    got = {(r["doc_id"], len(r["text"] or ""), len(r["removed_spans"])) for r in line_dedup.dedup_lines(spark, edge).collect()}
    whole = len(EDGE[4][1])
    assert got == {(1, 0, 0), (2, 0, 0), (3, 0, 1), (None, 4, 0), (5, whole, 0), (6, 0, 1), (7, 7, 0), (8, 300_000, 0)} and line_dedup.dedup_lines(spark, edge).count() == len(EDGE)
    assert line_dedup.dedup_lines(spark, empty).count() == 0 and line_dedup.dedup_lines(spark, edge).columns == [*edge.columns, "removed_spans"]


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (2, 0, "assistant", "x"), (3, 0, "System ", "s"), (3, 1, "tool", "t"), (3, 2, "assistant", None), (None, None, None, None)]
    got = defaultdict(list)
    for r in chat.repair(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), block=2).orderBy("out_turn", "part").collect():
        got[r["conv_id"]].append((r["out_turn"], r["action"], r["role"]))
    assert got[1] == [(0, "keep", "user"), (0, "merge", "user"), (1, "keep", "assistant")]
    assert got[3] == [(0, "keep", "system"), (1, "relabel", "user"), (2, "keep", "assistant")]
    assert got[2] == [(0, "insert", "user"), (1, "keep", "assistant")]


def test_chat_edges(spark, edge, empty):
    names = dict(conv="source", turn="row", role="lang", text="text")
    assert chat.repair(spark, empty, **names).count() == 0
    got = chat.repair(spark, edge, **names)
    assert got.where("action <> 'insert'").count() == len(EDGE) and got.where("text is null and action <> 'insert'").count() == 1
    rows = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", "x" * 300_000), (1, None, "system", "s")]
    out = chat.repair(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("out_turn", "part").collect()
    assert "".join(r["rendered"] for r in out) == f"<|system|>\ns<|end|>\n<|user|>\nq\n\nq<|end|>\n<|assistant|>\n{'x' * 300_000}"


def test_chat_repair_does_not_depend_on_blocks(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool"]), f"{c}-{t}") for c in range(40) for t in range(rng.randrange(1, 14))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = []
    for block in (1, 3, 2048):
        out = defaultdict(list)
        for r in chat.repair(spark, df, block=block).orderBy("conv_id", "out_turn", "part").collect():
            out[r["conv_id"]].append((r["out_turn"], r["turn"], r["action"], r["role"], r["rendered"]))
        got.append(out)
    assert got[0] == got[1] == got[2]


def cheapest(roles):
    """The least cost of any legal repair, by trying every role for every turn."""
    best = {chat.START: 0}
    for given in roles:
        new = {}
        for state, cost in best.items():
            for role in (chat.SYSTEM, chat.USER, chat.ASSISTANT):
                price = cost + chat.RELABEL * (role != given)
                ways = [price + chat.MERGE] if role == state else []
                for first in ((), (chat.USER,), (chat.ASSISTANT,), (chat.USER, chat.ASSISTANT), (chat.ASSISTANT, chat.USER)):
                    turns = [state, *first, role]
                    if all(y in chat.NEXT[x] for x, y in zip(turns, turns[1:])):
                        ways.append(price + chat.INSERT * len(first))
                for way in ways:
                    new[role] = min(new.get(role, way), way)
        best = new
    return min(c + {chat.SYSTEM: 2, chat.USER: 1, chat.ASSISTANT: 0, chat.START: 0}[s] * chat.INSERT for s, c in best.items())


def test_chat_blocks_equal_whole():
    rng = random.Random(4)
    for n in range(600):
        roles = [rng.randrange(4) for _ in range(rng.randrange(1, 14))]
        whole = chat.trace(roles, chat.START, chat.chain_blocks([chat.measure_block(roles)[:2]])[0][1], True)
        for size in (1, 3, 5):
            blocks = [roles[i : i + size] for i in range(0, len(roles), size)]
            ways = chat.chain_blocks([chat.measure_block(b)[:2] for b in blocks])
            steps = [(i + size * k if i >= 0 else -1, action, role) for k, (b, (x, y)) in enumerate(zip(blocks, ways)) for i, action, role in chat.trace(b, x, y, k == len(blocks) - 1)]
            assert steps == whole
        turns = [role for _, action, role in whole if action != "merge"]
        assert turns[-1] == chat.ASSISTANT and all(b in chat.NEXT[a] for a, b in zip([chat.START, *turns], turns))
        given = [(role, action) for i, action, role in whole if i >= 0]
        cost = sum((r != o) * chat.RELABEL + (a == "merge") * chat.MERGE for (r, a), o in zip(given, roles)) + chat.INSERT * sum(i < 0 for i, _, _ in whole)
        assert cost == cheapest(roles)


def test_pipeline(spark, sf):
    """The last stage's documents against a plain version of the first three stages; each mixed document at most twice."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect())
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")]
    best = {}
    for i, t in rows:
        key = t.encode().lower()
        best[key] = max(best.get(key, (i, t)), (i, t))
    kept = list(best.values())
    found = brute_components(kept, 5, 4, 5)
    alive = {i for i, (_, c) in found.items() if i == c}
    assert set(got) <= alive and max(got.values()) <= 2
    words = {i: len(t.encode().split()) for i, t in kept if i in alive}
    total = sum(words.values())
    assert abs(sum(words[i] * n for i, n in got.items()) - 1.5 * total) < 0.02 * total
