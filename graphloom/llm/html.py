"""Main text of web pages by tag-path ratios.

A page is cut into tags and text with a tolerant scanner; a stack of open elements gives
every text its root-to-leaf tag path. Elements that hold no text for readers, or menus and
footers by their kind, are left out. For each tag path the text length, punctuation and number of
occurrences are summed; the ratios length/occurrence and 1 + punctuation/occurrence, less the
share of linked text, are multiplied, laid out along the page and smoothed by a Gaussian window.

Names never delete. A container whose class, id or role names what is no article has
paths of its own, and their ratios count for STRONG of themselves if the name says so
outright (its last word does), or WEAK if a word of it does; forms, and headers outside the article, likewise.
What holds a main heading, an article or a main element isn't so named. As the
mean falls with them, a name around all of a page's text changes nothing.

Each text counts for every element around it by how far its path is above THRESHOLD of
the mean, or below it, and a block of links counts against it; the element with the largest sum is the article (where <article> or
<main> elements hold COVER of the text above the threshold, the one of them with most of it is
taken as such). All that is left in it is the text, but for named parts below the threshold (of
a single block with such a name, its own ratio decides): a block's white space is one space,
blocks are joined in page order.

Defined cases: null or empty html, or html without content, gives the empty text;
unclosed elements end where html lets them end, or with the page; elements may be nested to
any depth; a page without any element is text; other columns are never looked at.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import table

THRESHOLD, COVER, SIGMA = 0.25, 0.8, 1.0
#: What the ratios of containers count for that are named like what is no article, by their name's last word or by another.
STRONG, WEAK = 0.03, 0.3

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
#: One attribute after the other: name, then a value in quotes or without.
ATTRIBUTE = re.compile(r"""(=?[^\s/>=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>"'][^\s>]*)))?""")
RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template")}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var label wbr".split())
DROPPED = set("nav footer aside script style noscript head template iframe select button input textarea svg canvas object embed menu dialog audio video map datalist".split())
#: Words of a class, id or role that name a part outside the article; how such words start; words that name a part of it; words that outweigh those;
#: words that turn a name into a remark; and words that say where or how a named part lies.
BOILER = set("ad ads advert adverts adsense nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside complementary footer footers contentinfo masthead header headers cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter signup login form forms search share sharing social related comment comments commentlist respond reply replies disqus discussion pagination pager widget widgets toolbar skip tag tags copyright legal disclaimer teaser".split())
STARTS = ("advertis", "sponsor", "promo", "banner", "subscri", "recommend")
KEEP = set("article post entry main content story body page text".split())
VETO = set("ad ads advert adverts comment comments sidebar side footer foot nav navigation menu".split())
REMARK = set("no not non has have with without free is hide hidden".split())
PLACE = set("left right top bottom first last primary secondary wrapper wrap box container area block section inner outer list item items holder panel bar group region col column row slot unit module zone count".split())
#: Elements that show that what holds them isn't what its name says.
MAIN = set("h1 article main".split())
#: Elements that are a single block of text, or less.
SINGLE = INLINE | set("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption".split())
#: Elements that no class leaves out.
KEPT = set("article main h1 h2 h3 h4 h5 h6".split())
#: Opening one of these closes an open one of those, up to the nearest of the last.
CLOSES = {"p": ({"p"}, {"td", "th", "li", "div", "article", "section", "blockquote", "body", "table", "button"}), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，！？；：、]")


class Open:
    """An element that is open: the number of its tag path, whether it is left out, what its name weighs, and whether it is a single block so named."""

    __slots__ = ("name", "path", "depth", "out", "factor", "single", "link", "article", "up", "blocks", "weight")

    def __init__(self, name, up, out, factor, article, paths):
        self.name, self.up, self.out, self.article, self.blocks = name, up, out, article, 0
        alone = factor < 1 and name in SINGLE
        self.factor = 1.0 if alone else factor
        self.single = alone or bool(up and up.single)
        self.path = paths.setdefault((up.path, name, len(paths) if self.factor < 1 else None), len(paths) + 1) if up else 0
        self.depth = up.depth + 1 if up else 0
        self.link = name == "a" or bool(up and up.link)
        self.weight = None


def words_of(value: str) -> list[str]:
    return [w for w in re.split(r"[\s_-]+|\d+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()) if w]


def boilerplate(word: str) -> bool:
    return word in BOILER or word.startswith(STARTS)


def named(value: str) -> float:
    """The factor of a class, an id or a role."""
    least, all_words = 1.0, set(words_of(value))
    if all_words & KEEP and not all_words & VETO:
        return least
    for name in value.split():
        words = words_of(name)
        if not any(map(boilerplate, words)) or REMARK & set(words):
            continue
        while len(words) > 1 and words[-1] in PLACE:
            words.pop()
        least = min(least, STRONG if boilerplate(words[-1]) else WEAK)
    return least


def judged(name: str, attributes: str, up: Open) -> tuple[bool, float]:
    """(left out, what the element's ratios count for)."""
    if name in DROPPED or up.out:
        return True, 1.0
    factor = STRONG if name == "form" or name == "header" and not up.article else 1.0
    if attributes and name not in ("html", "body"):
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), next(filter(None, values), "")
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return True, 1.0
            if key in ("class", "id", "role") and name not in KEPT:
                words = set(words_of(value))
                factor = 1.0 if name == "header" and words & KEEP and not words & VETO else min(factor, named(value))
    return False, factor


def blocks(page: str) -> list[tuple[Open, int, str, int, int]]:
    """(element, block, text, length, linked length) of every text that isn't left out, in page order."""
    paths: dict[tuple[int, str], int] = {}
    root = Open("", None, False, 1.0, False, paths)
    stack, found, block, at = [root], [], 0, 0
    here = root

    def text(raw: str):
        if raw and not here.out:
            found.append((here, block, entities.unescape(raw)))

    while at < len(page):
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    here = stack[-1]
                    break
                if name in INLINE and stack[i].name not in INLINE:
                    break
            block += name not in INLINE
            continue
        if name not in INLINE:
            if name != "br":
                block += 1
            if name in ENDS_P:
                close(stack, {"p"}, CLOSES["p"][1])
            if name in CLOSES:
                close(stack, *CLOSES[name])
            here = stack[-1]
        if name == "br":
            text(" ")
        if name in VOID or m[3].endswith("/") and name not in RAW:
            continue
        if name in RAW:
            end = RAW[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        here.blocks += name == "p"
        here = Open(name, here, *judged(name, m[3], here), here.article or name in ("article", "main"), paths)
        stack.append(here)
        if name in MAIN:
            unnamed(here)
    out = []
    for e, b, t in found:
        size = len("".join(t.split()))
        out.append((e, b, t, size, size if e.link else 0))
    return out


def unnamed(e: Open) -> None:
    """Clears the names of what is around a main heading, an article or a main element, but for a page's header."""
    heading, e = e.name == "h1", e.up
    while e is not None and not (heading and e.name == "header"):
        e.factor = 1.0
        e = e.up


def weigh(e: Open) -> float:
    """The product of the factors of an element and of what is around it. A header with a heading beside paragraphs is the article's."""
    chain = []
    while e is not None and e.weight is None:
        chain.append(e)
        e = e.up
    weight = e.weight if e is not None else 1.0
    for x in reversed(chain):
        if x.name == "header" and x.up.blocks and x.up.name not in ("", "html", "body"):
            x.factor = 1.0
        weight *= x.factor
        x.weight = weight
    return weight


def close(stack: list[Open], names: set[str], until: set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in names:
            del stack[i:]
            return
        if stack[i].name in until:
            return


def content(parts) -> tuple[Open | None, set[int], set[int]]:
    """The element that holds the article; the blocks that go for both their name and their ratio; the paths that do."""
    length, linked, marks, times = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for e, _, t, size, link in parts:
        if size:
            length[e.path] += size
            linked[e.path] += link
            marks[e.path] += len(PUNCTUATION.findall(t))
            times[e.path] += 1
    if not length:
        return None, set(), set()
    ratio = {p: length[p] / n * (1 + marks[p] / n) * (1 - linked[p] / length[p]) for p, n in times.items()}
    full = [x for x in parts if x[3]]
    line = [math.sqrt(ratio[x[0].path]) for x in full]
    weight = [weigh(x[0]) for x in full]
    window = [math.exp(-((i / SIGMA) ** 2) / 2) for i in range(-2, 3)]
    smooth = []
    for i in range(len(line)):
        near = [(w, line[j]) for w, j in zip(window, range(i - 2, i + 3)) if 0 <= j < len(line) and weight[j] == weight[i]]
        smooth.append(weight[i] * sum(w * v for w, v in near) / sum(w for w, _ in near))
    mean = sum(s * x[3] for s, x in zip(smooth, full)) / sum(x[3] for x in full)
    best = defaultdict(list)
    for s, x in zip(smooth, full):
        best[x[0].path].append(s)
    fused = {p: sum(s) / len(s) for p, s in best.items()}
    low = {x[1] for x, w in zip(full, weight) if x[0].single and w * math.sqrt(x[3] * (1 + len(PUNCTUATION.findall(x[2]))) * (1 - x[4] / x[3])) < THRESHOLD * mean}
    own: dict[int, list] = {}
    whole, links = defaultdict(int), defaultdict(int)
    for _, b, _, size, link in full:
        whole[b] += size
        links[b] += link
    heaviest = max(weight)
    for (e, b, _, size, link), w in zip(full, weight):  # gain, then length above the threshold of what isn't named
        sums = own.setdefault(id(e), [e, 0.0, 0])
        if links[b] >= COVER * whole[b]:
            sums[1] -= mean  # a block of links
        elif not link:
            sums[1] += min(fused[e.path], mean) - THRESHOLD * mean
        sums[2] += size * (w == heaviest and fused[e.path] >= THRESHOLD * mean)
    held = dict(own)
    for e, _, _ in list(own.values()):
        while e.up is not None and id(e.up) not in held:
            e = e.up
            held[id(e)] = [e, 0.0, 0]
    for e, gain, size in sorted(held.values(), key=lambda x: -x[0].depth):  # from the leaves up
        if e.up is not None:
            up = held[id(e.up)]
            up[1] += held[id(e)][1]
            up[2] += held[id(e)][2]
    total = max(x[2] for x in held.values())
    main = [x for x in held.values() if x[0].name in ("article", "main") and x[2] >= COVER * total]
    if main:
        top = max(main, key=lambda x: (x[2], x[0].depth))[0]
    else:
        top = max(held.values(), key=lambda x: (round(x[1], 9), x[0].depth))[0]
    return top, low, {x[0].path for x, w in zip(full, weight) if w < weigh(top) and fused[x[0].path] < THRESHOLD * mean}


def extract(page: str | None) -> str:
    """The main text of a page."""
    parts = blocks(page or "")
    top, low, gone = content(parts)
    if top is None:
        return ""
    while top.name in SINGLE:
        top = top.up  # a single block isn't the whole article
    inside = {id(top): True}
    lines: dict[int, list[str]] = {}
    for e, b, t, _, _ in parts:
        climbed, path = [], e.path
        while e is not None and id(e) not in inside:
            climbed.append(id(e))
            e = e.up
        got = e is not None and inside[id(e)]
        inside.update(dict.fromkeys(climbed, got))
        if got and b not in low and path not in gone:
            lines.setdefault(b, []).append(t)
    return " ".join(filter(None, (" ".join("".join(x).split()) for x in lines.values())))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    narrow = pages.select(pages[f"`{id_col}`"].alias("page_id"), pages[f"`{url_col}`"].alias("url"), pages[f"`{html_col}`"].alias("html"))
    kinds = dict(narrow.dtypes)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [extract(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return narrow.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
