"""Main-text extraction by a tree-structured graphical model.

A page becomes a tree of its block elements. Every node has a hidden label, content or not, with a
potential from its own features (tag, class and id names, length, link density, punctuation), and
every edge one from the labels of parent and child. Sum-product messages go up and then down the
tree, over all pages of a chunk at once and a depth at a time; a node's text is kept if its
marginal of content is at least one half.

The potentials are counted on labelled pages: a bounded sample of the table's own pages whose
markup says what it is (article, nav, footer, ...), and for each of them a page with the same article
text under other common markup, with menus, notices, forms, comments and so on around it.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks

#: Labelled pages to train on, at most: the smallest hashes of the page's address.
TRAIN_PAGES = 300
#: Characters that such a page has at most, so that the sample is bounded.
TRAIN_CHARS = 200_000
ALPHA = 0.5
#: Pages made from each article, under markup that the table may lack.
VARIANTS = 6
#: HTML's element kinds.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
BARRIER = frozenset("table td th article section div body".split())
#: Words of class and id names by what they hold.
NEGATIVE = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form gdpr header login menu masthead meta nav navbar navigation newsletter notice pagination popup privacy promo promoted recommended related reply responses search share sharing sidebar signup site skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget".split())
POSITIVE = frozenset("article articlebody body content entry main page post story text".split())
KNOWN_TAGS = "html body div section article main header footer nav aside form p h1 h2 h3 h4 h5 h6 ul ol li table tr td th dl dt dd blockquote pre figure figcaption details summary dialog button select option fieldset address center menu".split()
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>]).*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
#: What stands between a tag's name and its >: a quote opens a string right after = only, and if it is closed.
STRING = r"""=\s*+(?:"[^"]*+"|'[^']*+')"""
ATTRIBUTES = re.compile(rf"(?:[^>=]++|{STRING}|=)*+", re.S)
STRINGS = re.compile(STRING, re.S)
#: Elements removed with what they hold, if they end; without an end tag they are as any other.
REMOVED = {name: re.compile(rf"</{name}\s*>", re.I) for name in "noscript template textarea title svg iframe select head".split()}
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
LABEL = re.compile(r'data-y="([01])"')
ENDS = re.compile(r"[.!?…。！？]")
TAG_NUMBER = {t: i for i, t in enumerate(KNOWN_TAGS)}
N_TAGS = len(KNOWN_TAGS) + 1
#: Feature families and their sizes.
FAMILIES = (N_TAGS, 2, 2, 8, 5, 3, 6)


class TagEnds:
    """Where tags end, in time linear in the page: what a scan without an end has passed isn't scanned again."""

    def __init__(self, html: str) -> None:
        self.html, self.last, self.dead = html, html.rfind(">"), []

    def after(self, at: int) -> int:
        """The place after the > of a tag whose name ends at a place, or -1 if it has none."""
        if at > self.last:
            return -1
        for start, begins, closes in self.dead:  # outside that scan's strings a scan from here would go the same way
            k = bisect_right(begins, at) - 1
            if at >= start and (k < 0 or at >= closes[k]):
                return -1
        end = ATTRIBUTES.match(self.html, at).end()
        if end < len(self.html):
            return end + 1
        strings = [m.span() for m in STRINGS.finditer(self.html, at)]
        self.dead.append((at, [a for a, _ in strings], [b for _, b in strings]))
        return -1


class Trees:
    """The nodes of several pages, in page order, and the runs of text that belong to them."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.tag: list[int] = []
        self.names: list[int] = []
        self.chars: list[int] = []
        self.linked: list[int] = []
        self.ends: list[int] = []
        self.label: list[int] = []
        self.runs: list[tuple[int, int, str]] = []  # page, node, text

    def node(self, parent: int, tag: str, attributes: str) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(TAG_NUMBER.get(tag, N_TAGS - 1))
        names = 0
        if "=" in attributes:
            for m in NAMES.findall(attributes):
                words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(m)).lower()))
                names |= bool(words & NEGATIVE) | 2 * bool(words & POSITIVE)
        self.names.append(names)
        label = LABEL.search(attributes) if "data-y" in attributes else None
        self.label.append(int(label[1]) if label else -1)
        for counts in (self.chars, self.linked, self.ends):
            counts.append(0)
        return len(self.parent) - 1

    def add(self, page: int, html: str) -> None:
        """Parses a page: block elements become nodes, text between their borders runs."""
        stack = [("#root", self.node(-1, "html", ""))]
        inside: Counter[str] = Counter()  # how often each name is open

        def close(i):
            inside.subtract(name for name, _ in stack[i:])
            del stack[i:]

        pending: list[str] = []
        linked = in_link = 0

        def flush():
            nonlocal linked
            if pending:
                text = " ".join(unescape("".join(pending)).split())
                pending.clear()
                if text:
                    at = stack[-1][1]
                    self.runs.append((page, at, text))
                    self.chars[at] += len(text)
                    self.linked[at] += min(linked, len(text))
                    self.ends[at] += len(ENDS.findall(text))
                linked = 0

        last = at = 0
        endless = set()
        ends = TagEnds(html)
        while m := TOKEN.search(html, at):
            start, end = m.span()
            attributes = ""
            if m[3] is not None:
                end = ends.after(end)
                if end < 0:  # no tag: its text is text
                    at = start + 1
                    continue
                attributes = html[m.end() : end - 1]
            if start > last:
                text = html[last:start]
                pending.append(text)
                if in_link:
                    linked += len(text)
            last = at = end
            if m[3] is None:
                continue
            name = m[3].lower()
            if name in ("svg", "math") and attributes.endswith("/"):
                continue
            if name in REMOVED and not m[2] and name not in endless:
                if end := REMOVED[name].search(html, last):
                    last = at = end.end()
                    continue
                endless.add(name)
            if name in INLINE:
                if name == "a":
                    in_link = not m[2]
                continue
            if name == "br" or name in VOID:
                pending.append(" ")
                continue
            flush()
            in_link = 0
            if m[2]:
                for i in range(len(stack) - 1, 0, -1) if inside[name] > 0 else ():
                    if stack[i][0] == name:
                        close(i)
                        break
                    if stack[i][0] in ("article", "body") and name in ("p", "li", "div"):
                        break
                continue
            closed = CLOSES.get(name) or ({"p"} if name in CLOSES_P else ())
            for i in range(len(stack) - 1, 0, -1) if any(inside[x] > 0 for x in closed) else ():
                if stack[i][0] in closed:
                    close(i)
                    break
                if stack[i][0] in BARRIER or stack[i][0] in ("ul", "ol", "dl"):
                    break
            stack.append((name, self.node(stack[-1][1], name, attributes)))
            inside[name] += 1
        if last < len(html):
            pending.append(html[last:])
        flush()


class ContentModel:
    """Potentials of nodes and edges; a few hundred numbers."""

    def __init__(self) -> None:
        self.counts = [np.full((2, n), ALPHA) for n in FAMILIES]
        self.edges = np.full((2, 2), ALPHA)
        self.root = np.full(2, ALPHA)

    @staticmethod
    def features(t: Trees) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
        parent, depth = np.array(t.parent, np.int64), np.array(t.depth, np.int64)
        by_depth = np.argsort(depth, kind="stable")
        levels = np.split(by_depth, np.searchsorted(depth[by_depth], np.arange(1, int(depth.max(initial=0)) + 1)))[1:]
        chars, linked, ends = (np.array(x, np.float64) for x in (t.chars, t.linked, t.ends))
        own = chars.copy()
        for level in reversed(levels):
            for x in (chars, linked, ends):
                np.add.at(x, parent[level], x[level])
        names = np.array(t.names, np.int64)
        density = linked / np.maximum(chars, 1)
        size = lambda x, top: np.minimum(np.log2(1 + x).astype(np.int64) // 2, top)
        found = [
            np.array(t.tag, np.int64),
            names & 1,
            names >> 1,
            size(chars, 7),
            np.where(chars == 0, 4, np.searchsorted([0.05, 0.3, 0.7], density)),
            np.where(chars == 0, 2, ends > 0),
            size(own, 5),
        ]
        return found, parent, levels

    def learn(self, t: Trees) -> None:
        """Counts the features and edges of labelled trees; a node without a label takes its parent's."""
        found, parent, _ = self.features(t)
        y = np.zeros(len(parent), np.int64)
        for i, label in enumerate(t.label):
            y[i] = label if label >= 0 else (y[parent[i]] if parent[i] >= 0 else 0)
        for counts, f in zip(self.counts, found):
            np.add.at(counts, (y, f), 1)
        inner = parent >= 0
        np.add.at(self.edges, (y[parent[inner]], y[inner]), 1)
        np.add.at(self.root, y[~inner], 1)

    def marginals(self, t: Trees) -> np.ndarray:
        """P(content) of every node: messages to the parents from the deepest level up, then back down."""
        found, parent, levels = self.features(t)
        up = np.zeros((len(parent), 2))
        for counts, f in zip(self.counts, found):
            up += np.log(counts / counts.sum(1, keepdims=True))[:, f].T
        edge = np.log(self.edges / self.edges.sum(1, keepdims=True))
        up[parent < 0] += np.log(self.root / self.root.sum())
        message = np.zeros_like(up)
        for level in reversed(levels):
            message[level] = np.logaddexp(edge[:, 0] + up[level, :1], edge[:, 1] + up[level, 1:])
            np.add.at(up, parent[level], message[level])
        belief = up.copy()
        for level in levels:
            outside = belief[parent[level]] - message[level]
            belief[level] += np.logaddexp(outside[:, :1] + edge[0], outside[:, 1:] + edge[1])
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))


_AROUND = (
    ('<header class="site-header"{n}><a href="/">{a}</a><p>{b}</p></header>', '<div class="menu"{n}><ul><li><a href="#">{a}</a></li><li><a href="#">{b}</a></li></ul></div>', '<nav{n}><a href="#">{a}</a> <a href="#">{b}</a></nav>', '<div id="cookie-notice"{n}><p>{a}. {b}.</p><button>{a}</button></div>', '<div class="ad"{n}>{a}. {b}.</div>'),
    ('<div class="sidebar"{n}><h3>{a}</h3><ul><li><a href="#">{b}</a></li></ul><p>{b}.</p></div>', '<aside{n}><h3>{b}</h3><p>{a}. {b}.</p></aside>', '<section id="comments" class="comments"{n}><h2>{a}</h2><div class="comment"><p>{b}. {a}.</p></div><div class="comment"><p>{a}. {b}.</p></div></section>', '<form action="/s"{n}><label>{a}</label><p>{b}.</p></form>', '<footer{n}><p>{a}. {b}.</p></footer>', '<div class="related"{n}><h3>{a}</h3><a href="#">{b}</a></div>', '<div class="newsletter"{n}><p>{a}. {b}.</p></div>', '<div class="share"{n}><a href="#">{a}</a></div>', '<div class="ad"{n}><p>{a}. {b}.</p></div>'),
)
_HOLDERS = ('<article{y}>{x}</article>', '<main{y}>{x}</main>', '<div class="content"{y}>{x}</div>', '<div id="post-body"{y}>{x}</div>', '<section class="story"{y}>{x}</section>', '<div class="entry"{y}><header{y}><h1>{h}</h1></header>{x}</div>', '<div{y}>{x}</div>')


def _variants(blocks: list[str], rng: random.Random) -> list[str]:
    """Pages with a known answer around one article's blocks."""
    if not blocks:
        return []
    words = " ".join(blocks).split() or ["text"]
    phrase = lambda: " ".join(rng.choices(words, k=rng.randrange(1, 12)))
    made = []
    for _ in range(VARIANTS):
        body = "".join(f"<p>{b}</p>" if rng.random() < 0.9 else f"<ul><li>{b}</li></ul>" for b in blocks)
        body = f"<h1>{phrase()}</h1>" * rng.randrange(2) + body
        if rng.random() < 0.3:
            body += rng.choice(_AROUND[1]).format(n=' data-y="0"', a=phrase(), b=phrase())
        holder = rng.choice(_HOLDERS).format(y=' data-y="1"', x=body, h=phrase())
        around = [[x.format(n=' data-y="0"', a=phrase(), b=phrase()) for x in rng.sample(kinds, rng.randrange(2, len(kinds) + 1))] for kinds in _AROUND]
        inner = "".join(around[0]) + holder + "".join(around[1])
        made.append(f'<html><body data-y="0">{f"<div id=wrapper>{inner}</div>" if rng.random() < 0.5 else inner}</body></html>')
    return made


def _labelled(html: str) -> str | None:
    """A page whose own markup tells: one article or main element outside which nothing is content."""
    if len(re.findall(r"<(?:article|main)\b", html, re.I)) != 1:
        return None
    marked = re.sub(r"<(article|main)\b", r'<\1 data-y="1"', html, flags=re.I)
    return re.sub(r"<(nav|footer|aside|form|body)\b", r'<\1 data-y="0"', marked, flags=re.I)


_FALLBACK = ["The first paragraph tells what happened, where, and when.", "A second one goes on for a while. It has more than one sentence, as prose does.", "Short end."]


def train(pages: DataFrame, url_col: str = "url", html_col: str = "html", limit: int = TRAIN_PAGES, most_chars: int = TRAIN_CHARS) -> ContentModel:
    """Counts potentials on at most `limit` labelled pages of the table, each of under `most_chars`, and on pages made from their articles.

    What reaches the driver is that bounded sample. If no page labels itself, only built-in text is used.
    """
    rng, t = random.Random(17), Trees()
    sample = pages.select(F.col(html_col).alias("html"), F.xxhash64(F.col(url_col), F.col(html_col)).alias("h"))
    tells = sample.where(F.col("html").rlike(r"(?i)<(article|main)\b") & (F.length("html") < most_chars))
    # hashes alone are ordered, as every task sends its first ones; then the pages of those are fetched
    least = [r.h for r in tells.select("h").distinct().orderBy("h").limit(limit).collect()]
    rows = tells.where(F.col("h").isin(least)).dropDuplicates(["h"]).orderBy("h").collect() if least else []
    articles = [_FALLBACK] * 3
    for row in rows:
        marked = _labelled(row.html)
        if marked is None:
            continue
        first = len(t.runs)
        t.add(0, marked)
        inside = lambda n: next((t.label[m] for m in _up(t, n) if t.label[m] >= 0), 0)
        articles.append([text.replace("&", "&amp;").replace("<", "&lt;") for _, n, text in t.runs[first:] if inside(n)])
    for blocks in articles:
        for page in _variants(blocks, rng):
            t.add(0, page)
    model = ContentModel()
    model.learn(t)
    return model


def _up(t: Trees, n: int):
    while n >= 0:
        yield n
        n = t.parent[n]


def extract(pages: DataFrame, model: ContentModel, columns: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The named columns of every page, its main text and n_chars (code points).

    Null and empty pages, and pages without content, get the empty text. Every row is kept, with
    repeats; an empty table gives none; other columns may have any names.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    frame = pages.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)), F.col(html_col).alias("text"))

    def run(batches):
        for batch in text_chunks(batches):
            t = Trees()
            for i, html in enumerate(batch.column("text").to_pylist()):
                t.add(i, html or "")
            kept = shared.value.marginals(t) >= 0.5
            texts: list[list[str]] = [[] for _ in range(batch.num_rows)]
            for page, node, text in t.runs:
                if kept[node]:
                    texts[page].append(text)
            done = [" ".join(x) for x in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(done, pa.string()), pa.array([len(x) for x in done], pa.int64())], [*batch.schema.names[:-1], "body", "n"])

    schema = ", ".join(f"c{i} {frame.schema[i].dataType.simpleString()}" for i in range(len(columns)))
    return frame.mapInArrow(run, f"{schema}, body string, n long").toDF(*columns, "text", "n_chars")


def op5_html_content(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train(pages))
