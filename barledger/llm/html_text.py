"""Main text of web pages: boosted trees over DOM nodes, decoded as one tree.

A page is parsed into block elements and text leaves. Every node gets features of its
subtree (text, links, density of elements), its tag and attribute tokens and those above
it, its depth and its siblings. Gradient-boosted trees give each node the odds that it
holds main text. The decoding picks the most likely labelling of the whole tree in which
a node can only hold main text if its parent does, so no text is taken from a rejected
menu and no accepted paragraph hangs below a rejected ancestor.

There are no labelled pages. The trees are trained on layouts written by a rule, whose
roles are known because the rule placed them, filled with words of a bounded sample of
the pages themselves.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Pages whose words fill the training layouts, and the number of layouts.
SAMPLE_PAGES = 100
LAYOUTS = 900
TREES = 50
DEPTH = 4
BINS = 32
RATE = 0.2
NODES_AT_ONCE = 10_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*|[^<>]*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop|aria-label|name)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes svg math object select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input label".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = frozenset("ul ol dl table body html article section div main aside nav".split())

TAG_GROUPS = (
    "#text", "p", "h1 h2 h3 h4 h5 h6", "li dt dd", "ul ol dl menu dir", "div section center", "article main", "nav", "header", "footer",
    "aside", "form fieldset button legend", "table tbody thead tr td th", "blockquote pre figure figcaption", "body html",
)
_GROUP = {tag: k for k, group in enumerate(TAG_GROUPS) for tag in group.split()}
#: Attribute words by what they usually name.
TOKENS = {
    "text": "article content contents post entry main body story text page prose blog articlebody maincontent postcontent news document",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs toc tabs pagination pager skip topbar toolbar dropdown",
    "frame": "header footer masthead banner contentinfo copyright bottom top logo branding site foot head legal",
    "side": "sidebar aside side complementary widget related recommended trending rail teaser more popular tags archive",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted commercial outbrain taboola adsense",
    "notice": "cookie cookies notice consent gdpr banner alert popup modal overlay message warning disclaimer privacy dialog",
    "form": "form search login signup subscribe subscription newsletter register contact input",
    "comment": "comment comments reply replies respond discussion disqus reader commentlist feedback review reviews thread",
    "share": "share sharing social follow facebook twitter meta byline author date tag",
}
_KIND = {}
for _k, _words in enumerate(TOKENS.values()):
    for _word in _words.split():
        _KIND.setdefault(_word, []).append(_k)
N_KINDS = len(TOKENS)


class Page:
    """A parsed page: nodes in page order, each with parent, tag, kinds of attribute words and own text."""

    __slots__ = ("parent", "depth", "tag", "kinds", "text", "link_chars")

    def __init__(self, source: str):
        self.parent, self.depth, self.tag = [-1], [0], [_GROUP["body"]]
        self.kinds, self.text, self.link_chars = [()], [""], [0]
        open_tags, open_nodes = ["#root"], [0]
        run: list[str] = []
        linked, in_link = 0, 0

        def flush() -> None:
            nonlocal run, linked
            if run:
                text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
                if text:
                    self._add(open_nodes[-1], _GROUP["#text"], (), text, min(linked, len(text)))
                run, linked = [], 0

        at, end = 0, len(source)
        while at < end:
            match = _TOKEN.search(source, at)
            piece = source[at : match.start() if match else end]
            if piece:
                run.append(piece)
                if in_link:
                    linked += len(piece)
            if not match:
                break
            at = match.end()
            name = match[2]
            if not name:
                if match[0].startswith("<![CDATA["):
                    run.append(html.escape(match[0][9:-3]))
                continue
            name = name.lower()
            if match[1]:
                if name == "a":
                    in_link = 0
                if name in INLINE:
                    continue
                flush()
                if name in open_tags:
                    while open_tags.pop() != name:
                        open_nodes.pop()
                    open_nodes.pop()
                in_link = 0
                continue
            if name in RAW:
                if name in ("svg", "math", "object", "template", "noscript", "select"):
                    flush()
                if not match[3].rstrip().endswith("/"):
                    close = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
                    at = close.end() if close else end
                continue
            if name == "a":
                in_link = 1
            if name in INLINE and name != "br":
                continue
            flush()
            if name in VOID:
                continue
            if name in CLOSES_P or name in LIKE:
                ends = LIKE.get(name, set()) | ({"p"} if name in CLOSES_P or name == "li" else set())
                for k in range(len(open_tags) - 1, 0, -1):
                    if open_tags[k] in ends:
                        del open_tags[k:], open_nodes[k:]
                        break
                    if open_tags[k] in BARRIER and open_tags[k] not in ends:
                        break
            if name in ("html", "body") and name in open_tags:
                continue
            kinds: list[int] = []
            if "=" in match[3]:
                for found in _ATTRIBUTE.finditer(match[3]):
                    for word in _WORD.findall(_CAMEL.sub(" ", found[1] or found[2] or found[3] or "").lower()):
                        kinds += _KIND.get(word, ())
            in_link = 0
            open_nodes.append(self._add(open_nodes[-1], _GROUP.get(name, len(TAG_GROUPS)), tuple(set(kinds)), "", 0))
            open_tags.append(name)
        flush()

    def _add(self, parent: int, tag: int, kinds: tuple, text: str, link_chars: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.kinds.append(kinds)
        self.text.append(text)
        self.link_chars.append(link_chars)
        return len(self.parent) - 1


N_TAGS = len(TAG_GROUPS) + 1


class Forest:
    """Many pages' nodes in one set of arrays; each page's root is its own parent."""

    def __init__(self, pages: list[Page]):
        size = np.array([len(p.parent) for p in pages], np.int64)
        self.pages = pages
        self.first = np.cumsum(size) - size
        self.root = np.repeat(self.first, size)
        self.parent = np.fromiter((x for p in pages for x in p.parent), np.int64, int(size.sum())) + self.root
        self.parent[self.first] = self.first
        depth = np.fromiter((x for p in pages for x in p.depth), np.int64, len(self.parent))
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 2))
        self.depth = depth
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def add_up(self, values: np.ndarray) -> None:
        """Adds every node's values to its parent's, from the leaves to the roots."""
        for level in reversed(self.levels):
            np.add.at(values, self.parent[level], values[level])

    def features(self) -> np.ndarray:
        """One row of numbers for every node."""
        pages, parent, depth = self.pages, self.parent, self.depth
        n = len(parent)
        tag = np.fromiter((x for p in pages for x in p.tag), np.int64, n)
        text = [t for p in pages for t in p.text]
        own = np.fromiter(map(len, text), float, n)
        links = np.fromiter((x for p in pages for x in p.link_chars), float, n)
        stops = np.fromiter((t.count(".") + t.count(",") + t.count("!") + t.count("?") if t else 0 for t in text), float, n)
        kinds = np.zeros((n, N_KINDS))
        for k, found in enumerate(x for p in pages for x in p.kinds):
            if found:
                kinds[k, list(found)] = 1
        above, nearest = np.zeros((n, N_KINDS)), np.eye(N_TAGS)[tag]
        for level in self.levels:
            up = parent[level]
            above[level] = np.maximum(above[up], kinds[up])
            nearest[level] = np.maximum(nearest[level], nearest[up])
        total = np.concatenate([
            np.stack([own, links, stops, own > 0, np.ones(n), tag == 1], axis=1), kinds], axis=1)
        self.add_up(total)
        size, linked, stopped, leaves, nodes, paragraphs = total[:, :6].T
        below = total[:, 6:] > 0
        child = np.ones(n, bool)
        child[self.first] = False
        children = np.bincount(parent[child], minlength=n)
        by_parent = np.argsort(np.where(child, parent, -1), kind="stable")
        group = parent[by_parent]
        begins = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.zeros(0, bool)
        begin = np.flatnonzero(begins)
        place = np.empty(n)
        place[by_parent] = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
        place[self.first] = 0
        page_size = np.maximum(size[self.root], 1)
        before = np.cumsum(own) - own
        before -= before[self.root]
        siblings = np.maximum(children[parent], 1)
        numbers = [
            np.log1p(size), np.log1p(own), linked / np.maximum(size, 1), nodes / np.log1p(size + 1), depth, size / page_size,
            size / np.maximum(size[parent], 1), place / siblings, np.log1p(siblings), np.log1p(size[parent] / siblings),
            stopped / np.maximum(size, 1), np.log1p(size / np.maximum(leaves, 1)), np.log1p(paragraphs), before / page_size,
            (before + size) / page_size, np.log1p(leaves), np.log1p(children), linked[parent] / np.maximum(size[parent], 1),
        ]
        return np.concatenate([np.stack(numbers, axis=1), np.eye(N_TAGS)[tag], nearest, kinds, above, below], axis=1).astype(np.float32)

    def main_texts(self, margin: np.ndarray) -> list[str]:
        """Each page's text under the most likely labelling in which main text has main ancestors only."""
        inside, outside = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
        chosen = np.zeros(len(margin), bool)
        for level in reversed(self.levels):
            chosen[level] = inside[level] > outside[level]
            np.add.at(inside, self.parent[level], np.maximum(inside[level], outside[level]))
            np.add.at(outside, self.parent[level], outside[level])
        chosen[self.first] = True
        for level in self.levels:
            chosen[level] &= chosen[self.parent[level]]
        out = []
        for page, first in zip(self.pages, self.first):
            keep = chosen[first : first + len(page.text)].tolist()
            out.append(" ".join(t for t, k in zip(page.text, keep) if k and t))
        return out


class Trees:
    """Gradient-boosted trees of fixed depth on binned features, with logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        levels = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(column, levels)) for column in x.T]
        binned = self._bins(x)
        used = [k for k in range(x.shape[1]) if len(self.edges[k])]
        margin = np.zeros(len(y))
        self.feature = np.zeros((TREES, 2**DEPTH - 1), np.int64)
        self.cut = np.full((TREES, 2**DEPTH - 1), BINS, np.int64)
        self.value = np.zeros((TREES, 2**DEPTH))
        for t in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            slope, bend = y - p, p * (1 - p)
            at = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                width = 2**level
                best = np.full(width, 1e-6)
                for k in used:
                    key = at * BINS + binned[:, k]
                    g = np.bincount(key, slope, width * BINS).reshape(width, BINS).cumsum(axis=1)
                    h = np.bincount(key, bend, width * BINS).reshape(width, BINS).cumsum(axis=1)
                    all_g, all_h = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
                    top = gain.argmax(axis=1)
                    better = gain[np.arange(width), top] > best
                    node = width - 1 + np.flatnonzero(better)
                    self.feature[t, node], self.cut[t, node] = k, top[better]
                    best[better] = gain[np.arange(width), top][better]
                node = width - 1 + at
                at = 2 * at + (binned[np.arange(len(y)), self.feature[t, node]] > self.cut[t, node])
            g, h = np.bincount(at, slope, 2**DEPTH), np.bincount(at, bend, 2**DEPTH)
            self.value[t] = RATE * g / (h + 1)
            margin += self.value[t][at]

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self._bins(x), np.arange(len(x))
        out = np.zeros(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                node = 2**level - 1 + at
                at = 2 * at + (binned[rows, feature[node]] > cut[node])
            out += value[at]
        return out


def layouts(words: list[str], number: int = LAYOUTS, seed: int = 7) -> Iterator[tuple[str, str]]:
    """Pages of every common shape; main text is wrapped in \\x01 ... \\x02, which become labels."""
    rng = np.random.default_rng(seed)

    def pick(*options: str) -> str:
        return options[int(rng.integers(len(options)))]

    def some(low: int, high: int) -> str:
        return " ".join(words[int(i)] for i in rng.integers(0, len(words), int(rng.integers(low, high + 1))))

    def sentences(low: int, high: int) -> str:
        return " ".join(some(3, 18).capitalize() + pick(".", ".", ".", "!", "?") for _ in range(int(rng.integers(low, high + 1))))

    def link() -> str:
        return f'<a href="/{some(1, 1)}">{some(1, 3)}</a>'

    def links(tag: str, kind: str) -> str:
        items = [link() for _ in range(int(rng.integers(2, 12)))]
        body = "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if rng.random() < 0.7 else pick(" | ", " ", " &middot; ").join(items)
        return f"<{tag}{kind}>{body}</{tag}>"

    def named(*options: str) -> str:
        if rng.random() < 0.12:
            return ""
        return f' {pick("class", "class", "id")}="{pick(*options)}"'

    def notes() -> list[str]:
        out = []
        for _ in range(int(rng.integers(1, 4))):
            who = f"<{(w := pick('b', 'cite', 'h4', 'div'))}>{some(1, 2)}</{w}>" if rng.random() < 0.7 else ""
            tag = pick("div", "li", "article", "section")
            out.append(f'<{tag}{named("comment", "comment-body", "reply", "user-comment", "review")}>{who}<p>{sentences(1, 5)}</p></{tag}>')
        return out

    def clutter() -> str:
        kind = int(rng.integers(0, 11))
        if kind == 0:
            return links("nav", named("nav", "main-menu", "navigation"))
        if kind == 1:
            return links("div", f' class="{pick("menu", "navbar", "breadcrumbs", "nav-links", "top-menu")}"')
        if kind == 2:
            return f'<header{named("site-header", "masthead", "top")}><{(h := pick("h1", "div", "p"))}>{some(1, 6)}</{h}>{links("nav", "") if rng.random() < 0.5 else ""}</header>'
        if kind == 3:
            tag, name = pick("footer|", "footer|", "footer| class=footer", "div| id=footer", "div| class='site-footer'").split("|")
            said = pick("&copy; ", "Copyright ", "&copy; 2024 ", "") + f"{some(1, 4)}{pick(' ', ' &middot; ', ' | ')}{sentences(0, 2)}"
            return f"<{tag}{name}>{f'<p>{said}</p>' if rng.random() < 0.4 else said}{link() if rng.random() < 0.4 else ''}</{tag}>"
        if kind == 4:
            tag = pick("aside", "div")
            return f'<{tag} class="{pick("sidebar", "side-bar widget", "related-posts", "right-rail", "recommended")}"><h3>{some(1, 4)}</h3>' + (links("div", "") if rng.random() < 0.5 else f"<p>{sentences(1, 4)}</p>") + f"</{tag}>"
        if kind == 5:
            return f'<div {pick("class", "id")}="{pick("ad", "ads", "advert", "ad-banner", "sponsored", "promo", "advertisement")}">{sentences(1, 2)}</div>'
        if kind == 6:
            return f'<div {pick("class", "id")}="{pick("cookie-notice", "consent", "notice", "gdpr-banner", "alert", "popup modal", "privacy-message")}"><p>{sentences(1, 3)}</p><button>{some(1, 2)}</button></div>'
        if kind == 7:
            return f'<form{named("search", "newsletter", "login-form", "subscribe")}><label>{some(1, 3)}</label><input type="text"><p>{sentences(0, 1)}</p><button>{some(1, 2)}</button></form>'
        if kind == 8:
            head, tag = f"<h3>{some(1, 3)}</h3>", pick("section", "div")
            return f'<{tag} {pick("id", "class")}="{pick("comments", "comment-list", "discussion", "disqus_thread", "reader-comments", "replies")}">{head}{"".join(notes())}</{tag}>'
        if kind == 9:
            return f'<div class="{pick("share", "social-links", "tags", "post-meta", "byline")}">{some(1, 3)} {link()} {link()}</div>'
        return f"<aside{named('widget', 'sidebar', 'note')}>{sentences(1, 3)}</aside>"

    def block() -> str:
        kind = rng.random()
        if kind < 0.75:
            text = sentences(1, 6) if rng.random() < 0.85 else some(1, 6)
            if rng.random() < 0.25:
                at = len(text) // 2
                text = text[:at] + f"<{pick('b', 'i', 'em', 'span')}>" + text[at:] + pick("</b></i></em></span>", "")
            if rng.random() < 0.15:
                text += " " + link() + " " + sentences(0, 1)
            return f"<p>\x01{text}\x02" + pick("</p>", "</p>", "</p>", "<br>", "")
        if kind < 0.83:
            return f"<h2>\x01{some(1, 8)}\x02</h2>"
        if kind < 0.9:
            return "<ul>" + "".join(f"<li>\x01{sentences(1, 2) if rng.random() < 0.7 else some(2, 9)}\x02</li>" for _ in range(int(rng.integers(2, 7)))) + "</ul>"
        if kind < 0.94:
            return f"<blockquote>{pick('', '<p>')}\x01{sentences(1, 3)}\x02</blockquote>"
        if kind < 0.97:
            return "<table>" + "".join(f"<tr><td>\x01{some(1, 4)}\x02</td><td>\x01{some(1, 6)}\x02</td></tr>" for _ in range(int(rng.integers(2, 5)))) + "</table>"
        return f"<div>\x01{sentences(1, 4)}\x02</div>"

    for _ in range(number):
        title = some(2, 12)
        blocks = [block() for _ in range(int(rng.integers(1, 16)) if rng.random() < 0.85 else 1)]
        headline = f"<{(h := pick('h1', 'h1', 'h2'))}>\x01{title}\x02</{h}>" if rng.random() < 0.85 else ""
        if rng.random() < 0.2 and headline:
            headline = f"<header>{headline}</header>"
        inner = [headline, *blocks]
        for _ in range(int(rng.integers(0, 3)) if rng.random() < 0.45 else 0):
            inner.insert(int(rng.integers(1, len(inner) + 1)), clutter())
        tag, names = pick("article|", "article|", "article|post", "main|", "main|content", "div|content", "div|main-content", "div|post-body entry",
                          "section|article-body", "div|story", "div|entry-content", "div|", "section|", "td|body-text").split("|")
        wrapped = f"<{tag}{f' {pick("class", "id")}="{names}"' if names else ''}>{''.join(inner)}</{tag}>"
        if rng.random() < 0.4:
            outer = pick("div|page", "div|wrapper", "div|container", "main|", "div|")
            side = clutter() if rng.random() < 0.5 else ""
            tag, name = outer.split("|")
            wrapped = f"<{tag}{f' class="{name}"' if name else ''}>{wrapped}{side}</{tag}>"
        before = [clutter() for _ in range(int(rng.integers(0, 4)))]
        after = [clutter() for _ in range(int(rng.integers(0, 4)))]
        yield title, f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{''.join(before)}{wrapped}{''.join(after)}</body></html>"


def train(words: list[str]) -> Trees:
    """Boosted trees for layouts filled with these words."""
    pages = [Page(source) for _, source in layouts(words or ["text"])]
    labels = np.array(["\x01" in t for p in pages for t in p.text], float)
    for page in pages:
        page.text = [t.replace("\x01", "").replace("\x02", "") for t in page.text]
    forest = Forest(pages)
    forest.add_up(labels)
    return Trees(forest.features(), (labels > 0).astype(float))


def _extractor(trees):
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trees.value
        for batch in found:
            texts: list[str] = []
            pages: list[Page] = []
            held = 0
            for k, source in enumerate(batch.column(2)):
                pages.append(Page(source.as_py() or ""))
                held += len(pages[-1].parent)
                if held > NODES_AT_ONCE or k == batch.num_rows - 1:
                    forest = Forest(pages)
                    texts += forest.main_texts(model.margin(forest.features()))
                    pages, held = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return batches


def main_texts(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars (code points), one row per page.

    Null or empty html, and pages without main text, give an empty text. Character
    references are decoded, white space in a block becomes one space, blocks follow each
    other in page order with one space between. Null or repeated page_ids and urls pass
    through. Other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    total = rows.count()
    share = F.shiftrightunsigned(F.xxhash64("page_id", "url"), 11) / float(1 << 53)
    # Equal ids and urls share a hash; however many such rows there are, 2 * SAMPLE_PAGES come.
    sample = (
        rows.where(share < SAMPLE_PAGES / max(total, 1)).orderBy(share, F.xxhash64("html"))
        .limit(2 * SAMPLE_PAGES).select("html").toLocalIterator()
    )
    words: set[str] = set()
    for row in sample:
        words.update(w for t in Page(row[0] or "").text for w in t.replace("\x01", "").replace("\x02", "").split())
    trees = spark.sparkContext.broadcast(train(sorted(words)))
    return rows.mapInArrow(_extractor(trees), "page_id long, url string, text string").select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
