"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is cut at block-level tags into flat text blocks.  Each has its word count and link
density, those of the blocks before and after it, and marks of where it stands (inside an
article, a navigation element, an element whose class names an advert, and so on).  A decision
tree, grown on the labelled pages of ``htmlpages``, weighs all of them and keeps or drops each
block; no name decides alone.  Kept blocks are joined in page order.  A whole page is read,
however long, and nothing is cut.

Definitions.  Null html is an empty page.  A page without kept blocks has an empty text.
Character references are decoded, white space inside a block becomes one space, a ``<br>`` is
white space; comments, scripts, styles and inline elements marked as hidden are no text.  Unclosed
and stray tags are tolerated: a closing tag ends the nearest open element of its name, and is
ignored where there is none; a head ends where anything stands that no head may hold.  Ids may be
null or repeat; each row stands for itself.  A carried column that is named as an added one gets
``_`` behind it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilark.functions.cluster import ship
from profilark.llm import textscan as ts
from profilark.llm.columns import named, renamed, typed
from profilark.llm.htmlpages import TRAINING, Page

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']*+(?:\"[^\"]*\"|'[^']*'))*+[^>\"']*+>|[^>]*+(?:>|\Z))|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"}
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Opening one of these ends an open element of the second set, not looking beyond the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
AWAY = set("nav footer aside form head select button menu dialog noscript template svg object canvas datalist audio video math".split())
BODY = {"article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Names of furniture, and names that are as often those of a subject ("side effects", "legal advice").
FURNITURE = set(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle adbox adslot sponsor sponsored promo cookie cookies consent gdpr sidebar sidenav nav navbar navbox navigation"
    " breadcrumb breadcrumbs footer masthead topbar comment comments commentlist disqus newsletter signin pagination pager modal paywall offscreen tagcloud recommendations popup".split()
)
AMBIGUOUS = set(
    "side legal notice notices alert alerts disclaimer search share sharing social related recommended skip banner menu widget widgets copyright promotion teaser reply replies respond"
    " subscribe subscription login signup toolbar overlay hidden".split()
)
#: What a head may hold.
IN_HEAD = {"head", "title", "base", "link", "meta", "style", "script", "noscript", "template"}
HEADER = {"header", "head", "top"}
GOOD = set("article content post entry story main body text page prose blogpost maincontent articlebody".split())
WORDS = re.compile(r"[a-z0-9]+")
CAMEL = re.compile(r"([a-z0-9])([A-Z])")

FEATURES = ["words", "link", "words_before", "link_before", "words_after", "link_after", "away", "furniture", "article", "named_body", "heading", "item", "page_has_article", "header", "ambiguous", "outside"]
NONE = (False,) * 6


@lru_cache(4096)
def _marks(tag: str, attributes: str, in_body: bool) -> tuple[bool, bool, bool, bool, bool, bool]:
    """(away, furniture, article, named body, header, ambiguous) of one element."""
    away, body, header = tag in AWAY, tag in BODY, tag == "header" and not in_body
    furniture = good = maybe = False
    if attributes and len(attributes) > 3:
        for name, *value in ATTRIBUTE.findall(attributes):
            name = name.lower()
            value = "".join(value)
            if name in ("class", "id"):
                tokens = set(WORDS.findall(CAMEL.sub(r"\1 \2", value).lower()))
                if not tokens & {"with", "has", "no", "without"} and tag not in ("html", "body"):
                    furniture |= bool(tokens & FURNITURE)
                    maybe |= bool(tokens & AMBIGUOUS)
                header |= bool(tokens & HEADER) and not in_body
                good |= bool(tokens & GOOD)
            elif name == "role":
                away |= value.lower() in ROLES
                body |= value.lower() in ("main", "article")
            elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                away = True
    return away, furniture, body, good, header, maybe


class _Page:
    """Collects the flat text blocks of one page."""

    def __init__(self):
        self.blocks: list[tuple[str, int, int, tuple]] = []
        self.stack: list[tuple[str, tuple]] = []
        self.own = NONE
        self.paragraph = None
        self.pieces: list[str] = []
        self.linked = 0
        self.link = False
        self.heading = self.item = False
        self.inline: list[tuple[str, bool]] = []

    def text(self, raw: str) -> None:
        if any(hidden for _, hidden in self.inline):
            return
        if self.stack and self.stack[-1][0] == "head" and raw.strip():
            self._leave_head()
        piece = html.unescape(raw) if "&" in raw else raw
        self.pieces.append(piece)
        if self.link:
            self.linked += len(piece.split())

    def cut(self) -> None:
        if self.pieces:
            words = "".join(self.pieces).split()
            if words:
                marks = self.own if self.paragraph is None else tuple(a or b for a, b in zip(self.own, self.paragraph))
                self.blocks.append((" ".join(words), len(words), min(self.linked, len(words)), (*marks, self.heading, self.item)))
            self.pieces = []
        self.linked = 0

    def _settle(self) -> None:
        self.own = self.stack[-1][1] if self.stack else NONE
        tags = [t for t, _ in self.stack[-4:]]
        self.heading = any(t in ("h1", "h2", "h3", "h4", "h5", "h6") for t in tags[-1:])
        self.item = any(t in ("li", "dt", "dd", "td", "th", "option") for t in tags[-2:])

    def _leave_head(self) -> None:
        for k, (tag, _) in enumerate(self.stack):
            if tag == "head":
                self.cut()
                del self.stack[k:]
                self._settle()
                return

    def open(self, tag: str, attributes: str) -> None:
        if tag not in IN_HEAD and self.stack and self.stack[-1][0] == "head":
            self._leave_head()
        if tag == "br":
            self.pieces.append(" ")
            return
        if tag in INLINE:
            if tag == "a":
                self.link = True
            if tag not in VOID and len(attributes) > 3:
                if _marks(tag, attributes, False)[0]:
                    self.inline.append((tag, True))
                elif self.inline and self.inline[-1][0] == tag:
                    self.inline.append((tag, False))
            elif self.inline and self.inline[-1][0] == tag:
                self.inline.append((tag, False))
            return
        self.cut()
        self.inline.clear()
        self.link = False
        self.paragraph = None
        if tag in VOID:
            return
        in_body = self.own[2]
        if tag == "p":
            self.paragraph = _marks(tag, attributes, in_body)
            return
        if tag in IMPLIED:
            ends, stop = IMPLIED[tag]
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in ends:
                    del self.stack[k:]
                    break
                if self.stack[k][0] in stop:
                    break
            self._settle()
        self.stack.append((tag, tuple(a or b for a, b in zip(self.own, _marks(tag, attributes, in_body)))))
        self._settle()

    def close(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self.link = False
            for k in range(len(self.inline) - 1, -1, -1):
                if self.inline[k][0] == tag:
                    del self.inline[k:]
                    break
            return
        if tag == "br":
            self.pieces.append(" ")
            return
        self.cut()
        self.inline.clear()
        self.link = False
        self.paragraph = None
        if tag != "p":
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == tag:
                    del self.stack[k:]
                    self._settle()
                    break


def blocks(page: str) -> list[tuple[str, int, int, tuple]]:
    """(text, words, linked words, marks) of every flat block of a page, in order."""
    p, at = _Page(), 0
    while at < len(page):
        m = TAG.search(page, at)
        if m is None:
            p.text(page[at:])
            break
        if m.start() > at:
            p.text(page[at : m.start()])
        at = m.end()
        if (tag := m[2]) is None:
            continue
        tag = tag.lower()
        if m[1]:
            p.close(tag)
        elif tag in RAW:
            end = RAW_END[tag].search(page, at)
            if tag not in ("script", "style"):
                p.cut()
            if end is None:
                break
            at = page.find(">", end.end()) + 1 or len(page)
        else:
            p.open(tag, m[3][:-1])
    p.cut()
    return p.blocks


def rows(found: list[tuple[str, int, int, tuple]]) -> np.ndarray:
    """blocks x FEATURES."""
    x = np.zeros((len(found), len(FEATURES)), np.float32)
    if found:
        words = np.array([b[1] for b in found], np.float32)
        link = np.array([b[2] for b in found], np.float32) / words
        marks = np.array([b[3] for b in found], bool)
        x[:, 0], x[:, 1] = words, link
        x[1:, 2], x[1:, 3] = words[:-1], link[:-1]
        x[:-1, 4], x[:-1, 5] = words[1:], link[1:]
        x[:, 6:10] = marks[:, :4]
        x[:, 10:12] = marks[:, 6:]
        x[:, 12] = marks[:, 2].any()
        x[:, 13:15] = marks[:, 4:6]
        x[:, 15] = marks[:, 2].any() & ~marks[:, 2]
    return x


def labelled_rows(pages: list[Page] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of labelled pages (of those for training, if none are given)."""
    xs, ys = [], []
    for page in TRAINING if pages is None else pages:
        found = []
        for path, words, linked, _ in page:
            marks, last = NONE, []
            for step in path.split():
                tag, _, name = step.partition(".")
                if tag not in INLINE:
                    last.append(tag)
                marks = tuple(a or b for a, b in zip(marks, _marks(tag, f' class="{name}"' if name else "", marks[2])))
            last = [t for t in last if t != "p"]
            found.append(("", words, linked, (*marks, bool(last) and last[-1] in ("h1", "h2", "h3", "h4", "h5", "h6"), any(t in ("li", "dt", "dd", "td", "th", "option") for t in last[-2:]))))
        xs.append(rows(found))
        ys.append(np.array([b[3] for b in page]))
    return np.concatenate(xs), np.concatenate(ys)


class Tree:
    """A binary decision tree by Gini impurity, with arrays for its nodes."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 1):
        self.feature, self.cut, self.left, self.right, self.value = [], [], [], [], []
        self._grow(x, y, depth, least)
        self.arrays = tuple(map(np.array, (self.feature, self.cut, self.left, self.right, self.value)))

    def _grow(self, x, y, depth, least) -> int:
        node = len(self.feature)
        for a, v in ((self.feature, -1), (self.cut, 0.0), (self.left, node), (self.right, node), (self.value, float(y.mean()))):
            a.append(v)
        best = None
        if depth and 0 < y.mean() < 1:
            for f in (*range(6, x.shape[1]), *range(6)):  # on a tie the place of a block counts before its numbers
                for cut in (np.unique(x[:, f])[:-1] + np.unique(x[:, f])[1:]) / 2:
                    low = x[:, f] <= cut
                    n = low.sum()
                    if min(n, len(y) - n) >= least:
                        p, q = y[low].mean(), y[~low].mean()
                        cost = (n * p * (1 - p) + (len(y) - n) * q * (1 - q)) / len(y)
                        if best is None or cost < best[0] - 1e-12:
                            best = (cost, f, cut)
        if best is not None and best[0] < y.mean() * (1 - y.mean()) - 1e-9:
            _, f, cut = best
            low = x[:, f] <= cut
            self.feature[node], self.cut[node] = f, float(cut)
            self.left[node] = self._grow(x[low], y[low], depth - 1, least)
            self.right[node] = self._grow(x[~low], y[~low], depth - 1, least)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right, value = self.arrays
        at = np.zeros(len(x), int)
        while (feature[at] >= 0).any():
            f = feature[at]
            go = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
            at = np.where(f < 0, at, np.where(go, left[at], right[at]))
        return value[at]


@lru_cache(1)
def default_tree() -> Tree:
    return Tree(*labelled_rows())


def main_text(page: str | None, tree: Tree | None = None) -> str:
    """The main text of one page."""
    found = blocks(page or "")
    if not found:
        return ""
    keep = (tree or default_tree()).predict(rows(found)) >= 0.5
    return "\n\n".join(b[0] for b, k in zip(found, keep.tolist()) if k)


def _extract(tree: Tree | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = tree or default_tree()
        for whole in batches:
            for part in ts.slices(whole, "html"):
                found = [blocks(v.as_py() or "") for v in part.column(1)]
                many = np.array([len(b) for b in found])
                keep = grown.predict(np.concatenate([rows(b) for b in found])) >= 0.5
                end = np.cumsum(many)
                texts = ["\n\n".join(b[0] for b, k in zip(page, keep[e - n : e].tolist()) if k) for page, n, e in zip(found, many.tolist(), end.tolist())]
                n_kept = [int(keep[e - n : e].sum()) for n, e in zip(many.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(many), pa.array(n_kept, pa.int64())], names=["rest", "main", "n_blocks", "n_kept"])

    return run


def extract(pages: DataFrame, *carry: str | Column, html_col: str = "html", tree: Tree | None = None) -> DataFrame:
    """The ``carry`` columns with ``main`` (text), ``n_blocks`` and ``n_kept`` for every page."""
    ship(pages.sparkSession)
    added = ["main", "n_blocks", "n_kept"]
    names = pages.select(*carry).columns
    rest = pages.select(F.struct(*carry).alias("rest"), named(html_col).cast("string").alias("html"))
    out = rest.mapInArrow(_extract(tree), typed(rest, "rest", "main string, n_blocks long, n_kept long"))
    return out.select(*(F.col("rest")[c].alias(n) for c, n in zip(names, renamed(names, added))), *added)
