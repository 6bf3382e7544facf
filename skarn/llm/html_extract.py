"""Main text of HTML pages: flat text blocks, judged by a decision tree on their own shape and that of their neighbours.

A page is cut into flat blocks at the borders of block-level elements. Each block has its words, link density, heading and
list marks, its place (in the article, in or named as boilerplate by element, class, id or role, or neither), and the word
count and link density of the blocks before and after it. A decision tree, grown on the small labelled table below, says which
blocks are main text. Scripts, styles, markup and elements that show no prose never become blocks. The tree is a few dozen
numbers; pages are read where they lie, without a shuffle.

Defined cases: a null or empty html has an empty text; a page without any main block has an empty text; unclosed elements and
comments run to the end of the page; repeated pages are each extracted; other columns are ignored; an empty table gives an
empty result; pages of any length are read whole, in one pass whose time grows with the page's length; blocks that are alike are
judged alike.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hands_back, small_batches

#: Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("audio button canvas datalist head map math noscript object picture select svg template video".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that another of the same kind closes, and where the search for it ends.
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
BOILERPLATE = frozenset("aside dialog fieldset footer form menu nav search".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words of class and id that name boilerplate, and words beside them that mean something else.
HINTS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related replies reply share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
NOT_HINTS = frozenset("has no with without".split())
NO_HINTS_ON = frozenset("article body html main".split())

TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place", "heading", "item")
#: Values of the feature place.
BOILER, OUTSIDE, NO_ARTICLE, IN_ARTICLE = 0, 1, 2, 3
#: The labelled table. Per sample page: whether it has an article, then its blocks in order: words, words in links, marks, label. Marks: a in the
#: article, b in a boilerplate element, n in an element named as boilerplate, h heading, i list item. Label 1: main text.
SAMPLES = [
    (1, [(1, 1, "bi", 0), (2, 2, "bi", 0), (1, 1, "bi", 0), (6, 0, "n", 0), (9, 0, "ah", 1), (60, 0, "a", 1), (2, 0, "a", 1), (80, 3, "a", 1), (9, 0, "b", 0)]),
    (1, [(1, 1, "bi", 0), (1, 1, "bi", 0), (30, 0, "n", 0), (5, 0, "ah", 1), (1, 0, "a", 1), (40, 40, "an", 0), (12, 1, "a", 1), (55, 0, "an", 0), (25, 0, "an", 0), (14, 2, "b", 0)]),
    (1, [(3, 0, "h", 0), (4, 4, "i", 0), (4, 4, "i", 0), (7, 0, "ah", 1), (300, 10, "a", 1), (3, 0, "ah", 1), (150, 0, "a", 1), (35, 0, "ab", 0), (4, 4, "ab", 0), (70, 0, "a", 1), (8, 0, "", 0)]),
    (1, [(20, 1, "", 0), (8, 0, "ah", 1), (6, 0, "ai", 1), (7, 0, "ai", 1), (5, 1, "ai", 1), (4, 0, "a", 1), (60, 0, "bn", 0), (45, 0, "b", 0), (20, 0, "n", 0), (3, 0, "n", 0)]),
    (1, [(40, 0, "", 0), (2, 2, "", 0), (10, 0, "ah", 1), (500, 20, "a", 1), (3, 3, "a", 1), (90, 0, "a", 1), (120, 0, "n", 0), (15, 0, "n", 0), (70, 0, "", 0), (90, 0, "b", 0)]),
    (0, [(2, 2, "bi", 0), (2, 2, "bi", 0), (8, 0, "h", 1), (70, 2, "", 1), (45, 0, "", 1), (12, 0, "", 1), (90, 4, "", 1), (6, 6, "i", 0), (7, 7, "i", 0), (25, 0, "n", 0), (12, 0, "b", 0)]),
    (0, [(3, 3, "", 0), (2, 2, "", 0), (4, 4, "", 0), (6, 0, "h", 1), (120, 0, "", 1), (30, 1, "", 1), (8, 0, "", 1), (60, 0, "", 1), (5, 5, "", 0), (6, 6, "", 0), (4, 4, "", 0)]),
    (0, [(1, 1, "i", 0), (1, 1, "i", 0), (2, 2, "i", 0), (80, 0, "n", 0), (40, 0, "", 1), (55, 3, "", 1), (65, 0, "", 1), (40, 0, "bn", 0), (22, 0, "bn", 0), (3, 0, "b", 0), (9, 9, "b", 0)]),
    (0, [(9, 0, "h", 1), (25, 0, "i", 1), (30, 1, "i", 1), (28, 0, "i", 1), (50, 0, "", 1), (35, 0, "b", 0), (3, 3, "i", 0), (3, 3, "i", 0), (4, 4, "i", 0), (2, 0, "", 0)]),
    (0, [(60, 0, "b", 0), (2, 2, "b", 0), (200, 5, "", 1), (1, 0, "", 1), (180, 0, "", 1), (90, 0, "n", 0), (30, 0, "n", 0), (70, 60, "", 0), (20, 18, "", 0), (5, 0, "", 0)]),
    (1, [(2, 2, "bi", 0), (5, 0, "ah", 1), (100, 0, "a", 1)]),
    (1, [(240, 4, "a", 1)]),
    (1, [(7, 0, "a", 1), (3, 0, "a", 1)]),
    (1, [(9, 0, "ah", 1), (4, 4, "a", 1), (20, 0, "a", 1)]),
    (0, [(60, 0, "", 1)]),
    (0, [(3, 3, "", 0), (3, 3, "", 0), (8, 0, "h", 1), (90, 0, "", 1), (30, 0, "", 1), (25, 1, "", 1)]),
]
DEPTH = 8


@dataclass
class Block:
    text: str
    words: int
    links: int
    flags: str


class Open:
    """An open element with what it hands down to its contents."""

    __slots__ = ("tag", "flags", "hidden")

    def __init__(self, tag: str, flags: frozenset[str], hidden: bool):
        self.tag, self.flags, self.hidden = tag, flags, hidden


def _marks(tag: str, attributes: str) -> tuple[set[str], bool]:
    marks, hidden = set(), tag in HIDDEN
    if tag in ("article", "main"):
        marks.add("a")
    if tag in BOILERPLATE:
        marks.add("b")
    if tag in HEADINGS:
        marks.add("h")
    if tag == "li":
        marks.add("i")
    if tag == "a":
        marks.add("l")
    if tag == "header":
        marks.add("r")
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.lower().replace(" ", ""):
                hidden = True
            elif name == "role":
                marks |= {"b"} if value.lower() in ROLES else {"a"} if value.lower() in ("main", "article") else set()
            elif name in ("class", "id") and tag not in NO_HINTS_ON:
                for part in value.split():
                    names = {x.lower() for x in NAMES.findall(part)}
                    if names & HINTS and not names & NOT_HINTS:
                        marks.add("n")
    return marks, hidden


def blocks_of(html: str) -> list[Block]:
    """The flat blocks of a page that have words, in page order."""
    out: list[Block] = []
    stack: list[Open] = [Open("", frozenset(), False)]
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of a tag in the stack
    pieces: list[str] = []
    links, blank = 0, True
    flags: frozenset[str] = frozenset()

    def flush() -> None:
        nonlocal links, blank
        if not blank:
            words = "".join(pieces).split()
            out.append(Block(" ".join(words), len(words), links, "".join(sorted(flags))))
        pieces.clear()
        links, blank = 0, True

    def write(text: str) -> None:
        nonlocal links, flags, blank
        top = stack[-1]
        if text and not top.hidden:
            if "&" in text:
                text = unescape(text)
            if blank:
                flags, blank = top.flags, text.isspace()
            pieces.append(text)
            if "l" in top.flags:
                links += len(text.split())

    def pop(k: int) -> None:
        for gone in reversed(stack[k:]):
            places[gone.tag].pop()
        del stack[k:]

    def close(names: tuple[str, ...], stops: tuple[str, ...] = ()) -> None:
        last = lambda tags: max((places[t][-1] for t in tags if places[t]), default=0)
        if (k := last(names)) > last(stops):
            pop(k)

    at, n = 0, len(html)
    while at < n:
        if (start := html.find("<", at)) < 0:
            write(html[at:])
            break
        m = TAG.match(html, start)
        if not m:
            write(html[at : start + 1])
            at = start + 1
            continue
        if start > at:
            write(html[at:start])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            close((tag,))
            continue
        if tag in BLOCK:
            flush()
            close(("p",), ("button", "table"))
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                pop(len(stack) - 1)
            if tag in CLOSES:
                names, stops = CLOSES[tag]
                close(tuple(names.split()), stops)
        if tag == "br":
            write(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            found = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = found.end() if found else n
            continue
        if tag == "a":
            close(("a",))
        marks, hidden = _marks(tag, m[3])
        top = stack[-1]
        # A page header is boilerplate; a header inside the article holds its title.
        if "r" in marks:
            marks = marks - {"r"} if "a" in top.flags else (marks - {"r"}) | {"b"}
        places[tag].append(len(stack))
        stack.append(Open(tag, top.flags | marks, top.hidden or hidden))
    flush()
    return out


def shapes(pages: list[list[tuple[int, int, str]]], has_article: list[bool]) -> np.ndarray:
    """FEATURES of every block of every page, from (words, words in links, marks)."""
    rows = []
    for blocks, article in zip(pages, has_article, strict=True):
        plain = [(w, k / w) for w, k, _ in blocks]
        for i, (w, k, marks) in enumerate(blocks):
            before, after = plain[i - 1] if i else (0, 0), plain[i + 1] if i + 1 < len(plain) else (0, 0)
            place = BOILER if "b" in marks or "n" in marks else IN_ARTICLE if "a" in marks else OUTSIDE if article else NO_ARTICLE
            rows.append((w, k / w, *before, *after, place, "h" in marks, "i" in marks))
    return np.array(rows, dtype=np.float64).reshape(-1, len(FEATURES))


class Tree:
    """A decision tree by Gini impurity, kept as arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = DEPTH):
        self.rows: list[list[float]] = []
        self._grow(x, y, depth)
        table = np.array(self.rows)
        self.feature, self.limit, self.left, self.right, self.value = table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        me = len(self.rows)
        self.rows.append([0, np.inf, me, me, float(y.mean())])
        best = self._best(x, y) if depth and 0 < y.mean() < 1 else None
        if best:
            feature, limit = best
            low = x[:, feature] <= limit
            left, right = self._grow(x[low], y[low], depth - 1), self._grow(x[~low], y[~low], depth - 1)
            self.rows[me] = [feature, limit, left, right, float(y.mean())]
        return me

    @staticmethod
    def _best(x: np.ndarray, y: np.ndarray) -> tuple[int, float] | None:
        impurity = lambda v: len(v) * v.mean() * (1 - v.mean()) if len(v) else 0.0
        # Marks first: among equal splits the one with fewer distinct values wins.
        order = sorted(range(x.shape[1]), key=lambda f: len(np.unique(x[:, f])))
        found, least = None, impurity(y) - 1e-9
        for feature in order:
            values = np.unique(x[:, feature])
            for limit in (values[1:] + values[:-1]) / 2:
                low = x[:, feature] <= limit
                if (now := impurity(y[low]) + impurity(y[~low])) < least - 1e-9:
                    found, least = (feature, float(limit)), now
        return found

    def keep(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=int)
        for _ in range(DEPTH + 1):
            at = np.where(x[np.arange(len(x)), self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
        return self.value[at] >= 0.5


def trained() -> Tree:
    x = shapes([[b[:3] for b in blocks] for _, blocks in SAMPLES], [bool(a) for a, _ in SAMPLES])
    return Tree(x, np.array([b[3] for _, blocks in SAMPLES for b in blocks], dtype=float))


def main_texts(pages: list[str | None], tree: Tree) -> list[str]:
    cut = [blocks_of(html) if html else [] for html in pages]
    shape = shapes([[(b.words, b.links, b.flags) for b in blocks] for blocks in cut], [any("a" in b.flags for b in blocks) for blocks in cut])
    keep, at, out = tree.keep(shape).tolist() if len(shape) else [], 0, []
    for blocks in cut:
        out.append("\n".join(b.text for b, k in zip(blocks, keep[at : at + len(blocks)], strict=True) if k))
        at += len(blocks)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    tree = trained()
    small_batches(pages.sparkSession)

    @hands_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.iloc[k : k + 500]
                yield pd.DataFrame({"page_id": part.page_id.astype("Int64"), "url": part.url, "text": main_texts(part.html.tolist(), tree)})

    rows = pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
