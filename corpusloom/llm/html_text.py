"""Main text of web pages: flat text blocks and a decision tree over shallow features.

A page is cut at its tags into a flat list of text blocks. A block is described by its number of words and its link
density (the share of its words inside links), by both of these for the block before and the block after it (Kohlschuetter,
Fankhauser and Nejdl, 2010), and by what its place says: whether it is inside the page's article, in an element that names
itself a menu, advert, footer and the like, or a heading. A decision tree, grown by Gini impurity on the small labelled
table below, says which blocks are main text; they are joined in page order.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import trimmed

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*(?:\"[^\"]*+\"|'[^']*+')|=)*+)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

#: Elements whose text is no markup, those whose contents are never shown as text, and those without an end.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
UNSEEN = frozenset("head noscript template svg math object audio video canvas select button map datalist dialog".split()) | RAW
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements within a line of text; all others begin and end blocks.
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong
    sub sup time tt u var img wbr""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never hold the article, and words that name such an element in its class, id or role.
BOILER = frozenset("nav header footer aside form menu fieldset".split())
HINTS = frozenset("""nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside widget related recommended recommendations trending teaser
    header masthead banner topbar bottombar footer copyright legal cookie cookies consent gdpr notice notices notification alert popup modal overlay
    newsletter subscribe subscription signup login promo promotion promoted sponsor sponsored ad ads advert adverts advertisement advertisements advertising adsense
    share sharing social comment comments commentlist reply replies respond disqus form search pagination pager paywall disclaimer complementary contentinfo
    tooltip toolbar hidden skip""".split())
#: Words that turn such a name into one of something else ("has-sidebar"), and names of an article's
#: container: 2 for one that holds nothing else, 1 for one that may hold more.
BUT = frozenset("has with without no not open closed enabled disabled".split())
ARTICLE_HINTS = {"article body": 2, "articlebody": 2, "post content": 2, "post body": 2, "entry content": 2, "article content": 2, "article text": 2, "story body": 2, "article": 2, "main content": 1,
    "content main": 1, "main": 1, "content": 1, "post": 1, "entry": 1, "hentry": 1, "story": 1}

FEATURES = ("words_before", "links_before", "words", "links", "words_after", "links_after", "scope", "named", "heading")

#: Labelled pages, block after block: words, link words, scope (1 inside the page's article, -1 outside it, 0 where the
#: page has none), 1 if an element around the block names itself no article, 1 for a heading, 1 for main text.
LABELLED: tuple[tuple[tuple[int, int, int, int, int, int], ...], ...] = (
    ((1, 1, -1, 1, 0, 0), (1, 1, -1, 1, 0, 0), (9, 0, -1, 1, 0, 0), (12, 0, 1, 0, 1, 1), (80, 0, 1, 0, 0, 1), (2, 0, 1, 0, 0, 1), (45, 1, 1, 0, 0, 1), (14, 0, -1, 1, 0, 0)),
    ((3, 3, -1, 1, 0, 0), (60, 0, -1, 1, 0, 0), (1, 0, 1, 0, 1, 1), (1, 0, 1, 0, 0, 1), (6, 0, -1, 1, 0, 0)),
    ((5, 0, 1, 0, 1, 1), (7, 7, 1, 0, 0, 1), (3, 0, 1, 0, 0, 1), (8, 8, 1, 1, 0, 0), (30, 0, 1, 1, 0, 0), (40, 4, 1, 0, 0, 1), (25, 0, -1, 1, 0, 0), (3, 0, -1, 1, 1, 0), (55, 0, -1, 1, 0, 0)),
    ((2, 0, -1, 0, 1, 0), (18, 0, -1, 0, 0, 0), (11, 0, 1, 0, 0, 1), (150, 9, 1, 0, 0, 1), (35, 2, -1, 0, 0, 0), (4, 4, -1, 0, 0, 0), (70, 0, -1, 0, 0, 0)),
    ((1, 1, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0), (9, 0, 0, 0, 1, 1), (64, 1, 0, 0, 0, 1), (38, 0, 0, 0, 0, 1), (5, 0, 0, 0, 1, 1), (90, 3, 0, 0, 0, 1), (6, 0, 0, 0, 0, 0)),
    ((4, 4, 0, 0, 0, 0), (6, 0, 0, 0, 1, 1), (17, 0, 0, 0, 0, 1), (120, 6, 0, 0, 0, 1), (3, 0, 0, 0, 0, 1), (75, 0, 0, 0, 0, 1), (10, 9, 0, 0, 0, 0), (8, 8, 0, 0, 0, 0), (12, 12, 0, 0, 0, 0)),
    ((20, 18, 0, 0, 0, 0), (26, 22, 0, 0, 0, 0), (33, 30, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0), (15, 14, 0, 0, 0, 0)),
    ((3, 0, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0), (50, 0, 0, 1, 0, 0), (8, 0, 0, 0, 1, 1), (42, 0, 0, 0, 0, 1), (28, 0, 0, 0, 0, 1), (31, 0, 0, 0, 0, 1), (44, 0, 0, 1, 0, 0), (61, 2, 0, 1, 0, 0), (5, 2, 0, 0, 0, 0)),
    ((2, 2, 0, 1, 0, 0), (24, 0, 0, 0, 0, 1), (19, 0, 0, 0, 0, 1), (4, 0, 0, 0, 0, 1), (22, 1, 0, 0, 0, 1), (1, 1, 0, 1, 0, 0), (3, 3, 0, 0, 0, 0)),
    ((2, 0, 1, 0, 1, 1), (9, 9, 1, 0, 0, 1), (4, 4, 1, 0, 0, 1)), ((1, 0, 1, 0, 0, 1),), ((30, 28, 1, 0, 0, 1), (45, 40, 1, 0, 0, 1)), ((1, 1, 1, 0, 0, 1), (8, 5, 1, 0, 0, 1), (2, 0, 1, 0, 0, 1)),
    ((2, 2, 0, 0, 0, 0), (2, 0, 0, 0, 1, 1), (14, 0, 0, 0, 0, 1), (2, 0, 0, 0, 0, 1), (11, 0, 0, 0, 0, 1), (2, 2, 0, 0, 0, 0)), ((1, 1, 0, 0, 0, 0), (1, 0, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0)),
    ((3, 2, 0, 0, 0, 0), (3, 0, 0, 0, 1, 1), (12, 1, 0, 0, 0, 1), (10, 0, 0, 0, 0, 1), (2, 0, 0, 0, 0, 1), (13, 0, 0, 0, 0, 1), (4, 0, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0)),
    ((4, 0, 0, 0, 1, 0), (3, 3, 0, 0, 0, 0), (4, 4, 0, 0, 0, 0), (5, 0, 0, 0, 1, 1), (21, 0, 0, 0, 0, 1), (3, 0, 0, 0, 1, 1), (16, 1, 0, 0, 0, 1), (3, 0, 0, 0, 1, 0), (6, 6, 0, 0, 0, 0), (5, 0, 0, 0, 0, 0)),
    ((30, 0, 0, 0, 0, 1), (40, 0, 0, 0, 0, 1)), ((22, 0, 0, 0, 0, 1), (35, 2, 0, 0, 0, 1), (28, 0, 0, 0, 0, 1)), ((18, 0, 0, 0, 0, 1), (65, 0, 0, 0, 0, 1), (5, 0, 0, 0, 0, 0)),
    ((9, 0, 0, 0, 1, 1), (75, 0, 0, 0, 0, 1), (20, 0, 0, 0, 0, 1), (88, 3, 0, 0, 0, 1), (12, 0, 0, 0, 0, 1), (95, 0, 0, 0, 0, 1), (47, 0, 0, 0, 0, 1), (5, 0, 0, 0, 0, 0)),
    ((26, 1, 0, 0, 0, 1),), ((1, 1, 0, 1, 0, 0), (34, 0, 0, 0, 0, 1)), ((16, 0, 0, 0, 0, 1), (2, 0, 0, 0, 0, 1), (48, 0, 0, 0, 0, 1)),
    ((40, 0, -1, 0, 0, 0), (35, 1, -1, 0, 0, 0), (12, 0, 1, 0, 0, 1), (22, 0, -1, 0, 0, 0), (31, 0, -1, 0, 0, 0)), ((1, 0, -1, 0, 0, 0), (60, 0, 1, 0, 0, 1), (3, 3, -1, 0, 0, 0)),
    ((1, 0, 1, 0, 0, 1), (15, 15, 1, 0, 0, 1), (2, 2, 1, 0, 0, 1), (1, 0, 1, 1, 0, 0), (2, 2, 1, 1, 0, 0), (500, 0, 1, 0, 0, 1), (200, 0, 1, 1, 0, 0), (300, 0, -1, 0, 0, 0)),
)

#: Labels that hold whatever a block and its neighbours look like, by scope and `named`; grown() adds a row for each
#: combination of these numbers of words and link densities, of the block itself and of both neighbours.
ANYWHERE = {(-1, 0): 0, (-1, 1): 0, (0, 1): 0, (1, 0): 1, (1, 1): 0}
ANY_WORDS, ANY_LINKS = (0, 3, 25, 90), (0.0, 0.5, 1.0)


def _hinted(tag: str, attributes: str, inside: int) -> tuple[bool, int]:
    """Whether an element names itself no article, and how surely it names itself one, from 0 to 3."""
    boiler, article = tag in BOILER and not (tag == "header" and inside), {"article": 3, "main": 1}.get(tag, 0)
    if not attributes or tag in ("html", "body"):
        return boiler, article
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape("".join(values))
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            boiler = True
        elif name in ("class", "id", "role", "itemprop"):
            for one in value.split():
                tokens = [t.lower() for t in _TOKENS.findall(one)]
                if " ".join(tokens) in ARTICLE_HINTS:
                    article = max(article, ARTICLE_HINTS[" ".join(tokens)])
                elif BUT.isdisjoint(tokens) and (tag not in ("article", "main") or len(tokens) == 1):
                    found = HINTS.intersection(tokens) - ({"header", "banner"} if inside else set())
                    boiler = boiler or bool(found)
    return boiler, article


class _Page:
    """The flat blocks of one page: texts, and for each words, link words, how surely inside the article, named, element."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[str, int, int, int, bool, str]] = []
        self.held: list[tuple[str, bool, bool, int]] = []  # open elements: name, unseen, named, inside
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.in_link = False
        self._read(source)
        self._end_block()

    def _now(self) -> tuple[str, bool, bool, int]:
        return self.held[-1] if self.held else ("", False, False, 0)

    def _end_block(self) -> None:
        if self.parts:
            words = html.unescape("".join(self.parts)).split()
            if words:
                tag, _, named, inside = self._now()
                links = len(html.unescape(" ".join(self.linked)).split()) if self.linked else 0
                self.blocks.append((" ".join(words), len(words), min(links, len(words)), inside, named, tag))
            self.parts, self.linked = [], []

    def _text(self, text: str) -> None:
        if text and not self._now()[1]:
            self.parts.append(text)
            if self.in_link:
                self.linked.append(text)

    def _close(self, tag: str) -> None:
        if not self.open.get(tag):
            return
        self._end_block()
        while True:
            name = self.held.pop()[0]
            self.open[name] -= 1
            if name == tag:
                return

    def _start(self, tag: str, attributes: str) -> None:
        boiler, article = _hinted(tag, attributes, self._now()[3]) if tag not in VOID else (False, 0)
        if tag in INLINE and not boiler or tag in VOID:
            if tag == "a":
                self.in_link = True
            elif tag == "br":
                self._text(" ")
            elif tag not in INLINE:
                self._end_block()
            return
        self._end_block()
        self.in_link = False
        if tag not in INLINE and self._now()[0] in ("p", *HEADINGS):  # these don't hold other blocks
            self._close(self._now()[0])
        elif tag in ("li", "option", "dt", "dd", "tr", "td", "th") and self._now()[0] == tag:
            self._close(tag)
        _, unseen, named, inside = self._now()
        named = named or boiler
        self.held.append((tag, unseen or tag in UNSEEN, named, 0 if named else max(inside, article)))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            found = _TAG.search(source, at)
            if not found:
                self._text(source[at:])
                return
            self._text(source[at : found.start()])
            at = found.end()
            tag = (found[2] or "").lower()
            if not tag:
                continue
            if found[1]:
                if tag in INLINE and not self.open.get(tag):
                    self.in_link = self.in_link and tag != "a"
                elif tag in INLINE:
                    self._close(tag)
                elif tag == "p" and not self.open.get("p"):
                    self._end_block()
                else:
                    self.in_link = False
                    self._close(tag)
                continue
            if tag in RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(source, at)
                at = end.end() if end else n
                continue
            if tag == "body" and self.open.get("head"):
                self._close("head")
            self._start(tag, found[3])


def page_blocks(source: str | None) -> tuple[list[str], np.ndarray]:
    """The texts of a page's blocks in order, and a row of FEATURES for each. Null is a page without blocks."""
    blocks = _Page(source).blocks if source else []
    surest = max((b[3] for b in blocks), default=0)
    rows = []
    for _, words, links, inside, named, tag in blocks:
        scope = 0 if not surest else 1 if inside == surest or inside and tag == "h1" else -1  # a title may stand before its article
        rows.append((words, links, scope, named, tag in HEADINGS))
    return [b[0] for b in blocks], featured(np.array(rows, dtype=float).reshape(-1, 5))


def featured(blocks: np.ndarray) -> np.ndarray:
    """FEATURES of blocks given as words, link words, scope, named, heading; beyond the ends of a page are empty blocks."""
    own = np.column_stack([blocks[:, 0], blocks[:, 1] / np.maximum(blocks[:, 0], 1)])
    none = np.zeros((1, 2))
    return np.column_stack([np.vstack([none, own[:-1]]) if len(own) else own, own, np.vstack([own[1:], none]) if len(own) else own, blocks[:, 2:5]])


class Tree:
    """A binary decision tree grown by Gini impurity; thresholds lie half-way between neighbouring values."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12) -> None:
        self.feature, self.threshold, self.child, self.value = [], [], [], []
        self._grow(x, y.astype(float), depth)
        self.feature, self.threshold, self.child, self.value = np.array(self.feature), np.array(self.threshold), np.array(self.child), np.array(self.value)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        at = len(self.feature)
        self.feature.append(-1)
        self.threshold.append(0.0)
        self.child.append((at, at))
        self.value.append(y.mean())
        best = self._split(x, y) if depth and 0 < y.mean() < 1 else None
        if best:
            j, cut = best
            below = x[:, j] <= cut
            self.feature[at], self.threshold[at] = j, cut
            self.child[at] = (self._grow(x[below], y[below], depth - 1), self._grow(x[~below], y[~below], depth - 1))
        return at

    @staticmethod
    def _split(x: np.ndarray, y: np.ndarray) -> tuple[int, float] | None:
        """The feature and threshold of least impurity, the first of equals."""
        best, least = None, np.inf
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, ones = x[order, j], np.cumsum(y[order])
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if not len(cuts):
                continue
            left, k = cuts + 1, ones[cuts]
            right, m = len(y) - left, ones[-1] - k
            impurity = k * (left - k) / left + m * (right - m) / right
            i = int(impurity.argmin())
            if impurity[i] < least - 1e-12:
                best, least = (j, float((v[cuts[i]] + v[cuts[i] + 1]) / 2)), impurity[i]
        return best

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The share of ones in each row's leaf."""
        at = np.zeros(len(x), dtype=int)
        while True:
            j = self.feature[at]
            inner = j >= 0
            if not inner.any():
                return self.value[at]
            over = x[np.arange(len(x)), np.maximum(j, 0)] > self.threshold[at]
            at = np.where(inner, self.child[at, over.astype(int)], at)


def grown(labelled: tuple = LABELLED) -> Tree:
    """The tree of labelled pages."""
    pages = [np.array(p, dtype=float) for p in labelled]
    sides = list(product(ANY_WORDS, ANY_LINKS))
    fixed = np.array([(*a, *b, *c, scope, named, heading, label) for (scope, named), label in ANYWHERE.items() for a, b, c, heading in product(sides, sides, sides, (0, 1))], dtype=float)
    return Tree(np.vstack([*(featured(p[:, :5]) for p in pages), fixed[:, :9]]), np.concatenate([*(p[:, 5] for p in pages), fixed[:, 9]]))


def main_text(source: str | None, tree: Tree) -> tuple[str, int, int]:
    """The main text of a page, its number of blocks and how many of them are kept."""
    texts, x = page_blocks(source)
    keep = tree.predict(x) >= 0.5 if texts else np.zeros(0, bool)
    return "\n".join(t for t, k in zip(texts, keep, strict=True) if k), len(texts), int(keep.sum())


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", labelled: tuple = LABELLED) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept of each row of pages.

    text: the blocks of main text, one line each, with character references decoded and white space of any kind turned
    into one space; n_chars: its code points. Null or empty pages, and pages without main text, have the empty text.
    Unclosed elements end with the element around them, an unclosed comment or script with the page; a page without any article element is judged by its blocks
    alone. Pages are read whole, however long; repeated rows and null keys are extracted like any other; other columns
    are ignored, whatever their names; a table without rows gives none.
    """
    tree = grown(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [main_text(x.as_py(), tree) for x in part.column(2)]
                texts = [x[0] for x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([x[1] for x in found], pa.int32()),
                    pa.array([x[2] for x in found], pa.int32())], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])
        trimmed()

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks int, n_kept int")
