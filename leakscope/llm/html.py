"""Main text of web pages by composite text density.

A page is read into a light tree: one pass of a token pattern, the usual implied
ends, one record per element.  Elements that are never article text (scripts,
menus, forms and the like, by tag, role or name) are left out.  Every element's
density is its characters per tag, adjusted by its links; a parent's score is the
sum of its children's densities.  The element of the highest score is the article,
and the lowest density on the way from the body to it is what other elements
need to belong to it.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm import textarrays as ta

# The vocabulary of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noscript noembed noframes template xmp svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("head nav aside form button select option dialog menu object audio video canvas datalist "
                    "fieldset footer".split()) | RAW
CLOSED_BY = {  # an open element ends where one of these begins
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"}, "option": {"option"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}}
HELD_BY = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
           "tbody": {"table"}, "thead": {"table"}, "option": {"select"}}

# Names and roles of what is not the article.
BOILERPLATE = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup sidebar side menu nav navbar navigation "
    "breadcrumb breadcrumbs footer comment comments disqus respond replies reply discussion share sharing social "
    "related recommended recommendations widget login search pagination pager masthead copyright disclaimer toolbar "
    "skip topbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar "
                  "toolbar".split())

LEAST_LINK_SHARE = 0.1

_ATTRIBUTES = r"""((?:[\s/]+(?:[^\s/>=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*))?)?)*+)[^>]*+"""
TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)" + _ATTRIBUTES + r"(?:>|\Z)", re.S)
RAW_END = {tag: re.compile("</" + re.escape(tag), re.I | re.A) for tag in RAW}
NAMING = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element:
    """An element: its place in the tree, and the characters, tags and links in it."""

    __slots__ = ("tag", "parent", "children", "left_out", "chars", "link_chars", "tags", "links", "blocks", "density", "inside",
                 "named")

    def __init__(self, tag: str, parent: Element | None, left_out: bool) -> None:
        self.tag, self.parent, self.left_out = tag, parent, left_out
        self.children: list[Element] = []
        self.chars = self.link_chars = self.tags = self.links = 0
        self.blocks = [0, 0]
        self.density = 0.0
        self.named = False      # by class, id or role not article text
        self.inside = tag in ("article", "main") or parent is not None and parent.inside


def _named(attributes: str) -> bool:
    """Whether class, id or role say that the element is not article text."""
    for name, *values in NAMING.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and not BOILERPLATE.isdisjoint(p.lower() for p in NAME_PART.findall(value)):
            return True
    return False


class Page:
    """Tree and text blocks of a page."""

    def __init__(self, source: str) -> None:
        self.root = Element("html", None, False)
        self.elements = [self.root]
        self.blocks: list[tuple[Element, str]] = []
        self._stack, self._run, self._owner = [self.root], [], self.root
        self._read(source)
        self._flush()
        for element in self._stack:
            element.blocks[1] = len(self.blocks)

    def _flush(self) -> None:
        text = " ".join(html.unescape("".join(self._run)).split()) if self._run else ""
        if text:
            self.blocks.append((self._owner, text))
        self._run = []

    def _text(self, piece: str) -> None:
        if not piece:
            return
        top = self._stack[-1]
        if not self._run:
            self._owner = next(e for e in reversed(self._stack) if e.tag not in INLINE)
        self._run.append(piece)
        size = len("".join(html.unescape(piece).split())) if "&" in piece else len(piece) - piece.count(" ")
        top.chars += size
        if any(e.tag == "a" for e in self._stack[-4:]):
            top.link_chars += size

    def _close(self, element: Element) -> None:
        while True:
            last = self._stack.pop()
            if last.tag not in INLINE:
                self._flush()
            last.blocks[1] = len(self.blocks)
            if last is element:
                return

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body", "head") and any(e.tag == tag for e in self._stack):
            return
        if tag not in INLINE:
            for element in reversed(self._stack):
                if element.tag == "p" or tag in CLOSED_BY.get(element.tag, ()):
                    self._close(element)
                    break
                if element.tag in ("table", "ul", "ol", "dl", "select", "div", "section", "article"):
                    break
            if tag != "br":
                self._flush()
        parent = self._stack[-1]
        out = parent.left_out or tag in SKIPPED or tag == "header" and not parent.inside
        element = Element(tag, parent, out)
        element.named = tag not in ("html", "body", "main") and bool(attributes) and _named(attributes)
        element.blocks = [len(self.blocks)] * 2
        parent.children.append(element)
        self.elements.append(element)
        if tag not in VOID:
            self._stack.append(element)

    def _read(self, source: str) -> None:
        at = 0
        while True:
            match = TOKEN.search(source, at)
            if match is None:
                if not self._stack[-1].left_out:
                    self._text(source[at:])
                return
            if match.start() > at and not self._stack[-1].left_out:
                self._text(source[at:match.start()])
            at = match.end()
            closing, tag = match[1], match[2]
            if tag is None:
                continue
            tag = tag.lower()
            if closing:
                if tag == "br":
                    self._text(" ")
                for element in reversed(self._stack[1:]):
                    if element.tag == tag:
                        self._close(element)
                        break
                    if tag in INLINE and element.tag not in INLINE:
                        break
                continue
            if tag in RAW:
                if tag in INLINE or match[3].rstrip().endswith("/") and tag in ("svg", "math"):
                    continue
                found = RAW_END[tag].search(source, at)
                if found is None:
                    return
                end = source.find(">", found.end())
                at = len(source) if end < 0 else end + 1
                continue
            self._start(tag, match[3] or "")
            if tag == "br" and self._run:
                self._text(" ")


def _leave_out(page: Page) -> None:
    """Names are believed unless the element holds the article: the page's first article or
    main element, or a first heading and more than half of the page's text."""
    sizes, holds, heads = {}, set(), set()
    for tag in ("article", "main"):
        first = next((e for e in page.elements if e.tag == tag and not e.named and not e.left_out), None)
        while first is not None:
            holds.add(first)
            first = first.parent
    for element in reversed(page.elements):
        sizes[element] = sizes.get(element, 0) + (0 if element.left_out else element.chars)
        parent = element.parent
        if parent is None:
            continue
        sizes[parent] = sizes.get(parent, 0) + sizes[element]
        if element in heads or element.tag == "h1":
            heads.add(parent)
    total = sizes[page.root]
    for element in page.elements:
        if element.parent is not None and element.parent.left_out:
            element.left_out = True
        elif element.named and element not in holds and not (element in heads and 2 * sizes[element] > total):
            element.left_out = True
    page.blocks = [b if not b[0].left_out else (b[0], "") for b in page.blocks]


def _measure(page: Page) -> Element:
    """Totals and densities of all elements; returns the body."""
    _leave_out(page)
    own = page.elements
    for element in own:
        element.links = 1 if element.tag == "a" else 0
    for element in reversed(own):          # children come after their parents
        parent = element.parent
        if parent is not None and not element.left_out:
            parent.chars += element.chars
            parent.link_chars += element.link_chars
            parent.tags += element.tags + 1
            parent.links += element.links
    body = next((e for e in own if e.tag == "body"), page.root)
    # menus are gone by now, so a page's share of links says little; without any it is undefined
    body_share = max(LEAST_LINK_SHARE, body.link_chars / max(1, body.chars))
    for e in own:
        if e.left_out or not e.chars:
            continue
        tags = max(1, e.tags)
        text = max(1, e.chars - e.link_chars)
        base = math.log(e.chars / text * e.link_chars + body_share * e.chars + math.e)
        inner = e.chars / max(1, e.link_chars) * tags / max(1, e.links)
        e.density = e.chars / tags * (math.log(inner) / math.log(base) if inner > 0 and base > 1 else 0.0)
    return body


def _score(element: Element) -> float:
    return sum(c.density for c in element.children if not c.left_out) or element.density


def _within(element: Element) -> Iterator[Element]:
    stack = [element]
    while stack:
        top = stack.pop()
        if not top.left_out:
            yield top
            stack.extend(reversed(top.children))


def _only_links(element: Element) -> bool:
    """A list or stretch of links: related pages, tags, buttons."""
    return element.links > 1 and element.link_chars > 0.8 * element.chars


def main_text(source: str | None) -> str:
    """The article of a page, blocks in page order, joined by one space."""
    page = Page(source or "")
    if not page.blocks:
        return ""
    body = _measure(page)
    best, top = body, -1.0
    for element in _within(body):
        if element.chars and element.tag not in INLINE:
            score = _score(element)
            if score > top:
                best, top = element, score
    threshold, path = best.density, best
    while path is not body and path.parent is not None:
        path = path.parent
        threshold = min(threshold, path.density)
    # the best element stands for the article element around it
    holder = best
    while holder is not None and holder.tag not in ("article", "main"):
        holder = holder.parent
    chosen = [holder or best]
    if holder is None:
        # other dense elements: the best of each branch beside the chosen one
        ancestors, path = set(), best
        while path is not None:
            ancestors.add(id(path))
            path = path.parent
        for element in _within(body):
            if id(element) in ancestors and element is not best:
                chosen.extend(c for c in element.children if id(c) not in ancestors and not c.left_out
                              and c.tag not in INLINE and c.density >= threshold > 0)
        # the page's only first heading, where it stands in front of the text, is the title
        titles = [e for e in _within(body) if e.tag == "h1" and e.chars]
        if len(titles) == 1 and titles[0].blocks[1] <= best.blocks[0]:
            chosen.append(titles[0])
    taken = [False] * len(page.blocks)
    for element in chosen:
        for i in range(*element.blocks):
            taken[i] = True
        for inner in _within(element):
            if inner is not element and inner.tag not in INLINE and _only_links(inner):
                for i in range(*inner.blocks):
                    taken[i] = False
    return " ".join(text for use, (_, text) in zip(taken, page.blocks) if use and text)


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in ta.slices(batches, "html", 4 * ta.SLICE_BYTES):
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    A null or empty page, and one without article text, has the empty text.
    Rows count by themselves; extra columns are not read.
    """
    return (pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
            .mapInArrow(_extract, "page_id long, url string, text string, n_chars long"))
