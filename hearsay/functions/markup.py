"""A reader of HTML that knows which element a text belongs to.

One scan with a stack of open elements, linear in the page whatever its markup. It runs as an Arrow
UDF on whole pages, for the page kinds whose fields hang on nesting; plain text removal stays in
:mod:`hearsay.functions.text`.
"""

from __future__ import annotations

import html as references
import re
from bisect import bisect_left
from collections import Counter
from typing import Callable, Iterator, NamedTuple

import pandas as pd
from pyspark.sql import Column, functions as F

# Elements without content, elements whose content is not shown, and elements that
# end where one of the named ones begins beside them.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(["script", "style", "template"])
ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "a": {"a"},
    "p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "pre", "form"},
}
# Addresses on the search result page of the forum platform.
THREAD = re.compile(r"/p/(\d+)")
FORUM = re.compile(r"/f\?kw=")
AUTHOR = re.compile(r"/home/main")

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)?(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in HIDDEN}


class Element(NamedTuple):
    tag: str
    classes: frozenset
    href: str | None
    titled: bool  # inside an element of class p_title
    text: int  # first text node


class Tree:
    """Elements in document order, each with the range of elements and texts inside it."""

    def __init__(self, html: str):
        self.elements: list[Element] = []
        self.until: list[tuple[int, int]] = []  # (element, text) after the last inside
        self.texts: list[str] = []
        self._stack: list[int] = []
        self._open: Counter = Counter()
        self._parts: list[str] = []
        self._scan(html)
        self._node()
        while self._stack:
            self._pop()

    def _scan(self, html: str) -> None:
        last, last_comment = html.rfind(">"), html.rfind("-->")
        at = 0
        while True:
            lt = html.find("<", at)
            # Behind the last ">" nothing is a tag.
            if lt < 0 or lt > last:
                self._parts.append(html[at:])
                return
            self._parts.append(html[at:lt])
            after = html[lt + 1 : lt + 2]
            if lt + 4 <= last_comment and html.startswith("<!--", lt):
                self._node()
                at = html.find("-->", lt + 4) + 3
            elif after in ("!", "?"):
                self._node()
                at = html.find(">", lt) + 1
            elif after == "/" and (name := _NAME.match(html, lt + 2)):
                self._end(name[0].lower())
                at = html.find(">", name.end()) + 1
            elif name := _NAME.match(html, lt + 1):
                tag = name[0].lower()
                values, at = self._attributes(html, name.end())
                if at < 0:  # the page ends inside the tag
                    return
                self._start(tag, values)
                if tag in HIDDEN:
                    end = _ENDS[tag].search(html, at)
                    if not end:
                        return
                    at = end.start()
            else:
                self._parts.append("<")
                at = lt + 1

    def _attributes(self, html: str, at: int) -> tuple[dict[str, str], int]:
        """Attributes from a place behind a tag's name, and the place behind the tag; -1 where
        the tag does not end. Every step goes on, so nothing is read twice."""
        values: dict[str, str] = {}
        while at < len(html):
            found = _ATTRIBUTE.match(html, at)
            at = found.end()
            value = ""
            if found[2]:
                quote = html[at : at + 1]
                if quote in ("'", '"') and quote:
                    end = html.find(quote, at + 1)
                    if end < 0:
                        return values, -1
                    value, at = html[at + 1 : end], end + 1
                else:
                    value = _BARE.match(html, at)[0]
                    at += len(value)
            if found[1]:
                values.setdefault(found[1].lower(), references.unescape(value))
            if html.startswith(">", at):
                return values, at + 1
        return values, -1

    def _node(self) -> None:
        """End the text node that is being read."""
        text = "".join(self._parts)
        if text:
            self.texts.append(references.unescape(text))
        self._parts = []

    def _pop(self) -> None:
        i = self._stack.pop()
        self._open[self.elements[i].tag] -= 1
        self.until[i] = (len(self.elements), len(self.texts))

    def _start(self, tag: str, values: dict[str, str]) -> None:
        self._node()
        while self._stack and tag in ENDED_BY.get(self.elements[self._stack[-1]].tag, ()):
            self._pop()
        around = self.elements[self._stack[-1]] if self._stack else None
        self.elements.append(Element(
            tag, frozenset(values.get("class", "").split()), values.get("href"),
            around is not None and (around.titled or "p_title" in around.classes),
            len(self.texts)))
        self.until.append((len(self.elements), len(self.texts)))
        if tag not in VOID:
            self._stack.append(len(self.elements) - 1)
            self._open[tag] += 1

    def _end(self, tag: str) -> None:
        self._node()
        if self._open[tag]:
            while self.elements[self._stack[-1]].tag != tag:
                self._pop()
            self._pop()

    def places(self, fits: Callable[[Element], bool]) -> list[int]:
        return [i for i, e in enumerate(self.elements) if fits(e)]

    def first(self, root: int, places: list[int]) -> int | None:
        """The first of the sorted places that is inside ``root``."""
        k = bisect_left(places, root + 1)
        return places[k] if k < len(places) and places[k] < self.until[root][0] else None

    def text(self, element: int | None, sep: str = "") -> str:
        """Trimmed non-blank text nodes inside an element."""
        if element is None:
            return ""
        parts = (t.strip() for t in self.texts[self.elements[element].text:self.until[element][1]])
        return sep.join(p for p in parts if p)


def _anchors(tree: Tree) -> list[dict]:
    return [{"href": tree.elements[i].href, "title": tree.text(i)}
            for i in tree.places(lambda e: e.tag == "a" and e.href is not None)]


def anchors(html: str | None) -> list[dict]:
    """All links of a page in order: href and text."""
    return _anchors(Tree(html or ""))


def search_hits(html: str | None) -> list[dict]:
    """Hits of a search result page: one per result block, or all titled thread links of a page
    without a block that has one. A thread counts once."""
    tree, hits = Tree(html or ""), {}

    def links(pattern: re.Pattern) -> list[int]:
        return tree.places(lambda e: e.tag == "a" and bool(pattern.search(e.href or "")))

    def classed(name: str, tag: str | None = None) -> list[int]:
        return tree.places(lambda e: name in e.classes and tag in (None, e.tag))

    titled = tree.places(lambda e: e.tag == "a" and e.titled)
    threads, contents, dates = links(THREAD), classed("p_content"), classed("p_date")
    forums, authors = (classed("p_forum", "a"), links(FORUM)), (
        classed("p_author", "a"), links(AUTHOR))
    for block in classed("s_post"):
        def named(*kinds: list[int]) -> str:
            return next((tree.text(i) for k in kinds
                         if (i := tree.first(block, k)) is not None), "")

        link = tree.first(block, titled)
        if link is None:
            link = tree.first(block, threads)
        found = link is not None and THREAD.search(tree.elements[link].href or "")
        if found and found[1] not in hits:
            hits[found[1]] = {
                "title": tree.text(link), "excerpt": tree.text(tree.first(block, contents), " "),
                "forum_name": named(*forums), "author_name": named(*authors),
                "created_at": named(dates)}
    if not hits:
        for link in _anchors(tree):
            found = THREAD.match(link["href"])
            if found and link["title"] and found[1] not in hits:
                hits[found[1]] = {"title": link["title"], "excerpt": "", "forum_name": "",
                                  "author_name": "", "created_at": ""}
    return [{"tid": tid, **hit} for tid, hit in hits.items()]


def _read(reader: Callable[[str | None], list[dict]], schema: str, html: Column) -> Column:
    @F.pandas_udf(f"array<struct<{schema}>>")
    def read(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for page in pages:
            yield page.map(reader)
    return read(html)


def anchors_of(html: Column) -> Column:
    """:func:`anchors` of a column."""
    return _read(anchors, "href:string,title:string", html)


def search_hits_of(html: Column) -> Column:
    """:func:`search_hits` of a column."""
    return _read(search_hits, "tid:string,title:string,excerpt:string,forum_name:string,"
                              "author_name:string,created_at:string", html)
