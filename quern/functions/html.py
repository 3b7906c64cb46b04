"""HTML by the standard library: a tree with simple selectors, and functions over columns of it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    """An element: tag, attributes, children (elements and texts)."""

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None = None):
        self.tag, self.attrs, self.up, self.children = tag, attrs, up, []

    def all(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                parts.append(n)
            elif n.tag not in ("script", "style"):
                stack.extend(reversed(n.children))
        return " ".join(" ".join(parts).split())

    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def find(self, selector: str) -> list[Node]:
        """Descendants that fit ``tag.class.class[attr]`` or ``[attr='value']``, comma-separated alternatives."""
        out = []
        for n in self.all():
            if n is self:
                continue
            for one in selector.split(","):
                m = re.fullmatch(r"\s*([\w-]*)((?:\.[\w-]+)*)(?:\[([\w-]+)(?:='([^']*)')?\])?\s*", one)
                if m and (not m[1] or n.tag == m[1]) and set(m[2].split(".")[1:]) <= n.classes() and (not m[3] or (m[3] in n.attrs and m[4] in (None, n.attrs[m[3]]))):
                    out.append(n)
                    break
        return out


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {})

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(n)
        if tag not in VOID:
            self.at = n

    def handle_endtag(self, tag):
        n = self.at
        while n.up is not None and n.tag != tag:
            n = n.up
        if n.up is not None:
            self.at = n.up

    def handle_data(self, data):
        self.at.children.append(data)


def parse_html(text: str) -> Node:
    tree = _Tree()
    tree.feed(text)
    return tree.root


class _Data(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data):
        self.parts.append(data)


def data(text: str) -> str:
    """All character data, entities decoded, joined by spaces [A15]."""
    parser = _Data()
    parser.feed(text)
    return " ".join(parser.parts)


def ampersands_only(html: Column) -> Column:
    """``html`` of which readers decode whole ``&amp;`` alone: other entities, and those cut short, stay as they stand."""
    return F.regexp_replace(html, "&(?!amp;)", "&amp;")


def data_of(html: Column) -> Column:
    """``data`` of a column; null stays null."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(data, na_action="ignore")

    return run(html)


@F.udtf(returnType="at int, tag string, text string, attrs map<string,string>", useArrow=True)
class HtmlElements:
    """``html_elements(html, selector)``: elements in the order of the page, with their text and attributes; null has none."""

    def eval(self, html: str, selector: str):
        for i, n in enumerate(parse_html(html or "").find(selector)):
            yield i, n.tag, n.text(), n.attrs
