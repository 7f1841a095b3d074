"""Fields of a crawled article page, by the standard library's parser in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser
from pathlib import PurePosixPath
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE = T.StructType([T.StructField("id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("alt", T.StringType()), T.StructField("caption", T.StringType()), T.StructField("position", T.IntegerType())])
PAGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "publish_date", "section", "category", "author", "meta_description")]
    + [T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("content", T.StringType()), T.StructField("images", T.ArrayType(IMAGE)), T.StructField("word_count", T.IntegerType()), T.StructField("reading_time_minutes", T.DoubleType())]
    + [T.StructField("named_entities", T.ArrayType(T.StringType())), T.StructField("event_date", T.StringType()), T.StructField("event_location", T.StringType())]
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of these ends a paragraph that is still open.
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_HIDDEN = frozenset(("script", "style", "template"))


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def all(self):
        """Elements below this one, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def texts(self):
        todo = list(reversed(self.children))
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                yield node
            elif node.tag not in _HIDDEN:
                todo += reversed(node.children)

    def text(self, separator: str = "") -> str:
        """Text nodes, each stripped, without the empty ones."""
        return separator.join(t for t in map(str.strip, self.texts()) if t)

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            self._close("p", {"article", "div", "section", "td", "body"})
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def _close(self, tag: str, stop: set[str]):
        node = self.at
        while node.parent is not None and node.tag != tag:
            if node.tag in stop:
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_endtag(self, tag):
        self._close(tag, set())

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str) -> Node:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.root


def visible_text(html: str | None) -> str:
    """Text without tags, nodes joined with one space."""
    return tree(html or "").text(" ")


def _original(url: str) -> str:
    url = f"https:{url}" if url.startswith("//") else url
    return url.split("?")[0].split("#")[0] if "cnn" in url else url


def page_fields(key: str, html: str, downloaded=lambda url: True) -> dict:
    """downloaded: whether an image could be had; others are left out and not counted."""
    root = tree(html)
    nodes = list(root.all())

    def meta(name: str, value: str) -> Node | None:
        return next((n for n in nodes if n.tag == "meta" and n.attrs.get(name) == value), None)

    def content(node: Node | None) -> str | None:
        return None if node is None else node.attrs.get("content")

    title = next((n for n in nodes if n.tag == "title"), None)
    date = next((c for c in (content(meta("itemprop", "datePublished")), content(meta("name", "pubdate")), content(meta("property", "article:published_time"))) if c), None)
    crumbs = [a for ul in nodes if ul.tag == "ul" and ul.has_class("breadcrumbs") for li in ul.all() if li.tag == "li" for a in li.all() if a.tag == "a"]
    words = content(meta("name", "keywords"))
    body = next((n for n in nodes if n.tag == "article"), None) or next((n for n in nodes if n.tag == "div" and n.has_class("article-body")), None)
    parts, images = [], []
    for node in body.all() if body else ():
        if node.tag == "p" and (text := node.text()):
            parts.append(text)
    for box in body.all() if body else ():
        if box.tag != "div" or not box.has_class("image__container"):
            continue
        img = next((n for n in box.all() if n.tag == "img"), None)
        if img is None or not img.attrs.get("src"):
            continue
        url = _original(img.attrs["src"])
        if not downloaded(url):
            continue
        name = f"{key}_{len(images)}{PurePosixPath(urlsplit(url).path).suffix or '.jpg'}"
        after = box.parent.children[box.parent.children.index(box) + 1 :]
        told = next((n for n in after if isinstance(n, Node) and n.tag == "div" and n.has_class("image__metadata")), None)
        images.append({"id": name, "url": url, "alt": img.attrs.get("alt", ""), "caption": told.text() if told else None, "position": len(parts)})
        parts.append(f"<{name}>")
    text = "\n".join(parts)
    n = len(text.split())
    return {
        "title": title.text() if title else None, "publish_date": date, "section": content(meta("property", "article:published_time")), "category": crumbs[-1].text() if crumbs else None,
        "author": content(meta("name", "author")), "meta_description": content(meta("name", "description")), "keywords": [w.strip() for w in words.split(",")] if words is not None else None,
        "content": text, "images": images, "word_count": n, "reading_time_minutes": round(n / 200, 2), "named_entities": [], "event_date": date, "event_location": None,
    }


def parsed(key: Column, html: Column) -> Column:
    """The page's fields; null for a null page and for one that can't be parsed."""

    @F.pandas_udf(PAGE)
    def run(keys: pd.Series, pages: pd.Series) -> pd.DataFrame:
        rows = []
        for k, page in zip(keys, pages, strict=True):
            try:
                rows.append(page_fields(k, page) if page is not None else {})
            except (ValueError, AssertionError, RecursionError):
                rows.append({})
        return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in PAGE.names})

    return run(key.cast("string"), html)


def without_tags(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(visible_text)

    return run(c)
