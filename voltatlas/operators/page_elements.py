"""Elements of raw HTML pages.

Titles and text are JVM-side expressions. Links, list items, table rows and cards need a reader
that knows nesting, quoted attributes and missing end tags, so they run in Arrow batches with the
standard library's HTML parser, in one pass over each page, whatever files the pages lie in.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from html.entities import name2codepoint
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltatlas.functions.columns import blank_to_null, col, let, strip

_REFERENCE = r"&(?:#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"
# Named characters come from the standard library's table of HTML names.
_NAMED = {f"&{name};": chr(code) for name, code in name2codepoint.items()} | {"&apos;": "'"}
_HIDDEN = r"(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>"
# Quoted values may hold '>'; a quote without its pair stands for itself.
_TAG = r"""(?s)</?[a-zA-Z](?>[^>"']+|"[^"]*"|'[^']*'|["'])*+>"""


def _character(ref: Column) -> Column:
    """The character a reference stands for; unknown names stay as they are."""
    digits = F.substring(ref, 3, F.length(ref) - 3)
    code = F.when(F.rlike(ref, F.lit("^&#[xX]")), F.substring(digits, 2, F.length(digits)))\
        .when(F.startswith(ref, F.lit("&#")), F.hex(digits.try_cast("int")))
    char = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
    names = F.create_map(*[F.lit(x) for pair in _NAMED.items() for x in pair])
    return F.coalesce(F.try_element_at(names, ref), char, ref)


_AMP = ["&amp;", "&#38;", "&#x26;", "&#X26;"]


def _decoded(text: Column) -> Column:
    def replaced(found: Column) -> Column:
        order = F.concat(F.filter(found, lambda r: ~r.isin(*_AMP)),
                         F.filter(found, lambda r: r.isin(*_AMP)))
        return F.reduce(order, text, lambda t, r: F.replace(t, r, _character(r)))

    refs = F.array_distinct(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)))
    return F.when(F.contains(text, F.lit("&")), let(refs, replaced)).otherwise(text)


def _decode(c: Column) -> Column:
    """Character references, each once: those of '&' go last, so none is decoded twice."""
    return let(c, _decoded)


def _joined_text(html: Column, separator: str) -> Column:
    """Text nodes, decoded, stripped and joined by a separator, without hidden elements."""
    cut = F.regexp_replace(F.regexp_replace(html, _HIDDEN, "\x01"), _TAG, "\x01")
    nodes = F.transform(F.split(cut, "\x01"), lambda n: strip(_decode(n)))
    return F.array_join(F.filter(nodes, lambda x: x != ""), separator)


def page_title(html: Column | str) -> Column:
    """X11: the first title as it stands, NULL without one."""
    return _decode(blank_to_null(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def page_text(html: Column | str) -> Column:
    """X11: visible text, one text node per line."""
    return _joined_text(col(html), "\n")


def section_links(df: DataFrame, path: str, base_url: str, html: str = "html",
                  key: str = "page_id", site_name: str = "") -> DataFrame:
    """Links below a path with a text of over two characters, made absolute."""
    t, u = F.col("text"), F.col("url")
    out = page_links(df, html, key).where(
        F.contains(u, F.lit(path)) & (F.length(t) > 2) & (u != path))
    if site_name:
        out = out.where(~F.contains(F.lower(t), F.lit(site_name)))
    return out.select(
        key, "position", t.alias("name"),
        F.when(F.startswith(u, F.lit("http")), u).otherwise(F.concat(F.lit(base_url), u))
        .alias("url"))


class _Node:
    """An element: its attributes, and which of the page's texts it holds."""

    __slots__ = ("tag", "attrs", "first", "last", "link", "head", "cells")

    def __init__(self, tag: str, attrs: dict, first: int) -> None:
        self.tag, self.attrs, self.first = tag, attrs, first
        self.last = None
        self.link = self.head = None  # first link inside; first heading or link of a card
        self.cells: list[_Node] = []  # of a table row


class _Reader(HTMLParser):
    """Links, items, rows and cards of a page in document order, in one pass.

    An end tag closes everything opened after its start; elements that are never closed end with
    the page. Text in scripts, styles and templates is left out.
    """

    _VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
             "source", "track", "wbr"}
    _HIDDEN = {"script", "style", "template"}
    _KEPT = {"a", "li", "tr", "td", "th", "h2", "h3", "h4"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.found: list[_Node] = []
        self.open: list[tuple[str, _Node | None]] = []
        self.counts: Counter[str] = Counter()  # open elements by tag
        self.rows: list[_Node] = []  # open ones
        self.no_link: list[_Node] = []  # open items and cells before their first link
        self.no_head: list[_Node] = []  # open cards before their first heading or link

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        card = tag == "div" and "card" in (values.get("class") or "").split()
        node = None
        if card or tag in self._KEPT:
            node = _Node(tag, values, len(self.texts))
            if tag != "tr" or self.counts["table"]:
                self.found.append(node)
            if tag == "a":
                for n in self.no_link:
                    n.link = node
                self.no_link = []
            if tag in ("a", "h2", "h3", "h4"):
                for n in self.no_head:
                    n.head = node
                self.no_head = []
            if tag in ("li", "td", "th"):
                self.no_link.append(node)
            if tag in ("td", "th"):
                for row in self.rows:
                    row.cells.append(node)
            if tag == "tr":
                self.rows.append(node)
            if card:
                self.no_head.append(node)
        if tag not in self._VOID:
            self.open.append((tag, node))
            self.counts[tag] += 1

    def handle_endtag(self, tag):
        if not self.counts[tag]:
            return
        while True:
            name, node = self.open.pop()
            self.counts[name] -= 1
            if node is not None:
                self._close(node)
            if name == tag:
                return

    def _close(self, node: _Node) -> None:
        node.last = len(self.texts)
        # Only open elements are listed, the innermost last.
        for waiting in (self.no_link, self.no_head, self.rows):
            if waiting and waiting[-1] is node:
                waiting.pop()

    def handle_data(self, data):
        text = data.strip()
        if text and not any(self.counts[t] for t in self._HIDDEN):
            self.texts.append(text)

    def text_of(self, node: _Node, separator: str = "") -> str:
        return separator.join(self.texts[node.first:node.last])


def _read(html: str | None) -> _Reader:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader


def _target(node: _Node | None) -> str | None:
    return (node.attrs.get("href") or None) if node is not None else None


def _links_of(html: str | None) -> Iterator[tuple]:
    page = _read(html)
    anchors = [n for n in page.found if n.tag == "a" and "href" in n.attrs]
    for pos, a in enumerate(anchors):
        text, url = page.text_of(a), a.attrs["href"] or ""
        if text or url:
            yield pos, text, url


def _items_of(html: str | None) -> Iterator[tuple]:
    page = _read(html)
    for pos, li in enumerate(n for n in page.found if n.tag == "li"):
        yield pos, page.text_of(li), _target(li.link)


def _rows_of(html: str | None) -> Iterator[tuple]:
    page = _read(html)
    pos = 0
    for row in page.found:
        if row.tag != "tr":
            continue
        texts = [page.text_of(c) for c in row.cells]
        if not any(texts):
            continue
        links = [{"text": page.text_of(c.link), "url": _target(c.link)} for c in row.cells if _target(c.link)]
        yield pos, texts, links
        pos += 1


def _cards_of(html: str | None) -> Iterator[tuple]:
    page = _read(html)
    for pos, card in enumerate(n for n in page.found if n.tag == "div"):
        head = card.head
        name = page.text_of(head) if head is not None else None
        url = _target(head) if head is not None and head.tag == "a" else None
        yield pos, name, url, page.text_of(card, " | ")


def _per_page(df: DataFrame, key: str, html: str, read: Callable, columns: list[str],
              ddl: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            out = [(k, *row) for k, h in zip(pdf[key], pdf[html]) for row in read(h)]
            yield pd.DataFrame(out, columns=[key, *columns])

    # A page takes far longer to read than to move, and a small file is a single scan task.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(key, html).repartition(parts).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, {ddl}")


def page_links(df: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Text and target of every link that has a target attribute, and a text or a target."""
    return _per_page(df, key, html, _links_of, ["position", "text", "url"],
                     "position int, text string, url string")


def page_list_items(df: DataFrame, html: str = "html", key: str = "page_id", longer_than: int = 5,
                    path: str | None = None) -> DataFrame:
    """List items with enough text and their first link; ``path`` filters on that link.

    An item holds the text of the items inside it, which are items as well.
    """
    out = _per_page(df, key, html, _items_of, ["position", "list_item", "url"],
                    "position int, list_item string, url string")
    out = out.where(F.length("list_item") > longer_than)
    return out.where(F.contains(F.col("url"), F.lit(path))) if path else out


def page_table_rows(df: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Cell texts and links of each table row with any text."""
    return _per_page(df, key, html, _rows_of, ["position", "cells", "links"],
                     "position int, cells array<string>, "
                     "links array<struct<text: string, url: string>>")


def page_cards(df: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Heading, link and details of each card."""
    return _per_page(df, key, html, _cards_of, ["position", "name", "url", "details"],
                     "position int, name string, url string, details string")
