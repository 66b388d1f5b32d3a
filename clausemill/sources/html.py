"""Blocks and links of HTML pages, by the standard library's parser.

Blocks are the innermost paragraphs, items, headings, quotes and cells, in order, with anchors and
offsets; furniture is left out. Pages are parsed in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

# Elements without canonical text, elements that are blocks, and those that have no end.
DROPPED = frozenset("script style noscript nav header footer form svg".split())
BLOCKS = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote pre td".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# what an element's start ends, if it is open
CLOSES = {t: {"p"} for t in (*BLOCKS, "ul", "ol", "table", "div", "article", "section")} | {"li": {"p", "li"}, "td": {"p", "td"}, "tr": {"p", "td", "tr"}}
SEPARATOR = "\n\n"
# Elements whose text is a link's context, nearest first.
CONTEXT = ("li", "tr", "article")


class _Node:
    __slots__ = ("tag", "id", "parts", "holds_block", "index", "parent")

    def __init__(self, tag: str, id_: str | None, parent: _Node | None, index: int) -> None:
        self.tag, self.id, self.parent, self.index = tag, id_, parent, index
        self.parts: list[str] = []
        self.holds_block = False

    def text(self) -> str:
        return " ".join(" ".join(self.parts).split())

    def anchor(self) -> str:
        if self.id:
            return f"#{self.id}"
        up = self.parent
        while up is not None:
            if up.id:
                return f"#{up.id} {self.tag}:nth({self.index})"
            up = up.parent
        return f"{self.tag}:nth({self.index})"


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Node] = []
        self.blocks: list[_Node] = []
        self.links: list[tuple[str, _Node, _Node | None]] = []
        self.whole: list[str] = []
        self.dropped = 0
        self.in_head = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            return
        if tag in DROPPED or tag in ("head", "title"):
            self.dropped += 1
            self.open.append(_Node(tag, None, None, -1))
            return
        while self.open and self.open[-1].tag in CLOSES.get(tag, ()):
            self.open.pop()
        at = dict(attrs)
        node = _Node(tag, at.get("id"), self.open[-1] if self.open else None, len(self.blocks))
        if tag in BLOCKS and not self.dropped:
            for up in self.open:
                up.holds_block = True
            self.blocks.append(node)
        self.open.append(node)
        if tag == "a":  # links of furniture too: what is furniture is decided by address and label
            near = next((n for n in reversed(self.open[:-1]) if n.tag in CONTEXT), None)
            self.links.append((at.get("href") or "", node, near))

    def handle_endtag(self, tag: str) -> None:
        if not any(n.tag == tag for n in self.open):
            return
        while self.open:
            node = self.open.pop()
            if node.tag in DROPPED or node.tag in ("head", "title"):
                self.dropped -= 1
            if node.tag == tag:
                return

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.whole.append(data)
        for n in self.open:
            if not self.dropped or n.tag == "a":
                n.parts.append(data)


def blocks_of(html: str) -> list[dict]:
    page = _Page()
    page.feed(html)
    page.close()
    out: list[dict] = []
    at = 0
    if not page.blocks:
        text = " ".join(" ".join(page.whole).split())
        return [{"block_no": 0, "dom_anchor": "body", "text": text, "char_start": 0, "char_end": len(text)}] if text else []
    for node in page.blocks:
        text = "" if node.holds_block else node.text()
        if text:
            out.append({"block_no": len(out), "dom_anchor": node.anchor(), "text": text, "char_start": at, "char_end": at + len(text)})
            at += len(text) + len(SEPARATOR)
    return out


def links_of(html: str, base: str = "") -> list[dict]:
    page = _Page()
    page.feed(html)
    page.close()
    return [
        {"ord": k, "href": urljoin(base, href), "anchor_text": node.text(), "context": near.text() if near else node.text()}
        for k, (href, node, near) in enumerate(page.links)
        if href
    ]


def _explode(pages: DataFrame, key: str, of, schema: pa.Schema, ddl: str, columns: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [c.to_pylist() for c in batch.columns[1:]]
            for k, *args in zip(batch.column(0).to_pylist(), *names):
                rows = [r | {"key": k} for r in of(*[a or "" for a in args])]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ship(pages.sparkSession)
    return pages.select(F.col(key).cast("string"), *columns).mapInArrow(run, ddl).withColumnRenamed("key", key)


def blocks(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    schema = pa.schema([("key", pa.string()), ("block_no", pa.int32()), ("dom_anchor", pa.string()), ("text", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32())])
    return _explode(pages, key, blocks_of, schema, "key string, block_no int, dom_anchor string, text string, char_start int, char_end int", [html])


def links(pages: DataFrame, key: str, html: str = "html", base: str = "url") -> DataFrame:
    schema = pa.schema([("key", pa.string()), ("ord", pa.int32()), ("href", pa.string()), ("anchor_text", pa.string()), ("context", pa.string())])
    return _explode(pages, key, links_of, schema, "key string, ord int, href string, anchor_text string, context string", [html, base])
