"""HTML pages to ordered, typed blocks.

The standard library's tokeniser feeds a small state machine for each page; Spark deals the pages over
the tasks. Content is the only `main`, else the only `article`, else the only element marked as
content; navigation, forms and hidden parts are left out. A failed page is one row with an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parse_markdown import Limits

BLOCK = "page_id long, ordinal int, block_type string, source_text string, depth int, heading_path array<string>, error string"
DROPPED = frozenset("nav footer script style form button input select textarea".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
OUTER = {"p": "paragraph", "ul": "list", "ol": "list", "table": "table", "pre": "code", "blockquote": "notice", "aside": "notice", "figure": "image", **{f"h{i}": "heading" for i in range(1, 7)}}
ENDS_P = frozenset([*OUTER, "div", "section", "article", "main", "header", "hr", "dl"])


class _Page(HTMLParser):
    """Collects the blocks under each candidate for content: lists of [type, depth, text]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.roots: dict[str, list[list]] = {"main": [], "article": [], "marked": []}
        self.stack: list[str] = []
        self.dropped_at: int | None = None
        self.block: tuple[int, str, int] | None = None
        self.parts: list[str] = []
        self.open: list[tuple[int, str, list]] = []
        self.nesting = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_P and "p" in self.stack and self.block and self.block[1] == "paragraph":
            self._pop(self.block[0])
        if tag == "li" and "li" in self.stack:
            inner = max(i for i, t in enumerate(self.stack) if t == "li")
            if not any(t in ("ul", "ol") for t in self.stack[inner + 1 :]):
                self._pop(inner)
        named = dict(attrs)
        if tag == "img" and self.dropped_at is None:
            self._image(named)
        if self.block and tag in ("br", "li", "tr", "p", "div"):
            self.parts.append("\n")
        elif self.block and tag in ("td", "th") and self.parts and self.parts[-1] != "\n":
            self.parts.append("\t")
        if tag in VOID:
            return
        at = len(self.stack)
        self.stack.append(tag)
        if self.dropped_at is None and (tag in DROPPED or "hidden" in named or named.get("aria-hidden") == "true"):
            self.dropped_at = at
        kind = "marked" if "data-docs-content" in named else tag if tag in ("main", "article") else None
        if kind and self.dropped_at is None:
            self.open.append((at, kind, []))
        if tag in OUTER and self.block is None and self.dropped_at is None:
            self.block, self.parts = (at, OUTER[tag], int(tag[1]) if OUTER[tag] == "heading" else 0), []
        if self.block and tag in ("ul", "ol"):
            self.nesting = max(self.nesting, sum(t in ("ul", "ol") for t in self.stack))

    def _image(self, named: dict[str, str | None]) -> None:
        if self.block and self.block[1] == "image":
            self.parts.insert(0, (named.get("alt") or "") + "\n")
        elif not self.block:
            self._emit("image", 0, named.get("alt") or "")

    def _emit(self, kind: str, depth: int, text: str) -> None:
        for _, _, rows in self.open:
            rows.append([kind, depth, text])

    def _pop(self, at: int) -> None:
        if self.block and self.block[0] >= at:
            _, kind, depth = self.block
            raw = "".join(self.parts)
            if kind == "code":
                text = raw.replace("\r\n", "\n").strip("\n")
            elif kind in ("list", "table", "image"):
                lines = ["\t".join(" ".join(c.split()) for c in line.split("\t")) for line in raw.split("\n")]
                text = "\n".join(x for x in lines if x.strip())
            else:
                text = " ".join(raw.split())
            self.block, self.parts = None, []
            if text:
                self._emit(kind, depth, text)
        while self.open and self.open[-1][0] >= at:
            _, kind, rows = self.open.pop()
            self.roots[kind].append(rows)
        if self.dropped_at is not None and self.dropped_at >= at:
            self.dropped_at = None
        del self.stack[at:]

    def handle_endtag(self, tag: str) -> None:
        if tag in self.stack:
            at = len(self.stack) - 1 - self.stack[::-1].index(tag)
            crossed = set(self.stack[at + 1 :])
            if tag not in ENDS_P | DROPPED | {"li", "tr", "td", "th", "body", "html"} and crossed & ENDS_P:
                return  # a stray end of an inline element closes no block
            self._pop(at)

    def handle_data(self, data: str) -> None:
        if self.block and self.dropped_at is None:
            self.parts.append(data)


def parse_html(html: str | None, limits: Limits = Limits()) -> tuple[list[tuple[str, int, str, list[str]]], str | None]:
    """(type, depth, text, heading path) of every block, or an error code."""
    if not (html or "").strip():
        return [], "empty"
    page = _Page()
    page.feed(html)
    page.close()
    page._pop(0)
    root = next((r for r in page.roots.values() if r), None)
    if root is None:
        return [], "missing_content"
    if len(root) > 1:
        return [], "ambiguous_content"
    if page.nesting > limits.nesting:
        return [], "too_deep"
    if len(root[0]) > limits.blocks:
        return [], "too_many_blocks"
    headings: list[str] = []
    out = []
    for kind, depth, text in root[0]:
        if len(text.encode("utf-8", "replace")) > limits.block_bytes:
            return [], "block_too_large"
        if kind == "heading":
            headings = (headings[: depth - 1] + [""] * depth)[: depth - 1] + [text]
        out.append((kind, depth, text, [h for h in headings if h]))
    return out, None if out else "empty"


def parse_pages(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", limits: Limits = Limits()) -> DataFrame:
    """BLOCK rows of every page: its blocks in order, or one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_id", "ordinal", "block_type", "source_text", "depth", "heading_path", "error"]
        for pdf in batches:
            rows = []
            for page_id, html in zip(pdf["page_id"], pdf["html"], strict=True):
                found, error = parse_html(html, limits)
                rows += [(page_id, i, k, t, d, h, None) for i, (k, d, t, h) in enumerate(found)] if not error else [(page_id, None, None, None, None, None, error)]
            yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "ordinal": "Int32", "depth": "Int32"})

    return pages.selectExpr(f"cast({id_col} as long) as page_id", f"{html_col} as html").mapInPandas(run, BLOCK)


def html_title(html: Column) -> Column:
    """The markup between the first `<h1>` and the `</h1>` after it, with the three characters that markup needs decoded, white
    space folded and cut; empty without them. Read from the page as it is: broken markup, or none that says where the content
    is, hides no title, and other references stay as they are written."""
    rest = F.substr(html, F.locate("<h1>", html) + 4)
    raw = F.when(F.contains(html, F.lit("<h1>")) & F.contains(rest, F.lit("</h1>")), F.substring_index(rest, "</h1>", 1)).when(html.isNotNull(), "")
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        raw = F.replace(raw, F.lit(name), F.lit(char))
    return F.regexp_replace(F.regexp_replace(raw, r"[\t\n\f\r ]+", " "), r"^\p{Zs}+|\p{Zs}+\z", "")
