"""Main-text extraction by minimum cut.

A page becomes a sequence of blocks. A logistic classifier, trained on the pages that html_examples
composes, gives each block its log-odds of being main text; they become capacities to the content or
boilerplate terminal. Its features are the block's own text, its neighbours' and its container's, and the
nearest element around it that says anything by tag or name, so that a telling name far outside doesn't
overrule an article within. An element that seems to be boilerplate but holds most of the page's text, beside which there is nothing
that looks like an article, is a wrapper (a page in one form, say) and says nothing. Neighbouring blocks, and blocks near in the element tree, are joined by
smoothness edges, and the minimum cut labels all blocks at once. Blocks whose terminal outweighs all their
open edges are settled first (their label is the same in every minimum cut); max-flow in phases of
shortest paths decides the rest. Where a cut leaves little of what stands directly in an article or main element, as of a
list of links or a single sentence, those blocks are tied to the content terminal and the page is cut again.

Each page is handled in its row: nothing is shuffled. Defined results: null or textless pages give
an empty text; a page without markup is one block, kept or not like any other; repeated rows give
repeated results. Text is never shortened. Columns _text and _blocks of the input are replaced.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_chunks
from .html_examples import pages

#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never shown as text of the page.
HIDDEN = frozenset("script style noscript template head title svg iframe object select option textarea button canvas audio video map".split())
#: Elements that may stand in a head; any other start tag, or text, ends a head left open.
IN_HEAD = frozenset("base basefont bgsound html link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_P_CLOSERS = BLOCKS - {"body", "html"}
_SCOPE = frozenset("table td th tr ul ol div article section main aside nav header footer form body html blockquote".split())
_IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOP_AT = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Words in names of elements that hold boilerplate, or main text.
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner sidebar side menu menus nav navbar navigation topnav footer foot "
    "header masthead breadcrumb breadcrumbs cookie cookies consent notice notices popup modal alert comment comments disqus replies reply respond responses discussion share sharing "
    "social related recommend recommended newsletter subscribe login signup form widget widgets copyright legal toolbar pagination pager tags teaser teasers outbrain taboola".split()
)
GOOD_WORDS = frozenset("content article post entry main body story text prose copy".split())
#: A name with one of these describes a layout or state, not what the element holds.
_NOT_ITS_OWN = frozenset("has with no is without layout wrap wrapper wrapping container page site open closed enabled disabled fixed left right type category".split())
_NAME = re.compile(r"[^\s]+")
_WORD = re.compile(r"[a-z]+")
SIGNALS = ("none", "article", "main", "good", "mixed", "bad", "nav", "aside", "header", "header_in_article", "footer", "form")
_TAGS = {"article": "article", "main": "main", "nav": "nav", "menu": "nav", "aside": "aside", "footer": "footer", "form": "form", "fieldset": "form", "header": "header"}
#: What a role says instead of a tag; a role that isn't here says nothing.
_ROLES = {
    "article": "article", "main": "main", "navigation": "nav", "menu": "nav", "menubar": "nav", "complementary": "aside", "banner": "header", "contentinfo": "footer", "form": "form", "search": "form",
    "alert": "bad", "alertdialog": "bad", "dialog": "bad", "status": "bad", "toolbar": "bad",
}
_MAY_WRAP = frozenset(("bad", "mixed", "form", "aside", "header"))
_CONTENT = frozenset(("article", "main", "good"))
FEATURES = (
    "bias", *[f"nearest_{s}" for s in SIGNALS], "in_article", "in_boilerplate", "link_share", "long", "paragraph", "heading", "item", "sentence", "near_links", "near_long",
    "container_links", "container_long",
)


class Block(NamedTuple):
    """Text; container and own element; depth; least depth since the block before; features; training label."""

    text: str
    parent: int
    own: int
    depth: int
    above: int
    features: tuple[float, ...]
    keep: bool


class _Open(NamedTuple):
    tag: str
    number: int
    signal: str
    in_article: bool
    in_boilerplate: bool
    keep: bool
    may_wrap: int  # the nearest open element that looks like boilerplate and may be a wrapper; 0: none


_ROOT = _Open("", 0, "none", False, False, False, 0)


def named(names: str) -> str:
    """What the names of an element say: good, bad, mixed or none."""
    good = bad = False
    for name in _NAME.findall(names.lower()):
        some = set(_WORD.findall(name))
        if not some & _NOT_ITS_OWN:
            good |= bool(some & GOOD_WORDS)
            bad |= bool(some & BAD_WORDS)
    return "mixed" if good and bad else "good" if good else "bad" if bad else "none"


class _Blocks(HTMLParser):
    """Collects blocks; tolerates what browsers do: implied ends, stray and missing end tags. What is known of
    the elements around is carried from each to the next, so depth costs nothing."""

    def __init__(self, wrappers: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.wrappers = wrappers  # numbers of elements that are known to be wrappers
        self.around: dict[int, int] = {}  # of each element that may be one, the next further out
        self.stack: list[_Open] = []
        self.levels: list[tuple[int, str]] = [(0, "")]  # number and tag of the open block elements
        self.open: Counter[str] = Counter()
        self.hidden = self.count = self.above = 0
        self.parts: list[str] = []
        self.linked = 0
        self.found: list[tuple] = []

    def flush(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        if text:
            depth = len(self.levels) - 1
            top = self.stack[-1] if self.stack else _ROOT
            own, tag = self.levels[-1]
            self.found.append((text, self.levels[-2][0] if depth else 0, own, depth, min(self.above, depth), tag, top, min(1.0, self.linked / len(text))))
            self.above = depth
        self.parts, self.linked = [], 0

    def _pop_to(self, at: int) -> None:
        for o in self.stack[at:]:
            self.hidden -= o.tag in HIDDEN
            self.open[o.tag] -= 1
            if o.tag in BLOCKS:
                self.levels.pop()
        self.above = min(self.above, len(self.levels) - 1)
        del self.stack[at:]

    def _close(self, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag in tags:
                self._pop_to(i)
                return
            if self.stack[i].tag in stop:
                return

    def _close_head(self) -> None:
        if self.stack and self.stack[-1].tag == "head":
            self._pop_to(len(self.stack) - 1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body":
            self._close({"head"}, {"template"})
        elif tag not in IN_HEAD:
            self._close_head()
        if tag in BLOCKS:
            self.flush()
            if tag in _P_CLOSERS:
                self._close({"p"}, _SCOPE)
        elif tag == "br":
            self.parts.append(" ")
        if tag in _IMPLIED:
            self._close(_IMPLIED[tag], _STOP_AT.get(tag, set()))
        if tag in VOID:
            return
        self.count += 1
        around = self.stack[-1] if self.stack else _ROOT
        roles = [_ROLES[r] for k, v in attrs if k == "role" and v for r in v.lower().split() if r in _ROLES]
        signal = _TAGS.get(tag) or (roles[0] if roles else "none")
        if signal == "none" and tag not in ("body", "html"):
            signal = named(" ".join(v for k, v in attrs if v and k in ("class", "id", "aria-label")))
        elif signal == "article" and named(" ".join(v for k, v in attrs if v and k in ("class", "id"))) == "bad":
            signal = "bad"  # a comment or teaser marked up as an article
        if any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs):
            signal = "bad"
        if signal == "header" and around.in_article:
            signal = "header_in_article"
        if self.count in self.wrappers:
            signal = "none"
        may_wrap = around.may_wrap
        if signal in _MAY_WRAP:
            self.around[self.count] = may_wrap
            may_wrap = self.count
        boilerplate = signal in ("bad", "nav", "aside", "footer", "form", "header")
        in_article = (around.in_article and not boilerplate) or signal in ("article", "main")
        self.stack.append(
            _Open(
                tag, self.count, around.signal if signal == "none" else signal, in_article,
                False if signal in ("article", "main") else around.in_boilerplate or boilerplate, around.keep or ("data-keep", "1") in attrs, may_wrap,
            )
        )
        self.open[tag] += 1
        if tag in BLOCKS:
            self.levels.append((self.count, tag))
        self.hidden += tag in HIDDEN

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if self.open[tag]:
            block = tag in BLOCKS
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].tag == tag:
                    self._pop_to(i)
                    break
                if not block and self.stack[i].tag in BLOCKS:  # an inline end doesn't close blocks
                    break

    def handle_data(self, data: str) -> None:
        if data.strip(" \t\n\r\f"):
            self._close_head()
        if not self.hidden:
            self.parts.append(data)
            if self.open["a"]:
                self.linked += len(data)


def _parsed(html: str, wrappers: frozenset[int]) -> _Blocks:
    parser = _Blocks(wrappers)
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser


def _wrapper(parser: _Blocks, share: float = 0.6, most_beside: float = 0.05) -> int:
    """The outermost element that looks like boilerplate but is a wrapper: it holds `share` of the page's plain text and a heading or something that looks
    like an article, and next to nothing that looks like one stands beside it. 0 if there is none."""
    plain: Counter[int] = Counter()
    content: Counter[int] = Counter()
    headed: set[int] = set()
    total = in_content = 0.0
    for text, _, _, _, _, tag, top, links in parser.found:
        size = len(text) * (1 - links)
        total += size
        plain[top.may_wrap] += size
        if top.signal in _CONTENT:
            in_content += size
            content[top.may_wrap] += size
        if tag in ("h1", "h2", "h3") or top.signal in _CONTENT:
            headed.add(top.may_wrap)
    for number in sorted(parser.around, reverse=True):  # inner elements have larger numbers
        outer = parser.around[number]
        if outer:
            plain[outer] += plain[number]
            content[outer] += content[number]
            if number in headed:
                headed.add(outer)
    return next((n for n in sorted(parser.around) if total and n in headed and plain[n] >= share * total and in_content - content[n] <= most_beside * total), 0)


def blocks(html: str | None, most_wrappers: int = 4) -> list[Block]:
    wrappers: frozenset[int] = frozenset()
    parser = _parsed(html or "", wrappers)
    while len(wrappers) < most_wrappers and (number := _wrapper(parser)):
        wrappers |= {number}
        parser = _parsed(html or "", wrappers)
    found = parser.found
    size: Counter[int] = Counter()
    linked: Counter[int] = Counter()
    for text, parent, _, _, _, _, _, links in found:
        size[parent] += len(text)
        linked[parent] += links * len(text)
    long = [min(1.0, math.log1p(len(x[0])) / 7) for x in found]
    out = []
    for i, (text, parent, own, depth, above, tag, top, links) in enumerate(found):
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(found)]
        mean = lambda some: sum(some) / len(near) if near else 0.0  # noqa: B023, E731
        features = (
            1.0, *[float(top.signal == s) for s in SIGNALS], float(top.in_article), float(top.in_boilerplate), links, long[i], float(tag in ("p", "blockquote", "pre")),
            float(tag[:1] == "h" and tag[1:].isdigit()), float(tag in ("li", "dd", "dt")), float(text[-1] in ".!?…。"), mean(found[j][7] for j in near),
            mean(long[j] for j in near), linked[parent] / size[parent], min(1.0, math.log1p(size[parent]) / 8),
        )
        out.append(Block(text, parent, own, depth, above, features, top.keep))
    return out


@lru_cache(maxsize=1)
def weights(ridge: float = 0.05, steps: int = 50) -> tuple[float, ...]:
    """Logistic weights fitted to the composed pages (Newton steps, ridge on all but the bias)."""
    rows = [b for page in pages() for b in blocks(page)]
    x, y = np.array([b.features for b in rows]), np.array([float(b.keep) for b in rows])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), g)
    return tuple(w.tolist())


def smoothness(page: list[Block], adjacent: float = 0.6, near: float = 0.9) -> dict[tuple[int, int], float]:
    """Edges between neighbours in page order, and between each block and the next under the same
    parent; both weaken with the number of elements that separate the two."""
    edges: dict[tuple[int, int], float] = defaultdict(float)
    last: dict[int, int] = {}
    for i, b in enumerate(page):
        if i:
            edges[i - 1, i] += adjacent / (1 + page[i - 1].depth + b.depth - 2 * b.above)
        if b.parent in last:
            edges[last[b.parent], i] += near / (1 + 2 * (page[last[b.parent]].own != b.own))
        last[b.parent] = i
    return dict(edges)


def minimum_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels with the least sum of refused odds and cut edges; True on the content side."""
    n = len(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    z = list(odds)
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(z[i]) < sum(near[i].values()):
            continue
        label[i] = z[i] > 0
        for j, w in near[i].items():
            near[j].pop(i)
            z[j] += w if label[i] else -w
            todo.append(j)
        near[i] = {}
    open_ = [i for i in range(n) if label[i] is None]
    if open_:
        side = _flow_side({i: near[i] for i in open_}, z)
        for i in open_:
            label[i] = i in side
    return [bool(x) for x in label]


def _flow_side(near: dict[int, dict[int, float]], z: list[float], least: float = 1e-12) -> set[int]:
    """Nodes on the source side of a maximum flow, in phases: levels by breadth, then paths along them until
    none is left; the number of phases is small, as paths through a page are."""
    source, sink = -1, -2
    capacity: dict[int, dict[int, float]] = {i: dict(x) for i, x in near.items()}
    capacity[source], capacity[sink] = {}, {}
    for i in near:
        a, b = (source, i) if z[i] > 0 else (i, sink)
        capacity[a][b] = abs(z[i])
        capacity[b].setdefault(a, 0.0)
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for j, c in capacity[i].items():
                if c > least and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return set(level)
        left = {i: list(capacity[i]) for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                flow = min(capacity[a][b] for a, b in itertools.pairwise(path))
                cut = None
                for k, (a, b) in enumerate(itertools.pairwise(path)):
                    capacity[a][b] -= flow
                    capacity[b][a] = capacity[b].get(a, 0.0) + flow
                    if cut is None and capacity[a][b] <= least:
                        cut = k
                del path[cut + 1 :]
                continue
            while left[i] and not (capacity[i][left[i][-1]] > least and level.get(left[i][-1]) == level[i] + 1):
                left[i].pop()
            if left[i]:
                path.append(left[i][-1])
            else:
                path.pop()
                if path:
                    left[path[-1]].pop()


_IN_ARTICLE = tuple(FEATURES.index(f"nearest_{s}") for s in ("article", "main"))


def label_blocks(page: list[Block], w: tuple[float, ...] | None = None, least: float = 0.3) -> list[bool]:
    """Labels of the minimum cut. Where less than `least` of the text that stands directly in article or main elements is kept, its blocks
    are tied to the content terminal."""
    w = w or weights()
    odds = [sum(a * b for a, b in zip(w, x.features, strict=True)) for x in page]
    edges = smoothness(page)
    labels = minimum_cut(odds, edges)
    own = [i for i, x in enumerate(page) if any(x.features[f] for f in _IN_ARTICLE)]
    if sum(len(page[i].text) for i in own if labels[i]) < least * sum(len(page[i].text) for i in own):
        for i in own:
            odds[i] = 1e6
        labels = minimum_cut(odds, edges)
    return labels


def main_text(html: str | None, w: tuple[float, ...] | None = None) -> str:
    page = blocks(html)
    return " ".join(b.text for b, keep in zip(page, label_blocks(page, w), strict=True) if keep)


def extract(docs: DataFrame, *, html_col: str = "html") -> DataFrame:
    """docs with _text (the main text, blocks joined by one space) and _blocks (how many were kept)."""
    w = weights()
    docs = docs.drop("_text", "_blocks")
    schema = docs.limit(0).withColumns({"_text": F.lit("").cast("string"), "_blocks": F.lit(0)}).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, html in text_chunks(batch, html_col):
                texts, kept = [], []
                for h in html:
                    page = blocks(h)
                    good = [b.text for b, keep in zip(page, label_blocks(page, w), strict=True) if keep]
                    texts.append(" ".join(good))
                    kept.append(len(good))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string()), pa.array(kept, pa.int32())], names=[*part.schema.names, "_text", "_blocks"]
                )

    return small_batches(docs).mapInArrow(add, schema)
