"""Main text of web pages by minimum-cut labelling of blocks.

A page is cut into blocks of text at block-level tags. A logistic classifier gives each block its log-odds of being content; their
positive or negative part is the block's capacity to the source or the sink. ``fit`` learns the classifier from pages whose text is
known; the weights given here were learned from made pages (``tests/llm/made_pages.py``). Blocks that follow each other, and blocks that
follow each other under one parent, are tied by smoothness edges that weaken with their distance in the DOM. The minimum cut
labels all blocks at once, so that a short line amid the article stays and a long one amid a menu goes.

What speaks against a block: tags around it (nav, footer, ...), names of classes around it (a name such as ``has-sidebar`` tells
of a layout, not of its content), being hidden. An article or main element begins anew: what stands around it says nothing about
what is in it, but names within it do. Where names would leave a page without any content, the largest container that is named
after a place on the page (a sidebar, a widget; not comments, adverts or notices), and that holds a paragraph or heading outside links,
is taken for a wrapper and its name for nothing, then the next, however short their texts. Text within a block is never split by the names of inline elements; only inline elements
that are not shown go.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one newline. Null html and
pages without content give an empty text. Repeated rows and null ids are kept; only page_id, url and html are read. Time grows
nearly with the length of a page: blocks whose own score outweighs all their edges are settled first, and the maximum flow runs
over the rest alone.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(script|style|noscript|template|textarea|iframe|title|select|annotation-xml|annotation)\b[^>]*(?<!/)>(?:.*?</\1\s*>|.*\Z)|<[!?][^>]*(?:>|\Z)|"
    r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of the keys ends an open one of the values, as far up as the nearest of the holders.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDERS = frozenset("ul ol dl table tbody thead tfoot menu div section article body".split())
_AWAY_TAGS = frozenset("nav footer aside form button menu dialog fieldset option".split())
_AWAY_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
_AWAY_WORDS = frozenset("ad ads adv adsense advert adverts banner nav navbar menu topbar toolbar crumb crumbs breadcrumb breadcrumbs sidebar aside footer foot masthead share sharing social related recommended comment comments commentlist respond reply replies disqus cookie cookies consent gdpr notice notices alert alerts promo promos promotion sponsor sponsored newsletter subscribe subscription signup login popup modal overlay widget widgets pagination pager copyright legal disclaimer teaser skip hidden".split())
_AWAY_STARTS = ("advert", "sponsor", "comment", "cookie", "sidebar", "breadcrumb", "newsletter", "footer", "navbar", "navigation")
#: Parts of class names that tell of a layout or a state, first or last in the name.
_LAYOUT_FIRST = frozenset("has with no not without is are hide enable enabled disable disabled show".split())
_LAYOUT_LAST = frozenset("free enabled disabled less off collapsed closed visible open ready".split())
_CONTENT_WORDS = frozenset("article content post entry story articlebody body main text".split())


#: Of the names that speak against a block, those of places on a page, which are given to wrappers of whole articles too.
_PLACES = frozenset("banner nav navbar menu topbar toolbar sidebar aside footer foot masthead modal overlay popup widget widgets teaser skip hidden".split())
_PLACE_STARTS = ("sidebar", "footer", "navbar", "navigation")


@dataclass
class Weights:
    """The classifier's weights, as ``fit`` gave them, and the strength of the smoothness edges."""

    bias: float = -5.28
    hidden: float = -15.1
    away_tag: float = -15.13
    away_class: float = -16.73
    inside_article: float = 6.19
    content_class: float = 2.42
    words: float = 3.28
    paragraph: float = 2.21
    heading: float = 8.08
    sentence: float = 6.04
    links: float = -6.14
    item: float = 3.66
    adjacent: float = 1.2
    sibling: float = 0.6


@dataclass
class Block:
    """place: the number of the element it stands in. away_class: the outermost element whose class speaks against it, or 0.
    wrapped: whether only names of places on a page do."""

    place: int
    tag: str
    hidden: bool
    away_tag: bool
    away_class: int
    article: bool
    content: bool
    wrapped: bool = False
    text: str = ""
    linked: int = 0
    parts: list[str] = field(default_factory=list)


def _names(value: str) -> tuple[bool, bool, bool]:
    """Whether the names in a class or id attribute speak against, or for, content; whether one against it is more than a place."""
    away = content = more = False
    for name in value.split():
        words = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
        if len(words) > 1 and (words[0] in _LAYOUT_FIRST or words[-1] in _LAYOUT_LAST):
            continue
        content |= not _CONTENT_WORDS.isdisjoint(words)
        against = [w for w in words if w in _AWAY_WORDS or w.startswith(_AWAY_STARTS)]
        away |= bool(against)
        more |= any(w not in _PLACES and not w.startswith(_PLACE_STARTS) for w in against)
    return away, content, more


def _hints(attributes: str) -> tuple[bool, bool, bool, bool, bool]:
    """Whether a tag's attributes hide it, give it a role against content, a name against it, or a role or name for it; whether the name
    against it is more than a place."""
    hidden = role = away = content = more = False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style":
            hidden |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
        elif name == "role":
            role |= value.lower() in _AWAY_ROLES
            content |= value.lower() in ("main", "article")
        elif name in ("class", "id", "itemprop"):
            against, good, thing = _names(value)
            away, content, more = away or against, content or good, more or thing
    return hidden, role, away, content, more


class Element:
    """An open element: what it and those around it say about the text in it."""

    __slots__ = ("tag", "place", "hidden", "away_tag", "away_class", "article", "content", "more")

    def __init__(self, tag: str, place: int, hidden: bool, away_tag: bool, away_class: int, article: bool, content: bool, more: bool) -> None:
        self.tag, self.place, self.hidden, self.away_tag, self.away_class, self.article, self.content, self.more = tag, place, hidden, away_tag, away_class, article, content, more

    def inner(self, tag: str, place: int, attributes: str) -> Element:
        hidden, role, away, content, more = _hints(attributes)
        begins = tag in ("article", "main")
        inside = self.article or begins
        away_tag = not begins and (self.away_tag or role or tag in _AWAY_TAGS or tag == "header" and not inside)
        counts = away and tag not in ("html", "body") and not begins
        return Element(tag, place, self.hidden or hidden, away_tag, 0 if begins else self.away_class or (place if counts else 0), inside, self.content or content, not begins and (self.more or counts and more))


class Page:
    """blocks: the page's blocks of text, in order. parent and depth: of each element, by its number."""

    def __init__(self, html: str) -> None:
        self.parent, self.depth = [0], [0]
        found: list[Block] = []
        stack = [Element("", 0, False, False, 0, False, False, False)]
        opened: Counter[str] = Counter()
        inline: list[tuple[str, bool]] = []
        links, hidden, now, at = 0, 0, None, 0

        def say(raw: str) -> None:
            nonlocal now
            if not raw or hidden or stack[-1].tag == "head":
                return
            if now is None:
                if not raw.strip():
                    return
                e = stack[-1]
                now = Block(e.place, e.tag, e.hidden, e.away_tag, e.away_class, e.article, e.content, bool(e.away_class) and not e.more)
                found.append(now)
            raw = unescape(raw)
            now.parts.append(raw)
            if links:
                now.linked += len(raw)

        def close(down: int) -> None:
            for e in stack[down:]:
                opened[e.tag] -= 1
            del stack[down:]

        for m in _TOKEN.finditer(html):
            if m.start() > at:
                say(html[at : m.start()])
            at = m.end()
            name = m[3] or m[6]
            if name is None:
                if m[1] and m[1].lower() in ("title", "textarea", "select") and now is not None:
                    say(" ")
                continue
            ends, tag, attributes = bool(m[2] or m[5]), name.lower(), m[4] or m[7] or ""
            if tag == "br":
                say(" ")
            elif tag in _BLOCK:
                now, links, hidden, inline = None, 0, 0, []
                if ends:
                    for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                        if stack[i].tag == tag:
                            close(i)
                            break
                        if tag == "p" and stack[i].tag != "p":
                            break
                    continue
                if tag in _VOID:
                    continue
                if stack[-1].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and tag != "body":
                    close(len(stack) - 1)
                if stack[-1].tag == "head" and tag != "head":
                    close(len(stack) - 1)
                for i in range(len(stack) - 1, 0, -1) if tag in _ENDS and any(opened[x] for x in _ENDS[tag]) else ():
                    if stack[i].tag in _ENDS[tag]:
                        close(i)
                        break
                    if stack[i].tag in _HOLDERS and stack[i].tag not in ("div", "section", "article"):
                        break
                self.parent.append(stack[-1].place)
                self.depth.append(self.depth[stack[-1].place] + 1)
                stack.append(stack[-1].inner(tag, len(self.parent) - 1, attributes))
                opened[tag] += 1
            elif tag == "a" and not ends:
                links = 1
            elif tag == "a":
                links = 0
            elif tag in _VOID or attributes.endswith("/"):
                continue
            elif ends:
                while inline and inline[-1][0] != tag and any(x[0] == tag for x in inline):
                    hidden -= inline.pop()[1]
                if inline and inline[-1][0] == tag:
                    hidden -= inline.pop()[1]
            else:
                against = bool(attributes) and _hints(attributes)[0]
                if len(inline) < 64 or against:  # deeper unclosed ones change nothing
                    inline.append((tag, against))
                hidden += against
        if at < len(html):
            say(html[at:])
        for b in found:
            b.text = " ".join("".join(b.parts).split())
        self.blocks = [b for b in found if b.text]

    def distance(self, a: int, b: int) -> int:
        """Steps between two elements in the DOM."""
        steps = 0
        while a != b:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            a, steps = self.parent[a], steps + 1
        return steps


def features(b: Block) -> list[float]:
    """What the classifier sees of a block, in the order of the weights."""
    words = b.text.count(" ") + 1
    return [
        1.0, float(b.hidden), float(b.away_tag), float(b.away_class > 0), float(b.article), float(b.content), min(words, 30) / 30,
        float(b.tag in ("p", "blockquote", "pre")), float(b.tag[:1] == "h" and b.tag[1:].isdigit()), float(b.text[-1] in ".!?…\"”»"), min(1.0, b.linked / len(b.text)), float(b.tag in ("li", "td", "dd", "dt")),
    ]


def score(b: Block, w: Weights) -> float:
    """Log-odds that the block is content."""
    own = (w.bias, w.hidden, w.away_tag, w.away_class, w.inside_article, w.content_class, w.words, w.paragraph, w.heading, w.sentence, w.links, w.item)
    return sum(a * x for a, x in zip(own, features(b), strict=True))


def labelled_blocks(html: str | None, text: str | None) -> list[tuple[list[float], bool]]:
    """Features of a page's blocks, and whether each is a line of the known text."""
    lines = Counter((text or "").split("\n"))
    out = []
    for b in Page(html or "").blocks:
        out.append((features(b), lines[b.text] > 0))
        lines[b.text] -= lines[b.text] > 0
    return out


def regression(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; ridge holds them back, so that separable blocks have finite ones."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(labelled: DataFrame, *, html: str = "html", text: str = "text", most: int = 5000) -> Weights:
    """Weights from pages whose main text is known: at most about ``most`` of them, those with the smallest hash of their html.

    Blocks alike in all features are counted together before anything leaves the tasks."""
    rows = labelled.select(F.col(html).alias("html"), F.col(text).alias("text")).where("html is not null")
    drawn = rows.where(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < min(1.0, most / max(1, rows.count())) * (1 << 30)).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [x for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in labelled_blocks(a, b)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in blocks], pa.list_(pa.float64())), pa.array([y for _, y in blocks], pa.bool_())], ["x", "y"])

    counts = drawn.mapInArrow(run, "x array<double>, y boolean").groupBy("x", "y").count().orderBy("x", "y").toPandas()
    if not len(counts):
        return Weights()
    return Weights(*regression(np.array(counts["x"].tolist()), counts["y"].to_numpy(float), counts["count"].to_numpy(float)).round(2).tolist())


def minimum_cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: on the source's side) that minimise what the cut takes.

    terminal: positive is capacity from the source, negative to the sink. edges: undirected. A node whose terminal outweighs all
    its edges is on that side in a minimum cut; its edges then count for its neighbours' terminals. What is left is cut by
    a maximum flow.
    """
    n = len(terminal)
    spare = list(terminal)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    around = [sum(x.values()) for x in near]
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is not None or -around[i] < spare[i] <= around[i]:
            continue
        label[i] = spare[i] > around[i]
        for j, c in near[i].items():
            if label[j] is None:
                spare[j] += c if label[i] else -c
                around[j] -= c
                del near[j][i]
                queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        reached = _source_side(rest, spare, near)
        for i in rest:
            label[i] = i in reached
    return [bool(x) for x in label]


def _source_side(nodes: list[int], spare: list[float], near: list[dict[int, float]], tiny: float = 1e-9) -> dict[int, int]:
    """Nodes that the source reaches when no more flow fits. Flow goes along shortest paths, all of one length in one phase."""
    while True:
        level = {i: 0 for i in nodes if spare[i] > tiny}
        queue, far = deque(level), None
        while queue:
            i = queue.popleft()
            if far is not None and level[i] >= far:
                break
            for j, room in near[i].items():
                if room > tiny and j not in level:
                    level[j] = level[i] + 1
                    if spare[j] < -tiny:
                        far = level[j]
                    queue.append(j)
        if far is None:
            return level
        todo = {i: iter(list(near[i])) for i in level}
        for start in [i for i in level if level[i] == 0]:
            path = [start]
            while path and spare[start] > tiny:
                i = path[-1]
                if spare[i] < -tiny:
                    flow = min(spare[start], -spare[i], *(near[a][b] for a, b in zip(path[:-1], path[1:], strict=True)))
                    spare[start] -= flow
                    spare[i] += flow
                    for a, b in zip(path[:-1], path[1:], strict=True):
                        near[a][b] -= flow
                        near[b][a] += flow
                    full = next((k for k, (a, b) in enumerate(zip(path[:-1], path[1:], strict=True)) if near[a][b] <= tiny), len(path) - 2)
                    for a in path[full:-1]:  # an edge with room left is tried again
                        todo[a] = chain([path[path.index(a) + 1]], todo[a])
                    del path[full + 1 :]
                    continue
                step = next((j for j in todo[i] if level.get(j) == level[i] + 1 and near[i][j] > tiny), None)
                if step is None:
                    path.pop()
                else:
                    path.append(step)


def main_text(html: str | None, weights: Weights = Weights()) -> str:  # noqa: B008
    page = Page(html or "")
    found = page.blocks
    edges, last = [], {}
    for k, b in enumerate(found):
        if k:
            edges.append((k - 1, k, weights.adjacent * 2 / (2 + page.distance(page.parent[found[k - 1].place], page.parent[b.place]))))
        parent = page.parent[b.place] if b.place else -1
        if last.get(parent, k - 1) != k - 1:
            edges.append((last[parent], k, weights.sibling))
        last[parent] = k
    while True:
        labels = minimum_cut([score(b, weights) for b in found], edges)
        if any(labels) or not _unwrapped(found):
            return "\n".join(b.text for b, yes in zip(found, labels, strict=True) if yes)


def _unwrapped(found: list[Block]) -> bool:
    """Of the elements whose names speak against their blocks, forgets the name of that with the most words, if it is the name of a place
    on the page, and if a paragraph or heading, not a link, is in it."""
    size, holds = Counter(), set()
    for b in found:
        if b.away_class and b.wrapped and not b.hidden and not b.away_tag and b.linked * 2 < len(b.text):
            size[b.away_class] += b.text.count(" ") + 1
            if b.tag in ("p", "blockquote", "pre") or b.tag[:1] == "h" and b.tag[1:].isdigit():
                holds.add(b.away_class)
    named = max(holds, key=lambda e: (size[e], -e), default=0)
    for b in found:
        if named and b.away_class == named:
            b.away_class = 0
    return named > 0


def extract(pages: DataFrame, *, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text) of every page."""
    weights = weights or Weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py(), weights) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")
