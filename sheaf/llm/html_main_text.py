"""Main text of web pages by minimum cut.

A page becomes blocks of text between block-level tags. A linear classifier over a block's ancestors,
links, length and shape gives its cost of being called content or boilerplate: capacities from and to
the terminals. All its evidence is soft: what an element's tag, role and class say is added up, and it counts less for
an element that holds most of the page's text. Neighbouring blocks, and blocks under one container, pull each other
towards one label: capacities between blocks. The minimum cut, by maximum flow, is the cheapest
labelling. Blocks whose own cost outweighs all that could pull at them are settled before, which leaves few to the flow.

Elements are kept in flat lists with the number of their parent, so time and memory are linear in the page's length, however
deep it nests.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from sheaf.llm.util import map_arrow

# fixed values: elements by role, and words in class, id or role that name one
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("annotation annotation-xml button canvas datalist head iframe noscript object script select style svg template textarea title video audio".split())
RAW = frozenset("script style textarea title iframe noscript xmp noframes".split())
CLOSES_P = BLOCKS - {"option", "optgroup", "legend", "title"}
CONTENT_TAGS = frozenset({"article", "main"})
CHROME_TAGS = frozenset("nav footer aside form menu dialog search fieldset".split())
CONTENT_WORDS = frozenset("article content entry main post story text body".split())
CHROME_WORDS = frozenset(
    "ad ads advert advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr menu modal nav navbar navigation newsletter pagination popup promo promoted replies respond sidebar signup sponsor sponsored subscribe".split()
)
WEAK_WORDS = frozenset("banner buttons form header login notice notification pager related reply search share sharing social tags toolbar widget".split())
CHROME_ROLES = frozenset("navigation contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STOP = re.compile(r"[.!?…:;,]")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


#: Weights of the classifier; positive speaks for content. Fixed values.
BIAS, PARAGRAPH, HEADING, ITEM, LINKED, LENGTH, STOPS, COPYRIGHT = -0.6, 1.2, 0.8, -0.3, -4.0, 0.5, 0.6, -3.0
#: What elements say of all that they hold: tags and words; at most MOST_CONTENT for content.
CONTENT_TAG, CONTENT_WORD, MOST_CONTENT, CHROME, WEAK, STATE, OUTSIDE = 3.0, 2.0, 4.0, -8.0, -6.0, -1.0, -4.0
#: Pull between blocks under one parent; next to each other where one's parent is the other's grandparent, as text and a list in
#: it; next to each other anywhere.
SIBLINGS, NESTED, ADJACENT, CONTRAST = 1.2, 0.9, 0.3, 4.0


class Page:
    """Elements as flat lists (a parent comes before its children), and blocks of text in page order."""

    def __init__(self):
        self.parent, self.tag, self.chrome, self.good, self.text_in, self.main_in = [-1], [""], [0.0], [0.0], [0], [0]
        self.blocks: list[Block] = []

    def add(self, parent: int, tag: str, chrome: float, good: float, main: bool) -> int:
        for column, value in ((self.parent, parent), (self.tag, tag), (self.chrome, chrome), (self.good, good), (self.text_in, 0), (self.main_in, int(main))):
            column.append(value)
        return len(self.parent) - 1

    def evidence(self) -> list[float]:
        """For each element what it and its ancestors say of the text in it."""
        is_main = [bool(x) for x in self.main_in]
        for b in self.blocks:
            self.text_in[b.element] += len(b.text)
        for k in range(len(self.parent) - 1, 0, -1):
            self.text_in[self.parent[k]] += self.text_in[k]
            self.main_in[self.parent[k]] += self.main_in[k]
        total, mains = max(1, self.text_in[0]), self.main_in[0]
        # where the page names its main part, and text is in it, other text is less likely content
        named = any(m and 4 * n >= total for m, n in zip(is_main, self.text_in))
        chrome, good, inside = [0.0] * len(self.parent), [0.0] * len(self.parent), [False] * len(self.parent)
        for k in range(1, len(self.parent)):
            up, own = self.parent[k], self.chrome[k]
            if own and self.main_in[k] == mains and 2 * self.text_in[k] > total:  # it holds all main parts and most text
                own *= (1 - self.text_in[k] / total) ** 2
            chrome[k], good[k], inside[k] = chrome[up] + own, min(MOST_CONTENT, good[up] + self.good[k]), inside[up] or is_main[k]
        return [c + g + (OUTSIDE if named and not i else 0.0) for c, g, i in zip(chrome, good, inside)]


class Block:
    __slots__ = ("parts", "linked", "element", "text")

    def __init__(self, element: int):
        self.parts, self.linked, self.element, self.text = [], 0, element, ""


def _nature(tag: str, attrs: str, within: bool) -> tuple[float, float, bool, bool]:
    """(chrome, content, whether it is a main part, hidden) that a start tag tells; within: inside a main part."""
    hidden, main = tag in HIDDEN, tag in CONTENT_TAGS
    chrome = CHROME if tag in CHROME_TAGS or tag == "header" and not within else 0.0
    words: set[str] = set()
    if "=" in attrs or "hidden" in attrs:
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name in ("class", "id"):
                words |= {w.lower() for w in _PART.findall(value)}
            elif name == "role":
                main = main or value.lower() in ("main", "article")
                chrome += CHROME * (value.lower() in CHROME_ROLES or value.lower() == "banner" and not within)
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                hidden = True
    good = CONTENT_TAG * main
    if words and tag not in ("body", "html"):
        named = bool(words & CHROME_WORDS)
        if main:  # mostly a state, such as comment-status-open
            chrome += STATE * (named or bool(words & WEAK_WORDS))
        else:
            chrome += CHROME * named + WEAK * min(2, len(words & WEAK_WORDS))
        good += CONTENT_WORD * bool(words & CONTENT_WORDS)
        main = main and not (named and words & {"comment", "comments", "reply", "replies"} and not words & CONTENT_WORDS)
    return chrome, good, main, hidden


def parsed(html: str) -> Page:
    """Elements and blocks with text, in page order; hidden parts and markup are left out."""
    page = Page()
    # open elements: tag, element, nearest block-level element, hidden, inside a main part
    stack: list[tuple[str, int, int, bool, bool]] = [("", 0, 0, False, False)]
    opened: dict[str, int] = {}
    at, block = 0, None

    def put(text: str) -> None:
        nonlocal block
        if not text or stack[-1][3]:
            return
        if block is None:
            if not text.strip():
                return
            block = Block(stack[-1][2])
            page.blocks.append(block)
        block.parts.append(text)
        if opened.get("a"):
            block.linked += len(text)

    def close(k: int) -> None:
        nonlocal block
        for x in stack[k:]:
            opened[x[0]] -= 1
            if x[0] in BLOCKS:
                block = None
        del stack[k:]

    while True:
        start = html.find("<", at)
        if start < 0:
            put(html[at:])
            break
        m = _TAG.match(html, start)
        if not m:  # a bare <
            put(html[at : start + 1])
            at = start + 1
            continue
        put(html[at:start])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if stack[k][0] in ("article", "main", "table", "td", "th") and tag not in BLOCKS:
                        break
            if tag in BLOCKS:
                block = None
            continue
        if tag in CLOSES_P:
            if opened.get("p") or opened.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    t = stack[k][0]
                    if t == "p" or t == tag and tag in ("li", "option", "tr"):
                        close(k)
                        break
                    if t in BLOCKS:
                        break
            block = None
        if tag in VOID:
            if tag == "br":
                put(" ")
            continue
        _, above, near, hidden, within = stack[-1]
        chrome, good, main, own_hidden = _nature(tag, m[3], within)
        if chrome or good or tag in BLOCKS:
            above = page.add(above, tag, chrome, good, main)
        stack.append((tag, above, above if tag in BLOCKS or chrome or good else near, hidden or own_hidden, within or main))
        opened[tag] = opened.get(tag, 0) + 1
        if tag in RAW:
            end = _END[tag].search(html, at)
            put(html[at : end.start()] if end else html[at:])
            at = end.start() if end else len(html)
    for b in page.blocks:
        b.text = " ".join(unescape("".join(b.parts)).split())
        b.parts = []
    page.blocks = [b for b in page.blocks if b.text]
    return page


def cost(b: Block, tag: str, evidence: float) -> float:
    """What calling the block boilerplate costs more than calling it content."""
    words = b.text.count(" ") + 1
    z = BIAS + LENGTH * min(math.log2(words), 6) + STOPS * bool(_STOP.search(b.text)) + LINKED * min(1.0, b.linked / max(1, len(b.text)))
    z += PARAGRAPH * (tag in ("p", "pre", "blockquote")) + HEADING * (tag in ("h1", "h2", "h3")) + ITEM * (tag == "li")
    return z + evidence + COPYRIGHT * (("©" in b.text or "copyright" in b.text[:40].lower()) and words < 40)


def graph_of(page: Page) -> tuple[list[float], list[tuple[int, int, float]]]:
    """The blocks' costs and the edges between them."""
    evidence, edges = page.evidence(), []
    costs = [cost(b, page.tag[b.element], evidence[b.element]) for b in page.blocks]
    last: dict[int, int] = {}

    def join(i: int, j: int, pull: float) -> None:  # the less, the more what their elements say differs
        contrast = abs(evidence[page.blocks[i].element] - evidence[page.blocks[j].element])
        edges.append((i, j, pull * math.exp(-contrast / CONTRAST)))

    for k, b in enumerate(page.blocks):
        parent = page.parent[b.element]
        if (j := last.get(parent)) is not None:
            join(j, k, SIBLINGS)
        if k and (before := page.parent[page.blocks[k - 1].element]) != parent:
            nested = parent > 0 and page.parent[parent] == before or before > 0 and page.parent[before] == parent
            join(k - 1, k, NESTED if nested else ADJACENT)
        last[parent] = k
    return costs, edges


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least cost: sum of -cost over False plus weights of cut edges (Dinic's maximum flow)."""
    n = len(costs)
    pull = [0.0] * n
    for i, j, w in edges:
        pull[i] += w
        pull[j] += w
    unary, fixed = list(costs), [None] * n
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, w in edges:
        near[i].append((j, w))
        near[j].append((i, w))
    queue = deque(k for k in range(n) if abs(unary[k]) >= pull[k])
    while queue:  # own cost outweighs every pull: settled, and pulls its neighbours with certainty
        k = queue.popleft()
        if fixed[k] is not None:
            continue
        fixed[k] = unary[k] > 0
        for j, w in near[k]:
            if fixed[j] is None:
                unary[j] += w if fixed[k] else -w
                pull[j] -= w
                if abs(unary[j]) >= pull[j] - 1e-12:
                    queue.append(j)
    free = [k for k in range(n) if fixed[k] is None]
    if not free:
        return fixed
    number = {k: i + 2 for i, k in enumerate(free)}
    graph: list[list[list]] = [[] for _ in range(len(free) + 2)]  # to, capacity left, place of the reverse

    def join(a: int, b: int, there: float, back: float) -> None:
        graph[a].append([b, there, len(graph[b])])
        graph[b].append([a, back, len(graph[a]) - 1])

    for k in free:
        if unary[k] > 0:
            join(0, number[k], unary[k], 0.0)
        elif unary[k] < 0:
            join(number[k], 1, -unary[k], 0.0)
    for i, j, w in edges:
        if i in number and j in number:
            join(number[i], number[j], w, w)
    while True:
        level, queue = {0: 0}, deque([0])
        while queue:
            a = queue.popleft()
            for b, c, _ in graph[a]:
                if c > 1e-12 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if 1 not in level:
            return [fixed[k] if fixed[k] is not None else number[k] in level for k in range(n)]
        tried = [0] * len(graph)
        path: list[tuple[int, int]] = []
        a = 0
        while True:
            if a == 1:
                flow = min(graph[x][e][1] for x, e in path)
                for x, e in path:
                    edge = graph[x][e]
                    edge[1] -= flow
                    graph[edge[0]][edge[2]][1] += flow
                path, a = [], 0
            while tried[a] < len(graph[a]):
                b, c, _ = graph[a][tried[a]]
                if c > 1e-12 and level.get(b) == level[a] + 1:
                    break
                tried[a] += 1
            if tried[a] < len(graph[a]):
                path.append((a, tried[a]))
                a = graph[a][tried[a]][0]
            elif not path:
                break
            else:
                a, e = path.pop()
                tried[a] += 1


def main_text(html: str | None) -> str:
    """Content blocks in page order, one on a line; empty where there is none."""
    page = parsed(html or "")
    return "\n".join(b.text for b, keep in zip(page.blocks, minimum_cut(*graph_of(page))) if keep)


def extracted(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """The columns of ``pages`` but for the html, with the main text and n_chars (code points).

    A null page counts as empty. Columns of the new names are replaced; rows stay.
    """
    rest = [f for f in pages.schema if f.name not in (html, text, "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.schema.get_field_index(html))]
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in rest]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*(f.name for f in rest), text, "n_chars"])

    return map_arrow(pages, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{text}` string, n_chars bigint"]))


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
