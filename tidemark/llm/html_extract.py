"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A linear classifier of bounded features says how much more a block costs as
boilerplate than as content; these costs are the capacities to the two terminals. Blocks that follow one another are
joined by smoothness edges, the heavier the nearer they stand in the DOM, and so are successive blocks of one parent.
The minimum cut, found by maximum flow, splits content from boilerplate: a block of doubt goes with its neighbours.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))|</[^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas textarea title head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("table ul ol dl div section article main aside nav body".split())
# what names a region of boilerplate: tags, roles, words of class and id
OUT_TAGS = frozenset("nav footer aside form button select dialog menu fieldset".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar toolbar".split())
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu sidebar footer masthead breadcrumb breadcrumbs cookie cookies consent gdpr "
    "notice alert popup modal overlay newsletter subscribe signup login share sharing social related recommended pagination pager widget toolbar skip banner disclaimer copyright".split()
)
COMMENT_WORDS = frozenset("comment comments disqus respond reply replies discussion".split())
IN_WORDS = frozenset("article content entry post story".split())
#: The classifier: the weight of each feature, all of them between 0 and 1, in nats towards content.
WEIGHTS = {
    "bias": -2.0,
    "length": 3.5,  # a block of 100 characters or more counts fully
    "links": -3.5,  # share of its characters inside links
    "sentence": 0.3,  # ends like a sentence
    "paragraph": 0.6, "heading": 0.8,  # by tag
    "article": 1.2,  # inside an element that is marked as the article
    "title": 1.5,  # a heading there
    "elsewhere": -3.0,  # the page marks an article and the block is not inside
    "named": -5.0,  # inside an element named as boilerplate, less as that element holds more of the page's text
    "comment": -6.0, "hidden": -8.0,
    "depth": -0.3, "margin": -0.3,  # deep in the DOM; at the very beginning or end of the page
}
#: Smoothness edges: between neighbours, more by nearness in the DOM, and between successive blocks of one parent; only
#: the share CROSSING of it where a region that the page names begins or ends between them.
ADJACENT, PROXIMITY, SIBLING, CROSSING = 0.1, 4.0, 0.5, 0.25


@dataclass(eq=False)
class Named:
    """An element that is named as boilerplate, and the next such one around it."""

    number: int
    outer: Named | None


@dataclass
class Block:
    text: str
    tag: str
    parent: int
    article: bool
    named: Named | None  # the innermost element around it that is named as boilerplate
    comment: bool
    hidden: bool
    linked: int  # characters inside links
    depth: int
    apart: int  # steps in the DOM from the block before


@dataclass
class _Element:
    tag: str
    number: int
    article: bool = False
    named: Named | None = None
    comment: bool = False
    hidden: bool = False


def _element(tag: str, number: int, attributes: str, above: _Element) -> _Element:
    named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if len(attributes) > 1 else {}
    words = {w.lower() for w in WORD.findall(f"{named.get('class', '')} {named.get('id', '')}")} if "class" in named or "id" in named else frozenset()
    e = _Element(tag, number, above.article, above.named, above.comment, above.hidden)
    role = named.get("role", "").lower()
    e.hidden |= "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "").lower()
    if tag in ("html", "body"):
        return e
    e.comment |= bool(words & COMMENT_WORDS)
    if tag in ("article", "main") or role in ("main", "article") or words & IN_WORDS and not words & OUT_WORDS:
        e.article = True
    elif tag in OUT_TAGS or role in OUT_ROLES or words & OUT_WORDS or (tag == "header" or "header" in words) and not above.article:
        e.named = Named(number, above.named)
    return e


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order, without scripts, styles, comments and heads; unclosed and stray tags are borne."""
    out: list[Block] = []
    stack = [_Element("", 0)]
    pieces: list[str] = []
    state = {"linked": 0, "in_link": 0, "low": 1, "last": 1}
    n, at = 0, 0

    def flush() -> None:
        if pieces:
            if text := " ".join("".join(pieces).split()):
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag not in INLINE), 0)
                above = next((e for e in reversed(stack[:k]) if e.tag not in INLINE), stack[0])
                top, low = stack[k], min(state["low"], k + 1)
                out.append(Block(text, top.tag, above.number, top.article, top.named, top.comment, top.hidden, state["linked"], k, max(1, state["last"] - low + k + 1 - low)))  # 1 where the same element goes on after a void or stray tag
                state["last"] = state["low"] = k + 1
            pieces.clear()
        state["linked"] = 0

    def text(raw: str) -> None:
        if raw:
            t = html.unescape(raw) if "&" in raw else raw
            pieces.append(t)
            if state["in_link"]:
                state["linked"] += len(t)

    def pop_to(i: int) -> None:
        for e in stack[i:]:
            state["in_link"] -= e.tag == "a"
        del stack[i:]
        state["low"] = min(state["low"], len(stack))

    size = len(page)
    while at < size and (m := TOKEN.search(page, at)):
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                pieces.append(" ")
                continue
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if tag not in INLINE:
                flush()
            if i and (tag not in INLINE or all(e.tag in INLINE for e in stack[i:])):
                pop_to(i)
            continue
        if tag in RAW:
            if not m[3].endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                if tag == "head" and not end:
                    continue
                at = end.end() if end else size
            continue
        if tag in VOID:
            if tag in ("br", "wbr"):
                pieces.append(" " if tag == "br" else "")
            elif tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES.get(tag, ()) or stack[i].tag == "p":
                    pop_to(i)
                    break
                if stack[i].tag in SCOPES:
                    break
        n += 1
        stack.append(_element(tag, n, m[3], stack[-1]))
        state["in_link"] += tag == "a"
    text(page[at:])
    flush()
    return out


def features(found: list[Block]) -> Iterator[dict[str, float]]:
    """The classifier's features of each block of a page; those that are not there are 0."""
    total = sum(len(b.text) for b in found)
    within: dict[Named, int] = {}
    for b in found:
        e = b.named
        while e and e not in within:
            within[e] = 0
            e = e.outer
        if b.named:
            within[b.named] += len(b.text)
    for e in sorted(within, key=lambda e: -e.number):  # inner ones first
        if e.outer:
            within[e.outer] += within[e]
    # the innermost holds the least, so it says the most
    named = [1 - within[b.named] / total if b.named else 0.0 for b in found]
    marked = any(b.article and not b.comment and x < 0.5 for b, x in zip(found, named, strict=True))
    before = 0
    for b, x in zip(found, named, strict=True):
        n = len(b.text)
        middle = (before + n / 2) / total
        before += n
        yield {
            "bias": 1.0, "length": min(1.0, n / 100), "links": min(1.0, b.linked / n), "sentence": float(b.text[-1] in ".!?…"), "paragraph": float(b.tag in ("p", "blockquote", "pre")),
            "heading": float(b.tag in ("h1", "h2", "h3", "h4")), "article": float(b.article), "title": float(b.article and b.tag in ("h1", "h2", "h3", "h4")), "elsewhere": float(marked and not b.article), "named": x, "comment": float(b.comment), "hidden": float(b.hidden),
            "depth": min(1.0, b.depth / 20), "margin": (2 * middle - 1) ** 8,
        }


def costs(found: list[Block]) -> list[float]:
    """How much more each block costs as boilerplate than as content: positive for likely content."""
    return [sum(WEIGHTS[k] * v for k, v in f.items()) for f in features(found)]


def smoothness(found: list[Block]) -> dict[tuple[int, int], float]:
    """Edges between blocks that follow one another on the page or in one parent."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}

    def share(a: Block, b: Block) -> float:
        return 1.0 if (a.named, a.comment, a.hidden, a.article) == (b.named, b.comment, b.hidden, b.article) else CROSSING

    for i, b in enumerate(found):
        if i:
            edges[i - 1, i] = (ADJACENT + PROXIMITY / b.apart) * share(found[i - 1], b)
        if (j := last.get(b.parent)) is not None:
            edges[j, i] = edges.get((j, i), 0.0) + SIBLING * share(found[j], b)
        last[b.parent] = i
    return edges


def minimum_cut(cost: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels of least cost: each block its own cost if it goes against it, each edge its weight if its ends differ.

    A block that prefers its label by more than all its edges weigh has that label in a minimum cut; such blocks are
    settled first and lean on their neighbours. Maximum flow by shortest augmenting paths decides the others.
    """
    cost, n = list(cost), len(cost)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(cost[i]) >= sum(near[i].values()):
            label[i] = cost[i] > 0
            for j, w in near[i].items():
                cost[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if not rest:
        return [bool(x) for x in label]
    source, sink = n, n + 1
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest} | {source: {}, sink: {}}
    for i in rest:
        if cost[i] > 0:
            room[source][i], room[i][source] = cost[i], 0.0
        else:
            room[i][sink], room[sink][i] = -cost[i], 0.0
    while True:
        came, todo = {source: source}, deque([source])
        while todo and sink not in came:
            i = todo.popleft()
            for j, r in room[i].items():
                if r > 1e-12 and j not in came:
                    came[j] = i
                    todo.append(j)
        if sink not in came:
            break
        path, j = [], sink
        while j != source:
            path.append((came[j], j))
            j = came[j]
        flow = min(room[i][j] for i, j in path)
        for i, j in path:
            room[i][j] -= flow
            room[j][i] += flow
    for i in rest:
        label[i] = i in came
    return [bool(x) for x in label]


def main_text(page: str) -> tuple[str, int, int, int]:
    """(main text, blocks, content blocks, blocks that the cut labels against their own cost) of a page."""
    found = blocks(page)
    cost = costs(found)
    label = minimum_cut(cost, smoothness(found))
    kept = [b.text for b, is_content in zip(found, label, strict=True) if is_content]
    return " ".join(kept), len(found), len(kept), sum((c > 0) != x for c, x in zip(cost, label, strict=True))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars, n_blocks, n_content, n_cut (blocks that the cut
    labels against their own cost). Null or empty html has an empty text; repeated
    rows give repeated results; other columns are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [main_text(h) for h in batch.column(2).to_pylist()]
            text, *counts = ([g[k] for g in got] for k in range(4))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), *(pa.array(c, pa.int64()) for c in counts)],
                ["id", "url", "text", "n_chars", "n_blocks", "n_content", "n_cut"],
            )

    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint, n_blocks bigint, n_content bigint, n_cut bigint").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
