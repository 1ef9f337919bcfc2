"""Main text of web pages by line-block distribution (operator 10).

Markup is stripped to one line per block element, with ``WINDOW`` blank lines around containers. A line weighs
its characters outside links; paragraphs and headings weigh more than bare text, lines of elements that are named
like menus, adverts or comments weigh less. The weights are summed over sliding windows of ``WINDOW`` lines. A region
runs from a surge (the window sum leaves zero) to the next dive. Strong regions peak at ``SURGE`` or
more and weigh at least ``SHARE`` of the heaviest one (which is always strong).

The content element is found from the strong regions alone: from the body down as long as one child holds ``MOST`` of
their weight, then up again over parents with paragraphs or headings of their own. Names above it no longer count, so
a page inside one form or one ``div`` called ``social`` keeps its text. Inside it the text from its first line to its
last is kept; named elements go unless they outweigh the rest. In an element without own paragraphs, and in
the body, children before, between and after strong ones are judged by position and by their paragraphs. Kept
blocks are joined by one line feed.

Defined results: null or empty html gives '', html without markup is one block, unclosed or
cut markup is read as far as it goes, unknown character references stay as they are; a page of links alone gives ''. Rows are
treated one by one: repeated rows, null ids and extra columns pass through unchanged.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ._io import read

WINDOW = 3
SURGE = 40
SHARE = 0.25
MOST = 0.8
#: Weight of a line inside an element that is named like a menu, an advert or a comment.
NAMED = 0.02
#: Weight of a character by the block's element; inside ``article`` or ``main`` twice as much.
BARE, PARAGRAPH, HEADING = 0.125, 1.0, 2.0

_RAW = re.compile(r"<!--|<(script|style|noscript|template|svg|iframe|object|canvas|select|textarea|head|title)(?![\w:-])[^>]*(?:>|$)", re.I)
_HEAD = re.compile(r"<(?:head)\b[^>]*>.*?(?=<body\b|</head\s*>)", re.S | re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>""")
_ATTR = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt "
                    "ruby s samp small span strike strong sub sup time tt u var wbr br input nobr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARAGRAPHS = frozenset("p pre blockquote".split())
_MAIN = frozenset(["article", "main"])
_LAYOUT = frozenset("article main section aside nav header footer form table div ul ol dl menu dialog".split())
_NAMED_TAG = frozenset("nav footer aside form menu dialog button header".split())
# words of class, id or role values that name something other than the main text
_NAMED_WORD = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
                        "banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar "
                        "navigation menu breadcrumb breadcrumbs sidebar sidenav widget comment comments disqus "
                        "respond reply replies share sharing social related recommended recommendations newsletter subscribe "
                        "subscription signup login footer pagination pager toolbar search complementary "
                        "contentinfo masthead".split())
_NAMED_ARTICLE = frozenset("ad ads advert advertisement comment comments promo related reply sponsored".split())
# words that only say what kind of box it is; a name of other words besides ("related-work") names a topic
_BOX_WORD = frozenset("area author bar block body bottom box btn button buttons column container content field form group header "
                      "heading icons inner item items left link links list main message panel post posts right row section site slot "
                      "text thread title top unit wrap wrapper zone".split())
_CELL, _ROW = frozenset(["td", "th"]), frozenset(["td", "th", "tr"])
# elements whose end tag may be missing -> open elements that they end when they open (a p: every block element ends it)
_ENDS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": _CELL, "th": _CELL, "tr": _ROW,
         **dict.fromkeys(["tbody", "thead", "tfoot"], _ROW | {"tbody", "thead", "tfoot"})}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node(NamedTuple):
    """An open or closed block element; node 0 is the body."""

    parent: int
    tag: str
    named: bool


class Line(NamedTuple):
    """A block's text, its characters outside links and its element; blank lines have no text."""

    text: str
    free: int
    node: int


def _named(tag: str, attrs: str) -> bool:
    """Whether tag, class, id or role name something other than main text."""
    if tag in _NAMED_TAG:
        return True
    if "=" in attrs and tag not in ("body", "html", "main"):
        wanted = _NAMED_ARTICLE if tag == "article" else _NAMED_WORD
        for m in _ATTR.finditer(attrs):
            for name in (m[1] or m[2] or m[3] or "").lower().split():
                words = set(_WORD.findall(name))
                if not wanted.isdisjoint(words) and words <= wanted | _BOX_WORD:
                    return True
    return False


def _without_raw(page: str) -> str:
    """``page`` without comments and the elements of ``_RAW``; of one that is never closed only the tag goes,
    but scripts, styles and comments go up to the page's end."""
    out, at, unclosed = [], 0, set()
    while m := _RAW.search(page, at):
        out.append(page[at:m.start()])
        at, tag = m.end(), (m[1] or "").lower()
        if not tag:
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
        elif not m[0].endswith("/>"):
            end = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif tag in ("script", "style"):
                at = len(page)
            else:
                unclosed.add(tag)
        out.append("\0" if tag else " ")
    return "".join([*out, page[at:]])


def lines(page: str) -> tuple[list[Line], list[Node]]:
    """The blocks and blank lines of a page, and its block elements."""
    page = _without_raw(_HEAD.sub("", page))
    out: list[Line] = []
    nodes = [Node(0, "body", False)]
    opened = [0]
    n_open: Counter[str] = Counter()
    text: list[str] = []
    linked = 0
    link = False

    def end_block(blanks: int) -> None:
        nonlocal linked
        line = " ".join("".join(text).replace("\0", " ").split())
        if line:
            out.append(Line(line, max(0, len(line) - linked), opened[-1]))
        text.clear()
        linked = 0
        out.extend([Line("", 0, 0)] * blanks)

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            plain = _html.unescape(raw) if "&" in raw else raw
            text.append(plain)
            if link:
                linked += len(" ".join(plain.split()))

    def close() -> str:
        tag = nodes[opened.pop()].tag
        n_open[tag] -= 1
        return tag

    at = 0
    for m in _TAG.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or tag in ("html", "body"):
            continue
        closing, attrs = bool(m[1]), m[3]
        named = not closing and tag not in _VOID and _named(tag, attrs)
        if tag == "a":
            link = not closing
        if tag == "br":
            add(" ")
        elif tag in _INLINE and not named and not n_open[tag]:
            continue
        elif tag in _VOID:
            end_block(0)
        else:
            link = link and tag == "a"
            end_block(WINDOW if named or tag in _LAYOUT else 0)
            if closing:
                while n_open[tag] and close() != tag:
                    pass
            elif not attrs.endswith("/"):
                ended = _ENDS.get(tag, ())
                while len(opened) > 1 and (nodes[opened[-1]].tag in ended or tag not in _INLINE and nodes[opened[-1]].tag == "p"):
                    close()
                nodes.append(Node(opened[-1], tag, named))
                opened.append(len(nodes) - 1)
                n_open[tag] += 1
    tail = page[at:]
    cut = re.search(r"<[/!a-zA-Z][^>]*$", tail)  # markup that the page's end cuts off
    add(tail[:cut.start()] if cut else tail)
    end_block(WINDOW)
    return out, nodes


def distribution(weight: list[float]) -> tuple[list[float], list[tuple[int, int]]]:
    """Window sums of the lines' weights, and the regions (first line, line after the last) from surge to dive."""
    padded = weight + [0.0] * WINDOW
    window = [sum(padded[i:i + WINDOW]) for i in range(len(weight))]
    regions, start = [], None
    for i, w in enumerate([*window, 0]):
        if w and start is None:
            start = i
        elif not w and start is not None:
            regions.append((start, i))
            start = None
    return window, regions


def _weights(block: list[Line], nodes: list[Node]) -> tuple[list[float], list[float]]:
    """Weight of a character of each node's own lines, and weight of each line."""
    kind, named, main = [BARE], [False], [False]
    for n in nodes[1:]:
        kind.append(HEADING if n.tag in _HEADINGS else PARAGRAPH if n.tag in _PARAGRAPHS else
                    BARE if n.tag in _LAYOUT else kind[n.parent])
        main.append(main[n.parent] or n.tag in _MAIN)
        named.append(n.named or named[n.parent] and n.tag not in _MAIN)
    per = [k * (NAMED if n else 1) * (2 if m else 1) for k, n, m in zip(kind, named, main)]
    return kind, [x.free * per[x.node] for x in block]


def _sums(nodes: list[Node], own: list) -> list:
    """Sums of ``own`` over each node and all below it."""
    total = list(own)
    for k in range(len(nodes) - 1, 0, -1):
        total[nodes[k].parent] += total[k]
    return total


def main_text(page: str | None) -> str:
    """The kept blocks of one page, joined by line feeds."""
    return "\n".join(_kept(*lines(page))) if page else ""


def _kept(block: list[Line], nodes: list[Node]) -> list[str]:
    kind, weight = _weights(block, nodes)
    window, regions = distribution(weight)
    if not regions:
        return []
    mass = [sum(weight[a:b]) for a, b in regions]
    top = max(mass)
    strong = [r for r, m in zip(regions, mass) if m == top or m >= SHARE * top and max(window[slice(*r)]) >= SURGE]
    lit = [i for a, b in strong for i in range(a, min(b + WINDOW, len(block))) if weight[i]]
    own = [0.0] * len(nodes)
    prose = [0] * len(nodes)  # characters of paragraphs and headings outside links
    for i in dict.fromkeys(lit):
        own[block[i].node] += weight[i]
    for x in block:
        if kind[x.node] > BARE:
            prose[x.node] += x.free
    held, prose_below = _sums(nodes, own), _sums(nodes, prose)
    children: list[list[int]] = [[] for _ in nodes]
    for k, n in enumerate(nodes[1:], 1):
        children[n.parent].append(k)

    def is_text(k: int) -> bool:
        """Has paragraphs or headings of its own, not inside a further container."""
        return any(prose[c] and not nodes[c].named and nodes[c].tag not in _LAYOUT for c in children[k])

    content = 0
    while best := max((c for c in children[content] if nodes[c].tag in _LAYOUT or nodes[c].named or children[c]), key=held.__getitem__, default=0):
        if held[best] < MOST * held[content]:
            break
        content = best
    if nodes[content].tag not in _LAYOUT:  # a paragraph or a cell: its container
        while content and nodes[content].tag not in _LAYOUT:
            content = nodes[content].parent
    while nodes[content].parent and (nodes[content].tag in ("table", "ul", "ol", "dl") or is_text(nodes[content].parent)):
        content = nodes[content].parent
    # of each node: below the content element, the child of it that holds it, outermost named element between
    child, mark = [-1] * len(nodes), [0] * len(nodes)
    child[content] = 0
    for k in range(content + 1, len(nodes)):
        n = nodes[k]
        if child[n.parent] >= 0:
            child[k] = child[n.parent] or k
            named = n.named and not (n.tag == "header" and content and prose_below[k])
            mark[k] = mark[n.parent] if mark[n.parent] and n.tag not in _MAIN else k if named else 0
    inside = [i for i, x in enumerate(block) if x.text and child[x.node] >= 0]
    plain = sum(block[i].free * kind[block[i].node] for i in inside if not mark[block[i].node])
    marked: Counter[int] = Counter()
    for i in inside:
        marked[mark[block[i].node]] += block[i].free * kind[block[i].node] * NAMED
    inside = [i for i in inside if not (m := mark[block[i].node]) or marked[m] > plain]
    if content and (is_text(content) or nodes[content].tag in _MAIN):
        return [block[i].text for i in inside]
    lit = [i for i in lit if child[block[i].node] >= 0]
    first, last = min(lit), max(lit)
    chosen = {child[block[i].node] for i in lit} - {0}
    free = [0] * len(nodes)
    full = [0] * len(nodes)
    for i in inside:
        free[child[block[i].node]] += block[i].free
        full[child[block[i].node]] += len(block[i].text)

    def stays(i: int) -> bool:
        c = child[block[i].node]
        if first <= i <= last or c in chosen:
            return True
        if not c or nodes[c].tag not in _LAYOUT:  # a line of the element itself
            return block[i].free > 0
        return content > 0 and prose_below[c] > 0 and 2 * free[c] > full[c]

    inside = [i for i in inside if stays(i)]
    while inside and not block[inside[0]].free and kind[block[inside[0]].node] == BARE:
        inside.pop(0)  # lines of links alone at the ends are menus
    while inside and not block[inside[-1]].free and kind[block[inside[-1]].node] == BARE:
        inside.pop()
    return [block[i].text for i in inside]


@F.pandas_udf(StringType())
def _main_text(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of column ``html`` in column ``into``."""
    return pages.withColumn(into, _main_text(F.col(html)))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
