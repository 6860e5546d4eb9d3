"""Main text of web pages by composite text density.

Every DOM node has a density: characters per tag, adjusted for links.  The sum of its children's
densities says how much text lies side by side right under it; the node of the largest sum is the
article.  The least density on the path from the body to that node is the page's threshold: parts of the
article below it that are mostly links (menus, lists of related pages) are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field as dc_field
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftline.llm.common import field, over_texts, ship, texts_of

_REST = r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+"
#: Comments, elements whose content isn't text, declarations, tags.  A tag ends before an unquoted ``<``; one whose quote never closes
#: ends at the next bracket.  Nothing is tried again, so an unclosed quote doesn't make every tag scan the rest of the page.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg)\b(?:{_REST}|[^<>]*+)>.*?(?:</\1\s*+>|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)(?:({_REST})|([^<>]*+))>", re.S | re.I
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul br".split())
#: Tags that an opening tag closes if they are open, and the tags beyond which it doesn't look.
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}} | {t: {"p"} for t in _ENDS_P}
_SCOPE = frozenset("html body table ul ol dl td th div article section main aside nav header footer button blockquote form".split())
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    parent: int
    parts: list = dc_field(default_factory=list)  # text (str) and children (int), in order
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    sum: float = 0.0


def parse(html: str) -> list[Node]:
    """The page's nodes in document order, the root first; unclosed, stray and misnested tags are put up with."""
    nodes = [Node("#root", -1)]
    open_: list[int] = [0]
    where: dict[str, list[int]] = {}  # of each tag, the places in open_ where it is
    scopes: list[int] = []  # places of scoping tags
    at = 0

    def text(piece: str) -> None:
        if piece:
            nodes[open_[-1]].parts.append(unescape(piece) if "&" in piece else piece)

    def cut(k: int) -> None:
        """Closes all from place ``k`` on; what was opened is closed once, so a page takes linear time."""
        for i in range(len(open_) - 1, k - 1, -1):
            tag = nodes[open_[i]].tag
            where[tag].pop()
            if tag in _SCOPE:
                scopes.pop()
        del open_[k:]

    for m in _TOKEN.finditer(html):
        text(html[at : m.start()])
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if m.group(2):
            places = where.get(name)
            if places and (name in _SCOPE or not scopes or scopes[-1] < places[-1]):
                cut(places[-1])
            continue
        shut = CLOSES.get(name, ())
        while k := max((where[t][-1] for t in shut if where.get(t)), default=0):
            if scopes and scopes[-1] > k:
                break
            cut(k)
            if name not in ("tr", "td", "th"):
                break
        nodes.append(Node(name, open_[-1]))
        nodes[open_[-1]].parts.append(len(nodes) - 1)
        if name not in VOID and not (m.group(4) or m.group(5) or "").endswith("/"):
            where.setdefault(name, []).append(len(open_))
            if name in _SCOPE:
                scopes.append(len(open_))
            open_.append(len(nodes) - 1)
    text(html[at:])
    return nodes


def weigh(nodes: list[Node]) -> None:
    """Sets every node's counts, composite density and density sum.

    density = C / T * log(C / LC * T / LT) to the base ln(C / (C - LC) * LC + LCb / Cb * C + e), with characters C, tags T, those
    of links LC and LT (at least 1 each), and Cb, LCb of the body.
    """
    for n in nodes:
        n.chars = sum(len(_SPACE.sub("", p)) for p in n.parts if p.__class__ is str)
    for i in range(len(nodes) - 1, 0, -1):
        n, up = nodes[i], nodes[nodes[i].parent]
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags
        up.chars += n.chars
        up.tags += n.tags + 1
        up.link_chars += n.link_chars
        up.link_tags += n.link_tags + (n.tag == "a")
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    share = body.link_chars / max(body.chars, 1)
    for n in nodes:
        if n.chars:
            t, lc, lt = max(n.tags, 1), max(n.link_chars, 1), max(n.link_tags, 1)
            base = log(n.chars / max(n.chars - n.link_chars, 1) * n.link_chars + share * n.chars + e)
            n.density = max(n.chars / t * log(max(n.chars / lc * t / lt, 1.0)) / max(base, 1e-9), 0.0)
    for n in nodes[1:]:
        nodes[n.parent].sum += n.density


def select(nodes: list[Node]) -> tuple[int, float]:
    """The node of the largest density sum in the body (the first of equals) and the path's threshold."""
    body = next((i for i, n in enumerate(nodes) if n.tag == "body"), 0)
    inside = [False] * len(nodes)
    inside[body] = True
    for i in range(body + 1, len(nodes)):
        inside[i] = inside[nodes[i].parent]
    best = max((i for i in range(len(nodes)) if inside[i]), key=lambda i: (nodes[i].sum, -i))
    i, least = best, nodes[best].density
    while i != body:
        i = nodes[i].parent
        least = min(least, nodes[i].density)
    return best, least


def lines(nodes: list[Node], top: int, threshold: float) -> Iterator[str]:
    """Text of a subtree, a line per block, without parts under the threshold that are mostly links."""
    out: list[str] = []
    todo: list = [top]
    while todo:
        x = todo.pop()
        if x.__class__ is str:
            out.append(x)
            continue
        n = nodes[x]
        if x != top and n.tag in BLOCK and n.density < threshold and 2 * n.link_chars > n.chars:
            out.append("\n")
            continue
        if n.tag in BLOCK:
            out.append("\n")
            todo.append("\n")
        # line ends of the source are spaces; those of blocks are marks of their own
        todo += [p.replace("\n", " ") if p.__class__ is str else p for p in reversed(n.parts)]
    for line in "".join(out).split("\n"):
        line = _SPACE.sub(" ", line).strip()
        if line:
            yield line


@dataclass
class Page:
    title: str
    text: str
    tag: str
    threshold: float


def extract_one(html: str) -> Page:
    nodes = parse(html)
    weigh(nodes)
    best, threshold = select(nodes)
    title = next((i for i, n in enumerate(nodes) if n.tag == "title"), None)
    return Page(" ".join(lines(nodes, title, 0.0)) if title is not None else "", "\n".join(lines(nodes, best, threshold)), nodes[best].tag, threshold)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, title, text, tag (of the node selected), threshold, n_chars.

    Null html: title, text, tag and threshold null, n_chars null.  Empty html and html without text: empty text.
    Repeated rows: a row each.  Scripts, styles and comments aren't text.  Of nodes with equal density sums the first is selected.
    Entities count as the characters they stand for.  An empty table gives none; pages of any length and however malformed
    take linear time.  Other columns are ignored.
    """
    ship(pages.sparkSession)
    schema = T.StructType([field(pages, id_col), *(T.StructField(c, T.StringType()) for c in ("title", "text", "tag")), T.StructField("threshold", T.DoubleType()), T.StructField("n_chars", T.LongType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [None if h is None else extract_one(h) for h in batch.column(1).to_pylist()]
        col = lambda f, kind: pa.array([None if p is None else f(p) for p in got], kind)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), col(lambda p: p.title, pa.string()), col(lambda p: p.text, pa.string()), col(lambda p: p.tag, pa.string()), col(lambda p: round(p.threshold, 6), pa.float64()), col(lambda p: len(p.text), pa.int64())], names=schema.names
        )

    return texts_of(pages, id_col, html_col).mapInArrow(over_texts(work), schema)
