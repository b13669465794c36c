"""Main text of web pages by composite text density.

Every DOM node gets a density: its characters per tag, lowered where much of it is link text. A node's sum is that of
its children's densities. The threshold is the least density on the path from the densest node up to the body; of the
nodes that reach it, the one with the largest sum is the article. An article or main element around it is taken as a
whole, and otherwise the parts beside it, up to the body, that reach the threshold too. Page furniture (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, comments) is cut out of the tree first; a class, id, role
or label alone never takes the page's only article with it (see ``_cut``). Figures and formulas are text.

Null or empty html, and pages without such a text, give an empty text. Broken markup is read as browsers do in the
common cases: open paragraphs, list items and cells are closed by the next one, stray end tags are ignored, and a quote
opens a value only right after an equals sign; the time is linear in the page, however long. Of nodes with equal sums the first of the page wins. Every row comes back, repeated ones too; an empty
table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A quote opens a value only right after "="; elsewhere it belongs to a name or to a value without quotes.
_ATTR = r"[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+"
_MARK = re.compile(rf"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTR})*+)(?:>|\Z))", re.S)
_EACH = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_WORDS = re.compile(r"[a-z]+")
# a last slash that is not the end of a value without quotes
_CLOSED = re.compile(r"(?:^|[\s\"'/])/\Z")
# Elements of HTML by their part in a page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe svg object canvas textarea title".split())
_FURNITURE = frozenset("head nav footer aside form button select option label fieldset dialog menu audio video".split()) | _RAW
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES = {"p": _BLOCK - {"br", "body", "html", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
_HINTS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner sidebar cookie cookies consent notice notices alert comment comments disqus respond reply replies menu navbar navigation nav breadcrumb breadcrumbs footer masthead share sharing social related recommended newsletter subscribe subscription popup modal toolbar widget pagination pager skip".split())
_ADVERTS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion".split())
_ARTICLE, _TEXT = ("article", "main"), frozenset("p h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("hint", "tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "drop")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False):
        self.tag, self.parent, self.children, self.drop, self.hint = tag, parent, [], drop, 0
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def attributes(attrs: str) -> dict[str, str]:
    """The attributes of a tag, names in lower case; of equal names the first."""
    found: dict[str, str] = {}
    for m in _EACH.finditer(attrs):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return found


def _furniture(tag: str, attrs: dict[str, str], within: bool) -> bool:
    """Elements that are never text; ``within`` says that an article or main element is open."""
    if tag in _FURNITURE or tag == "header" and not within:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    return "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true" or bool(_UNSEEN.search(attrs.get("style", "")))


def _hint(attrs: dict[str, str]) -> int:
    """2 if a whole class, id, role or label says furniture, 3 if it says advert, 1 if a part of one does, else 0."""
    found = 0
    for value in (attrs[k] for k in ("class", "id", "role", "aria-label") if k in attrs):
        for token in value.lower().split():
            words = _WORDS.findall(token)
            if any(w in _HINTS for w in words):
                whole = all(w in _HINTS for w in words) and not any(c.isdigit() for c in token)
                found = max(found, 3 if whole and all(w in _ADVERTS for w in words) else 2 if whole else 1)
    return found


def _cut(root: Node) -> None:
    """Drops what its names call furniture.

    A part of a name counts only outside an article or main element and for what holds neither one nor half of the
    page's text. A whole name counts for all but what holds every article and main element of the page, and the
    paragraphs and headings inside one, which only the name of an advert drops.
    """
    nodes = _order(root)
    if not any(n.hint for n in nodes):
        return
    size, held = {}, {}
    for n in reversed(nodes):
        kids = [c for c in n.children if isinstance(c, Node) and not c.drop]
        size[id(n)] = sum(len("".join(c.split())) for c in n.children if isinstance(c, str)) + sum(size[id(c)] for c in kids)
        held[id(n)] = (n.tag in _ARTICLE) + sum(held[id(c)] for c in kids)
    within = {}
    for n in nodes:
        inside = within[id(n)] = n.parent is not None and (within[id(n.parent)] or n.parent.tag in _ARTICLE)
        if n.hint == 1:
            n.drop = not inside and not held[id(n)] and 2 * size[id(n)] < size[id(root)]
        elif n.hint:
            n.drop = not (held[id(n)] and held[id(n)] == held[id(root)]) and not (inside and n.tag in _TEXT and n.hint == 2)


_STOPS = ("table", "td", "th", "button", "body", "article", "section", "div", "blockquote", "ul", "ol", "li")
_INLINE, _WALLS = frozenset("p li b i a span".split()), ("td", "th", "body", "article")


class _Open:
    """The open elements, with the places of each tag among them, so that closing one costs what it closes."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], defaultdict(list)

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these tags, 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def close(self, place: int) -> None:
        """Closes the element at ``place`` and all inside it."""
        for node in self.nodes[place:]:
            self.places[node.tag].pop()
        del self.nodes[place:]


def parse(html: str) -> Node:
    """The page's tree; text is kept as strings among the children, furniture without any content.

    Linear in the page, whatever its markup: no end tag searches the open elements.
    """
    root = Node("#", None)
    opened = _Open(root)
    pos = 0
    while True:
        m = _MARK.search(html, pos)
        text = html[pos : m.start() if m else len(html)]
        at = opened.nodes[-1]
        if text and not at.drop:
            at.children.append(unescape(text))
        if not m:
            return root
        pos, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            up = opened.last(name)
            if up and not (name in _INLINE and opened.last(*_WALLS) > up):
                opened.close(up)
            elif name in ("p", "br") and not at.drop:
                at.children.append(Node("br", at))
            continue
        for open_tag, closers in _CLOSES.items():
            if name in closers:
                up = opened.last(open_tag)
                if up and opened.last(*_SCOPE.get(open_tag, _STOPS)) <= up:
                    opened.close(up)
        at = opened.nodes[-1]
        attrs = attributes(m[3]) if m[3] and not at.drop else {}
        node = Node(name, at, at.drop or _furniture(name, attrs, bool(opened.last(*_ARTICLE))))
        if not node.drop and name not in ("html", "body", *_ARTICLE):
            node.hint = _hint(attrs)
        if not at.drop:
            at.children.append(node)
        closed = bool(_CLOSED.search(m[3]))
        if name in _RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(html, pos) if not closed or name in ("script", "style") else None
            if end:
                pos = html.find(">", end.start())
                pos = len(html) if pos < 0 else pos + 1
            elif not closed:
                pos = len(html)
        elif name not in _VOID and not (closed and name not in _BLOCK):
            opened.push(node)


def _order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node) and not c.drop]
    return out


def measure(root: Node) -> list[Node]:
    """Fills in counts, densities and sums; returns the nodes in page order."""
    nodes = _order(root)
    for node in reversed(nodes):
        own = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        kids = [c for c in node.children if isinstance(c, Node) and not c.drop]
        node.chars = own + sum(c.chars for c in kids)
        node.tags = len(kids) + sum(c.tags for c in kids)
        link = node.tag == "a"
        node.link_chars = node.chars if link else sum(c.link_chars for c in kids)
        node.link_tags = sum(c.link_tags + (c.tag == "a") for c in kids)
    body = next((n for n in nodes if n.tag == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(nodes):
        if node.chars:
            c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
            base = math.log(c / max(1, c - node.link_chars) * node.link_chars + share * c + math.e)
            node.density = c / t * max(0.0, math.log(max(1.0, c / lc * t / lt) + math.e - 1)) / base
        node.total = sum(c.density for c in node.children if isinstance(c, Node) and not c.drop)
    return nodes


def _written(nodes: list[Node]) -> str:
    parts: list[str] = []
    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif not x.drop:
            edge = [" "] if x.tag in _BLOCK else []
            todo += edge + x.children[::-1] + edge
    return " ".join("".join(parts).split())


def main_text(html: str | None) -> str:
    """The page's article, its blocks joined by a space."""
    if not html:
        return ""
    root = parse(html)
    _cut(root)
    nodes = measure(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    below = [n for n in _order(body) if n.chars]
    if not below:
        return ""
    densest = max(below, key=lambda n: n.density)
    path, least = densest, math.inf
    while path is not None:
        least = min(least, path.density)
        path = path.parent if path is not body else None
    best = max((n for n in below if n.density >= least), key=lambda n: n.total)
    if not best.total:
        best = densest
    whole, up = None, best
    while up is not None and up is not body:
        whole = up if up.tag in ("article", "main") else whole
        up = up.parent
    if whole is not None:
        return _written([whole])
    keep, path, at = {id(best)}, set(), best
    while at is not body:
        at = at.parent
        path.add(id(at))
        keep.update(id(c) for c in at.children if isinstance(c, Node) and not c.drop and c.density >= least and c.link_chars * 2 <= c.chars)
    parts, todo = [], [body]
    while todo:
        node = todo.pop()
        if id(node) in keep and id(node) not in path:
            parts.append(node)
            continue
        todo += [c for c in reversed(node.children) if isinstance(c, Node) and not c.drop]
    return " ".join(filter(None, (_written([n]) for n in parts)))


def extracted(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
