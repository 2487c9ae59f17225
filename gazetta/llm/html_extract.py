"""Main-text extraction by minimum-cut labelling.

A page is cut into blocks (the text between block-level tags).  A classifier turns each block's ancestors, class and id
words, link share and text shape into two costs, one per label; they are the capacities of its terminal edges.  Each
kind of evidence has a bounded cost (``_COST``), on the scale of the ties: elements and words that name boilerplate
outright outweigh what text and ties can say, words that name either (meta, byline, legal, side) do not.  Neighbouring
blocks, and successive blocks of the same parent, are tied by edges whose capacity falls with their distance in the
tree, so a short line among paragraphs or a bare word among links goes with its neighbours.  The minimum cut of that
graph, found by blocking flows (Dinic), labels each block content or boilerplate.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined by a newline.

Defined cases: null html is an empty page and gives an empty text; broken or cut-off markup closes at the end of the
page, and a tag that never ends is dropped; a head that is not closed ends at the first tag or text that cannot stand in
it; elements nested deeper than 512 are taken as siblings, as browsers do; empty tables give no rows; repeated rows are
each done; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?P<end>>|$)", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")
_SPACE = re.compile(r"[\s ]+")
#: Elements by what they do to text.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math meter nobr q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr br".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title select option svg math object audio video canvas head".split())
_RAW_TEXT = frozenset("script style textarea title iframe".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_ITEMS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd dt", ("dl",)), "dd": ("dd dt", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
_IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Elements, words of class and id, and roles that tell boilerplate or content.
_BAD_TAGS = frozenset("nav footer aside form button fieldset menu dialog".split())
_BAD_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements adsbygoogle adsense banner banners sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr popup modal sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs pager pagination footer masthead topbar toolbar comment comments commentlist respond reply replies disqus newsletter subscribe subscription signup login".split())
_DOUBTFUL_WORDS = frozenset("alert notice notices overlay related recommended recommendations trending share sharing social widget widgets tagcloud".split())
_EITHER_WORDS = frozenset("side aside crumbs foot copyright header discussion search tags byline meta skip hidden legal disclaimer".split())
#: Names that begin so tell of a part elsewhere (has-sidebar); an article of these classes is a comment or an advert.
_ELSEWHERE = frozenset("has with without no not is".split())
_NO_ARTICLE = frozenset("comment reply ad advert promo sponsored".split())
_GOOD_ROLES = frozenset("main article".split())
_GOOD_WORDS = frozenset("article content main story post entry body text maintext".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Costs of calling a block content (bad ...) or boilerplate (the others).
_COST = {"bad": 9.0, "bad and good": 7.0, "doubtful": 5.5, "either": 2.0, "outside": 3.5, "links": 3.0, "mark": 4.0, "scrap": 1.0, "article": 3.0, "good": 1.5, "heading": 1.5, "paragraph": 1.0, "words": 2.0, "sentence": 0.5}
_NEXT_TO, _SAME_PARENT = 3.0, 1.0
_DEEPEST = 512


class _Node:
    __slots__ = ("tag", "parent", "depth", "cost", "good", "link", "skip")

    def __init__(self, tag: str, parent: _Node | None, attrs: str = ""):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.cost, self.good = (parent.cost, parent.good) if parent else (0.0, 0.0)
        self.link = tag == "a" or bool(parent and parent.link)
        self.skip = tag in _RAW or bool(parent and parent.skip)
        in_article = bool(parent and parent.good >= _COST["article"])
        if tag in _BAD_TAGS or tag == "header" and not in_article:
            self._bad("bad")
        elif tag in ("article", "main"):
            self.good = max(self.good, _COST["article"])
        if attrs:
            found = {a.lower(): b or c or d or "" for a, b, c, d in _ATTR.findall(attrs)}
            names = [[w.lower() for w in _NAME_WORD.findall(name)] for k in ("class", "id") for name in found.get(k, "").split()]
            words = {w for name in names if name and name[0] not in _ELSEWHERE for w in name}
            role = found.get("role", "").lower()
            if role in _GOOD_ROLES:
                self.good = max(self.good, _COST["article"])
            if role in _BAD_ROLES or found.get("aria-hidden") == "true" or "hidden" in found or re.search(r"display:\s*none|visibility:\s*hidden", found.get("style", "")):
                self._bad("bad")
            elif tag == "article" and any(len(n) == 1 and n[0] in _NO_ARTICLE for n in names):
                self._bad("bad")
            elif words and tag not in ("html", "body", "article", "main") and not (tag in ("h1", "h2") and in_article):
                good = bool(words & _GOOD_WORDS)
                if words & _BAD_WORDS:
                    self._bad("bad and good" if good else "bad")
                elif words & _DOUBTFUL_WORDS:
                    self._bad("doubtful")
                elif words & _EITHER_WORDS:
                    self._bad("either")
                elif good:
                    self.good = max(self.good, _COST["good"])

    def _bad(self, kind: str) -> None:
        self.cost = max(self.cost, _COST[kind])


class _Block:
    __slots__ = ("node", "text", "linked")

    def __init__(self, node: _Node, text: str, linked: int):
        self.node, self.text, self.linked = node, text, linked


def blocks_of(page: str) -> list[_Block]:
    root = node = _Node("html", None)
    out: list[_Block] = []
    parts: list[tuple[str, bool]] = []
    holder = root

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(p for p, _ in parts))).strip()
            if text:
                out.append(_Block(holder, text, sum(len(p) for p, linked in parts if linked)))
            parts.clear()

    def close(tags: tuple[str, ...] | frozenset, barrier: tuple[str, ...] | frozenset) -> None:
        nonlocal node
        at = node
        while at is not None and at.tag not in tags:
            if at.tag in barrier:
                return
            at = at.parent
        if at is not None and at.parent is not None:
            node = at.parent

    def say(text: str) -> None:
        nonlocal holder, node
        if node.tag == "head" and text.strip():
            close(("head",), ("html",))
        if text and not node.skip:
            if not parts:
                holder = node
                while holder.tag in _INLINE and holder.parent is not None:
                    holder = holder.parent
            parts.append((text, node.link))

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            say(entities.escape(m["cdata"]))
        if m["tag"] is None:
            continue
        if not m["end"]:
            break  # the page ends inside a tag
        tag = m["tag"].lower()
        if tag == "br" or tag == "wbr":
            if tag == "br":
                say(" ")
            continue
        inline = tag in _INLINE
        if not inline:
            flush()
        if m["close"]:
            if tag == "p":
                close(("p",), frozenset(("article", "body", "html", "td")))
            elif inline:
                close((tag,), _CLOSES_P | frozenset(("li", "td", "th", "body", "html")))
            else:
                close((tag,), ("html",) if tag != "li" else ("ul", "ol", "html"))
            continue
        if tag in _CLOSES_P:
            close(("p",), frozenset(("article", "section", "div", "body", "html", "td", "li", "blockquote", "main", "aside", "nav", "footer", "header", "form")))
        elif tag in _ITEMS:
            closes, barrier = _ITEMS[tag]
            for name in closes.split():
                close((name,), barrier)
        if node.tag == "head" and tag not in _IN_HEAD:
            close(("head",), ("html",))
        if tag in _VOID or m["attrs"].endswith("/"):
            continue
        if node.depth >= _DEEPEST:
            node = node.parent
        child = _Node(tag, node, m["attrs"])
        if tag in _RAW_TEXT:
            stop = re.compile(rf"</{tag}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        node = child
    flush()
    return out


def costs(block: _Block, has_article: bool = False) -> tuple[float, float]:
    """(cost of calling it boilerplate, cost of calling it content)."""
    text, node = block.text, block.node
    words = text.count(" ") + 1
    heading = node.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    running = node.tag in ("p", "blockquote", "pre")
    content = node.good + _COST["words"] * min(words, 40) / 40 + heading * _COST["heading"] + running * _COST["paragraph"]
    if text[-1] in ".!?…\"”" and words > 3:
        content += _COST["sentence"]
    boiler = node.cost + _COST["links"] * min(1.0, block.linked / max(1, len(text)))
    if has_article and node.good < _COST["article"]:
        boiler += _COST["outside"]
    if words <= 3 and not (heading or running or node.tag in ("td", "th", "li", "dd", "dt")):
        boiler += _COST["scrap"]
    if text[:1] == "©" or text.startswith("Copyright"):
        boiler += _COST["mark"]
    return content, boiler


def _distance(a: _Node, b: _Node, most: int = 12) -> int:
    """Steps between two nodes of the tree; beyond ``most`` a tie is next to nothing."""
    steps = 0
    while a is not b and steps < most:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def graph_of(blocks: list[_Block]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """For each block the cost of boilerplate less that of content (flow straight through a block changes no cut), and the ties."""
    has_article = any(b.node.good >= _COST["article"] for b in blocks)
    excess = [keep - drop for keep, drop in (costs(b, has_article) for b in blocks)]
    ties, last = [], {}
    for j, b in enumerate(blocks):
        if j:
            ties.append((j - 1, j, _NEXT_TO / (1 + _distance(blocks[j - 1].node, b.node))))
        i = last.get(id(b.node.parent))
        if i is not None and i != j - 1:
            ties.append((i, j, _SAME_PARENT / math.sqrt(j - i)))
        last[id(b.node.parent)] = j
    return excess, ties


def label(blocks: list[_Block]) -> list[bool]:
    """True for content: the source side of the minimum cut."""
    return source_side(*graph_of(blocks))


def source_side(excess: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut by blocking flows.  Positive excess is room from the source, negative room to the sink; ties bear flow both ways."""
    n, eps = len(excess), 1e-9
    left, to, room, arcs = list(excess), [], [], [[] for _ in range(n)]
    for i, j, w in ties:
        arcs[i].append(len(to))
        arcs[j].append(len(to) + 1)
        to += (j, i)
        room += (w, w)
    while True:
        level = [0 if x > eps else -1 for x in left]
        layer, depth, met = [i for i in range(n) if level[i] == 0], 0, False
        while layer and not met:  # up to the first layer that reaches the sink
            depth += 1
            after = []
            for u in layer:
                for e in arcs[u]:
                    v = to[e]
                    if level[v] < 0 and room[e] > eps:
                        level[v] = depth
                        after.append(v)
                        met = met or left[v] < -eps
            layer = after
        if not met:
            return [x >= 0 for x in level]
        at = [0] * n
        for source in [i for i in range(n) if level[i] == 0]:
            path, u = [], source
            while left[source] > eps:
                if left[u] < -eps:
                    flow = min([left[source], -left[u], *[room[e] for e in path]])
                    left[source] -= flow
                    left[u] += flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    path, u = [], source
                    continue
                mine = arcs[u]
                while at[u] < len(mine) and not (room[mine[at[u]]] > eps and level[to[mine[at[u]]]] == level[u] + 1):
                    at[u] += 1
                if at[u] < len(mine):
                    path.append(mine[at[u]])
                    u = to[path[-1]]
                elif path:
                    u = to[path.pop() ^ 1]
                    at[u] += 1
                else:
                    break


def main_text(page: str | None) -> str:
    blocks = blocks_of(page) if page else []
    return "\n".join(b.text for b, keep in zip(blocks, label(blocks), strict=True) if keep) if blocks else ""


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the html by default), text and n_chars."""

    def judge(pages: list[str | None]) -> list[pa.Array]:
        texts = [main_text(p) for p in pages]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    keep = [c for c in pages.columns if c != html_col] if keep is None else keep
    return map_texts(pages, html_col, keep, "text string, n_chars long", judge)
