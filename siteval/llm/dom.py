"""A small DOM of a page: elements, texts in page order, and features of each element."""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("head title script style noscript template iframe object svg canvas audio video select option textarea "
                   "button input form label fieldset datalist dialog".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody "
                   "td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption".split())
CLOSED_BY_SAME = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"},
                  "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Words of tags, classes, ids and roles that mark what is around an article, and what is one.
AROUND = frozenset("nav navbar navigation menu menubar header masthead footer aside sidebar side cookie cookies consent notice "
                   "notices banner ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion "
                   "form search login signup subscribe newsletter comment comments reply replies respond disqus share sharing "
                   "social related recommended breadcrumb breadcrumbs pagination pager popup modal overlay widget toolbar "
                   "copyright legal complementary contentinfo alert skip tags toc".split())
WITHIN = frozenset("article main content post entry story articlebody body-text".split())
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_BLANK = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "depth", "around", "within", "begin", "end", "own")

    def __init__(self, tag, parent, around, within, begin):
        self.tag, self.parent, self.around, self.within, self.begin = tag, parent, around, within, begin
        self.children, self.own = [], 0
        self.depth = 0 if parent is None else parent.depth + 1
        self.end = begin


_UNFINISHED = re.compile("<[!?/A-Za-z]")


def marks(tag: str, attrs) -> tuple[int, int]:
    """How many words of an element mark surroundings, and an article."""
    words = [tag]
    for name, value in attrs:
        if value and name in ("class", "id", "role", "itemprop", "aria-label"):
            words += _TOKEN.findall(_CAMEL.sub(" ", value).lower())
    return sum(w in AROUND for w in words), sum(w in WITHIN for w in words)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#page", None, 0, 0, 0)
        self.nodes, self.texts = [self.root], []  # texts: (node, text); node None is a block boundary
        self.stack, self.size = [self.root], 0

    def _pop(self, upto: int) -> None:
        for node in self.stack[upto:]:
            node.end = self.size
        del self.stack[upto:]

    def _close_implied(self, tag: str) -> None:
        if tag in BLOCKS:  # a block ends an open paragraph
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag == "p":
                    return self._pop(k)
                if self.stack[k].tag in BLOCKS:
                    break
        stop = CLOSED_BY_SAME.get(tag)
        if stop:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag == tag:
                    return self._pop(k)
                if self.stack[k].tag in stop:
                    return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.texts.append((None, ""))
        elif tag == "br":
            self.texts.append((self.stack[-1], " "))
        self._close_implied(tag)
        if tag in VOID:
            return
        node = Node(tag, self.stack[-1], *marks(tag, attrs), self.size)
        self.stack[-1].children.append(node)
        self.nodes.append(node)
        self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and tag in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.texts.append((None, ""))
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                return self._pop(k)
        return None

    def handle_data(self, data):
        node = self.stack[-1]
        self.texts.append((node, data))
        if node.tag not in ("script", "style"):
            n = len(_BLANK.sub(" ", data).strip())
            node.own += n
            self.size += n

    def parse_marked_section(self, i, report=1):
        """``<![`` without CDATA: a comment up to the next ``>``, as browsers take it."""
        return self.parse_bogus_comment(i)

    def finish(self):
        # a comment, declaration, instruction or tag that the page does not finish is markup, not text
        if _UNFINISHED.match(self.rawdata):
            self.rawdata = ""
        self.close()
        self._pop(0)
        return self


def parse(html: str) -> _Builder:
    b = _Builder()
    b.feed(html)
    return b.finish()


FEATURES = ("depth", "children", "place among siblings", "siblings", "siblings of the same tag", "text", "own text",
            "share of link text", "elements below", "text per element", "share of marked surroundings",
            "surroundings marks", "marks of ancestors", "article marks", "article marks of ancestors",
            "article marks below", "paragraph", "link", "not shown", "not shown above", "place in page",
            "share of the page's text", "share of paragraph text", "surroundings or not shown, here or above")


def features(page: _Builder) -> np.ndarray:
    """One row per element, in page order."""
    nodes = page.nodes
    index = {id(n): i for i, n in enumerate(nodes)}
    n = len(nodes)
    text, links, marked, paragraphs, below, inner = (np.zeros(n) for _ in range(6))
    for i in range(n - 1, -1, -1):  # children stand after their parent
        node = nodes[i]
        text[i] += node.own
        if node.tag == "a":
            links[i] = text[i]
        if node.around or node.tag in HIDDEN:
            marked[i] = text[i]
        if node.tag in PARAGRAPHS:
            paragraphs[i] = text[i]
        inner[i] += node.within
        if node.parent is not None:
            p = index[id(node.parent)]
            for a in (text, links, marked, paragraphs, inner):
                a[p] += a[i]
            below[p] += below[i] + 1
    above = np.zeros((n, 3))
    total = max(text[0], 1.0)
    rows = np.zeros((n, len(FEATURES)))
    place: dict[int, int] = {}
    tags: dict[int, Counter] = {}  # of the children of each parent, counted once
    for i, node in enumerate(nodes):
        p = node.parent
        siblings = p.children if p is not None else [node]
        k = place.get(id(p), 0)
        place[id(p)] = k + 1
        if p is not None:
            j = index[id(p)]
            above[i] = above[j] + (p.around, p.within, p.tag in HIDDEN)
        if k == 0:
            tags[id(p)] = Counter(s.tag for s in siblings)
        same = tags[id(p)][node.tag]
        t = max(text[i], 1.0)
        rows[i] = (node.depth, len(node.children), k / len(siblings), math.log1p(len(siblings)), same / len(siblings),
                   math.log1p(text[i]), math.log1p(node.own), links[i] / t, math.log1p(below[i]),
                   math.log1p(text[i] / (below[i] + 1)), marked[i] / t, node.around, above[i, 0], node.within, above[i, 1],
                   min(inner[i] - node.within, 3), node.tag in PARAGRAPHS, node.tag == "a", node.tag in HIDDEN, above[i, 2],
                   node.begin / total, text[i] / total, paragraphs[i] / t,
                   node.around + above[i, 0] + (node.tag in HIDDEN) + above[i, 2] > 0)
    return rows


COLUMN = {name: i for i, name in enumerate(FEATURES)}
# what the labels are made of is kept from the trees, so they also serve pages that mark no article
SHOWN = [i for i, name in enumerate(FEATURES) if not name.startswith("article")]


def taught(rows: np.ndarray) -> np.ndarray | None:
    """1 for elements of a marked article and those around it, 0 for the rest;
    None if the page marks no article."""
    c = COLUMN
    out_of = rows[:, c["surroundings or not shown, here or above"]] > 0
    inside = (rows[:, c["article marks"]] + rows[:, c["article marks of ancestors"]]) > 0
    if not (inside & ~out_of).any():
        return None
    return ((inside | (rows[:, c["article marks below"]] > 0)) & ~out_of).astype(np.int64)


def decode(page: _Builder, gain: np.ndarray) -> np.ndarray:
    """Which elements to keep, such that nothing is kept below a dropped element
    and the sum of gains (log odds of keeping) is greatest."""
    nodes = page.nodes
    index = {id(n): i for i, n in enumerate(nodes)}
    kept = gain.copy()
    dropped = -gain
    lost = dropped.copy()
    for i in range(len(nodes) - 1, 0, -1):
        p = index[id(nodes[i].parent)]
        kept[p] += max(kept[i], lost[i])
        lost[p] += lost[i]
    keep = np.zeros(len(nodes), dtype=bool)
    keep[0] = True
    for i in range(1, len(nodes)):
        keep[i] = keep[index[id(nodes[i].parent)]] and kept[i] > lost[i]
    return keep


def text_of_kept(page: _Builder, keep: np.ndarray) -> str:
    """Blocks of the kept elements in page order, one per line."""
    index = {id(n): i for i, n in enumerate(page.nodes)}
    blocks, held = [], []
    for node, data in [*page.texts, (None, "")]:
        if node is None:
            block = _BLANK.sub(" ", "".join(held)).strip()
            if block:
                blocks.append(block)
            held = []
        elif keep[index[id(node)]]:
            held.append(data)
    return "\n".join(blocks)
