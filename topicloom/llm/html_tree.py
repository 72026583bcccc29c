"""A small HTML reader: block elements and text blocks of a page, with the features that the extraction model reads."""

from __future__ import annotations

import html
import re

import numpy as np

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:\b(?:id|class|role|itemprop|aria-label)\s*=\s*)(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never running text.
SILENT = frozenset("head script style title noscript template svg math iframe object canvas button select textarea audio video datalist".split())
RAW = frozenset(("script", "style", "textarea", "title"))
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: A start tag of the key closes an open element of the value, unless one of the scope's elements stands between.
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPE = frozenset("ul ol dl table html body".split())

#: Kinds of tags and of attribute tokens that are features of a node.
TAG_KINDS = (
    frozenset(("article", "main")), frozenset(("nav", "menu")), frozenset(("header", "hgroup")), frozenset(("footer",)), frozenset(("aside", "dialog")),
    frozenset(("form", "fieldset")), frozenset(("p",)), frozenset(("h1", "h2", "h3", "h4", "h5", "h6")), frozenset(("ul", "ol", "dl")), frozenset(("li", "dd", "dt")),
    frozenset(("div", "section", "center")), frozenset(("table", "tbody", "tr", "td", "th")), frozenset(("blockquote", "pre", "figure", "figcaption")), frozenset(("html", "body")),
)
TOKEN_KINDS = (
    frozenset("article articlebody content main post entry story text body prose".split()),
    frozenset("nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs".split()),
    frozenset("header masthead top banner logo topbar".split()),
    frozenset("footer bottom copyright colophon legal".split()),
    frozenset("sidebar aside side rail widget related recommended recommendations more popular trending tags".split()),
    frozenset("ad ads advert advertisement advertising sponsor sponsored promo promotion".split()),
    frozenset("cookie cookies consent notice alert popup modal overlay gdpr message warning banner".split()),
    frozenset("comment comments disqus reply replies respond discussion reader".split()),
    frozenset("form login signup subscribe newsletter search contact".split()),
    frozenset("share sharing social follow author byline meta".split()),
)
N_FEATURES = 2 * (len(TAG_KINDS) + len(TOKEN_KINDS)) + 13


class Node:
    __slots__ = ("tag", "parent", "children", "attrs", "depth", "parts", "links", "text", "length", "link_length", "leaves", "tags", "words", "stops")

    def __init__(self, tag: str, parent: Node | None, attrs: str):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        self.parts: list[str] = []
        self.links = self.length = self.link_length = self.leaves = self.tags = self.words = self.stops = 0
        self.text = ""


def parse(page: str) -> list[Node]:
    """Nodes in page order: block elements, and leaves (tag "#") that hold the text between two block boundaries."""
    root = Node("#root", None, "")
    nodes, stack, block, leaf = [root], [("#root", True)], root, None
    at, quiet, in_link, end = 0, 0, 0, len(page)

    def say(text: str) -> None:
        nonlocal leaf
        if not text or quiet:
            return
        if leaf is None:
            if text.isspace():
                return
            leaf = Node("#", block, "")
            block.children.append(leaf)
            nodes.append(leaf)
        leaf.parts.append(text)
        if in_link:
            leaf.links += len(text)

    def pop(down_to: int) -> None:
        nonlocal block, leaf, quiet, in_link
        while len(stack) > down_to:
            tag, is_block = stack.pop()
            quiet -= tag in SILENT
            in_link -= tag == "a"
            if is_block:
                block, leaf = block.parent, None

    def last(tags: tuple[str, ...], scope: frozenset[str]) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                return k
            if stack[k][0] in scope:
                return 0
        return 0

    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        found = _TAG.match(page, start) if start < end else None
        if start > at:
            say(html.unescape(page[at:start]) if "&" in page[at:start] else page[at:start])
        if start == end:
            break
        if not found:
            say("<")
            at = start + 1
            continue
        at = found.end()
        close, name, attrs = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not name:
            continue
        name = name.lower()
        if close:
            if name == "br":
                say(" ")
            elif k := last((name,), frozenset(("table",)) if name not in ("table", "html", "body") else frozenset()):
                pop(k)
            continue
        if name in VOID:
            if name in ("br", "hr", "img", "input", "wbr"):
                if name == "hr":
                    leaf = None
                elif name != "wbr":
                    say(" ")
            block.tags += 1
            continue
        if name == "body" and (k := last(("head",), frozenset())):
            pop(k)
        if name in CLOSES and (k := last(CLOSES[name], SCOPE)):
            pop(k)
        if name in BLOCKS and (k := last(("p",), frozenset(("table", "button")))):
            pop(k)
        is_block = name in BLOCKS
        if is_block:
            block = Node(name, block, attrs)
            block.parent.children.append(block)
            nodes.append(block)
            leaf = None
        else:
            block.tags += 1
        if attrs.endswith("/") and not is_block and name not in ("a",):
            continue
        stack.append((name, is_block))
        quiet += name in SILENT
        in_link += name == "a"
        if name in RAW:
            ends = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = ends.start() if ends else end
    for node in nodes:
        if node.tag == "#":
            node.text = " ".join("".join(node.parts).split())
    return nodes


def _tokens(attrs: str) -> set[str]:
    return {t.lower() for value in _ATTRIBUTE.findall(attrs) for t in _TOKEN.findall(value)} if "=" in attrs else set()


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node: kind of tag and attribute tokens, its own and its ancestors', subtree sizes and densities, depth,
    and its place among its siblings."""
    for node in reversed(nodes):
        if node.tag == "#":
            node.length, node.link_length, node.leaves = len(node.text), min(node.links, len(node.text)), 1
            node.words, node.stops = node.text.count(" ") + 1, node.text.count(". ") + node.text.count(", ") + node.text.endswith((".", "!", "?"))
        if up := node.parent:
            up.length += node.length
            up.link_length += node.link_length
            up.leaves += node.leaves
            up.words += node.words
            up.stops += node.stops
            up.tags += node.tags + (node.tag != "#")
    kinds, out = len(TAG_KINDS) + len(TOKEN_KINDS), np.zeros((len(nodes), N_FEATURES), np.float32)
    row = {id(node): k for k, node in enumerate(nodes)}
    total = nodes[0].length + 1
    for k, node in enumerate(nodes):
        x = out[k]
        if node.tag != "#":
            for j, tags in enumerate(TAG_KINDS):
                if node.tag in tags:
                    x[j] = 1
            if node.attrs and (tokens := _tokens(node.attrs)):
                for j, kind in enumerate(TOKEN_KINDS, len(TAG_KINDS)):
                    x[j] = len(tokens & kind)
        up = node.parent
        if up:
            above = out[row[id(up)]]
            np.maximum(above[:kinds], above[kinds : 2 * kinds], out=x[kinds : 2 * kinds])
        n = node.length
        x[2 * kinds :] = (
            np.log1p(n), node.link_length / (n + 1), n / (node.tags + 1), n / total, n / (up.length + 1) if up else 1, node.depth, node.leaves,
            len(up.children) if up else 0, 0, node.words / (node.leaves + 1), node.stops / (node.words + 1), n / (node.words + 1), node.tag == "#",
        )
    for node in nodes:
        for j, child in enumerate(node.children):
            out[row[id(child)], 2 * kinds + 8] = (j + 1) / (len(node.children) + 1)
    return out


def decode(nodes: list[Node], logits: np.ndarray) -> list[bool]:
    """Which nodes belong to the article: the choice of most total log odds under which no node is kept without its parent."""
    best = logits.astype(float).tolist()
    row = {id(node): k for k, node in enumerate(nodes)}
    for k in range(len(nodes) - 1, 0, -1):
        if best[k] > 0:
            best[row[id(nodes[k].parent)]] += best[k]
    kept = [False] * len(nodes)
    for k, node in enumerate(nodes):
        kept[k] = best[k] > 0 and (k == 0 or kept[row[id(node.parent)]])
    return kept
