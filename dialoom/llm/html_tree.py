"""HTML pages as trees of block elements, and features of their nodes."""

from __future__ import annotations

import html
import re

import numpy as np

# Element names with a meaning of their own in HTML.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
HIDDEN = set("script style head title template noscript iframe object svg select datalist noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rt rp s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: A start tag on the left ends an open element on the right, up to the nearest stop.
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
P_STOPS = {"button", "td", "th", "caption", "object", "body", "html"}
#: The start tags that leave a head open; any other one, or text, ends it.
IN_HEAD = set("html head base basefont bgsound link meta title style script noscript noframes template".split())
#: In svg and math every element can be closed by ``/>``; these start tags end both, but not within the elements of POINTS.
FOREIGN = {"svg", "math"}
BREAKOUT = CLOSES_P | set("b big body br code dd dt em embed head i img li listing meta nobr ruby s small span strong strike sub sup tt u var".split())
POINTS = set("foreignobject desc title mi mo mn ms mtext annotation-xml".split())

# A quote opens a value only behind "="; elsewhere it is part of a name or of a value without quotes.
_VALUE = r"""=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+|)"""
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|{_VALUE})*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
#: Every attribute in turn, so that nothing inside a value is taken for another attribute.
_ATTRIBUTE = re.compile(r"""([^\s=/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)))?+""")
_NAMING = {"class", "id", "role", "itemprop"}
_MARK = re.compile(r"""data-main="([01])\"""")
_TOKEN = re.compile(r"[a-z]+")
_BLANK = re.compile(r"\s+")
_END_TAG = re.compile(r"</([a-zA-Z][^\s/>]*+)")


class Node:
    __slots__ = ("tag", "names", "parent", "parts", "label", "chars", "linked", "tags", "stops", "blocks", "children")

    def __init__(self, tag: str, names: list[str], parent: Node | None, label: int | None) -> None:
        self.tag, self.names, self.parent, self.label = tag, names, parent, label
        self.parts: list[Node | str] = []  # children, and texts of inline content in between
        self.chars = self.linked = self.tags = self.stops = self.blocks = 0
        self.children: list[Node] = []


def parse(page: str | None) -> Node:
    """The tree of the page's block elements; inline elements only count, hidden ones are left out.

    A head ends where HTML ends it, with or without ``</head>``. A hidden element hides what stands before its
    end tag; one whose end tag is missing from the rest of the page hides nothing. All of a formula's text is kept.
    """
    root = Node("html", [], None, None)
    stack: list[tuple[str, Node]] = [("html", root)]  # open elements, each with its block
    page = page or ""
    at, hidden, links, foreign = 0, 0, 0, 0
    last: dict[str, int] | None = None  # each name's last end tag

    def cut(depth: int) -> None:
        nonlocal hidden, links, foreign
        for name, _ in stack[depth:]:
            hidden -= name in HIDDEN
            links -= name == "a"
            foreign -= name in FOREIGN
        del stack[depth:]

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if stack[-1][0] == "head" and page[at : m.start()].strip():
            cut(len(stack) - 1)
        if m.start() > at and not hidden:
            _add_text(stack[-1][1], page[at : m.start()], links)
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        block = stack[-1][1]
        if m[1] or m[4]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if depth:
                cut(depth)
            continue
        attributes = m[3] or m[6] or ""
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            cut(len(stack) - 1)
        if foreign and tag in BREAKOUT:
            cut(_outside(stack))
        block = stack[-1][1]
        if (foreign or tag in FOREIGN) and _self_closed(attributes):
            if not hidden and tag not in HIDDEN:
                block.tags += 1
            continue
        if tag == "br":
            _add_text(block, " ", 0)
        if tag in VOID:
            if not hidden:
                block.tags += 1
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if not end and tag in HIDDEN and tag not in ("script", "style"):
                at = page.find("<", at)
                at = at if at >= 0 else len(page)
                continue
            at = end.end() if end else len(page)
            continue
        if tag in CLOSES_P:
            _close(stack, {"p"}, P_STOPS)
        if tag in CLOSES:
            _close(stack, *CLOSES[tag])
        block = stack[-1][1]
        if tag in HIDDEN:
            if tag == "head" and (len(stack) > 1 or root.children):
                continue
            if tag != "head":
                if last is None:
                    last = {e[1].lower(): e.start() for e in _END_TAG.finditer(page)}
                if last.get(tag, -1) < at or (tag == "noscript" and any(name == tag for name, _ in stack)):
                    continue
            hidden += 1
            foreign += tag == "svg"
            stack.append((tag, block))
        elif tag in INLINE or tag in FOREIGN or (foreign and not hidden):
            foreign += tag in FOREIGN
            block.tags += 1
            links += tag == "a"
            stack.append((tag, block))
        elif tag in ("html", "body") and len(stack) == 1:
            root.names += _names(attributes)
        else:
            mark = _MARK.search(attributes) if "data-main" in attributes else None
            node = Node(tag, _names(attributes), block, int(mark[1]) if mark else block.label)
            if not hidden:
                block.parts.append(node)
                block.children.append(node)
            stack.append((tag, node))
        links = sum(name == "a" for name, _ in stack) if tag in CLOSES_P or tag in CLOSES else links
    if stack[-1][0] == "head" and page[at:].strip():
        cut(len(stack) - 1)
    if at < len(page) and not hidden:
        _add_text(stack[-1][1], page[at:], links)
    return root


def _self_closed(attributes: str) -> bool:
    """Whether a tag ends in ``/>``; the stroke after a value without quotes belongs to the value."""
    if not attributes.endswith("/"):
        return False
    word = attributes.rsplit(None, 1)[-1]
    return "=" not in word[max(word.rfind('"'), word.rfind("'")) + 1 :]


def _outside(stack: list[tuple[str, Node]]) -> int:
    """How many open elements stay when a start tag ends the svg or math it stands in."""
    keep = len(stack)
    for k in range(len(stack) - 1, 0, -1):
        if stack[k][0] in POINTS:
            break
        if stack[k][0] in FOREIGN:
            keep = k
    return keep


def _names(attributes: str) -> list[str]:
    if not attributes.strip():
        return []
    found = (m for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in _NAMING)
    return [t for m in found for t in _TOKEN.findall((m[2] or m[3] or m[4] or "").lower())]


def _add_text(block: Node, text: str, links: int) -> None:
    if "&" in text:
        text = html.unescape(text)
    block.parts.append(text)
    size = len(text) - text.count(" ")
    block.chars += size
    if links:
        block.linked += size
    block.stops += text.count(".") + text.count(",")


def _close(stack: list[tuple[str, Node]], names: set[str], stops: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k][0] in names:
            del stack[k:]
            return
        if stack[k][0] in stops or stack[k][0] in HIDDEN or stack[k][0] == "math":
            return


def blocks(node: Node, keep: set[int] | None, number: dict[int, int]) -> list[str]:
    """The texts of kept nodes in page order, white space inside a block turned into one space."""
    out: list[str] = []
    run: list[str] = []
    todo: list[tuple[Node, int]] = [(node, 0)]

    def flush() -> None:
        if run:
            text = _BLANK.sub(" ", "".join(run)).strip()
            if text:
                out.append(text)
            run.clear()

    while todo:
        here, k = todo.pop()
        kept = keep is None or number[id(here)] in keep
        while k < len(here.parts):
            part = here.parts[k]
            k += 1
            if isinstance(part, str):
                if kept:
                    run.append(part)
            else:
                flush()
                todo.append((here, k))
                todo.append((part, 0))
                break
        else:
            flush()
    return out


def preorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.children))
    return out


#: Attribute tokens and element names that are features, a fixed list.
TOKENS = (
    "article main content post story entry body text nav menu navbar breadcrumb header masthead banner footer bottom copyright aside "
    "sidebar rail widget related ad ads advert advertisement sponsor sponsored promo promotion notice cookie consent alert popup modal "
    "form search login subscribe newsletter signup comment comments discussion reply respond disqus share social tags meta author "
    "p h ul ol li table td div section blockquote pre figure"
).split()
_AT = {t: k for k, t in enumerate(TOKENS)}
NUMBERS = 17


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node: numbers of its subtree and place, own tokens, tokens of its ancestors."""
    number = {id(n): k for k, n in enumerate(nodes)}
    sums = np.array([[n.chars, n.linked, n.tags + 1, n.stops, 1] for n in nodes], float)
    parents = [number[id(n.parent)] if n.parent is not None else -1 for n in nodes]
    own = np.zeros((len(nodes), len(TOKENS)))
    depth, order = np.zeros(len(nodes)), np.zeros(len(nodes))
    for k, n in enumerate(nodes):
        tag = "h" if re.fullmatch("h[1-6]", n.tag) else n.tag
        for t in (tag, *n.names):
            at = _AT.get(t)
            if at is not None:
                own[k, at] = 1
    totals = sums.copy()
    for k in range(len(nodes) - 1, 0, -1):
        totals[parents[k]] += totals[k]
    above = np.zeros_like(own)
    siblings = np.ones(len(nodes))
    for k, n in enumerate(nodes):
        if parents[k] >= 0:
            depth[k] = depth[parents[k]] + 1
            above[k] = np.maximum(above[parents[k]], own[parents[k]])
        for place, child in enumerate(n.children):
            order[number[id(child)]] = place
            siblings[number[id(child)]] = len(n.children)
    parent = np.array([max(p, 0) for p in parents])
    chars, linked, tags, stops, count = totals.T
    page = max(totals[0, 0], 1.0)
    link_share = linked / np.maximum(chars, 1)
    density = chars / tags
    before, after = np.zeros((len(nodes), 2)), np.zeros((len(nodes), 2))
    for n in nodes:
        at = [number[id(c)] for c in n.children]
        for a, b in zip(at[:-1], at[1:], strict=True):
            before[b], after[a] = (link_share[a], density[a]), (link_share[b], density[b])
    seen = np.cumsum(sums[:, 0]) - sums[:, 0]
    numbers = np.column_stack([
        np.log1p(chars), np.log1p(sums[:, 0]), link_share, np.log1p(density), stops / np.maximum(chars, 1), np.log1p(count),
        depth, order, siblings, order / siblings, chars / page, chars / np.maximum(chars[parent], 1), seen / page,
        before[:, 0], np.log1p(before[:, 1]), after[:, 0], np.log1p(after[:, 1]),
    ])
    return np.hstack([numbers, own, above])
