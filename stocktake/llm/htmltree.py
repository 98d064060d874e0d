"""Main text of web pages by a tree-structured graphical model.

A page is parsed into a tree of block elements.  Each node is content or
boilerplate.  A node's potential comes from its own features: tag, link density,
length, and what its class and id say, which counts differently for an element
that holds most of the page's text or its heading.  A parent and child share a
potential that depends on the child's kind, and on whether the parent is named or
made as a part beside the text.  No name decides for all that stands below it.  Messages go up the tree and down again
(sum-product), which gives every node its exact marginal.  The parameters are
fitted by maximum likelihood on labelled pages: the gradient is the difference
between the features of the labels and their expectation under the model.

The text of a page is that of its text blocks with a content marginal of one
half or more.  Pages without such a block have an empty text.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, over_batches, text_slices

# fixed values: kinds of elements in HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg annotation select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img math semantics mrow mi mo mn ms mtext mspace mstyle msup msub msubsup mfrac msqrt mroot munder mover munderover mpadded mphantom".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
# opening one of these closes an open one of those, up to the given holder
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"})}

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/<>\"']*)([^<>\"']*)|!--|[!?])")
_PLAIN = re.compile(r"[^<>\"']*")
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")

#: how far up a tag looks for an element that it closes
NEAR = 64

GOOD = frozenset("article content post entry main body story text page blog hentry prose".split())
BAD = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo promoted popup modal overlay cookie cookies consent gdpr notice notices alert nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer foot bottom sidebar side aside widget widgets related recommended recommendations more share sharing social comment comments disqus reply replies discussion respond form search login signup subscribe newsletter copyright legal toolbar pager pagination tags meta byline skip toc topbar trending outbrain taboola hidden".split()
)
#: words beside which such a name tells how a page is laid out, not what a part is
MODIFIERS = frozenset("has have no not with without is show shows hide hides enabled disabled enable disable left right open opened closed fixed sticky on off active inactive layout col cols column columns mode style theme aware ready below above toggled count".split())


class Node:
    """A block element, or a run of text and inline elements inside one."""

    __slots__ = ("tag", "bad", "good", "parent", "children", "text", "size", "linked", "inside", "first", "holds", "share", "marked", "hidden", "label")

    def __init__(self, tag: str, names: list[str], parent: int, hidden: bool, label: int | None) -> None:
        self.tag, self.parent, self.hidden, self.label = tag, parent, hidden, label
        self.bad, self.good = 0, False  # 1: only beside a modifier, 2: by itself
        for name in names:
            words = {w.lower().rstrip("0123456789") for w in _SPLIT.split(name)}
            if words & BAD:
                self.bad = max(self.bad, 1 if words & MODIFIERS else 2)
            elif words & GOOD:
                self.good = True
        self.children: list[int] = []
        self.text: list[str] = []
        self.size = self.linked = 0  # letters below, and those of them in links
        self.inside = False  # below an article or main element
        self.first = False  # the page's first h1, article or main element
        self.holds = False  # it is, or holds, the page's first h1, article or main element
        self.share = 0.0  # of the page's letters, those below
        self.marked = False  # its tag or name says that it is beside the text, and it is no holder


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(begin, end, closing, name, attributes) of the tags and comments of a
    page; comments have no name.

    Quoted values may hold any letter; a tag whose quote never closes ends at
    the next ``>``.  What was read is never read again, so the time is linear.
    """
    last = {q: page.rfind(q) for q in "\"'>"}
    at = page.find("<")
    while at >= 0:
        head = _OPEN.match(page, at)
        if head is None:
            at = page.find("<", at + 1)
            continue
        end = head.end()
        if head[2] is None:
            mark = "-->" if head[0] == "<!--" else ">"
            found = page.find(mark, end)
            end = found + len(mark) if found >= 0 else len(page)
            yield at, end, False, "", ""
        else:
            while end < len(page) and page[end] in "\"'":
                quote = page[end]
                if last[quote] <= end:  # never closed
                    found = page.find(">", end) if last[">"] > end else -1
                    end = found if found >= 0 else len(page)
                    break
                end = _PLAIN.match(page, page.index(quote, end + 1) + 1).end()
            attributes = page[head.start(3) : end]
            end += end < len(page) and page[end] == ">"
            yield at, end, bool(head[1]), head[2].lower(), attributes
        at = page.find("<", end)


def parse(page: str) -> list[Node]:
    """Nodes of a page in document order, the root first.  Unclosed and
    misnested tags are mended as browsers do for blocks."""
    nodes = [Node("#root", [], -1, False, None)]
    stack = [0]  # open blocks
    opened: Counter[str] = Counter()  # of each tag
    unclosed: set[str] = set()  # raw elements that no later tag closes
    links, text_node = 0, -1

    def open_node(tag: str, attributes: str) -> int:
        found: list[str] = []
        hidden, label = False, None
        for name, a, b, c in _ATTR.findall(attributes):
            value = a or b or c
            name = name.lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                hidden = True
            elif name in ("class", "id", "role"):
                found += value.split()
        if "data-content" in attributes:
            label = int('data-content="1"' in attributes)
        node = Node(tag, found, stack[-1], hidden or nodes[stack[-1]].hidden, label if label is not None else nodes[stack[-1]].label)
        nodes.append(node)
        nodes[stack[-1]].children.append(len(nodes) - 1)
        return len(nodes) - 1

    def add_text(text: str) -> None:
        nonlocal text_node
        if not text:
            return
        if text_node < 0:
            if text.isspace():
                return
            text_node = open_node("#text", "")
        nodes[text_node].text.append(text)
        if links:
            nodes[text_node].linked += len(text.strip())

    def close_to(depth: int) -> None:
        nonlocal text_node
        opened.subtract(nodes[i].tag for i in stack[depth:])
        del stack[depth:]
        text_node = -1

    at = 0
    for begin, end, closing, tag, attributes in tags(page):
        if begin < at:
            continue
        add_text(page[at:begin])
        at = end
        if not tag:
            continue
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE and opened[tag] > 0:
                depth = len(stack) - 1
                while nodes[stack[depth]].tag != tag:
                    depth -= 1
                close_to(depth)
            continue
        if tag in RAW:
            close = None if tag in unclosed else re.compile(rf"</{tag}\s{{0,99}}>", re.I).search(page, at)
            if close:
                at = close.end()
            else:
                unclosed.add(tag)
                at = len(page) if tag in ("script", "style", "textarea", "title") else at
            continue
        if tag in ("br", "wbr", "img"):
            if tag != "wbr":
                add_text(" ")
            continue
        if tag in INLINE:
            links += tag == "a"
            continue
        text_node = -1
        near = range(len(stack) - 1, max(0, len(stack) - 1 - NEAR), -1)
        if tag in CLOSES_P and opened["p"] > 0:
            for depth in near:
                if nodes[stack[depth]].tag == "p":
                    close_to(depth)
                    break
                if nodes[stack[depth]].tag in ("table", "td", "th", "article", "section", "div"):
                    break
        if tag in IMPLIED:
            ends, holders = IMPLIED[tag]
            for depth in near:
                if depth >= len(stack):
                    continue
                if nodes[stack[depth]].tag in holders:
                    break
                if nodes[stack[depth]].tag in ends:
                    close_to(depth)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
        if tag in VOID:
            continue
        node = open_node(tag, attributes)
        if not attributes.rstrip().endswith("/"):
            stack.append(node)
            opened[tag] += 1
        links = 0 if tag in CLOSES_P else links
    if at < len(page):
        add_text(page[at:])
    for i in range(len(nodes) - 1, 0, -1):  # what stands below each node
        node, up = nodes[i], nodes[nodes[i].parent]
        if node.tag == "#text":
            node.size = len("".join(node.text).strip())
        up.size += node.size
        up.linked += node.linked
    total, seen = max(1, nodes[0].size), set()
    away = [False] * len(nodes)  # below a small part beside the text, as comments are
    for i, node in enumerate(nodes):
        node.share = node.size / total
        if not i:
            continue
        up = nodes[node.parent]
        node.inside = up.inside or up.tag in ("article", "main")
        away[i] = away[node.parent] or ((up.bad == 2 or up.tag in _ASIDE) and up.share < 0.7)
        if node.tag in ("h1", "article", "main") and node.tag not in seen and not away[i]:
            seen.add(node.tag)
            node.first = True
            while i >= 0 and not nodes[i].holds:
                nodes[i].holds = True
                i = nodes[i].parent
    for node in nodes:
        beside = node.bad == 2 or node.tag in _ASIDE or (node.tag == "header" and not node.inside)
        # without any heading or article the text may stand in a part of an odd name
        node.marked = beside and not node.holds and (bool(seen) or node.tag in _NEVER or node.share < 0.8 or 2 * node.linked > node.size)
    return nodes


TAGS = "#root #text html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th thead tbody pre blockquote figure figcaption nav header footer aside form button fieldset address details summary".split()
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_SHARES = ("little", "some", "most")
_OWN = ["bias", "good name", "hidden", "links < 1/4", "links < 3/4", "links more", "short", "middle", "long", "sentence end", "copyright"]
_OWN += ["block links < 1/4", "block links < 3/4", "block links more", "block short", "block middle", "block long", "inside", "header inside", "form around most", "first h1", "first article", "first main"]
_OWN += [f"bad name, {how}, {what}, {share}" for how in ("modified", "plain") for what in ("beside", "holder") for share in _SHARES]
_OWN_AT = {name: len(TAGS) + 1 + i for i, name in enumerate(_OWN)}
UNARY = len(TAGS) + 1 + len(_OWN)
#: kinds of edges: by the child, and by whether the parent is marked
_CHILDREN = ["text", "text block", "list", "container", "page part", "other"]
EDGES = _CHILDREN + [f"{c} of a marked parent" for c in _CHILDREN]
_ASIDE = frozenset("nav footer aside form fieldset button".split())
_NEVER = frozenset("nav footer aside button".split())
_PARTS = frozenset("nav header footer aside form article main section".split())


def _edge(node: Node, parent: Node) -> int:
    return _child(node) + (len(_CHILDREN) if parent.marked else 0)


def _child(node: Node) -> int:
    if node.tag == "#text":
        return 0
    if node.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "figcaption", "dd", "dt"):
        return 1
    if node.tag in ("ul", "ol", "li", "dl", "table", "tr", "td", "th", "tbody", "thead"):
        return 2
    if node.tag in _PARTS:
        return 4
    return 3 if node.tag in ("div", "body", "html", "center") else 5


def features(node: Node) -> list[int]:
    """Places of the features that the node has."""
    around = node.tag == "form" and (node.holds or node.share >= 0.5)
    out = [_OWN_AT["bias"], _OWN_AT["form around most"] if around else _TAG_AT.get(node.tag, len(TAGS))]
    if node.bad:
        share = _SHARES[0 if node.share < 0.3 else 1 if node.share < 0.7 else 2]
        out.append(_OWN_AT[f"bad name, {'plain' if node.bad == 2 else 'modified'}, {'holder' if node.holds else 'beside'}, {share}"])
    elif node.good:
        out.append(_OWN_AT["good name"])
    if node.hidden:
        out.append(_OWN_AT["hidden"])
    if node.inside:
        out.append(_OWN_AT["inside"])
        if node.tag in ("header", "hgroup"):
            out.append(_OWN_AT["header inside"])
    linked = node.linked / max(1, node.size)
    density = "links < 1/4" if linked < 0.25 else "links < 3/4" if linked < 0.75 else "links more"
    if node.tag != "#text":
        if node.first:
            out.append(_OWN_AT[f"first {node.tag}"])
        out.append(_OWN_AT[f"block {density}"])
        out.append(_OWN_AT["block short" if node.size < 60 else "block middle" if node.size < 300 else "block long"])
    else:
        text = "".join(node.text).strip()
        out.append(_OWN_AT[density])
        out.append(_OWN_AT["short" if len(text) < 25 else "middle" if len(text) < 120 else "long"])
        if text.endswith((".", "!", "?", "…", ":", ";", "”", '"')):
            out.append(_OWN_AT["sentence end"])
        if "©" in text or "&copy" in text or "all rights reserved" in text.lower():
            out.append(_OWN_AT["copyright"])
    return out


class TreeModel:
    """Parameters, and sum-product inference on one tree."""

    def __init__(self, unary: np.ndarray, edge: np.ndarray) -> None:
        self.unary, self.edge = unary, edge  # log-odds of content; (kind, parent, child) log potentials

    def marginals(self, nodes: list[Node], own: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Content marginal of each node, and joint marginals of each node with
        its parent (node, parent's state, own state)."""
        n = len(nodes)
        score, kind = [float(self.unary[f].sum()) for f in own], [_edge(x, nodes[x.parent]) for x in nodes]
        pot = np.exp(self.edge).tolist()
        belief = [(1.0, float(np.exp(np.clip(s, -30, 30)))) for s in score]
        up: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):  # children stand behind their parent
            b0, b1 = belief[i]
            k = pot[kind[i]]
            m0, m1 = k[0][0] * b0 + k[0][1] * b1, k[1][0] * b0 + k[1][1] * b1
            z = m0 + m1
            up[i] = (m0 / z, m1 / z)
            p = nodes[i].parent
            p0, p1 = belief[p][0] * up[i][0], belief[p][1] * up[i][1]
            z = p0 + p1
            belief[p] = (p0 / z, p1 / z)
        marginal = np.zeros((n, 2))
        joint = np.zeros((n, 2, 2))
        z = sum(belief[0])
        marginal[0] = (belief[0][0] / z, belief[0][1] / z)
        post = [tuple(marginal[0])] * n
        for i in range(1, n):
            p, k = post[nodes[i].parent], pot[kind[i]]
            q0, q1 = p[0] / max(up[i][0], 1e-300), p[1] / max(up[i][1], 1e-300)  # the parent without this child
            b0, b1 = belief[i]
            j00, j01, j10, j11 = q0 * k[0][0] * b0, q0 * k[0][1] * b1, q1 * k[1][0] * b0, q1 * k[1][1] * b1
            z = j00 + j01 + j10 + j11
            joint[i] = ((j00 / z, j01 / z), (j10 / z, j11 / z))
            post[i] = ((j00 + j10) / z, (j01 + j11) / z)
            marginal[i] = post[i]
        return marginal[:, 1], joint


class Forest:
    """Many labelled trees as arrays, for inference on all of them at once,
    level by level."""

    def __init__(self, trees: list[list[Node]]) -> None:
        nodes = [x for t in trees for x in t]
        shift = np.repeat(np.cumsum([0] + [len(t) for t in trees[:-1]]), [len(t) for t in trees])
        parent = np.array([x.parent for x in nodes])
        self.parent = np.where(parent < 0, -1, parent + shift)
        self.kind = np.array([_edge(x, t[x.parent]) for t in trees for x in t])
        self.label = np.array([x.label or 0 for x in nodes])
        own = [features(x) for x in nodes]
        self.rows, self.columns = np.repeat(np.arange(len(nodes)), [len(f) for f in own]), np.concatenate(own)
        depth = np.zeros(len(nodes), np.int64)
        for i, p in enumerate(self.parent):
            depth[i] = depth[p] + 1 if p >= 0 else 0
        self.levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]

    def expected(self, model: TreeModel) -> tuple[np.ndarray, np.ndarray]:
        """Expected unary and edge features under the model."""
        n = len(self.parent)
        belief = np.zeros((n, 2))
        belief[:, 1] = np.bincount(self.rows, model.unary[self.columns], n)
        up = np.zeros((n, 2))
        for at in self.levels[:0:-1]:
            up[at] = np.logaddexp(model.edge[self.kind[at], :, 0] + belief[at, :1], model.edge[self.kind[at], :, 1] + belief[at, 1:])
            np.add.at(belief, self.parent[at], up[at])
        post, edges = belief.copy(), np.zeros_like(model.edge)
        for at in self.levels[1:]:
            joint = (post[self.parent[at]] - up[at])[:, :, None] + model.edge[self.kind[at]] + belief[at][:, None, :]
            joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            np.add.at(edges, self.kind[at], joint)
            post[at] = np.log(np.maximum(joint.sum(axis=1), 1e-300))
        marginal = 1 / (1 + np.exp(np.clip(post[:, 0] - post[:, 1], -50, 50)))
        return np.bincount(self.columns, marginal[self.rows], UNARY), edges


def fit(pages: list[str], steps: int = 600, rate: float = 0.05, decay: float = 1e-5) -> TreeModel:
    """Maximum likelihood on labelled pages, by gradient ascent
    with steps scaled by each parameter's recent gradients (Adam).  Elements of a
    labelled page carry ``data-content="1"`` or ``"0"``; others take the label of
    their parent, the root is boilerplate."""
    forest = Forest([parse(p) for p in pages])
    model = TreeModel(np.zeros(UNARY), np.zeros((len(EDGES), 2, 2)))
    seen_u = np.bincount(forest.columns, forest.label[forest.rows], UNARY)
    seen_e = np.zeros_like(model.edge)
    inner = np.flatnonzero(forest.parent >= 0)
    np.add.at(seen_e, (forest.kind[inner], forest.label[forest.parent[inner]], forest.label[inner]), 1)
    total, speed, size = len(forest.parent), 0.0, 0.0
    for step in range(1, steps + 1):
        expected_u, expected_e = forest.expected(model)
        gradient = np.concatenate([seen_u - expected_u, (seen_e - expected_e).ravel()]) / total
        gradient -= decay * np.concatenate([model.unary, model.edge.ravel()])
        speed, size = 0.9 * speed + 0.1 * gradient, 0.99 * size + 0.01 * gradient**2
        move = rate * (speed / (1 - 0.9**step)) / (np.sqrt(size / (1 - 0.99**step)) + 1e-6)
        model = TreeModel(model.unary + move[:UNARY], model.edge + move[UNARY:].reshape(model.edge.shape))
    return model


#: layouts of ``labelled_pages``
LAYOUTS = ["article", "article in main", "main", "content div", "post div", "section", "bare div", "grid", "table"]


def labelled_pages(count: int = 450, seed: int = 7, layout: str | None = None) -> list[str]:
    """Labelled pages to learn from, written from templates of common layouts
    (``LAYOUTS``; all of them in turn unless one is named): with and without a
    heading, headers inside articles, divs with meaningless names inside each
    other, tables for layout, one short paragraph or many long ones, side bars,
    notices, forms, adverts between paragraphs, few or many comments.  Bodies,
    wrappers and holders often have names with words of ``BAD``, and some pages
    stand in one form."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(400)]

    def words(low: int, high: int, end: str = ".") -> str:
        return " ".join(r.choices(vocabulary, k=r.randint(low, high))).capitalize() + end

    def sentences(low: int, high: int) -> str:
        return " ".join(words(1, 14) for _ in range(r.randint(low, high)))

    def links(n: int, tag: str = "li") -> str:
        return "".join(f"<{tag}><a href='/x'>{words(1, 3, '')}</a></{tag}>" for _ in range(n))

    def paragraph() -> str:
        kind = r.random()
        text = words(1, 3) if kind < 0.2 else sentences(1, 6)
        if r.random() < 0.2:
            text += f" <a href='/y'>{words(1, 3, '')}</a> " + words(2, 9)
        if r.random() < 0.15:
            text = f"<b>{text}<br>"
        if r.random() < 0.08:
            text = text.replace(".", "%%%")
        return f"<p>{text}" + ("</p>" if r.random() < 0.85 else "")

    def body() -> str:
        parts = [paragraph() for _ in range(r.choice((1, 1, 2, 3, 5, 9)))] if r.random() < 0.93 else [f"<p>{words(1, 3)}</p>"]
        extra = [
            lambda: (lambda h: f"<{h}>{words(2, 6, '')}</{h}>")(r.choice(["h2", "h2", "h3", "h4"])),
            lambda: (lambda t: f"<{t}>{''.join(f'<li>{sentences(1, 2)}</li>' for _ in range(3))}</{t}>")(r.choice(["ul", "ol"])),
            lambda: f"<dl>{''.join(f'<dt>{words(1, 3, "")}</dt><dd>{sentences(1, 2)}</dd>' for _ in range(2))}</dl>",
            lambda: f"<blockquote><p>{sentences(1, 3)}</p></blockquote>",
            lambda: f"<table><tr><td>{words(1, 4, '')}</td><td>{words(1, 4, '')}</td></tr></table>",
            lambda: f"<pre>{words(4, 9, '')}</pre>",
            lambda: f"<figure><figcaption>{words(3, 9)}</figcaption></figure>",
            lambda: f"<div class='{r.choice(['ad', 'advert', 'ads banner', 'promo', 'newsletter'])}' data-content=\"0\">{sentences(1, 2)}</div>",
            lambda: f"<aside data-content=\"0\"><p>{sentences(1, 2)}</p></aside>",
            lambda: f"<div class='{r.choice(['share', 'social', 'related', 'tags'])}' data-content=\"0\">{links(3, 'span')}</div>",
        ]
        for _ in range(r.choice((0, 0, 1, 2, 3, 4)) if len(parts) > 1 else r.choice((0, 0, 0, 1, 3))):
            parts.insert(r.randint(0, len(parts)), r.choice(extra)())
        title = f"<h1>{words(3, 9, r.choice(['', '.']))}</h1>"
        head = r.choice([title, title, f"<header>{title}</header>", f"<div class='{r.choice(['title', 'head', 'x1'])}'>{title}</div>", f"<h2>{words(2, 8, '')}</h2>", ""])
        if r.random() < 0.15:  # lines without paragraphs
            parts = ["<br>".join(sentences(1, 4) for _ in range(r.randint(1, 4)))]
        return head + "".join(parts)

    def grid(content: str) -> str:
        names = ["row", "col", "col-8", "x", "c12", "wrap", "inner", "container", "a1", "box", "grid", "cell", "left", "page-7"]
        for _ in range(r.randint(1, 3)):
            content = f"<div {r.choice(['class', 'id'])}='{r.choice(names)}'>{content}</div>"
        return content

    bad = sorted(BAD)

    def name() -> str:
        """What a body, wrapper or holder may be called though it has the text."""
        kinds = [
            lambda: f"{r.choice(['has', 'no', 'with', 'show', 'is', 'hide'])}-{r.choice(bad)}",
            lambda: f"{r.choice(bad)}-{r.choice(['left', 'right', 'enabled', 'open', 'fixed', 'off', 'layout', 'active'])}",
            lambda: f"{r.choice(['single', 'page', 'main-column', 'layout', 'x', 'site'])} {r.choice(bad)}",
            lambda: f"{r.choice(['layout', 'page', 'view'])} {r.choice(['with', 'no'])}-{r.choice(bad)} {r.choice(bad)}-{r.choice(['on', 'left'])}",
        ]
        return r.choice(kinds)()

    def named(tag: str, chance: float = 0.4) -> str:
        return f"<{tag} {r.choice(['class', 'class', 'id'])}='{name()}'>" if r.random() < chance else f"<{tag}>"

    def page(layout: str) -> str:
        nav = r.choice([f"<nav><ul>{links(6)}</ul></nav>", f"<div class='menu'>{links(6, 'span')}</div>", f"<header><p>{words(1, 4, '')}</p><nav>{links(4, 'div')}</nav></header>", f"<ul id='nav'>{links(5)}</ul>", ""])
        top = r.choice(["", f"<div class='ad'>{sentences(1, 1)}</div>", f"<div class='cookie-notice'><p>{sentences(1, 3)}</p><button>ok</button></div>", f"<div id='banner'>{words(4, 9)}</div>", f"<div role='alert' class='notice'>{sentences(1, 2)}</div>"])
        side = r.choice(["", f"<aside><h3>{words(1, 3, '')}</h3><p>{sentences(1, 3)}</p><ul>{links(4)}</ul></aside>", f"<div class='sidebar'><h3>{words(1, 3, '')}</h3><p>{sentences(1, 4)}</p></div>", f"<section class='related'><h2>{words(1, 2, '')}</h2>{links(3, 'p')}</section>"])
        form = r.choice(["", f"<form><label>{words(1, 3, '')}</label><p>{words(3, 8)}</p><input><button>{words(1, 1, '')}</button></form>"])
        comments = r.choice(["", f"<div class='comments'><h3>{words(1, 1, '')}</h3>" + "".join(f"<div class='comment'><p>{sentences(1, 4)}</p></div>" for _ in range(r.choice((2, 2, 6, 12)))) + "</div>", f"<section id='comments'><article><p>{sentences(1, 4)}</p></article></section>", f"<ol class='commentlist'><li>{sentences(1, 3)}</li></ol>"])
        foot = r.choice([f"<footer>&copy; x.example &middot; {sentences(1, 2)}</footer>", f"<div class='footer'><p>{sentences(1, 2)}</p></div>", f"<footer><p>{words(2, 6)}</p><ul>{links(3)}</ul></footer>", ""])
        mark = 'data-content="1"'
        open_, close = {
            "article": (f"<article {mark}>", "</article>"),
            "article in main": (f"<main><article {mark}>", "</article></main>"),
            "main": (f"<main {mark}>", "</main>"),
            "content div": (f"<div class='{r.choice(['content', 'entry', 'article-body'])}' {mark}>", "</div>"),
            "post div": (f"<div class='post' id='main' {mark}>", "</div>"),
            "section": (f"<div class='wrap'><section class='story' {mark}>", "</section></div>"),
            "bare div": (f"<div {mark}>", "</div>"),
            "grid": ("", ""),
            "table": ("", ""),
        }[layout]
        inside = "" if r.random() < 0.7 else comments.replace("<div class='comments'>", "<div class='comments' data-content=\"0\">").replace("<section id='comments'>", "<section id='comments' data-content=\"0\">").replace("<ol class='commentlist'>", "<ol class='commentlist' data-content=\"0\">")
        if open_ and r.random() < 0.35:  # a holder's own name, or one more
            own = name()
            open_ = open_.replace("class='", f"class='{own} ", 1) if "class='" in open_ else open_.replace(f" {mark}", f" class='{own}' {mark}", 1)
        text = f"{open_}{body()}{inside}{close}"
        if layout == "grid":
            text = grid(f"<div {mark}>{text}</div>") if r.random() < 0.5 else f"<div {mark}>{grid(text)}</div>"
        if layout == "table":
            text = f"<table><tr><td>{links(4, 'div')}</td><td {mark}>{text}</td>" + (f"<td>{side}</td>" if side else "") + "</tr></table>"
            side = ""
        elif r.random() < 0.4:
            text, side = grid(text + (f"<div class='{r.choice(['row', 'col-4', 'x'])}'>{side}</div>" if side else "")), ""
        rest = f"{nav}{top}{text}{side}{form}{'' if inside else comments}{foot}"
        if r.random() < 0.25:
            rest = f"{named('div', 0.9)}{rest}</div>"
        if not form and r.random() < 0.12:
            rest = f"<form id='{r.choice(['form1', 'aspnetForm', name()])}' method='post'><input type='hidden'>{rest}</form>"
        return f"<!DOCTYPE html><html><head><title>{words(2, 5, '')}</title><script>var a='<p>';</script></head>{named('body')}{rest}</body></html>"

    return [page(layout or LAYOUTS[k % len(LAYOUTS)]) for k in range(count)]


@lru_cache(1)
def default_model() -> TreeModel:
    """The model fitted on ``labelled_pages``; the same on every machine."""
    return fit(labelled_pages())


def extract(page: str | None, model: TreeModel) -> str:
    """Main text of one page: blocks in page order, two line ends between."""
    if not page:
        return ""
    nodes = parse(page)
    content, _ = model.marginals(nodes, [features(x) for x in nodes])
    blocks = []
    for node, p in zip(nodes, content, strict=True):
        if node.tag == "#text" and p >= 0.5 and not node.hidden:
            text = " ".join(html.unescape("".join(node.text)).split())
            if text:
                blocks.append(text)
    return "\n\n".join(blocks)


def main_text(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of each row of ``pages``
    (page_id, url, html, any other columns).  Null and empty html, and pages
    without a content block, give an empty text; null ids and urls stay null,
    repeated rows give repeated results, an empty table none.  A page of any
    length takes time in proportion.  Rows stay in place; nothing is shuffled.  ``model`` defaults to the one
    fitted on the driver from ``labelled_pages``; its few hundred numbers go
    with the tasks."""
    model = model or default_model()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, sources in text_slices(batch.column(2)):
                texts = [extract(s, model) for s in sources]
                yield batch_of(schema, batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), texts, [len(t) for t in texts])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return over_batches(rows, run, "page_id long, url string, text string, n_chars long")
