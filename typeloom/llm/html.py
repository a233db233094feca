"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed into a tree of block-level nodes. Each node gets features of its subtree (text density,
links, punctuation), attribute tokens, depth and siblings; boosted trees, trained here on pages that this
module writes itself, give the odds that it holds main text; and a decoding over the tree picks whole
subtrees to keep or to drop, so that no node contradicts the ones above or below it.
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a piece of markup begins with; a comment and a character data section have ends of their own.
_OPENING = re.compile(r"<(?:(!--|!\[CDATA\[|[!?])|(/?)([a-zA-Z][^\s/>]*))")
_SECTION = re.compile(r"<(!--|!\[CDATA\[|[!?])")
_ENDS = {"!--": "-->", "![CDATA[": "]]>"}
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?<![^\s=\"'/>])([^\s=\"'/>]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Their content is never text of the page.
_MUTE = frozenset("head script style noscript template svg math iframe object canvas select option button textarea title audio video noembed noframes xmp".split())
#: What a head can hold; any other start tag ends it.
_IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
#: Muted elements that cannot hold one of their kind.
_SINGLE = frozenset("noscript select button option".split())
_BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre search section summary table caption tbody thead tfoot tr td th ul".split()
)
_CLOSES_P = _BLOCK - frozenset("td th tr tbody thead tfoot caption".split())
_GROUP = ("thead", "tbody", "tfoot", "caption", "colgroup")
#: Elements that a start tag ends, with all inside them, up to the nearest list, table or section around.
_SIBLING_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "caption", "colgroup"), "colgroup": ("caption", "colgroup"), "option": ("option",), "optgroup": ("optgroup",)} | dict.fromkeys(("thead", "tbody", "tfoot"), _GROUP)
_LISTS = frozenset("ul ol dl table select div section article".split())
_SCOPE = frozenset("html body article aside section main div td th table ul ol dl nav header footer form blockquote figure details fieldset li dd".split())

#: Attributes whose words are features, each in one of TOKENS hash buckets.
_NAMING = frozenset("class id role itemprop aria-label data-component".split())
TOKENS = 4096


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: tuple[int, ...] = ()
    children: list[int] = field(default_factory=list)
    own: int = 0
    links: int = 0
    marks: int = 0
    words: int = 0
    blocks: list[tuple[int, str]] = field(default_factory=list)
    n_inline: int = 0


def _tokens_of(attributes: str) -> tuple[int, ...]:
    """The buckets of the words in an element's naming attributes; words are parted at capitals and at what is no letter."""
    found = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() in _NAMING:
            found += re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(values)).lower())
    return tuple(dict.fromkeys(zlib.crc32(t.encode()) % TOKENS for t in found if len(t) > 1))


class _Markup:
    """The pieces of markup of a page, each found in time in proportion to its own length.

    A tag ends at the first > outside of quotes; where quotes leave none, at the first > at all, and without any it is
    text. What is known to lead nowhere is remembered, as the pages are whatever the web holds.
    """

    def __init__(self, page: str):
        self.page = page
        #: Places at which a quote opens, outside of others, from which no > outside of quotes is left.
        self.lost: set[int] = set()
        self.last = page.rfind(">")

    def tag_end(self, at: int) -> int:
        """Where a tag ends whose attributes begin at a place that has a > after it."""
        begin, met = at, []
        while True:
            stop = _STOP.search(self.page, at)
            if stop is not None and self.page[stop.start()] == ">":
                return stop.end()
            close = -1 if stop is None or stop.start() in self.lost else self.page.find(self.page[stop.start()], stop.end())
            if stop is not None:
                met.append(stop.start())
            if close < 0:
                self.lost.update(met)
                return self.page.find(">", begin) + 1
            at = close + 1

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """Begin, end, name, whether it is an end tag, and attributes (of a section: its text) of the next piece; a comment has no name."""
        while True:
            m = (_OPENING if at <= self.last else _SECTION).search(self.page, at)
            if m is None:
                return None
            if m[1]:
                close = _ENDS.get(m[1], ">")
                end = self.page.find(close, m.end())
                inside = self.page[m.end() : len(self.page) if end < 0 else end] if m[1] == "![CDATA[" else ""
                return m.start(), len(self.page) if end < 0 else end + len(close), "", False, inside
            if m.end() <= self.last:
                end = self.tag_end(m.end())
                return m.start(), end, m[3].lower(), m[2] == "/", self.page[m.end() : end - 1]
            at = m.end()


def _ended(page: str, tag: str, last: int) -> set[int]:
    """Where the start tags of an element begin that have an end tag of their own; ``last`` is the page's last >."""
    found: set[int] = set()
    open_: list[int] = []
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*?(/?)>", re.I).finditer(page, 0, last + 1):
        if m[1]:
            if open_:
                found.add(open_.pop())
        elif not m[2]:
            if tag in _SINGLE:
                open_.clear()
            open_.append(m.start())
    return found


def parse(page: str | None) -> list[Node]:
    """The page's block-level nodes in document order, each with its own text blocks; node 0 is the root.

    Inline elements belong to the block around them; a br or a block's edge ends a text block. Wrong or
    missing end tags are repaired as a browser does for these cases: an end tag without its start is
    ignored, an open p ends at the next block, a head at what it cannot hold. A muted element without an
    end tag ends at the next block's start tag, at one of its kind that it cannot hold, or with its parent.
    """
    nodes = [Node("#root", -1, 0)]
    if not page:
        return nodes
    # open elements, with the block node each lies in, and whether it is muted up to an end tag of its own
    stack: list[tuple[str, int, bool]] = [("#root", 0, False)]
    ended: dict[str, set[int]] = {}
    # places in the stack, of each tag, of the elements that bound a search, of muted ones, of those with an end tag
    where: dict[str, list[int]] = {}
    holders: dict[str, list[list[int]]] = {}
    in_scope, in_lists, muted, to_ends = [], [], [], []
    markup = _Markup(page)
    mute = anchors = 0
    pending: list[str] = []
    order = link_chars = pos = 0

    def flush() -> None:
        nonlocal order, link_chars
        if not pending:
            return
        text = _SPACE.sub(" ", entities.unescape("".join(pending))).strip()
        pending.clear()
        if text:
            node = nodes[stack[-1][1]]
            node.blocks.append((order, text))
            order += 1
            node.own += len(text)
            node.links += min(link_chars, len(text))
            node.marks += sum(map(text.count, ".,;:?!"))
            node.words += text.count(" ") + 1
        link_chars = 0

    def close_to(depth: int) -> None:
        nonlocal mute, anchors
        while len(stack) > depth:
            if stack[-1][0] in _BLOCK:
                flush()
            tag, _, to_end = stack.pop()
            mute -= tag in _MUTE
            anchors -= tag == "a"
            for places in held_by(tag):
                places.pop()
            if to_end:
                to_ends.pop()

    def held_by(tag: str) -> list[list[int]]:
        """The lists of places that an open element is in."""
        if tag not in holders:
            where[tag] = []
            holders[tag] = [where[tag]] + [places for held, places in ((tag in _SCOPE, in_scope), (tag in _LISTS, in_lists), (tag in _MUTE and tag != "head", muted)) if held]
        return holders[tag]

    def find(tags: tuple[str, ...], scope: list[int]) -> int:
        """The place of the innermost open element of some tags, or 0 if another element of a scope lies inside it."""
        at = max(where[t][-1] if where.get(t) else 0 for t in tags)
        return at if at and (not scope or scope[-1] <= at) else 0

    def overdue(tag: str) -> int:
        """Where the outermost muted element is that a start tag ends, or 0."""
        found = []
        if tag not in _IN_HEAD and where.get("head"):
            found.append((where["head"][0], not to_ends or to_ends[-1] < where["head"][0]))
        if to_ends:
            found.append((to_ends[0], False))
        if tag in _BLOCK and muted:
            found.append((muted[0], True))
        if tag in _SINGLE and where.get(tag):
            found.append((where[tag][0], True))
        at, ends = min(found, default=(0, False))  # False, for an element that has its end, comes first
        return at if ends else 0

    def text_between(lo: int, hi: int) -> None:
        nonlocal link_chars
        if mute == 1 and stack[-1][0] == "head" and not page[lo:hi].isspace() and hi > lo:
            close_to(len(stack) - 1)  # text ends a head
        if hi > lo and not mute:
            pending.append(page[lo:hi])
            link_chars += (hi - lo) * (anchors > 0)

    while True:
        piece = markup.next(pos)
        if piece is None:
            text_between(pos, len(page))
            break
        begin, end, tag, ends, attributes = piece
        text_between(pos, begin)
        pos = end
        if not tag:
            if attributes and not mute:
                pending.append(entities.escape(attributes))
            continue
        if ends:
            at = find((tag,), [] if tag in _BLOCK or tag in _MUTE else in_scope)
            if at:
                close_to(at)
            continue
        if mute:
            at = overdue(tag)
            if at:
                close_to(at)
        if tag in _BLOCK:
            flush()
        if tag in _CLOSES_P:
            at = find(("p",), in_scope)
            if at:
                close_to(at)
        if tag in _SIBLING_ENDS:
            at = find(_SIBLING_ENDS[tag], in_lists)
            if at:
                close_to(at)
        if tag in _VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, pos, markup.last + 1)
            pos = end.end() if end else len(page)
            continue
        block = stack[-1][1]
        if tag in _BLOCK and not mute:
            nodes[block].children.append(len(nodes))
            nodes.append(Node(tag, block, nodes[block].depth + 1, _tokens_of(attributes) if attributes else ()))
            block = len(nodes) - 1
        else:
            nodes[block].n_inline += 1
        if not attributes.rstrip().endswith("/") or tag in _BLOCK:
            to_end = tag in _MUTE and tag != "head"
            if to_end:
                if tag not in ended:
                    ended[tag] = _ended(page, tag, markup.last)
                to_end = begin in ended[tag]
            for places in held_by(tag):
                places.append(len(stack))
            if to_end:
                to_ends.append(len(stack))
            stack.append((tag, block, to_end))
            mute += tag in _MUTE
            anchors += tag == "a"
    close_to(1)
    flush()
    return nodes


_GROUPS = {t: i for i, names in enumerate(("p pre blockquote", "h1 h2 h3 h4 h5 h6", "li ul ol dl dt dd menu", "article main", "nav header footer aside search dialog address", "form fieldset", "table tr td th tbody thead tfoot caption", "div section center", "figure figcaption", "html body #root")) for t in names.split()}
_N_FEATURES = 28


def node_features(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """A row of features for each node; ``odds`` says of each token bucket how far it speaks for main text."""
    n = len(nodes)
    text, links, marks, words, size, inline = ([0] * n for _ in range(6))
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        text[i] += node.own
        links[i] += node.links
        marks[i] += node.marks
        words[i] += node.words
        inline[i] += node.n_inline
        size[i] += 1
        if node.parent >= 0:
            for held in (text, links, marks, words, size, inline):
                held[node.parent] += held[i]
    total = text[0] or 1
    rows = np.zeros((n, _N_FEATURES))
    above: list[tuple[float, float, int, int, int]] = []
    place = [0] * n
    for node in nodes:
        for k, c in enumerate(node.children):
            place[c] = k
    for i, node in enumerate(nodes):
        group = _GROUPS.get(node.tag, 7)
        own = [float(odds[t]) for t in node.tokens]
        low, high = min(own, default=0.0), max(own, default=0.0)
        before = above[node.parent] if node.parent >= 0 else (0.0, 0.0, 0, 0, 0)
        here = (min(before[0], low), max(before[1], high), before[2] + (group == 4), before[3] + (group == 3), before[4] + (group == 5))
        above.append(here)
        up = nodes[node.parent] if node.parent >= 0 else node
        around = len(up.children) or 1
        over = text[node.parent] if node.parent >= 0 else total
        t = text[i] or 1
        rows[i] = (
            math.log1p(text[i]), math.log1p(node.own), links[i] / t, marks[i] / t, t / (words[i] or 1), text[i] / size[i], text[i] / total,
            node.depth, len(node.children), size[i], inline[i] / size[i],
            low, high, sum(own), before[0], before[1], here[2], here[3], here[4],
            group, node.tag == "p", node.tag in ("h1", "h2"), node.tag == "li",
            place[i] / around, around, text[i] / (over or 1), over / around, marks[node.parent] / (over or 1) if node.parent >= 0 else 0.0,
        )
    return rows


def token_odds(trees: list[list[Node]], shares: list[np.ndarray], weights: list[np.ndarray], smooth: float = 2.0) -> np.ndarray:
    """The log odds of main text in nodes that bear a token, per bucket; 0 for one that no page has."""
    good, bad = np.full(TOKENS, smooth), np.full(TOKENS, smooth)
    for nodes, share, weight in zip(trees, shares, weights):
        for node, s, w in zip(nodes, share, weight):
            for t in node.tokens:
                good[t] += w * s
                bad[t] += w * (1 - s)
    return np.log(good / bad)


class Boosted:
    """Gradient-boosted regression trees on the logistic loss, with histogram splits."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, least: float = 8.0):
        self.n_trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> "Boosted":
        n, d = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1)
        self.base = float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
        f, width = np.full(n, self.base), 2**self.depth
        self.feature = np.zeros((self.n_trees, width - 1), np.int32)
        self.cut = np.full((self.n_trees, width - 1), np.inf)
        self.leaf = np.zeros((self.n_trees, width))
        for t in range(self.n_trees):
            p = 1 / (1 + np.exp(-f))
            g, h = weight * (y - p), weight * p * (1 - p)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                k = 2**level
                best, chosen = np.full(k, 1e-6), [(0, np.inf, self.bins)] * k
                for j in range(d):
                    cell = at * self.bins + codes[:, j]
                    gs = np.bincount(cell, g, k * self.bins).reshape(k, -1).cumsum(1)
                    hs = np.bincount(cell, h, k * self.bins).reshape(k, -1).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < self.least) | (ht - hs < self.least)] = -1
                    top = gain.argmax(1)
                    for node in np.flatnonzero(gain[np.arange(k), top] > best):
                        c = int(top[node])
                        if c < len(self.cuts[j]):
                            best[node], chosen[node] = gain[node, c], (j, float(self.cuts[j][c]), c)
                right = np.zeros(n, np.int64)
                for node, (j, value, c) in enumerate(chosen):
                    self.feature[t, k - 1 + node], self.cut[t, k - 1 + node] = j, value
                    mine = at == node
                    right[mine] = codes[mine, j] > c
                at = 2 * at + right
            gs, hs = np.bincount(at, g, width), np.bincount(at, h, width)
            self.leaf[t] = self.rate * gs / (hs + 1)
            f += self.leaf[t][at]
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(self.n_trees):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2**level - 1 + at
                at = 2 * at + (x[rows, self.feature[t][node]] > self.cut[t][node])
            out += self.leaf[t][at]
        return out


def decode(nodes: list[Node], logits: np.ndarray, split_cost: float = 1.0) -> list[bool]:
    """Which nodes' own text is main.

    A subtree is kept whole, dropped whole, or split at a cost, in which case the node's own text and each
    child's subtree decide for themselves. The best such choice over the tree is found bottom up; inside
    a subtree taken whole no node can differ from its root.
    """
    n = len(nodes)
    weight = [math.log1p(node.own) if node.own else 0.3 for node in nodes]
    keep = [w * -math.log1p(math.exp(-min(max(z, -30), 30))) for w, z in zip(weight, logits)]
    drop = [w * -math.log1p(math.exp(min(max(z, -30), 30))) for w, z in zip(weight, logits)]
    all_keep, all_drop, split = keep[:], drop[:], [0.0] * n
    best = [0.0] * n
    for i in range(n - 1, -1, -1):
        own = max(keep[i], drop[i])
        for c in nodes[i].children:
            all_keep[i] += all_keep[c]
            all_drop[i] += all_drop[c]
            own += best[c]
        split[i] = own - split_cost if nodes[i].children else -math.inf
        best[i] = max(all_keep[i], all_drop[i], split[i])
    out = [False] * n
    stack = [(0, None)]
    while stack:
        i, forced = stack.pop()
        if forced is None and best[i] > max(all_keep[i], all_drop[i]):
            out[i], inside = keep[i] > drop[i], None
        else:
            inside = forced if forced is not None else all_keep[i] > all_drop[i]
            out[i] = inside
        stack.extend((c, inside) for c in nodes[i].children)
    return out


def _words(rng: random.Random, n: int) -> str:
    syllables = "ka lo mi ter an en st re vi ção ung é ü da no per sol la tri".split()
    out = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for i in range(rng.randint(5, 12), n, rng.randint(5, 14)):
        out[i - 1] += rng.choice([",", ".", ".", ",", ";"])
    return (" ".join(out).capitalize() + rng.choice([".", ".", "!", "?", ""])) if n else ""


# Names that pages give their parts; training pages draw from them, and the model learns what they stand for.
_MENUS = "menu nav navbar navigation breadcrumb breadcrumbs pager pagination toolbar topbar skip links sitemap"
_ADVERTS = "ad ads adv advert advertisement advertising banner promo promotion sponsor sponsored outbrain taboola"
_NOTICES = "notice notices notification alert warning cookie cookies consent gdpr popup modal paywall privacy overlay disclaimer"
_FORMS = "form search newsletter login signup subscribe subscription contact feedback"
_COMMENTS = "comment comments discussion disqus reply replies respond responses thread reviews"
_SIDES = "sidebar side aside widget related recommended popular trending social share sharing tags tag meta complementary"
_HEADS = "header head masthead site topbar banner branding logo"
_FEET = "footer foot bottombar copyright contentinfo legal colophon"
_STORIES = "article articlebody body content entry main post story text page copy prose column narrative"
_FRAMES = "container wrapper wrap row col grid inner outer section box block layout panel item module region"


def training_page(rng: random.Random) -> tuple[str, set[str]]:
    """A made-up page and the set of marks of its main blocks; a block's text opens with its mark."""
    main: set[str] = set()
    count = iter(range(1, 10_000))

    def said(n: int, good: bool) -> str:
        mark = f"q{next(count)}q"
        if good:
            main.add(mark)
        return f"{mark} {_words(rng, n)}"

    def links(n: int) -> str:
        item = lambda: f'<a href="/{rng.randint(1, 99)}">{said(rng.randint(1, 3), False)}</a>'
        return rng.choice(["<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>", "<div>" + " | ".join(item() for _ in range(n)) + "</div>", "".join(f"<p>{item()}</p>" for _ in range(n))])

    def named(tag: str, names: str, inner: str, main: bool = False) -> str:
        form = rng.random()
        name = rng.choice(names.split())
        if not main and rng.random() < 0.05:
            name = rng.choice(_FRAMES.split())  # a name that says nothing
        also = rng.choice(_FRAMES.split())
        attr = f' class="{name}"' if form < 0.4 else f' id="{name}-{rng.randint(1, 9)}"' if form < 0.6 else f' class="{also} {name}"' if form < 0.75 else f' class="{name}-{also}"' if form < 0.9 else f' class="{also}{name.capitalize()}"'
        return f"<{tag}{attr}>{inner}</{tag}>"

    def block(tag: str, n: int, good: bool) -> str:
        return f"<{tag}>{said(n, good)}</{tag}>"

    def junk() -> str:
        kind = rng.randint(0, 9)
        short = lambda: rng.randint(1, 14)
        if kind == 0:
            inner = links(rng.randint(2, 9))
            return rng.choice([f"<nav>{inner}</nav>", f'<div role="navigation">{inner}</div>', named("div", _MENUS, inner), named("ul", _MENUS, inner)])
        if kind == 1:
            return named(rng.choice(["div", "div", "section", "p"]), _ADVERTS, said(rng.randint(2, 30), False))
        if kind == 2:
            inner = block("h3", 2, False) + rng.choice([links(4), block("p", rng.randint(5, 50), False), block("p", rng.randint(5, 50), False)])
            return rng.choice([f"<aside>{inner}</aside>", named("div", _SIDES, inner), named("aside", _SIDES, inner)])
        if kind == 3:
            return named(rng.choice(["div", "div", "section"]), _NOTICES, rng.choice([block("p", rng.randint(4, 40), False), said(rng.randint(4, 40), False)]))
        if kind == 4:
            inner = f"<label>{said(short(), False)}</label><input type='text'><p>{said(short(), False)}</p>"
            return rng.choice([f"<form>{inner}</form>", named("form", _FORMS, inner), named("div", _FORMS, f"<form>{inner}</form>"), named("div", _FORMS, block("p", rng.randint(4, 30), False))])
        if kind in (5, 6):
            each = "".join(rng.choice(["<div class='comment'>%s</div>", "<li>%s</li>", "<article class='comment'>%s</article>"]) % (block("h4", 2, False) + "".join(block("p", rng.randint(3, 60), False) for _ in range(rng.randint(1, 3)))) for _ in range(rng.randint(1, 5)))
            return named(rng.choice(["section", "div", "ol"]), _COMMENTS, rng.choice(["", block("h2", 2, False)]) + each)
        if kind == 7:
            return named("div", _SIDES, rng.choice(["", block("h3", 2, False)]) + links(rng.randint(2, 6)))
        if kind == 8:
            return named("div", _MENUS, links(3))
        return rng.choice(["<aside>%s</aside>", "<aside class='notice'>%s</aside>"]) % said(rng.randint(4, 40), False)

    def story() -> str:
        parts = []
        if rng.random() < 0.85:
            parts.append(block(rng.choice(["h1", "h1", "h2"]), rng.randint(2, 12), True))
        for _ in range(rng.choice([1, 2, 4, 7, 12, 20])):
            kind = rng.random()
            n = rng.choice([2, 5, 10, 25, 40, 80, 150])
            if kind < 0.66:
                inner = said(n, True)
                if rng.random() < 0.15:
                    inner = f"<b>{inner}</b><br>"
                parts.append(f"<p>{inner}" + rng.choice(["</p>", "</p>", "</p>", "", f' <a href="/x">{_words(rng, 2)}</a></p>']))
            elif kind < 0.74:
                parts.append(block(rng.choice(["h2", "h3"]), rng.randint(1, 8), True))
            elif kind < 0.82:
                tag = rng.choice(["ul", "ol"])
                parts.append(f"<{tag}>" + "".join(block("li", rng.randint(2, 15), True) for _ in range(rng.randint(2, 5))) + f"</{tag}>")
            elif kind < 0.87:
                parts.append(block(rng.choice(["blockquote", "pre"]), n, True))
            elif kind < 0.91:
                rows = "".join("<tr>" + "".join(block("td", rng.randint(1, 6), True) for _ in range(3)) + "</tr>" for _ in range(rng.randint(2, 4)))
                parts.append(f"<table>{rows}</table>")
            elif kind < 0.95:
                parts.append(f"<div>{said(n, True)}</div>")
            else:
                parts.append(junk())
        return "".join(parts)

    head = f"<!DOCTYPE html><html><head><title>{_words(rng, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
    inner = rng.choice([links(5), block("h1", 2, False) + links(4), block("p", rng.randint(1, 8), False) + links(3), ""])
    top = rng.choice([f"<header>{inner}</header>", named("div", _HEADS, inner), f"<nav>{inner}</nav>" if inner.startswith(("<ul", "<div><a", "<p><a")) else named("div", _HEADS, inner)])
    if rng.random() < 0.1:  # lines parted by breaks, without paragraphs
        content = block("h1", 4, True) + "<br><br>".join(said(rng.choice([10, 40, 80]), True) for _ in range(rng.randint(2, 6)))
    else:
        content = story()
    content = rng.choice([f"<article>{content}</article>"] * 4 + [f"<main>{content}</main>", f"<main><article>{content}</article></main>", named("div", _STORIES, content, True), f'<div id="main">{named("div", _STORIES, content, True)}</div>', named("section", _STORIES, content, True), named("article", _STORIES, content, True), f"<div>{content}</div>", f"<section>{content}</section>"])
    around = [junk() for _ in range(rng.randint(0, 3))]
    after = [junk() for _ in range(rng.randint(0, 3))]
    inner = rng.choice([f"&copy; {said(rng.randint(2, 25), False)}", block("p", rng.randint(2, 20), False), links(4) + block("p", 4, False), "<br>".join(said(rng.randint(2, 8), False) for _ in range(3))])
    foot = rng.choice([f"<footer>{inner}</footer>"] * 2 + [named("div", _FEET, inner)])
    before, behind = "".join(around), "".join(after)
    family = rng.random()
    if family < 0.1:  # a layout table
        page = f"{top}<table><tr><td>{before}</td><td>{content}</td><td>{behind}</td></tr></table>{foot}"
    elif family < 0.25:  # columns in frames
        frame = lambda x: f'<div class="{rng.choice(_FRAMES.split())}">{x}</div>'
        page = frame(top + frame(before) + frame(content) + behind) + foot
    elif family < 0.35:
        page = f'{top}<div class="{rng.choice(_FRAMES.split())}">{before}{content}{behind}{foot}</div>'
    else:
        page = top + before + content + behind + foot
    return head + page + "</body></html>", main


@dataclass
class Model:
    """The trees, and what each token bucket says."""

    trees: Boosted
    odds: np.ndarray

    def logits(self, pages: list[list[Node]]) -> np.ndarray:
        return self.trees.logit(np.concatenate([node_features(p, self.odds) for p in pages]))


@functools.cache
def trained(pages: int = 900, seed: int = 11) -> Model:
    """The model, fitted on so many made-up pages; the same for the same arguments.

    The trees see each half of the pages with token odds from the other half, so that they learn how far to trust them.
    """
    rng = random.Random(seed)
    trees, shares, weights = [], [], []
    for _ in range(pages):
        page, main = training_page(rng)
        nodes = parse(page)
        good, bad = [0] * len(nodes), [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            for _, text in nodes[i].blocks:
                mark = re.match(r"q\d+q", text)
                if mark is None:
                    continue
                if mark[0] in main:
                    good[i] += len(text)
                else:
                    bad[i] += len(text)
            if nodes[i].parent >= 0:
                good[nodes[i].parent] += good[i]
                bad[nodes[i].parent] += bad[i]
        share = np.array([g / (g + b) if g + b else 0.5 for g, b in zip(good, bad)])
        seen = np.array([g + b > 0 for g, b in zip(good, bad)])
        trees.append(nodes)
        shares.append(share)
        weights.append(seen * np.maximum(np.abs(share - 0.5) * 2, 0.05))
    halves = [token_odds(trees[i::2], shares[i::2], weights[i::2]) for i in (0, 1)]
    rows = [node_features(t, halves[1 - i % 2]) for i, t in enumerate(trees)]
    held = [w > 0 for w in weights]
    x, w = (np.concatenate([r[k] for r, k in zip(of, held)]) for of in (rows, weights))
    y = np.concatenate([(s[k] > 0.5).astype(float) for s, k in zip(shares, held)])
    return Model(Boosted().fit(x, y, w), token_odds(trees, shares, weights))


def chosen_text(nodes: list[Node], kept: list[bool]) -> str:
    blocks = [b for node, k in zip(nodes, kept) if k for b in node.blocks]
    blocks.sort()
    return " ".join(text for _, text in blocks)


def extract(pages: list[str | None], model: Model) -> list[str]:
    """Main texts of whole pages; empty where there is none."""
    trees = [parse(p) for p in pages]
    if not trees:
        return []
    logits = model.logits(trees)
    out, at = [], 0
    for nodes in trees:
        out.append(chosen_text(nodes, decode(nodes, logits[at : at + len(nodes)])))
        at += len(nodes)
    return out


def main_text(pages: DataFrame, html: str = "html", out: str = "text", model: Model | None = None) -> DataFrame:
    """pages with the main text of each in column ``out``.

    Null and empty pages, and pages without main text, give an empty text. Rows are judged alone, so
    repeated rows agree; whole pages are read, however long; other columns pass through. An empty table
    stays empty.
    """
    model = model or trained()

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            values = [v if isinstance(v, str) else None for v in batch]
            found: list[str] = []
            for at in range(0, len(values), 256):
                found += extract(values[at : at + 256], model)
            yield pd.Series(found, dtype="object")

    return pages.withColumn(out, texts(F.col(html)))
