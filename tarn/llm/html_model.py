"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is a binary variable (content or not). Parent-child potentials connect the elements; sum-product
messages run from the leaves to the root and back and yield each element's marginal. The potentials are fitted to
labelled pages by exact gradient ascent on the conditional likelihood.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import bounded_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg".split())
INLINE = frozenset("a abbr b bdi bdo cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
TEXT_TAGS = frozenset("p li td th tr tbody thead h1 h2 h3 h4 blockquote pre dd dt figcaption".split())
#: An opening tag of the value closes an open element of the key.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}
#: What an implied end does not reach through.
SCOPE = frozenset("html body table td th ul ol dl div section article main aside nav header footer form button select".split())
#: Names of class or id by which a page marks its main container; a page without one has features of its own.
MAIN_NAMES = frozenset("article content entry main post story".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|<[!?][^>]*(?:>|\Z)|[^<]+|<", re.S)
#: Where a quote is never closed, tags end at the next ``>`` from there on.
_UNQUOTED = re.compile(r"<!--.*?(?:-->|\Z)|</?[a-zA-Z][^>]*>|<[!?][^>]*(?:>|\Z)|[^<]+|<", re.S)
_OPENS = re.compile(r"</?[a-zA-Z]")
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_NAME = re.compile(r"[a-z]+")


@dataclass
class Page:
    """Elements in page order (parents first) and the page's texts: (element, text), or None between blocks."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    labels: list[int | None] = field(default_factory=list)
    texts: list[tuple[int, str] | None] = field(default_factory=list)

    def kinds(self) -> list[str]:
        return [edge_kind(self.tags[p] if p >= 0 else "", t) for p, t in zip(self.parents, self.tags, strict=True)]


#: Beside an element's names: an attribute hides it.
UNSEEN = "#unseen"


def _attributes(tag: str, labelled: bool) -> tuple[tuple[str, ...], int | None]:
    names: list[str] = []
    label = None
    for key, *values in _ATTR.findall(tag.partition(" ")[2] if " " in tag else ""):
        value = "".join(values).lower()
        if key in ("class", "id", "role"):
            names += _NAME.findall(value)
        elif key == "hidden" or key == "style" and "display:none" in value.replace(" ", ""):
            names += ["hidden", UNSEEN]
        elif labelled and key == "data-label":
            label = int(value)
    return tuple(dict.fromkeys(names)), label


def _tokens(html: str) -> Iterator[re.Match]:
    """Tags, comments and texts. After a tag that the end of the page cuts there is nothing; the caller may send a place to go on from."""
    pattern, at, last = _TOKEN, 0, html.rfind(">")
    while at < len(html):
        m = pattern.match(html, at)
        if m.end() == at + 1 and html[at] == "<" and _OPENS.match(html, at):
            if at > last:
                return
            if pattern is _TOKEN:
                pattern = _UNQUOTED
                continue
        at = (yield m) or m.end()


class _Open:
    """The open elements, with counts by tag, so that an end tag without a start costs nothing, and those an opening tag may close."""

    def __init__(self, page: Page, root: int):
        self.page, self.stack = page, [root]
        self.count: Counter[str] = Counter()
        self.closable: list[list[int]] = [[]]  # by scope: places in the stack of elements whose end may be implied

    def push(self, node: int) -> None:
        tag = self.page.tags[node]
        self.stack.append(node)
        self.count[tag] += 1
        if tag in SCOPE:
            self.closable.append([])
        if tag in CLOSED_BY:
            self.closable[-1].append(len(self.stack) - 1)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            tag = self.page.tags[self.stack.pop()]
            self.count[tag] -= 1
            if tag in CLOSED_BY:
                self.closable[-1].pop()
            if tag in SCOPE:
                self.closable.pop()

    def end(self, tag: str) -> None:
        if self.count[tag]:
            at = len(self.stack) - 1
            while self.page.tags[self.stack[at]] != tag:
                at -= 1
            self.cut(at)

    def implied_ends(self, tag: str) -> None:
        for at in reversed(self.closable[-1]):
            if tag in CLOSED_BY[self.page.tags[self.stack[at]]]:
                self.cut(at)
                return


def parse(html: str, labelled: bool = False) -> Page:
    """A tolerant tree in time linear in the page: unclosed, misnested and cut tags never fail.

    A tag that the end of the page cuts is dropped. A self-closed raw element ends at once unless its end tag is the
    next tag; one without an end tag holds nothing, but for script and style, which run to the end of the page.
    Attributes are read for names only; ``data-label`` counts in own training pages (``labelled``) alone.
    """
    page = Page()

    def add(tag: str, names: tuple[str, ...] = (), label: int | None = None) -> int:
        page.tags.append(tag)
        page.parents.append(opened.stack[-1] if len(page.tags) > 1 else -1)
        page.names.append(names)
        page.labels.append(label)
        return len(page.tags) - 1

    opened = _Open(page, 0)
    add("#root")
    ends: dict[str, int] = {}  # the next end of a raw element, as far as known
    tokens = _tokens(html)
    go_on = None
    while True:
        try:
            m = tokens.send(go_on)
        except StopIteration:
            return page
        go_on, token = None, m.group()
        if token[0] != "<" or token == "<":
            page.texts.append((opened.stack[-1], token))
            continue
        if token[1] in "!?":
            continue
        tag = _TAG.match(token).group(1).lower()
        if tag not in INLINE:
            page.texts.append(None)
        if token[1] == "/":
            opened.end(tag)
            continue
        if tag not in INLINE:
            opened.implied_ends(tag)
        names, label = _attributes(token, labelled) if len(token) > len(tag) + 2 else ((), None)
        node = add(tag, names, label)
        if tag in VOID:
            continue
        if tag not in RAW:
            if not token.endswith("/>"):
                opened.push(node)
            continue
        if ends.get(tag, -1) < m.end():
            end = re.compile(rf"</{tag}(?![\w-])", re.I).search(html, m.end())
            ends[tag] = end.start() if end else len(html)
        at = ends[tag]
        if token.endswith("/>") and html.find("<", m.end()) != at or at == len(html) and tag not in ("script", "style"):
            continue
        opened.push(node)
        if at > m.end():
            page.texts.append((node, html[m.end() : at]))
            go_on = at


def _bucket(n: float, bounds: tuple[float, ...]) -> int:
    return bisect_right(bounds, n)


def node_features(page: Page) -> list[tuple[str, ...]]:
    """Tag, names of class, id and role, own text length, length of all text below, and the share of it in links."""
    n = len(page.tags)
    own, below, linked = [0] * n, [0] * n, [0] * n
    for item in page.texts:
        if item is not None:
            own[item[0]] += len(item[1].strip())
    for i in range(n - 1, -1, -1):
        below[i] += own[i]
        if page.tags[i] == "a":
            linked[i] = below[i]
        if page.parents[i] >= 0:
            below[page.parents[i]] += below[i]
            linked[page.parents[i]] += linked[i]
    bare = not any(t in ("article", "main") for t in page.tags) and not any(MAIN_NAMES & set(x) for x in page.names if x)
    return [
        _features(page.tags[i], _bucket(own[i], (1, 25, 80, 250)), _bucket(below[i], (1, 80, 400, 1500)), _bucket(linked[i] / below[i] if below[i] else 0.0, (0.01, 0.3, 0.7)), page.names[i], bare)
        for i in range(n)
    ]


@lru_cache(50_000)
def _features(tag: str, own: int, below: int, linked: int, names: tuple[str, ...], bare: bool) -> tuple[str, ...]:
    f = [f"t:{tag}", f"o{own}", f"b{below}", f"l{linked}"] + [f"n:{x}" for x in names]
    return tuple(f + [f"x:{tag}", f"xo{own}", f"xl{linked}"] if bare else f)


def edge_kind(parent: str, tag: str) -> str:
    """Which table of parent-child potentials an element has with its parent. What hangs below the page itself is hardly bound to it."""
    if parent in ("#root", "html", "body"):
        return "top"
    return "inline" if tag in INLINE else "text" if tag in TEXT_TAGS else "block"


@dataclass
class TreeModel:
    """weights: log-odds of content for each feature; tables: log-potentials [parent][child] of each edge kind."""

    weights: dict[str, float]
    tables: dict[str, list[list[float]]]

    def unary(self, features: tuple[str, ...]) -> float:
        w = self.weights
        return sum(w.get(f, 0.0) for f in features)

    def messages(self, page: Page, unaries: list[float]) -> tuple[list[float], list[float], list[float]]:
        """Sum-product: log-odds (below, cavity of the parent, marginal) of each element."""
        n = len(page.tags)
        below = unaries[:]
        up = [0.0] * n
        tables = [self.tables[k] for k in page.kinds()]
        for i in range(n - 1, 0, -1):
            (w00, w01), (w10, w11) = tables[i]
            up[i] = _ratio(w10, w11, w00, w01, below[i])
            below[page.parents[i]] += up[i]
        total, cavity = below[:], [0.0] * n
        for i in range(1, n):
            (w00, w01), (w10, w11) = tables[i]
            cavity[i] = total[page.parents[i]] - up[i]
            total[i] += _ratio(w01, w11, w00, w10, cavity[i])
        return below, cavity, total

    def marginals(self, page: Page) -> list[float]:
        known: dict[tuple[str, ...], float] = {}
        unaries = []
        for f in node_features(page):
            if (u := known.get(f)) is None:
                u = known[f] = self.unary(f)
            unaries.append(u)
        return [_sigmoid(x) for x in self.messages(page, unaries)[2]]


def _ratio(a: float, b: float, c: float, d: float, x: float) -> float:
    """log((e^a + e^(b+x)) / (e^c + e^(d+x)))."""
    return _add(a, b + x) - _add(c, d + x)


def _add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


KINDS = ("block", "inline", "text", "top")


def fit(pages: list[Page], rounds: int = 150, rate: float = 0.5, l2: float = 0.0002) -> TreeModel:
    """Exact gradient ascent (adaptive steps) on the labels of all elements; an element without a label has its parent's.

    The messages of all pages run together, one depth of the trees at a time.
    """
    parent, kind, label, depth, names, at_name, at_element = [], [], [], [], {}, [], []
    for page in pages:
        start = len(parent)
        for i, (p, k, f, y) in enumerate(zip(page.parents, page.kinds(), node_features(page), page.labels, strict=True)):
            parent.append(start + p if p >= 0 else -1)
            kind.append(KINDS.index(k))
            depth.append(depth[start + p] + 1 if p >= 0 else 0)
            label.append(y if y is not None else label[start + p] if p >= 0 else 0)
            at_name += [names.setdefault(x, len(names)) for x in f]
            at_element += [start + i] * len(f)
    parent, kind, label, depth, at_name, at_element = map(np.array, (parent, kind, label, depth, at_name, at_element))
    n, inner = len(parent), np.flatnonzero(parent >= 0)
    levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
    seen = np.zeros((len(KINDS), 2, 2))
    np.add.at(seen, (kind[inner], label[parent[inner]], label[inner]), 1)
    weights, tables = np.zeros(len(names)), np.tile(np.array([[0.5, 0.0], [0.0, 0.5]]), (len(KINDS), 1, 1))
    square_w, square_t = np.zeros_like(weights), np.zeros_like(tables)
    for _ in range(rounds):
        below = np.bincount(at_element, weights=weights[at_name], minlength=n)
        up, cavity, t = np.zeros(n), np.zeros(n), tables[kind]
        for i in reversed(levels):
            up[i] = np.logaddexp(t[i, 1, 0], t[i, 1, 1] + below[i]) - np.logaddexp(t[i, 0, 0], t[i, 0, 1] + below[i])
            below += np.bincount(parent[i], weights=up[i], minlength=n)
        total = below.copy()
        for i in levels:
            cavity[i] = total[parent[i]] - up[i]
            total[i] += np.logaddexp(t[i, 0, 1], t[i, 1, 1] + cavity[i]) - np.logaddexp(t[i, 0, 0], t[i, 1, 0] + cavity[i])
        both = t[inner] + cavity[inner, None, None] * np.array([[0], [1]]) + below[inner, None, None] * np.array([0, 1])
        both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
        both /= both.sum(axis=(1, 2), keepdims=True)
        g_t = seen - l2 * len(pages) * tables
        np.add.at(g_t, kind[inner], -both)
        g_w = np.bincount(at_name, weights=(label - 1 / (1 + np.exp(-np.clip(total, -500, 500))))[at_element], minlength=len(names)) - l2 * len(pages) * weights
        square_w += g_w**2
        square_t += g_t**2
        weights += rate * g_w / np.sqrt(square_w + 1e-9)
        tables += rate * g_t / np.sqrt(square_t + 1e-9)
    return TreeModel(dict(zip(names, weights.tolist(), strict=True)), dict(zip(KINDS, tables.tolist(), strict=True)))


def labelled_pages(count: int = 320, seed: int = 11) -> list[str]:
    """Own labelled pages of many layouts; ``data-label`` marks content (1) and the rest (0). In a third of them no class, id or tag tells what a box is."""
    r = random.Random(seed)
    syllables = "ba be do fi ga hu jo ka le mi no pu ra so ti vu wa xe yo zu".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize() + r.choice(["", ".", "."])
    links = lambda n: "".join(f'<li><a href="/{word()}">{say(1, 2)}</a></li>' for _ in range(n))

    def paragraph() -> str:
        text = say(1, r.choice([3, 90, 90]))
        kind = r.random()
        if kind < 0.15:
            text = f"<b>{say(2, 8)}</b> {text}"
        elif kind < 0.3:
            text += f' <a href="/{word()}">{say(1, 4)}</a> {say(2, 20)}'
        elif kind < 0.4:
            text += f"<br>{say(2, 20)} <em>{word()}</em>"
        return f"<p>{text}</p>"

    def article() -> str:
        parts = [f"<h1>{say(2, 9)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 12])):
            k = r.random()
            parts.append(
                paragraph() if k < 0.75
                else f"<h2>{say(1, 6)}</h2>" if k < 0.82
                else f"<ul>{''.join(f'<li>{say(2, 14)}</li>' for _ in range(r.randint(1, 5)))}</ul>" if k < 0.88
                else f"<blockquote><p>{say(4, 30)}</p></blockquote>" if k < 0.92
                else f"<table><tr><th>{word()}</th><th>{word()}</th></tr><tr><td>{say(1, 4)}</td><td>{say(1, 4)}</td></tr></table>" if k < 0.95
                else f'<div data-label="0" class="{r.choice(["ad", "ads", "advert", "promo", "sponsored", "share", "social"])}">{say(2, 20)}</div>'
            )
        if r.random() < 0.25 and len(parts) > 1:
            parts.insert(1, f'<aside data-label="0" class="{r.choice(["related", "sidebar", "box"])}"><h3>{say(1, 3)}</h3><ul>{links(3)}</ul></aside>')
        while r.random() < 0.35:
            parts.append(extra())
        if r.random() < 0.5:
            parts.insert(0, f"<p><b>{say(3, 25)}<br>")
        return parts or [paragraph()]

    def body_of(text: list[str]) -> str:
        k = r.randrange(9)
        if k >= 7:  # no container of its own: paragraphs straight in the body or in a plain box
            text = "".join(b if "data-label" in b[:40] else re.sub(r"^<(\w+)", r'<\1 data-label="1"', b) for b in text)
            return text if k == 7 else f'<div data-label="1">{text}</div>'
        text = "".join(text)
        if k < 3:
            return f'<article data-label="1">{text}</article>'
        if k == 3:
            return f'<main data-label="1">{text}</main>'
        if k == 4:
            return f'<main data-label="1"><article data-label="1">{text}</article></main>'
        name = r.choice(["content", "article", "post", "entry", "story", "main", "post-content", "article-body", "entry-content"])
        inner = f'<div data-label="1" {r.choice(["class", "id"])}="{name}">{text}</div>'
        return inner if k == 5 else f'<div data-label="1" class="page"><section data-label="1">{inner}</section></div>'

    def comments() -> str:
        one = lambda: f'<div class="comment"><b>{word()}</b><p>{say(3, 40)}</p></div>'
        name = r.choice(["comments", "reader-comments", "comment-list", "replies", "discussion", "responses"])
        tag = r.choice(["div", "section", "ol"])
        return f'<{tag} data-label="0" {r.choice(["id", "class"])}="{name}"><h3>{say(1, 3)}</h3>{"".join(one() for _ in range(r.randint(1, 5)))}</{tag}>'

    def extra() -> str:
        k = r.randrange(9)
        box = lambda names, text: f'<div data-label="0" {r.choice(["class", "id"])}="{r.choice(names.split())}">{text}</div>'
        return [
            lambda: box("ad ads advert banner promo sponsored adsense advertisement", say(2, 25)),
            lambda: box("notice cookie cookies consent cookie-banner alert gdpr privacy disclaimer popup modal", f"<p>{say(4, 30)}</p><button>{word()}</button>"),
            lambda: box("sidebar widget related recommended menu breadcrumb breadcrumbs tags share social newsletter", f"<h4>{say(1, 3)}</h4><ul>{links(r.randint(1, 6))}</ul>"),
            lambda: f'<aside data-label="0"><h3>{say(1, 3)}</h3><p>{say(3, 40)}</p></aside>',
            lambda: f'<form data-label="0" action="/s"><label>{say(1, 3)}</label><input name="q"><select><option>{word()}</option></select><button>{word()}</button><p>{say(2, 15)}</p></form>',
            comments,
            lambda: f'<script data-label="0">var a="{word()}";</script>',
            lambda: f'<nav data-label="0" class="pagination">{say(1, 2)} <a href="/2">{word()}</a></nav>',
            lambda: f'<section data-label="0" class="{r.choice(["newsletter", "subscribe", "related", "promo"])}"><p>{say(3, 25)}</p></section>',
        ][k]()

    def plain_page() -> str:
        box = lambda y, text: f'<{(tag := r.choice(["div", "div", "section"]))} data-label="{y}" {r.choice(["class", "id"])}="{word()}{r.choice(["", "-" + word()])}">{text}</{tag}>'
        rest = lambda: box(0, r.choice([
            lambda: f"<ul>{links(r.randint(2, 9))}</ul>",
            lambda: " ".join(f'<a href="/{word()}">{word()}</a>' for _ in range(r.randint(2, 8))),
            lambda: f"<h4>{say(1, 3)}</h4><ul>{links(r.randint(1, 6))}</ul>",
            lambda: f"&copy; {word()} {say(0, 6)}" if r.random() < 0.5 else f'<a href="/">{word()}</a>',
            lambda: f'<p>&copy; {word()} {say(1, 4)} <a href="/">{word()}</a></p>',
        ])())
        parts = [f"<h1>{say(2, 9)}</h1>"] if r.random() < 0.8 else []
        parts += [f"<p>{say(6, 60)}</p>" if r.random() < 0.85 else f"<h2>{say(1, 6)}</h2><p>{say(8, 60)}</p>" for _ in range(r.randint(1, 8))]
        body = "".join(rest() for _ in range(r.randint(1, 3))) + box(1, "".join(parts)) + "".join(rest() for _ in range(r.randint(1, 3)))
        if r.random() < 0.6:
            body = box(0, body)
        return f'<html data-label="0"><head data-label="0"><title>{say(2, 8)}</title></head><body data-label="0">{body}</body></html>'

    out = []
    for n in range(count):
        if n % 3 == 2:
            out.append(plain_page())
            continue
        before = [f'<nav data-label="0"><ul>{links(r.randint(1, 8))}</ul></nav>' if r.random() < 0.8 else "", f'<header data-label="0"><h1>{say(1, 3)}</h1><p>{say(2, 12)}</p></header>' if r.random() < 0.4 else ""]
        if r.random() < 0.2:
            before.append(f'<div data-label="0" class="{r.choice(["header", "topbar", "navbar", "menu"])}"><ul>{links(3)}</ul></div>')
        before += [extra() for _ in range(r.choice([0, 1, 1, 2]))]
        main = body_of(article())
        after = [extra() for _ in range(r.choice([0, 0, 1, 2]))]
        after.append(f'<footer data-label="0">&copy; {word()} &middot; {say(2, 20)}</footer>' if r.random() < 0.7 else f'<div data-label="0" class="footer"><p>{say(2, 20)}</p></div>')
        page = f'<!DOCTYPE html><html data-label="0"><head data-label="0"><title>{say(2, 8)}</title><style>p{{}}</style><script>x()</script></head><body data-label="0">{"".join(before)}{main}{"".join(after)}</body></html>'
        out.append(page)
    return out


_MODEL: list[TreeModel] = []


def trained_model() -> TreeModel:
    """Fitted once a process to ``labelled_pages``."""
    if not _MODEL:
        _MODEL.append(fit([parse(p, labelled=True) for p in labelled_pages()]))
    return _MODEL[0]


def main_text(html: str, model: TreeModel, threshold: float = 0.5) -> str:
    """The text of the content elements. What an attribute hides is none, with all that it holds; a page without any element is its text."""
    page = parse(html)
    keep = [m >= threshold for m in model.marginals(page)] if len(page.tags) > 1 else [True]
    unseen = [UNSEEN in names for names in page.names]
    for i, parent in enumerate(page.parents):  # parents come before what they hold
        unseen[i] |= parent >= 0 and unseen[parent]
        keep[i] &= not unseen[i]
    parts = [" " if item is None else html_lib.unescape(item[1]) for item in page.texts if item is None or (keep[item[0]] and page.tags[item[0]] not in RAW)]
    return " ".join("".join(parts).split())


def extract_text(pages: DataFrame, model: TreeModel | None = None, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row of ``pages``; other columns, whatever their names, are not looked at.

    Null html counts as empty and gives the empty text; so does a page without content. Null keys and urls stay null,
    repeated rows stay, an empty table gives no rows. Pages of any length are taken whole, in time linear in them.
    """
    model = model or trained_model()
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, model) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["k", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)[key]
    return pages.select(F.col(key).alias("k"), "url", F.coalesce(html, F.lit("")).alias("h")).mapInArrow(run, f"k {kind}, url string, text string, n_chars long").withColumnRenamed("k", key)
