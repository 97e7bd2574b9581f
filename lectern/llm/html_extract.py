"""Main text of web pages by gradient-boosted trees over DOM nodes.

A tolerant parser gives each page's elements in document order, so a subtree is
a range and every subtree sum is a difference of running sums.  A node's
features are its subtree's text, link and tag densities, attribute tokens of
itself and its ancestors, depth and sibling statistics.  Boosted trees of
logistic loss (trained here on generated pages whose labels are known) give the
probability that its own text is content.  Hierarchical decoding then picks the
most likely labelling in which a node is content with all below it, boilerplate
with all below it, or mixed (at a price), so that no ancestor contradicts a
descendant.

Defined cases: null or empty html gives an empty text; text outside any element
belongs to the root; unclosed and stray tags are tolerated, and a page takes
time in proportion to its length whatever its tags; scripts, styles, templates
and comments are no text; repeated rows get equal rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import ensure_columns

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_QUOTE = re.compile("[>\"']")
OPAQUE = frozenset("script style noscript template svg iframe textarea".split())
_ATTR = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*[\"']?([^\"'>]+)", re.I)
_PART = re.compile(r"[a-zA-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_CLOSERS = BLOCK - {"li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "head", "title"}
GROUPS = {t: i + 1 for i, ts in enumerate(["p", "div section", "article main", "h1 h2 h3 h4 h5 h6", "a", "ul ol dl", "li dd dt", "nav menu", "header", "footer", "aside", "table tbody tr td th thead tfoot", "blockquote pre code figure figcaption", "b i em strong span u small font sup sub", "form input button select label textarea option", "head title meta link", "html body"]) for t in ts.split()}
GOOD = frozenset("article articles content main body post entry text story blog page hentry column prose document".split())
POOR = frozenset("nav navigation navbar menu ad ads advert advertisement sponsor sponsored banner footer header masthead sidebar side comment comments share social promo related cookie cookies popup modal breadcrumb breadcrumbs widget tags pagination pager login signup newsletter subscribe copyright legal meta toolbar rail".split())
FEATURES = 30


@dataclass
class Page:
    parent: list[int]
    end: list[int]
    tag: list[str]
    good: list[int]
    poor: list[int]
    pieces: list[tuple[int, str]]  # owner node and its text, in document order


class _Scanner:
    """Tags of a page, each character read a bounded number of times, whatever is left open.

    A tag ends at the first ``>`` outside quotes.  A quote that is never closed is
    no quote; once a tag would swallow the rest of the page, quotes no longer
    count; a tag without any ``>`` after it is text.
    """

    def __init__(self, source: str):
        self.source, self.quotes = source, True
        self.last = {c: source.rfind(c) for c in ">\"'"}
        self.low: str | None = None

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose name ends at ``at``; -1 without one."""
        if at > self.last[">"]:
            return -1
        first, i = self.source.find(">", at), at
        while self.quotes:
            m = _QUOTE.search(self.source, i)
            if m is None:
                self.quotes = False
                break
            c, i = m.group(), m.end()
            if c == ">":
                return i - 1
            if i <= self.last[c]:
                i = self.source.index(c, i) + 1
        return first

    def after(self, name: str, at: int) -> int:
        """Where the element ends whose content is no text: past its end tag, or the end of the page."""
        if self.low is None:
            self.low = self.source.lower() if len(self.source.lower()) == len(self.source) else self.source
        found = self.low.find("</" + name, at)
        close = self.source.find(">", found) if found >= 0 else -1
        return close + 1 if close >= 0 else len(self.source)

    def tokens(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """Start, end, lower-case name ('' for what is no element), whether it ends one, and attributes."""
        source, i = self.source, 0
        while (i := source.find("<", i)) >= 0:
            start, mark = i, source[i + 1 : i + 2]
            if source.startswith("<!--", i):
                stop = source.find("-->", i + 4)
                i = stop + 3 if stop >= 0 else len(source)
                yield start, i, "", False, ""
                continue
            m = _NAME.match(source, i + 1)
            if mark not in "!?" and m is None or not mark:
                i += 1
                continue
            stop = source.find(">", i) if m is None and i <= self.last[">"] else self.end(m.end()) if m else -1
            if stop < 0:
                if i > self.last[">"]:
                    return
                i += 1
                continue
            i = stop + 1
            if m is None:
                yield start, i, "", False, ""
                continue
            name, ends = m.group(1).lower(), mark == "/"
            if name in OPAQUE and not ends:
                i = self.after(name, i)
                yield start, i, "", False, ""
            else:
                yield start, i, name, ends, source[m.end() : stop]


def parse(source: str) -> Page:
    parent, end, tag, good, poor, pieces = [-1], [0], ["#root"], [0], [0], []
    stack = [0]
    opened: dict[str, int] = {}
    at = 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            opened[tag[node]] = opened.get(tag[node], 1) - 1
            end[node] = len(parent)

    for start, stop, name, ends, attributes in _Scanner(source).tokens():
        if start > at:
            text = source[at:start]
            if not text.isspace():
                pieces.append((stack[-1], text))
        at = stop
        if not name:
            continue
        if ends:
            if opened.get(name):  # a stray end tag costs nothing
                d = len(stack) - 1
                while tag[stack[d]] != name:
                    d -= 1
                close(d)
            continue
        if name in P_CLOSERS:
            for d in range(len(stack) - 1, max(0, len(stack) - 6), -1):
                if tag[stack[d]] == "p":
                    close(d)
                    break
                if tag[stack[d]] in BLOCK:
                    break
        elif name in CLOSES:
            for d in range(len(stack) - 1, max(0, len(stack) - 8), -1):
                if tag[stack[d]] in CLOSES[name]:
                    close(d)
                    break
                if tag[stack[d]] in ("ul", "ol", "dl", "table", "select"):
                    break
        node = len(parent)
        parent.append(stack[-1])
        end.append(node + 1)
        tag.append(name)
        g = b = 0
        if "=" in attributes:
            for value in _ATTR.findall(attributes):
                for part in _PART.findall(value):
                    part = part.lower()
                    g += part in GOOD
                    b += part in POOR
        good.append(g)
        poor.append(b)
        if name not in VOID and not attributes.endswith("/"):
            stack.append(node)
            opened[name] = opened.get(name, 0) + 1
    if at < len(source) and not source[at:].isspace():
        pieces.append((stack[-1], source[at:]))
    close(0)
    return Page(parent, end, tag, good, poor, pieces)


def features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """One row a node, and the length of each node's own text."""
    n = len(page.parent)
    parent, end = np.array(page.parent), np.array(page.end)
    node = np.arange(n)
    up = np.maximum(parent, 0)
    depth = np.zeros(n, dtype=np.int64)
    own = np.zeros((n, 4))  # characters, words, sentence marks, digits
    for owner, text in page.pieces:
        own[owner] += (len(text), text.count(" ") + 1, text.count(".") + text.count(",") + text.count("!") + text.count("?"), 1)
    good, poor = np.array(page.good), np.array(page.poor)
    good_up, poor_up, link = good.copy(), poor.copy(), np.array([t == "a" for t in page.tag], dtype=np.int64)
    inside = link.copy()
    article, side = (np.array([t in s for t in page.tag], dtype=np.int64) for s in ({"article", "main"}, {"nav", "footer", "aside", "header", "form"}))
    in_article, in_side = article.copy(), side.copy()
    for i in range(1, n):  # parents come first
        p = page.parent[i]
        depth[i] = depth[p] + 1
        good_up[i] += good_up[p]
        poor_up[i] += poor_up[p]
        inside[i] |= inside[p]
        in_article[i] |= in_article[p]
        in_side[i] |= in_side[p]
    run = lambda x: np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
    total = run(own)
    sub = total[end] - total[node]
    linked = run(own[:, 0] * inside)
    sub_link = linked[end] - linked[node]
    size = end - node
    links = run(link.astype(float))
    sub_links = links[end] - links[node]
    group = np.array([GROUPS.get(t, 0) for t in page.tag])
    kids = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n, np.int64)
    order = np.zeros(n, dtype=np.int64)
    seen: dict[int, int] = {}
    for i in range(1, n):
        p = page.parent[i]
        order[i] = seen.get(p, 0)
        seen[p] = order[i] + 1
    same = {}
    for i in range(n):
        k = (page.parent[i], page.tag[i])
        same[k] = same.get(k, 0) + 1
    like = np.array([same[page.parent[i], page.tag[i]] for i in range(n)])
    brothers = np.maximum(kids[up], 1)
    whole = max(sub[0, 0], 1.0)
    sib_text = np.bincount(up, weights=sub[:, 0], minlength=n)[up] / brothers
    x = np.column_stack(
        [
            group, group[up], group[up[up]], np.minimum(depth, 20), np.log1p(own[:, 0]), np.log1p(sub[:, 0]), sub[:, 0] / whole, own[:, 1], own[:, 2] / np.maximum(own[:, 1], 1), sub[:, 2] / np.maximum(sub[:, 1], 1),
            sub_link / np.maximum(sub[:, 0], 1), sub[:, 0] / size, np.log1p(size), sub_links, kids, brothers, order / brothers, like / brothers, np.log1p(sib_text), sub[:, 0] / np.maximum(sib_text, 1),
            good, poor, good_up - good, poor_up - poor, inside, in_article, in_side, total[node, 0] / whole, sub[up, 0] / whole, sub_link[up] / np.maximum(sub[up, 0], 1),
        ]
    )
    return x.astype(np.float32), own[:, 0]


@dataclass
class Trees:
    """Complete binary trees of one depth: splits in level order, then leaf values."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    bias: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        depth = (self.leaf.shape[1]).bit_length() - 1
        rows = np.arange(len(x))
        out = np.full(len(x), self.bias)
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - (leaf.shape[0] - 1)]
        return 1 / (1 + np.exp(-out))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Trees:
    """Second-order boosting on binned features."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    coded = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    m = x.shape[1]
    slot = coded + np.arange(m) * bins
    mean = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    bias = float(np.log(mean / (1 - mean)))
    score = np.full(len(x), bias)
    inner = 2**depth - 1
    all_f, all_c, all_leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), np.maximum(weight * p * (1 - p), 1e-9)
        at = np.zeros(len(x), dtype=np.int64)
        f_of, c_of = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = at - first
            index = (local[:, None] * (m * bins) + slot).ravel()
            gs = np.bincount(index, weights=np.repeat(g, m), minlength=count * m * bins).reshape(count, m, bins)
            hs = np.bincount(index, weights=np.repeat(h, m), minlength=count * m * bins).reshape(count, m, bins)
            gl, hl = np.cumsum(gs, axis=2), np.cumsum(hs, axis=2)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < 1e-3) | (ht - hl < 1e-3)] = -1
            for j, c in enumerate(cuts):
                gain[:, j, len(c) :] = -1
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6:
                    f_of[first + k], c_of[first + k] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(len(x)), f_of[at]] > c_of[at])
        leaf_at = at - inner
        leaf = -rate * np.bincount(leaf_at, weights=g, minlength=2**depth) / (np.bincount(leaf_at, weights=h, minlength=2**depth) + l2)
        score += leaf[leaf_at]
        all_f.append(f_of)
        all_c.append(c_of)
        all_leaf.append(leaf)
    return Trees(np.array(all_f), np.array(all_c), np.array(all_leaf), bias)


def decode(parent: list[int], end: list[int], p: np.ndarray, own: np.ndarray, price: float = 1.0) -> np.ndarray:
    """Whether each node's own text is content, in the best labelling without contradictions.

    best(v) = max(all content, all boilerplate, own choice + sum of best(child) - price).
    """
    n = len(parent)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    weight = np.where(own > 0, np.log1p(own), 0.0)
    yes, no = weight * np.log(p), weight * np.log(1 - p)
    node, stop = np.arange(n), np.array(end)
    sums = [np.concatenate([[0], np.cumsum(v)]) for v in (yes, no)]
    all_yes, all_no = (s[stop] - s[node] for s in sums)
    top = np.maximum(all_yes, all_no)
    mixed = (np.maximum(yes, no) - price).tolist()
    whole, best = top.tolist(), [0.0] * n
    for v in range(n - 1, -1, -1):
        best[v] = whole[v] if whole[v] >= mixed[v] or end[v] == v + 1 else mixed[v]
        if v:
            mixed[parent[v]] += best[v]
    out = np.zeros(n, dtype=bool)
    state = [0] * n  # 0: free, 1: content, 2: boilerplate
    pick = (yes >= no).tolist()
    over = (all_yes >= all_no).tolist()
    for v in range(n):
        s = state[parent[v]] if v else 0
        if not s and (whole[v] >= mixed[v] or end[v] == v + 1):
            s = 1 if over[v] else 2
        state[v] = s
        out[v] = s == 1 if s else pick[v]
    return out


def render(page: Page, content: np.ndarray) -> str:
    lines: list[list[str]] = [[]]
    block, last = {}, None
    for v in range(len(page.parent)):
        block[v] = v if v == 0 or page.tag[v] in BLOCK or page.tag[v] == "br" else block[page.parent[v]]
    for owner, text in page.pieces:
        if content[owner]:
            if block[owner] != last and lines[-1]:
                lines.append([])
            last = block[owner]
            lines[-1].append(entities.unescape(text))
    return "\n".join(x for x in (" ".join("".join(line).split()) for line in lines) if x)


# Training pages


def _words(rng: random.Random, low: int, high: int) -> str:
    out, cap = [], True
    for _ in range(rng.randint(low, high)):
        w = "".join(rng.choice(("an", "be", "ti", "on", "er", "st", "le", "ou", "mi", "ra", "ch", "el", "ung", "cion", "é", "ü", "ment", "que")) for _ in range(rng.randint(1, 4)))
        w = w.capitalize() if cap else w
        cap = rng.random() < 0.08
        out.append(w + ("." if cap else "," if rng.random() < 0.07 else rng.choice(("***", "###", "!!", " |")) if rng.random() < 0.02 else ""))
    return " ".join(out) + "."


def training_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page, and for each of its elements in order (the root first) whether its own text is content."""
    out, label = [], [False]

    def tag(name: str, attrs: str = "", content: bool = False) -> None:
        out.append(f"<{name}{' ' + attrs if attrs else ''}>")
        label.append(content)

    def end(name: str, always: bool = True) -> None:
        if always or rng.random() < 0.8:
            out.append(f"</{name}>")

    def cls(*names: str) -> str:
        return f'class="{rng.choice(names)}"' if rng.random() < 0.75 else ""

    def menu(where: str, attrs: str) -> None:
        tag(where, attrs)
        listed = rng.random() < 0.7
        if listed:
            tag("ul")
        for _ in range(rng.randint(2, 10)):
            if listed:
                tag("li")
            tag("a", f'href="/{rng.randint(1, 99)}"')
            out.append(_words(rng, 1, 3).rstrip("."))
            end("a")
            if listed:
                end("li")
        if listed:
            end("ul")
        end(where)

    def small(where: str, attrs: str, low: int = 3, high: int = 25) -> None:
        tag(where, attrs)
        if rng.random() < 0.4:
            tag("p")
            out.append(_words(rng, low, high))
            end("p")
        else:
            out.append(("&copy; " if rng.random() < 0.3 else "") + _words(rng, low, high))
        if rng.random() < 0.4:
            tag("a", 'href="#"')
            out.append(_words(rng, 1, 4))
            end("a")
        end(where)

    def article() -> None:
        shell = rng.choice((("article", ""), ("main", ""), ("div", 'class="content"'), ("div", 'id="main-content"'), ("div", 'class="post-body entry"'), ("section", cls("story", "text", "x1")), ("div", cls("col-8", "wrap", "c12"))))
        tag(shell[0], shell[1], True)
        if rng.random() < 0.8:
            tag(rng.choice(("h1", "h1", "h2")), "", True)
            out.append(_words(rng, 2, 12))
            end(out[-2][1:3])
        for _ in range(rng.choice((1, 2, 4, 8, 14))):
            kind = rng.random()
            if kind < 0.7:
                tag("p", "", True)
                if rng.random() < 0.25:
                    tag("b", "", True)
                    out.append(_words(rng, 2, 20))
                    end("b", False)
                    if rng.random() < 0.3:
                        tag("br", "", True)
                out.append(_words(rng, 1, rng.choice((6, 30, 90))))
                if rng.random() < 0.15:
                    tag("a", 'href="/r"', True)
                    out.append(_words(rng, 1, 3))
                    end("a")
                    out.append(_words(rng, 1, 20))
                end("p", rng.random() < 0.7)
            elif kind < 0.78:
                tag("ul", "", True)
                for _ in range(rng.randint(2, 6)):
                    tag("li", "", True)
                    out.append(_words(rng, 3, 20))
                    end("li", False)
                end("ul")
            elif kind < 0.86:
                tag(rng.choice(("h2", "h3")), "", True)
                out.append(_words(rng, 1, 8))
                end(out[-2][1:3])
            elif kind < 0.92:
                tag("blockquote", "", True)
                out.append(_words(rng, 5, 40))
                end("blockquote")
            elif kind < 0.96:
                small("div", rng.choice(('class="ad"', 'class="share social"', 'class="related"')))
            else:
                tag("pre", "", True)
                out.append(_words(rng, 5, 40))
                end("pre")
        end(shell[0])

    tag("html")
    tag("head")
    tag("title")
    out.append(_words(rng, 2, 10))
    end("title")
    end("head")
    tag("body")
    if rng.random() < 0.5:
        small("header", cls("masthead", "site-header"))
    if rng.random() < 0.8:
        menu(*rng.choice((("nav", ""), ("div", 'class="menu"'), ("div", cls("topbar", "nav-links")))))
    for _ in range(rng.randint(0, 2)):
        small("div", rng.choice(('class="ad"', 'class="banner"', 'id="cookie-notice"', 'class="promo box"')))
    if rng.random() < 0.3:
        small("aside", cls("sidebar", "rail"), 5, 40)
    article()
    for _ in range(rng.randint(0, 2)):
        rng.choice((lambda: small("aside", cls("sidebar", "rail"), 5, 40), lambda: menu("div", 'class="related"'), lambda: small("div", 'class="comments"', 5, 40), lambda: small("div", 'class="ad"')))()
    if rng.random() < 0.85:
        small(*rng.choice((("footer", ""), ("div", 'id="footer"'), ("div", 'class="copyright legal"'))))
    end("body", rng.random() < 0.9)
    end("html", rng.random() < 0.9)
    return "".join(out), label


def training_set(pages: int, seed: int) -> list[tuple[Page, np.ndarray]]:
    rng = random.Random(seed)
    out = []
    for _ in range(pages):
        source, label = training_page(rng)
        page = parse(source)
        out.append((page, np.array(label)))
    return out


@lru_cache(maxsize=2)
def trained(pages: int = 600, seed: int = 7) -> Trees:
    xs, ys, ws = [], [], []
    for page, label in training_set(pages, seed):
        x, own = features(page)
        some = own > 0
        xs.append(x[some])
        ys.append(label[some])
        ws.append(np.log1p(own[some]))
    return boost(np.vstack(xs), np.concatenate(ys).astype(float), np.concatenate(ws))


def extract_one(sources: list[str], model: Trees, price: float = 1.0) -> list[tuple[str, int, int]]:
    """Text, number of elements and number of content elements with text."""
    pages = [parse(s) for s in sources]
    got = [features(p) for p in pages]
    prob = model.predict(np.vstack([x for x, _ in got])) if got else np.zeros(0)
    out, at = [], 0
    for page, (x, own) in zip(pages, got):
        keep = decode(page.parent, page.end, prob[at : at + len(x)], own, price)
        at += len(x)
        out.append((render(page, keep), len(x) - 1, int((keep & (own > 0)).sum())))
    return out


def extract(pages: DataFrame, model: Trees | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, elements, content_elements for every page."""
    ensure_columns(pages, id_col, html_col)
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = tk.as_array(batch.column(1))
            for i, j in tk.slices(sources, 1_000_000):
                text, total, kept = zip(*extract_one(sources.slice(i, j - i).to_pylist(), model))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(text, pa.string()), pa.array(total, pa.int64()), pa.array(kept, pa.int64())], names=["page_id", "text", "elements", "content_elements"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, text string, elements long, content_elements long")
