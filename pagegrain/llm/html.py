"""HTML extraction: gradient-boosted trees over DOM nodes, decoded over the tree so that choices agree.

A page becomes a tree of block nodes (inline markup is read through). Each node gets features of its tag, attribute
tokens, depth, siblings, and densities over its subtree; the trees give the odds that it carries main text.
Decoding takes the most likely labelling under one constraint: below a dropped node nothing is kept. The trees
are trained here on pages that ``made`` draws from a fixed seed, whose labels are known; no page of the input is a label.
Attribute tokens count by kind; a share of the made pages has tokens of no kind, so that structure alone must do there.

Text of scripts, styles, form controls, labels, drawings, players and the head is never text. White space (a <br> too) inside a block becomes one
space; blocks are joined by one newline in page order. Edge cases: null or empty html, or none kept: empty text;
cut-off markup: what is open ends there; very long pages: one page is in memory at a time beside its batch; repeated rows
give repeated results. Only page_id, url and html are read, so other columns' names can't clash.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees
from .session import bounded, tidy

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*>|</[^>]*>",
    re.S,
)
_PARTIAL = re.compile(r"<(?:[a-zA-Z!?/])")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PIECE = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_RAW = frozenset("script style textarea title xmp iframe noembed noframes template noscript".split())
_HIDDEN = frozenset("head select option datalist map legend".split())
#: Hidden elements that stand within a line: their text goes, and the block around them stays whole.
_MUTE = frozenset("label button svg canvas object audio video".split())
#: End tags of those elements, in any case of letters; ASCII alone, so that no other letter passes for one of a name.
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in _RAW}
_MUTE_END = re.compile(f"</({'|'.join(sorted(_MUTE))})(?![^\\s/>])", re.I | re.A)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FAMILIES = (
    ("p",),
    ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"),
    ("li", "dd", "dt"),
    ("ul", "ol", "dl", "menu"),
    ("div", "center"),
    ("section",),
    ("article", "main"),
    ("nav",),
    ("header",),
    ("footer", "address"),
    ("aside",),
    ("form", "fieldset", "dialog", "search"),
    ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"),
    ("blockquote", "pre", "figure", "figcaption", "details", "summary"),
    ("html", "body"),
    ("#text",),
)
_FAMILY = {tag: k for k, tags in enumerate(_FAMILIES) for tag in tags}
_BLOCK = frozenset(_FAMILY) | _HIDDEN
#: Attribute tokens by kind; one bit more says that a node has tokens of no kind.
_KINDS = (
    "nav menu navbar breadcrumb breadcrumbs pagination pager toc tabs toolbar navigation",
    "ad ads advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored dfp outbrain taboola adsense",
    "comment comments reply replies disqus respond discussion commentlist feedback reviews",
    "foot footer copyright colophon legal contentinfo",
    "head header masthead topbar logo branding",
    "side sidebar aside widget widgets related recommended popular trending share social sharing tags complementary more",
    "notice notices cookie cookies consent alert popup modal overlay gdpr newsletter subscribe subscription paywall warning toast",
    "form search login signin signup register contact searchbox",
    "content article post entry story main body text prose hentry page blog",
)
_KIND = {token: k for k, tokens in enumerate(_KINDS) for token in tokens.split()}
_CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_SCOPE = frozenset("ul ol dl table select menu".split())
N_FEATURES = len(_FAMILIES) + 2 * (len(_KINDS) + 1) + 18


class Node:
    __slots__ = ("chars", "children", "depth", "kinds", "links", "order", "runs", "tag", "words")

    def __init__(self, tag: str, depth: int, kinds: int = 0):
        self.tag, self.depth, self.kinds = tag, depth, kinds
        self.children: list[Node] = []
        self.runs: list[str] = []
        self.chars = self.links = self.words = self.order = 0


def _kinds(attributes: str) -> int:
    out = 0
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            known = 0
            for token in _PIECE.findall(_CAMEL.sub(r"\1 \2", m[1] or m[2] or m[3] or "").lower()):
                if (k := _KIND.get(token)) is not None:
                    known |= 1 << k
            out |= known or 1 << len(_KINDS)
    return out


def parse(source: str, kinds=_kinds) -> Node:
    """The tree of block nodes; text that stands beside child blocks becomes a child ``#text`` of its own."""
    root = Node("html", 0)
    stack, at, end, text, links, linked, hidden = [root], 0, len(source), [], 0, 0, 0
    last, ends = source.rfind(">"), None
    muted: list[tuple[str, int]] = []  # open _MUTE elements with the number of blocks around them

    def close_run() -> None:
        nonlocal text, links
        if text:
            run = " ".join(entities.unescape("".join(text)).split())
            if run and not hidden:
                top = stack[-1]
                leaf = Node("#text", top.depth + 1)
                leaf.runs.append(run)
                leaf.chars, leaf.words, leaf.links = len(run), run.count(" ") + 1, min(links, len(run))
                top.children.append(leaf)
            text, links = [], 0

    def pop() -> None:
        nonlocal hidden
        gone = stack.pop()
        hidden -= gone.tag in _HIDDEN
        while muted and muted[-1][1] > len(stack):  # a block's end ends what is open in it
            muted.pop()

    while at < end:
        cut, m = source.find("<", at), None
        while 0 <= cut <= last and (m := _TOKEN.match(source, cut)) is None:  # a bare <
            cut = source.find("<", cut + 1)
        if m is None and (partial := _PARTIAL.search(source, max(at, last + 1))):
            end = partial.start()  # a tag that the page's end cuts off
        stop = cut if m else end
        if stop > at and not muted:
            text.append(source[at:stop])
            if linked:
                links += stop - at
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                linked = 0
            elif tag in _MUTE:
                if any(t == tag for t, _ in muted):
                    while muted.pop()[0] != tag:
                        pass
            elif tag in _BLOCK:
                close_run()
                if any(n.tag == tag for n in stack[1:]):
                    while stack[-1].tag != tag:
                        pop()
                    pop()
            continue
        if tag in _RAW:
            close = _RAW_END[tag].search(source, at, end)
            at = close.start() if close else end
            text.append(" ")
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            linked = 1
        elif tag == "html":
            pass
        elif tag in _MUTE:
            if ends is None:  # the last end tag of each name, sought once
                ends = {e[1].lower(): e.start() for e in _MUTE_END.finditer(source)}
            if not m[3].endswith("/") and ends.get(tag, -1) >= at:  # one that nothing ends hides nothing
                muted.append((tag, len(stack)))
        elif tag in _BLOCK or tag == "hr":
            close_run()
            linked = 0
            if stack[-1].tag == "p":
                pop()
            if tag in _CLOSES:
                for n in reversed(stack[1:]):
                    if n.tag in _SCOPE:
                        break
                    if n.tag in _CLOSES[tag]:
                        while stack[-1] is not n:
                            pop()
                        pop()
                        break
            elif tag == "body" and len(stack) > 1 and stack[-1].tag == "head":
                pop()
            if tag not in _VOID and not m[3].endswith("/"):
                node = Node(tag, stack[-1].depth + 1, kinds(m[3]))
                stack[-1].children.append(node)
                stack.append(node)
                hidden += tag in _HIDDEN
    close_run()
    return root


def flatten(root: Node) -> tuple[list[Node], list[int]]:
    """Nodes with text in page order, parents first, and the place of each one's parent; a lone text run joins its parent."""
    todo, order = [root], []
    while todo:  # sizes, children before parents
        n = todo.pop()
        order.append(n)
        todo.extend(n.children)
    for n in reversed(order):
        if n.tag != "#text":
            n.children = [c for c in n.children if c.chars]
            n.chars, n.words, n.links = sum(c.chars for c in n.children), sum(c.words for c in n.children), sum(c.links for c in n.children)
            if len(n.children) == 1 and n.children[0].tag == "#text":
                n.runs, n.children = n.children[0].runs, []
    nodes, parents, stack = [], [], [(root, -1)]
    while stack:
        n, p = stack.pop()
        n.order = len(nodes)
        nodes.append(n)
        parents.append(p)
        stack.extend((c, n.order) for c in reversed(n.children))
    return nodes, parents


def node_features(nodes: list[Node], parents: list[int]) -> np.ndarray:
    """One row of ``N_FEATURES`` for each node. Nodes are in page order, so a subtree is a range and its sums are differences."""
    n, fam, kin = len(nodes), len(_FAMILIES), len(_KINDS)
    up = np.array(parents, np.int64)
    up[0] = 0
    number = lambda values: np.fromiter(values, np.float64, n)
    chars, words, links, depth = (number(getattr(x, k) for x in nodes) for k in ("chars", "words", "links", "depth"))
    leaf, marks = number(bool(x.runs) for x in nodes), number(sum(map(x.runs[0].count, ".,?!")) if x.runs else 0 for x in nodes)
    heads, main = number(x.tag[0] == "h" and x.tag[1:].isdigit() for x in nodes), number(x.tag in ("article", "main") for x in nodes)
    size, above, index, same = np.ones(n), [0] * n, np.zeros(n), np.zeros(n)
    for i in range(n - 1, 0, -1):
        size[parents[i]] += size[i]
    inside = np.zeros(n)
    for i, node in enumerate(nodes):
        if i:
            above[i] = above[parents[i]] | nodes[parents[i]].kinds
            inside[i] = inside[parents[i]] or main[parents[i]]
        if node.children:
            tags = Counter(c.tag for c in node.children)
            for k, c in enumerate(node.children):
                index[c.order], same[c.order] = k, tags[c.tag]
    below = lambda v: np.concatenate(([0.0], np.cumsum(v)))
    at, end = np.arange(n), np.arange(n) + size.astype(np.int64)
    within = lambda v: below(v)[end] - below(v)[at]
    children = number(len(x.children) for x in nodes)
    siblings, around = children[up], chars[up]
    siblings[0] = 1
    own, inherited = np.array([x.kinds for x in nodes], np.int64), np.array(above, np.int64)
    out = np.zeros((n, N_FEATURES), np.float32)
    out[at, [_FAMILY.get(x.tag, 4) for x in nodes]] = 1
    for k in range(kin + 1):
        out[:, fam + k] = own >> k & 1
        out[:, fam + kin + 1 + k] = inherited >> k & 1
    total, one = max(1.0, chars[0]), np.maximum(1, chars)
    out[:, fam + 2 * kin + 2 :] = np.stack((
        np.log1p(chars), np.log1p(words), links / one, chars / size, words / np.maximum(1, within(leaf)), within(marks) / np.maximum(1, words), depth, index / siblings, siblings,
        same, children, chars / total, below(chars * leaf)[at] / total, inside, within(heads) > 0, around / total, chars / np.maximum(1, around), chars / np.maximum(1, words),
    ), axis=1)
    return out


def decode(parents: list[int], p: np.ndarray) -> np.ndarray:
    """The likeliest labels such that a kept node's parent is kept; the root always is."""
    n = len(parents)
    p = np.clip(p, 1e-6, 1 - 1e-6)
    keep, drop = np.log(p), np.log1p(-p)  # of the subtree, with its root kept or dropped
    for i in range(n - 1, 0, -1):
        keep[parents[i]] += max(keep[i], drop[i])
        drop[parents[i]] += drop[i]
    out = np.zeros(n, bool)
    out[0] = True
    for i in range(1, n):
        out[i] = out[parents[i]] and keep[i] >= drop[i]
    return out


_LABEL = re.compile(r"data-k([01])")


def _labelled(attributes: str) -> int:
    """``_kinds`` with a made page's label in the high bits."""
    m = _LABEL.search(attributes)
    return _kinds(attributes) | (1 << 40 if m and m[1] == "1" else 0) | (1 << 41 if m else 0)


def made(seed: int, pages: int) -> list[Node]:
    """Trees of made-up pages with labels: 1 for nodes that carry main text, 0 for the rest."""
    rnd = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    pool = ["".join(rnd.choices(letters, k=rnd.randint(1, 10))) for _ in range(2000)]

    def sentence(lo: int, hi: int) -> str:
        return " ".join(rnd.choices(pool, k=rnd.randint(lo, hi))).capitalize() + rnd.choice((".", ".", ".", "", "!", "?"))

    def text(lo: int, hi: int) -> str:
        return " ".join(sentence(3, 20) for _ in range(rnd.randint(lo, hi)))

    def tag(name: str, inner: str, kind: int | None, keep: int, bare: float = 0.3) -> str:
        """An element whose attribute tokens are of a kind; some pages' tokens are all of none."""
        tokens = strange if odd else _KINDS[kind].split() if kind is not None else []
        attribute = "" if not tokens or rnd.random() < bare else f' {rnd.choice(("class", "class", "class", "id"))}="{rnd.choice(tokens)}{rnd.choice(("", "-" + rnd.choice(letters) * 2, "-box x1"))}"'
        return f'<{name}{attribute} data-k{keep}="1">{inner}</{name}>'

    def links(n: int, item: str = "li") -> str:
        return "".join(f'<{item} data-k0="1"><a href="/">{sentence(1, 4)}</a></{item}>' for _ in range(n))

    def junk(which: int) -> str:
        if which == 0:
            return tag(rnd.choice(("nav", "nav", "div")), f'<ul data-k0="1">{links(rnd.randint(2, 9))}</ul>' if rnd.random() < 0.7 else links(rnd.randint(2, 6), "p"), 0, 0)
        if which == 1:
            return tag(rnd.choice(("div", "div", "aside", "section", "p")), rnd.choice((sentence(2, 15), text(1, 2), f'<a href="/">{sentence(2, 9)}</a>')), 1, 0, 0.0)
        if which == 2:
            return tag(rnd.choice(("section", "div")), f'<h3 data-k0="1">{sentence(1, 2)}</h3>' * rnd.randint(0, 1) + "".join(tag(rnd.choice(("div", "p", "li", "article")), rnd.choice((text(1, 5), f'<p data-k0="1">{text(1, 4)}</p>')), 2, 0) for _ in range(rnd.randint(1, 6))), 2, 0, 0.0)
        if which == 3:
            return tag(rnd.choice(("footer", "footer", "div")), rnd.choice((f"&copy; {sentence(2, 12)}", f'<p data-k0="1">&copy; {text(1, 2)}</p>', f'<ul data-k0="1">{links(3)}</ul>{sentence(2, 8)}')), 3, 0, 0.5)
        if which == 4:
            return tag(rnd.choice(("header", "div")), rnd.choice((sentence(1, 5), f'<a href="/">{sentence(1, 3)}</a>', f'<h2 data-k0="1">{sentence(1, 3)}</h2><p data-k0="1">{sentence(2, 8)}</p>')), 4, 0, 0.0)
        if which == 5:
            return tag(rnd.choice(("aside", "aside", "div")), f'<h3 data-k0="1">{sentence(1, 3)}</h3>' * rnd.randint(0, 1) + rnd.choice((f'<ul data-k0="1">{links(rnd.randint(2, 8))}</ul>', f'<p data-k0="1">{text(1, 3)}</p>')), 5, 0, 0.0)
        if which == 6:
            return tag(rnd.choice(("div", "div", "section", "p")), rnd.choice((text(1, 3), f'<p data-k0="1">{text(1, 2)}</p>')), 6, 0, 0.0)
        return tag("form", f'<p data-k0="1">{sentence(2, 8)}</p>{sentence(1, 4)}', 7, 0)

    def block() -> str:
        r = rnd.random()
        if r < 0.06:
            return f'<{(name := rnd.choice(("div", "div", "section")))} data-k1="1"><p data-k1="1">{text(1, 4)}</p></{name}>'
        if r < 0.72:
            return f'<p data-k1="1">{text(1, rnd.choice((1, 3, 8)))}</p>'
        if r < 0.8:
            return f'<h2 data-k1="1">{sentence(1, 8)}</h2>'
        if r < 0.88:
            return '<ul data-k1="1">' + "".join(f'<li data-k1="1">{sentence(3, 15)}</li>' for _ in range(rnd.randint(2, 6))) + "</ul>"
        if r < 0.94:
            return f'<blockquote data-k1="1">{text(1, 3)}</blockquote>'
        return f'<table data-k1="1"><tr data-k1="1"><td data-k1="1">{sentence(1, 5)}</td><td data-k1="1">{sentence(1, 5)}</td></tr></table>'

    out = []
    for _ in range(pages):
        odd, strange = rnd.random() < 0.15, rnd.choices(pool, k=6)
        plain = rnd.random() < 0.15  # nothing but the article
        if rnd.random() < 0.2:  # a few words are the whole article
            body = [f'<h1 data-k1="1">{sentence(1, 4)}</h1>'] * (rnd.random() < 0.85) + [f'<p data-k1="1">{sentence(1, 4)}</p>'] * rnd.choice((1, 1, 2))
        else:
            body = [f'<h1 data-k1="1">{sentence(2, 14)}</h1>'] * (rnd.random() < 0.85) + [block() for _ in range(rnd.choice((1, 1, 2, 4, 8, 16)))]
        for _ in range(0 if plain else rnd.choice((0, 0, 0, 1, 2))):
            body.insert(rnd.randint(0, len(body)), junk(rnd.choice((1, 1, 5, 6, 7, 2))))
        if rnd.random() < 0.25 and not plain:
            body.append(junk(2))
        article = tag(rnd.choice(("article", "article", "main", "div", "div", "section")), "".join(body), 8, 1, 0.3)
        for _ in range(rnd.choice((0, 0, 1, 2))):
            beside = [junk(rnd.choice((5, 1, 2)))] if rnd.random() < 0.4 and not plain else []
            article = tag(rnd.choice(("div", "main", "section")), "".join([article, *beside]), rnd.choice((8, None)), 1, 0.5)
        parts = [article]
        for which in (3, 2, 5, 7, 6, 1):
            if rnd.random() < (0.85 if which == 3 else 0.35) and not plain:
                parts.append(junk(which))
        for which in (1, 0, 4, 6):
            if rnd.random() < (0.8 if which == 0 else 0.4) and not plain:
                parts.insert(0, junk(which))
        out.append(parse(f"<html><body>{''.join(parts)}</body></html>", _labelled))
    return out


@lru_cache(maxsize=1)
def model(seed: int = 11, pages: int = 800) -> trees.Forest:
    """The forest; the same one each time, from made pages alone."""
    xs, ys = [], []
    for root in made(seed, pages):
        nodes, parents = flatten(root)
        y = np.zeros(len(nodes))
        for i, n in enumerate(nodes):
            y[i] = n.kinds >> 40 & 1 if n.kinds >> 41 & 1 else 1 if n.tag in ("html", "body") else y[parents[i]]
            n.kinds &= (1 << 40) - 1
        xs.append(node_features(nodes, parents))
        ys.append(y)
    return trees.fit(np.concatenate(xs), np.concatenate(ys), trees=60, depth=5, rate=0.25, share=0.5)


def extract(sources: list[str | None], forest: trees.Forest) -> list[str]:
    """The main text of each page."""
    pages = [flatten(parse(s or "")) for s in sources]
    scores = forest.predict(np.concatenate([node_features(*p) for p in pages])) if pages else np.zeros(0)
    out, at = [], 0
    for nodes, parents in pages:
        kept = decode(parents, scores[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(n.runs[0] for n, k in zip(nodes, kept, strict=True) if k and n.runs))
    return out


def _extracted(held: int, forest):
    def run(batches):
        trained = forest.value
        for batch in batches:
            texts = []
            for i in range(0, batch.num_rows, 64):
                texts += extract(batch.column(held).slice(i, 64).to_pylist(), trained)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(held)), pa.array(texts, pa.string())], [*batch.schema.names[:held], "text"])

    return run


def extract_pages(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text and n_chars (its code points) of every page."""
    rows = bounded(pages).select(*keep, F.col("html").alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    forest = pages.sparkSession.sparkContext.broadcast(model())  # some 60 trees of 63 nodes
    return rows.mapInArrow(tidy(_extracted(len(keep), forest)), f"{schema}, text string").withColumn("n_chars", F.char_length("text").cast("long"))
