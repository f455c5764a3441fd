"""Main text of web pages: gradient-boosted trees score DOM nodes, and a hierarchical decoding picks them without contradictions."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession

from .common import batched, table
from .sample_pages import MARK, sample_page

#: Sample pages that the model is trained on, boosting rounds and depth.
PAGES, ROUNDS, DEPTH = 6000, 60, 5

#: A tag without "<" inside; one with it in a quoted value, which is looked for in so many characters; one with unpaired quotes.
#: No scan goes beyond the next "<" or LONG characters, so that time grows with the page alone, however it is broken.
_STRICT = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>""")
_LOOSE = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>")
LONG = 2000
_ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+)""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements whose content is no text of the page, and those of them whose content is no markup and goes on until their end tag.
_SKIPPED = frozenset("script style template noscript iframe svg object canvas audio video map title".split())
_RAW = frozenset("script style noscript iframe title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line of text; those with a name of their own are nodes, but part no words.
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder semantics".split())
_CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An open element that a start tag closes, and the elements at which the search for it ends.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TAGS = ["html body", "article", "main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "nav", "header", "footer", "aside", "form fieldset", "button input select textarea option", "table tbody thead tr td th", "figure figcaption", "blockquote pre", "dialog ins"]
_GROUP = {t: i for i, x in enumerate(_TAGS) for t in x.split()}
#: Words in names of elements, by what they hint at.
_HINTS = [
    "ad ads advert advertisement advertising sponsored sponsor promo promotion adsbox banner adsbygoogle commercial", "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc submenu", "header masthead topbar top branding logo", "footer colophon copyright bottom legal imprint",
    "sidebar side widget rail secondary column", "cookie cookies consent notice alert popup modal gdpr warning notification overlay paywall privacy disclaimer", "newsletter subscribe subscription signup login search form contact register", "comment comments reply replies disqus discussion responses reviews",
    "share social sharing follow buttons", "related recommended popular trending more tags also stories teaser", "article content post entry story text main body articlebody",
]
_HINT = {w: 1 << i for i, x in enumerate(_HINTS) for w in x.split()}
_ABOVE = ["nav", "header", "footer", "aside", "form", "article", "main"]
_ABOVE_BIT = {t: 1 << i for i, t in enumerate(_ABOVE)}
_COUNTS = ("chars", "linked", "marks", "controls", "copyright", "in_p")
_CONTROLS = frozenset("input button select textarea label option".split())


def _markup(source: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """start, end, whether it closes, lower-case name (None: a comment or the like) and attributes of each piece of markup."""
    at = 0
    while (at := source.find("<", at)) >= 0:
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            end = end + 3 if end >= 0 else len(source)
            yield at, end, False, None, ""
        elif source[at + 1 : at + 2] in ("!", "?") or source.startswith("</", at) and not source[at + 2 : at + 3].isalpha():
            end = source.find(">", at) + 1 or len(source)
            if end == len(source) and not source.endswith(">"):
                return  # no more markup ends
            yield at, end, False, None, ""
        elif m := _STRICT.match(source, at) or _LOOSE.match(source, at, at + LONG) or _BROKEN.match(source, at):
            end = m.end()
            yield at, end, bool(m[1]), m[2].lower(), m[3]
        else:
            end = at + 1
        at = end


class Page:
    """The nodes of a page in document order, and its text as (node, piece) in that order; blocks are parted by a space."""

    __slots__ = ("tags", "parents", "hints", "above", "marked", "counts", "pieces", "stack", "places")

    def __init__(self, source: str):
        self.tags, self.parents, self.hints, self.above, self.marked = ["html"], [-1], [0], [0], [False]
        self.counts = [[0] * len(_COUNTS)]
        self.pieces: list[tuple[int, str]] = []
        self.stack, self.places = [0], {"html": [0]}  # open nodes, and by tag where in the stack they are
        at, linked, endless = 0, False, set()
        for start, end, close, tag, attributes in _markup(source):
            if start < at:
                continue
            if start > at:
                self._text(self.stack[-1], source[at:start], linked)
            at = end
            if tag is None or tag == "head":  # a head has no text but that of skipped elements, and its end tag may be left out
                continue
            if close:
                if tag == "a":
                    linked = False
                if tag in _INLINE:
                    if self.tags[self.stack[-1]] == tag and len(self.stack) > 1:
                        self._pop(len(self.stack) - 1)
                    continue
                self._space(self.stack[-1])
                if (k := self._last({tag})) > 0:
                    self._pop(k)
                    linked = False
                continue
            if tag in _SKIPPED:
                if not attributes.endswith("/") and tag not in endless:
                    found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                    if found:
                        at = found.end()
                    elif tag in _RAW:
                        at = len(source)
                    else:
                        endless.add(tag)  # an element that isn't closed skips nothing
                continue
            if tag in _CONTROLS:
                self.counts[self.stack[-1]][3] += 1
            if tag == "br" or tag == "hr":
                self._space(self.stack[-1])
            if tag == "a":
                linked = True
            if tag in _VOID:
                continue
            hint, named = 0, False
            if "=" in attributes:
                for name, value in _ATTRIBUTE.findall(attributes):
                    name = name.lower()
                    if name in ("class", "id", "role", "itemprop", "aria-label"):
                        named = True
                        for word in _TOKEN.findall(value):
                            hint |= _HINT.get(word.lower(), 0)
            if tag in _INLINE:
                if not (named and tag != "a") and tag != "ins":
                    continue
            else:
                linked = False
                self._space(self.stack[-1])
                if tag in _CLOSES_P:
                    self._close({"p"}, {"button", "td", "th", "table"})
                elif tag in _CLOSES:
                    self._close(*_CLOSES[tag])
            up = self.stack[-1]
            self.places.setdefault(tag, []).append(len(self.stack))
            self.stack.append(len(self.tags))
            self.tags.append(tag)
            self.parents.append(up)
            self.hints.append(hint)
            self.above.append(self.above[up] | _ABOVE_BIT.get(self.tags[up], 0) | self.hints[up] << len(_ABOVE))
            self.marked.append(MARK in attributes)
            self.counts.append([0] * len(_COUNTS))
        if at < len(source):
            self._text(self.stack[-1], source[at:], linked)

    def _last(self, tags: set[str]) -> int:
        """Where in the stack the innermost open node of ``tags`` is, 0 if none is."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _pop(self, k: int) -> None:
        for node in reversed(self.stack[k:]):
            self.places[self.tags[node]].pop()
        del self.stack[k:]

    def _close(self, what: set[str], until: set[str]) -> None:
        while (k := self._last(what)) > self._last(until):
            self._pop(k)
            if what == {"p"} or len(what) == 2:
                return

    def _space(self, node: int) -> None:
        self.pieces.append((node, " "))

    def _text(self, node: int, raw: str, linked: bool) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.pieces.append((node, text))
        n = len(text.strip())
        if n:
            c = self.counts[node]
            c[0] += n
            c[1] += n * linked
            c[2] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
            c[4] += "©" in text
            c[5] += n * (self.tags[node] == "p")

    def text(self, kept: np.ndarray) -> str:
        flags = kept.tolist()
        return " ".join("".join([x if flags[i] else " " for i, x in self.pieces]).split())


def _ends(parents: np.ndarray) -> np.ndarray:
    """One past the last descendant of each node, from parents in document order."""
    last = np.arange(1, len(parents) + 1)
    for i in range(len(parents) - 1, 0, -1):
        p = parents[i]
        if p >= 0 and last[i] > last[p]:
            last[p] = last[i]
    return last


def node_features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all nodes of all pages, their parents and subtree ends as numbers in the whole, and each page's first node."""
    starts = np.cumsum([0, *(len(p.tags) for p in pages)])
    n = int(starts[-1])
    parents = np.array([q + s if q >= 0 else -1 for p, s in zip(pages, starts) for q in p.parents])
    ends = _ends(parents)
    root = np.repeat(starts[:-1], np.diff(starts))
    counts = np.array([c for p in pages for c in p.counts], float)
    tag = np.array([_GROUP.get(t, len(_TAGS)) for p in pages for t in p.tags])
    sums = np.concatenate([np.zeros((1, counts.shape[1])), np.cumsum(counts, axis=0)])
    sub = sums[ends] - sums[np.arange(n)]
    depth = np.zeros(n)
    for i in range(n):
        if parents[i] >= 0:
            depth[i] = depth[parents[i]] + 1
    chars = sub[:, 0]
    nodes = ends - np.arange(n)
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    up = np.where(parents >= 0, parents, root)
    siblings = np.where(parents >= 0, np.bincount(up[parents >= 0], minlength=n)[up], 1)
    key = (parents + 1) * (len(_TAGS) + 1) + tag
    _, back, alike = np.unique(key, return_inverse=True, return_counts=True)
    order = np.zeros(n)
    seen = np.zeros(n)
    for i in range(n):
        if parents[i] >= 0:
            order[i] = seen[up[i]]
            seen[up[i]] += 1
    paragraphs = np.concatenate([[0], np.cumsum(tag == _GROUP["p"])])
    is_head = np.concatenate([[0], np.cumsum(tag == _GROUP["h1"])])
    bits = lambda values, k: (np.array(values)[:, None] >> np.arange(k) & 1).astype(float)
    x = [
        depth, np.log1p(chars), share(sub[:, 1], chars), np.log1p(nodes), np.log1p(chars / nodes), np.log1p(counts[:, 0]), share(sub[:, 2], chars), share(chars, chars[root]), paragraphs[ends] - paragraphs[np.arange(n)],
        share(sub[:, 5], chars), sub[:, 3], sub[:, 4], siblings, share(order, np.maximum(siblings, 1)), np.where(parents >= 0, share(alike[back], np.maximum(siblings, 1)), 1), np.log1p(share(chars[up] - chars, np.maximum(siblings - 1, 1))), share(chars, chars[up]), is_head[ends] - is_head[np.arange(n)],
        np.log1p(chars[up]), share(sub[up, 1], chars[up]),
    ]
    hot = np.eye(len(_TAGS) + 1)[tag]
    own = bits([h for p in pages for h in p.hints], len(_HINTS))
    above = bits([h for p in pages for h in p.above], len(_ABOVE) + len(_HINTS))
    # in one number, as trees would need many splits for it: a tag or name that hints at boilerplate, here or above
    boiler = hot[:, [_GROUP[t] for t in ("nav", "header", "footer", "aside", "form", "button", "dialog")]].sum(axis=1) + own[:, :-1].sum(axis=1)
    over = above[:, :5].sum(axis=1) + above[:, len(_ABOVE) : -1].sum(axis=1)
    return np.column_stack([*x, boiler, over, boiler + over, hot, own, above]), parents, ends, root


@dataclass(frozen=True)
class Trees:
    """A boosted ensemble as arrays: for each tree and node the feature (-1: leaf), threshold, children and value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for f, t, lo, hi, v in zip(self.feature, self.threshold, self.left, self.right, self.value):
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                split = f[at] >= 0
                at = np.where(split, np.where(x[rows, np.maximum(f[at], 0)] <= t[at], lo[at], hi[at]), at)
            out += v[at]
        return out


_MODELS: dict[tuple[int, int, int], Trees] = {}


def train(spark: SparkSession, pages: int = PAGES, rounds: int = ROUNDS, depth: int = DEPTH) -> Trees:
    """Boosted trees over the nodes of ``pages`` sample pages. A node is main text if it, one above or one below is marked.

    The sample doesn't depend on any input, so a process trains a model once.
    """
    if found := _MODELS.get((pages, rounds, depth)):
        return found

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [Page(sample_page(seed)) for seed in batch.column(0).to_pylist()]
            x, parents, ends, _ = node_features(made)
            marked = np.array([m for p in made for m in p.marked])
            below = np.concatenate([[0], np.cumsum(marked)])
            label = below[ends] > below[np.arange(len(ends))]
            for i, p in enumerate(parents):
                label[i] |= p >= 0 and marked[p]
                marked[i] |= p >= 0 and marked[p]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), pa.array(label.astype(float))], names=["x", "label"])

    rows = spark.range(0, pages, 1, 8).mapInArrow(nodes, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=64, stepSize=0.2, minInstancesPerNode=4, seed=7, cacheNodeIds=False).fit(rows)
    flat = [_flat(tree._java_obj.rootNode(), weight) for tree, weight in zip(model.trees, model.treeWeights)]
    size = max(len(f) for f in flat)
    part = lambda k, kind: np.array([[node[k] for node in f] + [0] * (size - len(f)) for f in flat], kind)
    found = _MODELS[pages, rounds, depth] = Trees(part(0, int), part(1, float), part(2, int), part(3, int), part(4, float), depth)
    return found


def _flat(root, weight: float) -> list[tuple[int, float, int, int, float]]:
    out: list = []

    def add(node) -> int:
        i = len(out)
        out.append(None)
        if node.subtreeDepth() == 0:
            out[i] = (-1, 0.0, 0, 0, weight * node.prediction())
        else:
            split = node.split()
            lo, hi = add(node.leftChild()), add(node.rightChild())
            out[i] = (split.featureIndex(), split.threshold(), lo, hi, 0.0)
        return i

    add(root)
    return out


#: What is added to a node's margin if its parent is kept: most parts of a main text are main text.
SWITCH = 1.0


def decode(margin: np.ndarray, parents: np.ndarray, ends: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Which nodes to keep so that the margins' sum is greatest, with ``switch`` for each node kept under a kept one, if what
    is dropped is dropped with all below it.

    From the leaves up, the best of a subtree is the greater of keeping its root, with the best of each child, and
    dropping everything; from the root down, a node is kept if it is so in its subtree and its parent is kept.
    """
    n = len(margin)
    sums = np.concatenate([[0.0], np.cumsum(margin)])
    dropped = (-(sums[ends] - sums[:n])).tolist()
    best, kept, up = margin.tolist(), [False] * n, parents.tolist()
    for i in range(n - 1, -1, -1):
        own = best[i] + switch
        kept[i] = own > dropped[i] or up[i] < 0  # the root stands for the page
        if up[i] >= 0:
            best[up[i]] += own if kept[i] else dropped[i]
    for i in range(n):
        kept[i] = kept[i] and (up[i] < 0 or kept[up[i]])
    return np.array(kept)


def main_texts(sources: list[str], trees: Trees) -> list[str]:
    """The main text of each page; empty if there is none."""
    pages = [Page(x) for x in sources]
    x, parents, ends, root = node_features(pages)
    kept = decode(trees.margin(x), parents, ends)
    starts = np.flatnonzero(root == np.arange(len(root)))
    return [p.text(kept[s : s + len(p.tags)]) for p, s in zip(pages, starts)]


def extracted(pages: DataFrame, trees: Trees) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html).

    Null and empty html give an empty text. White space of any kind within a block becomes one space, and so does a block's
    or line break's edge. Repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    sent = pages.sparkSession.sparkContext.broadcast(trees)  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                texts = main_texts([x or "" for x in part.column(2).to_pylist()], sent.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return batched(pages).selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty html give an empty text; null page_id and url stay null; repeated rows stay; pages of any length are read
    whole, in time that grows with the length; an empty table gives no rows; other columns are ignored."""
    return extracted(table(spark, sf_dir, "pages"), train(spark))
