"""Main text of web pages: gradient-boosted trees over the nodes of a page, and a decoding that leaves no node in where one around it is out.

A page becomes a tree (``dom``). A node's features are those of itself, of its subtree (text, density of elements, share of links and marks), of the
words of its attributes and of those around it, of its depth, and of its siblings. The trees, which ask the same question on a level (oblivious trees),
give the probability that a node holds main text. The decoding maximises the product of all nodes' probabilities over the choices in which whatever
is out takes its subtree along; one pass up and one down the tree find it. Text directly inside a node that stays is main text.

The tables have no labelled nodes, so the trees are trained on ``PAGES`` made-up pages (``page_maker``) that differ in layout and naming.

A null or empty page gives an empty text. Pages are read whole, however long or damaged. Repeated rows are extracted each, an empty table gives an
empty result. Columns other than the named ones are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, lean, texts, trimmed
from .dom import BREAK, Page, joined, parse
from .page_maker import made_page

#: Made-up pages that the trees are trained on, and trees, questions a tree, bins a feature, and every how manieth feature a tree may ask of.
PAGES, TREES, DEPTH, BINS, EVERY = 1000, 90, 5, 32, 4
RATE, RIDGE = 0.25, 4.0
BLOCK_BYTES = 1 << 20
MEMO_LIMIT = 1 << 14

#: Words of attributes by what they tell; a word counts for a group if it equals or begins with one of these.
GROUPS = {
    "main": "article content main body post entry story text prose copy".split(),
    "nav": "nav topnav menu breadcrumb tab tabs pagination pager toc".split(),
    "header": "header masthead topbar top branding logo site".split(),
    "footer": "footer colophon bottom copyright legal imprint".split(),
    "side": "side sidebar aside widget rail related recommend trending popular most read more".split(),
    "ad": "ad ads advert sponsor promo banner affiliate dfp".split(),
    "notice": "cookie consent gdpr notice alert popup modal overlay newsletter subscri paywall privacy warning".split(),
    "comment": "comment repl discuss disqus respon feedback".split(),
    "form": "form search login signup register contact".split(),
    "share": "share sharing social follow tweet".split(),
    "hidden": ["hidden"],
}
WHOLE = frozenset("ad ads tab tabs top read more most side site text body copy toc dfp".split())
WORDS = re.compile("[A-Z]?[a-z]+|[A-Z]+")
TAGS = {
    "paragraph": ("p", "pre", "blockquote"),
    "heading": ("h1", "h2", "h3", "h4", "h5", "h6"),
    "item": ("li", "dt", "dd"),
    "list": ("ul", "ol", "dl", "menu"),
    "cell": ("td", "th", "tr", "table", "tbody", "thead", "tfoot", "caption"),
    "block": ("div", "section", "center"),
    "article": ("article",),
    "main": ("main",),
    "nav": ("nav",),
    "header": ("header", "hgroup"),
    "footer": ("footer",),
    "aside": ("aside",),
    "form": ("form", "fieldset", "button", "label", "dialog"),
    "figure": ("figure", "figcaption", "details", "summary"),
    "root": ("#page", "html", "body"),
}
TAG_CODE = {t: i for i, names in enumerate(TAGS.values()) for t in names}
N_TAGS, N_GROUPS = len(TAGS) + 1, len(GROUPS)
#: Tags that tell something of all that they contain.
TELLING = [list(TAGS).index(x) for x in ("article", "main", "nav", "header", "footer", "aside", "form", "item", "figure")]


def groups_of(attributes: str) -> int:
    """A bit for each group that a word of the attributes belongs to."""
    bits = 0
    for word in WORDS.findall(attributes):
        w = word.lower()
        for i, stems in enumerate(GROUPS.values()):
            if any(w == s if s in WHOLE else w.startswith(s) for s in stems):
                bits |= 1 << i
    return bits


class Memo(dict):
    def __missing__(self, attributes: str) -> int:
        if len(self) >= MEMO_LIMIT:
            self.clear()
        bits = self[attributes] = groups_of(attributes)
        return bits


def features(pages: list[Page], memo: Memo) -> np.ndarray:
    """A column for each node of the pages, in their order; rows are features."""
    sizes = np.array([len(p.tags) for p in pages])
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)
    n = int(sizes.sum())
    parent = np.concatenate([np.array(p.parents) for p in pages]) + base
    first = parent < base
    parent[first] = np.flatnonzero(first)  # pages are their own parents here
    end = np.concatenate([np.array(p.ends) for p in pages]) + base
    depth = np.concatenate([np.array(p.depths) for p in pages])
    tag = np.array([TAG_CODE.get(t, N_TAGS - 1) for p in pages for t in p.tags])
    bits = np.array([memo[a] if a else 0 for p in pages for a in p.attributes])
    named = np.array([bool(a) for p in pages for a in p.attributes])
    own = np.zeros((7, n))  # characters, words, characters in links, stops and commas, pieces, links, fields and buttons
    at = 0
    for p, size in zip(pages, sizes, strict=True):
        where, chars, words, linked, stops = [], [], [], [], []
        for node, part, link in p.pieces:
            if node != BREAK:
                w = len(part.split())
                if w:
                    where.append(node + at)
                    chars.append(len(part))
                    words.append(w)
                    linked.append(len(part) if link else 0)
                    stops.append(part.count(".") + part.count(",") + part.count("!") + part.count("?"))
        for k, x in enumerate((chars, words, linked, stops, [1] * len(where))):
            np.add.at(own[k], where, x)
        for node, kind in p.marks:
            own[5 if kind == "a" else 6, node + at] += 1
        at += size
    upto = np.concatenate([np.zeros((7, 1)), np.cumsum(own, axis=1)], axis=1)
    nodes = np.arange(n)
    chars, words, linked, stops, pieces, links, fields = upto[:, end] - upto[:, nodes]
    below = end - nodes
    total = upto[0, base + np.repeat(sizes, sizes)] - upto[0, base]
    before = upto[0, nodes] - upto[0, base]
    order = np.lexsort((nodes, parent))
    order = order[~first[order]]
    starts = np.flatnonzero(np.r_[True, np.diff(parent[order]) > 0]) if len(order) else np.empty(0, int)
    count, index = np.ones(n), np.zeros(n)
    if len(order):
        runs = np.diff(np.r_[starts, len(order)])
        count[order] = np.repeat(runs, runs)
        index[order] = np.arange(len(order)) - np.repeat(starts, runs)
    with_text = np.zeros(n)
    np.add.at(with_text, parent[~first], chars[~first] > 0)
    brothers = np.maximum(count - 1, 1)
    ratio = lambda a, b: a / np.maximum(b, 1)
    log = np.log1p
    previous = np.zeros(n, int)
    if len(order):
        previous[order] = np.r_[order[0], order[:-1]]
        previous[order[starts]] = order[starts]
    rows = [
        log(chars), log(words), ratio(chars, words), ratio(linked, chars), ratio(stops, words), ratio(chars, below), ratio(words, pieces), log(below), depth,
        ratio(chars, total), ratio(before, total), 1 - ratio(before + chars, total), index, ratio(index, brothers), count, ratio(chars, chars[parent]),
        log((chars[parent] - chars) / brothers), ratio(linked[parent] - linked, chars[parent] - chars), ratio(stops[parent] - stops, words[parent] - words),
        log(own[0]), ratio(own[0], chars), links, ratio(links, words), fields, fields[parent], with_text, chars[previous] - chars, tag[previous] == tag, named,
        log(chars[parent]), ratio(linked[parent], chars[parent]), named[parent],
    ]
    around = np.zeros((N_GROUPS + len(TELLING), n), np.int32)  # how many of those around a node tell what
    mine = np.concatenate([(bits >> np.arange(N_GROUPS)[:, None]) & 1, np.stack([tag == t for t in TELLING])]).astype(np.int32)
    for level in range(1, int(depth.max(initial=0)) + 1):
        here = np.flatnonzero(depth == level)
        around[:, here] = np.minimum(around[:, parent[here]] + mine[:, parent[here]], 3)
    inside = upto_any(mine, end)
    return np.concatenate([np.stack([np.asarray(r, np.float32) for r in rows]), np.stack([tag == t for t in range(N_TAGS)]), np.stack([tag[parent] == t for t in range(N_TAGS)]), mine, around, inside]).astype(np.float32)


def upto_any(mine: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many of a node's descendants tell what, as a share."""
    sums = np.concatenate([np.zeros((len(mine), 1)), np.cumsum(mine, axis=1)], axis=1)
    nodes = np.arange(len(end))
    return (sums[:, end] - sums[:, nodes + 1]) / np.maximum(end - nodes - 1, 1)


@dataclass
class Trees:
    """Oblivious trees: question k of a tree is column[k] > bound[k], and the answers' bits choose the leaf."""

    columns: np.ndarray
    bounds: np.ndarray
    leaves: np.ndarray
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(x.shape[1], self.start)
        for columns, bounds, leaves in zip(self.columns, self.bounds, self.leaves, strict=True):
            leaf = np.zeros(x.shape[1], np.int32)
            for k, (c, b) in enumerate(zip(columns, bounds, strict=True)):
                leaf |= (x[c] > b).astype(np.int32) << k
            out += leaves[leaf]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting of the logistic loss with second-order leaves; a tree's questions are chosen by histograms over quantile bins."""
    n = x.shape[1]
    bounds = [np.unique(np.quantile(r, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for r in x]
    binned = np.stack([np.searchsorted(b, r, side="left") for b, r in zip(bounds, x, strict=True)])  # > bounds[k] means bin > k
    rng = np.random.default_rng(5)
    several = np.flatnonzero([len(b) > 0 for b in bounds])
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(p0 / (1 - p0)))
    score = np.full(n, start)
    columns, cuts, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        grad, curve = y - p, p * (1 - p)
        leaf = np.zeros(n, np.int64)
        qc, qb = [], []
        some = rng.choice(several, max(1, len(several) // EVERY), replace=False)
        flat = binned[some] + (np.arange(len(some)) * BINS)[:, None]
        weights = [np.broadcast_to(w, flat.shape).ravel() for w in (grad, curve)]
        for level in range(DEPTH):
            wide = 1 << level
            at = (flat + leaf * (len(some) * BINS)).ravel()
            g, h = (np.bincount(at, w, wide * len(some) * BINS).reshape(wide, len(some), BINS).cumsum(axis=2) for w in weights)
            gain = sum((a * a / (b + RIDGE)).sum(axis=0) for a, b in ((g, h), (g[:, :, -1:] - g, h[:, :, -1:] - h)))
            for i, c in enumerate(some):
                gain[i, len(bounds[c]) :] = -1
            i, k = np.unravel_index(int(gain.argmax()), gain.shape)
            c = int(some[i])
            qc.append(c)
            qb.append(float(bounds[c][k]))
            leaf |= (binned[c] > k).astype(np.int64) << level
        up, down = np.bincount(leaf, grad, 1 << DEPTH), np.bincount(leaf, curve, 1 << DEPTH)
        value = RATE * up / (down + RIDGE)
        score += value[leaf]
        columns.append(qc)
        cuts.append(qb)
        values.append(value)
    return Trees(np.array(columns), np.array(cuts, np.float32), np.array(values), start)


def holds(page: Page, marked: list[bool]) -> np.ndarray:
    """Whether a node's subtree has a marked piece of text."""
    own = np.zeros(len(page.tags) + 1, int)
    for (node, part, _), m in zip(page.pieces, marked, strict=True):
        if node != BREAK and m and part.strip():
            own[node + 1] += 1
    upto = np.cumsum(own)
    return upto[page.ends] - upto[:-1] > 0


def labelled(seed: int) -> tuple[Page, np.ndarray]:
    """A made-up page and its nodes' labels: pieces are main text where they are next in the page's known text."""
    source, wanted = made_page(seed)
    page = parse(source)
    rest = "".join(wanted.split())
    at, marked = 0, []
    # A piece of main text continues the known text; those between are other parts, whose texts differ.
    for node, part, _ in page.pieces:
        bare = "".join(part.split()) if node != BREAK else ""
        hit = bool(bare) and rest.startswith(bare, at)
        at += len(bare) if hit else 0
        marked.append(hit)
    return page, holds(page, marked) if at == len(rest) else np.zeros(0, bool)


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, seed: int = 1_000_000) -> Trees:
    """The trees, trained on made-up pages; some seconds, once a process."""
    found = [(p, y) for p, y in (labelled(seed + i) for i in range(pages)) if len(y)]
    x = features([p for p, _ in found], Memo())
    y = np.concatenate([y for _, y in found]).astype(float)
    texty = x[0] > 0
    return boost(x[:, texty], y[texty])


def decode(page: Page, score: np.ndarray, texty: np.ndarray) -> list[bool]:
    """The likeliest choice in which no node is in below one that is out. score: log odds; nodes without text don't count."""
    gain = np.where(texty, score, 0.0).tolist()  # of being in rather than out, in log likelihood
    parents = page.parents
    for v in range(len(gain) - 1, 0, -1):
        if gain[v] > 0:
            gain[parents[v]] += gain[v]
    kept = [gain[0] >= 0]
    for v in range(1, len(gain)):
        kept.append(kept[parents[v]] and gain[v] >= 0)
    return kept


def extract(sources: list[str], trees: Trees, memo: Memo) -> list[str]:
    pages = [parse(s) for s in sources]
    if not pages:
        return []
    x = features(pages, memo)
    score, texty = trees.scores(x), x[0] > 0
    out, at = [], 0
    for p in pages:
        to = at + len(p.tags)
        out.append(joined(p, decode(p, score[at:to], texty[at:to])))
        at = to
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", trees: Trees | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points of the text), for every row."""
    lean(pages.sparkSession)
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    model = trees or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for block in blocks(batches, BLOCK_BYTES, "html"):
            found = extract([x.decode() for x in texts(block.column("html"))], model, memo)
            yield from pa.table([block.column("page_id"), block.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"]).to_batches()

    kinds = [source.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return source.mapInArrow(trimmed(run), f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
