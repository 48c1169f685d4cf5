"""Main text of web pages by a minimum cut.

A page becomes a row of text blocks. A logistic classifier gives each block a cost of being called boilerplate and one
of being called content: the capacities of its edges to the two terminals. Blocks that follow each other, and blocks
under the same parent, are tied by smoothness edges. The maximum flow's cut is the cheapest labelling.

The classifier is trained here, on a bounded sample of pages whose own markup says which blocks are the article
(`article`, `main` or the like), starting from and held near fixed weights, which count alone where no page says so. The
weight of that markup itself is fixed, and isn't among the features that are fitted to it."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import pick, table

#: Pages that the classifier is fitted on at most, those with the smallest hashes.
SAMPLE_PAGES = 400
#: Of the sample's pages, only those up to this many characters are fitted on, so that the driver's memory is bounded.
SAMPLE_CHARS = 100_000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">]|['\"](?=[^'\">]*>))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")
# Elements whose text is never shown, or belongs to the page's controls.
RAW = frozenset("script style noscript template iframe textarea title noembed noframes".split())
CONTROLS = frozenset("form button select option input fieldset svg canvas object audio video map dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
# Elements that end an open paragraph.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# What elements, classes, ids and roles say about the blocks in them.
ARTICLE = frozenset("article main".split())
ASIDE = frozenset("nav footer aside header menu head".split())
GOOD_WORDS = frozenset("article body content entry main post story text".split())
BAD_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus foot footer "
    "gdpr header legal login masthead menu meta modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination popup privacy promo promotion "
    "recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags taboola teaser toolbar widget".split()
)
WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    linked: int  # characters within links
    tag: str
    parent: int  # number of the element that holds the block
    above: int  # number of the element that holds that
    good: bool
    bad: bool
    inside: bool  # an article or the like


def _said(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element's name, class, id or role speaks for content, or for boilerplate."""
    good, bad = tag in ARTICLE, tag in ASIDE
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name = m[1].lower()
            if name in ("class", "id", "role"):
                said = set(WORD.findall((m[2] or m[3] or m[4] or "").lower()))
                good |= bool(said & GOOD_WORDS)
                bad |= bool(said & BAD_WORDS)
                if name == "role":
                    bad |= bool(said & {"navigation", "banner", "contentinfo", "complementary", "search", "dialog"})
            elif name == "hidden" or (name == "aria-hidden" and (m[2] or m[3] or m[4]) == "true"):
                bad = True
    return good, bad


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order. Text of scripts, styles and controls is not in any; unclosed elements end
    with what holds them, and an end tag without a start counts for nothing."""
    out: list[Block] = []
    # name, number, good, bad, hidden, inside an article, place of the nearest element that isn't inline
    stack: list[tuple[str, int, bool, bool, bool, bool, int]] = [("", 0, False, False, False, False, 0)]
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = number = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                top = stack[-1]
                own = stack[top[6]]
                above = stack[stack[top[6] - 1][6]] if top[6] else own
                out.append(Block(text, min(linked, len(text)), own[0], own[1], above[1], top[2], top[3], top[5]))
            parts.clear()
        linked = 0

    def pop(to: int) -> None:
        while len(stack) > to:
            opened[stack.pop()[0]] -= 1

    n = len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not stack[-1][4]:
            parts.append(page[at:lt])
            if opened.get("a"):
                linked += lt - at
        if lt == n:
            break
        m = TOKEN.match(page, lt)
        if not m:
            if not stack[-1][4]:
                parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA[") and not stack[-1][4]:
                parts.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if m[1]:  # an end
            if tag not in INLINE:
                flush()
            if opened.get(tag):
                depth = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag)
                if tag not in INLINE or depth > stack[-1][6]:  # the end of inline elements doesn't end blocks
                    pop(depth)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "xmp":  # its text is shown as it stands
            end = re.compile(r"</xmp\s*>", re.I).search(page, at)
            flush()
            if not stack[-1][4]:
                parts.append(entities.escape(page[at : end.start() if end else n]))
            at = end.end() if end else n
            flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            flush()
            continue
        if tag not in INLINE:
            flush()
            holder = stack[-1][6]
            name = stack[holder][0]
            if (name == "p" and tag in CLOSES_P) or (tag == name and tag in ("li", "tr", "td", "th", "option")) or (tag in ("dt", "dd") and name in ("dt", "dd")):
                pop(holder)
            pop(stack[-1][6] + 1)  # formatting that was left open ends with its block
        if tag in VOID or (tag in CONTROLS and m[3].rstrip().endswith("/")):
            continue
        number += 1
        good, bad = _said(tag, m[3])
        top = stack[-1]
        bad = bad and not (tag == "header" and top[5] and not m[3].strip())  # an article's own header holds its title
        stack.append((tag, number, good or top[2], bad or top[3], top[4] or tag in CONTROLS, top[5] or tag in ARTICLE, top[6] if tag in INLINE else len(stack)))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


FEATURES = ("one", "good", "bad", "inside", "links", "words", "long", "sentence", "heading", "item", "start", "end", "copyright")
# The weights that the fit starts from.
PRIOR = np.array([0.2, 1.5, -4.0, 3.0, -3.0, 0.8, 0.5, 1.0, 0.3, -0.5, -0.2, -0.3, -1.5])
ENDS = re.compile(r"[.!?…。！？](?:\s|$)")
COPYRIGHT = re.compile(r"©|\(c\)|all rights reserved", re.I)


def features(page: list[Block]) -> np.ndarray:
    n = len(page)
    out = np.zeros((n, len(FEATURES)))
    for i, b in enumerate(page):
        size = len(b.text)
        spaces = b.text.count(" ")
        out[i] = (
            1, b.good, b.bad, b.inside and not b.bad, b.linked / size, min(spaces, 40) / 20, size > 200, bool(ENDS.search(b.text)),
            len(b.tag) == 2 and b.tag[0] == "h" and b.tag[1].isdigit(), b.tag in ("li", "td", "th", "dt", "dd"), i == 0 and n > 1, i == n - 1 and n > 1, size < 400 and bool(COPYRIGHT.search(b.text)),
        )
    return out


#: Place of the feature that says what the labels of the fit say: its weight stays.
INSIDE = FEATURES.index("inside")


def fit(pages: list[str], prior: np.ndarray = PRIOR, strength: float = 5.0, steps: int = 30) -> np.ndarray:
    """Weights by Newton's method on pages with an article of their own; normal around the prior. Whether a block is inside
    the article is what is fitted, by all other features."""
    xs, ys = [], []
    for page in pages:
        found = blocks(page)
        if any(b.inside for b in found) and not all(b.inside for b in found):
            xs.append(features(found))
            ys += [float(b.inside and not b.bad) for b in found]
    if not xs:
        return prior
    others = np.arange(len(FEATURES)) != INSIDE
    x, y, before, w = np.concatenate(xs)[:, others], np.array(ys), prior[others], prior[others]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - strength * (w - before))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    out = prior.copy()
    out[others] = w
    return out


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling (True: content) of least cost. gain[i] is the log odds of content: if positive, calling i
    boilerplate costs it, else calling it content costs its opposite; an edge costs its capacity where labels differ.

    A block whose gain outweighs all its edges has its label in every cheapest labelling; its edges then count for its
    neighbours' gains, which may settle these. What is left falls into parts, each labelled by its maximum flow."""
    near: list[list[tuple[int, float]]] = [[] for _ in gain]
    for a, b, c in edges:
        near[a].append((b, c))
        near[b].append((a, c))
    gain, pull = list(gain), [sum(c for _, c in x) for x in near]
    label: list[bool | None] = [None] * len(gain)
    todo = [i for i, g in enumerate(gain) if abs(g) > pull[i] or not near[i]]
    while todo:
        i = todo.pop()
        if label[i] is not None:
            continue
        label[i] = gain[i] > 0
        for j, c in near[i]:
            if label[j] is None:
                gain[j] += c if label[i] else -c
                pull[j] -= c
                if abs(gain[j]) > pull[j] + 1e-12:
                    todo.append(j)
    for i in range(len(gain)):
        if label[i] is None:
            part, seen = [i], {i: 0}
            for v in part:
                for u, _ in near[v]:
                    if label[u] is None and u not in seen:
                        seen[u] = len(part)
                        part.append(u)
            inner = [(seen[v], seen[u], c) for v in part for u, c in near[v] if u in seen and seen[v] < seen[u]]
            for v, k in zip(part, _flow([gain[v] for v in part], inner)):
                label[v] = k
    return [bool(x) for x in label]


def _flow(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The same by maximum flow: in each phase, distances to the sink from one search, then flows along all shortest paths
    until none is left."""
    n, tiny = len(gain), 1e-9
    near: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    cap: list[float] = []
    for a, b, c in edges:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += [b, a]
        cap += [c, c]
    source = [max(0.0, g) for g in gain]
    sink = [max(0.0, -g) for g in gain]
    while True:
        far = [-1] * n
        queue = [i for i in range(n) if sink[i] > tiny]
        for i in queue:
            far[i] = 0
        for v in queue:
            for e in near[v]:
                u = to[e]
                if far[u] < 0 and cap[e ^ 1] > tiny:
                    far[u] = far[v] + 1
                    queue.append(u)
        starts = [i for i in range(n) if source[i] > tiny and far[i] >= 0]
        if not starts:
            break
        at = [0] * n
        for s in starts:
            path: list[int] = []
            v = s
            while source[s] > tiny:
                if sink[v] > tiny and far[v] == 0:
                    flow = min([source[s], sink[v], *(cap[e] for e in path)])
                    source[s] -= flow
                    sink[v] -= flow
                    for e in path:
                        cap[e] -= flow
                        cap[e ^ 1] += flow
                    path, v = [], s
                    continue
                while at[v] < len(near[v]):
                    e = near[v][at[v]]
                    if cap[e] > tiny and far[to[e]] == far[v] - 1 >= 0:
                        break
                    at[v] += 1
                if at[v] < len(near[v]):
                    path.append(near[v][at[v]])
                    v = to[path[-1]]
                elif path:
                    v = to[path.pop() ^ 1]
                    at[v] += 1
                else:
                    break
    # content: what the source still reaches
    came = [x > tiny for x in source]
    queue = [i for i in range(n) if came[i]]
    for v in queue:
        for e in near[v]:
            if cap[e] > tiny and not came[to[e]]:
                came[to[e]] = True
                queue.append(to[e])
    return came


def edges(page: list[Block], gain: list[float], follow: float = 0.3, sibling: float = 0.7, certain: float = 3.0) -> list[tuple[int, int, float]]:
    """Blocks that follow each other, more strongly under the same element; and each block with the one before of its tag
    under the same holder, also if others stand between. A block that is certain by itself has no edge to one of
    another parent on the other side, and the less alike the shares of links of two blocks are, the weaker is their
    edge: adverts say nothing about the paragraphs they stand between."""
    out, last = [], {}

    def alike(i: int, j: int) -> float:
        shares = [page[k].linked / max(len(page[k].text), 1) for k in (i, j)]
        return max(0.0, 1.0 - abs(shares[0] - shares[1]))

    def apart(i: int, j: int) -> bool:
        return page[i].parent != page[j].parent and gain[i] * gain[j] < 0 and max(abs(gain[i]), abs(gain[j])) >= certain

    for i, b in enumerate(page):
        if i and not apart(i - 1, i):
            p = page[i - 1]
            out.append((i - 1, i, alike(i - 1, i) * (follow + (sibling if b.parent == p.parent or b.above == p.above else 0.0))))
        j = last.get((b.above, b.tag))
        if j is not None and j != i - 1 and not apart(j, i):
            out.append((j, i, alike(j, i) * sibling / 2))
        last[b.above, b.tag] = i
    return out


def extract(page: str, weights: np.ndarray = PRIOR) -> tuple[str, int]:
    """The main text of a page and its number of blocks."""
    found = blocks(page)
    if not found:
        return "", 0
    gain = features(found) @ weights
    keep = (gain > 0).tolist() if (gain > 0).all() or (gain <= 0).all() else min_cut(gain.tolist(), edges(found, gain.tolist()))
    kept = [b.text for b, k in zip(found, keep) if k]
    return "\n".join(kept), len(kept)


def sample(pages: DataFrame, html: str = "html", n: int = SAMPLE_PAGES) -> list[str]:
    """The n distinct pages with the smallest hashes: first their hashes alone, then the pages."""
    chosen = pick(pages, html=html).filter(F.char_length("html") <= SAMPLE_CHARS).withColumn("h", F.xxhash64("html"))
    least = [r.h for r in chosen.select("h").distinct().orderBy("h").limit(n).collect()]
    if not least:
        return []
    return sorted(r.html for r in chosen.filter(F.col("h") <= least[-1]).dropDuplicates(["h"]).select("html").collect())


def main_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", weights: np.ndarray | None = None, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text, n_blocks for each row of pages.

    text: the blocks called content, in page order, joined by one newline; character references are decoded, white space
    within a block is one space. It is empty for a null or empty page and for one without content. Repeated rows are
    extracted each; no rows give no rows; other columns don't matter. weights: of the classifier, fitted on
    sample_pages pages if not given."""
    weights = fit(sample(pages, html, sample_pages)) if weights is None else weights

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                got = [extract(p or "", weights) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64())], ["page_id", "url", "text", "n_blocks"])

    read = pick(pages, page_id=page_id, url=url, html=html)
    types = {f.name: f.dataType.simpleString() for f in read.schema.fields}
    return read.mapInArrow(scan, f"page_id {types['page_id']}, url {types['url']}, text string, n_blocks long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
