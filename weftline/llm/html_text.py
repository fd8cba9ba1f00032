"""Operator 10: main text of web pages by minimum cut.

A page is read into blocks of text. A linear classifier over what a block's text looks like
(length, links, sentence marks, kind, depth, place) gives log-odds of content; what the markup around it
says is added. The sum is the cost of calling the block content or boilerplate: the capacity to a
terminal. Blocks next to each other, and neighbours below one parent, are joined by smoothness
edges. The minimum cut, by maximum flow, separates content from boilerplate.

The classifier is fitted on a bounded sample of blocks (at most `fit_blocks`, from `fit_pages` pages)
that the markup labels by itself: those in an article or main element against those in navigation, footers, asides,
forms and the like. It does not see that markup. With too few labels fixed weights stand in.

Nulls and ties: null or empty html gives an empty text; a null page_id or url stays null; equal
pages are pages of their own; broken markup is read as far as it goes. An empty table gives none.
A very long page is read whole, by one task. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
SPACE = re.compile(r"\s+")

RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "object", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "nobr", "picture", "audio", "video", "map", "center", "math"}
HEAD = {"head", "select", "option", "button", "datalist", "optgroup", "legend"}

#: What markup says, in log-odds. Text alone counts for MOST at most either way, so that a name for boilerplate outweighs it.
TAG = {"nav": -14.0, "footer": -14.0, "aside": -14.0, "form": -14.0, "menu": -14.0, "dialog": -14.0, "fieldset": -14.0, "header": -7.0, "article": 4.0, "main": 3.0}
ROLE = {"navigation": -14.0, "banner": -14.0, "contentinfo": -14.0, "complementary": -14.0, "search": -14.0, "alert": -14.0, "dialog": -14.0, "alertdialog": -14.0, "main": 3.0, "article": 4.0}
ADVERT = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion".split())
OTHERS = frozenset("comment comments respond replies reply disqus discussion related recommended share sharing social newsletter subscribe subscription cookie cookies consent gdpr".split())
AWAY = ADVERT | OTHERS | frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer foot header masthead banner notice notices notification alert warning popup modal overlay signup pagination pager widget toolbar skip login search legal copyright tags rss".split())
HERE = frozenset("article content entry post story body text main".split())
AWAY_WEIGHT, HERE_WEIGHT, HIDDEN, MOST = -14.0, 2.0, -20.0, 4.0
#: Smoothness: next to each other below one parent, next to each other, next below one parent.
SIBLINGS, NEIGHBOURS, FAMILY = 1.2, 0.4, 0.8
KINDS = ("p", "h1", "h2", "h3", "li", "td", "div", "pre", "blockquote")
#: Weights of the classifier where there are too few labels: bias, log of the length, share of links, sentence marks, depth, place, one for each kind.
FALLBACK = np.array([-2.5, 0.6, -5.0, 1.0, 0.0, 0.0, 1.0, 1.0, 0.5, 0.5, -0.5, -0.3, 0.0, 1.0, 1.0])
MARKS = re.compile(r"[.!?;:,。！？、](?=\s|$)")


def features(text: str, linked: int, tag: str, depth: int, place: float) -> list[float]:
    """What the classifier sees of a block."""
    n = len(text)
    return [1.0, math.log1p(n), min(1.0, linked / n), min(1.0, 10 * len(MARKS.findall(text)) / n), min(depth, 20) / 10, place, *(float(tag == k) for k in KINDS)]


def fitted(x: np.ndarray, y: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; FALLBACK with fewer than 20 blocks of either label."""
    if min(y.sum(), len(y) - y.sum()) < 20:
        return FALLBACK
    w, balance = np.zeros(x.shape[1]), np.where(y, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (balance * (y - p)) - ridge * w
        step = np.linalg.solve((x * (balance * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def weight(tag: str, attributes: str, in_article: bool) -> float:
    """What an element's markup says of all blocks within."""
    out = TAG.get(tag, 0.0)
    if in_article and tag == "header":
        out = 0.0
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "role":
                out += ROLE.get(value.lower(), 0.0)
            elif name in ("class", "id"):
                words = {w.lower() for w in WORDS.findall(value)}
                # a word for content beside it makes most words harmless, and so does an article around it some
                away = words & (ADVERT | OTHERS if words & HERE else AWAY - {"header", "foot", "side", "tags"} if in_article else AWAY)
                if away and tag not in ("html", "body"):
                    out += AWAY_WEIGHT
                elif words & HERE:
                    out += HERE_WEIGHT
            elif hides(name, value):
                out += HIDDEN
    return out


def hides(name: str, value: str) -> bool:
    return name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value) is not None)


def dropped(attributes: str) -> bool:
    """Whether an element within a line is an advert or not shown."""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if hides(name, value) or (name in ("class", "id") and {w.lower() for w in WORDS.findall(value)} & ADVERT):
            return True
    return False


def blocks(page: str) -> list[tuple[str, list[float], float, int]]:
    """(text, features, log-odds of the markup, number of the parent element) of each block in page order."""
    out, parts, linked, link, formula = [], [], 0, 0, False
    stack = [("", 0.0, 0, False)]  # tag, what markup says, number, within an article
    number, at, end = 0, 0, len(page)
    lower, skip = None, None  # skip: an element within a line whose text goes, and how many of its name are open

    def text(piece: str) -> None:
        nonlocal linked
        if piece and skip is None:
            piece = entities.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if link:
                linked += len(piece)

    def flush() -> None:
        nonlocal linked, link
        if parts:
            t = SPACE.sub(" ", "".join(parts)).strip()
            if t:
                tag, said, _, _ = stack[-1]
                out.append((t, features(t, linked, tag, len(stack), at / end), said, stack[-2][2] if len(stack) > 1 else 0))
            parts.clear()
        linked = link = 0

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            at = end
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if tag in INLINE or formula:
            if tag == "a":
                link = 0 if closing else 1
            elif tag == "math":
                formula = not closing
            if skip and tag == skip[0]:
                skip = (tag, skip[1] + (-1 if closing else 1))
                skip = skip if skip[1] else None
            elif not skip and not closing and attributes and tag in INLINE and dropped(attributes):
                skip = (tag, 1)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in ("img", "wbr"):
            continue
        if tag in RAW and not closing:
            if lower is None:
                lower = page.lower()
            stop = lower.find(f"</{tag}", at)
            at = end if stop < 0 else stop
            continue
        skip = None
        flush()
        if tag in VOID or tag in RAW:
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if stack[-1][0] == "p" or (tag in ("li", "dt", "dd", "td", "th", "tr", "option") and stack[-1][0] == tag):
            stack.pop()
        elif tag == "body" and stack[-1][0] == "head":
            stack.pop()
        number += 1
        _, said, _, inside = stack[-1]
        said += HIDDEN if tag in HEAD else weight(tag, attributes, inside)
        if not attributes.endswith("/") or tag in ("p", "div"):
            stack.append((tag, said, number, inside or tag == "article"))
    flush()
    return out


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling with the least cost: a score's size for a label against it, an edge's weight for ends that differ.

    A block whose score is at least the sum of its edges takes its own side in some minimum
    cut; it is taken first, and its edges become capacities of its neighbours. Maximum flow
    decides the others.
    """
    n = len(scores)
    sure = [abs(s) for s in scores]
    for a, b, w in edges:
        sure[a] -= w
        sure[b] -= w
    label: list = [s > 0 if d >= 0 else None for s, d in zip(scores, sure)]
    open_ = [i for i in range(n) if label[i] is None]
    if not open_:
        return label
    node = {i: j + 2 for j, i in enumerate(open_)}
    own = {i: scores[i] for i in open_}
    graph: list[dict] = [{} for _ in range(len(open_) + 2)]

    def add(u, v, c, back):
        graph[u][v] = graph[u].get(v, 0.0) + c
        graph[v][u] = graph[v].get(u, 0.0) + back

    for a, b, w in edges:
        if a in node and b in node:
            add(node[a], node[b], w, w)
        elif a in node:
            own[a] += w if label[b] else -w
        elif b in node:
            own[b] += w if label[a] else -w
    for i, s in own.items():
        if s > 0:
            add(0, node[i], s, 0.0)
        elif s < 0:
            add(node[i], 1, -s, 0.0)
    while True:
        before, queue = {0: 0}, deque([0])
        while queue and 1 not in before:
            u = queue.popleft()
            for v, c in graph[u].items():
                if c > 1e-9 and v not in before:
                    before[v] = u
                    queue.append(v)
        if 1 not in before:
            break
        path, v = [], 1
        while v:
            path.append((before[v], v))
            v = before[v]
        flow = min(graph[u][v] for u, v in path)
        for u, v in path:
            graph[u][v] -= flow
            graph[v][u] += flow
    for i in open_:
        label[i] = node[i] in before
    return label


def scores(found: list, model: np.ndarray) -> list[float]:
    """The capacity of each block: positive for content."""
    if not found:
        return []
    x = np.array([f for _, f, _, _ in found])
    return (np.clip(x @ model, -MOST, MOST) + np.array([said for _, _, said, _ in found])).tolist()


def smoothness(found: list) -> list[tuple[int, int, float]]:
    edges, last = [], {}
    for i, (*_, parent) in enumerate(found):
        if i:
            edges.append((i - 1, i, SIBLINGS if found[i - 1][3] == parent else NEIGHBOURS))
        j = last.get(parent)
        if j is not None and j < i - 1:
            edges.append((j, i, FAMILY))
        last[parent] = i
    return edges


def main_text(page: str | None, model: np.ndarray = FALLBACK) -> str:
    """The content blocks of a page, joined by empty lines."""
    found = blocks(page) if page else []
    keep = minimum_cut(scores(found, model), smoothness(found))
    return "\n\n".join(t for (t, *_), k in zip(found, keep) if k)


def classifier(pages: DataFrame, fit_pages: int, fit_blocks: int) -> np.ndarray:
    """Weights from the blocks of a bounded sample that markup labels."""

    def run(batches):
        for b in batches:
            rows = [(f, said > 0) for h in b.column(0).to_pylist() if h for _, f, said, _ in blocks(h) if said >= TAG["main"] or said <= AWAY_WEIGHT]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows], pa.list_(pa.float64())), pa.array([y for _, y in rows], pa.bool_())], ["x", "y"])

    drawn = pages.select("html", F.xxhash64("html", F.lit("fit")).alias("h")).orderBy("h").limit(fit_pages).select("html")
    found = drawn.mapInArrow(run, "x array<double>, y boolean").limit(fit_blocks).toPandas()
    return fitted(np.array(found["x"].tolist(), float).reshape(len(found), -1), found["y"].to_numpy(bool)) if len(found) else FALLBACK


def extracted(pages: DataFrame, fit_pages: int = 256, fit_blocks: int = 20_000) -> DataFrame:
    """page_id, url, text, n_chars."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    model = classifier(rows, fit_pages, fit_blocks)

    def run(batches):
        for b in batches:
            texts = [main_text(h, model) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
