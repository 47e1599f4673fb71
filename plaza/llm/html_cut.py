"""Main text of HTML pages by minimum-cut labelling.

A page is split into text blocks (runs between block-level tags). A linear classifier over tags, class and id words, link density and
length gives each block a cost of being called content and a cost of being called boilerplate; these are its capacities to
the two terminals. Neighbouring blocks, and successive blocks of one parent element, are joined by smoothness edges that weaken with
their distance in the DOM, and weigh enough to turn a block that the classifier alone is not sure of. The minimum cut, found by
maximum flow, labels all blocks at once. Blocks whose own costs outweigh all their edges are fixed first, which leaves few for the flow.

The classifier is fitted (``fit``): pages of which a known text holds the longest block are labelled by that text, a block being
content if the text has it as a line. About ``sample`` such pages are used at most, chosen by a hash of page_id; logistic regression starts from the weights of
``prior`` and is drawn back to them, so features that the sample does not show keep them. Headlines are not learned from, as they may be
shortened. Without known texts the prior is the classifier.

Cases: a null or empty page has an empty text; broken markup is read like browsers do in the main (unclosed paragraphs and
items end at the next, stray end tags are ignored, an unclosed comment or script runs to the end); repeated rows are
extracted alike; a null page_id is kept and not learned from; an empty table gives an empty result; other columns are ignored. Very long
pages are handled by one row, and parsed in time linear in their tags (the flow over the few blocks that are not fixed first has no such bound).
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.llm.shared import staged

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object textarea title head canvas audio video select button".split())
OPAQUE = frozenset("script style textarea title iframe".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = frozenset("ul ol dl table tr tbody thead tfoot article section div nav main aside header footer form body".split())
BOILER_TAGS = {"nav": 4.5, "menu": 4.0, "footer": 4.5, "aside": 4.0, "form": 4.5, "header": 4.0, "dialog": 4.5, "search": 4.5, "fieldset": 3.0}
#: Class and id words that name a part outside of the article. Such a part inside an article does not count as in it.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr sidebar nav navbar navigation breadcrumb breadcrumbs comment comments disqus respond related recommended newsletter subscribe subscription signup contentinfo complementary dialog".split()
)
#: Words that parts of an article have too.
DOUBTFUL_WORDS = frozenset(
    "promotion banner notice notices alert popup modal overlay side menu footer header masthead reply replies share sharing social login search widget toolbar copyright legal disclaimer pagination pager tags skip".split()
)
CONTENT_WORDS = frozenset("article content post entry story body main text".split())
_WORDS = re.compile(r"[a-z]+")
Weights = dict[str, float]


def prior(feature: str) -> float:
    """The weight of a feature before any page is seen."""
    kind, _, value = feature.partition(":")
    if kind == "in":
        return 2.5 if value == "article" else -0.8 if value == "article-header" else -BOILER_TAGS[value]
    if kind == "word":
        return -5.5 if value in BOILER_WORDS else -1.2 if value in DOUBTFUL_WORDS else 0.8 if value in CONTENT_WORDS else 0.0
    if kind == "chars":
        return min(1.5, 0.35 * math.log(1 + 2 ** int(value) / 20))
    if kind == "links":
        return -0.75 * int(value)
    return {"bias": -0.5, "paragraph": 1.0, "heading": 0.8, "short": -0.7}[kind]


class Element:
    __slots__ = ("tag", "parent", "depth", "block", "jump", "marks", "outside", "hidden")

    def __init__(self, tag: str, parent: Element | None, attributes: str):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.block = self if tag in BLOCK or parent is None else parent.block
        # An ancestor at a distance that grows by doubling, by which a far one is found in few steps.
        far = parent.jump if parent else self
        self.jump = (far.jump if parent.depth - far.depth == far.depth - far.jump.depth else parent) if parent else self
        # Features that the element and its ancestors give to blocks, and whether one of them is outside of any article.
        self.marks, self.outside, self.hidden = (parent.marks, parent.outside, parent.hidden) if parent else (frozenset(["bias"]), False, False)
        new = set()
        if tag in RAW:
            self.hidden = True
        if tag in ("article", "main") and not self.outside:
            new.add("in:article")
        if tag in BOILER_TAGS:
            # The header of an article holds its title.
            new.add("in:article-header" if tag == "header" and "in:article" in self.marks else f"in:{tag}")
        if attributes and ("class" in attributes or "id" in attributes or "role" in attributes or "hidden" in attributes or "style" in attributes):
            found = {a.lower(): b or c or d or "" for a, b, c, d in _ATTRIBUTE.findall(attributes)}
            if tag not in ("article", "main", "body", "html"):
                for k in ("class", "id", "role"):
                    if k in found:
                        new.update("word:" + w for w in _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", found[k]).lower()))
            if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
                self.hidden = True
        if new:
            self.marks |= new
            if any(x[5:] in BOILER_WORDS if x[:5] == "word:" else x[3:] in BOILER_TAGS for x in new):
                self.outside = True
                self.marks -= {"in:article"}


class Block:
    __slots__ = ("text", "element", "links")

    def __init__(self, text: str, element: Element, links: int):
        self.text, self.element, self.links = text, element, links


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, without scripts, styles and other hidden elements.

    Elements may be nested to any depth: where each tag is open is kept by tag, so that no lookup walks the ancestors.
    """
    stack, out, held, links, at = [Element("html", None, "")], [], [], 0, 0
    opened: dict[str, list[int]] = {}
    bounds: list[int] = []

    def push(tag: str, attributes: str) -> None:
        opened.setdefault(tag, []).append(len(stack))
        if tag in BOUNDS:
            bounds.append(len(stack))
        stack.append(Element(tag, stack[-1], attributes))

    def cut(k: int) -> None:
        while len(stack) > k:
            tag = stack.pop().tag
            opened[tag].pop()
            if tag in BOUNDS:
                bounds.pop()

    def flush() -> None:
        nonlocal links
        text = " ".join(unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(Block(text, stack[-1].block, min(links, len(text))))
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw and not stack[-1].hidden:
            held.append(raw)
            if opened.get("a"):
                links += len(raw.strip())

    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        slash, tag, attributes = m[1] or m[4], m[2] or m[5], m[3] or m[6] or ""
        if tag is None:
            continue
        tag = tag.lower()
        if slash:
            if tag in BLOCK:
                flush()
            if opened.get(tag):
                cut(opened[tag][-1])
            continue
        if tag in BLOCK:
            flush()
            last = max((opened[x][-1] for x in CLOSES.get(tag, {"p"}) if opened.get(x)), default=0)
            if last and last >= (bounds[-1] if bounds else 0):
                cut(last)
        if tag == "body" and opened.get("head"):
            cut(opened["head"][0])
        if tag in VOID:
            if tag == "br" or tag == "hr":
                add(" ")
            continue
        if attributes.endswith("/") and tag not in BLOCK and tag != "a":
            continue
        push(tag, attributes)
        if tag in OPAQUE:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            cut(len(stack) - 1)
    flush()
    return out


def features(b: Block) -> list[str]:
    """The features of a block."""
    tag, out = b.element.tag, list(b.element.marks)
    out.append(f"chars:{min(12, len(b.text).bit_length())}")
    if b.links:
        out.append(f"links:{math.ceil(4 * b.links / len(b.text))}")
    if tag in ("p", "pre", "blockquote"):
        out.append("paragraph")
    elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        out.append("heading")
    elif tag in ("body", "html", "div", "td", "section") and len(b.text) < 40:
        out.append("short")
    return out


class Classifier:
    """The log odds that a block is content."""

    def __init__(self, weights: Weights | None = None):
        self.weights = dict(weights or {})

    def __call__(self, b: Block) -> float:
        total = 0.0
        for f in features(b):
            w = self.weights.get(f)
            if w is None:
                w = self.weights[f] = prior(f)
            total += w
        if len(self.weights) > 100_000:
            self.weights = {f: w for f, w in self.weights.items() if w != prior(f)}
        return total


def _distance(a: Element, b: Element) -> int:
    total = a.depth + b.depth
    if a.depth < b.depth:
        a, b = b, a
    while a.depth > b.depth:
        a = a.jump if a.jump.depth >= b.depth else a.parent
    while a is not b:
        a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.parent, b.parent)
    return total - 2 * a.depth


def smoothness(found: list[Block]) -> dict[tuple[int, int], float]:
    """Edges between neighbouring blocks and between successive blocks of one parent."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[Element, int] = {}
    for k, b in enumerate(found):
        if k:
            edges[k - 1, k] = 1.2 / (1 + _distance(found[k - 1].element, b.element))
        parent = b.element.parent or b.element
        if parent in last:
            edges[last[parent], k] = edges.get((last[parent], k), 0.0) + 0.2
        last[parent] = k
    return edges


def min_cut(content: list[float], boiler: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels (content?) of least total cost: ``content[i]`` or ``boiler[i]``, plus the edges between different labels."""
    n = len(content)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    gain, label = [b - c for c, b in zip(content, boiler, strict=True)], [None] * n
    pull = [sum(x.values()) for x in near]
    todo = deque(range(n))
    while todo:  # fix the blocks that no labelling of their neighbours can turn
        i = todo.popleft()
        if label[i] is None and abs(gain[i]) > pull[i]:
            label[i] = gain[i] > 0
            for j, w in near[i].items():
                if label[j] is None:
                    gain[j] += w if label[i] else -w
                    pull[j] -= w
                    todo.append(j)
    free = [i for i in range(n) if label[i] is None]
    if not free:
        return label
    # Source: content; sink: boilerplate. A block on the source side pays its edge to the sink, which is the cost of content.
    s, t = n, n + 1
    cap: dict[int, dict[int, float]] = {i: {j: w for j, w in near[i].items() if label[j] is None} for i in free}
    cap[s], cap[t] = {}, {}
    for i in free:
        if gain[i] > 0:
            cap[s][i], cap[i][s] = gain[i], 0.0
        elif gain[i] < 0:
            cap[i][t], cap[t][i] = -gain[i], 0.0
    while True:
        back, queue = {s: s}, deque([s])
        while queue and t not in back:
            u = queue.popleft()
            for v, w in cap[u].items():
                if w > 1e-12 and v not in back:
                    back[v] = u
                    queue.append(v)
        if t not in back:
            break
        path, v = [], t
        while v != s:
            path.append((back[v], v))
            v = back[v]
        flow = min(cap[u][v] for u, v in path)
        for u, v in path:
            cap[u][v] -= flow
            cap[v][u] += flow
    for i in free:
        label[i] = i in back
    return label


def labelled_blocks(page: str | None, score: Classifier | None = None) -> list[tuple[str, float, bool]]:
    """(text, classifier score, label) of each block of a page."""
    found = blocks(page or "")
    scores = list(map(score or Classifier(), found))
    label = min_cut([max(0.0, -x) for x in scores], [max(0.0, x) for x in scores], smoothness(found))
    return [(b.text, x, y) for b, x, y in zip(found, scores, label, strict=True)]


def main_text(page: str | None, score: Classifier | None = None) -> str:
    return "\n".join(text for text, _, keep in labelled_blocks(page, score) if keep)


def _line_key(line: str) -> int:
    return xxhash.xxh64_intdigest(" ".join(line.split())) - (1 << 63)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, key) of each line of a known text that is not empty."""
    for b in batches:
        doc, key = [], []
        for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            mine = {_line_key(x) for x in text.split("\n") if x and not x.isspace()}
            doc += [d] * len(mine)
            key += mine
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(key, pa.int64())], names=["doc", "key"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, key, chars, features) of the blocks of pages, without headlines."""
    for b in batches:
        for lo in range(0, b.num_rows, 500):
            part, out = b.slice(lo, 500), []
            for page, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                out += [(page, _line_key(x.text), len(x.text), sorted(features(x))) for x in blocks(html) if x.element.tag not in ("h1", "h2", "h3", "h4", "h5", "h6")]
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "key", "chars", "features"])


def labelled_sample(pages: DataFrame, known: DataFrame, sample: int) -> DataFrame:
    """(features, content, n): how many blocks of about ``sample`` pages have which features and label."""
    pages = pages.where("page_id is not null and html is not null").select(F.col("page_id").cast("bigint").alias("page_id"), "html")
    share = F.lit(int((1 << 20) * min(1.0, sample / max(1, pages.count()))))
    held = staged(pages.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) < share).mapInArrow(_blocks, "page_id bigint, key bigint, chars bigint, features array<string>"), "blocks")
    texts = known.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    lines = lambda of: of.mapInArrow(_lines, "doc bigint, key bigint")
    # The text of a page is the first one that has the page's longest block as a line. There are as many such blocks and texts as pages in the sample, so lines
    # of all texts are compared as they are read, and only those of the texts found are read again.
    longest = staged(held.groupBy("page_id").agg(F.max_by("key", F.struct("chars", "key")).alias("key")), "longest")
    text = lines(texts).join(F.broadcast(longest.select("key").distinct()), "key", "left_semi").groupBy("key").agg(F.min("doc").alias("doc"))
    owner = staged(longest.join(text, "key").select("page_id", "doc"), "owners")
    own = lines(texts.join(F.broadcast(owner.select(F.col("doc").alias("doc_id")).distinct()), "doc_id", "left_semi")).withColumn("content", F.lit(1)).distinct()
    marked = held.join(owner, "page_id").join(own, ["doc", "key"], "left").withColumn("content", F.coalesce("content", F.lit(0)))
    return marked.groupBy("features", "content").agg(F.count("*").alias("n"))


def regress(rows: list[tuple[list[str], int, int]], spread: float = 0.5, rounds: int = 25) -> Weights:
    """Logistic regression by Newton's method over (features, label, count), with normal priors of deviation ``spread`` around ``prior``."""
    names = sorted({f for r in rows for f in r[0]})
    if not names:
        return {}
    at = {f: i for i, f in enumerate(names)}
    y, n = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    # Features of all rows one after another, and all pairs of features of a row.
    column, width = np.array([at[f] for r in rows for f in r[0]]), np.array([len(r[0]) for r in rows])
    row, ends = np.repeat(np.arange(len(rows)), width), np.cumsum(width)
    left, wide = np.repeat(column, width[row]), np.repeat(row, width[row])
    right = column[np.repeat(ends - width, width**2) + np.concatenate([np.tile(np.arange(k), k) for k in width])]
    pair, d = left * len(names) + right, len(names)
    start = np.array([prior(f) for f in names])
    w = start.copy()
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[column], len(rows)), -30, 30)))
        slope = np.bincount(column, (n * (y - q))[row], d) - (w - start) / spread**2
        curve = np.bincount(pair, (n * q * (1 - q))[wide], d * d).reshape(d, d) + np.eye(d) / spread**2
        step = np.linalg.solve(curve, slope)
        w += step / max(1.0, np.abs(step).max())
    return dict(zip(names, w.tolist(), strict=True))


def fit(pages: DataFrame, known: DataFrame, sample: int = 2000, least: int = 5, most: int = 2000) -> Weights:
    """Weights of a classifier from ``pages`` (page_id, html) of which ``known`` (doc_id, text) has the text.

    Features of fewer than ``least`` blocks of the sample, and all but the ``most`` frequent ones, keep their prior.
    """
    rows = labelled_sample(pages, known, sample).collect()  # different feature lists of the sample
    times: Counter = Counter()
    for r in rows:
        times.update(dict.fromkeys(r.features, r.n))
    kept = {f for f, n in sorted(times.items(), key=lambda x: (-x[1], x[0]))[:most] if n >= least}
    merged: Counter = Counter()
    for r in rows:
        merged[tuple(f for f in r.features if f in kept), r.content] += r.n
    return regress([(list(found), content, n) for (found, content), n in sorted(merged.items())])


def _extractor(weights: Weights):
    def extract_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Classifier(weights)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                text = [main_text(x, score) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return extract_batch


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html)."""
    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(_extractor(weights or {}), "page_id bigint, url string, text string, n_chars bigint")


def op5_html_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(pages, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


QUERIES = {"op5_html_cut": op5_html_cut}
