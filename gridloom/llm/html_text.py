"""Main text of web pages by gradient-boosted trees over DOM nodes (operator 2).

A page becomes a tree of block elements. Each node has features of its tag, the tokens of its class,
id and role, its own and its ancestors' (menus, adverts, comments ...), text and link density of
its subtree, depth, siblings and place. Boosted trees (Spark ML), trained on nodes of a bounded
sample of pages (``max_pages``), give each node a probability of being article text. Training labels
come from pages whose markup names the article (article, main, role=main, itemprop=articleBody, or
a content class) and from elements that name what they are (nav, footer, form ...); every node
enters a second time with those names masked, so that pages that name nothing are decided by density
and place.

Decoding goes over the whole tree: a node is wholly article, wholly not, or mixed (its children
decide), and the assignment of greatest likelihood is found bottom-up. So nothing under a rejected
node is kept and nothing under an accepted one is rejected.

Defined results: null, empty and text-free html give an empty text; repeated rows are pages of
their own; unclosed and misplaced tags are closed as browsers do for block elements, in time linear in the page; extra columns
are ignored; with no page to train on, blocks outside menus and the like are kept.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, restored, small_batches

# Element names of the HTML standard by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template textarea select option button iframe svg math object canvas video audio datalist title".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
REACHED = frozenset("p h1 h2 h3 h4 h5 h6".split())
SEMANTIC = frozenset("article main nav header footer aside form menu dialog".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
# Words in class, id and role that say what an element is.
LEXICON = {
    "menu": "nav navbar menu breadcrumb breadcrumbs pagination pager toolbar tabs skip navigation toc",
    "frame": "header masthead footer foot copyright colophon banner topbar bottom legal credits",
    "side": "sidebar side aside rail widget related recommended recommend trending popular teaser more",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion dfp adsense",
    "notice": "cookie cookies consent notice alert popup modal overlay newsletter subscribe subscription gdpr paywall disclaimer",
    "talk": "comment comments reply replies disqus discussion respond reader reactions",
    "share": "share sharing social follow tags tag meta byline rating search login signup form",
    "content": "content article articlebody post entry story main text body page maincontent",
}
TOKEN_GROUP = {w: i for i, ws in enumerate(LEXICON.values()) for w in ws.split()}
N_GROUPS, CONTENT = len(LEXICON), len(LEXICON) - 1
TAG_KINDS = [frozenset(s.split()) for s in ("p pre blockquote", "h1 h2 h3 h4 h5 h6", "ul ol dl menu dir", "li dt dd", "table tbody thead tfoot tr td th", "div section center details", "article main", "nav menu", "header footer hgroup", "aside", "form fieldset legend", "figure figcaption")]

_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*+)|[!?/])")
_ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
_RAW_END = {t: re.compile(rf"</{t}\s*+>", re.I) for t in RAW}
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Page:
    """Block elements in document order and the runs of text directly in them."""

    tag: list[str]
    parent: list[int]
    groups: list[int]
    runs: list[tuple[int, str, int]]  # node, text, characters inside links


def _groups(attributes: str) -> int:
    bits = 0
    for m in _ATTR.finditer(attributes):
        for word in _TOKEN.findall(m[2] or m[3] or m[4] or ""):
            if (g := TOKEN_GROUP.get(word.lower())) is not None:
                bits |= 1 << g
    return bits


class Tags:
    """Tags and comments of a page from left to right, each character looked at a bounded number of times.

    A tag ends at the first > outside quotes. Once a quote is never closed, tags end at the first >.
    """

    def __init__(self, text: str) -> None:
        self.text, self.last, self.quotes = text, text.rfind(">"), True

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, is an end tag, name, attributes) of the next one; no name: a comment or declaration."""
        text = self.text
        while m := _OPEN.search(text, at):
            at = m.end()
            if m[1]:
                end = text.find("-->", at)
                return m.start(), len(text) if end < 0 else end + 3, False, "", ""
            if at > self.last:  # nothing ends a tag from here on
                continue
            end = at
            if m[3] and self.quotes:
                end = _ATTRIBUTES.match(text, at).end()
                self.quotes = text[end : end + 1] == ">"
            if not (m[3] and self.quotes):
                end = text.find(">", at)
            return m.start(), end + 1, bool(m[2]), (m[3] or "").lower(), text[at:end]
        return None


def parse(text: str) -> Page:
    page = Page(["html"], [-1], [0], [])
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements; the number of the block they are in
    places: dict[str, list[int]] = {}  # where in the stack a name is open
    blocks, walls = [0], [0]  # where blocks are open; those that a paragraph doesn't reach beyond
    hidden = links = linked = 0
    buffer: list[str] = []
    tags = Tags(text)

    def flush() -> None:
        nonlocal linked
        if buffer:
            if run := " ".join(_html.unescape("".join(buffer)).split()):
                page.runs.append((stack[-1][1], run, min(linked, len(run))))
            buffer.clear()
        linked = 0

    def latest(names: set[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def close(where: int) -> None:
        nonlocal hidden, links
        while len(stack) > where:
            name = stack.pop()[0]
            places[name].pop()
            hidden -= name in HIDDEN
            links -= name == "a"
        for open_blocks in (blocks, walls):
            while open_blocks[-1] >= where:
                open_blocks.pop()

    at, end = 0, len(text)
    while at < end:
        tag = tags.after(at)
        stop = tag[0] if tag else end
        if stop > at and not hidden:
            buffer.append(text[at:stop])
            linked += (stop - at) * (links > 0)
        if not tag:
            break
        _, at, ends, name, attributes = tag
        if not name:
            continue
        if ends:
            where = latest({name})
            if name == "p" and not where:
                flush()
            elif where and (name in BLOCK or blocks[-1] < where):
                if blocks[-1] >= where:
                    flush()
                close(where)
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name == "html" or (name == "body" and latest({"body"})):
            continue
        if name in BLOCK:
            flush()
            closing, until = CLOSES.get(name, ({"p"}, None))
            where = latest(closing)
            if where > (walls[-1] if until is None else latest(until)):
                close(where)
            page.tag.append(name)
            page.parent.append(stack[-1][1])
            page.groups.append(_groups(attributes))
            blocks.append(len(stack))
            if name not in REACHED:
                walls.append(len(stack))
            number = len(page.tag) - 1
        elif not attributes.endswith("/") or name in HIDDEN:
            number = stack[-1][1]
        else:
            continue
        places.setdefault(name, []).append(len(stack))
        stack.append((name, number))
        hidden += name in HIDDEN
        links += name == "a"
        if name in RAW:
            raw = _RAW_END[name].search(text, at)
            at = raw.start() if raw else end
    flush()
    return page


N_FEATURES = 2 * len(TAG_KINDS) + 2 * N_GROUPS + 17


def features(page: Page, masked: bool = False) -> np.ndarray:
    """A row for each node; masked: without what names the article or what isn't."""
    n = len(page.tag)
    own, link, runs, marks = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    first = np.full(n, -1.0)
    seen = 0
    for node, text, linked in page.runs:
        own[node] += len(text)
        link[node] += linked
        runs[node] += 1
        marks[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        if first[node] < 0:
            first[node] = seen
        seen += len(text)
    total, links, blocks, dots, size, paragraphs = own.copy(), link.copy(), runs.copy(), marks.copy(), np.ones(n), np.zeros(n)
    depth, index, children = np.zeros(n), np.zeros(n), np.zeros(n)
    parent = page.parent
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
        index[i] = children[parent[i]]
        children[parent[i]] += 1
    for i in range(n - 1, 0, -1):
        p = parent[i]
        total[p] += total[i]
        links[p] += links[i]
        blocks[p] += blocks[i]
        dots[p] += dots[i]
        size[p] += size[i]
        paragraphs[p] += paragraphs[i] + (page.tag[i] == "p")
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    up = np.maximum(parent, 0)
    tags = [("div" if masked and t in SEMANTIC else t) for t in page.tag]
    kind = np.array([[t in k for k in TAG_KINDS] for t in tags], float)
    bits = np.array([[0 if masked else (g >> k) & 1 for k in range(N_GROUPS)] for g in page.groups], float)
    kind_up, bits_up = kind.copy(), bits.copy()
    for i in range(1, n):  # what any ancestor or the node itself is
        kind_up[i] = np.maximum(kind[i], kind_up[parent[i]])
        bits_up[i] = np.maximum(bits[i], bits_up[parent[i]])
    whole = max(total[0], 1.0)
    table = np.column_stack([
        depth, index, children[up], (index + 1) / np.maximum(children[up], 1), np.log1p(own), np.log1p(total), total / np.maximum(size, 1), links / np.maximum(total, 1), dots / np.maximum(total, 1) * 100, total / whole,
        total / np.maximum(total[up], 1), total / np.maximum(blocks, 1), paragraphs, paragraphs[up], links[up] / np.maximum(total[up], 1), first / whole, np.log1p(total[up]),
    ])
    return np.column_stack([table, kind, kind_up, bits, bits_up])


def weak_labels(page: Page) -> np.ndarray:
    """1: article, 0: not, -1: can't be told or mixed."""
    n = len(page.tag)
    out = np.full(n, -1)
    bad_bits = (1 << CONTENT) - 1
    named = [i for i in range(n) if page.tag[i] in ("article", "main")] or [i for i in range(n) if page.groups[i] >> CONTENT & 1 and page.tag[i] not in ("body", "html")]
    if not named:
        return out
    inside, bad, holds = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    for i in named:
        inside[i] = True
    for i in range(1, n):
        p = page.parent[i]
        inside[i] |= inside[p]
        bad[i] = bad[p] or page.tag[i] in ("nav", "footer", "aside", "form", "menu", "dialog") or (page.tag[i] == "header" and not inside[i]) or bool(page.groups[i] & bad_bits and not page.groups[i] >> CONTENT & 1)
    for i in range(n - 1, 0, -1):
        holds[page.parent[i]] |= holds[i] | (inside[i] & ~bad[i])
    mixed = np.zeros(n, bool)
    for i in range(n - 1, 0, -1):
        mixed[page.parent[i]] |= mixed[i] | (bad[i] & inside[page.parent[i]])
    good = inside & ~bad
    out[good & ~mixed] = 1
    out[bad | (~inside & ~holds)] = 0
    return out


@dataclass
class Forest:
    """Boosted trees as arrays: feature (-1 at leaves), threshold, children, value, by tree."""

    trees: list[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        rows = np.arange(len(x))
        for weight, feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(f, 0)] <= threshold[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            margin += weight * value[at]
        return 1 / (1 + np.exp(-2 * np.clip(margin, -20, 20)))


def forest_of(description: str) -> Forest:
    """The trees of a fitted GBT model, from its public description."""
    trees = []
    for part in re.split(r"\n\s*Tree \d+ ", description)[1:]:
        weight = float(re.match(r"\(weight ([-\d.Ee]+)\)", part)[1])
        rows: list[list[float]] = []
        open_nodes: list[int] = []
        for line in part.splitlines()[1:]:
            line = line.strip()
            if m := re.match(r"If \(feature (\d+) <= ([-\d.Ee]+)\)", line):
                rows.append([int(m[1]), float(m[2]), -1, -1, 0.0])
                new = len(rows) - 1
            elif m := re.match(r"Predict: ([-\d.Ee]+)", line):
                rows.append([-1, 0.0, -1, -1, float(m[1])])
                new = len(rows) - 1
            else:
                continue
            while open_nodes and rows[open_nodes[-1]][3] >= 0:
                open_nodes.pop()
            if open_nodes:
                up = rows[open_nodes[-1]]
                up[2 if up[2] < 0 else 3] = new
            if rows[new][0] >= 0:
                open_nodes.append(new)
        a = np.array(rows, float)
        trees.append((weight, a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
    return Forest(trees)


def keep_nodes(page: Page, p: np.ndarray, mixing: float = 1.0) -> np.ndarray:
    """Which nodes' own text is kept: the likeliest assignment of in, out and mixed to the tree."""
    n = len(page.tag)
    own, children = np.zeros(n), np.zeros(n, bool)
    for node, text, _ in page.runs:
        own[node] += len(text)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    weight = np.where(own > 0, 0.5 + np.log1p(own), 0.5)
    weight[np.array([t in ("html", "body") for t in page.tag]) & (own == 0)] = 0.0  # they hold everything
    yes, no = weight * np.log(p), weight * np.log(1 - p)
    alone = np.where(own > 0, np.maximum(yes, no), 0.0)
    below, state = np.zeros(n), np.zeros(n, int)
    for i in range(n - 1, -1, -1):
        mix = below[i] + alone[i] - mixing if children[i] else -np.inf
        best = max(yes[i], no[i], mix)
        state[i] = 1 if best == yes[i] else 0 if best == no[i] else 2
        if i:
            q = page.parent[i]
            yes[q] += yes[i]
            no[q] += no[i]
            below[q] += best
            children[q] = True
    kept = np.zeros(n, bool)
    for i in range(n):
        if i and state[page.parent[i]] != 2:
            state[i] = state[page.parent[i]]
        kept[i] = state[i] == 1 or (state[i] == 2 and p[i] >= 0.5)
    return kept


def fit(pages: DataFrame, max_pages: int = 400, trees: int = 20, depth: int = 4, id_col: str = "page_id", html_col: str = "html") -> Forest | None:
    """Trains on nodes of at most max_pages pages (least hash of the html first)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    def nodes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for text in pdf["html"]:
                page = parse(text)
                y = weak_labels(page)
                for masked in (False, True):
                    x = features(page, masked)
                    rows += [(x[i], float(y[i])) for i in np.flatnonzero(y >= 0)]
            yield pd.DataFrame(rows, columns=["x", "label"])

    column = F.col(f"`{html_col}`")
    sample = pages.select(column.cast("string").alias("html")).where(F.length("html") > 0).orderBy(F.xxhash64("html")).limit(max_pages)
    table = sample.repartition(4).mapInPandas(nodes, "x array<double>, label double").persist()
    try:
        kinds = {r["label"]: r["n"] for r in table.groupBy("label").agg(F.count("*").alias("n")).collect()}
        if len(kinds) < 2:
            return None
        weight = F.when(F.col("label") == 1, 0.5 / kinds[1.0]).otherwise(0.5 / kinds[0.0]) * float(sum(kinds.values()))
        data = table.select(array_to_vector("x").alias("features"), "label", weight.alias("weight"))
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=1, weightCol="weight", maxMemoryInMB=64).fit(data)
        return forest_of(model.toDebugString)
    finally:
        table.unpersist()


def extract(pages: DataFrame, forest: Forest | None, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, url, text, n_blocks) of every page; a null url stays null, and is null where the table has no such column."""
    shared = pages.sparkSession.sparkContext.broadcast(forest)  # trees of bounded number and depth

    def text_of(page: Page, p: np.ndarray) -> tuple[str, int]:
        kept = keep_nodes(page, p)
        blocks = [text for node, text, _ in page.runs if kept[node]]
        return "\n".join(blocks), len(blocks)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in parts:
            for at in range(0, len(pdf), 100):
                part = pdf.iloc[at : at + 100]
                found = [parse(h) for h in part["html"]]
                if model is None:
                    ps = [np.where(weak_labels(f) == 0, 0.1, 0.9) for f in found]
                else:
                    xs = [features(f) for f in found]
                    ps = np.split(model.probability(np.concatenate(xs)), np.cumsum([len(x) for x in xs])[:-1])
                texts = [text_of(f, p) for f, p in zip(found, ps, strict=True)]
                yield pd.DataFrame({"page_id": part["page_id"].to_numpy(), "url": part["url"].to_numpy(), "text": [t for t, _ in texts], "n_blocks": [n for _, n in texts]})

    small_batches(pages.sparkSession)
    url = F.col(f"`{url_col}`").cast("string") if url_col.lower() in {c.lower() for c in pages.columns} else F.lit(None).cast("string")
    plain = pages.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("page_id"), url.alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    return restored(plain.mapInPandas(run, "page_id long, url string, text string, n_blocks int"), "page_id")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
