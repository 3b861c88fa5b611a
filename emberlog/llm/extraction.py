"""Main text of web pages by a tree-structured graphical model.

Block elements of a page are the nodes; each is content or not. A node's features speak for either, potentials tie child to
parent, and sum-product messages, first upward, then downward, give every node's marginal. Weights are fitted by the
exact gradient on labelled pages: a bounded sample of the table whose markup names the article, as it is and told again in
other layouts, in which the label of every element is known.
"""

import random
from collections.abc import Iterator
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.dom import MEASURES, Page
from emberlog.llm.frames import ship_with_tasks, small_batches

ship_with_tasks(__name__)

#: Pages that the model is fitted on: how many at most and of what length, how many pages are told again, and each how often at least.
TRAIN_PAGES, TRAIN_CHARS, TOLD_PAGES, LAYOUTS = 200, 1 << 16, 600, 3
STEPS, RATE, DECAY = 160, 0.15, 3e-4
#: Share of the pages told again whose article is cut to a few blocks, and to short, alike lines.
FEW, SHORT = 0.2, 0.25
#: Characters of pages that are worked on together.
TOGETHER = 1 << 22

#: Measures of an element cut into bins: own and whole text, shares of links and stops, children, place and share in the page.
BINS = {
    "own": (0.5, 15, 50, 150, 400), "whole": (0.5, 15, 50, 150, 400, 1500), "links": (-0.5, 0.01, 0.2, 0.5, 0.9),
    "stops": (-0.5, 0.001, 0.007, 0.015, 0.03), "kids": (0.5, 1.5, 3.5, 8.5), "at": (0.02, 0.1, 0.5, 0.9),
    "share": (0.02, 0.1, 0.3, 0.6, 0.9), "inputs": (0.5,), "sign": (0.5,),
}
_OFFSETS = np.cumsum([0] + [len(e) + 1 for e in BINS.values()])
#: Kinds of edges by the child: sections, parts of the page, and the rest.
SECTIONS = frozenset("div section article main body html center td".split())
PARTS = frozenset("nav header footer aside form dialog menu address button label fieldset head".split())


class Forest:
    """The elements of several pages: features, parents, levels."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.tag) for p in pages]
        self.starts = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        base = np.repeat(self.starts[:-1], sizes)
        parent = np.array([x for p in pages for x in p.parent], np.int64)
        self.parent = np.where(parent < 0, -1, parent + base)
        self.tags = [t for p in pages for t in p.tag]
        self.names = [x for p in pages for x in p.names]
        self.label = np.array([x for p in pages for x in p.label], np.int64)
        self.kind = np.array([0 if t in SECTIONS else 1 if t in PARTS else 2 for t in self.tags], np.int64)
        taken = [p.measures() for p in pages]
        m = {name: np.array([x for t in taken for x in t[i]], np.float64) for i, name in enumerate(MEASURES)}
        size, seen = np.maximum(m["whole"], 1), np.maximum(m["seen"], 1)
        some = m["whole"] > 0
        m |= {"links": np.where(some, m["links"] / size, -1), "stops": np.where(some, m["stops"] / size, -1),
              "at": m["first"] / seen, "share": m["whole"] / seen}
        self.bins = np.stack([o + np.searchsorted(e, m[n]) for o, (n, e) in zip(_OFFSETS, BINS.items(), strict=False)], 1)
        depth = np.zeros(len(self.parent), np.int64)
        ups = self.parent.tolist()
        for i, p in enumerate(ups):
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        #: Elements by depth, from the children of the roots on.
        self.levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1 if len(depth) else 1)))[1:]

    def entries(self, index: dict[str, int], grow: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(element, feature) of the features given by words: tag, parent's tag, names."""
        nodes, found = [], []
        number = (lambda x: index.setdefault(x, len(index))) if grow else index.get
        ups = self.parent.tolist()
        for i, (tag, names) in enumerate(zip(self.tags, self.names, strict=True)):
            words = [f"tag={tag}", *[f"name={x}" for x in names]] if names else [f"tag={tag}", f"plain={tag}"]
            if ups[i] >= 0:
                words.append(f"up={tag}<{self.tags[ups[i]]}")
            for w in words:
                k = number(w)
                if k is not None:
                    nodes.append(i)
                    found.append(k)
        return np.array(nodes, np.int64), np.array(found, np.int64)


def _log_sum(x: np.ndarray) -> np.ndarray:
    """log(sum(exp)) over the last axis of length 2."""
    return np.logaddexp(x[..., 0], x[..., 1])


def marginals(forest: Forest, score: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(content) per element and the pair marginals (element, parent's label, own label), by sum-product.

    ``score`` is each element's log odds of content for either label of its parent, ``edges`` the log potentials (kind,
    parent's label, own label). A root's parent counts as no content.
    """
    n = len(score)
    tie = edges[forest.kind]
    tie[:, :, 1] += score
    below = np.zeros((n, 2))
    below[forest.parent < 0] = tie[forest.parent < 0, 0]
    to_parent = np.zeros((n, 2))
    for level in forest.levels[::-1]:
        to_parent[level] = _log_sum(below[level][:, None, :] + tie[level])
        np.add.at(below, forest.parent[level], to_parent[level])
    belief, pairs = below.copy(), np.zeros((n, 2, 2))
    for level in forest.levels:
        joint = (belief[forest.parent[level]] - to_parent[level])[:, :, None] + tie[level]
        belief[level] += _log_sum(joint.transpose(0, 2, 1))
        joint += below[level][:, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        pairs[level] = joint / joint.sum((1, 2), keepdims=True)
    shown = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
    pairs[forest.parent < 0, 0] = np.stack([1 - shown, shown], 1)[forest.parent < 0]
    return shown, pairs


class Model:
    """Weights of the binned measures and of the words, by the parent's label, and the edge potentials."""

    def __init__(self, index: dict[str, int], bins: np.ndarray, words: np.ndarray, edges: np.ndarray):
        self.index, self.bins, self.words, self.edges = index, bins, words, edges

    def score(self, forest: Forest, nodes: np.ndarray, found: np.ndarray) -> np.ndarray:
        n = len(forest.tags)
        return np.stack([self.bins[y][forest.bins].sum(1) + np.bincount(nodes, self.words[y][found], n) for y in (0, 1)], 1)

    def content(self, pages: list[Page]) -> list[np.ndarray]:
        """Per page the marginals of its elements."""
        forest = Forest(pages)
        shown, _ = marginals(forest, self.score(forest, *forest.entries(self.index)), self.edges)
        return np.split(shown, forest.starts[1:-1])


def fit(pages: list[Page]) -> Model:
    """Weights of greatest likelihood on labelled pages, with weight decay; the gradient comes from the marginals."""
    forest = Forest(pages)
    index: dict[str, int] = {}
    nodes, found = forest.entries(index, grow=True)
    model = Model(index, np.zeros((2, _OFFSETS[-1])), np.zeros((2, len(index))), np.zeros((3, 2, 2)))
    seen = np.zeros((len(forest.label), 2, 2))
    up = np.where(forest.parent >= 0, forest.label[forest.parent], 0)
    seen[np.arange(len(up)), up, forest.label] = 1
    weights = [model.bins, model.words, model.edges]
    means, squares = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        off = seen - marginals(forest, model.score(forest, nodes, found), model.edges)[1]
        slopes = [
            np.stack([np.bincount(forest.bins.ravel(), np.repeat(off[:, y, 1], forest.bins.shape[1]), _OFFSETS[-1]) for y in (0, 1)]),
            np.stack([np.bincount(found, off[nodes, y, 1], len(index)) for y in (0, 1)]),
            np.stack([off[forest.kind == k].sum(0) for k in range(3)]),
        ]
        for w, g, m, v in zip(weights, slopes, means, squares, strict=True):
            g = g / len(pages) - DECAY * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


# Names that pages commonly give to their parts, by which part.
ARTICLE = "article content main post entry story body text page-content post-body article-body entry-content main-content story-body".split()
NOISE = {
    "nav": "nav navbar menu main-menu breadcrumb breadcrumbs navigation topnav pagination pager toc tabs".split(),
    "header": "header masthead site-header banner topbar logo branding page-header".split(),
    "footer": "footer site-footer page-footer bottom legal copyright colophon".split(),
    "aside": "sidebar aside widget related recommended side rail popular trending tags more-stories".split(),
    "notice": "notice cookie cookie-banner consent alert popup modal message gdpr announcement paywall".split(),
    "ad": "ad ads advert advertisement sponsored promo banner-ad ad-slot sponsor promotion adsense".split(),
    "form": "form search newsletter subscribe signup login contact-form search-form".split(),
    "comments": "comments comment comment-list reader-comments replies discussion responses comment-body".split(),
    "share": "share social sharing social-links byline-share share-buttons follow".split(),
}
NOISE_TAG = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "notice": "div", "ad": "div", "form": "form", "comments": "section", "share": "div"}


class Teller:
    """Tells the text of a page again in a random layout; ``data-y`` marks the content elements."""

    def __init__(self, rng: random.Random, content: list[str], noise: list[str], others: list[str]):
        self.rng, self.content, self.noise, self.others = rng, content, noise, others

    def _box(self, tag: str, names: list[str], inner: str, label: int, plain: float = 0.15) -> str:
        named = "" if self.rng.random() < plain else f' {self.rng.choice(["class", "class", "id"])}="{self.rng.choice(names)}"'
        return f'<{tag}{named} data-y="{label}">{inner}</{tag}>'

    def _words(self, low: int, high: int) -> str:
        words = self.rng.choice(self.others + self.noise).split() or ["more"]
        start = self.rng.randrange(len(words))
        return escape(" ".join(words[start : start + self.rng.randint(low, high)]))

    def _links(self) -> str:
        items = [f'<li data-y="0"><a href="/{i}">{self._words(1, 3)}</a></li>' for i in range(self.rng.randint(2, 9))]
        if self.rng.random() < 0.7:
            return f'<ul data-y="0">{"".join(items)}</ul>'
        return " | ".join(f'<a href="/{i}">{self._words(1, 3)}</a>' for i in range(self.rng.randint(2, 9)))

    def _paragraphs(self, low: int, high: int, words: int = 30) -> str:
        return "".join(f'<p data-y="0">{self._words(3, words)}</p>' for _ in range(self.rng.randint(low, high)))

    def part(self, kind: str, inside: bool = False) -> str:
        """One part of a page that is not content."""
        r = self.rng.random()
        inner = {
            "nav": lambda: self._links(), "header": lambda: ("<h1>" + self._words(1, 4) + "</h1>" if r < 0.5 else self._words(1, 5)) + (self._links() if r > 0.3 else ""),
            "footer": lambda: ("&copy; " if r < 0.7 else "") + self._words(2, 15) + (self._links() if r < 0.4 else ""),
            "aside": lambda: f"<h3>{self._words(1, 4)}</h3>" + (self._links() if r < 0.6 else self._paragraphs(1, 3)),
            "notice": lambda: (self._paragraphs(1, 2) if r < 0.5 else self._words(5, 25)) + "<button>OK</button>" * (r < 0.7),
            "ad": lambda: self._words(3, 25) if r < 0.6 else self._paragraphs(1, 2),
            "form": lambda: f"<label>{self._words(1, 5)}</label><input name=q><button>{self._words(1, 2)}</button>" + self._paragraphs(0, 1, 12),
            "comments": lambda: f"<h3>{self._words(1, 3)}</h3>" + "".join(
                self._box(self.rng.choice(["div", "li", "article"]), NOISE["comments"], f"<b>{self._words(1, 2)}</b>" + self._paragraphs(1, 3, 60), 0, 0.2)
                for _ in range(self.rng.randint(1, 4))),
            "share": lambda: self._links(),
        }[kind]()
        semantic = self.rng.random() < 0.5 and not (inside and kind in ("header", "footer") and r < 0.5)
        tag = NOISE_TAG[kind] if semantic else self.rng.choice(["div", "div", "section", "ul" if kind == "nav" and "<li" in inner else "div"])
        known = semantic and tag not in ("div", "section")
        return self._box(tag, NOISE[kind], inner, 0, 0.5 if known else 0.0)

    def article(self) -> str:
        """The content, now and then broken by a part that is not."""
        out, broken = [], self.rng.random() < 0.4
        for i, block in enumerate(self.content):
            text, r = escape(block, quote=False), self.rng.random()
            if i == 0 and r < 0.8:
                tag = self.rng.choice(["h1", "h1", "h2"])
                out.append(f'<{tag} data-y="1">{text}</{tag}>')
            elif r < 0.04:
                words = text.split(" ")
                items = [" ".join(words[k : k + 8]) for k in range(0, len(words), 8)]
                out.append('<ul data-y="1">' + "".join(f'<li data-y="1">{x}</li>' for x in items) + "</ul>")
            elif r < 0.07:
                out.append(f'<blockquote data-y="1"><p data-y="1">{text}</p></blockquote>')
            elif r < 0.1:
                out.append(f'<h3 data-y="1">{text[:60]}</h3><p data-y="1">{text}')
            elif r < 0.13:
                out.append(f'<div data-y="1">{text}</div>')
            elif r < 0.15:
                out.append(f'<table data-y="1"><tr data-y="1"><td data-y="1">{text[:40]}</td><td data-y="1">{text}</td></tr></table>')
            elif r < 0.3:
                out.append(f'<p data-y="1"><b>{text}<br>')
            elif r < 0.4:
                out.append(f'<p data-y="1">{text[:30]} <a href="/x">{text[30:45]}</a> {text[45:]}</p>')
            else:
                out.append(f'<p data-y="1">{text}</p>')
            if broken and self.rng.random() < 0.2:
                out.append(self.part(self.rng.choice(["ad", "aside", "form", "share", "notice"]), True))
        if self.rng.random() < 0.35:
            out.append(self.part(self.rng.choice(["comments", "share", "footer", "aside", "form"]), True))
        return "".join(out)

    def page(self) -> str:
        rng = self.rng
        inner, r = self.article(), rng.random()
        if r < 0.3:
            inner = self._box("article", ARTICLE, inner, 1, 0.6)
        elif r < 0.75:
            inner = self._box(rng.choice(["div", "div", "section", "main"]), ARTICLE, inner, 1, 0.15)
        elif r < 0.9:
            inner = self._box("main", ARTICLE, self._box(rng.choice(["article", "div"]), ARTICLE, inner, 1, 0.3), 1, 0.5)
        if rng.random() < 0.3:
            inner = f'<div class="{rng.choice(["wrapper", "container", "row", "layout", "page"])}" data-y="0">{inner}{self.part("aside") if rng.random() < 0.6 else ""}</div>'
        before = [self.part(k) for k in ("notice", "header", "nav", "form", "ad", "aside") if rng.random() < 0.4]
        after = [self.part(k) for k in ("comments", "aside", "ad", "form", "nav", "footer", "notice") if rng.random() < 0.4]
        rng.shuffle(before)
        return f"<html><head><title>{self._words(2, 6)}</title></head><body>{''.join(before)}{inner}{''.join(after)}</body></html>"


def marked_article(page: Page) -> bool:
    """Label a page by its own markup (article or main without the parts that are no content); whether it names one."""
    for i in range(1, len(page.tag)):
        if page.tag[i] in PARTS or page.tag[i] in ("script", "style") or any(x in NOISE["ad"] + NOISE["comments"] for x in page.names[i]):
            page.label[i] = 0
        else:
            page.label[i] = int(page.tag[i] in ("article", "main") or (page.label[page.parent[i]] and page.parent[i] > 0))
    return any(page.label)


def labelled_pages(htmls: list[str], seed: int = 7) -> list[Page]:
    """Labelled pages made of the given ones: those with a marked article as they are, all told again in other layouts."""
    rng, out, told = random.Random(seed), [], []
    for html in htmls:
        page = Page(html)
        known = marked_article(page)
        if known:
            out.append(page)
        content = page.blocks([bool(x) for x in page.label]) if known else [b for b in page.blocks([True] * len(page.tag)) if len(b.split()) > 20]
        noise = page.blocks([not x for x in page.label]) if known else []
        told.append((content, noise))
    if not any(content for content, _ in told):
        told = [([f"word {i}, and more of it. " * (1 + i % 9) for i in range(k % 12 + 2)], ["more", "about us"]) for k in range(40)]
    others = [b for content, _ in told for b in content[:3]]
    told = [x for x in told if x[0]]
    for content, noise in told:
        for _ in range(max(LAYOUTS, -(-TOLD_PAGES // len(told)))):
            blocks = content[:60]
            r = rng.random()
            if r < FEW:
                blocks = [b[: rng.choice([20, 60, 200, 1000])] for b in blocks[: rng.randint(1, 3)]]
            elif r < FEW + SHORT:
                # Articles of many short, alike lines: verse, licences, junk.
                blocks = [b[: rng.choice([12, 30, 60])] for b in rng.choices(blocks, k=rng.randint(1, 3)) for _ in range(rng.randint(4, 25))]
            out.append(Page(Teller(rng, blocks, noise, others).page()))
    return out


def train(pages: DataFrame) -> Model:
    """The model for a table of pages, fitted on at most TRAIN_PAGES of it, chosen by hash, of at most TRAIN_CHARS characters."""
    short = pages.filter(F.length("html").between(1, TRAIN_CHARS)).select("html", F.xxhash64("html").alias("h"))
    # The hashes first: whole pages of every task would be too much for the driver.
    chosen = [row.h for row in short.select("h").distinct().orderBy("h").limit(TRAIN_PAGES).collect()]
    found = short.filter(F.col("h").isin(chosen)).groupBy("h").agg(F.min("html").alias("html")).collect() if chosen else []
    return fit(labelled_pages([row.html for row in sorted(found)]))


def _extractor(model: Model):
    def texts(htmls: list[str]) -> list[str]:
        pages = [Page(html) for html in htmls]
        return ["\n".join(page.blocks((shown >= 0.5).tolist())) for page, shown in zip(pages, model.content(pages), strict=True)]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(page_id, url, html) -> page_id, url, text."""
        for batch in batches:
            held, size, out = [], 0, []
            for html in batch.column(2):
                held.append(html.as_py() or "")
                size += len(held[-1])
                if size >= TOGETHER:
                    out += texts(held)
                    held, size = [], 0
            if held:
                out += texts(held)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return extract


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page: its main text, one line per block.

    Null or empty html has empty text; null ids and urls stay; repeated rows are pages of their own; an empty table gives an empty
    result. Other columns are not read.
    """
    small_batches(pages.sparkSession)
    types = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    found = pages.select("page_id", "url", "html").mapInArrow(_extractor(train(pages)), f"page_id {types[0]}, url {types[1]}, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
