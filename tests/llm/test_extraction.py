"""Main text of pages: planted articles, held-out layouts, and messages against enumeration."""

import html
import itertools
import os
import re

import numpy as np
import pytest
from conftest import SF_DIR

from emberlog.llm import catalog, extraction
from emberlog.llm.dom import Page

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
SCHEMA = "page_id bigint, url string, html string, text string, n_chars string"


def article(page):
    """The article of a page of the given tables, whose articles hold h1 and p only."""
    inside = re.search("<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_articles_of_the_given_pages(spark):
    got = catalog.QUERIES["op12_dom_marginals"](spark, SF_DIR).collect()
    want = {r.page_id: (r.url, article(r.html)) for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    assert {r.page_id: (r.url, r.text) for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


@pytest.fixture(scope="module")
def model_and_others(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").select("html").collect()]
    return extraction.fit(extraction.labelled_pages(pages[: len(pages) // 2])), pages[len(pages) // 2 :]


def test_held_out_layouts(model_and_others):
    model, others = model_and_others
    told = extraction.labelled_pages(others, seed=99)
    right = total = 0
    for page, shown in zip(told, model.content(told), strict=True):
        own = {node for node, text, _ in page.runs if text.strip()}
        right += sum((shown[i] >= 0.5) == bool(page.label[i]) for i in own)
        total += len(own)
    assert total > 1000 and right / total > 0.97


def test_parts_that_are_no_content(model_and_others):
    model, _ = model_and_others
    body = "".join(f"<p>Sentence number {i} of the <a href=x>story</a> goes on, as it should, for a good while.</p>" for i in range(8))
    page = Page(
        "<body><div class=cookie-banner><p>We use cookies, as all do.</p><button>OK</button></div><header><h1>The Site</h1></header>"
        "<div id=menu><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></div>"
        f"<div class=content><h1>Title &amp; more</h1>{body}<form><label>Your mail</label><input name=m><p>Subscribe now</form></div>"
        "<aside><h3>Related</h3><ul><li><a href=/c>Another story</a></ul></aside>"
        "<section class=comments><h3>Comments</h3><div class=comment><b>Ann</b><p>I did not like this story at all, sorry.</p></div></section>"
        "<footer>&copy; 2020 The Site</footer></body>"
    )
    blocks = page.blocks((model.content([page])[0] >= 0.5).tolist())
    assert blocks[0] == "Title & more" and len(blocks) == 9 and blocks[8].startswith("Sentence number 7 of the story goes")


def test_messages_equal_enumeration():
    pages = [Page("<body><nav><p>a<p>b</nav><main><p>c</main></body>"), Page("x"), Page("<div><p>1</div>")]
    forest, rng = extraction.Forest(pages), np.random.default_rng(1)
    score, edges = rng.normal(size=(len(forest.tags), 2)) * 2, rng.normal(size=(3, 2, 2))
    shown, pairs = extraction.marginals(forest, score, edges)
    for a, b in itertools.pairwise(forest.starts):
        weight, one = 0.0, np.zeros(b - a)
        both = np.zeros((b - a, 2, 2))
        for labels in itertools.product((0, 1), repeat=b - a):
            up = [0 if forest.parent[i] < 0 else labels[forest.parent[i] - a] for i in range(a, b)]
            energy = sum(edges[forest.kind[i]][u][y] + y * score[i][u] for i, u, y in zip(range(a, b), up, labels, strict=True))
            w = np.exp(energy)
            weight += w
            one += w * np.array(labels)
            both[np.arange(b - a), up, labels] += w
        assert np.allclose(shown[a:b], one / weight) and np.allclose(pairs[a:b], both / weight)


def test_reader():
    page = Page('<P CLASS="mainBody x">a<b>b <i>c</b>d<p>e<div>x<p>y</div>z<ul><li>1<li>2<ul><li>3</ul></ul><a href="q>r">l</a>\nm\t&lt;')
    assert page.blocks([True] * len(page.tag)) == ["ab cd", "e", "x", "y", "z", "1", "2", "3", "l m <"]
    assert page.names[1] == ("main", "body", "x")
    for broken in ("<", "<p", "</", "<!--", "<script>x", '<p title="a', "</p></div>", "<![foo[", "&#xD800;&#0;&#99999999;", "<a" * 50, "<b><div>" * 3000):
        assert isinstance(Page(broken).blocks([True] * 10_000), list)


def test_edges(spark):
    good = "<html><body><nav><a href=/>x</a></nav><article><h1>T</h1><p>One, two.</p></article></body></html>"
    rows = [(1, "u", good), (1, "u", good), (None, None, good), (2, "u", None), (3, None, ""), (4, "u", "plain"), (5, "u", "<p>" + "long text, " * 200_000)]
    frame = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    got = extraction.main_text(frame).collect()
    assert len(got) == len(rows) and sorted(map(str, [(r.page_id, r.url) for r in got])) == sorted(str(r[:2]) for r in rows)
    assert {r.text for r in got if r.page_id in (2, 3)} == {""} and all(r.n_chars == len(r.text) for r in got)
    assert extraction.main_text(frame.limit(0)).count() == 0
    assert extraction.main_text(frame.filter("page_id = 2")).select("text", "n_chars").first() == ("", 0)
