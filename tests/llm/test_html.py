"""Main text of pages: exact messages, the given pages, layouts never seen, and awkward markup."""

import html
import itertools
import re

import numpy as np
import pytest

from urlrisk.llm import html_extract as H
from urlrisk.llm.html_tree import Page
from urlrisk.llm.queries import op2

FOLDER = "/root/testdata/sf0.01"


def article_text(page):
    """What the given pages hold in their article, by its plain reading."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", inner))
    return "\n".join(b for b in blocks if b)


@pytest.fixture(scope="module")
def model(spark):
    return H.fit(spark.read.parquet(f"{FOLDER}/pages.parquet"))


def test_given_pages(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    found = op2(spark, FOLDER).collect()
    assert len(found) == len(pages)
    for row in found:
        assert row["text"] == article_text(pages[row["page_id"]]["html"])
        assert row["n_chars"] == len(row["text"]) and row["url"] == pages[row["page_id"]]["url"]


def test_messages_equal_summing_over_all_states(model):
    page = Page("<body><div class='ad'>Buy it now.</div><div><p>One line of text. Two.</p></div></body>")
    forest = H.Forest([page])
    n = len(page.tag)
    seen = sum(H.TEMPER[k] * t[forest.features[:, k]] for k, t in enumerate(model.seen))
    seen[forest.total[:, 0] == 0] = 0
    edge = model.edge[forest.tag * 3 + forest.marks]
    total = np.zeros((n, 3))
    for states in itertools.product(range(3), repeat=n):
        log = model.root[states[0]] + sum(seen[i, s] for i, s in enumerate(states)) + sum(edge[i, states[forest.parent[i]], states[i]] for i in range(1, n))
        total[range(n), states] += np.exp(log)
    assert np.allclose(model.marginals(forest), total / total.sum(axis=1, keepdims=True))


def test_written_pages_are_read_as_marked(model):
    pages = H.written_pages()
    for source, text in zip(pages, model.extract(pages)):
        page = Page(source)
        assert text == page.blocks_of([bool(g) for g in H.labels_by_hand(page, H.Forest([page]))])


SENTENCE = "Words of the text stand here, with more of them behind. And again some."
LAYOUTS = [
    (f"<div id='wrap'><div class='top-nav'><a href=/>Home</a> | <a href=/a>About</a></div><div class='col'><h2>Title</h2><p>{SENTENCE}</p><div class='inline-ad'><p>Buy this now, it is cheap. Buy it.</p></div>"
     f"<p>{SENTENCE} Two.</p></div><div class='right sidebar'><p>Popular things to read, every day.</p></div><div id='comments'><p>I like this very much. It is good, really.</p></div></div><div class='footer'>Copyright</div>",
     f"Title\n{SENTENCE}\n{SENTENCE} Two."),
    (f"<main><h1>Head</h1><p>{SENTENCE}<p>{SENTENCE} Next.<ul><li>One thing to say.<li>Other thing to say.</ul><section class=comments><h3>Comments</h3><p>Nice text, thank you for it. Really.</p></section></main><footer>foot</footer>",
     f"Head\n{SENTENCE}\n{SENTENCE} Next.\nOne thing to say.\nOther thing to say."),
    (f"<nav><a href=1>x</a></nav><article><h1>H</h1><p>{SENTENCE}</p><aside>Read also: other things.</aside><form><p>Subscribe to us.</p><input></form><p>{SENTENCE} End.</p></article><div class='cookie-banner'>We use cookies.</div>",
     f"H\n{SENTENCE}\n{SENTENCE} End."),
    ("<article><p>A &amp; B &lt;tag&gt; &eacute;&#233;&nbsp;x <i>in</i> <b>line</b>s</p><pre>a\n  b</pre></article><script>var x='</p>';</script><style>p{}</style>", "A & B <tag> éé x in lines\na b"),
    ("<p>Only a paragraph of text, nothing else. It is short.</p>", "Only a paragraph of text, nothing else. It is short."),
    ("plain words without any markup, just that. And more.", "plain words without any markup, just that. And more."),
]


@pytest.mark.parametrize("source, text", LAYOUTS)
def test_other_layouts(model, source, text):
    assert model.extract([source])[0] == text


def test_awkward_pages(spark, model):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", " \n", "x"), (3, "u", "<a href=\"x", "x"), (3, "u", "<a href=\"x", "x"), (4, "u", "<div>" * 4000 + "deep", "x"),
            (5, "u", "<!-- <p>no</p>", "x"), (6, "u", "<" * 50000, "x"), (7, "u", "<a b='" * 3000, "x"), (8, "u", "</p></div><p", "x"), (9, "u", "<script>" * 2000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = H.extract(pages, model)
    assert found.columns == ["page_id", "url", "text"]
    texts = [(r["page_id"], r["text"]) for r in found.collect()]
    assert len(texts) == len(rows) and all(t is not None for _, t in texts)
    assert dict(texts)[1] == dict(texts)[2] == dict(texts)[5] == ""
    assert H.extract(pages.limit(0), H.fit(pages.limit(0))).count() == 0
