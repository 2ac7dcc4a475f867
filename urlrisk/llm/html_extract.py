"""Main text of web pages by a tree-structured graphical model.

Every DOM node with text is in one of three states: content, boilerplate, or
mixed (some of both below it).  The states of a page form a Markov tree: every
edge has a parent-child potential that depends on the child's tag and on what its
class, id and role say; every node has the likelihood of what is seen of it: its
tag, how much text and how many sentences it has, how much of the text is links.
Sum-product messages go from the leaves to the root and back; they give every
node its exact marginals.
A block of the page is kept if its text is content with a probability of one half
or more, by length.

All parameters are counts on labelled pages: (1) at most about ``LABELLED`` of the
given pages in which the markup says what the article is (one ``article`` or one
``main``); (2) written page plans with all kinds of boilerplate inside and around
the article, marked by hand; a page of these weighs ``WRITTEN`` times a given one on
average.  In training a third of the
landmark tags are hidden, so that the model can do without them.

Defined cases: a null, empty or text-less page gives an empty text.  Scripts,
styles and comments of the markup are no text.  Text without any markup is read
like the text of a page.  Unclosed and misplaced tags are read as browsers do.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .html_tree import Page

LABELLED = 2000  # given pages to learn from
WRITTEN = 3
CONTENT, BOILERPLATE, MIXED = 0, 1, 2
TEMPER = (0.3, 1.0, 0.15, 0.6, 0.15)  # exponents of the likelihoods: statistics of a node and of its children repeat each other
SMOOTH = (0.3, 0.05, 0.3, 0.3, 0.3)
BACKED = 0.5  # weight of all edges together in the potentials of one kind of edge
# Tag groups and words of class, id and role.
GROUPS = {t: g for g, tags in {
    "article": "article main", "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form fieldset legend input select option textarea button label",
    "head": "head title", "page": "#page html body", "box": "div section center details dialog summary", "p": "p blockquote pre figcaption dd", "heading": "h1 h2 h3 h4 h5 h6",
    "list": "ul ol dl", "item": "li dt", "link": "a", "table": "table thead tbody tfoot tr td th caption"}.items() for t in tags.split()}
LANDMARKS = frozenset("article nav header footer aside form".split())
AGAINST = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner footer "
                    "foot colophon sidebar side aside complementary widget widgets related recommended more popular trending cookie cookies consent gdpr notice alert popup modal overlay dialog newsletter "
                    "subscribe subscription signup login signin register form search share sharing social comment comments commentlist disqus reply replies respond discussion responses feedback copyright "
                    "legal disclaimer toolbar pagination pager paging tags tagcloud skip hidden contentinfo toc outbrain taboola paywall bylinebox".split())
FOR = frozenset("article content main post entry story body text prose page maincontent articlebody".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
FEATURES = ("tag", "marks", "length", "links", "sentences")
SIZES = (20, 3, 6, 4, 4)
TAGS = {g: i for i, g in enumerate([*dict.fromkeys(GROUPS.values()), "inline", "text"])}
SPEAKING = [TAGS[g] for g in ("nav", "header", "footer", "aside", "form")]  # tags that say what class and role can say
SENTENCE = re.compile(r"[.!?:;,](?=\s|$)")


def marks_of(marks: str) -> int:
    """0 nothing, 1 speaks for content, 2 against it."""
    if not marks:
        return 0
    words = {w.lower() for mark in marks.split() if not mark.startswith("data-") for w in WORD.findall(mark)}
    return 2 if words & AGAINST else 1 if words & FOR else 0


class Forest:
    """The trees of many pages in arrays; children stand after their parents."""

    def __init__(self, pages: list[Page]):
        start = np.cumsum([0] + [len(p.tag) for p in pages])
        self.start = start
        self.parent = np.concatenate([np.array(p.parent) + s for p, s in zip(pages, start)]) if pages else np.empty(0, np.int64)
        self.parent[start[:-1]] = -1
        tags = [t for p in pages for t in p.tag]
        self.text = np.array([not t for t in tags], bool)
        group = [GROUPS.get(t, "inline") if t else "text" for t in tags]
        self.tag = np.array([TAGS[g] for g in group], np.int64)
        self.marks = np.array([marks_of(m) for p in pages for m in p.marks], np.int64)
        self.marks[np.isin(self.tag, SPEAKING)] = 2
        depth = np.zeros(len(tags), np.int64)
        for i, up in enumerate(self.parent.tolist()):
            if up >= 0:
                depth[i] = depth[up] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)]
        own = np.zeros((len(tags), 3))  # characters, of them in links, ends of clauses
        texts = [(i, t) for i, t in enumerate(t for p in pages for t in p.text) if t]
        inside = self._below(np.array([t == "a" for t in tags], bool))
        for i, t in texts:
            own[i] = len(t), len(t) * inside[i], len(SENTENCE.findall(t))
        self.size = own[:, 0].copy()
        for level in reversed(self.levels[1:]):
            np.add.at(own, self.parent[level], own[level])
        self.total = own
        length, links, ends = own.T
        self.features = np.stack([self.tag, self.marks, np.searchsorted([1, 25, 80, 250, 800], length, side="right"),
                                  np.searchsorted([0.01, 0.3, 0.7], links / np.maximum(length, 1), side="right"), np.searchsorted([1, 3, 8], ends, side="right")], axis=1)

    def _below(self, flag: np.ndarray) -> np.ndarray:
        """Whether a node or one above it has the flag."""
        out = flag.copy()
        for level in self.levels[1:]:
            out[level] |= out[self.parent[level]]
        return out

    def states(self, good: np.ndarray) -> np.ndarray:
        """States of all nodes from the leaves: content where ``good``."""
        own = np.where(self.text & good, self.size, 0.0)
        for level in reversed(self.levels[1:]):
            np.add.at(own, self.parent[level], own[level])
        return np.where(own <= 0, BOILERPLATE, np.where(own >= self.total[:, 0], CONTENT, MIXED))


def labels_by_markup(page: Page, forest: Forest) -> np.ndarray | None:
    """Which nodes the markup says are article text; None if it doesn't say."""
    tags = np.array(page.tag)
    main = (tags == "article") if (tags == "article").sum() else (tags == "main")
    if main.sum() != 1:
        return None
    other = np.isin(forest.tag, [TAGS[g] for g in ("nav", "header", "footer", "aside", "form")]) | (forest.marks == 2)
    return forest._below(main) & ~forest._below(other)


def labels_by_hand(page: Page, forest: Forest) -> np.ndarray:
    good, bad = (np.array([f"data-{w} " in m for m in page.marks]) for w in ("main", "not"))
    return forest._below(good) & ~forest._below(bad)


def counts(page: Page, by_hand: bool) -> np.ndarray | None:
    """What a labelled page adds to the counts: start, edges, and features by state; None for a page without labels."""
    forest = Forest([page])
    good = (labels_by_hand if by_hand else labels_by_markup)(page, forest)
    if good is None:
        return None
    state, some = forest.states(good), forest.total[:, 0] > 0
    out = np.zeros(COUNTS)
    if some[0]:
        out[state[0]] += 1
    child = np.flatnonzero(some & (forest.parent >= 0))
    feature = forest.features.copy()
    landmark = np.isin(feature[:, 0], [TAGS[g] for g in LANDMARKS])
    for i in np.flatnonzero(landmark):
        if zlib.crc32(f"{len(page.tag)}:{i}".encode()) % 3 == 0:
            feature[i, :2] = TAGS["box"], 0
    np.add.at(out, 3 + (feature[child, 0] * 3 + feature[child, 1]) * 9 + state[forest.parent[child]] * 3 + state[child], 1)
    at = 3 + EDGES
    for k, size in enumerate(SIZES):
        np.add.at(out, at + state[some] * size + feature[some, k], 1)
        at += 3 * size
    return out


EDGES = SIZES[0] * SIZES[1] * 9  # by tag and marks of the child, state of the parent, state of the child
COUNTS = 3 + EDGES + 3 * sum(SIZES)


class Model:
    """Log potentials from counts."""

    def __init__(self, given: np.ndarray, written: np.ndarray):
        def even(c: np.ndarray) -> np.ndarray:
            return c / max(1.0, c[:3].sum())  # per page

        total = 40 * (even(given) + WRITTEN * even(written))

        def logs(part: np.ndarray, smooth: float) -> np.ndarray:
            part = part + smooth
            return np.log(part / part.sum(axis=-1, keepdims=True))

        self.root = logs(total[:3], 0.1)
        edges = total[3:3 + EDGES].reshape(-1, 3, 3)
        common = np.exp(logs(edges.sum(axis=0), 0.02))
        self.edge = logs(edges + BACKED * common, 0.0)
        at, self.seen = 3 + EDGES, []
        for size in SIZES:
            self.seen.append(logs(total[at:at + 3 * size].reshape(3, size), SMOOTH[len(self.seen)]).T)
            at += 3 * size

    def marginals(self, forest: Forest) -> np.ndarray:
        """Sum-product on all trees at once, level by level: probabilities of the three states of every node."""
        n = len(forest.parent)
        up = sum(TEMPER[k] * table[forest.features[:, k]] for k, table in enumerate(self.seen))
        up[forest.total[:, 0] == 0] = 0.0
        message, edge = np.zeros((n, 3)), self.edge[forest.tag * 3 + forest.marks]

        def total(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis=axis, keepdims=True)
            return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

        for level in reversed(forest.levels[1:]):
            message[level] = total(edge[level] + up[level][:, None, :], 2)
            np.add.at(up, forest.parent[level], message[level])
        down = np.zeros((n, 3))
        if n:
            down[forest.levels[0]] = self.root
        for level in forest.levels[1:]:
            above = forest.parent[level]
            down[level] = total(edge[level] + (up[above] - message[level] + down[above])[:, :, None], 1)
        belief = up + down
        belief = np.exp(belief - belief.max(axis=1, keepdims=True)) if n else belief
        return belief / belief.sum(axis=1, keepdims=True)

    def extract(self, sources: list[str | None]) -> list[str]:
        pages = [Page(s or "") for s in sources]
        forest = Forest(pages)
        content = self.marginals(forest)[:, CONTENT]
        out = []
        for page, at in zip(pages, forest.start):
            weight: dict[int, list[float]] = {}
            nodes = [i for i, tag in enumerate(page.tag) if not tag]
            for i in nodes:
                w = weight.setdefault(page.block[i], [0.0, 0.0])
                size = len(page.text[i].strip()) or 1
                w[0] += size * content[at + i]
                w[1] += size
            keep = [False] * len(page.tag)
            for i in nodes:
                part, size = weight[page.block[i]]
                keep[i] = part >= 0.5 * size
            out.append(page.blocks_of(keep))
        return out


def written_pages() -> list[str]:
    """Page plans with their content marked: kinds of articles, with boilerplate around and inside."""
    line = "The report was read on Monday, and most of the members agreed with it. "
    linked = line.replace("the members", "<a href='/m'>the members</a>")
    long, short = f"<p>{line * 2}{linked}{line}</p>", "<p>Some of them did not.</p>"
    links = "".join(f'<li><a href="/{i}">Part {i}</a></li>' for i in range(6))
    inner = (f"<h1>What the members said</h1>{long}{long}{short}", f"<h2>One more report</h2>{long}<ul><li>{line}</li><li>{linked}</li><li>Three of them</li></ul>{long}",
             f"<p>{line * 2}<a href='/x'>as said before</a>, {line}</p><blockquote>{line}</blockquote><ol><li>{line}</li><li>{line}</li></ol><h3>More</h3>{long}", f"<h1>Short news</h1>{short}", f"{line * 3}<br>{line * 2}")
    around = ("<article data-main='1'>{}</article>", "<main><article data-main='1'>{}</article></main>", "<div id='content' data-main='1'>{}</div>", "<div class='post-body' data-main='1'>{}</div>",
              "<section data-main='1'>{}</section>", "<div data-main='1'>{}</div>")
    extra = [f"<aside data-not='1'><h3>Most read</h3><ul>{links}</ul></aside>", f"<div class='sidebar' data-not='1'><p>{line}</p><ul>{links}</ul></div>",
             f"<section id='comments' data-not='1'><h3>2 comments</h3><div class='comment'><p>{line}</p></div><div class='comment'><p>{line * 3}</p></div></section>",
             "<form action='/s' data-not='1'><label>Mail</label><p>Get our news by mail.</p><button>Send</button></form>", f"<div class='cookie-notice' data-not='1'><p>We use cookies. {line}</p></div>",
             f"<div class='ad' data-not='1'>{line}</div>", f"<div class='advert' data-not='1'><p>{line * 2}</p></div>", f"<div class='related' data-not='1'><h4>Read on</h4><p><a href='/y'>{line}</a></p></div>",
             "<div class='share' data-not='1'><a href='#'>Share</a> <a href='#'>Post</a></div>", f"<div class='newsletter' data-not='1'><h3>Newsletter</h3><p>{line}</p></div>",
             f"<div role='alert' data-not='1'>{line}</div>", f"<ol class='commentlist' data-not='1'><li><p>{line * 2}</p></li><li>{line}</li></ol>"]
    out = []
    for i in range(len(inner) * len(around) * 2):
        body, box = inner[i % len(inner)], around[i // len(inner) % len(around)]
        first, second = extra[i % len(extra)], extra[(5 * i + 3) % len(extra)]
        middle = box.format(body + (first + long if i % 2 else ""))
        top = f"<header><a href='/'>Site</a><p>News of the day</p></header><nav><ul>{links}</ul></nav>" if i % 3 else f"<div class='menu'><ul>{links}</ul></div>"
        bottom = f"<footer><p>&copy; Site, all rights. {line if i % 4 == 0 else ''}</p></footer>" if i % 3 != 1 else f"<div id='footer'>&copy; Site <a href='/l'>Legal</a></div>"
        out.append(f"<html><head><title>What the members said</title></head><body>{top}{second if i % 4 < 2 else ''}{middle}{second if i % 4 >= 2 else ''}{bottom}</body></html>")
    return out


def fit(pages: DataFrame, html: str = "html", labelled: int = LABELLED) -> Model:
    """The model from about ``labelled`` given pages whose markup names the article, and the written ones."""
    share = -(-pages.count() // labelled) or 1
    sample = pages.select(F.col(html).alias("html")).where(F.col("html").isNotNull()).where(F.pmod(F.xxhash64("html"), F.lit(share)) == 0)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTS)
        for batch in source:
            for text in batch.column(0).to_pylist():
                found = counts(Page(text), False)
                total += 0 if found is None else found
        yield pa.RecordBatch.from_pydict({"place": np.arange(COUNTS), "n": total})

    given = np.zeros(COUNTS)
    for row in sample.mapInArrow(run, "place long, n double").groupBy("place").agg(F.sum("n").alias("n")).collect():
        given[row["place"]] = row["n"]
    return Model(given, sum(counts(Page(p), True) for p in written_pages()))


def extract(pages: DataFrame, model: Model, html: str = "html", text: str = "text") -> DataFrame:
    """All columns of ``pages`` but the html, with its main text; one narrow pass."""
    kept = [c for c in pages.columns if c not in (html, text)]
    schema = pages.select(*kept).schema.add(text, "string", False)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = model.extract(part.column(html).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, text])

    return pages.select(*kept, html).mapInArrow(run, schema)
