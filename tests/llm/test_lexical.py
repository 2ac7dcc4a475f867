"""Ranked search next to a plain scoring of every document."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from urlrisk.llm import lexical, sql

SCHEMA = "doc_id long, text string, term string, segment long"


def terms_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower)


def brute(docs, items, k=20):
    held = [(d, Counter(terms_of(t))) for d, t in docs if terms_of(t)]
    n, words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * n // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text) if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def made(n, seed=1):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(draw.choices(words, weights, k=draw.randint(1, 120)))) for i in range(n)]
    items = [(i, " ".join(draw.choices(words, weights if i % 2 else None, k=draw.randint(1, 30)))) for i in range(25)]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA).repartition(3),
            spark.createDataFrame([(i, t, "y", 2) for i, t in items], SCHEMA.replace("doc_id", "item_id")))


AWKWARD = [(None, "One two three"), (None, None), (1, ""), (2, "!!! \t"), (3, "one ONE Été K k"), (3, "one ONE Été K k"), (3, "other"), (4, "one " * 3000), (5, "two\x00three\x7ffour")]


def test_awkward_rows(spark):
    items = [(1, "one two"), (1, "one two"), (1, "three"), (None, "other été"), (2, None), (3, ""), (4, "nowhere"), (5, "K k Été")]
    assert found(lexical.rank(*frames(spark, AWKWARD, items))) == brute(AWKWARD, items)


@pytest.mark.parametrize("window, short, segment, block", [(4, 3, 2000, 10), (256, 16, 1 << 23, 1 << 15), (16, 1, 20_000, 100)])
def test_many_documents(spark, window, short, segment, block):
    """All sizes of segments, windows and blocks give the rows of a plain scoring."""
    docs, items = made(900)
    docs += [(10_000 + i, docs[7][1]) for i in range(60)]  # ties
    d, i = frames(spark, docs, items)
    terms = lexical.item_terms(i)
    for vocabulary in (lexical.vocabulary(terms), None):
        got = lexical.search(lexical.index(d, vocabulary, segment_bytes=segment), terms, block=block, window=window, short=short)
        assert found(got) == brute(docs, items)


def test_vocabulary_bound(spark):
    terms = lexical.item_terms(frames(spark, [], [(1, "a b c")])[1])
    assert lexical.vocabulary(terms, 3) == {b"a", b"b", b"c"}
    assert lexical.vocabulary(terms, 2) is None


def test_empty_tables(spark):
    some, none = frames(spark, [(1, "a b")], [(1, "a b")]), frames(spark, [], [])
    assert found(lexical.rank(some[0], none[1])) == found(lexical.rank(none[0], some[1])) == []


def test_windows_are_skipped():
    """Windows whose bounds together stay below the threshold are not opened."""
    n, opened = 20_000, []
    segment = lexical.Segment(list(range(n)), np.full(n, 50), n, 50 * n)
    counts = np.ones(n, np.int64)
    counts[5000:5030] = 9
    segment.add(b"long", np.arange(n), counts)
    rare = np.arange(40, 60)
    segment.add(b"rare", rare, np.ones(20, np.int64))
    plain = segment._window
    segment._window = lambda at, *rest: (opened.append(at), plain(at, *rest))
    ids, scores = segment.search([(b"long", 10), (b"rare", 5000)])
    assert ids == rare.tolist() and opened == [0]


def test_long_text_in_pieces(monkeypatch):
    text = ("ab c " * 500).encode()
    whole = lexical.term_counts(text)
    monkeypatch.setattr(lexical, "PIECE", 7)
    assert lexical.term_counts(text) == whole == {b"ab": 500, b"c": 500}


def test_norms_beyond_64_bits():
    assert lexical.norms(np.array([10**9, 1]), 10**12, 10**10).tolist() == [75 + 25 * 10**11, 75 + 2500]


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    from urlrisk.llm.queries import QUERIES
    got = found(QUERIES["op12_lexical_search"].run(spark, folder))
    assert got == sorted(con.execute(sql.LEXICAL).fetchall(), key=str)
    assert len(got) > 100
