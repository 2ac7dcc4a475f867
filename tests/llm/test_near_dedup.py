"""Near-duplicate classes next to all pairs, and the awkward rows."""

from collections import Counter

import numpy as np

from urlrisk.llm import near_dedup as N
from urlrisk.llm.words import Hasher

DOCS = "/root/testdata/sf0.001/documents.parquet"


def words_of(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def shingles(text):
    w = words_of(text)
    n = min(5, len(w))
    return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def similarity(a, b):
    """Probability Jaccard, by its definition."""
    keys = a.keys() | b.keys()
    total = 0.0
    for i in a.keys() & b.keys():
        total += 1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in keys)
    return total


def brute(rows):
    """doc_id -> smallest doc_id of its class, from all pairs."""
    label = {i: i for i, _ in rows}
    sets = {i: (t, shingles(t)) for i, t in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            (s, a), (t, b) = sets[i], sets[j]
            if s == t or len(a.keys() & b.keys()) >= 0.5 * min(len(a), len(b)) and a and b and similarity(a, b) >= 0.8:
                p, q = sorted((root(i), root(j)))
                label[q] = p
    return {i: root(i) for i in ids}


def variants():
    """Chains of edits of one text, a group of copies, and texts that share a passage only."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = list(rng.choice(vocabulary, 120))
    rows, at = [], 0
    for copy in range(12):
        text = list(base)
        for place in rng.choice(120, copy // 3, replace=False):
            text[place] = f"x{copy}{place}"
        rows.append((at, " ".join(text)))
        at += 1
    for _ in range(9):
        rows.append((at, " ".join(base)))
        at += 1
    chain = list(rng.choice(vocabulary, 200))
    for step in range(8):  # each is near the one before, the last is far from the first
        rows.append((at, " ".join(chain)))
        chain = chain[12:] + list(rng.choice(vocabulary, 12))
        at += 1
    passage = list(rng.choice(vocabulary, 50))
    for _ in range(12):
        rows.append((at, " ".join(list(rng.choice(vocabulary, 60)) + passage)))
        at += 1
    rows += [(at, "one two"), (at + 1, "One, two!"), (at + 2, "one two three"), (at + 3, ""), (at + 4, ""), (at + 5, "!!!"), (at + 6, "again and again " * 30), (at + 7, "again and again " * 31)]
    return rows


def test_classes_equal_all_pairs(spark):
    rows = variants()
    found = {r["doc_id"]: r["class_id"] for r in N.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute(rows)


def test_given_documents(spark):
    docs = spark.read.parquet(DOCS)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert {r["doc_id"]: r["class_id"] for r in N.classes(docs).collect()} == brute(rows)


def test_open_buckets_are_settled_in_rounds(spark):
    """Short sketches put unlike texts into the same buckets; no link is lost."""
    rows = variants()
    found = {r["doc_id"]: r["class_id"] for r in N.classes(spark.createDataFrame(rows, "doc_id long, text string"), bands=24, rows=1).collect()}
    assert found == brute(rows)


def test_awkward_rows(spark):
    rows = [(None, "a b c d e f"), (1, None), (2, "a b c d e f"), (2, "a b c d e f"), (3, "A B c d e f"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, class_id string, node int")
    found = sorted(((r["doc_id"], r["class_id"]) for r in N.classes(docs).collect()), key=str)
    assert found == sorted([(None, None), (None, None), (1, 1), (2, 2), (2, 2), (3, 2)], key=str)
    stay = N.kept(docs)
    assert stay.columns == docs.columns
    assert sorted((str(r["doc_id"]) for r in stay.collect())) == ["1", "2", "None", "None"]
    assert N.classes(docs.limit(0)).count() == 0


def test_exact_similarity_and_its_estimate():
    rng = np.random.default_rng(1)
    hasher = Hasher()
    a = [f"w{i % 37}" for i in rng.integers(0, 60, 150)]
    b = list(a)
    for i in range(0, 150, 40):
        b[i] = "changed"
    s, t = hasher.shingles(" ".join(a), 5), hasher.shingles(" ".join(b), 5)
    exact = similarity(shingles(" ".join(a)), shingles(" ".join(b)))
    assert abs(N.probability_jaccard(s, t) - exact) < 1e-9
    who = N.sketches([s, t], 4096)
    assert abs((who[0] == who[1]).mean() - exact) < 0.03


def test_unlike_texts_of_one_doc_id_do_not_replace_each_other(spark):
    base = [f"w{i}" for i in range(80)]
    copy, other = " ".join([*base[:-1], "last"]), " ".join(f"v{i}" for i in range(80))
    text = " ".join(base)
    rows = [(5, text), (5, other), (3, copy), (5, other), (7, text), (7, copy)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        assert sorted(map(tuple, N.kept(docs).collect())) == [(3, copy), (5, other)]
