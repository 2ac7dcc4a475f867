"""Phrases next to counting everything, on given documents and awkward texts."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from urlrisk.llm import collocations as C, sql
from urlrisk.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, lang string, text string, phrase string, n long"


def brute(docs, support=10, limit=2000):
    counts, total = {1: Counter(), 2: Counter(), 3: Counter()}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split("[ \t]", piece) if w]
            total[lang] += len(words)
            for k in counts:
                counts[k].update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    f = lambda lang, *words: counts[len(words)][lang, *words]
    rows = []
    for k in (2, 3):
        for (lang, *words), a in counts[k].items():
            if a < support:
                continue
            if k == 2 and any(100 * n >= 50 * a for n in LONGER(counts, support).get((lang, *words), ())):
                continue
            cuts = [(1000000 * a * a // (f(lang, *words[:c]) * f(lang, *words[c:])), c) for c in range(1, k)]
            score, c = min(cuts)
            rows.append((lang, " ".join(words), a, f(lang, *words[:c]), f(lang, *words[c:]), total[lang], score))
    rows.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    out, rank = [], Counter()
    for lang, phrase, a, l, r, n, score in rows:
        rank[lang] += 1
        if rank[lang] <= limit:
            out.append((lang, rank[lang], phrase, a, l, r, n, score))
    return sorted(out)


def LONGER(counts, support, known={}):
    """Counts of the frequent triples around each pair."""
    if known.get("of") is not counts:
        around = {}
        for (lang, *w), n in counts[3].items():
            if n >= support:
                for pair in (w[:2], w[1:]):
                    around.setdefault((lang, *pair), []).append(n)
        known.update({"of": counts, "around": around})
    return known["around"]


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def frame(spark, docs):
    return spark.createDataFrame([(i % 50, lang, text, "x", 1) for i, (lang, text) in enumerate(docs)], SCHEMA).repartition(4)


def made(n=400, seed=1):
    draw = random.Random(seed)
    words = ["Alpha", "beta", "gamma's", "été", "(x)", "of", "the", "of the", "a b", "k\x00"] + [f"w{i}" for i in range(60)]
    weights = [9, 8, 7, 6, 5, 9, 9, 5, 3, 2] + [1] * 60
    text = lambda: "".join(w + draw.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!", ";x "]) for w in draw.choices(words, weights, k=draw.randint(0, 60)))
    docs = [(draw.choice(["en", "en", "de", None, "und", ""]), text()) for _ in range(n)]
    copy = "one very common passage that stands in many documents and is never cut"
    return docs + [("en", copy)] * 30 + [("fr", copy + ". " + copy)] * 6 + [(None, None), ("en", ""), ("en", " . ,!"), ("de", "alone")]


def test_awkward_texts(spark):
    docs = made()
    assert found(C.collocations(frame(spark, docs))) == brute(docs)


@pytest.mark.parametrize("fraction, least", [(0.0, 1), (1.0, 10), (0.05, 1), (0.3, 40)])
def test_any_sample_gives_the_same(spark, fraction, least):
    """An empty, a whole and a misleading sample: border failures are expanded until the counts are closed."""
    docs = made(250, 2)
    assert found(C.collocations(frame(spark, docs), fraction=fraction, sample_least=least, support=4, limit=60)) == brute(docs, 4, 60)


def test_passes_end_when_no_failure_is_left(spark):
    docs = frame(spark, made(250, 3))
    texts = C._texts(docs, "text", "lang")
    assert C.frequent(texts, 5, fraction=1.0, sample_least=5)[1] == 1
    assert C.frequent(texts, 5, fraction=0.0, sample_least=1)[1] == 3


def test_shared_hashes_begin_again(spark, monkeypatch):
    """Words that share their first hash are noticed, and another seed is used."""
    plain, docs = C.Hasher.__call__, made(120, 4)

    def weak(self, raw):
        first, *rest = plain(self, raw)
        return (first % 50 if self.weak else first), *rest

    init = C.Hasher.__init__
    monkeypatch.setattr(C.Hasher, "__init__", lambda self, seed: (init(self, seed), setattr(self, "weak", seed == 0))[0])
    monkeypatch.setattr(C.Hasher, "__call__", weak)
    with pytest.raises(C.SharedHash):
        C.frequent(C._texts(frame(spark, docs), "text", "lang"), 5)
    assert found(C.collocations(frame(spark, docs), support=5)) == brute(docs, 5)


def test_counts_do_not_depend_on_pieces(monkeypatch):
    """A long text that is hashed and counted in many parts keeps the phrases across their ends."""
    import pyarrow as pa
    draw = random.Random(6)
    text = "".join(draw.choice(["a", "b", "cc", "ddd"]) + draw.choice([" ", " ", "  ", "\t", ".", "\n "]) for _ in range(3000)) + "x" * 500
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"], "text": [text.encode(), b"a b cc"]})

    def counts():
        maps = C.Maps(*(np.full(C.BITS // 64, ~np.uint64(0)) for _ in range(2)))
        total = Counter()
        for lang, words in C.read(iter([batch]), 0):
            for row in C.counted(words, [maps]):
                n = len(row["n"])
                for key in zip(*(np.broadcast_to(row.get(c, 0), n).tolist() for c in ("size", "a", "b", "c", "n"))):
                    total[lang, *key[:4]] += key[4]
        return +total

    whole = counts()
    assert {k[1] for k in whole} == {1, 2, 3}
    for piece, words in ((64, 50), (7, 3), (1 << 20, 10)):
        monkeypatch.setattr(C, "PIECE", piece)
        monkeypatch.setattr(C, "WORDS", words)
        assert counts() == whole


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000
    df = spark.createDataFrame([(big, big + 1, big + 7), (10, 10, 10), (10, 3, 7)], "a long, l long, r long")
    assert [r[0] for r in df.select(C._score("a", "l", "r")).collect()] == [1000000 * a * a // (l * r) for a, l, r in ((big, big + 1, big + 7), (10, 10, 10), (10, 3, 7))]


def test_ties_at_the_limit(spark):
    """More equal phrases than the limit: the first by their bytes."""
    docs = [("en", f"p{i:03d} q{i:03d}. é{i} z{i}") for i in range(40) for _ in range(10)]
    assert found(C.collocations(frame(spark, docs), limit=25)) == brute(docs, limit=25)


def test_empty_table(spark):
    assert found(C.collocations(frame(spark, [("en", "a b")]).limit(0))) == []


def test_query_and_sql_on_given_documents(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    got = found(QUERIES["op13_collocations"].run(spark, FOLDER))
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert got == brute(docs) == sorted(con.execute(sql.COLLOCATIONS).fetchall())
    assert len(got) > 100


def test_no_stage_runs_two_python_workers_for_a_task(spark, monkeypatch):
    plans, maps = [], C.bit_maps
    monkeypatch.setattr(C, "bit_maps", lambda found: plans.append(found._jdf.queryExecution().executedPlan().toString()) or maps(found))
    docs = spark.createDataFrame([("a b c. a b d",)] * 20, "text string").withColumn("lang", F.lit("en"))
    found, _ = C.frequent(C._texts(docs, "text", "lang"), fraction=1.0)
    assert {(r["size"], r["n"]) for r in found.collect()} == {(0, 120), (1, 40), (1, 20), (2, 40), (2, 20), (3, 20)}
    assert plans and not any("InArrow" in p for p in plans)
