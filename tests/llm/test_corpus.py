"""Language ID, decontamination, mixture, shards and nearest neighbours next to brute force, and their awkward rows."""

import os
import random
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import compare, duck  # noqa: E402
from pyspark.sql import functions as F

from urlrisk.llm import ann, decontaminate, language_id, mixture, shards
from urlrisk.llm.common import Letters
from urlrisk.llm.queries import QUERIES
from urlrisk.llm.words import Hasher, windows

FOLDER = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size int, cell string"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql and n != "op10_licenses"])
def test_same_rows_as_sql(spark, con, name):
    ok, _, info = compare(spark, con, FOLDER, name, QUERIES[name])
    assert ok, info


# Language ID

def plain_counts(text):
    spaced = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    out = {}
    for n in (1, 2, 3):
        for i in range(len(spaced) - n + 1):
            g = spaced[i:i + n]
            if g != " " and " " not in g[1:-1]:
                out[g] = out.get(g, 0) + 1
    return out


def test_gram_counts_in_pieces(monkeypatch):
    rng = random.Random(4)
    letters = Letters(str.isalpha)
    for size in (3, 7, 50):
        monkeypatch.setattr(language_id, "PIECE", size)
        for _ in range(60):
            text = "".join(rng.choice("aBé 𝒳-1\nß") for _ in range(rng.randrange(0, 120)))
            keys, n = language_id.gram_counts(text, letters)
            grams = ["".join(chr(k >> s & 0x1FFFFF) for s in (42, 21, 0) if k >> s & 0x1FFFFF) for k in keys.tolist()]
            assert dict(zip(grams, n.tolist())) == (plain_counts(text) if any(c.isalpha() for c in text) else {})
            assert grams == sorted(grams)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = QUERIES["op4_language_id"].run(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 150 and right > 0.97


def test_language_of_awkward_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (None, None, None), (3, "", "en"), (4, "12 !!", "de"), (5, "und der", None), (5, "und der", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    found = language_id.identify(docs, language_id.learned(docs), score="s")
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "s"]
    got = sorted(((r["text"] or "", r["lang_pred"], r["s"]) for r in found.collect()))
    assert [g[1] for g in got] == ["und", "und", "und", "de", "en", "de", "de"] and all(0 <= g[2] <= 1 for g in got)
    assert language_id.learned(docs.limit(0)) == []
    assert {r["lang_pred"] for r in language_id.identify(docs, []).collect()} == {"und"}


# Decontamination

def plain_tiles(p, t, seed):
    free_p, free_t, out = [True] * len(p), [True] * len(t), []
    seed = max(1, min(seed, len(p)))
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and free_p[i + n] and free_t[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < seed:
            return out
        free_p[i:i + n] = [False] * n
        free_t[j:j + n] = [False] * n
        out.append(best)


def test_tiling_is_the_greedy_one():
    rng = np.random.default_rng(6)
    for _ in range(60):
        p, t = rng.integers(1, 4, rng.integers(1, 40)).astype(np.uint64), rng.integers(1, 4, rng.integers(1, 90)).astype(np.uint64)
        if rng.random() < 0.5 and len(p) > 4:
            cut = len(p) // 2
            t = np.concatenate([t, p[cut:], t[:3], p[:cut]])
        for seed in (2, 3, 5):
            assert decontaminate.tiles(p, t, seed) == plain_tiles(p.tolist(), t.tolist(), seed)


def test_windows_name_equal_runs():
    w = np.random.default_rng(0).integers(0, 3, 200).astype(np.uint64)
    for size in (1, 2, 3, 5, 8, 21):
        names = {}
        for i, h in enumerate(windows(w, size).tolist()):
            names.setdefault(tuple(w[i:i + size].tolist()), set()).add(h)
        assert all(len(v) == 1 for v in names.values()) and len({min(v) for v in names.values()}) == len(names)
    assert len(windows(w[:3], 5)) == 0


def test_contaminations(spark):
    words = [f"w{i}" for i in range(400)]
    item = words[:40]
    texts = [" ".join(words[100:150] + item + words[200:250]), " ".join(words[100:150] + item[20:] + words[200:210] + item[:20]), " ".join(words[100:130] + item[:15] + words[300:320]),
             " ".join(words[100:300]), "", None, "Short ITEM, here", " ".join(item[:19]), " ".join(item[:20])]
    docs = spark.createDataFrame([(i, t, "a", 5) for i, t in enumerate(texts)], "doc_id long, text string, item_id string, coverage int")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "short item here"), (3, None), (None, "..."), (4, " ".join(item).upper())], "item_id long, text string")
    want = {(0, 1), (1, 1), (0, 4), (1, 4), (6, 2), (8, 1), (8, 4)}
    for block in (1 << 20, 4):
        found = decontaminate.contaminations(docs, bench, block=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(found) == len(want)
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == set(range(9)) - {d for d, _ in want}
    assert decontaminate.clean(docs, bench).columns == docs.columns
    assert decontaminate.clean(docs, bench.limit(0)).count() == 9 and decontaminate.contaminations(docs.limit(0), bench).count() == 0


def test_contaminations_of_given_documents(spark):
    docs, bench = (spark.read.parquet(f"{FOLDER}/{t}.parquet").select(i, "text").collect() for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    hasher = Hasher()
    items = [(b[0], hasher.words(b[1]).tolist()) for b in bench]
    want = set()
    for d, text in docs:
        words = hasher.words(text).tolist()
        grams = {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
        for b, item in items:
            if grams & {tuple(item[i:i + 5]) for i in range(len(item) - 4)} and 2 * sum(t[0] for t in plain_tiles(item, words, 5)) >= len(item):
                want.add((d, b))
    assert {(r["doc_id"], r["item_id"]) for r in QUERIES["op5_decontamination"].run(spark, FOLDER).collect()} == want


# Mixture

def awkward(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (None, "d e f g", None), (None, None, None), (4, "h " * 900, "y"), (5, "i j", "z"), (6, "k", "é")]
    return spark.createDataFrame([(i, t, None, s, None, 7, "c") for i, t, s in rows], DOCUMENTS)


def test_targets_fill_up():
    rng = random.Random(8)
    for _ in range(200):
        sizes = [rng.choice([0, rng.randrange(1, 50), rng.randrange(1, 10000)]) for _ in range(rng.randrange(1, 12))]
        weights = [rng.choice([5, 2, 1]) for _ in sizes]
        t, total = [0.0] * len(sizes), float(sum(sizes))
        shared, left = set(range(len(sizes))), total
        while shared:  # share, stop at three times, share the excess again
            share = {k: left * weights[k] / sum(weights[j] for j in shared) for k in shared}
            over = {k for k in shared if share[k] > 3 * sizes[k] + 1e-9}
            for k in over or shared:
                t[k] = min(share[k], 3.0 * sizes[k])
            left -= sum(3.0 * sizes[k] for k in over)
            shared = shared - over if over else set()
        got = mixture.targets(sizes, weights)
        assert np.allclose(got, t, atol=1e-6) and abs(sum(got) - total) < 1e-6 * max(1, total)


def test_schedule_is_even_and_ranked(spark):
    shares = [500.0, 300.0, 0.0, 200.0]
    rows = mixture.schedule(spark, 70_000, mixture.bounds(shares)).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(70_000))
    seen = [0] * 4
    for i, r in enumerate(rows, 1):
        assert r["rank"] == seen[r["source_no"]]
        seen[r["source_no"]] += 1
        if i % 500 == 0:
            assert all(abs(n - i * s / 1000) < 8 for n, s in zip(seen, shares))


def test_mix_takes_what_it_says(spark):
    docs = awkward(spark)
    taken = mixture.take(docs, block=4).collect()
    assert len(taken) == 9
    pieces = mixture.mix(docs, block=4).collect()
    by_text = {}
    for p in pieces:
        assert 0 <= p["begin"] < p["end"] <= len(p["row"]["text"].split()) and p["end"] - p["begin"] <= 4
        by_text[p["row"]["text"]] = by_text.get(p["row"]["text"], 0) + p["end"] - p["begin"]
    want = {}
    for r in taken:
        assert r["size"] == len((r["row"]["text"] or "").split()) and 0 <= r["taken"] <= 3 * r["size"]
        if r["taken"]:
            want[r["row"]["text"]] = want.get(r["row"]["text"], 0) + r["taken"]
    assert by_text == want
    whole = mixture.whole_documents(docs)
    assert whole.columns == docs.columns
    assert mixture.take(docs.limit(0)).count() == 0 and mixture.take(docs.where("text IS NULL")).count() == 2


def test_taken_is_near_target_and_repeats(spark):
    found = QUERIES["op7_mixture"].run(spark, FOLDER)
    sums = found.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 160 for r in sums)
    again = QUERIES["op7_mixture"].run(spark, FOLDER)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, again.collect()))


# Shards

def test_longest_first():
    assert shards.longest_first([("a", 5), ("b", 4), ("c", 3), ("d", 3), ("e", 3)], 2) == [("a", 0), ("b", 1), ("c", 1), ("d", 0), ("e", 1)]


def test_shards_hold_groups_and_number_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").unionByName(awkward(spark).drop("size", "cell"))
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    found = shards.assign(docs).collect()
    assert len(found) == docs.count()
    by_shard, of_crc = {}, {}
    for r in found:
        assert (r["size"], r["text_crc32"]) in [(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts[r["doc_id"]]]
        by_shard.setdefault(r["shard"], []).append(r)
        assert of_crc.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"]
    loads = [sum(r["size"] for r in by_shard.get(s, [])) for s in range(16)]
    largest = max(r["size"] for r in found)
    assert max(loads) - min(loads) <= largest
    for rows in by_shard.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert shards.assign(docs.limit(0)).count() == 0


def test_bundles_balance_small_groups(spark):
    docs = spark.range(30_000).select("id", F.concat(F.lit("t"), F.col("id").cast("string"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int"))).alias("body"))
    docs = docs.unionByName(spark.range(15_000).select("id", F.lit("copy of it").alias("body")))
    loads = {r[0]: r[1] for r in shards.assign(docs, doc_id="id", text="body").groupBy("shard").sum("size").collect()}
    hot = 15_000 * 11
    rest = sorted(loads.values())
    assert rest[-1] == hot and rest[-2] - rest[0] <= 1500


# Nearest neighbours

def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 70))
    x[300:420] = x[5]  # ties
    rows = [(i, [float(v) for v in line]) for i, line in enumerate(x)]
    bad = [(900, None), (901, [0.0] * 70), (902, [float("nan")] * 70), (903, [1.0] * 3), (920, [None] * 70), (None, rows[0][1]), (0, rows[0][1]), (940, [float("inf")] + [1.0] * 69)]
    vectors = spark.createDataFrame([(*r, 1.0) for r in rows + bad], "vec_id long, embedding array<double>, norm double")
    coded, size = ann.index(vectors)
    found = {}
    for r in ann.search(coded, size, F.col("vec_id") % 20 == 0, block=16).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 700, 20))
    hits = 0
    for q, got in found.items():
        scores = x @ x[q]
        best = sorted((i for i in range(700) if i != q), key=lambda i: (-np.float64(np.einsum("j,j->", x[i], x[q])), i))[:20]
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21)) and all(abs(scores[v] - s) < 1e-9 for _, v, s in got)
        hits += len({v for _, v, _ in got} & set(best))
    assert hits >= 0.98 * 20 * len(found)
    empty, size = ann.index(vectors.limit(0))
    assert ann.search(empty, size, F.col("vec_id") % 20 == 0).count() == 0
    few, size = ann.index(vectors.where("vec_id < 3"))
    assert ann.search(few, size, F.col("vec_id") == 0).count() == 2


def test_recall_on_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = vectors.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    coded, size = ann.index(vectors)
    found = {(r["query_id"], r["vec_id"]) for r in ann.search(coded, size, F.col("vec_id") % 20 == 0).collect()}
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        scores[q] = -np.inf
        for i in np.argsort(-scores)[:20]:
            hits += (ids[q], ids[i]) in found
            total += 1
    assert hits >= 0.99 * total
