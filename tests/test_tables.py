"""Feeds, history, dataset, evaluation and streams on small tables."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from urlrisk.functions import ordering as O
from urlrisk.operators import dataset as D, evaluate as V, explain as X, feeds, history as H, report
from urlrisk.session import new_folder
from urlrisk.sources import feeds as R
from urlrisk.streaming import jobs


def test_first_source_wins(spark):
    one = lambda urls, name: feeds.as_feed(spark.createDataFrame([(u,) for u in urls], "url string"), name)
    merged = feeds.merge_feeds([one(["http://a.com/", "http://b.com"], "x"), one(["HTTP://A.COM", "http://c.com//"], "y"), one(["http://c.com"], "z")])
    assert sorted((r["url"], r["source"]) for r in merged.collect()) == [("http://a.com/", "x"), ("http://b.com", "x"), ("http://c.com//", "y")]


def test_ranked_filter(spark):
    df = spark.createDataFrame([(5, "good.org"), (1, "a.b"), (2, "12.34.56"), (3, "x.notgvt1.com"), (4, "fine.net"), (6, "late.org")], "rank int, domain string")
    assert [r["domain"] for r in feeds.filter_ranked(df, 2).collect()] == ["fine.net", "good.org"]


def test_missing_files(spark):
    path = new_folder(spark, "none")
    assert R.read_local_dump(spark, path, path) is None
    assert R.read_dns_cache(spark, path).count() == 0
    spark.createDataFrame([(1,)], "a int").write.option("header", True).csv(path)
    with pytest.raises(ValueError):
        R.read_features(spark, path)


def entries(spark, n):
    return spark.createDataFrame([(f"{i:03d}", f"text {i}", "text", "safe", i / 100, False, dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * (i // 2)))
                                  for i in range(n)], "id string, content string, contentType string, threatLevel string, score double, isPhishing boolean, analyzedAt timestamp")


def test_history(spark):
    table = entries(spark, 7)
    assert [r["id"] for r in H.keep_newest(table, 5).collect()] == ["006", "004", "005", "002", "003"]
    assert [r["id"] for r in H.list_newest(table, 2, 1).collect()] == ["004", "005"]
    assert H.unexpired(table, 0, "2024-02-01").count() == 7 and H.unexpired(table, 7, "2024-02-01").count() == 0
    assert H.pruned_count(table, 0, 5, "2024-02-01").first()["removed"] == 2
    assert {r["id"]: r["rowNo"] for r in H.number_newest_first(table).collect()} == {
        "006": 1, "004": 2, "005": 3, "002": 4, "003": 5, "000": 6, "001": 7}
    text = spark.createDataFrame([("z" * 60,), ("z" * 61,)], "c string").select(H.display_text(F.col("c")).alias("c")).collect()
    assert [r["c"] for r in text] == ["z" * 60, "z" * 57 + "…"]


def test_hash_zones_equal_sorting(spark):
    rows = [(i % 3 == 0, hashlib.md5(str(i).encode()).hexdigest()) for i in range(3000)]
    df = spark.createDataFrame([(int(a), h) for a, h in rows], "label int, h string")
    cuts = lambda sizes: {0: [700, 1500], 1: [10, 999]}
    for digits in (1, 3):
        got = {r["h"]: r["zone"] for r in O.hash_zones(df, "label", "h", cuts, digits=digits).collect()}
        for label, limits in ((0, [700, 1500]), (1, [10, 999])):
            ordered = sorted(h for a, h in rows if int(a) == label)
            assert all(got[h] == sum(rank > c for c in limits) for rank, h in enumerate(ordered, 1))
        assert len(got) == 3000


def test_medians_are_exact(spark):
    rng = random.Random(1)
    values = [(float(rng.choice([1, 1, 1, rng.random() * 100])), float(i) if i % 3 else None) for i in range(1001)]
    df = spark.createDataFrame(values, "a double, b double")
    import statistics
    got = {r["column"]: r["median"] for r in D.exact_medians(df, ["a", "b"], accuracy=50).collect()}
    assert got == {"a": statistics.median(v for v, _ in values), "b": statistics.median(v for _, v in values if v is not None)}


def test_prepare(spark):
    rows = [(float(i), 1.0, float(i % 2), None if i % 10 == 0 else float(i % 7), int(i % 4 == 0)) for i in range(400)] * 2
    df = spark.createDataFrame(rows, "urlLength double, isHttps double, hasAtSymbol double, digitRatio double, label int")
    out, dropped = D.prepare(df, new_folder(spark, "prepare"))
    assert dropped == ["isHttps"] and out.where("digitRatio IS NULL").count() == 0
    counts = {r["split"]: (r["phishing"], r["legitimate"]) for r in D.split_stats(out).collect()}
    assert counts == {"train": (70, 70), "val": (15, 15), "test": (15, 15)}


def test_published_counts_give_published_metrics(spark):
    counts = [(0, 0.1)] * 2453 + [(0, 0.9)] * 52 + [(1, 0.1)] * 126 + [(1, 0.9)] * 2378
    df = spark.createDataFrame(counts, "label int, score double")
    m = V.metrics(V.confusion(df)).first()
    assert [round(m[c], 5) for c in ("accuracy", "precision", "recall", "f1")] == [0.96446, 0.97860, 0.94968, 0.96392]


def test_areas_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "label int, score double")
    pos, neg = [s for l, s in rows if l], [s for l, s in rows if not l]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert V.roc_auc(df).first()[0] == pytest.approx(pairs)
    area, r0, p0 = 0.0, 0.0, 1.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
        area, r0, p0 = area + (tp / len(pos) - r0) * (tp / (tp + fp) + p0) / 2, tp / len(pos), tp / (tp + fp)
    assert V.pr_auc(df).first()[0] == pytest.approx(area)


def test_correlations(spark):
    df = spark.createDataFrame([(float(i), float(-2 * i + 7), 1.0) for i in range(20)], "a double, b double, c double")
    got = {(r["a"], r["b"]): round(r["r"], 9) for r in X.correlations(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == -1.0 and got[("b", "a")] == -1.0 and got[("a", "c")] == 0.0 and got[("c", "c")] == 0.0


def test_metadata_and_summary(spark):
    df = spark.createDataFrame([("x", "done", "safe"), ("y", "error", None), ("x", "done", "critical")], "category string, status string, threatLevel string")
    assert sorted((r["item"], r["value"] or "", r["n"]) for r in report.dataset_metadata(df, "category").collect()) == [
        ("category", "x", 2), ("category", "y", 1), ("total", "", 3)]
    s = report.batch_summary(df).first()
    assert (s["safe"], s["suspicious"], s["critical"], s["failed"], s["completed"], s["total"]) == (1, 0, 1, 1, 3, 3)


def test_stream_counts_equal_batch_for_closed_windows(spark):
    source, out, checkpoint = (new_folder(spark, n) for n in ("s", "o", "c"))
    table = entries(spark, 40).select("threatLevel", "analyzedAt")
    table.write.parquet(source)
    stream = spark.readStream.schema(table.schema).parquet(source)
    jobs.append_stream(jobs.level_counts(stream), out, checkpoint).awaitTermination()
    streamed = {r["windowStart"]: r["total"] for r in spark.read.parquet(out).collect()}
    batch = {r["windowStart"]: r["total"] for r in jobs.level_counts(table).collect()}
    assert streamed and all(batch[w] == n for w, n in streamed.items())
