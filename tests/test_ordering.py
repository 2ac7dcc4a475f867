"""Numbering, running sums and cuts keep every row, also those without a time, score, key or label."""

import datetime as dt

from pyspark.sql import functions as F

from urlrisk.functions import ordering as O
from urlrisk.operators import dataset, feeds, history as H
from urlrisk.sources import sinks


def entries(spark):
    rows = [(f"{i:03d}" if i % 9 else None, f"c{i}", "text", "safe", 0.1, False,
             None if i % 7 == 3 else dt.datetime(2024, 1, 1 + i % 3, 5, 0, 0)) for i in range(60)]
    return spark.createDataFrame(rows, "id string, content string, contentType string, threatLevel string, score double, isPhishing boolean, analyzedAt timestamp")


def test_newest_first_numbers_every_row(spark):
    table = entries(spark)
    rows = H.number_newest_first(table).orderBy("rowNo").collect()
    assert [r["rowNo"] for r in rows] == list(range(1, 61))
    known = [r["analyzedAt"] for r in rows if r["analyzedAt"]]
    assert known == sorted(known, reverse=True) and all(r["analyzedAt"] is None for r in rows[len(known):])
    assert sinks.history_export(table).count() == 60


def test_curated_rows_without_a_key_are_numbered(spark):
    rows = [(f"http://a{i}.com/x", None if i % 4 == 0 else i * 3_000_000) for i in range(40)]
    out = feeds.curated_legitimate(spark.createDataFrame(rows, "url string, k long"), "k").collect()
    assert sorted(r["id"] for r in out) == list(range(1, 41))


def test_running_sums_with_a_null_key(spark):
    df = spark.createDataFrame([(None, 5), (0.25, 1), (0.5, 2), (0.75, 4)], "score double, n long")
    for partitions in (None, 1, 3):
        got = O.running_sums(df, [F.col("score")], ["n"], partitions).collect()
        assert sorted((r["score"] or 0, r["cum_n"]) for r in got) == [(0, 5), (0.25, 6), (0.5, 8), (0.75, 12)]


def in_tasks(spark, rows):
    """Rows of each range."""
    return [r["n"] for r in rows.groupBy("_range").agg(F.count("*").alias("n")).collect()]


def test_scores_of_any_size_and_one_rank_are_split(spark):
    """Scores up to 1e9, one constant rank, and rows that are equal throughout: no range holds more than half."""
    wide = spark.range(20_000).select((F.pow(F.lit(10.0), F.col("id") % 10) * (1 + F.col("id") / 1e6)).alias("score"))
    one = spark.range(20_000).select(F.lit(0).alias("score"), F.concat(F.lit("http://a/"), F.col("id").cast("string")).alias("url"))
    same = spark.range(20_000).select(F.lit(1).alias("score"), F.lit("x").alias("url"))
    for df in (wide, one, same):
        sizes = in_tasks(spark, O.in_ranges(df, [F.col("score")], partitions=8))
        assert sum(sizes) == 20_000 and len(sizes) > 4 and max(sizes) < 10_000
        assert sorted(r["no"] for r in O.row_numbers(df, [F.col("score")], "no", partitions=8).collect()) == list(range(1, 20_001))


def test_numbers_follow_the_order(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 50).alias("k"))
    rows = O.row_numbers(df, [F.col("k").desc(), F.col("id")], "no", partitions=7).orderBy("no").collect()
    assert [(r["k"], r["id"]) for r in rows] == sorted(((i % 50, i) for i in range(5000)), key=lambda r: (-r[0], r[1]))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "score double, n long")
    assert O.row_numbers(none, [F.col("score")], "no").count() == 0 == O.running_sums(none, [F.col("score")], ["n"]).count()
    assert O.hash_zones(spark.createDataFrame([], "label int, h string"), "label", "h", lambda rows: {k: [1] for k in rows}).count() == 0


def test_cuts_are_exact_in_every_group(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, None).otherwise((F.col("id") % 3).cast("int")).alias("label"), F.md5(F.col("id").cast("string")).alias("h"))
    ranks = {}
    for r in sorted(df.collect(), key=lambda r: r["h"]):
        ranks.setdefault(r["label"], []).append(r["id"])
    out = O.hash_zones(df, "label", "h", lambda rows: {k: [0, 1, n // 2, n, n + 9] for k, n in rows.items()}).collect()
    assert len(out) == 1000
    for r in out:
        rank, n = ranks[r["label"]].index(r["id"]) + 1, len(ranks[r["label"]])
        assert r["zone"] == sum(rank > c for c in (0, 1, n // 2, n, n + 9))


def test_medians_narrow_until_few_values_are_left(spark):
    """Distinct doubles, many more than one task may hold, and values that repeat."""
    from urlrisk.operators.dataset import exact_medians
    df = spark.range(30_001).select(F.hash("id").cast("double").alias("a"), (F.hash("id") % 3).alias("b"), F.when(F.col("id") < 4, F.col("id") * 1.0).alias("c"),
                                    F.lit(None).cast("double").alias("d"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.col("id") * 2.0).alias("e"))
    want = df.agg(*[F.median(c).alias(c) for c in "abcde"]).first().asDict()
    for most, accuracy in ((100_000, 10_000), (50, 20), (1, 10)):
        got = {r["column"]: r["median"] for r in exact_medians(df, list("abcde"), accuracy, most).collect()}
        assert got == {c: want[c] for c in "abce"}


def test_split_and_balance_keep_rows_without_a_label(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("row_key"), F.when(F.col("id") < 10, None).otherwise((F.col("id") % 2).cast("int")).alias("label"))
    assert dataset.split(df).count() == 100
    assert {r["label"]: r["count"] for r in dataset.balance(df).groupBy("label").count().collect()} == {None: 10, 0: 10, 1: 10}


def test_retention_reads_needed_dates_only(spark, tmp_path):
    H.append(entries(spark).withColumn("date", F.to_date("analyzedAt")), str(tmp_path / "h"))
    plan = H.unexpired(spark.read.parquet(str(tmp_path / "h")), 1, "2024-01-03")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
