"""Streams that stop, go on, and run a batch again."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from compare import compare, duck
from urlrisk.catalog import load
from urlrisk.catalog.osint_queries import bundle
from urlrisk.operators import history_table as T, versions as V
from urlrisk.session import new_folder
from urlrisk.streaming import jobs

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
QUERIES = load()


@pytest.mark.parametrize("name", ("str_03_level_counts_stream", "str_03_level_counts_stream_all"))
def test_stored_windows_are_all_windows(spark, name):
    assert QUERIES[name].sql == QUERIES["str_03_level_counts"].sql
    ok, n, info = compare(spark, duck(FOLDER), FOLDER, name, QUERIES[name])
    assert ok, info
    assert n == QUERIES["str_03_level_counts"].run(spark, FOLDER).count()


def crash(checkpoint):
    """Forget that the last batch was done, as after a crash between its write and its mark."""
    done = [int(f) for f in os.listdir(f"{checkpoint}/commits") if f.isdigit()]
    for name in (f"{max(done)}", f".{max(done)}.crc"):
        if os.path.exists(path := f"{checkpoint}/commits/{name}"):
            os.remove(path)
    return max(done)


def messages(spark, ids, domain="known.com"):
    return spark.createDataFrame([(f"m{i}", f"https://{domain}/login?x={i}", "url", dt.datetime(2024, 1, 1 + i % 3, 5)) for i in ids],
                                 "msg_id string, content string, content_type string, received timestamp")


def rows(spark, root):
    return sorted((r["id"], r["threatLevel"], r["score"], r["response"]) for r in T.read(spark, root).collect())


def test_batch_that_runs_again_adds_nothing(spark):
    source, root, checkpoint = (new_folder(spark, n) for n in ("in", "history", "checkpoint"))
    stream = lambda: jobs.read_messages(spark, source, f"{jobs.MESSAGE_SCHEMA}, received timestamp")
    known = bundle(spark, FOLDER)
    run = lambda: jobs.score_into_history(stream(), lambda s: known, root, checkpoint, "received").awaitTermination()
    for part in range(2):
        messages(spark, range(20 * part, 20 * part + 20)).write.mode("append").parquet(source)
        run()
    first = rows(spark, root)
    assert len(first) == 40 and len({r[0] for r in first}) == 40
    assert crash(checkpoint) == 1
    run()
    assert rows(spark, root) == first
    assert crash(checkpoint) == 1
    messages(spark, range(40, 45)).write.mode("append").parquet(source)  # more has landed since
    run()
    assert len(rows(spark, root)) == 45


def test_batch_that_failed_before_its_commit_runs_whole(spark):
    source, root, checkpoint = (new_folder(spark, n) for n in ("in", "history", "checkpoint"))
    messages(spark, range(10)).write.parquet(source)
    known, calls = bundle(spark, FOLDER), []

    def lost(session):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return known

    run = lambda: jobs.score_into_history(jobs.read_messages(spark, source, f"{jobs.MESSAGE_SCHEMA}, received timestamp"), lost, root, checkpoint, "received").awaitTermination()
    with pytest.raises(Exception, match="lost"):
        run()
    assert T.read(spark, root).count() == 0
    run()
    assert T.read(spark, root).count() == 10


def test_bundle_is_read_for_every_batch(spark):
    """A domain that becomes known while the stream runs is seen by the next batch."""
    source, root, checkpoint, known = (new_folder(spark, n) for n in ("in", "history", "checkpoint", "bundle"))
    whole = bundle(spark, FOLDER)
    domain = whole.where("hasReputation AND hasDns").agg(F.min("domain")).first()[0]
    for part in range(3):
        messages(spark, [part], domain).coalesce(1).write.mode("append").parquet(source)
    whole.where(F.col("domain") != domain).write.parquet(known)
    seen = []

    def read(session):
        if len(seen) == 1:
            whole.where(F.col("domain") == domain).write.mode("append").parquet(known)
        seen.append(1)
        return session.read.parquet(known)

    stream = jobs.read_messages(spark, source, f"{jobs.MESSAGE_SCHEMA}, received timestamp", files_per_trigger=1)
    jobs.score_into_history(stream, read, root, checkpoint, "received").awaitTermination()
    got = [r["known"] for r in T.read(spark, root).select(F.get_json_object("response", "$.hasValidDns").alias("known")).collect()]
    assert len(seen) == 3 and sorted(got) == ["false", "true", "true"]


def test_time_of_the_batch_where_messages_have_none(spark):
    source, root, checkpoint = (new_folder(spark, n) for n in ("in", "history", "checkpoint"))
    messages(spark, range(4)).drop("received").write.parquet(source)
    known = bundle(spark, FOLDER)
    run = lambda: jobs.score_into_history(jobs.read_messages(spark, source), lambda s: known, root, checkpoint).awaitTermination()
    run()
    first = rows(spark, root)
    crash(checkpoint)
    run()
    assert rows(spark, root) == first and len(first) == 4


def test_equal_messages_of_one_instant_are_two_rows(spark):
    both = messages(spark, [1, 4]).withColumn("content", F.lit("https://known.com/a")).withColumn("received", F.lit("2024-01-01").cast("timestamp"))
    assert T.scored_entries(both, bundle(spark, FOLDER), "received").select("id").distinct().count() == 2


def test_counts_of_a_batch_that_runs_again(spark):
    source, root, checkpoint = (new_folder(spark, n) for n in ("in", "counts", "checkpoint"))
    scored = lambda hours: spark.createDataFrame([("safe" if h % 2 else "critical", dt.datetime(2024, 1, 1, h, 30)) for h in hours], "threatLevel string, analyzedAt timestamp")
    run = lambda: jobs.count_into_table(spark.readStream.schema("threatLevel string, analyzedAt timestamp").parquet(source), root, checkpoint).awaitTermination()
    got = lambda: sorted((r["windowStart"].hour, r["safe"], r["critical"], r["total"]) for r in jobs.stored_level_counts(spark, root).collect())
    for hours in ([1, 1, 2], [2, 3, 3, 3]):
        scored(hours).write.mode("append").parquet(source)
        run()
    want = [(1, 2, 0, 2), (2, 0, 2, 2), (3, 3, 0, 3)]
    assert got() == want
    crash(checkpoint)
    run()
    assert got() == want
    assert jobs.compact_level_counts(spark, root, "c", most=1) is True and got() == want
    assert V.live(spark, root).count() == 1
