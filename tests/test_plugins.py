"""Replaceable parts: sources, analysers, limits; records and counters beside them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from urlrisk import rules
from urlrisk.catalog.osint_queries import bundle
from urlrisk.operators import enrich as E, score as S, text as T
from urlrisk.plans import scoring
from urlrisk.plans.analysers import OUTPUT, checked, word_analyser
from urlrisk.session import new_folder
from urlrisk.sources import plugin as P, sinks

FOLDER = "/root/testdata/sf0.001"


class Made(P.SnapshotSource):
    """Two parts of DNS rows."""

    kind = "dns"

    def partitions(self):
        return range(2)

    def read(self, part):
        yield {"domain": f"d{part}.com", "rtype": "A", "value": "10.0.0.1", "ttl": 60}
        if self.options.get("fault") == "type":
            yield {"domain": "x.com", "ttl": "long"}
        if self.options.get("fault") == "column":
            yield {"domain": "x.com", "colour": "red"}


def test_source_is_read_in_parts_and_checked(spark):
    P.cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])
    P.register(spark, "made", Made)
    rows = spark.read.format("made").load()
    assert rows.rdd.getNumPartitions() == 2 and [n for n, _ in rows.dtypes] == [c for c, _ in P.columns("dns")]
    assert {(r["domain"], r["ttl"], r["priority"], r["status"]) for r in rows.collect()} == {("d0.com", 60, None, None), ("d1.com", 60, None, None)}
    assert {r["nA"] for r in E.dns_summary(rows).collect()} == {1}
    for fault, says in (("type", "ttl is 'long', not int"), ("column", "unknown columns")):
        with pytest.raises(Exception, match=says):
            spark.read.format("made").option("fault", fault).load().collect()
    with pytest.raises(ValueError, match="kind"):
        P.register(spark, "other", type("Other", (P.SnapshotSource,), {"kind": "weather"}))


def test_values_of_a_row():
    wanted = P.columns("whois")
    assert P.checked({"domain": "a", "emails": ["x", None]}, wanted, "s")[0] == "a"
    for bad in ({"emails": "x"}, {"emails": [1]}, {"domain": 5}):
        with pytest.raises(ValueError):
            P.checked(bad, wanted, "s")
    with pytest.raises(ValueError):
        P.checked({"ttl": True}, P.columns("dns"), "s")


def test_analyser_without_its_columns_is_refused(spark):
    messages = spark.createDataFrame([("m", "Act now", "text")], "msg_id string, content string, content_type string")
    known = bundle(spark, FOLDER)
    score = lambda analyser: scoring.score_messages(messages, known, analyser=analyser)
    with pytest.raises(ValueError, match="textConfidence is missing"):
        score(lambda df, text, kind: T.text_analysis(df, text, kind).drop("textConfidence"))
    with pytest.raises(ValueError, match="indicatorCount is string"):
        score(lambda df, text, kind: T.text_analysis(df, text, kind).withColumn("indicatorCount", F.lit("many")))
    with pytest.raises(ValueError, match="kind is missing"):
        score(lambda df, text, kind: T.text_analysis(df, text, kind).drop("kind"))
    row = score(word_analyser({"act now": 0.9})).first()
    assert row["detectedTactics"] == ["urgency_pressure"] and row["textFeatures"] == 1


def test_built_in_analyser_has_the_output(spark):
    df = spark.createDataFrame([("Act now", "text")], "content string, kind string")
    assert set(OUTPUT) <= set(checked(T.text_analysis)(df, "content", "kind").columns)


def test_limits(spark):
    """``None`` shows all reasons; the fixed values cut them."""
    text = "Act now! Urgent. Verify your password. Click here. You have won. Attached invoice.exe from PayPal support team http://10.0.0.1/a"
    messages = spark.createDataFrame([("m", text, "text")], "msg_id string, content string, content_type string")
    known = bundle(spark, FOLDER)
    few = scoring.score_messages(messages, known, limits=S.Limits(verdict=1)).first()["reasons"]
    fixed = scoring.score_messages(messages, known).first()["reasons"]
    everything = scoring.score_messages(messages, known, limits=S.Limits(None, None, None, None)).first()["reasons"]
    assert len(few) == 1 and everything[:len(fixed)] == fixed and len(fixed) <= rules.VERDICT_REASONS
    df = spark.createDataFrame([(text,)], "content string")
    whole = T.text_analysis(df, most=None).first()["textReasons"]
    assert T.text_analysis(df, most=2).first()["textReasons"] == whole[:2] and len(whole) > 2


def test_record_sets_are_bounded_and_complete(spark):
    rows = [("a.com", "MX", f"mx{i}", "success", 60 * i, i % 4 or None) for i in range(30)] + [("a.com", "MX", "mx3", "success", 9999, 3)]
    rows += [("a.com", "A", None, "success", 1, None), ("a.com", "A", "1.1.1.1", "timeout", 1, None), ("b.com", "TXT", "x", None, None, None), (None, "A", "2.2.2.2", None, 5, None)]
    df = spark.createDataFrame(rows, "domain string, rtype string, value string, status string, ttl int, priority int")
    sets = {(r["domain"], r["rtype"]): r for r in E.dns_record_sets(df, 5).collect()}
    assert set(sets) == {("a.com", "MX"), ("b.com", "TXT")} | {k for k in sets if k[0] is None}
    mx = sets["a.com", "MX"]
    assert mx["nRecords"] == 30 and [r["priority"] for r in mx["records"]] == [0] * 5
    whole = {(r["domain"], r["rtype"]): r for r in E.dns_record_sets(df, None).collect()}["a.com", "MX"]["records"]
    assert len(whole) == 30 and whole[:5] == mx["records"] and [r["ttl"] for r in whole if r["value"] == "mx3"] == [9999]
    assert E.dns_records(df).where("value = 'x'").first()["priority"] is None


def test_hot_bucket_runs_in_several_tasks(spark):
    """One key, all rows in one hour, many at one instant: ranges share them, and every event finds its snapshot."""
    draw = random.Random(5)
    start = dt.datetime(2024, 1, 1, 7)
    at = lambda: start + dt.timedelta(seconds=draw.randrange(600))
    events = [(i, "hot", at()) for i in range(4000)] + [(9000 + i, "hot", start + dt.timedelta(seconds=300)) for i in range(2000)]
    events += [(20_000, "hot", start - dt.timedelta(hours=2)), (20_001, "hot", start + dt.timedelta(hours=3)), (20_002, "cold", start), (20_003, None, start)]
    snaps = [("hot", start + dt.timedelta(seconds=7 * i), i) for i in range(0, 90, 3)] + [("cold", start - dt.timedelta(days=1), 500), ("hot", start - dt.timedelta(hours=1), 600)]
    e = spark.createDataFrame(events, "event_id int, domain string, ts timestamp")
    s = spark.createDataFrame(snaps, "domain string, observed_at timestamp, seq int")
    got = {r["event_id"]: r["seq"] for r in E.as_of_join(e, s, hot_rows=500).collect()}
    assert len(got) == len(events)
    for i, key, ts in events:
        seen = [(t, n) for k, t, n in snaps if k == key and t <= ts]
        assert got[i] == (max(seen)[1] if seen else None)
    from urlrisk.functions.ordering import in_ranges
    sizes = [r["count"] for r in in_ranges(e.where("domain = 'hot'"), [F.col("domain"), F.col("ts")], 8).groupBy("_range").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 2000


def test_write_counts_and_rejected_rows(spark):
    rows = [("http://a", "1", 1.0), (None, "1", 2.0), ("http://b", "x", 3.0), ("http://c", "0", None)]
    df = spark.createDataFrame(rows, "url string, label string, f double")
    path, rejected = new_folder(spark, "features"), new_folder(spark, "rejected")
    assert sinks.write_features(df, path, rejected, ["f"]) == {"ok": 2, "errors": 2, "columnsComplete": True}
    assert spark.read.option("header", True).csv(path).count() == 2
    assert {(r["url"], r["rejectReason"]) for r in spark.read.parquet(rejected).collect()} == {(None, "missing url"), ("http://b", "bad label")}
