import datetime as dt

import pytest
from pyspark.sql import functions as F

from urlrisk.functions.ordering import in_ranges
from urlrisk.operators import enrich as E

AS_OF = "2024-02-01"
WHOIS = ("domain string, domain_name array<string>, registrar string, creation_date array<string>, expiration_date array<string>, "
         "updated_date array<string>, name_servers array<string>, name string, org string, emails array<string>, country string")


def whois(spark, **values):
    row = {f.split()[0]: None for f in WHOIS.split(", ")} | {"domain": "a.com", "domain_name": ["a.com"], "name_servers": []} | values
    return E.whois_records(spark.createDataFrame([tuple(row.values())], WHOIS), AS_OF).first()


@pytest.mark.parametrize("text,day", [("2024-01-27", 27), ("2024-01-27T10:00:00", 27), ("2024-01-27T10:00:00Z", 27), ("27-JAN-2024", 27),
                                      ("2024/01/27", 27), ("27/01/2024", 27), ("2024.01.27", 27), ("soon", None)])
def test_date_formats(spark, text, day):
    got = whois(spark, creation_date=[text, "1999-01-01"])["creationDate"]
    assert (got and got.day) == day


def test_whois_flags(spark):
    new = whois(spark, creation_date=["2024-01-27"], expiration_date=["2024-12-01"], org="Domains By Proxy")
    assert (new["domainAgeDays"], new["recentlyRegistered"], new["shortLifespan"], new["isPrivacyProtected"]) == (5, True, True, True)
    assert whois(spark, creation_date=["2024-03-01"])["domainAgeDays"] == 0
    assert whois(spark, domain_name=None)["status"] == "not_found"
    assert whois(spark)["registrant"] is None and whois(spark, country="US")["registrant"]["country"] == "US"


def dns(spark, *records):
    schema = "domain string, rtype string, value string, status string"
    return E.dns_summary(spark.createDataFrame([("a.com", *r) for r in records], schema)).first()


def test_dns_summary(spark):
    assert dns(spark, ("TXT", "V=SPF1 x", "success"))["hasValidMx"] is True
    assert dns(spark, ("MX", "", "success"))["hasValidMx"] is False
    assert dns(spark, ("CNAME", "site.azureedge.net", "success"))["usesCdn"] is True
    assert dns(spark, ("A", "10.0.0.1", "success"), ("MX", None, "timeout"))["status"] == "success"


@pytest.mark.parametrize("records,status", [
    ([("A", None, "nxdomain"), ("MX", None, "nxdomain")], "not_found"),
    ([("MX", None, "error"), ("A", None, "timeout")], "timeout"),
    ([("MX", None, "error"), ("NS", None, "timeout")], "error"),
    ([("A", None, "success")], "not_found"),
])
def test_dns_status(spark, records, status):
    assert dns(spark, *records)["status"] == status


def test_reputation_score(spark):
    schema = "domain string, source string, isMalicious boolean, confidence double, category string"
    base = [("a.com", "virustotal", True, 0.5, None), ("a.com", "internal", False, 0.0, "no_data")]
    score = lambda rows: E.reputation_summary(spark.createDataFrame(rows, schema)).first()["aggregateScore"]
    assert score(base) == pytest.approx(1 / 3)
    assert score(base + [("a.com", "abuseipdb", False, 0.0, None)]) == pytest.approx(0.25)
    assert score(base + [("a.com", "abuseipdb", True, 1.0, "check_failed")]) == pytest.approx(1 / 3)


def test_as_of_join_equals_brute_force_on_a_hot_key(spark):
    events = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 5}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=17 * i)) for i in range(120)]
    snaps = [(j, "hot" if j % 4 else f"k{j % 5}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=41 * j)) for j in range(1, 50)]
    got = E.as_of_join(spark.createDataFrame(events, "event_id int, domain string, ts timestamp"),
                       spark.createDataFrame(snaps, "seq int, domain string, observed_at timestamp"))
    expected = {e: max(((t, s) for s, k, t in snaps if k == d and t <= at), default=(None, None))[1] for e, d, at in events}
    assert {r["event_id"]: r["seq"] for r in got.collect()} == expected


def test_ranges_of_hot_buckets_do_not_grow_with_the_rows(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(E, "in_ranges", lambda rows, order, parts: dealt.append(parts) or in_ranges(rows, order, parts))
    start = dt.datetime(2024, 1, 1)
    events = [(i, "hot", start + dt.timedelta(minutes=17 * i)) for i in range(600)]
    snaps = [(j, "hot", start + dt.timedelta(minutes=41 * j)) for j in range(1, 200)]
    got = E.as_of_join(spark.createDataFrame(events, "event_id int, domain string, ts timestamp"),
                       spark.createDataFrame(snaps, "seq int, domain string, observed_at timestamp"), bucket="year", hot_rows=2)
    expected = {e: max(((t, s) for s, _, t in snaps if t <= at), default=(None, None))[1] for e, _, at in events}
    assert {r["event_id"]: r["seq"] for r in got.collect()} == expected
    assert dealt == [E.RANGES]


def test_spread_join_equals_plain_join(spark):
    left = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "hot").otherwise(
        F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("domain"))
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 40)], "domain string, v int")
    plain = sorted((r["id"], r["v"] or -1) for r in left.join(right, "domain", "left").collect())
    assert sorted((r["id"], r["v"] or -1) for r in E.spread_left_join(left, right, "domain", "id").collect()) == plain


@pytest.mark.parametrize("days,tier,text", [(None, "Unknown", None), (0, "Very New", "Less than a day"), (1, "Very New", "1 day"), (45, "New", "1 month"),
                                            (200, "Established", "6 months"), (365, "Established", "1 year"), (800, "Established", "2y 2m")])
def test_age_words(spark, days, tier, text):
    df = spark.createDataFrame([(days,)], "d int").select(E.age_tier(F.col("d")).alias("a"), E.age_text(F.col("d")).alias("b"))
    assert tuple(df.first()) == (tier, text)


def test_keys(spark):
    row = spark.createDataFrame([(" //WWW.a.com.:80/x ", "https://www.B.org?x")], "a string, b string").select(
        E.dns_key(F.col("a")).alias("a"), E.whois_key(F.col("b")).alias("b")).first()
    assert tuple(row) == ("a.com", "b.org")


def test_rows_without_a_key_are_spread(spark):
    left = spark.range(4000).select("id", F.lit(None).cast("string").alias("domain"))
    right = spark.createDataFrame([("a.com", 1)], "domain string, v int")
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "-1")
        spark.conf.set(names[1], "false")
        df = E.spread_left_join(left, right, "domain", "id")
        assert "hashpartitioning(_join_key" in df._jdf.queryExecution().executedPlan().toString()
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        # The plan of the counts keeps the partitions of the join.
        assert sum(sizes) == 4000
        per_part = [r["n"] for r in df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()]
        assert len(per_part) == 8 and max(per_part) < 2000
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
