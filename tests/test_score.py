import pytest
from pyspark.sql import functions as F

from urlrisk import rules
from urlrisk.operators import score as S, urls
from urlrisk.plans import scoring


def scored(spark, *addresses, **options):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(addresses)], "url_id int, url string")
    return sorted(scoring.score_urls(df, **options).collect(), key=lambda r: r["url_id"])


def test_unknown_enrichment(spark):
    row = scored(spark, "https://example.org/")[0]
    assert row["osintScore"] == pytest.approx(0.2) and len(row["osintFactors"]) == 2
    assert row["confidence"] == pytest.approx(0.3 + 0.5 / 3 + 0.1)
    assert row["riskLevel"] == "safe" and row["urlScore"] == 0.0


def test_risky_url_scores_higher(spark):
    safe, risky = scored(spark, "https://example.org/", "http://paypal-login.192.168.1.1.tk:8080//verify@x?a=1")
    assert risky["finalScore"] > safe["finalScore"] and risky["reasons"][0].lower().count("attack") == 1
    assert len(risky["reasons"]) <= 10 and len(set(risky["reasons"])) == len(risky["reasons"])


@pytest.mark.parametrize("score,level", [(0.2999, "safe"), (0.3, "suspicious"), (0.5, "dangerous"), (0.7, "critical")])
def test_level_edges(spark, score, level):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(urls.step_level(F.col("s"), rules.LEVELS, rules.LEVEL_BOUNDS)).first()[0] == level


def test_weights_and_thresholds_are_checked():
    with pytest.raises(ValueError):
        S.Weights(0.5, 0.5, 0.5)
    with pytest.raises(ValueError):
        S.Thresholds(bounds=(0.5, 0.3, 0.7))


def test_custom_weights(spark):
    row = scored(spark, "http://a.tk/", weights=S.Weights(1.0, 0.0, 0.0))[0]
    assert row["finalScore"] == pytest.approx(row["urlScore"])


def verdict(spark, **values):
    row = {"kind": "text", "finalScore": 0.0, "textConfidence": 0.0, "totalRiskIndicators": 0, "hasReputation": None, "aggregateScore": None,
           "hasWhois": None, "isPrivacyProtected": None, "domainAgeDays": None, "maliciousCount": None, "textReasons": [], "reasons": []} | values
    schema = ("kind string, finalScore double, textConfidence double, totalRiskIndicators int, hasReputation boolean, aggregateScore double, "
              "hasWhois boolean, isPrivacyProtected boolean, domainAgeDays int, maliciousCount int, textReasons array<string>, reasons array<string>")
    return S.add_verdict(spark.createDataFrame([tuple(row.values())], schema)).first()


def test_verdicts(spark):
    row = verdict(spark, kind="url", finalScore=0.6, textConfidence=0.8)
    assert (row["verdictScore"], row["threatLevel"]) == (0.63, "dangerous")
    row = verdict(spark, textConfidence=0.8, totalRiskIndicators=3, hasReputation=True, aggregateScore=0.6)
    assert row["verdictScore"] == pytest.approx(0.635)
    assert verdict(spark, hasWhois=True, domainAgeDays=0)["verdictReasons"] == []
    assert verdict(spark, hasWhois=True, domainAgeDays=3)["verdictReasons"] == ["Domain registered recently (3 days ago)"]


def test_a_bad_row_fails_no_job(spark):
    schema = "domain string, hasWhois boolean, registrar string, domainAgeDays int, isPrivacyProtected boolean, recentlyRegistered boolean, " \
             "hasDns boolean, nA int, nAAAA int, nMX int, nNS int, nTXT int, nCNAME int, hasValidMx boolean, usesCdn boolean, hasIpAddresses boolean, " \
             "hasReputation boolean, aggregateScore double, knownMalicious boolean, maliciousCount int"
    empty = spark.createDataFrame([], schema)
    messages = spark.createDataFrame([("a", " ", "auto"), ("b", "x http://[bad/ y", "text"), ("c", "hello", "auto"), ("d", "x", "sms")],
                                     "msg_id string, content string, content_type string")
    got = {r["msg_id"]: r for r in scoring.score_messages(messages, empty).collect()}
    assert {k: r["success"] for k, r in got.items()} == {"a": False, "b": False, "c": True, "d": False}
    assert got["a"]["threatLevel"] == "safe" and got["a"]["reasons"] == ["Analysis error"] and got["b"]["error"] == "Invalid IPv6 URL"
