import pytest
from pyspark.sql import functions as F

from urlrisk import rules
from urlrisk.operators import content as C, text as T


def hits(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, content string")
    found = T.phrase_hits(df, "content", "id").orderBy("position", "listNo").collect()
    return [(r["category"], r["evidence"], r["position"]) for r in found]


@pytest.mark.parametrize("text,expected", [
    ("Act NOW!", [("urgency", "Act NOW", 0)]),
    ("react now", []), ("act  now", []), ("act now_", []), ("éurgent urgent", [("urgency", "urgent", 8)]),
    ("re-enter your password", [("credential_request", "re-enter your password", 0), ("credential_request", "enter your password", 3)]),
    ("wire transfer funds", [("monetary_request", "wire transfer", 0), ("monetary_request", "transfer funds", 5)]),
    ("act now or lose", [("urgency", "act now", 0), ("emotional_manipulation", "act now or lose", 0)]),
    ("PayPal paypal", [("brand_mention", "PayPal", 0)]),
    ("see https://x.com/urgent urgent", [("urgency", "urgent", 25)]),
    ("urgent@x.com Apple.com hurry.net click here.now", []),
    ("it SUPPORT, urgent urgent", [("authority_impersonation", "it SUPPORT", 0), ("urgency", "urgent", 12), ("urgency", "urgent", 19)]),
])
def test_phrase_hits(spark, text, expected):
    assert hits(spark, text) == expected
    counts = T.add_phrase_counts(spark.createDataFrame([(text,)], "content string"), "content").first()
    for x in rules.LEXICONS:
        assert counts[f"n_{x.category}"] == sum(c == x.category for c, _, _ in expected), x.category


@pytest.mark.parametrize("x", rules.LEXICONS, ids=lambda x: x.category)
def test_every_phrase_is_found(spark, x):
    df = spark.createDataFrame([(p,) for p in x.phrases], "content string")
    assert all(r[f"n_{x.category}"] >= 1 for r in T.add_phrase_counts(df, "content").collect())


@pytest.mark.parametrize("text,confidence", [
    ("nothing here", 0.0), ("urgent PayPal", 0.8), ("urgent", 0.8), ("as seen on PayPal, certified", 0.633),
])
def test_confidence(spark, text, confidence):
    assert T.text_analysis(spark.createDataFrame([(text,)], "content string")).first()["textConfidence"] == pytest.approx(confidence)


def test_links_and_attachments_need_a_message(spark):
    df = spark.createDataFrame([("http://10.0.0.1/a.exe and https://x.tk/", "email"), ("http://10.0.0.1/a.exe", "url")], "content string, kind string")
    email, url = T.text_analysis(df, "content", "kind").collect()
    assert (email["n_link_ip"], email["n_link_tld"], email["n_attachment_extension"]) == (1, 1, 1)
    assert (url["n_link_ip"], url["n_attachment_extension"], url["indicatorCount"]) == (0, 0, 0)


@pytest.mark.parametrize("text,scoring,plain,domain", [
    ("HTTPS://A.com/x y", "url", "text", None), ("www.b.org/x", "url", "url", "b.org"), ("shop.example.co.uk/x", "url", "text", "shop.example.co.uk"),
    ("me@x.org", "text", "email", "x.org"), ("From: me@mail.x.org", "email", "email", "mail.x.org"),
    ("see http://www.y.net/a or me@z.org", "text", "text", "y.net"), ("hello", "text", "text", None), ("http://[bad/x", "url", "url", None),
])
def test_routing(spark, text, scoring, plain, domain):
    c = F.col("c")
    row = spark.createDataFrame([(text,)], "c string").select(C.scoring_type(c), C.text_type(c), C.enrichment_domain(c)).first()
    assert tuple(row) == (scoring, plain, domain)


def test_compose_and_quarantine(spark):
    df = spark.createDataFrame([("b", "s", "f"), ("b", None, ""), ("b", "", "f")], "b string, s string, f string")
    got = [r[0] for r in df.select(C.compose_email(F.col("b"), F.col("s"), F.col("f"))).collect()]
    assert got == ["From: f\nSubject: s\n\nb", "b", "From: f\nb"]
    good, bad = C.split_requests(spark.createDataFrame([(" x ", "auto"), (" ", "url"), ("x", "sms")], "content string, content_type string"))
    assert [r["content"] for r in good.collect()] == ["x"]
    assert sorted(r["requestError"] for r in bad.collect()) == ["Content cannot be empty", "Unknown content type"]
