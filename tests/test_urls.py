"""URL jobs against hand-computed rows and against the standard library's parser."""

from urllib.parse import parse_qs, unquote, urlparse

import pytest
from pyspark.sql import functions as F

from urlrisk import rules
from urlrisk.functions import urlparts as U
from urlrisk.functions.strings import strip, strip_long
from urlrisk.operators import content, urls

CASES = [
    "https://mail.secure.example.com", "https://www.example.co.uk", "http://192.168.1.1/login", "https://a.com/?q=1&q=2&e=&k",
    "http://a.com:80/", "http://a.com:8080/", "http://[::1]:8080/", "HTTP://Foo.COM/Bar", "https://[bad/x", "", "   ",
    "example.com/path/a//b;p=1/c;x", "https://user:pw@host.tk:99/a?b=c#d?e", "https://h.com/%41%zz%20+x?a%20b=1&a+b=2#f",
    "http://1234abcd.xyz/a/b/c/d/e?a=1&b=2&c=3&d=4&e=5", "https://a_b-c.example.net/login", "http://x.y/?=v&k=&z=1",
    "https://example.com/\tab\ncd", "https://müller.de/ü?é=1", "https://a.b.c.d.e.f/", "https://0x7f.1/2130706433",
]


def twin(url):
    """The same features with the standard library."""
    if not url:
        return None
    n = url.strip()
    n = n if n.startswith(("http://", "https://")) else "https://" + n
    p = urlparse(n)
    loc = p.netloc.lower()
    host = loc[:loc.find("]") + 1] if loc.startswith("[") else loc.rsplit(":", 1)[0]
    return {
        "urlLength": len(n), "domainLength": len(host), "hasAtSymbol": "@" in n, "hasDoubleSlash": "//" in p.path,
        "pathDepth": len(p.path.strip("/").split("/")) if p.path.strip("/") else 0, "isHttps": p.scheme == "https",
        "queryParamCount": len(parse_qs(p.query)), "digitRatio": sum(c.isdigit() for c in host) / len(host) if host else 0.0,
        "hasSuspiciousKeywords": any(k in unquote(n.lower()) for k in rules.SUSPICIOUS_KEYWORDS),
        "specialCharCount": sum(c not in rules.URL_ALLOWED_CHARS for c in n.lower()),
    }


@pytest.fixture(scope="module")
def features(spark):
    df = spark.createDataFrame([(u,) for u in CASES], "url string")
    return {r["url"]: r.asDict() for r in urls.url_features(df).collect()}


@pytest.mark.parametrize("url", [u for u in CASES if u and u != "https://[bad/x"])
def test_features_equal_the_standard_parser(features, url):
    for name, value in twin(url).items():
        assert features[url][name] == pytest.approx(value), name


@pytest.mark.parametrize("url,name,value", [
    ("https://a.com/?q=1&q=2&e=&k", "queryParamCount", 1),
    ("http://a.com:80/", "hasPortNumber", False), ("http://a.com:8080/", "hasPortNumber", True),
    ("http://[::1]:8080/", "hasPortNumber", True), ("http://[::1]:8080/", "hasIpAddress", True),
    ("HTTP://Foo.COM/Bar", "domainLength", 4), ("HTTP://Foo.COM/Bar", "hasDoubleSlash", True),
    ("HTTP://Foo.COM/Bar", "isHttps", True), ("http://192.168.1.1/login", "subdomainCount", 0),
    ("https://www.example.co.uk", "subdomainCount", 1), ("https://mail.secure.example.com", "subdomainCount", 2),
    ("https://[bad/x", "urlLength", 14), ("https://[bad/x", "domainLength", 0), ("", "urlLength", 0), ("", "isHttps", False),
    ("https://user:pw@host.tk:99/a?b=c#d?e", "hasSuspiciousTld", True),
])
def test_feature_values(features, url, name, value):
    assert features[url][name] == value


@pytest.mark.parametrize("url,expected", [
    ("https://mail.secure.example.com", ("mail.secure", "example", "com")),
    ("https://www.example.co.uk", ("www", "example", "co.uk")),
    ("http://192.168.1.1/login", (None, "192.168.1.1", "")),
    ("https://localhost/", (None, "localhost", "")),
])
def test_components(spark, url, expected):
    row = urls.url_components(spark.createDataFrame([(url,)], "url string")).first()
    assert (row["subdomain"], row["base"], row["tld"]) == expected


@pytest.mark.parametrize("url,score", [
    ("https://example.org/", 0.0), ("http://example.org/", 0.1), ("http://example.org/" + "ab/" * 70, 0.25), ("https://example.tk/", 0.68),
])
def test_structural_score(spark, url, score):
    assert urls.url_analysis(spark.createDataFrame([(url,)], "url string")).first()["structuralScore"] == pytest.approx(score)


def test_brand_rules_skip_legitimate_hosts(spark):
    df = spark.createDataFrame([("https://mail.google.com/login",), ("https://google-login.example.com/",),
                                ("https://my.applesauce.com",), ("https://my.applex.com",), ("https://x.irs.com",)], "url string")
    got = {r["url"]: [h["description"] for h in r["hits"] if h["type"] == rules.BRAND] for r in urls.url_analysis(df).collect()}
    assert got["https://mail.google.com/login"] == []
    assert got["https://google-login.example.com/"] == ["Potential Google impersonation"]
    assert got["https://my.applesauce.com"] == []
    assert got["https://my.applex.com"] == ["Potential Apple impersonation"]
    assert got["https://x.irs.com"] == ["Potential IRS impersonation"]


def test_custom_rules_and_domains(spark):
    df = spark.createDataFrame([("https://shop.acme.org/acme-sale",)], "url string")
    mine = (rules.UrlRule(rules.BRAND, r"acme", 0.4, "acme", True), rules.UrlRule("custom", r"sale", 0.2, "sale"))
    assert urls.url_analysis(df, url_rules=mine, legitimate=()).first()["patternCount"] == 2
    assert urls.url_analysis(df, url_rules=mine, legitimate=("acme.org",)).first()["patternCount"] == 1


def test_large_domain_set_by_join_equals_the_expression(spark):
    hosts = [(i, h) for i, h in enumerate(["google.com", "mail.google.com", "notgoogle.com", "a.b.fb.com", "x.org", ""])]
    df = spark.createDataFrame(hosts, "row_id int, site string")
    known = spark.createDataFrame([(d,) for d in rules.LEGITIMATE_BRAND_DOMAINS], "domain string")
    by_join = {r["row_id"]: r["isLegitimate"] for r in urls.legitimate_by_join(df, known).collect()}
    by_expr = {r["row_id"]: r["x"] for r in df.withColumn(
        "x", U.in_domain_set(F.col("site"), rules.LEGITIMATE_BRAND_DOMAINS)).collect()}
    assert by_join == by_expr == {0: True, 1: True, 2: False, 3: True, 4: False, 5: False}


def test_domain_rules_of_feeds(spark):
    cases = {"https://user@Ex.com:80/x": "ex.com", "ex.com/path": "ex.com", "//h.org/x": "h.org", "https://.a.b./": "a.b",
             "/only/path": "", "http://[bad/x": ""}
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r["url"]: r["d"] for r in df.withColumn("d", U.feed_domain(F.col("url"))).collect()} == cases


ODD = (None, "", " ", "　", " a.com ", "a.com　", "\u0085x\u0085 ", "\x7f", "\x1fabc\x1f", "x\ty.com\r\n", "~!", "héé", "héé ", "\U0001F600 ", "[1.2.3.4]", "[[1.2.3.4]]",
       "::1", "[::1]", "1.2.3.4", "01.2.3.4:8080", "١.2.3.4", "a b.com/x", "a.com/x y", "A.COM", "a.com/\n", "FROM: x", "x?y=1#z", "#?a", "ab?", "Kİ%41%zz 12٣")


def test_passes_spared_on_long_texts_change_nothing(spark):
    c = F.col("c")
    pairs = {
        "strip": (strip_long(c), strip(c)),
        "parsable": (U.parsable(c), F.translate(c, "\t\r\n", "")),
        "query": (U.query(c), F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)),
        "is_ip": (U.is_ip(c), F.btrim(c, F.lit("[]")).rlike(rules.IPV4) | c.rlike(rules.IPV6)),
        "domain": (content._is_domain(c, rules.BARE_DOMAIN), c.rlike("(?d)" + rules.BARE_DOMAIN)),
        "domain, any case": (content._is_domain(c, rules.BARE_DOMAIN_ANY_CASE), c.rlike("(?d)" + rules.BARE_DOMAIN_ANY_CASE)),
        "allowed": (F.length(F.regexp_replace(F.lower(c), urls._ALLOWED, "")), F.length(F.translate(F.lower(c), rules.URL_ALLOWED_CHARS, ""))),
    }
    df = spark.createDataFrame([(x,) for x in ODD], "c string")
    for name, (new, plain) in pairs.items():
        assert [r["c"] for r in df.where(~new.eqNullSafe(plain)).collect()] == [], name


def test_long_texts_are_not_read_one_character_at_a_time(spark):
    df = spark.createDataFrame([("1", "a text")], "id string, content string")
    plan = urls.url_features(df, "content").withColumn("kind", content.scoring_type(F.col("content")))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and "from:|subject:" not in plan
