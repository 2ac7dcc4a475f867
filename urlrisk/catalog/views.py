"""Input views of the registered queries.

The given tables hold no URL-risk material, so each query starts from a view
that derives it from a whole table.  A view is one SQL text that means the same
in Spark and in DuckDB (no backslashes, explicit group numbers, anchored
replacements), so both sides of a check read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table

AS_OF = "2024-02-01"

VIEWS: dict[str, str] = {}

# URLs: every page's own, and for every page another one with the features the rules look for, planted by page_id.
VIEWS["v_url"] = """
  SELECT page_id, url FROM pages
  UNION ALL
  SELECT 1000000000000 + page_id AS page_id,
    CASE page_id % 12
      WHEN 1 THEN scheme || regexp_replace(host, '[.][a-z]+$', '.tk') || rest
      WHEN 2 THEN scheme || 'user:pw@' || host || rest
      WHEN 3 THEN scheme || host || ':8080' || rest
      WHEN 4 THEN scheme || '10.' || CAST(page_id % 250 AS STRING) || '.3.4' || rest
      WHEN 5 THEN scheme || 'paypal-' || host || rest
      WHEN 6 THEN scheme || host || '/login/verify' || rest
      WHEN 7 THEN scheme || host || '//x//y;p=1' || rest
      WHEN 8 THEN scheme || host || rest || '/%20%2e%2e%41%4c+%zz'
      WHEN 9 THEN scheme || host || '/p?a=1&a=2&b=&c%20d=5&c+d=6&e'
      WHEN 10 THEN host || rest
      WHEN 11 THEN scheme || host || '/' || repeat('x', 120) || rest
      ELSE scheme || host || rest END AS url
  FROM (
    SELECT page_id,
      regexp_extract(url, '^(https?://)', 1) AS scheme,
      CASE page_id % 13
        WHEN 5 THEN 'mail.google.com'
        WHEN 6 THEN 'my.applepie.com'
        WHEN 7 THEN 'x.chaser.co.uk'
        WHEN 8 THEN 'irs-refund_' || CAST(page_id % 10 AS STRING) || '.net'
        WHEN 9 THEN '1234abcd' || CAST(page_id % 7 AS STRING) || '.xyz'
        WHEN 10 THEN 'PayPal.com.Secure--login.example.ga'
        ELSE regexp_extract(url, '^https?://([^/?#]*)', 1) END AS host,
      regexp_extract(url, '^https?://[^/?#]*(.*)$', 1) AS rest
    FROM pages) u
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _needed(names) -> list[str]:
    """The views that the given views read, inputs first."""
    out: list[str] = []
    for name in names:
        for other in VIEWS:
            if other != name and f"{other} " in VIEWS[name].replace("\n", " ").replace(")", " "):
                for inner in _needed([other]):
                    if inner not in out:
                        out.append(inner)
        if name not in out:
            out.append(name)
    return out


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view as a lazy DataFrame."""
    needed = _needed([name])
    text = " ".join(VIEWS[n] for n in needed)
    for source in TABLES:
        if source in text:
            table(spark, folder, source).createOrReplaceTempView(source)
    for inner in needed[:-1]:
        spark.sql(VIEWS[inner]).createOrReplaceTempView(inner)
    return spark.sql(VIEWS[name])


def with_views(sql: str, *names: str) -> str:
    """The DuckDB text: the views as common table expressions, then the query."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in _needed(names)]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body

# Pages with two web links appended: the given pages hold relative links only.
VIEWS["v_html"] = """
  SELECT p.page_id, p.html || '<a href="' || u.url || '">go</a> see ' || p.url || ' (and) http://10.0.0.7/a?b=c.' AS html
  FROM pages p JOIN v_url u ON p.page_id + 1000000000000 = u.page_id
"""

# Messages: every document and every conversation turn, whole, with planted sentences; and short ones beside each document.
VIEWS["v_msg"] = """
  SELECT 'd' || CAST(doc_id AS STRING) AS msg_id,
    CASE doc_id % 13
      WHEN 1 THEN text || ' Act now, your account suspended. URGENT! Visit http://d' || CAST(doc_id AS STRING) || '.com/now'
      WHEN 2 THEN 'From: a@d' || CAST(doc_id AS STRING) || '.com' || chr(10) || 'Subject: security alert' || chr(10) || text
      WHEN 3 THEN text || ' http://secure-paypal.d' || CAST(doc_id AS STRING) || '.tk/login?x=' || CAST(doc_id AS STRING)
      WHEN 4 THEN 'd' || CAST(doc_id AS STRING) || '.com/account/update/card ' || text
      WHEN 5 THEN text || ' Visit http://10.1.2.3/verify and http://login.bank.tk/a now. mail me@d' || CAST(doc_id AS STRING) || '.com'
      WHEN 6 THEN 'Mail b@d' || CAST(doc_id AS STRING) || '.com: please re-enter your password at PayPal. Send payment required, wire transfer funds. ' || text
      WHEN 7 THEN '   ' || text || '   '
      WHEN 8 THEN text || ' see attached invoice.exe or open the attachment report.docm'
      WHEN 9 THEN 'Subject: hi' || chr(10) || 'to: x' || chr(10) || text || ' click here, limited time sensitive'
      WHEN 10 THEN text || ' IT support: customer service help desk. Act now or lose, congratulations you deserve it. award-winning, trusted by most popular Google.com urgent@x.com hurry.net Click http://www.d' || CAST(doc_id AS STRING) || '.com'
      WHEN 11 THEN text
      WHEN 12 THEN text || ' http://[bad/link here'
      ELSE text END AS content,
    CASE doc_id % 13 WHEN 11 THEN 'sms' WHEN 5 THEN 'email' WHEN 8 THEN 'text' ELSE 'auto' END AS content_type
  FROM documents
  UNION ALL
  SELECT 'c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS msg_id,
    CASE WHEN role = 'user' THEN text || ' enter your PIN. confirm your SSN!' ELSE text || ' https://www.d' || CAST(conv_id AS STRING) || '.com/a' END AS content,
    'auto' AS content_type
  FROM conversations
  UNION ALL
  SELECT 'x' || CAST(doc_id AS STRING) AS msg_id,
    CASE doc_id % 13
      WHEN 3 THEN 'http://secure-paypal.d' || CAST(doc_id AS STRING) || '.tk/login?x=' || CAST(doc_id AS STRING)
      WHEN 4 THEN 'd' || CAST(doc_id AS STRING) || '.com/account/update/card'
      WHEN 5 THEN 'https://www.d' || CAST(doc_id AS STRING) || '.com/a'
      WHEN 7 THEN '   '
      ELSE 'Subject: ' || lang END AS content,
    CASE doc_id % 13 WHEN 11 THEN 'sms' ELSE 'auto' END AS content_type
  FROM documents
"""

# WHOIS rows: one per planted domain, dates in every accepted format and one bad one.
VIEWS["v_whois"] = """
  SELECT domain, k,
    CASE WHEN k % 11 = 4 THEN NULL ELSE domain END AS domain_name,
    CASE WHEN k % 3 = 0 THEN ' Registrar ' || CAST(k % 5 AS STRING) || ' ' ELSE '' END AS registrar,
    CASE WHEN k % 11 = 4 THEN NULL ELSE
      CASE k % 8 WHEN 0 THEN y || '-' || m || '-' || d
        WHEN 1 THEN y || '-' || m || '-' || d || 'T10:20:30'
        WHEN 2 THEN y || '-' || m || '-' || d || 'T10:20:30Z'
        WHEN 3 THEN d || '-Jan-' || y
        WHEN 4 THEN y || '/' || m || '/' || d
        WHEN 5 THEN d || '/' || m || '/' || y
        WHEN 6 THEN y || '.' || m || '.' || d
        ELSE 'unknown' END END AS created,
    CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(CAST(y AS INT) + k % 2 AS STRING) || '-' || m || '-20' END AS expires,
    CASE k % 5 WHEN 0 THEN 'Domains By Proxy, LLC' WHEN 1 THEN 'Acme' WHEN 2 THEN '' ELSE NULL END AS org,
    CASE k % 7 WHEN 0 THEN 'REDACTED FOR PRIVACY' WHEN 1 THEN 'A Person' ELSE NULL END AS name,
    CASE WHEN k % 6 = 0 THEN 'US' ELSE NULL END AS country,
    'NS1.' || domain || ' ' AS ns
  FROM (SELECT 'd' || CAST(u AS STRING) || '.com' AS domain, u AS k,
          CAST(CASE WHEN u % 9 = 8 THEN 2024 ELSE 2010 + u % 14 END AS STRING) AS y,
          lpad(CAST(CASE WHEN u % 9 = 8 THEN 1 ELSE 1 + u % 12 END AS STRING), 2, '0') AS m,
          lpad(CAST(1 + (u * 7) % 28 AS STRING), 2, '0') AS d
        FROM (SELECT user_id AS u FROM events GROUP BY user_id) g) w
"""

# DNS lookups: one row per event.
VIEWS["v_dns"] = """
  SELECT event_id AS seq, ts AS observed_at, 'd' || CAST(user_id AS STRING) || '.com' AS domain,
    CASE event_type WHEN 'view' THEN 'A' WHEN 'click' THEN 'NS' WHEN 'signup' THEN 'TXT'
      WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'MX' WHEN event_id % 3 = 1 THEN 'AAAA' ELSE 'CNAME' END
      ELSE 'A' END AS rtype,
    CASE WHEN event_type = 'error' OR user_id % 50 IN (3, 4, 5) THEN NULL
      WHEN event_type = 'view' THEN '10.0.' || CAST(event_id % 200 AS STRING) || '.1'
      WHEN event_type = 'click' THEN CASE WHEN user_id % 7 = 1 THEN 'ns' || CAST(event_id % 9 AS STRING) || '.CloudFlare.com' ELSE 'ns.example.net' END
      WHEN event_type = 'signup' THEN CASE WHEN user_id % 5 = 0 THEN 'V=SPF1 include' ELSE 'note' END
      WHEN event_id % 3 = 0 THEN CASE WHEN user_id % 4 = 0 THEN '' ELSE 'mx.example.net' END
      WHEN event_id % 3 = 1 THEN 'fe80::' || CAST(event_id % 100 AS STRING)
      ELSE 'site.azureedge.net' END AS value,
    CASE WHEN user_id % 50 = 3 THEN 'nxdomain'
      WHEN user_id % 50 = 4 THEN CASE WHEN event_type = 'signup' THEN 'timeout' WHEN event_type = 'error' THEN 'nxdomain' ELSE 'error' END
      WHEN user_id % 50 = 5 THEN 'success'
      WHEN event_type = 'error' THEN 'timeout' ELSE 'success' END AS status
  FROM events
"""

# Reputation checks: one per event.
VIEWS["v_rep"] = """
  SELECT event_id, 'd' || CAST(user_id AS STRING) || '.com' AS domain,
    CASE user_id % 3 WHEN 0 THEN 'virustotal' WHEN 1 THEN 'abuseipdb' ELSE 'internal' END AS source,
    event_type = 'error' AND user_id % 50 < 40 AS isMalicious,
    CASE WHEN value > 150 THEN 1.0 ELSE value / 150 END AS confidence,
    CASE event_id % 7 WHEN 0 THEN 'api_key_missing' WHEN 1 THEN 'check_failed' WHEN 2 THEN 'not_found'
      WHEN 3 THEN 'no_data' WHEN 4 THEN 'phishing' WHEN 5 THEN '' ELSE NULL END AS category
  FROM events
"""

# Vendor answers as JSON text.
VIEWS["v_vendor"] = """
  SELECT event_id AS key,
    CASE WHEN event_id % 10 = 0 THEN '{"data":{"attributes":{}}}'
      WHEN event_id % 10 = 1 THEN '{"data":{"attributes":{"last_analysis_stats":{"malicious":0,"suspicious":0}}}}'
      ELSE '{"data":{"attributes":{"last_analysis_stats":{"malicious":' || CAST(event_id % 4 AS STRING)
        || ',"suspicious":' || CAST(user_id % 3 AS STRING) || ',"harmless":' || CAST(event_id % 70 AS STRING)
        || '},"categories":{"b":"' || event_type || '","a":"other"}}}}' END AS body,
    '{"data":{"abuseConfidenceScore":' || CAST(event_id % 101 AS STRING) || ',"totalReports":' || CAST(user_id % 9 AS STRING)
      || CASE WHEN event_id % 2 = 0 THEN ',"usageType":"' || event_type || '"' ELSE '' END || '}}' AS ip_body
  FROM events
"""

# Feed rows from the pages, four per page, with copies that differ in case and final slashes.
VIEWS["v_feed"] = """
  SELECT page_id, copy, CASE WHEN copy = 1 THEN upper(url) || '//' WHEN copy = 2 AND page_id % 3 = 0 THEN url || '/' ELSE url END AS url,
    (page_id + copy) % 6 AS priority,
    CASE WHEN (page_id + copy) % 5 = 0 THEN ' NO ' ELSE 'Yes' END AS verified,
    CASE WHEN (page_id + copy) % 7 = 0 THEN 'no' ELSE 'yes ' END AS online,
    CASE page_id % 4 WHEN 0 THEN 'PayPal' WHEN 1 THEN '' WHEN 2 THEN 'Bank, Inc' ELSE 'Other' END AS target,
    CASE page_id % 4 WHEN 0 THEN '4.9' WHEN 1 THEN '5' WHEN 2 THEN 'x' ELSE '7.25' END AS score
  FROM (SELECT page_id, url, 0 AS copy FROM v_url UNION ALL SELECT page_id, url, 1 AS copy FROM v_url
    UNION ALL SELECT page_id, url, 2 AS copy FROM v_url UNION ALL SELECT page_id, url, 3 AS copy FROM v_url) f
"""

# Ranked domains, one per event, with short, numeric and infrastructure names.
VIEWS["v_ranked"] = """
  SELECT CASE WHEN event_id % 50 = 7 THEN 'n/a' ELSE CAST(event_id AS STRING) END AS rank_text, event_id,
    CASE event_id % 9 WHEN 0 THEN 'a.b' WHEN 1 THEN '12.34.56' WHEN 2 THEN 'x.notgvt1.com' WHEN 3 THEN ' WWW.Site' || CAST(event_id % 4000 AS STRING) || '.org '
      WHEN 4 THEN '' ELSE 'site' || CAST(event_id % 4000 AS STRING) || '.org' END AS domain
  FROM events
"""

# History rows, one per event.
VIEWS["v_hist"] = """
  SELECT CAST(event_id AS STRING) AS id, CASE WHEN event_id % 4 = 0 THEN 'say "' || event_type || '" ' || repeat('z', 58) ELSE event_type || ' ' || CAST(user_id AS STRING) END AS content,
    CASE WHEN event_id % 3 = 0 THEN 'url' ELSE 'text' END AS contentType, score,
    CASE WHEN score < 0.3 THEN 'safe' WHEN score < 0.5 THEN 'suspicious' WHEN score < 0.7 THEN 'dangerous' ELSE 'critical' END AS threatLevel,
    score >= 0.5 AS isPhishing, ts AS analyzedAt, CASE WHEN event_id % 10 = 0 THEN 'error' WHEN event_id % 10 = 1 THEN 'pending' ELSE 'done' END AS status
  FROM (SELECT event_id, ts, user_id, event_type, CASE WHEN value > 150 THEN 1.0 ELSE value / 150 END AS score FROM events) e
"""

# Feature rows with a constant column, a binary one, an outlier, gaps, duplicates and unequal classes.
VIEWS["v_feat"] = """
  SELECT CAST(l_quantity AS DOUBLE) AS urlLength, CAST(floor(l_extendedprice / 1000) AS DOUBLE) AS domainLength,
    CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE l_discount END AS digitRatio, CAST(1 AS DOUBLE) AS hasEncodedChars,
    CAST(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS DOUBLE) AS isHttps,
    CAST(CASE WHEN l_orderkey % 997 = 0 THEN 100000 ELSE l_linenumber END AS DOUBLE) AS dnsRecordCount,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label
  FROM lineitem
"""

# Scores with many ties.
VIEWS["v_scored"] = """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
    CAST((l_orderkey * 31 + l_partkey * 17 + l_linenumber) % 1000 AS DOUBLE) / 1000 AS score
  FROM lineitem
"""

# Attributions, wide; one feature contributes nothing.
VIEWS["v_attr"] = """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity - 25) / 50 AS urlLength, (l_extendedprice - 50000) / 100000 AS domainLength,
    l_discount - 0.05 AS hasValidMx, (l_extendedprice / l_quantity - 2000) / 4000 + l_tax AS dnsRecordCount, CAST(0 AS DOUBLE) AS isHttps
  FROM lineitem
"""
