"""Enrichment and join jobs as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..operators import enrich as E, urls
from ..session import new_folder
from ..sources import plugin
from .registry import query
from .url_queries import FEATURES, PARTS, _alt, _list
from .views import AS_OF, view, with_views


def whois_raw(spark, folder):
    """v_whois in the raw, list-valued shape."""
    return view(spark, folder, "v_whois").select(
        "domain", F.array("domain_name").alias("domain_name"), "registrar",
        F.when(F.col("created").isNotNull(), F.array("created", F.lit("1999-01-01"))).alias("creation_date"),
        F.when(F.col("expires").isNotNull(), F.array("expires")).alias("expiration_date"),
        F.lit(None).cast("array<string>").alias("updated_date"),
        F.array("ns", F.lit("")).alias("name_servers"), "name", "org",
        F.lit(None).cast("array<string>").alias("emails"), "country")


WHOIS = f"""
  w0 AS (SELECT *, try_strptime(created, ['%Y-%m-%d', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M:%SZ', '%d-%b-%Y', '%Y/%m/%d',
              '%d/%m/%Y', '%Y.%m.%d']) AS cr, try_strptime(expires, ['%Y-%m-%d']) AS ex FROM v_whois),
  whois AS MATERIALIZED (SELECT domain,
    CASE WHEN domain_name IS NOT NULL OR created IS NOT NULL THEN 'success' ELSE 'not_found' END AS status,
    nullif(trim(registrar), '') AS registrar, cr, ex,
    CAST(CASE WHEN cr IS NULL THEN NULL ELSE greatest(0, CAST(floor((epoch(TIMESTAMP '{AS_OF}') - epoch(cr)) / 86400) AS INT)) END AS INT) AS age,
    coalesce(regexp_matches(lower(nullif(trim(org), '')), '{_alt(rules.PRIVACY_WORDS)}'), false)
      OR coalesce(regexp_matches(lower(nullif(trim(name), '')), '{_alt(rules.PRIVACY_WORDS)}'), false) AS private,
    coalesce(floor((epoch(ex) - epoch(cr)) / 86400) < 365, false) AS short,
    nullif(trim(name), '') IS NOT NULL OR nullif(trim(org), '') IS NOT NULL OR country IS NOT NULL AS contact,
    nullif(trim(org), '') AS organization, lower(trim(ns)) AS ns FROM w0)
"""


@query("osi_01_dns_key", with_views(r"""
  SELECT page_id, trim(regexp_extract(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    lower(trim(url)), '^https://', ''), '^http://', ''), '^//', ''), '^www\.', ''), '^([^/?#:]*)', 1), '.') AS domain FROM v_url""",
  "v_url"))
def _dns_key(spark, folder):
    return view(spark, folder, "v_url").select("page_id", E.dns_key(F.col("url")).alias("domain"))


@query("osi_02_whois_key", with_views(r"""
  SELECT page_id, regexp_extract(regexp_replace(regexp_replace(regexp_replace(
    lower(trim(url)), '^https://', ''), '^http://', ''), '^www\.', ''), '^([^/?#:]*)', 1) AS domain FROM v_url""", "v_url"))
def _whois_key(spark, folder):
    return view(spark, folder, "v_url").select("page_id", E.whois_key(F.col("url")).alias("domain"))


@query("osi_03_whois_records", with_views(f"""WITH {WHOIS}
  SELECT domain, status, registrar, CAST(cr AS TIMESTAMP) AS "creationDate", CAST(ex AS TIMESTAMP) AS "expirationDate",
    ns AS "nameServers", contact AS "hasContact", organization FROM whois""", "v_whois"))
def _whois_records(spark, folder):
    return E.whois_records(whois_raw(spark, folder), AS_OF).select(
        "domain", "status", "registrar", "creationDate", "expirationDate",
        F.array_join("nameServers", ",").alias("nameServers"), F.col("registrant").isNotNull().alias("hasContact"),
        F.col("registrant.organization").alias("organization"))


@query("ext_04_foreign_source", with_views(f"""WITH {WHOIS}
  SELECT domain, status, registrar, CAST(cr AS TIMESTAMP) AS "creationDate", CAST(ex AS TIMESTAMP) AS "expirationDate",
    ns AS "nameServers", contact AS "hasContact", organization FROM whois""", "v_whois"))
def _foreign_source(spark, folder):
    """WHOIS answers as text files, read by a source of another format."""
    path = new_folder(spark, "ext04")
    line = lambda field, value: F.when(value.isNotNull(), F.concat(F.lit(f"{field}: "), value, F.lit("\n")))
    raw = view(spark, folder, "v_whois")
    created = F.when(F.col("created").isNotNull(), F.concat(line("Creation Date", F.col("created")), F.lit("Creation Date: 1999-01-01\n")))
    answer = F.concat_ws("", line("Query", F.col("domain")), line("Domain Name", F.col("domain_name")), line("Registrar", F.col("registrar")), created,
                         line("Registry Expiry Date", F.col("expires")), line("Name Server", F.col("ns")), line("Registrant Name", F.col("name")),
                         line("Registrant Organization", F.col("org")), line("Registrant Country", F.col("country")))
    raw.select(answer.alias("value")).write.text(path)
    plugin.register(spark, "whois_text", plugin.WhoisText)
    records = E.whois_records(spark.read.format("whois_text").load(path if "://" in path else f"file://{path}"), AS_OF)
    return records.select(
        "domain", "status", "registrar", "creationDate", "expirationDate",
        F.array_join("nameServers", ",").alias("nameServers"), F.col("registrant").isNotNull().alias("hasContact"),
        F.col("registrant.organization").alias("organization"))


@query("osi_04_whois_flags", with_views(f"""WITH {WHOIS}
  SELECT domain, age AS "domainAgeDays", coalesce(age < 30, false) AS "recentlyRegistered", short AS "shortLifespan",
    private AS "isPrivacyProtected" FROM whois""", "v_whois"))
def _whois_flags(spark, folder):
    return E.whois_records(whois_raw(spark, folder), AS_OF).select(
        "domain", "domainAgeDays", "recentlyRegistered", "shortLifespan", "isPrivacyProtected")


DNS = f"""
  d0 AS (SELECT *, status = 'success' AND value IS NOT NULL AS ok, list_position(['A','AAAA','MX','NS','TXT','CNAME'], rtype) AS o
         FROM v_dns),
  d1 AS (SELECT domain, {', '.join(f"CAST(count(*) FILTER (WHERE ok AND rtype = '{t}') AS INT) AS n{t}" for t in rules.DNS_TYPES)},
    coalesce(bool_or(ok AND ((rtype = 'MX' AND value <> '') OR (rtype = 'TXT' AND starts_with(lower(value), 'v=spf1')))), false) AS mx,
    coalesce(bool_or(ok AND rtype IN ('CNAME', 'NS') AND regexp_matches(lower(value), '{_alt(rules.CDN_WORDS)}')), false) AS cdn,
    count(*) FILTER (WHERE ok) AS n, bool_and(status = 'nxdomain') AS missing,
    arg_min(status, o * 10 + CASE WHEN status = 'timeout' THEN 1 ELSE 2 END) FILTER (WHERE status IN ('timeout', 'error')) AS failure
    FROM d0 GROUP BY domain),
  dns AS MATERIALIZED (SELECT *, CASE WHEN missing THEN 'not_found' WHEN failure IS NOT NULL AND n = 0 THEN failure
    WHEN n = 0 THEN 'not_found' ELSE 'success' END AS status FROM d1)
"""


@query("osi_05_dns_summary", with_views(f"""WITH {DNS}
  SELECT domain, nA AS "nA", nAAAA AS "nAAAA", nMX AS "nMX", nNS AS "nNS", nTXT AS "nTXT", nCNAME AS "nCNAME",
    mx AS "hasValidMx", cdn AS "usesCdn", nA + nAAAA > 0 AS "hasIpAddresses" FROM dns""", "v_dns"))
def _dns_summary(spark, folder):
    return E.dns_summary(view(spark, folder, "v_dns")).drop("status")


# Lookups with a time to live, and mail servers with a priority, some without.
_DNS_FULL = """SELECT *, CAST(seq % 3600 AS INT) AS ttl, CASE WHEN rtype = 'MX' AND seq % 4 <> 0 THEN CAST(seq % 3 * 10 AS INT) END AS priority FROM v_dns"""


@query("osi_05_dns_records", with_views(f"""WITH f AS ({_DNS_FULL}),
  r AS (SELECT domain, rtype, value, CASE WHEN rtype = 'MX' THEN coalesce(priority, 0) END AS priority, max(ttl) AS ttl FROM f
        WHERE coalesce(status, 'success') = 'success' AND value IS NOT NULL GROUP BY ALL)
  SELECT * FROM r""", "v_dns"))
def _dns_records(spark, folder):
    return E.dns_records(_dns_full(spark, folder))


def _dns_full(spark, folder):
    rows = view(spark, folder, "v_dns")
    priority = F.when((F.col("rtype") == "MX") & (F.col("seq") % 4 != 0), F.col("seq") % 3 * 10).cast("int")
    return rows.withColumns({"ttl": (F.col("seq") % 3600).cast("int"), "priority": priority})


@query("osi_05_dns_record_sets", with_views(f"""WITH f AS ({_DNS_FULL}),
  r AS (SELECT domain, rtype, value, CASE WHEN rtype = 'MX' THEN coalesce(priority, 0) ELSE 0 END AS priority, max(ttl) AS ttl FROM f
        WHERE coalesce(status, 'success') = 'success' AND value IS NOT NULL GROUP BY ALL),
  o AS (SELECT *, row_number() OVER (PARTITION BY domain, rtype ORDER BY priority, value) AS place, count(*) OVER (PARTITION BY domain, rtype) AS n FROM r)
  SELECT domain, rtype, any_value(n) AS "nRecords", string_agg(priority || ' ' || value || ' ' || ttl, ';' ORDER BY place) AS records FROM o WHERE place <= 3 GROUP BY domain, rtype""", "v_dns"))
def _dns_record_sets(spark, folder):
    shown = F.transform("records", lambda r: F.concat_ws(" ", r["priority"].cast("string"), r["value"], r["ttl"].cast("string")))
    return E.dns_record_sets(_dns_full(spark, folder), 3).select("domain", "rtype", "nRecords", F.array_join(shown, ";").alias("records"))


@query("joi_05_as_of_hot_bucket", with_views("""
  WITH e AS (SELECT event_id, ts, CASE WHEN user_id % 3 = 0 THEN 'hot.com' ELSE 'd' || CAST(user_id % 50 AS STRING) || '.com' END AS domain FROM events),
  s AS (SELECT seq, CASE WHEN seq % 3 = 1 THEN 'hot.com' ELSE domain END AS domain, observed_at FROM v_dns WHERE rtype = 'A')
  SELECT e.event_id, e.domain, e.ts, s.seq, s.observed_at FROM e ASOF LEFT JOIN s ON e.domain = s.domain AND e.ts >= s.observed_at""", "v_dns"))
def _as_of_hot(spark, folder):
    """One key with a third of all rows, and buckets as wide as the table: its rows are dealt by ranges."""
    from .views import table
    events = table(spark, folder, "events").select("event_id", "ts", F.when(F.col("user_id") % 3 == 0, "hot.com").otherwise(
        F.concat(F.lit("d"), (F.col("user_id") % 50).cast("string"), F.lit(".com"))).alias("domain"))
    snaps = view(spark, folder, "v_dns").where("rtype = 'A'").select(F.when(F.col("seq") % 3 == 1, "hot.com").otherwise(F.col("domain")).alias("domain"), "observed_at", "seq")
    return E.as_of_join(events, snaps, bucket="year", hot_rows=1000)


@query("osi_06_dns_status", with_views(f"WITH {DNS} SELECT domain, status FROM dns", "v_dns"))
def _dns_status(spark, folder):
    return E.dns_summary(view(spark, folder, "v_dns")).select("domain", "status")


@query("osi_07_vendor_checks", with_views("""
  WITH j AS (SELECT key, json_extract(body, '$.data.attributes.last_analysis_stats') AS s,
      json_extract_string(body, '$.data.attributes.categories.b') AS c FROM v_vendor),
  k AS (SELECT key, c, coalesce(CAST(s->>'malicious' AS BIGINT), 0) + coalesce(CAST(s->>'suspicious' AS BIGINT), 0) AS f,
      coalesce(CAST(s->>'malicious' AS BIGINT), 0) + coalesce(CAST(s->>'suspicious' AS BIGINT), 0)
        + coalesce(CAST(s->>'harmless' AS BIGINT), 0) AS t FROM j)
  SELECT key, 'virustotal' AS source, f > 0 AS "isMalicious", round(least(f::DOUBLE / greatest(t, 1), 1.0), 6) AS confidence,
    c AS category FROM k""", "v_vendor"))
def _vendor(spark, folder):
    return E.verdict_vendor_checks(view(spark, folder, "v_vendor")).withColumn("confidence", F.round("confidence", 6))


@query("osi_08_ip_abuse_checks", with_views("""
  WITH j AS (SELECT key, CAST(json_extract_string(ip_body, '$.data.abuseConfidenceScore') AS DOUBLE) AS s,
      CAST(json_extract_string(ip_body, '$.data.totalReports') AS BIGINT) AS r,
      json_extract_string(ip_body, '$.data.usageType') AS category FROM v_vendor)
  SELECT key, 'abuseipdb' AS source, s > 50 OR r > 5 AS "isMalicious", round(s / 100, 6) AS confidence, category FROM j""",
  "v_vendor"))
def _ip_abuse(spark, folder):
    bodies = view(spark, folder, "v_vendor").select("key", F.col("ip_body").alias("body"))
    return E.ip_abuse_checks(bodies).withColumn("confidence", F.round("confidence", 6))


@query("osi_09_ip_fan_out", with_views("""
  WITH f AS (SELECT domain, value AS ip, row_number() OVER (PARTITION BY domain
      ORDER BY CASE WHEN rtype = 'A' THEN 0 ELSE 1 END, seq, value) AS "ipNo"
    FROM v_dns WHERE rtype IN ('A', 'AAAA') AND value IS NOT NULL),
  c AS (SELECT '10.0.' || CAST(event_id % 200 AS STRING) || '.1' AS ip, source, bool_or(isMalicious) AS bad FROM v_rep GROUP BY 1, 2)
  SELECT f.domain, CAST(f."ipNo" AS INT) AS "ipNo", f.ip, c.source, c.bad FROM f JOIN c USING (ip)
  WHERE "ipNo" <= 5 AND source IN ('virustotal', 'abuseipdb')""", "v_dns", "v_rep"))
def _ip_fan_out(spark, folder):
    checks = (view(spark, folder, "v_rep")
              .groupBy(F.concat(F.lit("10.0."), (F.col("event_id") % 200).cast("string"), F.lit(".1")).alias("ip"), "source")
              .agg(F.bool_or("isMalicious").alias("bad")))
    return E.ip_checks(view(spark, folder, "v_dns"), checks, 5).select("domain", "ipNo", "ip", "source", "bad")


REP = """
  r0 AS (SELECT *, CASE WHEN source = 'virustotal' THEN 2.0 ELSE 1.0 END AS w,
      coalesce(category NOT IN ('api_key_missing', 'check_failed'), true) AS counted FROM v_rep),
  rep AS MATERIALIZED (SELECT domain, least(coalesce(sum(CASE WHEN counted AND isMalicious THEN confidence * w ELSE 0.0 END)
        / nullif(sum(CASE WHEN counted THEN w ELSE 0.0 END), 0), 0.0), 1.0)::DOUBLE AS agg,
      bool_or(isMalicious AND confidence > 0.5) AS known, CAST(count(*) FILTER (WHERE isMalicious) AS INT) AS bad,
      CAST(count(*) AS INT) AS n,
      CAST(count(*) FILTER (WHERE category <> '' AND category NOT IN ('api_key_missing', 'check_failed', 'not_found')) AS INT) AS cats
    FROM r0 GROUP BY domain)
"""


@query("osi_10_reputation_score", with_views(
    f'WITH {REP} SELECT domain, round(agg, 6) AS "aggregateScore" FROM rep', "v_rep"))
def _reputation_score(spark, folder):
    return E.reputation_summary(view(spark, folder, "v_rep")).select(
        "domain", F.round("aggregateScore", 6).alias("aggregateScore"))


@query("osi_11_reputation_flags", with_views(
    f'WITH {REP} SELECT domain, known AS "knownMalicious", bad AS "maliciousCount", n AS "totalChecks", '
    'cats AS "categoryCount" FROM rep', "v_rep"))
def _reputation_flags(spark, folder):
    return E.reputation_summary(view(spark, folder, "v_rep")).drop("status", "aggregateScore")


@query("osi_11_reputation_categories", with_views(
    "SELECT domain, category, count(*) AS n FROM v_rep WHERE category <> '' AND category NOT IN "
    "('api_key_missing', 'check_failed', 'not_found') GROUP BY domain, category", "v_rep"))
def _reputation_categories(spark, folder):
    return E.reputation_categories(view(spark, folder, "v_rep"))


def bundle(spark, folder):
    return E.osint_bundle(
        E.whois_records(whois_raw(spark, folder), AS_OF), E.dns_summary(view(spark, folder, "v_dns")),
        E.reputation_summary(view(spark, folder, "v_rep")))


BUNDLE = f"""{WHOIS}, {DNS}, {REP},
  bundle AS MATERIALIZED (SELECT coalesce(w.domain, d.domain, r.domain) AS domain, w.domain IS NOT NULL AS "hasWhois",
      d.domain IS NOT NULL AS "hasDns", r.domain IS NOT NULL AS "hasReputation", w.registrar, w.age, w.private,
      coalesce(w.age < 30, false) AS recent, d.mx, d.cdn, d.nA, d.nAAAA, d.nMX, d.nNS, d.nTXT, d.nCNAME, r.agg, r.known, r.bad
    FROM (SELECT * FROM whois WHERE status = 'success') w
    FULL JOIN (SELECT * FROM dns WHERE status = 'success') d ON w.domain = d.domain
    FULL JOIN rep r ON coalesce(w.domain, d.domain) = r.domain)
"""
OSINT = """
  SELECT *, CASE WHEN "hasWhois" THEN age END AS "domainAgeDays", coalesce("hasWhois" AND recent, false) AS "isNewlyRegistered",
    coalesce("hasWhois" AND age < 365, false) AS "isYoungDomain", coalesce("hasWhois" AND private, false) AS "hasPrivacyProtection",
    coalesce("hasDns" AND mx, false) AS "hasValidMx", coalesce("hasDns" AND cdn, false) AS "usesCdn",
    CASE WHEN "hasDns" THEN nA + nAAAA + nMX + nNS + nTXT ELSE 0 END AS "dnsRecordCount", coalesce("hasDns", false) AS "hasValidDns",
    CASE WHEN "hasReputation" THEN agg ELSE 0.0::DOUBLE END AS "reputationScore",
    CASE WHEN "hasReputation" THEN bad ELSE 0 END AS "maliciousSourceCount",
    coalesce("hasReputation" AND known, false) AS "isKnownMalicious", coalesce("hasWhois", false) AS "hasValidWhois"
"""
QUALITY = """
  SELECT *, CAST("isNewlyRegistered" AS INT) + CAST("isYoungDomain" AND NOT "isNewlyRegistered" AS INT)
      + CAST("hasPrivacyProtection" AS INT) + CAST("hasValidDns" AND NOT "hasValidMx" AS INT) + CAST("isKnownMalicious" AS INT)
      + CAST("maliciousSourceCount" > 0 AS INT) AS "osintRiskIndicators",
    (CAST("hasValidWhois" AS INT) + CAST("hasValidDns" AS INT) + 1) / 3.0::DOUBLE AS "dataCompleteness",
    (CAST(coalesce("hasWhois", false) AS INT) + CAST(coalesce("hasDns", false) AS INT)
      + CAST(coalesce("hasReputation", false) AS INT)) / 3.0::DOUBLE AS "dataQuality"
"""
_BUNDLE_VIEWS = ("v_whois", "v_dns", "v_rep")


@query("joi_04_enrichment_bundle", with_views(f"""WITH {BUNDLE}
  SELECT domain, "hasWhois", "hasDns", "hasReputation", registrar, age AS "domainAgeDays", round(agg, 6) AS "aggregateScore" FROM bundle""",
  *_BUNDLE_VIEWS))
def _bundle(spark, folder):
    return bundle(spark, folder).select("domain", "hasWhois", "hasDns", "hasReputation", "registrar", "domainAgeDays",
                                        F.round("aggregateScore", 6).alias("aggregateScore"))


_O = ", ".join(f'"{c}"' for c in rules.OSINT_FEATURES if c != "reputationScore")


@query("osi_12_osint_features", with_views(f"""WITH {BUNDLE}, o AS ({OSINT} FROM bundle)
  SELECT domain, {_O}, round("reputationScore", 6) AS "reputationScore" FROM o""", *_BUNDLE_VIEWS))
def _osint_features(spark, folder):
    return E.add_osint_features(bundle(spark, folder)).withColumn(
        "reputationScore", F.round("reputationScore", 6)).select("domain", *rules.OSINT_FEATURES)


@query("osi_13_osint_quality", with_views(f"""WITH {BUNDLE}, o AS ({OSINT} FROM bundle), q AS ({QUALITY} FROM o)
  SELECT domain, "osintRiskIndicators", round("dataCompleteness", 6) AS "dataCompleteness", round("dataQuality", 6) AS "dataQuality" FROM q""",
  *_BUNDLE_VIEWS))
def _osint_quality(spark, folder):
    return E.add_osint_quality(E.add_osint_features(bundle(spark, folder))).select(
        "domain", "osintRiskIndicators", F.round("dataCompleteness", 6).alias("dataCompleteness"),
        F.round("dataQuality", 6).alias("dataQuality"))


@query("osi_14_osint_summary", with_views(f"""WITH {BUNDLE}
  SELECT domain, coalesce("hasDns" AND nA + nAAAA > 0, false) AS "summaryHasValidDns",
    round(CASE WHEN "hasReputation" THEN agg ELSE 0.5 END, 6) AS "summaryReputation",
    coalesce("hasWhois" AND private, false) AS "summaryIsPrivate", coalesce(bad > 0, false) AS "inBlacklists" FROM bundle""",
  *_BUNDLE_VIEWS))
def _osint_summary(spark, folder):
    out = bundle(spark, folder).withColumns(E.osint_summary_columns())
    return out.select("domain", "summaryHasValidDns", F.round("summaryReputation", 6).alias("summaryReputation"),
                      "summaryIsPrivate", "inBlacklists")


@query("osi_15_age_and_label", with_views(f"""WITH {BUNDLE}
  SELECT domain, CASE WHEN age IS NULL THEN 'Unknown' WHEN age < 30 THEN 'Very New' WHEN age < 180 THEN 'New' ELSE 'Established' END AS tier,
    CASE WHEN age IS NULL THEN NULL WHEN age < 1 THEN 'Less than a day' WHEN age = 1 THEN '1 day' WHEN age < 30 THEN age || ' days'
      WHEN age < 365 THEN CASE WHEN age // 30 = 1 THEN '1 month' ELSE (age // 30) || ' months' END
      WHEN (age % 365) // 30 = 0 THEN CASE WHEN age // 365 = 1 THEN '1 year' ELSE (age // 365) || ' years' END
      ELSE (age // 365) || 'y ' || ((age % 365) // 30) || 'm' END AS age,
    CASE WHEN agg >= 0.7 THEN 'Good' WHEN agg >= 0.4 THEN 'Fair' ELSE 'Poor' END AS label FROM bundle""", *_BUNDLE_VIEWS))
def _age_and_label(spark, folder):
    return bundle(spark, folder).select(
        "domain", E.age_tier(F.col("domainAgeDays")).alias("tier"), E.age_text(F.col("domainAgeDays")).alias("age"),
        E.reputation_label(F.col("aggregateScore")).alias("label"))


# ---------------------------------------------------------------------- joins
_SITES = "SELECT page_id, 'd' || CAST(page_id % 60 AS STRING) || '.com' AS domain, url FROM v_url"


def _sites(spark, folder):
    """URLs with a domain that the snapshots know for most rows."""
    return view(spark, folder, "v_url").withColumn(
        "domain", F.concat(F.lit("d"), (F.col("page_id") % 60).cast("string"), F.lit(".com")))


def dns_cache(spark, folder):
    """Snapshot in the shape of the lookup cache (its count includes CNAME)."""
    return E.dns_summary(view(spark, folder, "v_dns")).select(
        "domain", (F.col("status") == "success").alias("hasValidDns"), "hasValidMx", "usesCdn",
        E.dns_record_count(count_cname=True).alias("dnsRecordCount"))


@query("joi_01_features_with_dns", with_views(f"""WITH {DNS}, src AS ({_SITES}), {PARTS}, {FEATURES}
  SELECT f.page_id, f."urlLength", coalesce(d.status = 'success', false) AS "hasValidDns", coalesce(d.mx, false) AS "hasValidMx",
    coalesce(d.cdn, false) AS "usesCdn", coalesce(nA + nAAAA + nMX + nNS + nTXT + nCNAME, 0) AS "dnsRecordCount"
  FROM feats2 f LEFT JOIN dns d ON f.domain = d.domain""", "v_url", "v_dns"))
def _features_with_dns(spark, folder):
    feats = urls.url_features(_sites(spark, folder)).select("page_id", "domain", "urlLength")
    joined = feats.join(dns_cache(spark, folder), "domain", "left")
    false = F.lit(False)
    return joined.select("page_id", "urlLength", F.coalesce("hasValidDns", false).alias("hasValidDns"),
                         F.coalesce("hasValidMx", false).alias("hasValidMx"), F.coalesce("usesCdn", false).alias("usesCdn"),
                         F.coalesce("dnsRecordCount", F.lit(0)).alias("dnsRecordCount"))


@query("joi_02_cache_misses", with_views(f"""SELECT DISTINCT domain FROM ({_SITES}) s
  WHERE domain NOT IN (SELECT lower(domain) FROM v_dns)""", "v_url", "v_dns"))
def _cache_misses(spark, folder):
    return E.cache_misses(_sites(spark, folder).select("domain").distinct(), view(spark, folder, "v_dns").select("domain"))


@query("joi_03_cache_merge", with_views("""
  WITH b AS (SELECT upper(domain) AS domain, observed_at, seq FROM v_dns WHERE observed_at < TIMESTAMP '2024-01-15'
             UNION ALL SELECT domain, observed_at, seq FROM v_dns WHERE observed_at >= TIMESTAMP '2024-01-15')
  SELECT lower(domain) AS domain, max(observed_at) AS observed_at, arg_max(seq, (observed_at, seq)) AS seq FROM b GROUP BY lower(domain)""", "v_dns"))
def _cache_merge(spark, folder):
    both = view(spark, folder, "v_dns").select("domain", "observed_at", "seq")
    old = both.where("observed_at < TIMESTAMP '2024-01-15'").withColumn("domain", F.upper("domain"))
    return E.merge_cache(old, both.where("observed_at >= TIMESTAMP '2024-01-15'"))


@query("joi_05_as_of_enrichment", with_views("""
  WITH e AS (SELECT event_id, ts, 'd' || CAST(user_id % 50 AS STRING) || '.com' AS domain FROM events),
  s AS (SELECT seq, domain, observed_at, status FROM v_dns WHERE rtype = 'A')
  SELECT e.event_id, e.domain, e.ts, s.seq, s.status, s.observed_at FROM e ASOF LEFT JOIN s ON e.domain = s.domain AND e.ts >= s.observed_at""",
  "v_dns"))
def _as_of(spark, folder):
    from .views import table
    events = table(spark, folder, "events").select("event_id", "ts", F.concat(
        F.lit("d"), (F.col("user_id") % 50).cast("string"), F.lit(".com")).alias("domain"))
    snaps = view(spark, folder, "v_dns").where("rtype = 'A'").select("domain", "observed_at", "seq", "status")
    return E.as_of_join(events, snaps)


@query("joi_06_domain_suffix", with_views(f"""WITH src AS (SELECT * FROM v_url), {PARTS}
  SELECT page_id, regexp_matches(site0, '(?:^|\\.)(?:google\\.com|example\\.net|applepie\\.com)$') AS "isLegitimate" FROM u3""", "v_url"))
def _domain_suffix(spark, folder):
    hosts = urls.url_components(view(spark, folder, "v_url")).select("page_id", "site")
    # The set comes from the table itself: the base domains of three known hosts.
    known = (hosts.select(F.explode(urls.U.domain_suffixes(F.col("site"))).alias("domain")).distinct()
             .where(F.col("domain").isin("google.com", "example.net", "applepie.com")))
    return urls.legitimate_by_join(hosts, known).select("page_id", "isLegitimate")


@query("joi_07_blocklist", with_views(f"""WITH src AS ({_SITES}),
  b AS (SELECT domain, max(confidence) AS c, min(category) AS k FROM v_rep WHERE isMalicious GROUP BY domain)
  SELECT s.domain, 'internal' AS source, b.c IS NOT NULL AS "isMalicious", coalesce(b.c, 0.0)::DOUBLE AS confidence,
    CASE WHEN b.c IS NULL THEN 'no_data' ELSE b.k END AS category FROM (SELECT DISTINCT domain FROM src) s LEFT JOIN b USING (domain)""",
  "v_url", "v_rep"))
def _blocklist(spark, folder):
    bad = view(spark, folder, "v_rep").where("isMalicious").select("domain", "confidence", "category")
    return E.blocklist_checks(_sites(spark, folder).select("domain").distinct(), bad)
