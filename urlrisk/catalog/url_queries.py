"""URL feature jobs as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..operators import urls
from .registry import query
from .views import view, with_views


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return "(" + ", ".join(_lit(w) for w in words) + ")"


def _alt(words) -> str:
    from ..functions.strings import quote_all
    return quote_all(words)


_WS = "' ' || chr(9) || chr(10) || chr(13)"

# Parse columns, written for DuckDB.
PARTS = f"""
  u0 AS (SELECT *, CASE WHEN starts_with(trim(url, {_WS}), 'http://') OR starts_with(trim(url, {_WS}), 'https://')
                   THEN trim(url, {_WS}) ELSE 'https://' || trim(url, {_WS}) END AS n FROM src),
  u1 AS (SELECT *, lower(regexp_extract(n, '^https?://([^/?#]*)', 1)) AS loc,
           regexp_replace(regexp_extract(n, '^https?://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS pth,
           regexp_extract(n, '^[^?#]*\\?([^#]*)', 1) AS qry,
           regexp_extract(n, '^[^#]*#(.*)$', 1) AS frg,
           url_decode(n) AS dec, url_decode(lower(n)) AS decl FROM u0),
  u2 AS (SELECT *, CASE WHEN starts_with(loc, '[') THEN regexp_extract(loc, '^\\[[^\\]]*\\]', 0)
                        ELSE regexp_replace(loc, ':[^:]*$', '') END AS hst,
           split_part(loc, ':', 1) AS site0 FROM u1),
  u3 AS (SELECT *, regexp_matches(trim(hst, '[]'), '{rules.IPV4}') OR regexp_matches(hst, '{rules.IPV6}') AS ip,
           string_split(hst, '.') AS labs, string_split(site0, '.') AS slabs FROM u2)
"""

_TWO = _list(rules.TWO_PART_TLDS)

FEATURES = f"""
  feats AS (SELECT *,
    CAST(length(n) AS INT) AS "urlLength", CAST(length(hst) AS INT) AS "domainLength",
    CAST(CASE WHEN ip OR len(labs) <= 2 THEN 0
         WHEN labs[-2] || '.' || labs[-1] IN {_TWO} THEN greatest(0, len(labs) - 3)
         ELSE len(labs) - 2 END AS INT) AS "subdomainCount",
    CAST(CASE WHEN trim(pth, '/') = '' THEN 0 ELSE len(string_split(trim(pth, '/'), '/')) END AS INT) AS "pathDepth",
    ip AS "hasIpAddress", contains(n, '@') AS "hasAtSymbol", contains(pth, '//') AS "hasDoubleSlash",
    contains(hst, '-') AS "hasDashInDomain", contains(hst, '_') AS "hasUnderscoreInDomain",
    starts_with(n, 'https://') AS "isHttps",
    CASE WHEN starts_with(loc, '[') THEN contains(loc, ']:')
         ELSE regexp_matches(loc, ':[0-9]+$') AND NOT regexp_matches(loc, ':0*(80|443)$') END AS "hasPortNumber",
    (CASE WHEN ip THEN '' ELSE labs[-1] END) IN {_list(rules.SUSPICIOUS_TLDS)} AS "hasSuspiciousTld",
    regexp_matches(n, '%[0-9a-fA-F][0-9a-fA-F]') AS "hasEncodedChars",
    regexp_matches(decl, '{_alt(rules.SUSPICIOUS_KEYWORDS)}') AS "hasSuspiciousKeywords",
    CASE WHEN hst = '' THEN 0.0 ELSE CAST(len(regexp_extract_all(hst, '[0-9]')) AS DOUBLE) / length(hst) END AS "digitRatio",
    CAST(length(regexp_replace(lower(n), '[a-z0-9._~:/?#\\[\\]@!$&''()*+,;=-]', '', 'g')) AS INT) AS "specialCharCount",
    CAST(len(list_distinct(list_transform(
         list_filter(string_split(qry, '&'), lambda p: regexp_matches(p, '^[^=]*=.')),
         lambda p: url_decode(replace(split_part(p, '=', 1), '+', ' '))))) AS INT) AS "queryParamCount"
  FROM u3),
  feats2 AS (SELECT *,
    CAST("hasIpAddress" AS INT) + CAST("hasAtSymbol" AS INT) + CAST("hasDoubleSlash" AS INT)
      + CAST("hasUnderscoreInDomain" AS INT) + CAST("hasPortNumber" AS INT) + CAST("hasSuspiciousTld" AS INT)
      + CAST("hasSuspiciousKeywords" AS INT) AS "suspiciousFeatureCount",
    "subdomainCount" >= 2 OR "pathDepth" >= 4 OR "queryParamCount" >= 3 AS "isHighlyStructured" FROM feats)
"""

_QUOTED = ", ".join(f'"{c}"' for c in rules.URL_FEATURES)


def from_urls(body: str, *more: str) -> str:
    """DuckDB text over v_url with the shared parse and feature expressions."""
    parts = ["src AS (SELECT * FROM v_url)", PARTS, FEATURES, *more]
    return with_views("WITH " + ", ".join(parts) + " " + body, "v_url")


def features(spark, folder):
    return urls.url_features(view(spark, folder, "v_url"))


# One query per feature column keeps the comparison readable; the wide one is the job itself.
@query("url_01_features", from_urls(f'SELECT page_id, {_QUOTED} FROM feats2'))
def _features(spark, folder):
    return features(spark, folder).select("page_id", *rules.URL_FEATURES)


@query("url_02_feature_counts", from_urls(
    'SELECT page_id, "suspiciousFeatureCount", "isHighlyStructured" FROM feats2'))
def _feature_counts(spark, folder):
    return features(spark, folder).select("page_id", "suspiciousFeatureCount", "isHighlyStructured")


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
COMPONENTS = f"""
  c0 AS (SELECT *, regexp_matches(site0, '^(?:{_OCTET}\\.){{3}}{_OCTET}$') AS quad,
           len(slabs) >= 3 AND slabs[-2] || '.' || slabs[-1] IN {_TWO} AS two FROM feats2),
  comps AS (SELECT page_id, split_part(n, ':', 1) AS scheme, site0 AS site,
    CASE WHEN NOT quad AND two AND len(slabs) > 3 THEN array_to_string(slabs[1:len(slabs)-3], '.')
         WHEN NOT quad AND NOT two AND len(slabs) > 2 THEN array_to_string(slabs[1:len(slabs)-2], '.') END AS subdomain,
    CASE WHEN quad OR len(slabs) < 2 THEN site0 WHEN two THEN slabs[-3] ELSE slabs[-2] END AS base,
    CASE WHEN quad OR len(slabs) < 2 THEN '' WHEN two THEN slabs[-2] || '.' || slabs[-1] ELSE slabs[-1] END AS tld,
    pth AS path, nullif(qry, '') AS query, nullif(frg, '') AS fragment FROM c0)
"""


@query("url_03_components", from_urls("SELECT * FROM comps", COMPONENTS))
def _components(spark, folder):
    return urls.url_components(view(spark, folder, "v_url")).select(
        "page_id", "scheme", "site", "subdomain", "base", "tld", "path", "query", "fragment")


# RE2 has no look-ahead: the same sets of hosts, written without it.
_WITHOUT_LOOKAHEAD = {
    2: "apple[^a-z]|[^a-z]apple($|[^sp]|s$|s[^a]|sa$|sa[^u]|sau$|sau[^c]|sauc$|sauc[^e]|p$|p[^i]|pi$|pi[^e])",
    12: "chase[^a-z]|[^a-z]chase($|[^rdnyi]|i$|i[^n]|in$|in[^g])",
    13: "irs[^a-z]|[^a-z]irs($|[a-z])",
    15: "dhl[^a-z]|[^a-z]dhl($|[a-z])",
    16: "usps[^a-z]|[^a-z]usps($|[a-z])",
}


def _rule_rows() -> str:
    """UNION ALL of one branch per rule."""
    out = []
    for i, r in enumerate(rules.URL_RULES):
        target = "site0" if r.on_host else "n" if r.kind == rules.OBFUSCATION else "dec"
        pattern = _lit("(?i)" + _WITHOUT_LOOKAHEAD.get(i, r.pattern))
        guard = " AND NOT legit" if r.kind == rules.BRAND else ""
        # Where the pattern had to be rewritten, the matched text may hold one more character.
        matched = "'-'" if i in _WITHOUT_LOOKAHEAD else f"regexp_extract({target}, {pattern}, 0)"
        out.append(f"SELECT page_id, {i} AS rule, {_lit(r.kind)} AS type, {matched} AS matched, "
                   f"CAST({r.severity} AS DOUBLE) AS severity, {_lit(r.description)} AS description "
                   f"FROM base WHERE regexp_matches({target}, {pattern}){guard}")
    return " UNION ALL ".join(out)


_LEGIT = f"""base AS MATERIALIZED (SELECT *, regexp_matches(site0,
   '(?:^|\\.)(?:{_alt(rules.LEGITIMATE_BRAND_DOMAINS)})$') AS legit FROM feats2)"""
HITS = f"{_LEGIT}, hits AS MATERIALIZED ({_rule_rows()})"
STATS = """
  agg AS (SELECT page_id, count(*) AS cnt, max(severity) AS mx,
            list_sum(list(severity ORDER BY rule)) AS total, count(*) FILTER (WHERE severity >= 0.8) AS strong,
            count(*) FILTER (WHERE type = 'brand_impersonation') AS k1,
            count(*) FILTER (WHERE type = 'url_obfuscation') AS k2,
            count(*) FILTER (WHERE type = 'credential_harvesting') AS k3,
            count(*) FILTER (WHERE type = 'suspicious_structure') AS k4,
            count(*) FILTER (WHERE type = 'urgency_indicator') AS k5,
            count(*) FILTER (WHERE type = 'suspicious_tld') AS k6
          FROM hits GROUP BY page_id),
  st0 AS (SELECT b.*, coalesce(cnt, 0) AS "patternCount", coalesce(mx, 0.0) AS "maxSeverity",
            coalesce(total / cnt, 0.0) AS "avgSeverity", coalesce(strong, 0) AS strong,
            coalesce(k1,0) AS k1, coalesce(k2,0) AS k2, coalesce(k3,0) AS k3, coalesce(k4,0) AS k4,
            coalesce(k5,0) AS k5, coalesce(k6,0) AS k6
          FROM base b LEFT JOIN agg USING (page_id)),
  st AS MATERIALIZED (SELECT *, CASE WHEN "patternCount" = 0 THEN
            CASE WHEN "isHttps" THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END
              + CASE WHEN length(n) > 100 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END
              + CASE WHEN length(n) > 200 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
          ELSE least("maxSeverity" * 0.5::DOUBLE + "avgSeverity" * 0.3::DOUBLE
               + least("patternCount" / 5.0::DOUBLE, 1.0::DOUBLE) * 0.2::DOUBLE
               + CASE WHEN "isHttps" THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END, 1.0::DOUBLE) END AS "structuralScore" FROM st0)
"""


def analysis(spark, folder):
    return urls.url_analysis(view(spark, folder, "v_url"))


def _shown(df):
    """Hits in long form; rewritten patterns show no matched text (see above)."""
    return df.withColumn("matched", F.when(F.col("rule").isin(*_WITHOUT_LOOKAHEAD), "-").otherwise(F.col("matched")))


@query("url_04_pattern_hits", from_urls("SELECT * FROM hits", HITS))
def _hits(spark, folder):
    return _shown(urls.explode_hits(analysis(spark, folder), "page_id"))


@query("ext_01_custom_rules", with_views("""
  SELECT page_id, CAST(contains(url, 'page=2') AS INT) + CAST(regexp_matches(url, '/(en|fr)/') AS INT) AS "patternCount",
    greatest(CASE WHEN contains(url, 'page=2') THEN 0.2 ELSE 0 END, CASE WHEN regexp_matches(url, '/(en|fr)/') THEN 0.4 ELSE 0 END)::DOUBLE AS "maxSeverity"
  FROM v_url WHERE page_id < 1000000000000""", "v_url"))
def _custom_rules(spark, folder):
    """Rules of the caller in place of the given ones."""
    mine = (rules.UrlRule("paging", "page=2", 0.2, "second page"), rules.UrlRule("language", "/(en|fr)/", 0.4, "language folder"))
    own = view(spark, folder, "v_url").where("page_id < 1000000000000")  # the URLs of the pages themselves
    return urls.url_analysis(own, url_rules=mine, legitimate=()).select("page_id", "patternCount", "maxSeverity")


@query("url_05_brand_hits", from_urls(
    "SELECT page_id, rule, severity, description FROM hits WHERE type = 'brand_impersonation'", HITS))
def _brand_hits(spark, folder):
    return urls.explode_hits(urls.hits_of_type(analysis(spark, folder), rules.BRAND), "page_id").select(
        "page_id", "rule", "severity", "description")


@query("url_05_obfuscation_hits", from_urls(
    "SELECT page_id, rule, matched, severity FROM hits WHERE type = 'url_obfuscation'", HITS))
def _obfuscation_hits(spark, folder):
    return urls.explode_hits(urls.hits_of_type(analysis(spark, folder), rules.OBFUSCATION), "page_id").select(
        "page_id", "rule", "matched", "severity")


@query("url_06_structural_score", from_urls(
    'SELECT page_id, round("structuralScore", 6) AS "structuralScore" FROM st', HITS, STATS))
def _structural_score(spark, folder):
    return analysis(spark, folder).select("page_id", F.round("structuralScore", 6).alias("structuralScore"))


_NOTES = """SELECT page_id, concat_ws('|',
    CASE WHEN legit THEN 'Domain matches known legitimate brand' END,
    CASE WHEN NOT "isHttps" THEN 'URL does not use HTTPS encryption' END,
    CASE WHEN "patternCount" = 0 THEN 'No suspicious patterns detected' END,
    CASE WHEN k1 > 0 THEN k1 || ' Brand Impersonation pattern(s) detected' END,
    CASE WHEN k2 > 0 THEN k2 || ' Url Obfuscation pattern(s) detected' END,
    CASE WHEN k3 > 0 THEN k3 || ' Credential Harvesting pattern(s) detected' END,
    CASE WHEN k4 > 0 THEN k4 || ' Suspicious Structure pattern(s) detected' END,
    CASE WHEN k5 > 0 THEN k5 || ' Urgency Indicator pattern(s) detected' END,
    CASE WHEN k6 > 0 THEN k6 || ' Suspicious Tld pattern(s) detected' END,
    CASE WHEN strong > 0 THEN strong || ' high-severity indicator(s) found' END) AS notes FROM st"""


@query("url_07_notes", from_urls(_NOTES, HITS, STATS))
def _notes(spark, folder):
    return analysis(spark, folder).select("page_id", F.array_join("notes", "|").alias("notes"))


@query("url_08_structural_level", from_urls("""
    SELECT level, count(*) AS n FROM (SELECT CASE WHEN "structuralScore" < 0.2 THEN 'safe'
       WHEN "structuralScore" < 0.4 THEN 'low' WHEN "structuralScore" < 0.6 THEN 'medium'
       WHEN "structuralScore" < 0.8 THEN 'high' ELSE 'critical' END AS level FROM st) GROUP BY level""", HITS, STATS))
def _structural_level(spark, folder):
    return (analysis(spark, folder).groupBy(F.col("structuralLevel").alias("level"))
            .agg(F.count("*").alias("n")))


@query("url_09_pattern_stats", from_urls("""
    SELECT page_id, "patternCount", round("maxSeverity", 6) AS "maxSeverity",
           round("avgSeverity", 6) AS "avgSeverity" FROM st""", HITS, STATS))
def _pattern_stats(spark, folder):
    return analysis(spark, folder).select(
        "page_id", F.col("patternCount").cast("bigint").alias("patternCount"),
        F.round("maxSeverity", 6).alias("maxSeverity"), F.round("avgSeverity", 6).alias("avgSeverity"))


@query("url_10_url_vector", from_urls(
    "SELECT page_id, " + ", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in rules.URL_FEATURES) + " FROM feats2"))
def _url_vector(spark, folder):
    return urls.as_vector_columns(features(spark, folder), rules.URL_FEATURES, "page_id")


@query("url_11_links", with_views("""
    SELECT page_id, CAST(i - 1 AS INT) AS "linkNo", l[i] AS url FROM (
      SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
        SELECT page_id, regexp_extract_all(html, 'https?://[!$-_a-z]+') AS l FROM v_html))""", "v_html"))
def _links(spark, folder):
    return urls.extract_links(view(spark, folder, "v_html"), "html", "page_id")


@query("url_11_link_features", with_views("WITH src AS (SELECT page_id, unnest(regexp_extract_all(html, "
       "'https?://[!$-_a-z]+')) AS url FROM v_html), " + PARTS + ", " + FEATURES + f"""
       SELECT page_id, url, {_QUOTED} FROM feats2""", "v_html"))
def _link_features(spark, folder):
    links = urls.extract_links(view(spark, folder, "v_html"), "html", "page_id")
    return urls.url_features(links).select("page_id", "url", *rules.URL_FEATURES)
