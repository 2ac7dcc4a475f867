"""Message and scoring jobs as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..operators import content as C, enrich as E, score as S
from ..plans import scoring
from ..plans.analysers import word_analyser
from . import osint_queries as O, text_queries as X, url_queries as Q
from .registry import query
from .url_queries import _lit
from .views import view, with_views

# ------------------------------------------------------------------ messages
_TRIMMED = f"trim(content, {X._WS})"
_BARE, _BARE_ANY = rules.BARE_DOMAIN, rules.BARE_DOMAIN_ANY_CASE
SCORING_TYPE = f"""CASE WHEN regexp_matches(lower({_TRIMMED}), '^(https?://|www\\.)') OR regexp_matches(lower({_TRIMMED}), {_lit(_BARE)})
   THEN 'url' WHEN regexp_matches(lower(content), 'from:|subject:|to:') THEN 'email' ELSE 'text' END"""
DOMAIN = f"""nullif(CASE
   WHEN regexp_matches({_TRIMMED}, '^(https?://|www\\.)') THEN
     CASE WHEN contains(loc0, '[') <> contains(loc0, ']') THEN NULL ELSE replace(loc0, 'www.', '') END
   WHEN regexp_matches({_TRIMMED}, {_lit(_BARE_ANY)}) THEN lower(split_part({_TRIMMED}, '/', 1))
   WHEN regexp_matches(content, 'https?://(?:[a-zA-Z0-9-]+\\.)+[a-zA-Z]{{2,}}') THEN
     replace(lower(regexp_extract(content, 'https?://((?:[a-zA-Z0-9-]+\\.)+[a-zA-Z]{{2,}})', 1)), 'www.', '')
   ELSE lower(regexp_extract(content, '@([a-zA-Z0-9-]+(?:\\.[a-zA-Z0-9-]+)+)', 1)) END, '')"""
_LOC = f"lower(regexp_extract(CASE WHEN contains({_TRIMMED}, '://') THEN {_TRIMMED} ELSE 'http://' || {_TRIMMED} END, '^[a-z]+://([^/?#]*)', 1)) AS loc0"


@query("prj_06_compose_email", """
  SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'From: ' || o_orderstatus || chr(10) ELSE '' END
    || CASE WHEN o_orderpriority <> '5-LOW' THEN 'Subject: ' || o_orderpriority || chr(10) || chr(10) ELSE '' END
    || CAST(o_custkey AS VARCHAR) AS content FROM orders""")
def _compose(spark, folder):
    from .views import table
    c = F.col
    orders = table(spark, folder, "orders").select(
        "o_orderkey", c("o_custkey").cast("string").alias("body"),
        F.when(c("o_orderpriority") != "5-LOW", c("o_orderpriority")).alias("subject"),
        F.when(c("o_orderstatus") != "F", c("o_orderstatus")).otherwise("").alias("sender"))
    return orders.select("o_orderkey", C.compose_email(c("body"), c("subject"), c("sender")).alias("content"))


@query("prj_07_validation", X.over_messages(f"""
  SELECT coalesce(CASE WHEN {_TRIMMED} = '' THEN 'Content cannot be empty'
     WHEN content_type NOT IN ('auto','url','email','text') THEN 'Unknown content type' END, 'ok') AS state, count(*) AS n
  FROM msgs GROUP BY 1"""))
def _validation(spark, folder):
    checked = C.add_request_error(X.messages(spark, folder))
    return checked.groupBy(F.coalesce("requestError", F.lit("ok")).alias("state")).agg(F.count("*").alias("n"))


@query("prj_08_scoring_type", X.over_messages(f"SELECT msg_id, {SCORING_TYPE} AS kind FROM msgs"))
def _scoring_type(spark, folder):
    return X.messages(spark, folder).select("msg_id", C.scoring_type(F.col("content")).alias("kind"))


@query("prj_09_text_type", X.over_messages(f"""
  SELECT msg_id, CASE WHEN regexp_matches(lower({_TRIMMED}), '^(https?://|www\\.)') AND NOT contains(content, ' ') THEN 'url'
    WHEN regexp_matches({_TRIMMED}, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$')
      OR regexp_matches(lower(content), 'from:|subject:|to:') THEN 'email' ELSE 'text' END AS kind FROM msgs"""))
def _text_type(spark, folder):
    return X.messages(spark, folder).select("msg_id", C.text_type(F.col("content")).alias("kind"))


@query("prj_10_enrichment_domain", X.over_messages(
    f"SELECT msg_id, {DOMAIN} AS domain FROM (SELECT *, {_LOC} FROM msgs)"))
def _domain(spark, folder):
    return X.messages(spark, folder).select("msg_id", C.enrichment_domain(F.col("content")).alias("domain"))


# ------------------------------------------------------------------- scoring
def _sum(items) -> str:
    return "0.0::DOUBLE" + "".join(f"\n + CASE WHEN {c} THEN {a} ELSE 0.0::DOUBLE END" for c, a, _ in items)


def _texts(items) -> str:
    return "list_filter([" + ",\n".join(f"CASE WHEN {c} THEN {t} END" for c, _, t in items) + "], lambda x: x IS NOT NULL)"


_d = lambda x: f"{x}::DOUBLE"
URL_ITEMS = [
    ('"urlLength" > 75', 'least(("urlLength" - 75) / 100.0::DOUBLE, 0.3::DOUBLE)', "'Long URL (' || \"urlLength\" || ' chars)'"),
    ('"hasIpAddress"', _d(0.4), "'Uses IP address instead of domain name'"),
    ('"hasAtSymbol"', _d(0.35), "'Contains @ symbol (potential redirect attack)'"),
    ('"hasDoubleSlash"', _d(0.25), "'Contains double slash in path'"),
    ('"hasUnderscoreInDomain"', _d(0.2), "'Domain contains underscore'"),
    ('"hasSuspiciousTld"', _d(0.25), "'Uses suspicious top-level domain'"),
    ('NOT "isHttps"', _d(0.15), "'Does not use HTTPS'"),
    ('"hasSuspiciousKeywords"', _d(0.2), "'Contains suspicious keywords'"),
    ('"hasPortNumber"', _d(0.2), "'Uses explicit port number'"),
    ('"hasEncodedChars"', _d(0.15), "'Contains URL-encoded characters'"),
    ('"digitRatio" > 0.3', _d(0.15), "'High ratio of digits in domain'"),
    ('"pathDepth" > 4', _d(0.1), "'Deep URL path (' || \"pathDepth\" || ' levels)'"),
    ('"subdomainCount" > 2', _d(0.15), "'Multiple subdomains (' || \"subdomainCount\" || ')'"),
    ('"queryParamCount" > 4', _d(0.1), "'Many query parameters (' || \"queryParamCount\" || ')'"),
    ('"patternCount" > 0', '"structuralScore" * 0.3::DOUBLE', "\"patternCount\" || ' suspicious pattern(s) detected'"),
]
OSINT_ITEMS = [
    ('"isKnownMalicious"', _d(0.8), "'URL is in known malicious lists'"),
    ('"maliciousSourceCount" > 0', 'least("maliciousSourceCount" * 0.25::DOUBLE, 0.5::DOUBLE)',
     "\"maliciousSourceCount\" || ' reputation source(s) flagged malicious'"),
    ('"reputationScore" > 0.3', '"reputationScore" * 0.4::DOUBLE', "'Poor reputation score (' || printf('%.2f', \"reputationScore\") || ')'"),
    ('"isNewlyRegistered"', _d(0.35), "'Domain registered within last 30 days'"),
    ('NOT "isNewlyRegistered" AND "isYoungDomain"', _d(0.2), "'Domain less than 1 year old'"),
    ('coalesce("domainAgeDays" < 7, false)', _d(0.15), "'Domain registered within last 7 days'"),
    ('"hasPrivacyProtection"', _d(0.1), "'WHOIS privacy protection enabled'"),
    ('"hasValidDns" AND NOT "hasValidMx"', _d(0.15), "'No valid mail server configuration'"),
    ('"hasValidDns" AND "dnsRecordCount" < 3', _d(0.1), "'Minimal DNS configuration'"),
    ('NOT "hasValidWhois"', _d(0.1), "'WHOIS data unavailable'"),
    ('NOT "hasValidDns"', _d(0.1), "'DNS resolution failed'"),
]
COMBINED_ITEMS = [
    ('total >= 5', _d(0.4), "'High number of risk indicators (' || total || ')'"),
    ('total >= 3 AND total < 5', _d(0.2), "'Multiple risk indicators (' || total || ')'"),
    ('"isNewlyRegistered" AND "hasSuspiciousKeywords"', _d(0.3), "'New domain with phishing keywords'"),
    ('"hasIpAddress" AND NOT "isHttps"', _d(0.25), "'IP address without HTTPS'"),
    ('"urlLength" > 100 AND "hasSuspiciousTld" AND "hasSuspiciousKeywords"', _d(0.25), "'Long URL with suspicious TLD and keywords'"),
    ('"isYoungDomain" AND "isHighlyStructured"', _d(0.2), "'Complex URL structure on young domain'"),
    ('"dataCompleteness" < 0.7 AND "suspiciousFeatureCount" >= 2', _d(0.15), "'Incomplete OSINT data with suspicious URL features'"),
    ('"usesCdn" AND "hasSuspiciousKeywords"', _d(0.1), "'CDN used with suspicious keywords'"),
    ('"digitRatio" > 0.2 AND "hasSuspiciousTld"', _d(0.15), "'High digit ratio with suspicious TLD'"),
]
_HIGH, _MEDIUM = Q._alt(rules.HIGH_PRIORITY_WORDS), Q._alt(rules.MEDIUM_PRIORITY_WORDS)
_LEVEL = lambda s: (f"CASE WHEN {s} < 0.3 THEN 'safe' WHEN {s} < 0.5 THEN 'suspicious' WHEN {s} < 0.7 THEN 'dangerous' "
                    "ELSE 'critical' END")
# Needs ``st`` (URL part with hits) joined with the bundle as ``j``.
SCORES = f"""
  o AS ({O.OSINT} FROM j), q AS ({O.QUALITY} FROM o),
  t AS (SELECT *, "suspiciousFeatureCount" + "osintRiskIndicators" AS total FROM q),
  sc0 AS (SELECT *, least({_sum(URL_ITEMS)}, 1.0) AS us, least({_sum(OSINT_ITEMS)}, 1.0) AS os, least({_sum(COMBINED_ITEMS)}, 1.0) AS cs,
      {_texts(URL_ITEMS)} AS uf, {_texts(OSINT_ITEMS)} AS osf, {_texts(COMBINED_ITEMS)} AS cf FROM t),
  sc1 AS (SELECT *, us * 0.25::DOUBLE + os * 0.35::DOUBLE + cs * 0.40::DOUBLE AS fin FROM sc0),
  sc AS MATERIALIZED (SELECT *, {_LEVEL('fin')} AS lvl,
      least(0.3::DOUBLE + "dataCompleteness" * 0.5::DOUBLE + CASE WHEN "patternCount" > 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + 0.1::DOUBLE, 1.0) AS conf0
    FROM sc1),
  fac AS (SELECT page_id, f, i, CASE WHEN regexp_matches(lower(f), '{_HIGH}') THEN 0 WHEN regexp_matches(lower(f), '{_MEDIUM}') THEN 1 ELSE 2 END AS r
    FROM (SELECT page_id, l[i] AS f, i FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i
          FROM (SELECT page_id, list_concat(list_concat(uf, osf), cf) AS l FROM sc)))),
  fac1 AS (SELECT page_id, f, min(i) AS i, min(r) AS r FROM fac GROUP BY page_id, f),
  rea AS (SELECT page_id, list(f ORDER BY r, i)[1:10] AS rs FROM fac1 GROUP BY page_id),
  scored AS MATERIALIZED (SELECT sc.*, coalesce(rs, [CASE WHEN lvl = 'safe' THEN 'No significant risk indicators detected'
      ELSE 'Unable to determine specific risk factors' END]) AS rs FROM sc LEFT JOIN rea USING (page_id))
"""
_VIEWS = ("v_url", "v_whois", "v_dns", "v_rep")


def over_scored(body: str) -> str:
    """DuckDB text over the URLs of v_url, scored with the bundle."""
    parts = [f"src AS ({O._SITES})", Q.PARTS, Q.FEATURES, Q.HITS, Q.STATS, O.BUNDLE,
             "j AS (SELECT st.*, b.* EXCLUDE (domain) FROM st LEFT JOIN bundle b ON st.domain = b.domain)", SCORES]
    return with_views("WITH " + ", ".join(parts) + " " + body, *_VIEWS)


def scored_urls(spark, folder, **settings):
    sites = O._sites(spark, folder).withColumnRenamed("domain", "known")
    feats = scoring.U.with_parts(sites, "url")
    feats = scoring.U.add_feature_counts(scoring.U.add_features(feats, "url"))
    feats = scoring.U.drop_parts(scoring.U.add_structural_score(scoring.U.add_hits(feats, "url"), "url"))
    enriched = E.enrich(feats.withColumnRenamed("known", "domain"), O.bundle(spark, folder), row="page_id")
    return S.add_risk_score(S.add_component_scores(E.add_osint_quality(E.add_osint_features(enriched))), **settings)


def _component(name, column, factors):
    @query(name, over_scored(
        f"SELECT page_id, round({column}, 6) AS score, array_to_string({factors}, '|') AS factors FROM scored"))
    def run(spark, folder):
        spark_name = {"us": "url", "os": "osint", "cs": "combined"}[column]
        return scored_urls(spark, folder).select(
            "page_id", F.round(f"{spark_name}Score", 6).alias("score"),
            F.array_join(f"{spark_name}Factors", "|").alias("factors"))


_component("sco_01_url_score", "us", "uf")
_component("sco_02_osint_score", "os", "osf")
_component("sco_03_combined_score", "cs", "cf")


@query("sco_04_blend", over_scored('SELECT page_id, round(fin, 6) AS "finalScore" FROM scored'))
def _blend(spark, folder):
    return scored_urls(spark, folder).select("page_id", F.round("finalScore", 6).alias("finalScore"))


@query("ext_02_weights", over_scored("""SELECT page_id, round(us * 0.5::DOUBLE + os * 0.3::DOUBLE + cs * 0.2::DOUBLE, 6) AS "finalScore" FROM scored"""))
def _own_weights(spark, folder):
    return scored_urls(spark, folder, weights=S.Weights(0.5, 0.3, 0.2)).select("page_id", F.round("finalScore", 6).alias("finalScore"))


@query("ext_05_thresholds", over_scored("""SELECT page_id, CASE WHEN fin < 0.1 THEN 'safe' WHEN fin < 0.25 THEN 'suspicious' WHEN fin < 0.4 THEN 'dangerous' ELSE 'critical' END AS "riskLevel"
   FROM scored"""))
def _own_thresholds(spark, folder):
    return scored_urls(spark, folder, thresholds=S.Thresholds(bounds=(0.1, 0.25, 0.4), phishing=0.25)).select("page_id", "riskLevel")


@query("sco_06_risk_level", over_scored('SELECT lvl AS "riskLevel", count(*) AS n FROM scored GROUP BY lvl'))
def _risk_level(spark, folder):
    return scored_urls(spark, folder).groupBy("riskLevel").agg(F.count("*").alias("n"))


@query("sco_07_confidence", over_scored("SELECT page_id, round(conf0, 6) AS confidence FROM scored"))
def _score_confidence(spark, folder):
    return scored_urls(spark, folder).select("page_id", F.round("confidence", 6).alias("confidence"))


@query("sco_08_ranked_reasons", over_scored("SELECT page_id, array_to_string(rs, '|') AS reasons FROM scored"))
def _ranked(spark, folder):
    return scored_urls(spark, folder).select("page_id", F.array_join("reasons", "|").alias("reasons"))


@query("sco_09_components", over_scored("""
  SELECT page_id, 'URL Structure' AS name, round(us * 0.25, 6) AS weighted, len(uf) AS n FROM scored
  UNION ALL SELECT page_id, 'OSINT Analysis', round(os * 0.35, 6), len(osf) FROM scored
  UNION ALL SELECT page_id, 'Feature Analysis', round(cs * 0.40, 6), len(cf) FROM scored"""))
def _components(spark, folder):
    out = scored_urls(spark, folder).select("page_id", S.components().alias("parts"))
    out = out.withColumn("weights", S.component_map(F.col("parts")))
    return (out.select("page_id", "weights", F.explode("parts").alias("p"))
            .select("page_id", "p.name", F.round(F.col("weights")[F.col("p.name")], 6).alias("weighted"),
                    F.size("p.factors").cast("bigint").alias("n")))


@query("sco_17_flags", over_scored("""
  SELECT page_id, lvl IN ('dangerous', 'critical') AS "isPhishing", lvl <> 'safe' AS "isSuspicious", round(fin, 6) AS "finalScore" FROM scored"""))
def _flags(spark, folder):
    return scored_urls(spark, folder).select("page_id", "isPhishing", "isSuspicious", F.round("finalScore", 6).alias("finalScore"))


@query("flt_02_threshold", over_scored('SELECT page_id FROM scored WHERE fin >= 0.5'))
def _threshold(spark, folder):
    return scored_urls(spark, folder).where(S.flag_at_threshold(F.col("finalScore"))).select("page_id")


# ------------------------------------------------- verdicts over all messages
_CHECKED = f"""
  msgs AS MATERIALIZED (SELECT msg_id, content_type, trim(content, {X._WS}) AS content FROM v_msg),
  routed AS MATERIALIZED (SELECT *, {DOMAIN} AS domain,
      CASE WHEN content_type = 'auto' THEN {SCORING_TYPE} ELSE content_type END AS kind,
      CASE WHEN content = '' THEN 'Content cannot be empty' WHEN content_type NOT IN ('auto','url','email','text') THEN 'Unknown content type' END AS err
    FROM (SELECT *, {_LOC} FROM msgs)),
  active AS (SELECT * FROM routed WHERE kind IN ('email', 'text')),
  src AS (SELECT msg_id, msg_id AS page_id, content AS url, kind, domain, err FROM routed)
"""
# Content as a URL; the rules and the score apply to the rows of kind url.  The four
# parse columns of an unusable row (empty, broken brackets) give the default features.
_REPLACE_FEATS = f"""
  fixed AS (SELECT * REPLACE ({", ".join(
      f'CASE WHEN bad THEN {"length(url)" if c == "urlLength" else "0.0" if c == "digitRatio" else "0" if c in ("domainLength", "subdomainCount", "pathDepth", "specialCharCount", "queryParamCount") else "false"} ELSE "{c}" END AS "{c}"'
      for c in rules.URL_FEATURES)}) FROM (SELECT *, url = '' OR contains(loc, '[') <> contains(loc, ']') AS bad FROM feats)),
  feats2 AS MATERIALIZED (SELECT *,
    CAST("hasIpAddress" AS INT) + CAST("hasAtSymbol" AS INT) + CAST("hasDoubleSlash" AS INT)
      + CAST("hasUnderscoreInDomain" AS INT) + CAST("hasPortNumber" AS INT) + CAST("hasSuspiciousTld" AS INT)
      + CAST("hasSuspiciousKeywords" AS INT) AS "suspiciousFeatureCount",
    "subdomainCount" >= 2 OR "pathDepth" >= 4 OR "queryParamCount" >= 3 AS "isHighlyStructured" FROM fixed)
"""
_FEATS_ONLY = Q.FEATURES[:Q.FEATURES.index("feats2 AS")].rstrip().rstrip(",")
_URL_HITS = Q.HITS.replace("FROM base WHERE ", "FROM base WHERE kind = 'url' AND NOT bad AND ")
_VERDICT = f"""
  v0 AS (SELECT s.*, tv.conf AS tconf, tv.n AS tn, tv.tl, tv.reasons AS trs, "domainAgeDays" AS a,
      coalesce("hasWhois" AND private, false) AS priv, coalesce("domainAgeDays" > 0 AND "domainAgeDays" < 30, false) AS rec,
      coalesce(s.err, CASE WHEN s.kind IN ('email','text') AND bl.msg_id IS NOT NULL THEN 'Invalid IPv6 URL' END) AS error
    FROM scored s JOIN tver tv ON s.msg_id = tv.msg_id
    LEFT JOIN (SELECT DISTINCT msg_id FROM links WHERE contains(regexp_extract(link, '^https?://([^/?#]*)', 1), '[')
        <> contains(regexp_extract(link, '^https?://([^/?#]*)', 1), ']')) bl ON s.msg_id = bl.msg_id),
  v1 AS (SELECT *, CASE WHEN kind = 'url' THEN fin * 0.85::DOUBLE + tconf * 0.15::DOUBLE
      ELSE tconf * 0.55::DOUBLE + least(total / 10.0::DOUBLE, 1.0) * 0.25::DOUBLE + (CASE WHEN coalesce("hasReputation", false) THEN agg
        WHEN coalesce("hasWhois", false) THEN CASE WHEN rec THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN priv THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
        ELSE 0.0::DOUBLE END) * 0.20::DOUBLE END AS comb FROM v0),
  ver AS MATERIALIZED (SELECT *, floor(least(greatest(comb, 0.0), 1.0) * 1000 + 0.5) / 1000 AS vs, {_LEVEL('comb')} AS vl,
      list_concat(list_concat(trs[1:5], CASE WHEN kind = 'url' THEN rs[1:3] ELSE []::VARCHAR[] END), list_filter([
        CASE WHEN rec THEN 'Domain registered recently (' || a || ' days ago)' END,
        CASE WHEN priv THEN 'WHOIS privacy protection enabled' END,
        CASE WHEN coalesce(bad_1 > 0, false) THEN 'Found in ' || bad_1 || ' blacklists' END], lambda x: x IS NOT NULL))[1:10] AS vr FROM v1)
"""


def over_verdicts(body: str, text_parts=(X.TEXT_HITS, X.OTHER_HITS, X.ALL_HITS, X.TEXT_VERDICT)) -> str:
    """DuckDB text over all messages with their verdicts in ``ver``."""
    scores = SCORES.replace(" bad ELSE", " bad_1 ELSE")
    parts = [_CHECKED, Q.PARTS, _FEATS_ONLY, _REPLACE_FEATS, _URL_HITS, Q.STATS, O.BUNDLE,
             'j AS (SELECT st.*, b.* EXCLUDE (domain, bad), b.bad AS bad_1 FROM st LEFT JOIN bundle b ON st.domain = b.domain)',
             scores, *text_parts, _VERDICT]
    return with_views("WITH " + ", ".join(parts) + " " + body, "v_msg", "v_whois", "v_dns", "v_rep")


def verdicts(spark, folder):
    return scoring.score_messages(X.messages(spark, folder), O.bundle(spark, folder))


@query("sco_10_url_verdict", over_verdicts("SELECT msg_id, vs AS score FROM ver WHERE kind = 'url' AND error IS NULL"))
def _url_verdict(spark, folder):
    return verdicts(spark, folder).where("kind = 'url' AND success").select("msg_id", F.col("confidenceScore").alias("score"))


@query("sco_11_message_verdict", over_verdicts("SELECT msg_id, vs AS score FROM ver WHERE kind <> 'url' AND error IS NULL"))
def _message_verdict(spark, folder):
    return verdicts(spark, folder).where("kind <> 'url' AND success").select("msg_id", F.col("confidenceScore").alias("score"))


@query("sco_12_verdict_level", over_verdicts("""
  SELECT kind, vl AS "threatLevel", comb >= 0.5 AS "isPhishing", count(*) AS n FROM ver WHERE error IS NULL GROUP BY ALL"""))
def _verdict_level(spark, folder):
    return (verdicts(spark, folder).where("success").groupBy("kind", "threatLevel", "isPhishing")
            .agg(F.count("*").alias("n")))


@query("sco_13_verdict_reasons", over_verdicts("SELECT msg_id, array_to_string(vr, '|') AS reasons FROM ver WHERE error IS NULL"))
def _verdict_reasons(spark, folder):
    return verdicts(spark, folder).where("success").select("msg_id", F.array_join("reasons", "|").alias("reasons"))


_ADVICE = " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in rules.RECOMMENDATIONS)


@query("sco_14_recommendation", over_verdicts(
    f"SELECT CASE vl {_ADVICE} END AS recommendation, count(*) AS n FROM ver WHERE error IS NULL GROUP BY 1"))
def _recommendation(spark, folder):
    return verdicts(spark, folder).where("success").groupBy("recommendation").agg(F.count("*").alias("n"))


@query("sco_15_feature_summary", over_verdicts("""
  SELECT msg_id, "suspiciousFeatureCount" AS "urlFeatures", tn AS "textFeatures", "osintRiskIndicators" AS "osintFeatures",
    total + tn AS "totalRiskIndicators", array_to_string(tl, ',') AS "detectedTactics" FROM ver WHERE error IS NULL"""))
def _feature_summary(spark, folder):
    return verdicts(spark, folder).where("success").select(
        "msg_id", "urlFeatures", F.col("textFeatures").cast("bigint").alias("textFeatures"), "osintFeatures",
        F.col("totalRiskIndicators").cast("bigint").alias("totalRiskIndicators"),
        F.array_join("detectedTactics", ",").alias("detectedTactics"))


SCO_16 = f"""
  SELECT msg_id, error IS NULL AS success, kind, domain, coalesce(error IS NULL AND comb >= 0.5, false) AS "isPhishing",
    CASE WHEN error IS NULL THEN vs ELSE 0.0 END AS "confidenceScore", CASE WHEN error IS NULL THEN vl ELSE 'safe' END AS "threatLevel",
    CASE WHEN error IS NULL THEN array_to_string(vr, '|') ELSE 'Analysis error' END AS reasons,
    CASE WHEN error IS NULL THEN CASE vl {_ADVICE} END ELSE 'Unable to analyze content. Please try again.' END AS recommendation,
    CASE WHEN error IS NULL AND domain IS NOT NULL THEN a END AS "domainAgeDays",
    CASE WHEN error IS NULL AND domain IS NOT NULL THEN registrar END AS registrar,
    CASE WHEN error IS NULL AND domain IS NOT NULL THEN priv END AS "isPrivate",
    CASE WHEN error IS NULL AND domain IS NOT NULL THEN coalesce("hasDns" AND nA + nAAAA > 0, false) END AS "hasValidDns",
    CASE WHEN error IS NULL AND domain IS NOT NULL THEN round(CASE WHEN "hasReputation" THEN agg ELSE 0.5 END, 6) END AS "reputationScore",
    CASE WHEN error IS NULL AND domain IS NOT NULL THEN coalesce(bad_1 > 0, false) END AS "inBlacklists",
    CASE WHEN error IS NULL THEN total + tn ELSE 0 END AS "totalRiskIndicators",
    CASE WHEN error IS NULL THEN array_to_string(tl, ',') ELSE '' END AS "detectedTactics", error FROM ver
"""


def flat_verdicts(df):
    """Verdicts with arrays as text, for comparison and for CSV."""
    return df.select(
        "msg_id", "success", "kind", "domain", "isPhishing", "confidenceScore", "threatLevel",
        F.array_join("reasons", "|").alias("reasons"), "recommendation", "domainAgeDays", "registrar", "isPrivate", "hasValidDns",
        F.round("reputationScore", 6).alias("reputationScore"), "inBlacklists",
        F.col("totalRiskIndicators").cast("bigint").alias("totalRiskIndicators"),
        F.array_join("detectedTactics", ",").alias("detectedTactics"), "error")


@query("sco_16_score_messages", over_verdicts(SCO_16))
def score_all(spark, folder):
    return flat_verdicts(verdicts(spark, folder))


_WORDS = {"act now": 0.9, "account": 0.5, "password": 0.8, "click": 0.4}
_HELD = [f"CAST(kind IN ('email', 'text') AND contains(lower(content), '{w}') AS INT)" for w in _WORDS]
_WORD_VERDICT = f"""
  links AS (SELECT NULL::VARCHAR AS msg_id, NULL::VARCHAR AS link WHERE false),
  tver AS MATERIALIZED (SELECT msg_id, n, CASE WHEN n > 0 THEN ['urgency_pressure'] ELSE []::VARCHAR[] END AS tl, least(n * 0.25::DOUBLE, 1.0::DOUBLE) AS conf,
      CASE WHEN n > 0 THEN ['Holds ' || n || ' listed words'] ELSE []::VARCHAR[] END AS reasons FROM (SELECT msg_id, {" + ".join(_HELD)} AS n FROM routed))
"""


@query("ext_03_analyser", over_verdicts(SCO_16, (_WORD_VERDICT,)))
def _own_analyser(spark, folder):
    """Verdicts with another text analyser in place of the built-in one."""
    return flat_verdicts(scoring.score_messages(X.messages(spark, folder), O.bundle(spark, folder), analyser=word_analyser(_WORDS)))
