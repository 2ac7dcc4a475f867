"""The scoring plan: messages in, one explained verdict per message out.

One pass computes everything that depends on the content; the content itself is
dropped before the only shuffle, the join with the per-domain bundle.  The same
function serves batch tables and streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.staging import computed_once
from ..operators import content as C, enrich as E, score as S, text as T, urls as U
from . import analysers

RESULT = (
    "msg_id", "success", "kind", "domain", "isPhishing", "confidenceScore", "threatLevel", "reasons", "recommendation",
    "domainAgeDays", "registrar", "isPrivate", "hasValidDns", "reputationScore", "inBlacklists",
    "urlFeatures", "textFeatures", "osintFeatures", "totalRiskIndicators", "detectedTactics", "error",
)


def content_signals(messages: DataFrame, url_rules=U.rules.URL_RULES, legitimate=U.rules.LEGITIMATE_BRAND_DOMAINS,
                    analyser=T.text_analysis) -> DataFrame:
    """All signals that need the content: type, domain, URL features, URL hits, text verdict.

    Input: ``msg_id, content, content_type`` and any other columns, which stay.
    ``url_rules`` and ``legitimate`` replace the pattern rules and the brand hosts;
    ``analyser`` is any function (table, text column, type column) that adds the
    columns of the text analysis; see ``plans.analysers``.
    """
    checked = C.add_request_error(messages)
    given = F.col("content_type")
    kind = F.when(given == "auto", C.scoring_type(F.col("content"))).otherwise(given)
    routed = computed_once(
        checked.withColumns({"kind": kind, "domain": C.enrichment_domain(F.col("content"))}),
        "requestError", "content", "kind", "domain")
    # The pattern rules apply to URLs only; other rows pass a null and skip them.
    parts = U.with_parts(routed, "content").withColumn("_url", F.when(F.col("kind") == "url", F.col("content")))
    out = U.add_feature_counts(U.add_features(parts, "content"))
    out = U.drop_parts(U.add_structural_score(U.add_hits(out, "_url", url_rules, legitimate), "_url")).drop("_url", "hits", "notes", "structuralLevel")
    return analysers.checked(analyser)(out, "content", "kind").drop("content", "content_type")


def verdicts(signals: DataFrame, bundle: DataFrame, weights: S.Weights = S.Weights(),
             thresholds: S.Thresholds = S.Thresholds(), model=None, limits: S.Limits = S.Limits()) -> DataFrame:
    """Join the enrichment, score, and decide; a bad row gets an error, never an exception."""
    enriched = E.add_osint_quality(E.add_osint_features(E.enrich(signals, bundle)))
    scored = S.add_component_scores(enriched)
    if model is not None:
        from ..operators.model import add_probability
        scored = add_probability(scored, model, "modelScore")
    scored = S.add_risk_score(scored, weights, thresholds, "modelScore" if model is not None else None, limits)
    scored = scored.drop("isPhishing", "confidence", "isSuspicious")
    scored = S.add_verdict(scored, thresholds=thresholds, model_line=model is not None, limits=limits)

    error = F.coalesce("requestError", F.when(
        F.col("kind").isin("email", "text") & F.col("hasBrokenLink"), "Invalid IPv6 URL"))
    decided = scored.withColumn("error", error).withColumns(E.osint_summary_columns())
    ok, known = F.col("error").isNull(), F.col("error").isNull() & F.col("domain").isNotNull()
    or_else = lambda value, other: F.when(ok, value).otherwise(other)
    return decided.select(
        *[c for c in signals.columns if c not in _SIGNALS and c not in ("msg_id", "kind", "domain")],
        "msg_id", ok.alias("success"), "kind", "domain",
        or_else(F.col("verdictIsPhishing"), F.lit(False)).alias("isPhishing"),
        or_else(F.col("verdictScore"), F.lit(0.0)).alias("confidenceScore"),
        or_else(F.col("threatLevel"), F.lit("safe")).alias("threatLevel"),
        or_else(F.col("verdictReasons"), F.array(F.lit("Analysis error"))).alias("reasons"),
        or_else(S.recommendation(F.col("threatLevel")),
                F.lit("Unable to analyze content. Please try again.")).alias("recommendation"),
        F.when(known, F.col("domainAgeDays")).alias("domainAgeDays"),
        F.when(known, F.col("registrar")).alias("registrar"),
        F.when(known, F.col("summaryIsPrivate")).alias("isPrivate"),
        F.when(known, F.col("summaryHasValidDns")).alias("hasValidDns"),
        F.when(known, F.col("summaryReputation")).alias("reputationScore"),
        F.when(known, F.col("inBlacklists")).alias("inBlacklists"),
        or_else(F.col("suspiciousFeatureCount"), F.lit(0)).alias("urlFeatures"),
        or_else(F.col("indicatorCount"), F.lit(0)).alias("textFeatures"),
        or_else(F.col("osintRiskIndicators"), F.lit(0)).alias("osintFeatures"),
        or_else(F.col("totalRiskIndicators") + F.col("indicatorCount"), F.lit(0)).alias("totalRiskIndicators"),
        or_else(F.col("tactics"), F.array().cast("array<string>")).alias("detectedTactics"),
        "error")


_SIGNALS = frozenset(
    ("requestError", "suspiciousFeatureCount", "isHighlyStructured", "isLegitimate", "patternCount", "maxSeverity",
     "avgSeverity", "structuralScore", "indicatorCount", "highSeverityCount", "tactics", "textConfidence",
     "textIsPhishing", "textLevel", "textReasons", "hasBrokenLink")
    + tuple(c for c, _, _ in T.KINDS) + tuple(U.rules.URL_FEATURES))


def score_messages(messages: DataFrame, bundle: DataFrame, weights: S.Weights = S.Weights(),
                   thresholds: S.Thresholds = S.Thresholds(), model=None, limits: S.Limits = S.Limits(), **extensions) -> DataFrame:
    """Messages ``(msg_id, content, content_type)`` and the per-domain bundle -> verdicts.

    ``extensions`` are the replaceable parts of ``content_signals``.
    """
    return verdicts(content_signals(messages, **extensions), bundle, weights, thresholds, model, limits)


def score_urls(urls: DataFrame, bundle: DataFrame | None = None, url: str = "url", key: str = "url_id",
               weights: S.Weights = S.Weights(), thresholds: S.Thresholds = S.Thresholds(), model=None, limits: S.Limits = S.Limits()) -> DataFrame:
    """URL scores without the text part: components, final score, level, confidence, reasons."""
    parts = U.with_parts(urls, url)
    site = F.lower(U.U.host_before_first_colon(F.col("_netloc")))
    out = U.add_feature_counts(U.add_features(parts, url)).withColumn("domain", F.when(site != "", site))
    out = U.drop_parts(U.add_structural_score(U.add_hits(out, url), url))
    if bundle is None:
        none = {"hasWhois": "boolean", "hasDns": "boolean", "hasReputation": "boolean", "domainAgeDays": "int",
                "recentlyRegistered": "boolean", "isPrivacyProtected": "boolean", "hasValidMx": "boolean",
                "usesCdn": "boolean", "aggregateScore": "double", "maliciousCount": "int", "knownMalicious": "boolean",
                **{f"n{t}": "int" for t in U.rules.DNS_TYPES}}
        enriched = out.withColumns({n: F.lit(None).cast(t) for n, t in none.items()})
    else:
        enriched = E.enrich(out, bundle, row=key)
    scored = S.add_component_scores(E.add_osint_quality(E.add_osint_features(enriched)))
    if model is not None:
        from ..operators.model import add_probability
        scored = add_probability(scored, model, "modelScore")
    return S.add_risk_score(scored, weights, thresholds, "modelScore" if model is not None else None, limits)
