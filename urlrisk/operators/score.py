"""Scoring jobs: component scores, blend, verdict, reasons.

A component is a list of (condition, amount, sentence).  The same list gives the
score, as a sum in list order, and the factors, as the sentences that apply.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions.staging import computed_once
from ..functions.strings import contains_any, first_items, present, round_half_up
from .urls import step_level


@dataclass(frozen=True)
class Weights:
    """Shares of the three components; they must sum to one."""

    url: float = 0.25
    osint: float = 0.35
    combined: float = 0.40

    def __post_init__(self):
        if abs(self.url + self.osint + self.combined - 1.0) > 0.001:
            raise ValueError("weights must sum to 1")


@dataclass(frozen=True)
class Thresholds:
    """Level bounds and the bound of a phishing verdict."""

    bounds: tuple = rules.LEVEL_BOUNDS
    phishing: float = rules.PHISHING_THRESHOLD

    def __post_init__(self):
        if list(self.bounds) != sorted(set(self.bounds)):
            raise ValueError("level bounds must increase")


@dataclass(frozen=True)
class Limits:
    """How many reasons are shown; ``None`` for all."""

    score: int | None = rules.SCORE_REASONS
    verdict_text: int | None = rules.VERDICT_TEXT_REASONS
    verdict_url: int | None = rules.VERDICT_URL_REASONS
    verdict: int | None = rules.VERDICT_REASONS


def _n(col: str) -> Column:
    return F.col(col).cast("string")


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def url_rules() -> list[tuple]:
    c = F.col
    return [
        (c("urlLength") > 75, F.least((c("urlLength") - 75) / 100.0, F.lit(0.3)), _say("Long URL (", _n("urlLength"), " chars)")),
        (c("hasIpAddress"), 0.4, "Uses IP address instead of domain name"),
        (c("hasAtSymbol"), 0.35, "Contains @ symbol (potential redirect attack)"),
        (c("hasDoubleSlash"), 0.25, "Contains double slash in path"),
        (c("hasUnderscoreInDomain"), 0.2, "Domain contains underscore"),
        (c("hasSuspiciousTld"), 0.25, "Uses suspicious top-level domain"),
        (~c("isHttps"), 0.15, "Does not use HTTPS"),
        (c("hasSuspiciousKeywords"), 0.2, "Contains suspicious keywords"),
        (c("hasPortNumber"), 0.2, "Uses explicit port number"),
        (c("hasEncodedChars"), 0.15, "Contains URL-encoded characters"),
        (c("digitRatio") > 0.3, 0.15, "High ratio of digits in domain"),
        (c("pathDepth") > 4, 0.1, _say("Deep URL path (", _n("pathDepth"), " levels)")),
        (c("subdomainCount") > 2, 0.15, _say("Multiple subdomains (", _n("subdomainCount"), ")")),
        (c("queryParamCount") > 4, 0.1, _say("Many query parameters (", _n("queryParamCount"), ")")),
        (c("patternCount") > 0, c("structuralScore") * 0.3, _say(_n("patternCount"), " suspicious pattern(s) detected")),
    ]


def osint_rules() -> list[tuple]:
    c = F.col
    return [
        (c("isKnownMalicious"), 0.8, "URL is in known malicious lists"),
        (c("maliciousSourceCount") > 0, F.least(c("maliciousSourceCount") * 0.25, F.lit(0.5)),
         _say(_n("maliciousSourceCount"), " reputation source(s) flagged malicious")),
        (c("reputationScore") > 0.3, c("reputationScore") * 0.4,
         _say("Poor reputation score (", F.format_string("%.2f", F.bround("reputationScore", 2)), ")")),
        (c("isNewlyRegistered"), 0.35, "Domain registered within last 30 days"),
        (~c("isNewlyRegistered") & c("isYoungDomain"), 0.2, "Domain less than 1 year old"),
        (F.coalesce(c("domainAgeDays") < 7, F.lit(False)), 0.15, "Domain registered within last 7 days"),
        (c("hasPrivacyProtection"), 0.1, "WHOIS privacy protection enabled"),
        (c("hasValidDns") & ~c("hasValidMx"), 0.15, "No valid mail server configuration"),
        (c("hasValidDns") & (c("dnsRecordCount") < 3), 0.1, "Minimal DNS configuration"),
        (~c("hasValidWhois"), 0.1, "WHOIS data unavailable"),
        (~c("hasValidDns"), 0.1, "DNS resolution failed"),
    ]


def combined_rules() -> list[tuple]:
    c = F.col
    risky = c("totalRiskIndicators")
    return [
        (risky >= 5, 0.4, _say("High number of risk indicators (", _n("totalRiskIndicators"), ")")),
        ((risky >= 3) & (risky < 5), 0.2, _say("Multiple risk indicators (", _n("totalRiskIndicators"), ")")),
        (c("isNewlyRegistered") & c("hasSuspiciousKeywords"), 0.3, "New domain with phishing keywords"),
        (c("hasIpAddress") & ~c("isHttps"), 0.25, "IP address without HTTPS"),
        ((c("urlLength") > 100) & c("hasSuspiciousTld") & c("hasSuspiciousKeywords"), 0.25,
         "Long URL with suspicious TLD and keywords"),
        (c("isYoungDomain") & c("isHighlyStructured"), 0.2, "Complex URL structure on young domain"),
        ((c("dataCompleteness") < 0.7) & (c("suspiciousFeatureCount") >= 2), 0.15,
         "Incomplete OSINT data with suspicious URL features"),
        (c("usesCdn") & c("hasSuspiciousKeywords"), 0.1, "CDN used with suspicious keywords"),
        ((c("digitRatio") > 0.2) & c("hasSuspiciousTld"), 0.15, "High digit ratio with suspicious TLD"),
    ]


def _component(items: list[tuple]) -> tuple[Column, Column]:
    amount = lambda cond, x: F.when(cond, x if isinstance(x, Column) else F.lit(float(x))).otherwise(F.lit(0.0))
    total = F.lit(0.0)
    for cond, x, _ in items:
        total = total + amount(cond, x)
    factors = present([F.when(cond, s if isinstance(s, Column) else F.lit(s)) for cond, _, s in items])
    return F.least(total, F.lit(1.0)), factors


def add_component_scores(df: DataFrame) -> DataFrame:
    """The three raw component scores (0..1) with their factors."""
    df = df.withColumn("totalRiskIndicators", F.col("suspiciousFeatureCount") + F.col("osintRiskIndicators"))
    out = {}
    for name, items in (("url", url_rules()), ("osint", osint_rules()), ("combined", combined_rules())):
        out[f"{name}Score"], out[f"{name}Factors"] = _component(items)
    return df.withColumns(out)


def ranked_reasons(factors: Column, level: Column, most: int | None = rules.SCORE_REASONS) -> Column:
    """Distinct factors, the two priority classes first, in stable order, ``most`` at most."""
    distinct = F.array_distinct(factors)
    rank = lambda f: (F.when(contains_any(F.lower(f), rules.HIGH_PRIORITY_WORDS), 0)
                      .when(contains_any(F.lower(f), rules.MEDIUM_PRIORITY_WORDS), 1).otherwise(2))
    keyed = F.transform(distinct, lambda f, i: F.struct(rank(f).alias("r"), i.alias("i"), f.alias("f")))
    ordered = first_items(F.transform(F.array_sort(keyed), lambda x: x["f"]), most)
    nothing = F.when(level == "safe", F.array(F.lit("No significant risk indicators detected"))).otherwise(
        F.array(F.lit("Unable to determine specific risk factors")))
    return F.when(F.size(factors) == 0, nothing).otherwise(ordered)


def add_risk_score(df: DataFrame, weights: Weights = Weights(), thresholds: Thresholds = Thresholds(),
                   model_score: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """Final score, level, confidence and reasons of a URL.

    With ``model_score`` the model's probability replaces the weighted blend.
    """
    blend = (F.col("urlScore") * weights.url + F.col("osintScore") * weights.osint
             + F.col("combinedScore") * weights.combined)
    final = F.least(F.greatest(blend if model_score is None else F.col(model_score), F.lit(0.0)), F.lit(1.0))
    confidence = F.least(
        F.lit(0.3) + F.col("dataCompleteness") * 0.5 + F.when(F.col("patternCount") > 0, 0.1).otherwise(F.lit(0.0)) + 0.1,
        F.lit(1.0))
    if model_score is not None:
        confidence = F.least(confidence + 0.2, F.lit(1.0))
    return (df.withColumn("finalScore", final)
            .withColumns({
                "riskLevel": step_level(F.col("finalScore"), rules.LEVELS, thresholds.bounds),
                "confidence": confidence})
            .withColumns({
                "reasons": ranked_reasons(F.concat("urlFactors", "osintFactors", "combinedFactors"), F.col("riskLevel"), limits.score),
                "isPhishing": F.col("riskLevel").isin("dangerous", "critical"),
                "isSuspicious": F.col("riskLevel") != "safe",
            }))


def components(weights: Weights = Weights()) -> Column:
    """Components as an array of structs: name, raw score, weight, weighted score, category, factors."""
    one = lambda label, name, weight, category: F.struct(
        F.lit(label).alias("name"), F.col(f"{name}Score").alias("rawScore"), F.lit(weight).alias("weight"),
        (F.col(f"{name}Score") * weight).alias("weightedScore"), F.lit(category).alias("category"),
        F.col(f"{name}Factors").alias("factors"))
    return F.array(one("URL Structure", "url", weights.url, "url_structure"),
                   one("OSINT Analysis", "osint", weights.osint, "osint_derived"),
                   one("Feature Analysis", "combined", weights.combined, "domain_analysis"))


def component_map(items: Column) -> Column:
    """Component name -> weighted score."""
    return F.map_from_entries(F.transform(items, lambda c: F.struct(c["name"], c["weightedScore"])))


def flag_at_threshold(score: Column, threshold: float = rules.PHISHING_THRESHOLD) -> Column:
    return score >= threshold


def add_verdict(df: DataFrame, kind: str = "kind", thresholds: Thresholds = Thresholds(),
                model_line: bool = False, limits: Limits = Limits()) -> DataFrame:
    """Combine URL score, text confidence and enrichment into one verdict per message."""
    false = F.lit(False)
    age = F.col("domainAgeDays")
    recent = F.coalesce((age > 0) & (age < 30), false)
    private = F.coalesce(F.col("hasWhois") & F.col("isPrivacyProtected"), false)
    side = (F.when(F.coalesce("hasReputation", false), F.col("aggregateScore"))
            .when(F.coalesce("hasWhois", false), F.when(recent, 0.3).otherwise(F.lit(0.0))
                  + F.when(private, 0.2).otherwise(F.lit(0.0)))
            .otherwise(0.0))
    is_url = F.col(kind) == "url"
    combined = F.when(is_url, F.col("finalScore") * 0.85 + F.col("textConfidence") * 0.15).otherwise(
        F.col("textConfidence") * 0.55 + F.least(F.col("totalRiskIndicators") / 10.0, F.lit(1.0)) * 0.25 + side * 0.20)
    none = F.array().cast("array<string>")
    reasons = F.concat(
        present([F.when(is_url, F.concat(F.lit("ML model confidence: "),
                                         F.format_string("%.1f", F.bround(F.col("finalScore") * 100, 1)), F.lit("%")))])
        if model_line else none,
        first_items(F.col("textReasons"), limits.verdict_text),
        F.when(is_url, first_items(F.col("reasons"), limits.verdict_url)).otherwise(none),
        present([
            F.when(recent, _say("Domain registered recently (", age.cast("string"), " days ago)")),
            F.when(private, "WHOIS privacy protection enabled"),
            F.when(F.coalesce(F.col("maliciousCount") > 0, false),
                   _say("Found in ", _n("maliciousCount"), " blacklists")),
        ]))
    scored = df.withColumn("_combined", F.least(F.greatest(combined, F.lit(0.0)), F.lit(1.0)))
    return computed_once(
        scored.withColumns({
            "verdictIsPhishing": F.col("_combined") >= thresholds.phishing,
            "verdictScore": round_half_up(F.col("_combined"), 3),
            "threatLevel": step_level(F.col("_combined"), rules.LEVELS, thresholds.bounds),
            "verdictReasons": first_items(reasons, limits.verdict),
        }).drop("_combined"),
        "verdictIsPhishing", "verdictScore", "threatLevel", "verdictReasons")


def recommendation(level: Column) -> Column:
    """Advice for a level, from a literal map."""
    table = F.create_map(*[F.lit(x) for pair in rules.RECOMMENDATIONS for x in pair])
    return F.coalesce(F.try_element_at(table, level), F.lit("Unable to assess. Proceed with caution."))


def reason_group(reason: Column) -> Column:
    """First group whose pattern the reason matches."""
    out = None
    for name, pattern in rules.REASON_GROUPS:
        test = reason.rlike("(?id)" + pattern)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("other")
