"""URL jobs: feature table, components, pattern hits, structural score, vectors.

Every job is ``DataFrame -> DataFrame`` made of Column expressions, so it is one
narrow stage with no shuffle and no Python workers.  The parse results are named
columns of an earlier projection, so each is computed once per row and not once
per rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions import urlparts as U
from ..functions.staging import computed_once, explode_rows
from ..functions.strings import contains_any_plain, percent_decode, present

HIT_TYPE = "array<struct<rule:int,type:string,matched:string,severity:double,description:string>>"

#: Runs of characters that a URL may hold, listed one by one for a table lookup.
_ALLOWED = "[" + "".join(c if c.isalnum() else "\\" + c for c in rules.URL_ALLOWED_CHARS) + "]+"

_PARTS = ("_normal", "_text", "_netloc", "_path", "_query", "_lowered", "_host", "_is_ip", "_bad")


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add the parse columns (leading underscore) that the URL jobs share."""
    parts = (
        df.withColumn("_normal", U.normalised(F.coalesce(F.col(url), F.lit(""))))
        .withColumn("_text", U.parsable(F.col("_normal")))
        .withColumns({
            "_netloc": U.netloc(F.col("_text")),
            "_path": U.path(F.col("_text")),
            "_query": U.query(F.col("_text")),
            "_lowered": percent_decode(F.lower("_normal")),
        })
        .withColumns({
            "_host": U.host_before_last_colon(F.col("_netloc")),
            "_bad": U.broken_brackets(F.col("_netloc")),
        })
        .withColumn("_is_ip", U.is_ip(F.col("_host")))
    )
    return computed_once(parts, *_PARTS)


def drop_parts(df: DataFrame) -> DataFrame:
    return df.drop(*_PARTS)


def _subdomain_count() -> Column:
    n = U.label_count(F.col("_host"))
    two_part = U.last_labels(F.col("_host"), 2).isin(*rules.TWO_PART_TLDS)
    return (F.when(F.col("_is_ip") | (n <= 2), 0)
            .when(two_part, F.greatest(F.lit(0), n - 3))
            .otherwise(n - 2))


def _path_depth() -> Column:
    inner = F.btrim(F.col("_path"), F.lit("/"))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, "/")))


def _has_port() -> Column:
    location = F.col("_netloc")
    default = "|".join(str(p) for p in rules.DEFAULT_PORTS)
    explicit = location.rlike(r":\d+$") & ~location.rlike(rf":0*(?:{default})$")
    return F.when(location.startswith("["), location.contains("]:")).otherwise(explicit)


def _feature_columns() -> dict[str, Column]:
    normal, host = F.col("_normal"), F.col("_host")
    digits = F.length(host) - F.length(F.regexp_replace(host, r"\p{Nd}+", ""))
    tld = F.when(F.col("_is_ip"), "").otherwise(U.last_labels(host, 1))
    return {
        "urlLength": F.length(normal),
        "domainLength": F.length(host),
        "subdomainCount": _subdomain_count(),
        "pathDepth": _path_depth(),
        "hasIpAddress": F.col("_is_ip"),
        "hasAtSymbol": normal.contains("@"),
        "hasDoubleSlash": F.col("_path").contains("//"),
        "hasDashInDomain": host.contains("-"),
        "hasUnderscoreInDomain": host.contains("_"),
        "isHttps": F.col("_text").startswith("https://"),
        "hasPortNumber": _has_port(),
        "hasSuspiciousTld": tld.isin(*rules.SUSPICIOUS_TLDS),
        "hasEncodedChars": normal.contains("%") & normal.rlike("%[0-9a-fA-F]{2}"),
        "hasSuspiciousKeywords": contains_any_plain(F.col("_lowered"), rules.SUSPICIOUS_KEYWORDS),
        "digitRatio": F.when(host == "", 0.0).otherwise(digits / F.length(host)),
        "specialCharCount": F.length(F.regexp_replace(F.lower(normal), _ALLOWED, "")),
        "queryParamCount": U.query_key_count(F.col("_query")),
    }


_INT_FEATURES = ("urlLength", "domainLength", "subdomainCount", "pathDepth", "specialCharCount", "queryParamCount")


def _default(name: str) -> Column:
    if name in _INT_FEATURES:
        return F.lit(0)
    return F.lit(0.0) if name == "digitRatio" else F.lit(False)


def add_features(parts: DataFrame, url: str = "url") -> DataFrame:
    """Add the 17 feature columns to a table that has the parse columns."""
    raw = F.coalesce(F.col(url), F.lit(""))
    usable = (raw != "") & ~F.col("_bad")
    out = {name: F.when(usable, expr).otherwise(_default(name)) for name, expr in _feature_columns().items()}
    out["urlLength"] = (F.when(usable, F.length(F.col("_normal")))
                        .otherwise(F.length(raw)))
    return parts.withColumns(out)


def add_feature_counts(df: DataFrame) -> DataFrame:
    """Number of raised suspicious flags, and whether the URL has a complex shape."""
    flags = ("hasIpAddress", "hasAtSymbol", "hasDoubleSlash", "hasUnderscoreInDomain",
             "hasPortNumber", "hasSuspiciousTld", "hasSuspiciousKeywords")
    count = sum((F.col(f).cast("int") for f in flags[1:]), F.col(flags[0]).cast("int"))
    shaped = (F.col("subdomainCount") >= 2) | (F.col("pathDepth") >= 4) | (F.col("queryParamCount") >= 3)
    return df.withColumns({"suspiciousFeatureCount": count, "isHighlyStructured": shaped})


def url_features(df: DataFrame, url: str = "url") -> DataFrame:
    """The feature table: input columns plus 17 features and the two counts."""
    return drop_parts(add_feature_counts(add_features(with_parts(df, url), url)))


def add_components(parts: DataFrame, url: str = "url") -> DataFrame:
    """Add scheme, host, subdomain, base, tld, query and fragment columns."""
    usable = (F.coalesce(F.col(url), F.lit("")) != "") & ~F.col("_bad")
    host = F.col("_site")
    n = F.size(F.col("_labels"))
    quad = U.is_dotted_quad(host)
    two_part = (n >= 3) & U.last_labels(host, 2).isin(*rules.TWO_PART_TLDS)
    tail = F.when(two_part, 3).otherwise(2)
    named = ~quad & (n >= 2)
    subdomain = F.when(named & (n > tail), F.array_join(F.slice(F.col("_labels"), F.lit(1), n - tail), "."))
    base = F.when(named, F.element_at(F.col("_labels"), -tail)).otherwise(host)
    tld = (F.when(~named, "").when(two_part, U.last_labels(host, 2))
           .otherwise(U.last_labels(host, 1)))
    blank_to_null = lambda c: F.when(c != "", c)
    return (
        parts.withColumn("_site", F.when(usable, U.host_before_first_colon(F.col("_netloc"))).otherwise(""))
        .withColumn("_labels", F.split(F.col("_site"), r"\."))
        .withColumns({
            "scheme": F.when(usable, F.when(F.col("_text").startswith("https://"), "https").otherwise("http"))
            .otherwise(""),
            "site": host,
            "subdomain": F.when(usable, blank_to_null(subdomain)),
            "base": base,
            "tld": tld,
            "path": F.when(usable, F.col("_path")).otherwise(""),
            "query": F.when(usable, blank_to_null(F.col("_query"))),
            "fragment": F.when(usable, blank_to_null(U.fragment(F.col("_text")))),
        })
        .drop("_site", "_labels")
    )


def url_components(df: DataFrame, url: str = "url") -> DataFrame:
    """The component table."""
    return drop_parts(add_components(with_parts(df, url), url))


def add_hits(parts: DataFrame, url: str = "url", url_rules: Sequence[rules.UrlRule] = rules.URL_RULES,
             legitimate: tuple = rules.LEGITIMATE_BRAND_DOMAINS) -> DataFrame:
    """Add ``isLegitimate`` and ``hits``: the rules that match, in rule order.

    Host rules read the host, obfuscation rules the URL as written, all others
    the decoded URL.  Brand rules do not apply to legitimate hosts.
    """
    usable = (F.coalesce(F.col(url), F.lit("")) != "") & ~F.col("_bad")

    def hit(number: int, rule: rules.UrlRule) -> Column:
        target = (F.col("_site") if rule.on_host
                  else F.col("_normal") if rule.kind == rules.OBFUSCATION else F.col("_decoded"))
        pattern = "(?id)" + rule.pattern
        found = target.rlike(pattern)
        if rule.kind == rules.BRAND:
            found = ~F.col("isLegitimate") & found
        return F.when(found, F.struct(
            F.lit(number).alias("rule"), F.lit(rule.kind).alias("type"),
            F.regexp_extract(target, pattern, 0).alias("matched"),
            F.lit(float(rule.severity)).alias("severity"), F.lit(rule.description).alias("description")))

    found = (present([hit(i, r) for i, r in enumerate(url_rules)]) if url_rules else F.array()).cast(HIT_TYPE)
    with_hits = (
        parts.withColumn("_site", F.when(usable, U.host_before_first_colon(F.col("_netloc"))).otherwise(""))
        .withColumns({"isLegitimate": U.in_domain_set(F.col("_site"), legitimate),
                      "_decoded": F.when(usable, percent_decode(F.col("_normal")))})
        .withColumn("hits", F.when(usable, found).otherwise(F.array().cast(HIT_TYPE)))
        .drop("_site", "_decoded")
    )
    return computed_once(with_hits, "isLegitimate", "hits")


def add_hit_stats(df: DataFrame) -> DataFrame:
    """Add the number of hits and their highest, summed and average severity."""
    severities = F.transform(F.col("hits"), lambda h: h["severity"])
    return (
        df.withColumn("_severities", severities)
        .withColumns({
            "patternCount": F.size("_severities"),
            "maxSeverity": F.coalesce(F.array_max("_severities"), F.lit(0.0)),
            "_total": F.aggregate("_severities", F.lit(0.0), lambda a, x: a + x),
        })
        .withColumn("avgSeverity", F.when(F.col("patternCount") > 0, F.col("_total") / F.col("patternCount"))
                    .otherwise(0.0))
        .drop("_severities", "_total")
    )


def add_structural_score(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``structuralScore`` (0..1), its five-step level and the notes.

    Needs the parse columns and ``hits``.
    """
    raw = F.coalesce(F.col(url), F.lit(""))
    plain = ~F.col("_text").startswith("https://")
    length = F.length(F.col("_normal"))
    zero = F.lit(0.0)
    quiet = (F.when(plain, 0.1).otherwise(zero) + F.when(length > 100, 0.05).otherwise(zero)
             + F.when(length > 200, 0.1).otherwise(zero))
    blend = (F.col("maxSeverity") * 0.5 + F.col("avgSeverity") * 0.3
             + F.least(F.col("patternCount") / 5.0, F.lit(1.0)) * 0.2)
    loud = F.least(blend + F.when(plain, 0.1).otherwise(zero), F.lit(1.0))
    score = (F.when((raw == "") | F.col("_bad"), 0.0)
             .when(F.col("patternCount") == 0, quiet).otherwise(loud))

    hits = F.col("hits")
    kinds = F.array_distinct(F.transform(hits, lambda h: h["type"]))
    per_kind = F.transform(kinds, lambda k: F.concat(
        F.size(F.filter(hits, lambda h: h["type"] == k)).cast("string"), F.lit(" "),
        F.initcap(F.replace(k, F.lit("_"), F.lit(" "))), F.lit(" pattern(s) detected")))
    strong = F.size(F.filter(hits, lambda h: h["severity"] >= 0.8))
    notes = F.concat(
        present([
            F.when(F.col("isLegitimate"), "Domain matches known legitimate brand"),
            F.when(plain, "URL does not use HTTPS encryption"),
            F.when(F.col("patternCount") == 0, "No suspicious patterns detected"),
        ]),
        per_kind,
        present([F.when(strong > 0, F.concat(strong.cast("string"), F.lit(" high-severity indicator(s) found")))]))
    notes = (F.when(raw == "", F.array(F.lit("Empty URL provided")))
             .when(F.col("_bad"), F.array(F.lit("URL parsing failed: Invalid IPv6 URL"))).otherwise(notes))
    return (add_hit_stats(df)
            .withColumn("structuralScore", score)
            .withColumns({"structuralLevel": step_level(F.col("structuralScore"), rules.STRUCTURAL_LEVELS,
                                                        rules.STRUCTURAL_BOUNDS),
                          "notes": notes}))


def step_level(score: Column, names: Sequence[str], bounds: Sequence[float]) -> Column:
    """Name of the half-open step a score falls into."""
    out = F.when(score < bounds[0], names[0])
    for bound, name in zip(bounds[1:], names[1:]):
        out = out.when(score < bound, name)
    return out.otherwise(names[-1])


def url_analysis(df: DataFrame, url: str = "url", url_rules: Sequence[rules.UrlRule] = rules.URL_RULES,
                 legitimate: tuple = rules.LEGITIMATE_BRAND_DOMAINS) -> DataFrame:
    """Hits, statistics, structural score, level and notes for each URL."""
    return drop_parts(add_structural_score(add_hits(with_parts(df, url), url, url_rules, legitimate), url))


def hits_of_type(df: DataFrame, kind: str) -> DataFrame:
    """Keep in ``hits`` only the hits of one type."""
    return df.withColumn("hits", F.filter("hits", lambda h: h["type"] == kind))


def explode_hits(df: DataFrame, *keys: str) -> DataFrame:
    """Long form: one row per hit."""
    return explode_rows(df, "hits", "hit", *keys).select(*keys, "hit.*")


def as_vector_columns(df: DataFrame, names: Sequence[str], *keys: str) -> DataFrame:
    """Feature columns as doubles in the given order; an unknown value stays null."""
    return df.select(*keys, *[F.col(n).cast("double").alias(n) for n in names])


def extract_links(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """One row per web link in a text or page, in order of appearance."""
    found = F.regexp_extract_all(F.col(text), F.lit(rules.LINK_PATTERN), F.lit(0))
    return df.select(*keys, F.posexplode_outer(found).alias("linkNo", "url")).where(F.col("url").isNotNull())


def legitimate_by_join(hosts: DataFrame, domains: DataFrame, host: str = "site", key: str = "row_id") -> DataFrame:
    """Which rows lie in a *large* domain set: equal to an entry or below one.

    Distinct hosts are looked up, not rows, so a host that holds a third of all
    rows is looked up once; its suffixes meet the set by equality.  The flag goes
    back to the rows with one join on the host, where adaptive execution picks
    broadcast by measured size and splits hot partitions.
    """
    known = domains.select(F.col("domain").alias("_suffix")).distinct()
    listed = (
        hosts.select(host).where(F.col(host) != "").distinct()
        .withColumn("_suffix", F.explode(U.domain_suffixes(F.col(host))))
        .join(known, "_suffix", "left_semi")
        .select(host).distinct()
        .withColumn("_listed", F.lit(True))
    )
    return (hosts.join(listed, host, "left")
            .withColumn("isLegitimate", F.coalesce("_listed", F.lit(False))).drop("_listed"))
