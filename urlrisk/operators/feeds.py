"""Corpus jobs: common feed shape, union, de-duplication, rank filter, curated rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions import urlparts as U
from ..functions.ordering import row_numbers
from ..functions.staging import computed_once
from ..functions.strings import quote_all

MALICIOUS_COLUMNS = ("url", "domain", "source", "label", "feedId", "verificationTime", "target")
LEGITIMATE_COLUMNS = ("url", "domain", "source", "label", "rank", "category")


def as_feed(df: DataFrame, source: str, label: int = 1, keep_unknown: bool = False) -> DataFrame:
    """Common feed columns from any source; what it lacks is empty text."""
    text = lambda n: (F.coalesce(F.col(n).cast("string"), F.lit("")) if n in df.columns else F.lit("")).alias(n)
    domain = U.feed_domain(F.col("url"))
    if keep_unknown:
        domain = F.coalesce(F.nullif(domain, F.lit("")), F.lit("unknown"))
    out = computed_once(df.withColumn("domain", domain), "url", "domain")
    return out.where(F.col("domain") != "").select(
        "url", "domain", F.lit(source).alias("source"), F.lit(label).alias("label"),
        text("feedId"), text("verificationTime"), text("target"))


def ranked_entries(ranked: DataFrame) -> DataFrame:
    """Ranked domains as legitimate feed rows."""
    return ranked.select(
        F.concat(F.lit("https://"), "domain").alias("url"), "domain", F.lit("tranco").alias("source"),
        F.lit(0).alias("label"), "rank", F.lit("").alias("category"))


def filter_ranked(ranked: DataFrame, n: int | None = None) -> DataFrame:
    """Ranked domains that are sites: not short, not numeric, not infrastructure; the best ``n`` where given."""
    infrastructure = F.col("domain").rlike(f"(?:{quote_all(rules.INFRASTRUCTURE_SUFFIXES)})$")
    numeric = F.replace("domain", F.lit("."), F.lit("")).rlike(r"^\p{Nd}+$")
    sites = ranked.where((F.length("domain") >= 4) & ~numeric & ~infrastructure)
    return sites if n is None else sites.orderBy("rank", "domain").limit(n)


def union_by_priority(feeds: Sequence[DataFrame]) -> DataFrame:
    """All feeds with ``priority``, the position in the list."""
    marked = [f.withColumn("priority", F.lit(i)) for i, f in enumerate(feeds)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def url_key(url: Column) -> Column:
    """Two URLs are the same without regard to case and final slashes."""
    return F.rtrim(F.lower(url), F.lit("/"))


def domain_key(domain: Column) -> Column:
    return F.replace(F.lower(domain), F.lit("www."), F.lit(""))


def first_per_key(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """One row per key, the first in the given order.

    An aggregate and not a window: copies of a hot key are merged on the map
    side, so no task sees all of them.
    """
    columns = df.columns
    return (df.withColumn("_key", key).groupBy("_key")
            .agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_row")).select("_row.*"))


def dedupe_urls(df: DataFrame) -> DataFrame:
    return first_per_key(df, url_key(F.col("url")), ("priority", "url"))


def dedupe_domains(df: DataFrame) -> DataFrame:
    return first_per_key(df, domain_key(F.col("domain")), ("priority", "domain", "url"))


def merge_feeds(feeds: Sequence[DataFrame]) -> DataFrame:
    """Union of prioritised feeds, one row per URL."""
    return dedupe_urls(union_by_priority(feeds)).drop("priority")


def distinct_domains(df: DataFrame) -> DataFrame:
    return df.select("domain").where(F.length("domain") > 0).distinct()


def curated_malicious(df: DataFrame, order: str) -> DataFrame:
    """Curated malicious rows with their derived columns; ids follow the given order column."""
    parsed = df.withColumn("_loc", F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))
    scheme = F.lower(F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    labels = F.size(F.split("_loc", r"\."))
    return _numbered(parsed.withColumns({
        "domain": F.substring_index(F.substring_index("_loc", "@", -1), ":", 1),
        "scheme": scheme,
        "path": F.regexp_replace(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1), r";[^/]*$", ""),
        "hasIpAddress": F.col("_loc").contains(".") & F.col("_loc").rlike(r"\p{Nd}"),
        "hasAtSymbol": F.col("url").contains("@"),
        "isHttps": scheme == "https",
        "urlLength": F.length("url"),
        "subdomainCount": F.greatest(labels - 2, F.lit(0)),
        "isPhishing": F.lit(True),
    }).drop("_loc"), order)


def curated_legitimate(df: DataFrame, order: str) -> DataFrame:
    """Curated legitimate rows with their derived columns."""
    location = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)
    return _numbered(df.withColumns({
        "domain": F.replace(location, F.lit("www."), F.lit("")),
        "isHttps": F.lower(F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)) == "https",
        "urlLength": F.length("url"),
        "isPhishing": F.lit(False),
    }), order)


def _numbered(df: DataFrame, order: str) -> DataFrame:
    """Ids from 1 in the order of a column, equal ones by URL."""
    return row_numbers(df, [F.col(order), F.col("url")], "id")
