"""Message jobs: validation, e-mail composition, type routing, domain for enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions.strings import contains_any_plain, strip, strip_long


def compose_email(content: Column, subject: Column, sender: Column) -> Column:
    """Body with a subject line and a sender line in front, each only if given."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    with_subject = F.when(filled(subject), F.concat(F.lit("Subject: "), subject, F.lit("\n\n"), content)).otherwise(content)
    return F.when(filled(sender), F.concat(F.lit("From: "), sender, F.lit("\n"), with_subject)).otherwise(with_subject)


def add_request_error(df: DataFrame, content: str = "content", kind: str = "content_type") -> DataFrame:
    """Trim the content and add ``requestError`` (null for a valid request)."""
    text = F.coalesce(strip_long(F.col(content)), F.lit(""))
    error = (F.when(text == "", "Content cannot be empty")
             .when(~F.coalesce(F.col(kind).isin(*rules.CONTENT_TYPES), F.lit(False)), "Unknown content type"))
    return df.withColumns({content: text, "requestError": error})


def split_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid requests, and the quarantined ones with their reason."""
    checked = add_request_error(df)
    return (checked.where(F.col("requestError").isNull()).drop("requestError"),
            checked.where(F.col("requestError").isNotNull()))


def _has_header(low: Column) -> Column:
    return contains_any_plain(low, rules.HEADERS)


def _web_prefix(text: Column) -> Column:
    return text.startswith("http://") | text.startswith("https://") | text.startswith("www.")


def _is_domain(text: Column, pattern: str) -> Column:
    """Whether the text fits a pattern of bare domains; a space before the first slash, as in most texts, spares the pattern."""
    return ~F.substring_index(text, "/", 1).contains(" ") & text.rlike("(?d)" + pattern)


def scoring_type(content: Column) -> Column:
    """Type for the scoring path: web prefix or bare domain, then mail headers, else text."""
    low = F.lower(strip_long(content))
    return (F.when(_web_prefix(low) | _is_domain(low, rules.BARE_DOMAIN), "url")
            .when(_has_header(low), "email").otherwise("text"))


def text_type(content: Column) -> Column:
    """Type for the text path: a lone web address, a lone mail address, mail headers, else text."""
    low = strip(F.lower(content))
    return (F.when(_web_prefix(low) & ~content.contains(" "), "url")
            .when(strip(content).rlike(rules.ADDRESS) | _has_header(low), "email").otherwise("text"))


def enrichment_domain(content: Column) -> Column:
    """Domain to enrich by, null where the content names none.

    A URL gives its network location, a bare domain itself; else the first link
    in the text, else the first mail address.
    """
    text = strip_long(content)
    full = F.when(text.contains("://"), text).otherwise(F.concat(F.lit("http://"), text))
    location = F.lower(F.regexp_extract(F.translate(full, "\t\r\n", ""), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))
    no_www = lambda c: F.replace(c, F.lit("www."), F.lit(""))
    broken = location.contains("[") != location.contains("]")
    link = F.regexp_extract(content, rules.LINK_IN_TEXT, 0)
    address = F.regexp_extract(content, rules.ADDRESS_DOMAIN, 1)
    found = (F.when(_web_prefix(text), F.when(~broken, no_www(location)))
             .when(_is_domain(text, rules.BARE_DOMAIN_ANY_CASE), F.lower(F.substring_index(text, "/", 1)))
             .when(link != "", no_www(F.lower(F.regexp_extract(link, "^https?://(.*)$", 1))))
             .when(address != "", F.lower(address)))
    return F.when(found != "", found)
