"""URL parsing as Column expressions.

The jobs need three different host rules (see the functions ``host_*``), so each
has its own name.  ``parse_url`` is not used: it gives null for hosts with
underscores or spaces, which are exactly the hosts of interest here.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import rules
from .strings import percent_decode, quote_all, strip_chars, strip_long, without


def normalised(url: Column) -> Column:
    """Trimmed URL; without an explicit web scheme it gets ``https://``."""
    text = strip_long(url)
    has_scheme = text.startswith("http://") | text.startswith("https://")
    return F.when(has_scheme, text).otherwise(F.concat(F.lit("https://"), text))


def parsable(normal: Column) -> Column:
    """The text that is parsed: tab and line breaks are not part of a URL."""
    return without(normal, "\t\r\n")


def netloc(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, r"^https?://([^/?#]*)", 1))


def path(text: Column) -> Column:
    """Path without the parameters of its last segment."""
    whole = F.regexp_extract(text, r"^https?://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(whole, r";[^/]*$", "")


def query(text: Column) -> Column:
    return F.when(~text.contains("?"), "").otherwise(F.regexp_extract(text, r"^[^?#]*\?([^#]*)", 1))


def fragment(text: Column) -> Column:
    return F.regexp_extract(text, r"^[^#]*#([\s\S]*)", 1)


def broken_brackets(location: Column) -> Column:
    """An opening bracket without a closing one, or the reverse."""
    return location.contains("[") != location.contains("]")


def host_before_last_colon(location: Column) -> Column:
    """Host for the feature table: a bracketed address, else up to the last colon."""
    return F.when(location.startswith("["), F.regexp_extract(location, r"^\[[^\]]*\]", 0)).otherwise(
        F.regexp_replace(location, r":[^:]*$", ""))


def host_before_first_colon(location: Column) -> Column:
    """Host for the component table."""
    return F.substring_index(location, ":", 1)


def host_without_userinfo(location: Column) -> Column:
    """Host for feeds: after the last ``@``, before the first colon, no outer dots."""
    bare = F.substring_index(F.substring_index(location, "@", -1), ":", 1)
    return strip_chars(F.lower(bare), ".")


def feed_domain(url: Column) -> Column:
    """Domain of a feed URL: network location, else the first path segment."""
    text = F.translate(F.ltrim(url), "\t\r\n", "")
    location = F.regexp_extract(text, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)
    rest = F.regexp_replace(text, r"^[a-zA-Z][a-zA-Z0-9+.\-]*:", "")
    first_segment = F.regexp_extract(rest, r"^([^/?#;]*)", 1)
    return F.when(broken_brackets(location), F.lit("")).otherwise(
        host_without_userinfo(F.when(location != "", location).otherwise(first_segment)))


def is_ip(host: Column) -> Column:
    """IPv4 (outer brackets ignored) or IPv6; long hosts that are no address are told by a digit or colon they lack."""
    digit = F.substring(F.ltrim(host, F.lit("[]")), 1, 1).between("0", "9")
    return (digit & strip_chars(host, "[]").rlike(rules.IPV4)) | (host.contains(":") & host.rlike(rules.IPV6))


def is_dotted_quad(host: Column) -> Column:
    """Four numeric labels of at most 255, leading zeros allowed."""
    octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    return host.rlike(rf"^(?:{octet}\.){{3}}{octet}$")


def label_count(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def last_labels(host: Column, n: int) -> Column:
    return F.substring_index(host, ".", -n)


def query_key_count(text: Column) -> Column:
    """Distinct decoded keys that have a non-empty value."""
    pairs = F.filter(F.split(text, "&"), lambda p: p.rlike(r"^[^=]*=[\s\S]"))
    keys = F.transform(pairs, lambda p: percent_decode(F.substring_index(p, "=", 1), plus_is_space=True))
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.array_distinct(keys)))


def in_domain_set(host: Column, domains: tuple) -> Column:
    """True where the host is one of the domains or below one of them."""
    if not domains:
        return F.lit(False)
    return host.rlike(rf"(?:^|\.)(?:{quote_all(domains)})$")


def domain_suffixes(host: Column) -> Column:
    """The host and every parent of it, as an array (for key joins)."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
