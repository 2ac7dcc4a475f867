"""Enrichment jobs over snapshot tables: WHOIS, DNS, reputation, joins, features.

All per-domain results are aggregates with fixed-size state (counts, flags,
minima), so a domain that holds a third of the records is combined on the map
side before the shuffle.  Record values stay in long form; no list per domain is
collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import rules
from ..functions.ordering import in_ranges
from ..functions.strings import contains_any, strip, strip_chars


# ---------------------------------------------------------------- domain keys
def dns_key(text: Column) -> Column:
    """Domain key for DNS and reputation tables."""
    out = F.lower(strip(text))
    for prefix in ("^https://", "^http://", "^//", r"^www\."):
        out = F.regexp_replace(out, prefix, "")
    return strip_chars(F.regexp_extract(out, "^([^/?#:]*)", 1), ".")


def whois_key(text: Column) -> Column:
    """Domain key for WHOIS tables (keeps outer dots and a leading ``//``)."""
    out = strip(F.lower(text))
    for prefix in ("^https://", "^http://", r"^www\."):
        out = F.regexp_replace(out, prefix, "")
    return F.regexp_extract(out, "^([^/?#:]*)", 1)


# ---------------------------------------------------------------------- WHOIS
def parse_date(text: Column) -> Column:
    """First of the accepted formats that fits; one-digit days and months too."""
    value = strip(text)
    loose = [f.replace("MM-dd", "M-d").replace("MM/dd", "M/d").replace("dd/MM", "d/M").replace("MM.dd", "M.d")
             .replace("dd-MMM", "d-MMM").replace("HH:mm:ss", "H:m:s") for f in rules.WHOIS_DATE_FORMATS]
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in loose])


def _first(df: DataFrame, name: str) -> Column:
    """First list element, or the text itself; blank becomes null."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    is_list = df.schema[name].dataType.typeName() == "array"
    value = strip(F.get(F.col(name), 0) if is_list else F.col(name))
    return F.when(value != "", value)


def whois_records(raw: DataFrame, as_of: str) -> DataFrame:
    """Normalise raw WHOIS rows and derive age, privacy and lifespan flags.

    ``as_of`` is the time ages are measured at (never the wall clock, so a
    re-run gives the same rows).
    """
    name, org = _first(raw, "name"), _first(raw, "org")
    email, country = _first(raw, "emails"), _first(raw, "country")
    servers = F.transform(F.filter("name_servers", lambda s: s != ""), lambda s: strip(F.lower(s)))
    contact = F.when(F.coalesce(name, org, email, country).isNotNull(), F.struct(
        name.alias("name"), org.alias("organization"), email.alias("email"), country.alias("country"),
        _first(raw, "state").alias("state"), _first(raw, "city").alias("city")))
    private = F.lit(False)
    for field in ("name", "org", "registrant_name", "registrant_organization"):
        private = private | F.coalesce(contains_any(F.lower(_first(raw, field)), rules.PRIVACY_WORDS), F.lit(False))
    has_name = F.size(F.filter("domain_name", lambda d: d != "")) > 0
    found = F.coalesce(has_name, F.lit(False)) | (F.size(F.coalesce("creation_date", F.array())) > 0)
    dated = raw.select(
        whois_key(F.col("domain")).alias("domain"),
        F.when(found, "success").otherwise("not_found").alias("status"),
        _first(raw, "registrar").alias("registrar"),
        parse_date(F.get("creation_date", 0)).alias("creationDate"),
        parse_date(F.get("expiration_date", 0)).alias("expirationDate"),
        parse_date(F.get("updated_date", 0)).alias("updatedDate"),
        F.coalesce(servers, F.array().cast("array<string>")).alias("nameServers"),
        contact.alias("registrant"),
        private.alias("isPrivacyProtected"),
    )
    days = lambda a, b: F.floor((F.unix_timestamp(a) - F.unix_timestamp(b)) / 86400).cast("int")
    now = F.lit(as_of).cast("timestamp")
    return (dated.withColumn("domainAgeDays", F.when(F.col("creationDate").isNotNull(),
                                                     F.greatest(F.lit(0), days(now, F.col("creationDate")))))
            .withColumns({
                "recentlyRegistered": F.coalesce(F.col("domainAgeDays") < 30, F.lit(False)),
                "shortLifespan": F.coalesce(days(F.col("expirationDate"), F.col("creationDate")) < 365, F.lit(False)),
            }))


# ------------------------------------------------------------------------ DNS
def dns_summary(records: DataFrame) -> DataFrame:
    """One row per domain: counts per record type, mail, CDN and lookup status.

    ``records`` is long: domain, rtype, value, and ``status`` of the lookup that
    gave the row (success, nxdomain, timeout, error); failed lookups have a row
    with a null value.
    """
    ok = F.coalesce(F.col("status"), F.lit("success")) == "success"
    has_value = ok & F.col("value").isNotNull()
    of_type = lambda *t: has_value & F.col("rtype").isin(*t)
    failed = F.col("status").isin("timeout", "error")
    # Position of the type in the lookup order, with the kind of failure in the last digit.
    order = F.array_position(F.array(*[F.lit(t) for t in rules.DNS_TYPES]), F.col("rtype"))
    failure = F.when(failed, order * 10 + F.when(F.col("status") == "timeout", 1).otherwise(2))
    counts = {t: F.count_if(of_type(t)).cast("int") for t in rules.DNS_TYPES}
    grouped = (
        records.groupBy("domain")
        .agg(
            *[c.alias(f"n{t}") for t, c in counts.items()],
            F.bool_or((of_type("MX") & (F.col("value") != ""))
                      | (of_type("TXT") & F.lower("value").startswith("v=spf1"))).alias("hasValidMx"),
            F.bool_or(of_type("CNAME", "NS") & contains_any(F.lower("value"), rules.CDN_WORDS)).alias("usesCdn"),
            F.count_if(has_value).cast("int").alias("nRecords"),
            F.bool_and(F.coalesce(F.col("status") == "nxdomain", F.lit(False))).alias("allMissing"),
            F.min(failure).alias("firstFailure"),
        )
    )
    status = (F.when(F.col("allMissing"), "not_found")
              .when(F.col("firstFailure").isNotNull() & (F.col("nRecords") == 0),
                    F.when(F.col("firstFailure") % 10 == 1, "timeout").otherwise("error"))
              .when(F.col("nRecords") == 0, "not_found").otherwise("success"))
    false = F.lit(False)
    return grouped.select(
        "domain", status.alias("status"), *[f"n{t}" for t in rules.DNS_TYPES],
        F.coalesce("hasValidMx", false).alias("hasValidMx"), F.coalesce("usesCdn", false).alias("usesCdn"),
        ((F.col("nA") + F.col("nAAAA")) > 0).alias("hasIpAddresses"))


def dns_records(records: DataFrame) -> DataFrame:
    """Successful records in long form: domain, rtype, value, ttl, and the priority of MX records (0 where none is given).

    ``records`` as for ``dns_summary``, with ``ttl`` and ``priority``.  Equal records count
    once, with their longest ttl.
    """
    ok = (F.coalesce(F.col("status"), F.lit("success")) == "success") & F.col("value").isNotNull()
    priority = F.when(F.col("rtype") == "MX", F.coalesce(F.col("priority"), F.lit(0))).cast("int")
    return (records.where(ok & F.col("rtype").isin(*rules.DNS_TYPES))
            .groupBy("domain", "rtype", "value", priority.alias("priority")).agg(F.max("ttl").cast("int").alias("ttl")))


def dns_record_sets(records: DataFrame, most: int | None = 100) -> DataFrame:
    """One row per domain and type: ``nRecords`` different records and an array of the first ``most``.

    Mail servers come by priority, then all by value.  The bound keeps the row of a
    domain with millions of records small; ``dns_records`` has all of them, and
    ``None`` lifts the bound for tables where that is known to be small.
    """
    rows = dns_records(records)
    counts = rows.groupBy("domain", "rtype").agg(F.count("*").alias("nRecords"))
    if most is not None:
        order = Window.partitionBy("domain", "rtype").orderBy(F.col("priority").asc_nulls_first(), "value")
        rows = rows.withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= most).drop("_no")
    record = F.struct(F.coalesce("priority", F.lit(0)).alias("priority"), "value", "ttl")
    sets = rows.groupBy("domain", "rtype").agg(F.array_sort(F.collect_list(record)).alias("records"))
    return sets.join(counts, ["domain", "rtype"])


def dns_record_count(count_cname: bool = False) -> Column:
    """Record count feature; the corpus form also counts CNAME records."""
    types = [t for t in rules.DNS_TYPES if count_cname or t != "CNAME"]
    return sum((F.col(f"n{t}") for t in types[1:]), F.col(f"n{types[0]}"))


def first_addresses(records: DataFrame, limit: int | None = None) -> DataFrame:
    """The first addresses of each domain, IPv4 before IPv6, ``limit`` at most where given.

    Needs ``seq``, the position of a record in its lookup.  Spark cuts each
    group on the map side (window group limit), so hot domains shuffle little.
    """
    order = Window.partitionBy("domain").orderBy(
        F.when(F.col("rtype") == "A", 0).otherwise(1), "seq", "value")
    return (records.where(F.col("rtype").isin("A", "AAAA") & F.col("value").isNotNull())
            .select("domain", "rtype", "seq", "value")
            .withColumn("ipNo", F.row_number().over(order)).where(F.lit(True) if limit is None else F.col("ipNo") <= limit)
            .select("domain", "ipNo", F.col("value").alias("ip")))


def ip_checks(records: DataFrame, checks: DataFrame, limit: int | None = None) -> DataFrame:
    """Reputation checks of the first addresses: (domain, ip) with the sources that check addresses."""
    usable = checks.where(F.col("source").isin(*rules.IP_SOURCES))
    return first_addresses(records, limit).join(usable, "ip", "inner")


# ----------------------------------------------------------------- reputation
def verdict_vendor_checks(bodies: DataFrame) -> DataFrame:
    """Vendor JSON (key, body) -> check rows: share of engines that object."""
    schema = ("data struct<attributes:struct<last_analysis_stats:map<string,bigint>,"
              "categories:map<string,string>>>")
    parsed = bodies.withColumn("_a", F.from_json("body", schema)["data"]["attributes"])
    stats = F.coalesce(F.col("_a.last_analysis_stats"), F.create_map().cast("map<string,bigint>"))
    flagged = F.coalesce(F.try_element_at(stats, F.lit("malicious")), F.lit(0)) + F.coalesce(
        F.try_element_at(stats, F.lit("suspicious")), F.lit(0))
    total = F.aggregate(F.map_values(stats), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return parsed.withColumns({"_flagged": flagged, "_total": total}).select(
        "key", F.lit("virustotal").alias("source"), (F.col("_flagged") > 0).alias("isMalicious"),
        F.least(F.col("_flagged") / F.greatest(F.col("_total"), F.lit(1)), F.lit(1.0)).alias("confidence"),
        F.get(F.map_values("_a.categories"), 0).alias("category"))


def ip_abuse_checks(bodies: DataFrame) -> DataFrame:
    """Address-abuse JSON (key, body) -> check rows."""
    schema = "data struct<abuseConfidenceScore:double,totalReports:bigint,usageType:string>"
    parsed = bodies.withColumn("_d", F.from_json("body", schema)["data"])
    score = F.coalesce(F.col("_d.abuseConfidenceScore"), F.lit(0.0))
    reports = F.coalesce(F.col("_d.totalReports"), F.lit(0))
    return parsed.select(
        "key", F.lit("abuseipdb").alias("source"), ((score > 50) | (reports > 5)).alias("isMalicious"),
        (score / 100.0).alias("confidence"), F.col("_d.usageType").alias("category"))


def blocklist_checks(domains: DataFrame, blocklist: DataFrame | None = None) -> DataFrame:
    """Check rows of the internal blocklist; without a list every row says ``no_data``."""
    if blocklist is None:
        listed = domains.select("domain", F.lit(None).cast("double").alias("_c"), F.lit(None).cast("string").alias("_k"))
    else:
        entries = blocklist.groupBy("domain").agg(F.max("confidence").alias("_c"), F.min("category").alias("_k"))
        listed = domains.select("domain").join(entries, "domain", "left")
    return listed.select(
        "domain", F.lit("internal").alias("source"), F.col("_c").isNotNull().alias("isMalicious"),
        F.coalesce("_c", F.lit(0.0)).alias("confidence"),
        F.when(F.col("_c").isNull(), "no_data").otherwise(F.col("_k")).alias("category"))


def reputation_summary(checks: DataFrame) -> DataFrame:
    """Weighted aggregate per domain, plus counts and flags."""
    weight = F.lit(1.0)
    for source, value in rules.SOURCE_WEIGHTS.items():
        weight = F.when(F.col("source") == source, value).otherwise(weight)
    counted = ~F.coalesce(F.col("category").isin(*rules.UNSCORED_CATEGORIES), F.lit(False))
    shown = F.coalesce(F.col("category") != "", F.lit(False)) & ~F.col("category").isin(*rules.HIDDEN_CATEGORIES)
    bad = F.coalesce(F.col("isMalicious"), F.lit(False))
    score = F.try_divide(F.sum(F.when(counted & bad, F.col("confidence") * weight).otherwise(0.0)),
                         F.sum(F.when(counted, weight).otherwise(0.0)))
    return checks.groupBy("domain").agg(
        F.lit("success").alias("status"),
        F.least(F.coalesce(score, F.lit(0.0)), F.lit(1.0)).alias("aggregateScore"),
        F.bool_or(bad & (F.col("confidence") > 0.5)).alias("knownMalicious"),
        F.count_if(bad).cast("int").alias("maliciousCount"),
        F.count("*").cast("int").alias("totalChecks"),
        F.count_if(shown).cast("int").alias("categoryCount"))


def reputation_categories(checks: DataFrame) -> DataFrame:
    """Threat categories per domain, long form, sentinels left out."""
    return (checks.where((F.col("category") != "") & ~F.col("category").isin(*rules.HIDDEN_CATEGORIES))
            .groupBy("domain", "category").agg(F.count("*").alias("n")))


# ---------------------------------------------------------------------- joins
def merge_cache(old: DataFrame, new: DataFrame, key: str = "domain", at: str = "observed_at") -> DataFrame:
    """New rows replace cached rows with the same lower-case key; the latest row wins."""
    both = old.unionByName(new).withColumn(key, F.lower(key))
    values = [c for c in both.columns if c != key]
    return (both.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(at, *[c for c in values if c != at])).alias("_v"))
            .select(key, "_v.*"))


def cache_misses(domains: DataFrame, cache: DataFrame, key: str = "domain") -> DataFrame:
    """Domains that still have to be looked up."""
    return domains.join(cache.select(F.lower(key).alias("_cached")), F.lower(F.col(key)) == F.col("_cached"), "left_anti")


def spread_left_join(left: DataFrame, right: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Left join on a key that may be missing on most left rows.

    Rows without a key can match nothing, but would all meet in one shuffle
    partition; they are spread by another column, over eight times as many stand-ins
    as there are shuffle partitions.  Rows with a
    hot key are split by adaptive execution (skew join), which works here since
    ``right`` has one row per key and this is the only join of the big side.
    """
    # A stand-in for the missing key that no key equals.
    slices = 8 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filler = F.concat(F.lit("\u0001"), F.pmod(F.xxhash64(spread_by), F.lit(slices)).cast("string"))
    return (left.withColumn("_join_key", F.coalesce(F.col(key), filler))
            .join(right.withColumnRenamed(key, "_join_key"), "_join_key", "left").drop("_join_key"))


def osint_bundle(whois: DataFrame, dns: DataFrame, reputation: DataFrame) -> DataFrame:
    """One row per domain with the sides whose status is success.

    The three inputs have one row per domain, so merging them first leaves one
    join for the big table, on one key.
    """
    ok = F.col("status") == "success"
    w = whois.where(ok).select(
        "domain", F.lit(True).alias("hasWhois"), "registrar", "domainAgeDays", "isPrivacyProtected", "recentlyRegistered")
    d = dns.where(ok).select(
        "domain", F.lit(True).alias("hasDns"), *[f"n{t}" for t in rules.DNS_TYPES], "hasValidMx", "usesCdn", "hasIpAddresses")
    r = reputation.where(ok).select(
        "domain", F.lit(True).alias("hasReputation"), "aggregateScore", "knownMalicious", "maliciousCount")
    false = F.lit(False)
    return (w.join(d, "domain", "full_outer").join(r, "domain", "full_outer")
            .withColumns({n: F.coalesce(n, false) for n in ("hasWhois", "hasDns", "hasReputation")}))


def enrich(df: DataFrame, bundle: DataFrame, key: str = "domain", row: str = "msg_id") -> DataFrame:
    """Add the bundle columns by domain; unknown domains get none."""
    return spread_left_join(df, bundle, key, row)


#: Rows of one (key, bucket) that one task orders; more are dealt by ranges.
HOT_ROWS = 1 << 20
#: Ranges for the rows of all hot buckets, as long as a range of them stays below ``HOT_ROWS``.  The driver
#: gets a sample of some hundred rows for each range.
RANGES = 128


def as_of_join(events: DataFrame, snapshots: DataFrame, key: str = "domain", event_id: str = "event_id",
               event_at: str = "ts", seen_at: str = "observed_at", bucket: str = "hour", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Latest snapshot seen at or before each event.

    Time buckets split hot keys: each (key, bucket) is ordered on its own, and
    what held at the start of a bucket comes from a running maximum over one row
    per (key, bucket).  No event meets more than one candidate row.  A (key, bucket) of
    more than ``hot_rows`` rows is not ordered in one task: its rows are dealt by ranges
    of their time, and what held at the end of a range is carried into the next.  The
    ranges are few however small ``hot_rows`` is: more than ``RANGES`` only where they
    would hold about ``HOT_ROWS``.
    Events without a key can have no snapshot; they are set aside, so that they don't
    meet in one task.
    """
    keyless = events.where(F.col(key).isNull())
    events, snapshots = events.where(F.col(key).isNotNull()), snapshots.where(F.col(key).isNotNull())
    values = [c for c in snapshots.columns if c not in (key,)]
    s = snapshots.select(F.col(key).alias("_k"), F.col(seen_at).alias("_t"), F.struct(*values).alias("_v"))
    s = s.withColumn("_b", F.date_trunc(bucket, "_t"))
    e = events.withColumn("_b", F.date_trunc(bucket, F.col(event_at)))
    last = s.groupBy("_k", "_b").agg(F.max_by("_v", F.struct("_t", "_v")).alias("_last"), F.count("*").alias("_seen"))
    wanted = e.groupBy(F.col(key).alias("_k"), "_b").agg(F.count("*").alias("_asked"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = wanted.join(last, ["_k", "_b"], "full_outer")
    carried = (buckets.withColumn("_carried", F.last("_last", ignorenulls=True).over(before))
               .where(F.col("_carried").isNotNull()).select("_k", "_b", F.col("_carried").alias("_v")))
    # The carried row sorts first in its bucket, snapshots sort before events of the same instant.
    rows = (
        e.select(F.col(key).alias("_k"), "_b", F.col(event_at).alias("_t"), F.lit(2).alias("_kind"),
                 F.lit(None).cast(s.schema["_v"].dataType).alias("_v"), F.struct(*events.columns).alias("_e"))
        .unionByName(s.select("_k", "_b", "_t", F.lit(1).alias("_kind"), "_v"), allowMissingColumns=True)
        .unionByName(carried.select("_k", "_b", F.col("_b").alias("_t"), F.lit(0).alias("_kind"), "_v"),
                     allowMissingColumns=True)
    )
    # One row for each hot bucket: at most all rows / hot_rows of them.
    hot = buckets.select("_k", "_b", (F.coalesce("_asked", F.lit(0)) + F.coalesce("_seen", F.lit(0))).alias("_n")).where(F.col("_n") > hot_rows).collect()
    if hot:
        which = events.sparkSession.createDataFrame([(r["_k"], r["_b"]) for r in hot], rows.select("_k", "_b").schema)
        dealt = 2 * sum(r["_n"] for r in hot)
        parts = min(1 + dealt // hot_rows, max(RANGES, 1 + dealt // HOT_ROWS))
        filled = _filled(rows.join(which, ["_k", "_b"], "left_anti"), ["_k", "_b"], ["_t", "_kind", "_v"]).unionByName(
            _filled_by_ranges(rows.join(which, ["_k", "_b"], "left_semi"), parts))
    else:
        filled = _filled(rows, ["_k", "_b"], ["_t", "_kind", "_v"])
    return filled.where(F.col("_kind") == 2).select("_e.*", "_now.*").unionByName(keyless, allowMissingColumns=True)


def _filled(rows: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """Rows with the last snapshot up to them (``_now``) in their group."""
    upto = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("_k", "_b", "_kind", "_e", F.last("_v", ignorenulls=True).over(upto).alias("_now"))


def _filled_by_ranges(rows: DataFrame, parts: int) -> DataFrame:
    """The same for few large buckets: ranges of the order, and one carried row for each range.

    A range that begins inside a bucket takes over the last snapshot before it, if that
    one is of the same bucket; every bucket begins with its own carried row or none.
    """
    ranged = in_ranges(rows, [F.col("_k"), F.col("_b"), F.col("_t"), F.col("_kind"), F.col("_v")], parts)
    ends = ranged.groupBy("_range").agg(
        F.min_by(F.struct("_k", "_b"), "_place").alias("_first"),
        F.max_by(F.when(F.col("_v").isNotNull(), F.struct("_k", "_b", "_v")), F.when(F.col("_v").isNotNull(), F.col("_place"))).alias("_end"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    taken = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(earlier)).where(
        (F.col("_before._k") == F.col("_first._k")) & F.col("_before._b").eqNullSafe(F.col("_first._b")))
    carried = taken.select("_range", F.col("_first._k").alias("_k"), F.col("_first._b").alias("_b"), F.col("_before._v").alias("_v"),
                           F.lit(-1).cast("bigint").alias("_place"), F.lit(0).alias("_kind"))
    return _filled(ranged.unionByName(carried, allowMissingColumns=True), ["_range", "_k", "_b"], ["_place"])


# ------------------------------------------------------------------- features
def add_osint_features(df: DataFrame, count_cname: bool = False) -> DataFrame:
    """The 12 enrichment features from bundle columns; a missing side leaves its defaults."""
    true_if = lambda cond: F.coalesce(cond, F.lit(False))
    whois, dns, rep = true_if(F.col("hasWhois")), true_if(F.col("hasDns")), true_if(F.col("hasReputation"))
    age = F.when(whois, F.col("domainAgeDays"))
    return df.withColumns({
        "domainAgeDays": age,
        "isNewlyRegistered": whois & true_if(F.col("recentlyRegistered")),
        "isYoungDomain": true_if(age < 365),
        "hasPrivacyProtection": whois & true_if(F.col("isPrivacyProtected")),
        "hasValidMx": dns & true_if(F.col("hasValidMx")),
        "usesCdn": dns & true_if(F.col("usesCdn")),
        "dnsRecordCount": F.when(dns, dns_record_count(count_cname)).otherwise(0).cast("int"),
        "hasValidDns": dns,
        "reputationScore": F.when(rep, F.col("aggregateScore")).otherwise(0.0),
        "maliciousSourceCount": F.when(rep, F.col("maliciousCount")).otherwise(0).cast("int"),
        "isKnownMalicious": rep & true_if(F.col("knownMalicious")),
        "hasValidWhois": whois,
    })


def add_osint_quality(df: DataFrame) -> DataFrame:
    """Risk indicator count, completeness of the features, and quality of the data."""
    tests = (
        F.col("isNewlyRegistered"), F.col("isYoungDomain") & ~F.col("isNewlyRegistered"),
        F.col("hasPrivacyProtection"), F.col("hasValidDns") & ~F.col("hasValidMx"),
        F.col("isKnownMalicious"), F.col("maliciousSourceCount") > 0,
    )
    as_int = [t.cast("int") for t in tests]
    out = {
        "osintRiskIndicators": sum(as_int[1:], as_int[0]),
        "dataCompleteness": (F.col("hasValidWhois").cast("int") + F.col("hasValidDns").cast("int") + 1) / 3.0,
    }
    if "hasReputation" in df.columns:
        known = [F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("hasWhois", "hasDns", "hasReputation")]
        out["dataQuality"] = (known[0] + known[1] + known[2]) / 3.0
    return df.withColumns(out)


def osint_summary_columns() -> dict[str, Column]:
    """Summary shown next to a verdict: a higher reputation means more suspicious."""
    false = F.lit(False)
    return {
        "summaryHasValidDns": F.coalesce(F.col("hasDns") & F.col("hasIpAddresses"), false),
        "summaryReputation": F.when(F.coalesce("hasReputation", false), F.col("aggregateScore")).otherwise(0.5),
        "summaryIsPrivate": F.coalesce(F.col("hasWhois") & F.col("isPrivacyProtected"), false),
        "inBlacklists": F.coalesce(F.col("maliciousCount") > 0, false),
    }


def age_tier(days: Column) -> Column:
    return F.when(days.isNull(), "Unknown").when(days < 30, "Very New").when(days < 180, "New").otherwise("Established")


def age_text(days: Column) -> Column:
    """Age in words: days, then months, then years with months."""
    text = lambda c: c.cast("string")
    months, years, rest = F.floor(days / 30), F.floor(days / 365), F.floor((days % 365) / 30)
    plural = lambda n, one, many: F.when(n == 1, one).otherwise(F.concat(text(n), F.lit(many)))
    return (F.when(days < 1, "Less than a day").when(days < 30, plural(days, "1 day", " days"))
            .when(days < 365, plural(months, "1 month", " months"))
            .when(rest == 0, plural(years, "1 year", " years"))
            .otherwise(F.concat(text(years), F.lit("y "), text(rest), F.lit("m"))))


def reputation_label(score: Column) -> Column:
    return F.when(score >= 0.7, "Good").when(score >= 0.4, "Fair").otherwise("Poor")
