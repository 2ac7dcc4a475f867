"""Feed, corpus, reader and writer jobs as registered queries.

Reader queries write a feed that Spark derives from the tables to the shared
folder, in the format of the feed, and read it back with the reader.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import urlparts as U
from ..operators import enrich as E, feeds, report
from ..session import new_folder
from ..sources import feeds as R, sinks
from .osint_queries import DNS, dns_cache
from .registry import query
from .url_queries import _alt, from_urls
from .views import view, with_views

# Domain of a feed URL for DuckDB: location or first path segment, no userinfo, port or outer dots.
_DOMAIN = r"""(CASE WHEN contains(loc, '[') <> contains(loc, ']') THEN '' ELSE
  trim(lower(split_part(list_extract(string_split(CASE WHEN loc <> '' THEN loc ELSE seg END, '@'), -1), ':', 1)), '.') END)"""
_WITH_LOC = r"""SELECT *, regexp_extract(trim(url), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1) AS loc,
  regexp_extract(regexp_replace(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*:', ''), '^([^/?#;]*)', 1) AS seg FROM v_feed"""
FEED = f"f AS (SELECT *, trim(url) AS u, {_DOMAIN} AS domain FROM ({_WITH_LOC}))"
_COLS = 'u AS url, domain, {src} AS source, 1 AS label, {fid} AS "feedId", {vt} AS "verificationTime", {tgt} AS target'


def _feed(spark, folder):
    return view(spark, folder, "v_feed")


def _line(*columns):
    """CSV line with quoted values."""
    quoted = [F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    return F.concat_ws(",", *quoted).alias("value")


@query("prj_01_feed_domain", with_views(f"WITH {FEED} SELECT page_id, copy, domain FROM f", "v_feed"))
def _feed_domain(spark, folder):
    return _feed(spark, folder).select("page_id", "copy", U.feed_domain(F.col("url")).alias("domain"))


@query("prj_02_feed_shape", with_views(f"WITH {FEED} SELECT " + _COLS.format(
    src="'openphish'", fid="''", vt="''", tgt="target") + " FROM f WHERE domain <> ''", "v_feed"))
def _feed_shape(spark, folder):
    return feeds.as_feed(_feed(spark, folder).select("url", "target"), "openphish")


def _verified_rows(spark, folder):
    return _feed(spark, folder).select(
        F.concat_ws("-", F.col("page_id").cast("string"), F.col("copy").cast("string")).alias("phish_id"), "url",
        F.lit("http://detail").alias("phish_detail_url"), F.lit("2024").alias("submission_time"), "verified",
        F.lit("2024-01-02").alias("verification_time"), "online", "target")


_VERIFIED_COLS = _COLS.format(src="'phishtank'", fid="CAST(page_id AS VARCHAR) || '-' || CAST(copy AS VARCHAR)",
                              vt="'2024-01-02'", tgt="target")


@query("src_01_verified_csv", with_views(f"""WITH {FEED} SELECT {_VERIFIED_COLS} FROM f
    WHERE lower(trim(verified)) = 'yes' AND lower(trim(online)) = 'yes' AND domain <> ''""", "v_feed"))
def _verified_csv(spark, folder):
    path = new_folder(spark, "src01")
    _verified_rows(spark, folder).write.option("header", True).option("escape", '"').csv(path)
    return R.read_verified_csv(spark, path)


@query("src_02_verified_json", with_views(
    f"WITH {FEED} SELECT {_VERIFIED_COLS} FROM f WHERE verified = 'yes' AND domain <> ''".replace(
        "verified = 'yes'", "lower(verified) = 'yes'"), "v_feed"))
def _verified_json(spark, folder):
    path = new_folder(spark, "src02")
    _verified_rows(spark, folder).withColumn("verified", F.lower("verified")).write.json(path)
    return R.read_verified_json(spark, path, lines=True)


def _json_arrays(spark, folder, path):
    """The verified feed as files of one JSON array each, for a thousand pages at most."""
    page = F.substring_index("phish_id", "-", 1).cast("bigint")
    rows = _verified_rows(spark, folder).withColumn("verified", F.when(page % 2 == 0, F.lower("verified")).otherwise(F.col("verified")))
    arrays = rows.groupBy(F.floor(page / 1000).alias("part")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)


@query("src_02_verified_json_array", with_views(f"WITH {FEED} SELECT {_VERIFIED_COLS} FROM f WHERE (CASE WHEN page_id % 2 = 0 THEN lower(verified) ELSE verified END) = 'yes' AND domain <> ''", "v_feed"))
def _verified_json_array(spark, folder):
    """The form of one array in a file; only the exact word counts here."""
    path = new_folder(spark, "src02")
    _json_arrays(spark, folder, path)
    return R.read_verified_json(spark, path)


@query("src_06_local_dump_json", with_views(f"WITH {FEED} SELECT {_VERIFIED_COLS} FROM f WHERE domain <> ''", "v_feed"))
def _local_dump_json(spark, folder):
    """The JSON dump, where there is no CSV one."""
    path = new_folder(spark, "src06")
    _json_arrays(spark, folder, path)
    return R.read_local_dump(spark, path + "-none", path)


@query("src_03_url_lines", with_views(
    f"WITH {FEED} SELECT " + _COLS.format(src="'openphish'", fid="''", vt="''", tgt="''") + " FROM f WHERE domain <> ''", "v_feed"))
def _url_lines(spark, folder):
    path = new_folder(spark, "src03")
    lines = _feed(spark, folder).select(F.concat(F.lit(" "), F.col("url"), F.lit(" ")).alias("value"))
    noise = _feed(spark, folder).select(F.when(F.col("copy") < 2, "# a comment").otherwise("   ").alias("value"))
    lines.unionByName(noise).write.text(path)
    return R.read_url_lines(spark, path)


@query("src_04_tagged_csv", with_views(f"WITH {FEED} SELECT " + _COLS.format(
    src="'urlhaus'", fid="''", vt="''", tgt="target") + " FROM f WHERE domain <> '' AND starts_with(u, 'http')", "v_feed"))
def _tagged_csv(spark, folder):
    path = new_folder(spark, "src04")
    rows = _feed(spark, folder).withColumns({c: F.lit(c) for c in ("id", "dateadded", "url_status", "last_online", "threat", "link", "reporter")})
    full = rows.select(_line("id", "dateadded", "url", "url_status", "last_online", "threat", "target", "link", "reporter"))
    short = rows.select(_line("id", "dateadded", "url"))
    comments = rows.select(F.concat(F.lit("# "), F.col("url")).alias("value"))
    full.unionByName(short).unionByName(comments).write.text(path)
    return R.read_tagged_csv(spark, path)


@query("src_05_scored_csv", with_views(f"WITH {FEED} SELECT " + _COLS.format(
    src="'phishstats'", fid="''", vt="''", tgt="''")
    + " FROM f WHERE domain <> '' AND starts_with(u, 'http') AND try_cast(score AS DOUBLE) >= 5", "v_feed"))
def _scored_csv(spark, folder):
    path = new_folder(spark, "src05")
    rows = _feed(spark, folder).withColumns({"date": F.lit("2024-01-02"), "ip": F.lit("10.0.0.1")})
    rows.select(_line("date", "score", "url", "ip")).write.text(path)
    return R.read_scored_csv(spark, path)


@query("src_06_local_dump", with_views(f"WITH {FEED} SELECT {_VERIFIED_COLS} FROM f WHERE domain <> ''", "v_feed"))
def _local_dump(spark, folder):
    path = new_folder(spark, "src06")
    _verified_rows(spark, folder).write.option("header", True).option("escape", '"').csv(path)
    return R.read_local_dump(spark, path, path + "-none")


@query("src_07_curated", with_views(f"""WITH {FEED}
  SELECT u AS url, CASE WHEN domain = '' THEN 'unknown' ELSE domain END AS domain, 'curated' AS source, 1 AS label FROM f WHERE u <> ''
  UNION ALL SELECT u, replace(target, 'www.', ''), 'curated', 0 FROM f WHERE u <> '' AND trim(target) <> ''""", "v_feed"))
def _curated(spark, folder):
    path = new_folder(spark, "src07")
    # Documents of bounded size: the rows of one page each.
    entry = F.struct(F.col("page_id").alias("id"), "url", F.col("target").alias("domain"), "target", F.lit("c").alias("category"))
    (_feed(spark, folder).groupBy("page_id").agg(F.collect_list(entry).alias("urls"))
     .select(F.struct(F.lit("s").alias("source")).alias("metadata"), "urls").write.json(path))
    cols = ("url", "domain", "source", "label")
    # JSON lines hold one document per line.
    entries = R.read_curated(spark, path, lines=True)
    return R.curated_malicious_rows(entries).select(*cols).unionByName(R.curated_legitimate_rows(entries).select(*cols))


@query("src_07_curated_documents", with_views(f"""WITH {FEED}
  SELECT u AS url, CASE WHEN domain = '' THEN 'unknown' ELSE domain END AS domain, 'curated' AS source, 1 AS label FROM f WHERE u <> ''""", "v_feed"))
def _curated_documents(spark, folder):
    """One document in a file, written over several lines."""
    path = new_folder(spark, "src07")
    entry = F.struct(F.col("page_id").alias("id"), "url", F.col("target").alias("domain"), "target", F.lit("c").alias("category"))
    documents = _feed(spark, folder).groupBy(F.floor(F.col("page_id") / 500).alias("part")).agg(F.collect_list(entry).alias("urls"))
    whole = F.struct(F.struct(F.lit("s").alias("source")).alias("metadata"), "urls")
    documents.select(F.to_json(whole, {"pretty": "true"}).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return R.curated_malicious_rows(R.read_curated(spark, path)).select("url", "domain", "source", "label")


_RANK = "r AS (SELECT try_cast(trim(rank_text) AS INT) AS rank, lower(trim(domain)) AS domain FROM v_ranked)"


def _ranked(spark, folder):
    path = new_folder(spark, "src08")
    view(spark, folder, "v_ranked").select("rank_text", "domain").write.option("escape", '"').csv(path)
    return R.read_ranked_csv(spark, path)


@query("src_08_ranked_csv", with_views(f"WITH {_RANK} SELECT rank, domain FROM r WHERE rank IS NOT NULL AND domain <> ''", "v_ranked"))
def _ranked_csv(spark, folder):
    return _ranked(spark, folder).orderBy("rank")


@query("src_09_labelled", with_views(f"""WITH {FEED} SELECT u AS url, domain, 1 AS label FROM f WHERE domain <> ''
  UNION ALL SELECT 'https://' || lower(trim(domain)), lower(trim(domain)), 0 FROM v_ranked WHERE try_cast(rank_text AS INT) IS NOT NULL AND trim(domain) <> ''""",
  "v_feed", "v_ranked"))
def _labelled(spark, folder):
    bad, good = new_folder(spark, "src09"), new_folder(spark, "src09")
    sinks.write_feed(feeds.as_feed(_feed(spark, folder).select("url"), "openphish"), bad)
    sinks.write_feed(feeds.ranked_entries(_ranked(spark, folder)), good)
    return R.read_labelled(spark, bad, good)


@query("src_10_feature_file", with_views("""SELECT urlLength AS "urlLength", domainLength AS "domainLength", isHttps AS "isHttps", hasEncodedChars AS "hasEncodedChars",
   digitRatio AS "digitRatio", dnsRecordCount AS "dnsRecordCount", label FROM v_feat""", "v_feat"))
def _feature_file(spark, folder):
    path = new_folder(spark, "src10")
    view(spark, folder, "v_feat").write.option("header", True).csv(path)
    return R.read_features(spark, path)


@query("src_11_url_list", with_views("SELECT trim(url) AS url FROM v_feed WHERE trim(url) <> ''", "v_feed"))
def _url_list(spark, folder):
    path = new_folder(spark, "src11")
    _feed(spark, folder).select(F.concat(F.lit("  "), "url").alias("value")).write.text(path)
    return R.read_url_list(spark, path)


@query("src_12_dns_cache", with_views(f"""WITH {DNS} SELECT domain, status = 'success' AS "hasValidDns", mx AS "hasValidMx", cdn AS "usesCdn",
   nA + nAAAA + nMX + nNS + nTXT + nCNAME AS "dnsRecordCount", TIMESTAMP '2024-01-01' AS observed_at FROM dns""", "v_dns"))
def _cache(spark, folder):
    path = new_folder(spark, "src12")
    dns_cache(spark, folder).withColumns({"domain": F.upper("domain"), "observed_at": F.lit("2024-01-01").cast("timestamp")}).write.parquet(path)
    return R.read_dns_cache(spark, path).unionByName(R.read_dns_cache(spark, path + "-none"))


@query("prj_03_ranked_entries", with_views(f"""WITH {_RANK}
  SELECT 'https://' || domain AS url, domain, 'tranco' AS source, 0 AS label, rank, '' AS category FROM r
  WHERE rank IS NOT NULL AND domain <> ''""", "v_ranked"))
def _ranked_entries(spark, folder):
    return feeds.ranked_entries(_ranked(spark, folder))


@query("prj_04_curated_malicious", with_views(r"""
  WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS loc,
      lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS scheme,
      regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS path FROM v_url)
  SELECT row_number() OVER (ORDER BY page_id) AS id, split_part(list_extract(string_split(loc, '@'), -1), ':', 1) AS domain, scheme, path,
    contains(loc, '.') AND regexp_matches(loc, '[0-9]') AS "hasIpAddress", contains(url, '@') AS "hasAtSymbol", scheme = 'https' AS "isHttps",
    CAST(length(url) AS INT) AS "urlLength", CAST(greatest(len(string_split(loc, '.')) - 2, 0) AS INT) AS "subdomainCount" FROM p""", "v_url"))
def _curated_malicious(spark, folder):
    return feeds.curated_malicious(view(spark, folder, "v_url"), "page_id").select(
        "id", "domain", "scheme", "path", "hasIpAddress", "hasAtSymbol", "isHttps", "urlLength", "subdomainCount")


@query("prj_05_curated_legitimate", with_views(r"""
  SELECT row_number() OVER (ORDER BY page_id) AS id, replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), 'www.', '') AS domain,
    starts_with(lower(url), 'https:') AS "isHttps", CAST(length(url) AS INT) AS "urlLength", page_id AS "approximateRank" FROM v_url""", "v_url"))
def _curated_legitimate(spark, folder):
    return feeds.curated_legitimate(view(spark, folder, "v_url"), "page_id").select(
        "id", "domain", "isHttps", "urlLength", F.col("page_id").alias("approximateRank"))


@query("flt_01_ranked_filter", with_views(f"""WITH {_RANK} SELECT rank, domain FROM r
  WHERE rank IS NOT NULL AND length(domain) >= 4 AND NOT regexp_matches(replace(domain, '.', ''), '^[0-9]+$')
    AND NOT regexp_matches(domain, '({_alt(rules.INFRASTRUCTURE_SUFFIXES)})$') ORDER BY rank, domain LIMIT 3000""", "v_ranked"))
def _ranked_filter(spark, folder):
    return feeds.filter_ranked(_ranked(spark, folder), 3000)


_UNION = "SELECT url, domain, source, label, priority FROM (SELECT u AS url, domain, 's' || priority AS source, 1 AS label, priority FROM f WHERE domain <> '')"


def _union(spark, folder):
    """Six feeds, told apart by their priority."""
    rows = _feed(spark, folder)
    parts = [feeds.as_feed(rows.where(F.col("priority") == i).select("url"), f"s{i}") for i in range(6)]
    return feeds.union_by_priority(parts).select("url", "domain", "source", "label", "priority")


@query("set_01_union", with_views(f"WITH {FEED} {_UNION}", "v_feed"))
def _union_query(spark, folder):
    return _union(spark, folder)


_DEDUPED = f"""{FEED}, un AS ({_UNION}),
  dd AS (SELECT url, domain, source, label FROM (SELECT *, row_number() OVER (PARTITION BY rtrim(lower(url), '/') ORDER BY priority, url) AS r FROM un) WHERE r = 1)"""


@query("set_02_dedupe_urls", with_views(f"WITH {_DEDUPED} SELECT * FROM dd", "v_feed"))
def deduped(spark, folder):
    return feeds.dedupe_urls(_union(spark, folder)).drop("priority")


@query("set_03_dedupe_domains", with_views(f"""WITH {FEED}, un AS ({_UNION})
  SELECT url, domain, source, label FROM (SELECT *, row_number() OVER (PARTITION BY replace(lower(domain), 'www.', '') ORDER BY priority, domain, url) AS r FROM un) WHERE r = 1""",
  "v_feed"))
def _dedupe_domains(spark, folder):
    return feeds.dedupe_domains(_union(spark, folder)).drop("priority")


@query("set_05_distinct_domains", with_views(f"WITH {FEED} SELECT DISTINCT domain FROM f WHERE domain <> ''", "v_feed"))
def _distinct_domains(spark, folder):
    return feeds.distinct_domains(_union(spark, folder))


@query("agg_01_source_counts", with_views(f"WITH {_DEDUPED} SELECT source, count(*) AS n FROM dd GROUP BY source", "v_feed"))
def _source_counts(spark, folder):
    return report.count_by(deduped(spark, folder), "source")


@query("agg_02_top_targets", with_views("SELECT target, count(*) AS n FROM v_feed WHERE target <> '' GROUP BY target ORDER BY n DESC, target LIMIT 10", "v_feed"))
def _top_targets(spark, folder):
    return report.top_values(_feed(spark, folder), "target")


@query("agg_03_top_tlds", with_views(f"""WITH {_DEDUPED} SELECT regexp_extract(domain, '[^.]*$', 0) AS tld, count(*) AS n FROM dd
  WHERE contains(domain, '.') GROUP BY 1 ORDER BY n DESC, tld LIMIT 10""", "v_feed"))
def _top_tlds(spark, folder):
    return report.top_tlds(deduped(spark, folder))


@query("agg_04_category_counts", "SELECT lang AS category, count(*) AS n FROM documents WHERE lang <> '' GROUP BY lang")
def _category_counts(spark, folder):
    from .views import table
    return report.count_by(table(spark, folder, "documents"), "lang", "category")


@query("agg_05_rank_range", with_views('WITH ' + _RANK + ' SELECT min(nullif(rank, 0)) AS "minRank", max(nullif(rank, 0)) AS "maxRank" FROM r', "v_ranked"))
def _rank_range(spark, folder):
    return report.rank_range(_ranked(spark, folder))


@query("agg_06_metadata", """SELECT 'total' AS item, NULL AS value, count(*) AS n FROM documents
  UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source""")
def _metadata(spark, folder):
    from .views import table
    return report.dataset_metadata(table(spark, folder, "documents"), "lang", "source")


@query("snk_01_feed_csv", with_views(f"WITH {FEED} SELECT " + _COLS.format(
    src="'openphish'", fid="NULL", vt="NULL", tgt="nullif(target, '')").replace("1 AS label", "'1' AS label") + " FROM f WHERE domain <> ''", "v_feed"))
def _write_feed(spark, folder):
    path = new_folder(spark, "snk01")
    sinks.write_feed(feeds.as_feed(_feed(spark, folder).select("url", "target"), "openphish"), path)
    table = spark.read.option("header", True).option("escape", '"').csv(path)
    # A plain CSV reader may give an empty field as null or as empty text.
    return table.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in table.columns])


@query("snk_02_features", from_urls("SELECT " + ", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in rules.URL_FEATURES)
       + ", " + ", ".join(f'{"NULL" if c == "domainAgeDays" else "0.0"}::DOUBLE AS "{c}"' for c in rules.OSINT_FEATURES)
       + ", CAST(page_id % 2 AS INT) AS label FROM feats2 WHERE page_id % 5 <> 0"))
def _write_features(spark, folder):
    return R.read_features(spark, _features_written(spark, folder)[0])


def _features_written(spark, folder):
    """Paths of the feature file and of the rejected rows, and the counters of the write."""
    from ..operators.urls import url_features
    path, rejected = new_folder(spark, "snk02"), new_folder(spark, "snk02-rejected")
    rows = url_features(view(spark, folder, "v_url")).withColumn(
        "label", F.when(F.col("page_id") % 5 == 0, "bad").otherwise((F.col("page_id") % 2).cast("string")))
    full = E.add_osint_features(rows.withColumns({
        **{n: F.lit(None).cast("boolean") for n in ("hasWhois", "hasDns", "hasReputation", "recentlyRegistered", "isPrivacyProtected", "knownMalicious")},
        **{n: F.lit(None).cast("int") for n in ("domainAgeDays", "maliciousCount", *[f"n{t}" for t in rules.DNS_TYPES])},
        "aggregateScore": F.lit(None).cast("double"), "hasValidMx": F.lit(None).cast("boolean"), "usesCdn": F.lit(None).cast("boolean")}))
    return path, rejected, sinks.write_features(full, path, rejected, rules.ALL_FEATURES)


@query("snk_02_rejected", from_urls('SELECT page_id, url, \'bad\' AS label, \'bad label\' AS "rejectReason", CAST("urlLength" AS BIGINT) AS "urlLength" FROM feats2 WHERE page_id % 5 = 0'))
def _rejected(spark, folder):
    """The table of rejected rows, read back."""
    rows = spark.read.parquet(_features_written(spark, folder)[1])
    return rows.select("page_id", "url", "label", "rejectReason", F.col("urlLength").cast("bigint").alias("urlLength"))


@query("agg_14_counters_of_write", with_views("""SELECT count(*) FILTER (WHERE page_id % 5 <> 0) AS ok, count(*) FILTER (WHERE page_id % 5 = 0) AS errors,
   true AS "columnsComplete" FROM v_url""", "v_url"))
def _counters_of_write(spark, folder):
    """Counters that the write itself has observed."""
    counters = _features_written(spark, folder)[2]
    return spark.createDataFrame([(counters["ok"], counters["errors"], counters["columnsComplete"])], "ok bigint, errors bigint, columnsComplete boolean")
