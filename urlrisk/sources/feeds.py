"""Readers for URL feeds, rank lists and caches.

Schemas are fixed, so no file is read twice to infer one.  Every feed reader
gives the common feed columns; rows without a domain are dropped.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import rules
from ..functions.strings import strip
from ..functions.urlparts import feed_domain
from ..operators.feeds import LEGITIMATE_COLUMNS, MALICIOUS_COLUMNS, as_feed

_VERIFIED = ("phish_id string, url string, phish_detail_url string, submission_time string, verified string, "
             "verification_time string, online string, target string")
# A value no file holds: empty fields then stay empty and only missing ones are null.
_NO_NULL = "\u0001"


def _csv(spark: SparkSession, path: str, schema: str, header: bool = False, comment: str | None = None) -> DataFrame:
    reader = (spark.read.schema(schema).option("header", header).option("nullValue", _NO_NULL)
              .option("escape", '"').option("multiLine", False))
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path)


def _yes(name: str) -> Column:
    return F.lower(strip(F.coalesce(F.col(name), F.lit("")))) == "yes"


def _from_verified(df: DataFrame, keep: Column) -> DataFrame:
    return as_feed(df.where(keep).withColumns({
        "url": strip(F.coalesce("url", F.lit(""))), "feedId": F.col("phish_id"),
        "verificationTime": F.col("verification_time")}).where(F.col("url") != ""), "phishtank")


def read_verified_csv(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """CSV feed with a header; strict keeps verified entries that are online."""
    df = _csv(spark, path, _VERIFIED, header=True)
    return _from_verified(df, _yes("verified") & _yes("online") if strict else F.lit(True))


def read_verified_json(spark: SparkSession, path: str, strict: bool = True, lines: bool = False) -> DataFrame:
    """JSON feed; strict keeps verified entries (online is not checked in this form).

    One JSON array is one value and is parsed by one task; use JSON lines for
    files of a size where that matters.
    """
    df = spark.read.schema(_VERIFIED).option("multiLine", not lines).json(path)
    return _from_verified(df, F.coalesce(F.col("verified") == "yes", F.lit(False)) if strict else F.lit(True))


def read_local_dump(spark: SparkSession, csv_path: str | None = None, json_path: str | None = None) -> DataFrame | None:
    """A dump fetched earlier, unfiltered; CSV wins over JSON, None where neither exists."""
    for path, reader in ((csv_path, read_verified_csv), (json_path, read_verified_json)):
        if path:
            try:
                return reader(spark, path, strict=False)
            except AnalysisException as error:
                if "PATH_NOT_FOUND" not in str(error):
                    raise
    return None


def read_url_lines(spark: SparkSession, path: str, source: str = "openphish") -> DataFrame:
    """One URL per line; blank lines and ``#`` lines are skipped."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("url"))
    return as_feed(lines.where((F.col("url") != "") & ~F.col("url").startswith("#")), source)


def _unquoted(name: str) -> Column:
    return F.btrim(strip(F.coalesce(F.col(name), F.lit(""))), F.lit('"'))


def read_tagged_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV without a header, ``#`` comments; needs four columns, tags become the target."""
    df = _csv(spark, path, "id string, dateadded string, url string, url_status string, last_online string, "
                           "threat string, tags string, link string, reporter string", comment="#")
    kept = df.where(F.col("url_status").isNotNull()).withColumns({"url": _unquoted("url"), "target": _unquoted("tags")})
    return as_feed(kept.where(F.col("url").startswith("http")), "urlhaus")


def read_scored_csv(spark: SparkSession, path: str, minimum: float = 5.0) -> DataFrame:
    """CSV (date, score, url, ip); rows without a number or below the minimum are dropped."""
    df = _csv(spark, path, "date string, score string, url string, ip string", comment="#")
    kept = df.withColumns({"_score": _unquoted("score").try_cast("double"), "url": _unquoted("url")})
    return as_feed(kept.where((F.col("_score") >= minimum) & F.col("url").startswith("http")), "phishstats")


_CURATED = ("metadata struct<source:string,totalUrls:bigint>, urls array<struct<id:bigint,url:string,domain:string,"
            "target:string,category:string,approximateRank:int>>")


def read_curated(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Entries of nested curated documents: one document per file, or one per line."""
    documents = spark.read.schema(_CURATED).option("multiLine", not lines).json(path)
    return documents.select(F.explode("urls").alias("u")).select("u.*")


def curated_malicious_rows(entries: DataFrame) -> DataFrame:
    """Entries with a URL; one without a domain gets ``unknown``."""
    df = entries.withColumn("url", strip(F.coalesce("url", F.lit("")))).where(F.col("url") != "")
    return as_feed(df, "curated", keep_unknown=True)


def curated_legitimate_rows(entries: DataFrame) -> DataFrame:
    """Entries with URL and domain; ``www.`` is cut from the domain."""
    blank = F.lit("")
    df = entries.withColumns({"url": strip(F.coalesce("url", blank)), "domain": strip(F.coalesce("domain", blank))})
    return df.where((F.col("url") != "") & (F.col("domain") != "")).select(
        "url", F.replace("domain", F.lit("www."), blank).alias("domain"), F.lit("curated").alias("source"),
        F.lit(0).alias("label"), F.coalesce("approximateRank", F.lit(0)).alias("rank"),
        F.coalesce("category", blank).alias("category")).select(*LEGITIMATE_COLUMNS)


def read_ranked_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rank list (rank, domain); rows without a numeric rank or a domain are skipped."""
    df = _csv(spark, path, "rank string, domain string")
    return (df.select(strip(F.col("rank")).try_cast("int").alias("rank"), F.lower(strip("domain")).alias("domain"))
            .where(F.col("rank").isNotNull() & (F.col("domain") != "")))


def read_labelled(spark: SparkSession, malicious: str, legitimate: str, limit: int = 0) -> DataFrame:
    """Labelled corpus of two feed files; the first ``limit`` by URL where given (0: all)."""
    one = lambda path, names, label: _csv(spark, path, ", ".join(f"{n} string" for n in names), header=True).select(
        "url", "domain", F.lit(label).alias("label"))
    both = one(malicious, MALICIOUS_COLUMNS, 1).unionByName(one(legitimate, LEGITIMATE_COLUMNS, 0))
    return both.orderBy("url", "label").limit(limit) if limit else both


def read_features(spark: SparkSession, path: str, names=rules.ALL_FEATURES) -> DataFrame:
    """Feature file with a label; an unknown value is null, never NaN."""
    df = spark.read.option("header", True).csv(path)
    if "label" not in df.columns:
        raise ValueError("the feature table has no label column")
    number = lambda n: F.when(~F.isnan(F.col(n).try_cast("double")), F.col(n).try_cast("double")).alias(n)
    return df.select(*[number(n) for n in names if n in df.columns], F.col("label").cast("int"))


def read_url_list(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One URL per line, trimmed, blanks dropped; the first ``limit`` in order where given."""
    df = spark.read.text(path).select(strip(F.col("value")).alias("url")).where(F.col("url") != "")
    return df if limit is None else df.orderBy("url").limit(limit)


CACHE_SCHEMA = "domain string, hasValidDns boolean, hasValidMx boolean, usesCdn boolean, dnsRecordCount int, observed_at timestamp"


def read_dns_cache(spark: SparkSession, path: str) -> DataFrame:
    """Lookup cache by lower-case domain; a missing cache is an empty one."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path).withColumn("domain", F.lower("domain"))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)
