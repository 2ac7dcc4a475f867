"""Corpus and batch reports: counts, top lists, dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import rules
from ..functions.staging import explode_rows


def count_by(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Counts of the non-empty values, largest first, ties by value."""
    name = name or column
    return (df.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(F.col(column).alias(name))
            .agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), name))


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent non-empty values."""
    return count_by(df, column).limit(n)


def top_tlds(df: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent last labels of domains that have a dot."""
    tld = F.when(F.col("domain").contains("."), F.substring_index("domain", ".", -1))
    return (df.select(tld.alias("tld")).where(F.col("tld").isNotNull()).groupBy("tld").agg(F.count("*").alias("n"))
            .orderBy(F.col("n").desc(), "tld").limit(n))


def rank_range(df: DataFrame) -> DataFrame:
    """Lowest and highest rank; zero and null are no ranks."""
    rank = F.when(F.col("rank") != 0, F.col("rank"))
    return df.agg(F.min(rank).alias("minRank"), F.max(rank).alias("maxRank"))


def dataset_metadata(df: DataFrame, *columns: str) -> DataFrame:
    """Total and distinct values with their counts, in long form (item, value, n).

    Long form, because a list of all values would be one unbounded row.
    """
    total = df.agg(F.lit("total").alias("item"), F.lit(None).cast("string").alias("value"), F.count("*").alias("n"))
    if not columns:
        return total
    items = F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("string").alias("value")) for c in columns])
    values = df.select(F.explode(items).alias("i")).select("i.*").groupBy("item", "value").agg(F.count("*").alias("n"))
    return total.unionByName(values)


def class_counts(df: DataFrame, *by: str, label: str = "label") -> DataFrame:
    """Rows per group: all, class 1 and class 0."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col(label) == 1).alias("phishing"),
                               F.count_if(F.col(label) == 0).alias("legitimate"))


def batch_summary(df: DataFrame) -> DataFrame:
    """Finished rows per level, failed rows, completed and total."""
    done = F.col("status") == "done"
    return df.agg(
        *[F.count_if(done & (F.col("threatLevel") == level)).alias(level) for level in rules.LEVELS],
        F.count_if(F.col("status") == "error").alias("failed"),
        F.count_if(F.col("status").isin("done", "error")).alias("completed"), F.count("*").alias("total"))


def newest(df: DataFrame, n: int) -> DataFrame:
    """The n newest history rows (each partition keeps n, no full sort)."""
    return df.orderBy(F.col("analyzedAt").desc(), F.col("id")).limit(n)


def dashboard(history: DataFrame, n: int = 10) -> DataFrame:
    """Totals over the n newest rows."""
    return newest(history, n).agg(
        F.count("*").alias("total"), F.count_if(F.col("threatLevel") == "safe").alias("safe"),
        F.count_if(F.col("threatLevel") == "critical").alias("critical"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("avgScore"),
        F.coalesce(F.try_divide(F.count_if(F.col("threatLevel") == "safe") * 100.0, F.count("*")), F.lit(0.0)).alias("safePercent"))


def by_day_label(history: DataFrame, as_of: str) -> DataFrame:
    """Rows per day, the day of ``as_of`` and the one before it by name."""
    day, today = F.to_date("analyzedAt"), F.to_date(F.lit(as_of))
    label = (F.when(day == today, "Today").when(day == F.date_sub(today, 1), "Yesterday")
             .otherwise(F.date_format(day, "MMM d")))
    return history.groupBy(day.alias("day"), label.alias("label")).agg(
        F.count("*").alias("n"), F.max("analyzedAt").alias("newest"))


def score_trend(history: DataFrame, n: int = 7) -> DataFrame:
    return newest(history, n).select("analyzedAt", "id", "score")


def hits_per_type(df: DataFrame) -> DataFrame:
    """Pattern hits per type over a corpus that has ``hits``."""
    return explode_rows(df, "hits", "hit").groupBy(F.col("hit.type").alias("type")).agg(F.count("*").alias("n"))


def texts_per_tactic(df: DataFrame) -> DataFrame:
    """Texts per tactic over a corpus that has ``tactics``."""
    return explode_rows(df, "tactics", "tactic").groupBy("tactic").agg(F.count("*").alias("n"))


def extraction_counters(df: DataFrame, names) -> DataFrame:
    """Usable rows, rejected rows, and whether all feature columns are there."""
    good = F.col("url").isNotNull() & F.col("label").try_cast("int").isNotNull()
    return df.agg(F.count_if(good).alias("ok"), F.count_if(~good).alias("errors"),
                  F.lit(all(n in df.columns for n in names)).alias("columnsComplete"))
