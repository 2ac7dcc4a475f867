"""History table jobs.

The table is partitioned by date, so expiry and deletion touch only the dates
they concern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordering import row_numbers

COLUMNS = ("id", "content", "contentType", "threatLevel", "score", "isPhishing", "analyzedAt", "response")


def entry_id(content: Column, at: Column, *more: Column) -> Column:
    """Id that depends on content, time and ``more`` (a message id) only: a task that runs again writes the same id."""
    return F.sha2(F.concat_ws("\u0001", content, F.unix_micros(at.cast("timestamp")).cast("string"), *more), 256)


def to_entries(results: DataFrame) -> DataFrame:
    """Scored rows (content, kind, verdict columns, analyzedAt) as history rows.

    Where there is a ``msg_id``, it is part of the id: equal contents of one instant stay two rows.
    """
    message = [F.col("msg_id")] if "msg_id" in results.columns else []
    return results.select(
        entry_id(F.col("content"), F.col("analyzedAt"), *message).alias("id"), "content", F.col("kind").alias("contentType"),
        "threatLevel", F.col("confidenceScore").alias("score"), "isPhishing", "analyzedAt",
        F.to_json(F.struct(*[c for c in results.columns if c not in ("content", "analyzedAt")])).alias("response"),
        F.to_date("analyzedAt").alias("date"))


def append(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").partitionBy("date").parquet(path)


def list_newest(history: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows from the newest on; a page of them where ``limit`` is given."""
    rows = history.orderBy(F.col("analyzedAt").desc(), F.col("id")).offset(offset)
    return rows if limit is None else rows.limit(limit)


def total(history: DataFrame) -> DataFrame:
    return history.agg(F.count("*").alias("total"))


def get(history: DataFrame, entry: str) -> DataFrame:
    return history.where(F.col("id") == entry)


def delete(history: DataFrame, entry: str) -> DataFrame:
    """The table without one row; rows without an id stay."""
    return history.where(~F.col("id").eqNullSafe(F.lit(entry)))


def keep_newest(history: DataFrame, n: int | None = None) -> DataFrame:
    """The n newest rows; all where n isn't given."""
    return history if n is None else history.orderBy(F.col("analyzedAt").desc(), F.col("id")).limit(n)


def unexpired(history: DataFrame, days: int, as_of: str) -> DataFrame:
    """Rows not older than the given days; 0 keeps all, else rows without a time go.  A table by date reads the dates it needs only."""
    if days == 0:
        return history
    bound = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    kept = history.where(F.col("analyzedAt") >= bound)
    return kept.where(F.col("date") >= F.to_date(bound)) if "date" in history.columns else kept


def prune(history: DataFrame, days: int, n: int, as_of: str) -> DataFrame:
    """Expire, then cap."""
    return keep_newest(unexpired(history, days, as_of), n)


def pruned_count(history: DataFrame, days: int, n: int, as_of: str) -> DataFrame:
    """How many rows expiry and cap remove."""
    kept = unexpired(history, days, as_of).agg(F.least(F.count("*"), F.lit(n)).alias("kept"))
    return total(history).select((F.col("total") - kept.scalar()).alias("removed"))


def search(history: DataFrame, text: str = "", level: str | None = None) -> DataFrame:
    """Rows whose content holds the text (case ignored), of one level where given."""
    found = history.where(F.lower("content").contains(text.lower())) if text else history
    return found if level in (None, "all") else found.where(F.col("threatLevel") == level)


def sort_by(history: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Sort by content, threatLevel, score or analyzedAt; equal rows by id."""
    if column not in ("content", "threatLevel", "score", "analyzedAt"):
        raise ValueError(f"cannot sort by {column}")
    return history.orderBy(F.col(column).desc() if descending else F.col(column).asc(), "id")


def display_text(content: Column) -> Column:
    """Content cut to the width of a table cell."""
    return F.when(F.length(content) > 60, F.concat(F.substring(content, 1, 57), F.lit("…"))).otherwise(content)


def number_newest_first(history: DataFrame) -> DataFrame:
    """Add ``rowNo``: 1 for the newest row."""
    return numbered_by_time(history, "rowNo")


def numbered_by_time(history: DataFrame, name: str) -> DataFrame:
    """Number rows from the newest on, equal times by id; rows without a time come last."""
    return row_numbers(history, [F.col("analyzedAt").desc(), F.col("id")], name)
