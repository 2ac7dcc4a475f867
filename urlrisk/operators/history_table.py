"""The history as a stored table: appends, deletion, expiry and pages.

Changes go through ``versions``, so each shows whole or not at all, and touches the
days it concerns only.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.scoring import score_messages
from . import versions
from .history import delete, list_newest, to_entries

SCHEMA = ("id string, content string, contentType string, threatLevel string, score double, isPhishing boolean, "
          "analyzedAt timestamp, response string, date date")
#: A page is narrowed down by counts until no more rows than this lie around it in one unit.
FINE = 100_000


def scored_entries(messages: DataFrame, bundle: DataFrame, at: str = "analyzedAt", **options) -> DataFrame:
    """Messages (``msg_id, content, content_type`` and a time) scored, as history rows.

    The content travels with the verdict here, because the history keeps it.
    """
    kept = messages.select("msg_id", "content", "content_type", F.col("content").alias("_given"), F.col(at).cast("timestamp").alias("analyzedAt"))
    return to_entries(score_messages(kept, bundle, **options).withColumnRenamed("_given", "content"))


def append(entries: DataFrame, root: str, name: str) -> bool:
    """Append history rows under a name; a name that was used already changes nothing."""
    return versions.add(entries.withColumn("day", versions.day_of(F.col("date"))), root, name)


def read(spark: SparkSession, root: str) -> DataFrame:
    return versions.read(spark, root, SCHEMA)


def delete_entry(spark: SparkSession, root: str, entry: str) -> bool:
    """Take a row out of the table: the days that hold it are written anew; False where there is none."""
    return versions.replace(spark, root, SCHEMA, lambda rows: rows.where(F.col("id") == entry), lambda rows: delete(rows, entry), f"delete-{_token()}")


def expire(spark: SparkSession, root: str, days: int, as_of: str) -> bool:
    """Take rows older than the given days out, and rows without a time; 0 keeps all.

    Whole days go without being read; only the day of the bound is written anew.
    """
    if days == 0:
        return False
    bound = datetime.datetime.fromisoformat(as_of) - datetime.timedelta(days=days)
    day, at = bound.date().isoformat(), F.lit(bound).cast("timestamp")
    names = [f"expire-{_token()}" for _ in range(2)]
    older = (F.col("day") < day) | (F.col("day") == versions.NO_DAY)
    gone = versions.replace(spark, root, SCHEMA, lambda rows: versions.live(spark, root).where(older), None, names[0])
    cut = versions.replace(spark, root, SCHEMA, lambda rows: rows.where((F.col("day") == day) & (F.col("analyzedAt") < at)),
                           lambda rows: rows.where(F.col("analyzedAt") >= at), names[1])
    return gone or cut


def compact(spark: SparkSession, root: str, most: int = 16) -> bool:
    """Join what many small appends have written for one day."""
    return versions.compact(spark, root, SCHEMA, f"compact-{_token()}", most)


def total(spark: SparkSession, root: str) -> int:
    """Rows of the table, from its commits."""
    return versions.live(spark, root).agg(F.sum("n")).first()[0] or 0


def page(spark: SparkSession, root: str, limit: int, offset: int = 0, fine: int = FINE) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` from the newest on.

    Counts per day (from the commits), then per hour, minute and so on, and beginning of
    the id say where they lie, so that only the days around them are read and only the
    rows around them are sorted.
    """
    counts = versions.live(spark, root).groupBy("day").agg(F.sum("n").alias("n")).collect()
    days = sorted(((r["day"], r["n"]) for r in counts), key=lambda d: (d[0] != versions.NO_DAY, d[0]), reverse=True)
    chosen, before, around = _around(days, limit, offset)
    rows = read(spark, root).where(F.col("day").isin(chosen))
    skip = offset - before
    for unit in ("hour", "minute", "second", "millisecond", "microsecond"):
        if around <= fine:
            break
        rows, skip, around = _narrowed(rows, F.date_trunc(unit, "analyzedAt"), limit, skip, newest=True)
    # Rows of one instant go by the beginnings of their ids.
    for length in (2, 4, 8):
        if around <= fine or rows.select("analyzedAt").distinct().limit(2).count() > 1:
            break
        rows, skip, around = _narrowed(rows, F.substring("id", 1, length), limit, skip, newest=False)
    return list_newest(rows, limit, skip).drop("day")


def _around(counts: list[tuple], limit: int, offset: int) -> tuple[list, int, int]:
    """Units (in order, with their rows) that hold the page; rows before the first of them and rows in them."""
    chosen, before, at, inside = [], 0, 0, 0
    for unit, n in counts:
        if at + n <= offset:
            before = at + n
        elif at < offset + limit:
            chosen.append(unit)
            inside += n
        at += n
    return chosen, before, inside


def _narrowed(rows: DataFrame, unit: Column, limit: int, skip: int, newest: bool) -> tuple[DataFrame, int, int]:
    """Only the units around the page; each step has some hundred units for every one that is left of the step before."""
    counts = [(r["unit"], r["n"]) for r in rows.groupBy(unit.alias("unit")).agg(F.count("*").alias("n")).collect()]
    known = sorted((c for c in counts if c[0] is not None), key=lambda c: c[0], reverse=newest)
    none = [c for c in counts if c[0] is None]
    chosen, before, around = _around([*known, *none] if newest else [*none, *known], limit, skip)
    if not chosen:
        return rows, skip, 0
    real = [u for u in chosen if u is not None]
    held = unit.isin([F.lit(u) for u in real]) if real else F.lit(False)
    return rows.where(held | unit.isNull() if None in chosen else held), skip - before, around


def page_after(history: DataFrame, limit: int, at: datetime.datetime | None, entry: str | None) -> DataFrame:
    """The next rows from the newest on after a row that is known by its time and id; no row before it is sorted."""
    if at is None:
        rest = history.where(F.col("analyzedAt").isNull() & (F.col("id") > entry))
    else:
        time = F.lit(at).cast("timestamp")
        rest = history.where((F.col("analyzedAt") < time) | F.col("analyzedAt").isNull() | ((F.col("analyzedAt") == time) & (F.col("id") > F.lit(entry))))
        if "day" in history.columns:
            rest = rest.where((F.col("day") <= at.date().isoformat()) | (F.col("day") == versions.NO_DAY))
    return rest.orderBy(F.col("analyzedAt").desc(), F.col("id")).limit(limit)


def _token() -> str:
    import uuid
    return uuid.uuid4().hex
