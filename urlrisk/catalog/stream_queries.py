"""Stream jobs as registered queries: a folder is streamed to its end and the result read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history_table
from ..session import new_folder
from ..streaming import jobs
from .osint_queries import bundle
from .registry import query
from .score_queries import SCO_16, flat_verdicts, over_verdicts
from .text_queries import messages
from .views import view, with_views


@query("str_01_score_stream", over_verdicts(SCO_16))
def _score_stream(spark, folder):
    source, out, checkpoint, known = (new_folder(spark, f"str01-{n}") for n in ("in", "out", "checkpoint", "bundle"))
    messages(spark, folder).write.parquet(source)
    bundle(spark, folder).write.parquet(known)
    stream = jobs.read_messages(spark, source)
    jobs.score_stream(stream, spark.read.parquet(known), out, checkpoint).awaitTermination()
    return flat_verdicts(spark.read.parquet(out))


@query("str_02_dedupe_stream", with_views("SELECT DISTINCT rtrim(lower(url), '/') AS url_key FROM v_feed", "v_feed"))
def _dedupe_stream(spark, folder):
    source, out, checkpoint = (new_folder(spark, f"str02-{n}") for n in ("in", "out", "checkpoint"))
    feed = view(spark, folder, "v_feed").select(
        "page_id", "url", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("page_id") % 600).cast("int"))).alias("ts"))
    feed.write.parquet(source)
    stream = spark.readStream.schema("page_id long, url string, ts timestamp").parquet(source)
    jobs.append_stream(jobs.dedupe_feed(stream).select("url_key"), out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


_LEVELS = ", ".join(f"count(*) FILTER (WHERE threatLevel = '{x}') AS {x}" for x in ("safe", "suspicious", "dangerous", "critical"))


_COUNTS = with_views(f"""SELECT date_trunc('hour', analyzedAt) AS "windowStart", {_LEVELS}, count(*) AS total FROM v_hist GROUP BY 1""", "v_hist")


@query("str_03_level_counts", _COUNTS)
def _level_counts(spark, folder):
    return jobs.level_counts(view(spark, folder, "v_hist"))


def _levels(spark, folder):
    return view(spark, folder, "v_hist").select("threatLevel", F.col("analyzedAt").cast("timestamp").alias("analyzedAt"))


def _count_stream(spark, source, root, checkpoint):
    stream = spark.readStream.schema("threatLevel string, analyzedAt timestamp").parquet(source)
    jobs.count_into_table(stream, root, checkpoint).awaitTermination()


@query("str_03_level_counts_stream", _COUNTS)
def _level_counts_stream(spark, folder):
    """All windows, those that the watermark has not closed among them."""
    source, root, checkpoint = (new_folder(spark, f"str03-{n}") for n in ("in", "table", "checkpoint"))
    _levels(spark, folder).write.parquet(source)
    _count_stream(spark, source, root, checkpoint)
    return jobs.stored_level_counts(spark, root)


@query("str_03_level_counts_stream_all", _COUNTS)
def _level_counts_stream_all(spark, folder):
    """The same table after rows that land in four parts, cut in the middle of a window; the stream stops and goes on in between."""
    source, root, checkpoint = (new_folder(spark, f"str03-{n}") for n in ("in", "table", "checkpoint"))
    rows = _levels(spark, folder)
    ends = rows.select(F.unix_micros(F.min("analyzedAt")).alias("a"), F.unix_micros(F.max("analyzedAt")).alias("b")).first()
    part = F.floor((F.unix_micros("analyzedAt") - ends["a"]) * 4 / (ends["b"] - ends["a"] + 1))
    for i in range(4):
        rows.where(part == i).write.mode("append").parquet(source)
        _count_stream(spark, source, root, checkpoint)
    jobs.compact_level_counts(spark, root, "compact", most=1)
    return jobs.stored_level_counts(spark, root)


# Messages get a time, and the history keeps what was scored.
_AT = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (length(content_type) * 7 + length(msg_id)) HOUR"
_ENTRIES = f"""SELECT sha256(concat_ws(chr(1), m.content, CAST(epoch_us({_AT.replace("content_type", "m.content_type").replace("msg_id", "m.msg_id")}) AS VARCHAR), m.msg_id)) AS id, s.msg_id,
    s.kind AS "contentType", s."threatLevel", round(s."confidenceScore", 6) AS score, s."isPhishing", {_AT.replace("content_type", "m.content_type").replace("msg_id", "m.msg_id")} AS "analyzedAt",
    length(m.content)::INT AS length FROM ({SCO_16}) s JOIN v_msg m ON m.msg_id = s.msg_id"""


@query("str_01_history_stream", over_verdicts(_ENTRIES))
def _history_stream(spark, folder):
    """Messages that land in three parts, scored into the history; the bundle is read anew for every batch."""
    source, root, checkpoint, known = (new_folder(spark, f"str01-{n}") for n in ("in", "history", "checkpoint", "bundle"))
    hours = F.length("content_type") * 7 + F.length("msg_id")
    rows = messages(spark, folder).withColumn("received", F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=hours))
    bundle(spark, folder).write.parquet(known)
    for part in range(3):
        rows.where(F.pmod(F.xxhash64("msg_id"), F.lit(3)) == part).write.mode("append").parquet(source)
        stream = jobs.read_messages(spark, source, f"{jobs.MESSAGE_SCHEMA}, received timestamp")
        jobs.score_into_history(stream, lambda session: session.read.parquet(known), root, checkpoint, "received").awaitTermination()
    entries = history_table.read(spark, root)
    return entries.select("id", F.get_json_object("response", "$.msg_id").alias("msg_id"), "contentType", "threatLevel", F.round("score", 6).alias("score"),
                          "isPhishing", "analyzedAt", F.length("content").alias("length"))
