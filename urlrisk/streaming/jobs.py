"""The jobs as streams.  Batch and stream share the transformations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from .. import rules
from ..operators import history_table, versions
from ..operators.feeds import url_key
from ..plans.scoring import score_messages

MESSAGE_SCHEMA = "msg_id string, content string, content_type string"


def read_messages(spark: SparkSession, folder: str, schema: str = MESSAGE_SCHEMA, files_per_trigger: int | None = None) -> DataFrame:
    """Messages that land as Parquet files in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def score_stream(messages: DataFrame, bundle: DataFrame, out: str, checkpoint: str, available_now: bool = True,
                 **options) -> StreamingQuery:
    """Score a stream of messages and append the verdicts to a table.

    The bundle is a static table: its files are those of the time when it was read; use
    ``score_into_history`` for a bundle that changes meanwhile.  The file sink and the
    checkpoint make each input file count exactly once.
    """
    return append_stream(score_messages(messages, bundle, **options), out, checkpoint, available_now)


def dedupe_feed(feed: DataFrame, at: str = "ts", delay: str = "1 day") -> DataFrame:
    """First row per URL; repeats inside the watermark are dropped, so the state is bounded."""
    return (feed.withColumn("url_key", url_key(F.col("url"))).withWatermark(at, delay)
            .dropDuplicatesWithinWatermark(["url_key"]))


def level_counts(scored: DataFrame, at: str = "analyzedAt", width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Rows per level in tumbling windows; as a stream, rows later than the delay are dropped."""
    timed = scored.withWatermark(at, delay) if scored.isStreaming else scored
    return (timed.groupBy(F.window(at, width).alias("w"))
            .agg(*[F.count_if(F.col("threatLevel") == level).alias(level) for level in rules.LEVELS], F.count("*").alias("total"))
            .select(F.col("w.start").alias("windowStart"), *rules.LEVELS, "total"))


LEVEL_COUNTS = "windowStart timestamp, " + ", ".join(f"{level} long" for level in rules.LEVELS) + ", total long"


def _started(writer: DataStreamWriter, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def score_into_history(messages: DataFrame, read_bundle: Callable[[SparkSession], DataFrame], root: str, checkpoint: str,
                       at: str | None = None, name: str = "stream", available_now: bool = True, **options) -> StreamingQuery:
    """Score a stream of messages and append the verdicts to the history table at ``root``.

    ``read_bundle`` is called for every micro-batch, so a batch is scored with the bundle
    of its time.  A batch is one commit of the history, named by its number: a batch
    that runs again after a crash finds its commit and adds nothing.  ``at`` is the
    column with the time of a message; without one it is the time of the batch, which
    the checkpoint keeps.  Streams with checkpoints of their own need names of their own.
    """
    timed = messages if at else messages.withColumn("_at", F.current_timestamp())

    def write(batch: DataFrame, number: int) -> None:
        spark, commit = batch.sparkSession, f"{name}-{number:012d}"
        versions.create(spark, root)
        if not versions.committed(spark, root, commit):
            history_table.append(history_table.scored_entries(batch, read_bundle(spark), at or "_at", **options), root, commit)

    return _started(timed.writeStream.foreachBatch(write), checkpoint, available_now)


def count_into_table(scored: DataFrame, root: str, checkpoint: str, at: str = "analyzedAt", name: str = "counts",
                     available_now: bool = True, **options) -> StreamingQuery:
    """Keep the level counts of a stream as a table at ``root``, windows that are still open among them.

    Every micro-batch commits the windows it has changed with their counts so far;
    ``stored_level_counts`` takes the newest row of a window.
    """
    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumns({"batch": F.lit(number).cast("long"), "day": versions.day_of(F.to_date("windowStart"))})
        if not versions.add(rows, root, f"{name}-{number:012d}"):
            batch.write.format("noop").mode("overwrite").save()  # the counts kept by the stream need the batch all the same

    return _started(level_counts(scored, at, **options).writeStream.outputMode("update").foreachBatch(write), checkpoint, available_now)


def _newest(rows: DataFrame) -> DataFrame:
    """The newest row of every window; a fixed-size state per window."""
    counts = F.struct(*rules.LEVELS, "total", "batch")
    merged = rows.groupBy("windowStart", "day").agg(F.max_by(counts, "batch").alias("c"))
    return merged.select("windowStart", "c.*", "day")


def stored_level_counts(spark: SparkSession, root: str) -> DataFrame:
    """The table of ``count_into_table``: one row for each window."""
    return _newest(versions.read(spark, root, f"{LEVEL_COUNTS}, batch long")).drop("batch", "day")


def compact_level_counts(spark: SparkSession, root: str, name: str, most: int = 16) -> bool:
    """Keep only the newest row of each window on days with more than ``most`` commits."""
    return versions.compact(spark, root, f"{LEVEL_COUNTS}, batch long", name, most, _newest)


def append_stream(df: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to a Parquet table."""
    return _started(df.writeStream.format("parquet").outputMode("append").option("path", out), checkpoint, available_now)
