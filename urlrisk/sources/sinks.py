"""Writers.  Parquet is the working format; CSV and JSON are for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..operators.history import numbered_by_time
from ..operators.feeds import LEGITIMATE_COLUMNS, MALICIOUS_COLUMNS
from ..session import new_folder


def write_feed(df: DataFrame, path: str, format: str = "csv") -> None:
    """Feed with its fixed column order."""
    columns = LEGITIMATE_COLUMNS if "rank" in df.columns else MALICIOUS_COLUMNS
    out = df.select(*columns)
    writer = out.write.mode("errorifexists")
    writer.option("header", True).option("escape", '"').csv(path) if format == "csv" else writer.format(format).save(path)


def write_features(df: DataFrame, path: str, rejected_path: str, names, format: str = "csv") -> dict:
    """Features and label; rows that cannot be used go to their own place and fail nothing.

    Gives ``ok``, ``errors`` and ``columnsComplete``.  The rows are derived once, into a
    stage by usable and rejected; the counts are observed in that write.
    """
    counts = Observation("features")
    marked = df.withColumn("rejectReason", _reject_reason())
    good = F.col("rejectReason").isNull()
    stage = new_folder(df.sparkSession, "features")
    observed = marked.observe(counts, F.count_if(good).alias("ok"), F.count_if(~good).alias("errors"))
    observed.withColumn("_bad", ~good).write.partitionBy("_bad").parquet(stage)
    stored = df.sparkSession.read.schema(marked.schema.add("_bad", "boolean")).parquet(stage)
    out = stored.where(~F.col("_bad")).select(*[F.col(n).cast("double").alias(n) for n in names], F.col("label").cast("int").alias("label"))
    out.write.mode("errorifexists").option("header", True).format(format).save(path)
    stored.where("_bad").drop("_bad").write.mode("errorifexists").parquet(rejected_path)
    return {**counts.get, "columnsComplete": all(n in df.columns for n in names)}


def _reject_reason():
    return (F.when(F.col("url").isNull(), "missing url")
            .when(F.col("label").try_cast("int").isNull(), "bad label"))


def split_feature_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a URL and a numeric label, and the others with the reason."""
    marked = df.withColumn("rejectReason", _reject_reason())
    return marked.where(F.col("rejectReason").isNull()).drop("rejectReason"), marked.where(F.col("rejectReason").isNotNull())


def write_splits(df: DataFrame, path: str, stats: DataFrame, stats_path: str) -> None:
    """Splits as partitions of one table; stats as JSON lines."""
    df.write.mode("errorifexists").partitionBy("split").parquet(path)
    write_report(stats, stats_path)


def write_report(df: DataFrame, path: str) -> None:
    """Report rows as JSON, one object per row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("errorifexists").text(path)


def history_export(df: DataFrame) -> DataFrame:
    """History rows for CSV, newest first, numbered from 1."""
    return numbered_by_time(df, "#").select(
        "#", F.concat(F.lit('"'), F.replace("content", F.lit('"'), F.lit('""')), F.lit('"')).alias("Content"),
        F.col("contentType").alias("Type"), F.col("threatLevel").alias("Threat Level"),
        F.format_string("%.1f", F.col("score") * 100).alias("Score"), F.col("analyzedAt").alias("Date"))


def write_history_csv(df: DataFrame, path: str) -> None:
    """The rows are joined to lines as they are: the content is quoted already."""
    out = history_export(df).orderBy("#")
    line = F.concat_ws(",", *[F.col(f"`{c}`").cast("string") for c in out.columns])
    out.select(line.alias("value")).write.mode("errorifexists").text(path)


def write_history_json(df: DataFrame, path: str) -> None:
    """History rows as JSON, one object per row."""
    df.write.mode("errorifexists").json(path)


def batch_export(df: DataFrame) -> DataFrame:
    """Finished rows of a batch: URL, status, level, confidence, flag, milliseconds."""
    return df.where(F.col("status") == "done").select(
        F.col("url").alias("URL"), F.col("status").alias("Status"), F.col("threatLevel").alias("Threat Level"),
        F.format_string("%.3f", "confidenceScore").alias("Confidence"), F.col("isPhishing").alias("Is Phishing"),
        F.format_string("%.0f", "analysisTime").alias("Analysis Time (ms)"))


def write_batch_csv(df: DataFrame, path: str) -> None:
    batch_export(df).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_batch_json(df: DataFrame, path: str) -> None:
    df.where(F.col("status") == "done").select(
        "url", "threatLevel", "confidenceScore", "isPhishing", "analysisTime", "reasons").write.mode("errorifexists").json(path)
