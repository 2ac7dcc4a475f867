"""Tables by day whose changes show all at once or not at all.

A table is a folder.  Below ``data`` are the rows, by day and by the attempt that wrote
them; below ``commits`` one small file for each change says which (day, attempt) pairs
it adds and which it takes away.  Readers take pairs that were added and not taken away
since.  So a change shows when its commit file appears; a writer that fails before
leaves files nobody reads.  A commit has a name, and a name that is there already makes
the change a no-op: a batch that is run again after a crash adds nothing.

Days without a date are ``NO_DAY``.  Appends may run beside anything; a ``replace``
touches only the pairs it has seen at its start, so rows appended meanwhile stay, but
two replacements of one day must not run at the same time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

NO_DAY = "none"
COMMIT = "day string, attempt string, live boolean, n long, name string"


def day_of(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit(NO_DAY))


def create(spark: SparkSession, root: str) -> None:
    """An empty table; nothing where there is one."""
    if not _exists(spark, f"{root}/commits"):
        spark.createDataFrame([], "value long, day string, attempt string").write.partitionBy("day", "attempt").parquet(f"{root}/data")
        _commit(spark.createDataFrame([], "day string, attempt string, live boolean, n long"), root, "create")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _commit(pairs: DataFrame, root: str, name: str) -> None:
    """One file, so that it appears whole; a row without a day marks a commit without pairs."""
    mark = pairs.sparkSession.createDataFrame([(None, None, False, 0)], "day string, attempt string, live boolean, n long")
    pairs.select("day", "attempt", "live", "n").unionByName(mark).coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/name={name}")


def commits(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(COMMIT).parquet(f"{root}/commits")


def committed(spark: SparkSession, root: str, name: str) -> bool:
    return not commits(spark, root).where(F.col("name") == name).isEmpty()


def live(spark: SparkSession, root: str) -> DataFrame:
    """``day, attempt, n`` (rows) of what readers see; a few rows per day and commit."""
    rows = commits(spark, root).where("day IS NOT NULL")
    return rows.where("live").select("day", "attempt", "n").join(rows.where("NOT live").select("day", "attempt"), ["day", "attempt"], "left_anti")


def _data(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    schema = spark.createDataFrame([], schema).schema
    return spark.read.schema(schema.add("day", "string").add("attempt", "string")).parquet(f"{root}/data")


def read(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """The rows of a table with their ``day``; only folders of live pairs are read."""
    return _data(spark, root, schema).join(live(spark, root).select("day", "attempt"), ["day", "attempt"], "left_semi").drop("attempt")


def _written(rows: DataFrame, root: str, name: str) -> DataFrame:
    """Write rows (with ``day``) as one attempt; the pairs it made and their sizes."""
    attempt = f"{name}-{uuid.uuid4().hex}"
    rows.withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("day", "attempt").parquet(f"{root}/data")
    made = rows.sparkSession.read.schema("day string, attempt string").parquet(f"{root}/data").where(F.col("attempt") == attempt)
    return made.groupBy("day", "attempt").agg(F.count("*").alias("n")).withColumn("live", F.lit(True))


def add(rows: DataFrame, root: str, name: str) -> bool:
    """Append rows that have a column ``day``; False where a commit of this name is there."""
    spark = rows.sparkSession
    create(spark, root)
    if committed(spark, root, name):
        return False
    _commit(_written(rows, root, name), root, name)
    return True


def replace(spark: SparkSession, root: str, schema: StructType | str, pairs: Callable[[DataFrame], DataFrame],
            change: Callable[[DataFrame], DataFrame] | None, name: str) -> bool:
    """Put ``change(rows)`` in the place of the rows of some live pairs, or nothing where ``change`` is ``None``.

    ``pairs`` gets the rows of the table with their ``day`` and ``attempt`` and gives a
    table with these two columns.  False and no change where it has no row, or where a
    commit of this name is there.
    """
    create(spark, root)
    if committed(spark, root, name):
        return False
    now = live(spark, root)
    # What is taken away is fixed before anything is read, so that rows appended from now on stay.
    chosen = f"{root}/chosen/{name}-{uuid.uuid4().hex}"
    pairs(_data(spark, root, schema).join(now, ["day", "attempt"])).select("day", "attempt").distinct().coalesce(1).write.parquet(chosen)
    old = spark.read.schema("day string, attempt string").parquet(chosen)
    if old.isEmpty():
        return False
    gone = old.withColumn("live", F.lit(False)).withColumn("n", F.lit(0).cast("long"))
    if change is None:
        _commit(gone, root, name)
        return True
    rows = change(_data(spark, root, schema).join(old, ["day", "attempt"], "left_semi").drop("attempt"))
    _commit(gone.unionByName(_written(rows, root, name)), root, name)
    return True


def compact(spark: SparkSession, root: str, schema: StructType | str, name: str, most: int = 16,
            change: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> bool:
    """One pair for each day that has more than ``most`` of them."""
    many = live(spark, root).groupBy("day").agg(F.count("*").alias("pairs")).where(F.col("pairs") > most).select("day")
    return replace(spark, root, schema, lambda rows: live(spark, root).join(many, "day", "left_semi"), change, name)
