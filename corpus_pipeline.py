"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Every stage works on all rows the one before kept; its result is written as
Parquet and read again.  All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from urlrisk.catalog.registry import Query
from urlrisk.llm import decontaminate, language_id, mixture, near_dedup, shards
from urlrisk.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was recognised.

    Goes: a null text and a text without a letter.  A missing ``lang`` gets the
    recognised language; a given one stays.  Without any labelled row no language
    can be recognised; then all rows with a letter stay as they are.
    """
    rows = language_id.learned(docs)
    docs = docs.select(*COLUMNS)
    if not rows:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs, rows, pred="__pred", score="__score")
    return found.where(F.col("__pred") != language_id.UNKNOWN).withColumn("lang", F.coalesce("lang", "__pred")).select(*COLUMNS)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest doc_id; rows without doc_id or text stay."""
    return near_dedup.kept(docs.select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover less than half of every item of ``benchmark``."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in whole documents: a row stands as often as its words are taken, so some stand twice or not at all."""
    return mixture.whole_documents(docs.select(*COLUMNS))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row: doc_id, size, text_crc32, shard, slot."""
    return shards.assign(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", languages), ("near_dedup", deduplicated), ("decontamination", decontaminated), ("mixture", mixed), ("shards", sharded)]
#: Profiles, sketches, tiling and heaps have no SQL form together; every stage is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERY = Query(run, ORACLE_SQL)
