"""Shards of near-equal bytes by longest-processing-time scheduling.

Rows with equal texts form a group that stays together.  Groups, the largest
first, go to the shard with the least bytes so far, kept in a heap.  Only groups
of at least 1/4096 of an even share of all bytes times 16 shards (so at most 4096
of them) are scheduled one by one; the others are first tied into 4096 bundles by
the leading digits of their digest, and a bundle is scheduled like a group.  What
reaches the driver is therefore at most 8192 sizes, whatever the input.

Slots number the rows of a shard without gaps: every shard is cut into 4096 cells
by a digest of the row, cells are counted, and rows are numbered inside their
cell only.

Defined cases: a null text counts like an empty one (1 byte of size, checksum 0).
A group larger than an even share makes its shard the largest; nothing is split.
Equal sizes are scheduled in the order of their digests, equal loads go to the
smaller shard.  Repeated rows get slots of their own.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

SHARDS = 16
DIGITS = 3  # hexadecimal: 4096 bundles, and cells of a shard
PARTS = 16 ** DIGITS


def longest_first(sizes: list[tuple[str, int]], shards: int) -> list[tuple[str, int]]:
    """Item and shard of every (item, size), the largest item first to the least loaded shard."""
    heap = [(0, shard) for shard in range(shards)]
    out = []
    for item, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out.append((item, shard))
    return out


def text_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def assign(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot`` of every row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = stored(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_size(text).alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"),
                              F.md5(whole).alias("digest")), "sizes")
    groups = stored(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") * PARTS >= total
    single = groups.where(large).select(F.col("digest").alias("item"), "bytes")
    bundle = groups.where(~large).groupBy(F.substring("digest", 1, DIGITS).alias("item")).agg(F.sum("bytes").alias("bytes"))
    plan = longest_first([(r["item"], r["bytes"]) for r in single.unionByName(bundle).collect()], shards)

    spark = docs.sparkSession
    table = spark.createDataFrame(plan, "item string, shard int")
    own = F.broadcast(table.where(F.length("item") > DIGITS).select(F.col("item").alias("digest"), F.col("shard").alias("own_shard")))
    tied = F.broadcast(table.where(F.length("item") == DIGITS).select(F.col("item").alias("bundle"), F.col("shard").alias("bundle_shard")))
    placed = (rows.withColumn("bundle", F.substring("digest", 1, DIGITS)).join(own, "digest", "left").join(tied, "bundle", "left")
              .select("doc_id", "size", "text_crc32", F.coalesce("own_shard", "bundle_shard").alias("shard"),
                      F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text_crc32").cast("string"))), 1, DIGITS).alias("cell")))
    cells = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # at most 4096 a shard
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    return (placed.withColumn("place", F.row_number().over(inside) - 1).join(F.broadcast(offsets), ["shard", "cell"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("place")).cast("long").alias("slot")))
