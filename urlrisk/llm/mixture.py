"""Mixing sources to target weights by a low-discrepancy schedule.

* **Targets.**  Sources share all words by weight; none gets more than three
  times its own words, and what it can't use is shared by weight among the rest.
* **Schedule.**  Slot i of the mix is the point ``i * golden ratio mod 1``, mapped
  through the cumulative targets to a source.  Any stretch of slots holds each
  source in its proportion, to within a few slots.  The slots of a source are
  ranked.
* **Blocks.**  The documents of a source, shuffled by a digest, form one stream
  of words that repeats without end.  It is cut into blocks of equal length; the
  slot of rank r takes block r.  A source that is taken n times over gives each of
  its documents n times, give or take the last round.

Points and bounds are whole numbers (31 bits), so that the schedule is the same
everywhere.  Streams are laid out in 4096 cells per source: cells are summed, and
only rows of one cell are put in order together.

Defined cases: null texts and texts without a word have size 0 and nothing of
them is taken.  Rows without a source form the last source.  Rows that repeat a
doc_id are documents of their own.  Without any word nothing is taken and all
targets are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import stored

WEIGHTS = (5, 2, 1)
MOST = 3  # times its size that a source may be taken
BLOCK = 32  # words
DIGITS = 3  # hexadecimal: 4096 cells of a source
POINTS = 1 << 31
GOLDEN = 1327217885  # POINTS / golden ratio, odd
CHUNK = 1 << 16  # slots ranked together
SOURCES = 100_000  # at most; they are weighed on the driver


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[float]:
    """Target of every source: its weight's share, at most ``most`` times its size."""
    order = sorted(range(len(sizes)), key=lambda k: (most * sizes[k] / weights[k], k))
    left, weight, level = sum(sizes), sum(weights), 0.0
    full = set()
    for k in order:
        if left * weights[k] <= most * sizes[k] * weight:
            level = left / weight
            break
        full.add(k)
        left -= most * sizes[k]
        weight -= weights[k]
    return [float(most * sizes[k]) if k in full else level * weights[k] for k in range(len(sizes))]


def bounds(shares: list[float]) -> list[int]:
    """For each source the point that its part of the line ends before."""
    units = [int(s * 1024) for s in shares]
    total, at, out = sum(units), 0, []
    for u in units:
        at += u
        out.append((at << 31) // total if total else 0)
    return out


def schedule(spark: SparkSession, slots: int, ends: list[int]) -> DataFrame:
    """``slot``, ``source_no``, ``rank`` of every slot of the mix, made where it is used.

    Slots are made and ranked in chunks; sums over the chunks before make the
    ranks global.
    """
    line = np.array(ends, np.int64)

    def chunk(number: int) -> tuple[np.ndarray, np.ndarray]:
        slot = np.arange(number * CHUNK, min(slots, (number + 1) * CHUNK), dtype=np.int64)
        return slot, np.searchsorted(line, (slot & (POINTS - 1)) * GOLDEN & (POINTS - 1), side="right")

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for number in batch.column(0).to_pylist():
                no, n = np.unique(chunk(number)[1], return_counts=True)
                yield pa.RecordBatch.from_pydict({"chunk": np.full(len(no), number), "source_no": no.astype(np.int32), "n": n})

    def make(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for number in batch.column(0).to_pylist():
                slot, no = chunk(number)
                order = np.argsort(no, kind="stable")
                ranked = no[order]
                first = np.searchsorted(ranked, ranked)
                rank = np.empty(len(no), np.int64)
                rank[order] = np.arange(len(no)) - first
                yield pa.RecordBatch.from_pydict({"chunk": np.full(len(no), number), "slot": slot, "source_no": no.astype(np.int32), "inside": rank})

    numbers = spark.range(-(-slots // CHUNK))
    counted = numbers.mapInArrow(count, "chunk long, source_no int, n long")
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("chunk", "source_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # Spark takes the slots for as few as the numbers they are made of; without the hint it would broadcast them.
    return (numbers.mapInArrow(make, "chunk long, slot long, source_no int, inside long").join(offsets.hint("shuffle_hash"), ["chunk", "source_no"])
            .select("slot", "source_no", (F.col("offset") + F.col("inside")).alias("rank")))


def _streams(docs: DataFrame, weights: tuple[int, ...], most: int, block: int, size: Column) -> tuple[DataFrame, DataFrame, int, list[int]]:
    """Rows with their place in the stream of their source; the schedule; numbers of it."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").alias("key"), size.alias("size"),
                       F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), size.cast("string"))).alias("order"))
    rows = rows.withColumn("cell", F.substring("order", 1, DIGITS))
    cells = stored(rows.groupBy("key", "cell").agg(F.sum("size").alias("words")), "cells")
    found = cells.groupBy("key").agg(F.sum("words").alias("words")).limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources; mix coarser ones")
    found = sorted(((r["key"], r["words"]) for r in found), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [words for _, words in found]
    shares = targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))], most)
    slots, ends = -(-sum(sizes) // block), bounds(shares)
    made = stored(schedule(spark, slots, ends), "schedule")
    taken = {r["source_no"]: r["n"] * block for r in made.groupBy("source_no").agg((F.max("rank") + 1).alias("n")).collect()}
    sources = F.broadcast(spark.createDataFrame(
        [(k, key, words, share, min(taken.get(k, 0), most * words)) for k, ((key, words), share) in enumerate(zip(found, shares))],
        "source_no int, name string, source_size long, target double, source_taken long"))
    before = Window.partitionBy("source_no").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    numbered = cells.join(sources, F.col("key").eqNullSafe(F.col("name")))
    offsets = numbered.select("source_no", F.col("cell"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source_no", "cell").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (rows.join(sources, F.col("key").eqNullSafe(F.col("name"))).drop("key", "name").join(offsets, ["source_no", "cell"])
              .withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))))
    return placed, made, slots, ends


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, size: Column | None = None) -> DataFrame:
    """``row`` (all columns of ``docs``), ``size``, ``source_size``, ``target``, ``taken`` (words the mix takes of it)."""
    placed, *_ = _streams(docs, weights, most, block, word_count() if size is None else size)
    words, all_, n = F.col("source_size"), F.col("source_taken"), F.col("size")
    rest = F.least(F.greatest(F.expr("source_taken % nullif(source_size, 0)") - F.col("start"), F.lit(0)), n)
    taken = F.when((words > 0) & (n > 0), F.floor(all_ / words) * n + rest).otherwise(0)
    return placed.select("row", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """The mix itself: ``slot``, ``row``, ``begin`` and ``end`` (words of the document) of every piece, to be read by slot and ``at``."""
    placed, made, *_ = _streams(docs, weights, most, block, word_count())
    times = F.sequence(F.lit(0), F.expr("(source_taken - 1 - start) div source_size"))
    copies = (placed.where("size > 0 AND source_taken > start").select("*", F.explode(times).alias("turn"))
              .withColumn("at", F.col("turn") * F.col("source_size") + F.col("start")).withColumn("till", F.least(F.col("at") + F.col("size"), "source_taken")))
    ranks = F.sequence(F.expr(f"at div {block}"), F.expr(f"(till - 1) div {block}"))
    pieces = copies.select("*", F.explode(ranks).alias("rank"))
    return (pieces.join(made, ["source_no", "rank"])
            .select("slot", "at", "row", (F.greatest("at", F.col("rank") * block) - F.col("at")).alias("begin"),
                    (F.least("till", (F.col("rank") + 1) * block) - F.col("at")).alias("end")))


def whole_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix in whole documents: each row as often as its words are taken, rounded; rows without a word stay once."""
    times = F.when(F.col("size") > 0, F.expr("(2 * taken + size) div (2 * size)")).otherwise(1).cast("int")
    return take(docs, **settings).select("row", F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).select("row.*")
