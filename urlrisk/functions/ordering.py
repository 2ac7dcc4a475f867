"""Ranks and running totals over whole tables without one big ordered task.

A window without a partition sends a table through one task.  Here rows are dealt by
ranges of their order, whose bounds Spark draws from the data, and sorted inside their
range; equal rows go on by a hash of the row, so that a value which most rows share
is cut as well.  The sorted rows are written once with the number of their range and
their place in it.  Ranges are few, so running totals over them are one small task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType

from ..session import new_folder

#: Bits of ``monotonically_increasing_id`` for the place inside a partition.
PLACE_BITS = 33

def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal keys, where null equals null: no row without a time, label or score is lost."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(other, reduce(lambda a, b: a & b, same)).drop(*[f"_r_{k}" for k in keys])


def in_ranges(df: DataFrame, order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """The rows, stored in order: range ``_range`` (ascending) and ``_place`` in it (from 0).

    Rows that are equal in ``order`` go on by a hash of the whole row and, if they are
    equal in all columns, in any order.
    """
    keyed = df.withColumns({"_tie": F.xxhash64(*df.columns), "_any": F.rand(7)})
    keys = [*order, F.col("_tie"), F.col("_any")]
    dealt = keyed.repartitionByRange(partitions, *keys) if partitions else keyed.repartitionByRange(*keys)
    at = F.monotonically_increasing_id()
    rows = dealt.sortWithinPartitions(*keys).drop("_tie", "_any").withColumn("_at", at)
    path = new_folder(df.sparkSession, "ranges")
    rows.write.parquet(path)
    stored = df.sparkSession.read.schema(rows.schema).parquet(path)
    return stored.withColumns({"_range": F.shiftright("_at", PLACE_BITS).cast("int"), "_place": F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))}).drop("_at")


def before_ranges(ranged: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Per range the sums over all ranges before it: ``_range`` and ``before_<value>``; one row for each range."""
    sums = ranged.groupBy("_range").agg(*[F.sum(v).alias(k) for k, v in values.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_range", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"before_{k}") for k in values])


def row_numbers(df: DataFrame, order: Sequence[Column], name: str, partitions: int | None = None) -> DataFrame:
    """Number all rows (from 1) in an order; as many rows out as in."""
    ranged = in_ranges(df, order, partitions)
    offsets = before_ranges(ranged, {"rows": F.lit(1)})
    return ranged.join(offsets, "_range").withColumn(name, F.col("before_rows") + F.col("_place") + 1).drop("_range", "_place", "before_rows")


def running_sums(df: DataFrame, order: Sequence[Column], values: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Running sums ``cum_<value>`` over all rows in an order."""
    ranged = in_ranges(df, order, partitions)
    offsets = before_ranges(ranged, {v: F.col(v) for v in values})
    upto = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.withColumns({f"_in_{v}": F.sum(v).over(upto) for v in values})
    return (inside.join(offsets, "_range").withColumns({f"cum_{v}": F.col(f"before_{v}") + F.col(f"_in_{v}") for v in values})
            .drop("_range", "_place", *[f"_in_{v}" for v in values], *[f"before_{v}" for v in values]))


def cut_keys(df: DataFrame, group: str, key: str, cuts: DataFrame, digits: int = 3) -> list[tuple[object, int, str]]:
    """The hash key at each rank of ``cuts``, per group: (group, rank, key).

    One histogram of leading digits finds the bucket of a rank, one of further
    digits refines that bucket only, and what is left, about one row in sixteen
    million, is ordered.  A few rows per group come back.
    """
    first, second = F.substring(key, 1, digits).alias("_d0"), F.substring(key, 1 + digits, digits).alias("_d1")
    wanted = cuts.select(F.col(group), F.explode("cuts").alias("_rank")).distinct().withColumn("_left", F.col("_rank"))

    def bucket_of(counts: DataFrame, above: list[str], level: str, wanted: DataFrame) -> DataFrame:
        """The bucket that holds each wanted rank, and the rank inside it."""
        w = Window.partitionBy(group, *above).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(w), F.lit(0)))
        hit = null_safe_join(placed, wanted, [group, *above])
        return (hit.where((F.col("_before") < F.col("_left")) & (F.col("_left") <= F.col("_before") + F.col("_rows")))
                .select(group, *above, level, "_rank", (F.col("_left") - F.col("_before")).alias("_left")))

    coarse = bucket_of(df.groupBy(group, first).agg(F.count("*").alias("_rows")), [], "_d0", wanted)
    inside = null_safe_join(df.select(group, F.col(key).alias("_key"), first, second), coarse.select(group, "_d0").distinct(), [group, "_d0"])
    fine = bucket_of(inside.groupBy(group, "_d0", "_d1").agg(F.count("*").alias("_rows")), ["_d0"], "_d1", coarse)
    last = null_safe_join(inside, fine.select(group, "_d0", "_d1").distinct(), [group, "_d0", "_d1"])
    order = Window.partitionBy(group, "_d0", "_d1").orderBy("_key")
    ranked = null_safe_join(last.withColumn("_no", F.row_number().over(order)), fine, [group, "_d0", "_d1"])
    return [(r[group], r["_rank"], r["_key"]) for r in ranked.where("_no = _left").select(group, "_rank", "_key").collect()]


def hash_zones(df: DataFrame, group: str, key: str, cuts: Callable[[dict], dict], name: str = "zone", digits: int = 3, most_groups: int = 1000) -> DataFrame:
    """Cut each group at exact ranks of a hash key: ``name`` is how many cuts lie before the row.

    ``key`` is a hexadecimal hash that is unique in its group (class labels,
    ``most_groups`` at most; null is a class); ``cuts`` turns the rows of each group
    into its ranks (a few per group).  The rows are stored once and counted there; then
    the keys at the cuts are looked up and rows compare their own key with them, without
    a join.
    """
    path = new_folder(df.sparkSession, "zones")
    df.write.parquet(path)
    df = df.sparkSession.read.schema(df.schema).parquet(path)
    counted = df.groupBy(group).agg(F.count("*").alias("n")).limit(most_groups + 1).collect()
    if len(counted) > most_groups:
        raise ValueError(f"more than {most_groups} groups in {group}")
    ranks = cuts({r[group]: r["n"] for r in counted})
    wanted = df.sparkSession.createDataFrame([(g, list(cut)) for g, cut in ranks.items()], df.select(group).schema.add("cuts", ArrayType(LongType())))
    at = {(g, rank): found for g, rank, found in cut_keys(df, group, key, wanted, digits)} if ranks else {}
    zone = F.lit(0)
    for value, cut in ranks.items():
        # A cut at 0 lies before all rows, one behind the last row before none.
        keys = [at.get((value, rank), "" if rank <= 0 else "\uffff") for rank in cut]
        passed = reduce(lambda a, b: a + b, [(F.col(key) > k).cast("int") for k in keys])
        zone = F.when(F.col(group).eqNullSafe(F.lit(value)), passed).otherwise(zone)
    return df.withColumn(name, zone)
