"""Dataset preparation: constant columns, duplicates, outliers, gaps, balance, split.

Column statistics are one aggregate each; their single row goes back into the
plan as literals.  Row choices (balance, split, order) follow a seeded hash of
the row, so they do not depend on partitions or on re-runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import rules
from ..functions.ordering import hash_zones

LABEL = "label"


def feature_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (LABEL, "row_key", "split")]


def _profile(df: DataFrame, measures: dict) -> dict:
    """One row of aggregates as a dict (its size is the number of columns, not of rows)."""
    return df.agg(*[expr.alias(name) for name, expr in measures.items()]).first().asDict() if measures else {}


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one distinct value (nulls aside)."""
    names = feature_names(df)
    got = _profile(df, {**{f"lo_{n}": F.min(n) for n in names}, **{f"hi_{n}": F.max(n) for n in names}})
    return [n for n in names if got[f"lo_{n}"] == got[f"hi_{n}"]]


def drop_constant(df: DataFrame) -> tuple[DataFrame, list[str]]:
    dropped = constant_columns(df)
    return df.drop(*dropped), dropped


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicates over all columns; unknown equals unknown."""
    return df.dropDuplicates()


def with_row_key(df: DataFrame) -> DataFrame:
    """Hash of the whole row: after de-duplication it names the row."""
    return df.withColumn("row_key", F.md5(F.concat_ws("|", *[
        F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns])))


def clip_bounds(df: DataFrame, z: float = 5.0) -> dict[str, tuple[float, float]]:
    """mean +- z standard deviations of each column that is neither binary nor constant."""
    names = feature_names(df)
    got = _profile(df, {
        **{f"m_{n}": F.avg(n) for n in names}, **{f"s_{n}": F.stddev_samp(n) for n in names},
        **{f"b_{n}": F.bool_and(F.col(n).isin(0, 1)) for n in names}})
    return {n: (got[f"m_{n}"] - z * got[f"s_{n}"], got[f"m_{n}"] + z * got[f"s_{n}"])
            for n in names if got[f"b_{n}"] is False and got[f"s_{n}"]}


def clip(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    cut = lambda n, lo, hi: F.when(F.col(n) < lo, F.lit(lo)).when(F.col(n) > hi, F.lit(hi)).otherwise(F.col(n))
    return df.withColumns({n: cut(n, lo, hi) for n, (lo, hi) in bounds.items()})


def clipped_count(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """How many values lie outside their bounds."""
    outside = sum((F.count_if((F.col(n) < lo) | (F.col(n) > hi)) for n, (lo, hi) in bounds.items()), F.lit(0))
    return df.agg(outside.alias("clipped"))


def exact_medians(df: DataFrame, names: Sequence[str], accuracy: int = 10_000, most: int = 100_000) -> DataFrame:
    """Exact medians (column, median) without sorting the table.

    An approximate percentile has a guaranteed rank error, so two of them bracket the
    two middle values; exact counts say how many values lie below the bracket and in it.
    While a bracket holds more than ``most`` values, the next pass draws a narrower one
    from the values inside, for all columns at once.  What is left is ordered, or is one
    value that repeats.
    """
    slack = 2.0 / accuracy
    total = _profile(df, {n: F.count(n) for n in names})
    # Column -> lowest and highest value of the bracket, values below it, values inside it.
    inside = {n: (None, None, 0, total[n]) for n in names if total[n]}

    def held(n: str) -> Column:
        low, high, _, _ = inside[n]
        return F.col(n).isNotNull() if low is None else F.col(n).between(low, high)

    wide = list(inside)
    while wide:
        wanted = {}
        for n in wide:
            _, _, below, size = inside[n]
            middle = [((total[n] + 1) // 2 - below) / size, (total[n] // 2 + 1 - below) / size]
            shares = [max(0.0, middle[0] - slack), min(1.0, middle[1] + slack)]
            wanted[n] = F.percentile_approx(F.when(held(n), F.col(n)), shares, accuracy)
        drawn = _profile(df, wanted)
        ends = {n: (drawn[n][0], drawn[n][1]) for n in wide}
        counts = _profile(df, {**{f"l_{n}": F.count_if(F.col(n) < low) for n, (low, _) in ends.items()},
                               **{f"i_{n}": F.count_if(F.col(n).between(low, high)) for n, (low, high) in ends.items()}})
        before, still = {n: inside[n][3] for n in wide}, []
        for n, (low, high) in ends.items():
            inside[n] = low, high, counts[f"l_{n}"], counts[f"i_{n}"]
            if most < inside[n][3] < before[n] and low < high:
                still.append(n)
        wide = still
    if not inside:
        return df.sparkSession.createDataFrame([], "column string, median double")
    item = lambda n: F.when(held(n), F.struct(F.lit(n).alias("column"), F.col(n).cast("double").alias("value"),
                                              F.lit(inside[n][2]).alias("below"), F.lit(total[n]).alias("n")))
    values = (df.select(F.explode(F.array(*[item(n) for n in inside])).alias("i"))
              .where(F.col("i").isNotNull()).select("i.*")
              .groupBy("column", "below", "n", "value").agg(F.count("*").alias("k")))
    w = Window.partitionBy("column").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    upto = values.withColumn("upto", F.col("below") + F.sum("k").over(w))
    # Ranks (from 1) of the two middle values.
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    return upto.groupBy("column").agg(
        ((F.min(F.when(F.col("upto") >= low, F.col("value"))) + F.min(F.when(F.col("upto") >= high, F.col("value")))) / 2.0)
        .alias("median"))


def fill_medians(df: DataFrame) -> DataFrame:
    """Median of its column for every unknown feature."""
    names = feature_names(df)
    gaps = _profile(df, {n: F.count_if(F.col(n).isNull()) for n in names})
    wanted = [n for n in names if gaps[n]]
    # One row per column comes back, never data rows.
    medians = {r["column"]: r["median"] for r in exact_medians(df, wanted).collect()} if wanted else {}
    return df.fillna(medians) if medians else df


def _seeded(seed: int) -> Column:
    return F.md5(F.concat(F.col("row_key"), F.lit(f"-{seed}")))


def balance(df: DataFrame, seed: int = 42) -> DataFrame:
    """Cut the larger class to the size of the smaller one, exactly."""
    least = lambda rows: {label: [min(rows.values())] for label in rows}
    keyed = df.withColumn("_h", _seeded(seed))
    return hash_zones(keyed, LABEL, "_h", least, "_zone").where(F.col("_zone") == 0).drop("_zone", "_h")


def shuffled(df: DataFrame, seed: int = 42) -> DataFrame:
    """Rows in hash order (a range-partitioned sort)."""
    return df.orderBy(_seeded(seed))


SPLITS = ("train", "val", "test")


def split(df: DataFrame, seed: int = 42, train: int = 70, val: int = 15) -> DataFrame:
    """Add ``split``: per class, the first ``train`` per cent in hash order, then ``val``, then test."""
    cuts = lambda rows: {label: [n * train // 100, n * (train + val) // 100] for label, n in rows.items()}
    keyed = df.withColumn("_h", _seeded(seed + 1))
    names = F.array(*[F.lit(s) for s in SPLITS])
    return hash_zones(keyed, LABEL, "_h", cuts, "_zone").withColumn(
        "split", F.element_at(names, F.col("_zone") + 1)).drop("_zone", "_h")


def feature_stats(train: DataFrame) -> DataFrame:
    """Mean, sample deviation, minimum, maximum and exact median of each feature."""
    names = feature_names(train)
    parts = [F.struct(F.lit(n).alias("column"), F.avg(n).alias("mean"), F.stddev_samp(n).alias("std"),
                      F.min(n).cast("double").alias("min"), F.max(n).cast("double").alias("max")) for n in names]
    # Aggregates first, then one row is turned into one row per column.
    row = train.agg(*[p.alias(f"s{i}") for i, p in enumerate(parts)])
    long = row.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(names))])).alias("s")).select("s.*")
    return long.join(exact_medians(train, names), "column", "left")


def split_stats(df: DataFrame) -> DataFrame:
    """Rows and classes per split."""
    from .report import class_counts
    return class_counts(df, "split")


def dataset_record(df: DataFrame, dropped: Sequence[str], seed: int = 42) -> DataFrame:
    """Statistics of a split dataset in long form (section, item, value)."""
    text = lambda c: F.col(c).cast("string")
    names = [c for c in feature_names(df)]
    splits = split_stats(df).select(F.explode(F.array(*[
        F.struct(F.lit("splits").alias("section"), F.concat(F.col("split"), F.lit(f".{c}")).alias("item"), text(c).alias("value"))
        for c in ("total", "phishing", "legitimate")])).alias("r")).select("r.*")
    measured = feature_stats(df.where(F.col("split") == "train")).select(F.explode(F.array(*[
        F.struct(F.lit("featureStatistics").alias("section"), F.concat(F.col("column"), F.lit(f".{c}")).alias("item"),
                 text(c).alias("value")) for c in ("mean", "std", "min", "max", "median")])).alias("r")).select("r.*")
    fixed = [("dataset", "featureCount", str(len(names))), ("dataset", "featureNames", ",".join(names)),
             ("dataset", "droppedColumns", ",".join(dropped)), ("dataset", "randomSeed", str(seed)),
             ("dataset", "splitRatios", "0.70,0.15,0.15")]
    head = df.sparkSession.createDataFrame(fixed, "section string, item string, value string")
    return head.unionByName(splits).unionByName(measured)


def augment_legitimate(df: DataFrame, key: str, variants: int = 4, seed: int = 42) -> DataFrame:
    """The table plus variants of its class-0 rows with a path, a query or one more subdomain.

    The choices come from a hash of the row key and the variant number.
    """
    draw = lambda salt: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", F.col(key).cast("string"), "variant", F.lit(f"{seed}-{salt}"))),
                                                  1, 8), 16, 10).cast("bigint"), F.lit(1_000_000))
    pick = lambda items, salt: F.element_at(F.array(*[F.lit(x) for x in items]), (F.pmod(draw(salt), F.lit(len(items))) + 1).cast("int"))
    a, b, c = rules.VARIANT_BOUNDS
    u = draw("kind") / 1_000_000.0
    shape = F.when(u < a, "path").when(u < b, "deep").when(u < c, "query").otherwise("subdomain")
    copies = (df.where(F.col(LABEL) == 0)
              .withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(variants))))
              .withColumns({"_shape": shape, "_common": pick(rules.COMMON_PATHS, "common"),
                            "_deep": pick(rules.DEEP_PATHS, "deep"),
                            "_q": pick(range(len(rules.QUERY_SHAPES)), "query")}))
    deep = F.col("_shape") == "deep"
    path = F.when(deep, F.col("_deep")).otherwise(F.col("_common"))
    depth = F.when(deep, F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).otherwise(1)
    of_query = lambda i: F.element_at(F.array(*[F.lit(q[i]) for q in rules.QUERY_SHAPES]), F.col("_q") + 1)
    extra = (F.length(path) + F.when(F.col("_shape") == "query", of_query(1)).otherwise(0)
             + F.when(F.col("_shape") == "subdomain", rules.SUBDOMAIN_CHARS).otherwise(0))
    kind = lambda n: df.schema[n].dataType
    made = copies.withColumns({
        "urlLength": (F.col("urlLength") + extra).cast(kind("urlLength")),
        "pathDepth": depth.cast(kind("pathDepth")),
        "queryParamCount": F.when(F.col("_shape") == "query", of_query(0)).otherwise(F.col("queryParamCount")).cast(kind("queryParamCount")),
        "subdomainCount": (F.col("subdomainCount") + F.when(F.col("_shape") == "subdomain", 1).otherwise(0)).cast(kind("subdomainCount")),
        "specialCharCount": F.greatest(F.lit(0), F.col("specialCharCount") + depth - 1).cast(kind("specialCharCount")),
    }).drop("_shape", "_common", "_deep", "_q")
    return df.withColumn("variant", F.lit(0)).unionByName(made)


def feature_group(names: Sequence[str], url_only: bool) -> list[str]:
    return [n for n in names if not url_only or n not in rules.OSINT_FEATURES]


def validate(df: DataFrame, names: Sequence[str] = rules.ALL_FEATURES) -> DataFrame:
    """Column count, expected count, whether they agree, and rows."""
    expected = len(names) + 1
    return df.agg(F.lit(len(df.columns)).alias("columns"), F.lit(expected).alias("expected"),
                  F.lit(len(df.columns) == expected).alias("complete"), F.count("*").alias("rows"))


def prepare(df: DataFrame, folder: str, seed: int = 42) -> tuple[DataFrame, list[str]]:
    """All steps in their fixed order; gives the split table and the dropped columns.

    The choice of rows reads its input several times, so the three stages are
    written below ``folder`` (shared by all executors) and read back: no stage is
    computed twice, and a lost executor costs one stage at most.
    """
    spark = df.sparkSession

    def stored(table: DataFrame, name: str) -> DataFrame:
        table.write.mode("errorifexists").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    kept, dropped = drop_constant(df)
    unique = stored(with_row_key(drop_duplicates(kept)), "unique")
    balanced = stored(balance(fill_medians(clip(unique, clip_bounds(unique))), seed), "balanced")
    return stored(split(balanced, seed), "split"), dropped
