"""Explanation jobs over attributions (row, feature, contribution)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import rules


def to_long(wide: DataFrame, names: Sequence[str], *keys: str) -> DataFrame:
    """One row per row and feature."""
    items = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("contribution")) for n in names])
    return wide.select(*keys, F.explode(items).alias("i")).select(*keys, "i.*")


def mean_absolute(long: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    return (long.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("meanAbs"))
            .orderBy(F.col("meanAbs").desc(), "feature"))


def signed_mean(long: DataFrame) -> DataFrame:
    return long.groupBy("feature").agg(F.avg("contribution").alias("signedMean"))


def toward_each_class(long: DataFrame, n: int = 5) -> DataFrame:
    """The n features with the highest and the n with the lowest signed mean."""
    means = signed_mean(long)
    top = means.orderBy(F.col("signedMean").desc(), "feature").limit(n).withColumn("direction", F.lit("phishing"))
    low = means.orderBy("signedMean", "feature").limit(n).withColumn("direction", F.lit("legitimate"))
    return top.unionByName(low)


def instability(long: DataFrame) -> DataFrame:
    """Population deviation of the absolute contribution."""
    return long.groupBy("feature").agg(F.stddev_pop(F.abs("contribution")).alias("instability"))


def correlations(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pearson matrix (a, b, r) of a wide attribution table; undefined is 0.

    All moments are one aggregate over the rows; the pairs are made from its one
    row.  Sums of products around a rough centre keep large values accurate.
    """
    centre = wide.agg(*[F.avg(n).alias(n) for n in names]).first()
    x = {n: F.col(n) - F.lit(float(centre[n] or 0.0)) for n in names}
    sums = [F.count("*").alias("n")] + [F.sum(x[n]).alias(f"s_{n}") for n in names]
    sums += [F.sum(x[a] * x[b]).alias(f"p_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    row = wide.agg(*sums)

    def r(a: str, b: str):
        first, second = (a, b) if names.index(a) <= names.index(b) else (b, a)
        cov = F.col(f"p_{first}_{second}") - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("n")
        var = lambda c: F.col(f"p_{c}_{c}") - F.col(f"s_{c}") * F.col(f"s_{c}") / F.col("n")
        root = F.sqrt(F.greatest(var(a), F.lit(0.0)) * F.greatest(var(b), F.lit(0.0)))
        return F.coalesce(F.try_divide(cov, root), F.lit(0.0))

    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(a, b).alias("r")) for a in names for b in names])
    return row.select(F.explode(cells).alias("c")).select("c.*")


def strong_pairs(matrix: DataFrame, bound: float = 0.5) -> DataFrame:
    return matrix.where((F.abs("r") > bound) & (F.col("a") < F.col("b")))


def group_share(long: DataFrame, osint: Sequence[str] = rules.OSINT_FEATURES) -> DataFrame:
    """Share of the enrichment features and of the URL features in the total mean absolute contribution."""
    means = long.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("m"))
    is_osint = F.col("feature").isin(*osint)
    sums = means.agg(F.sum("m").alias("total"), F.sum(F.when(is_osint, F.col("m")).otherwise(0.0)).alias("osint"),
                     F.sum(F.when(is_osint, 0.0).otherwise(F.col("m"))).alias("url"))
    percent = lambda c: F.when(F.col("total") > 0, F.round(F.col(c) * 100.0 / F.col("total"), 2)).otherwise(0.0)
    return sums.select("total", "osint", "url", percent("osint").alias("osintPercent"), percent("url").alias("urlPercent"))
