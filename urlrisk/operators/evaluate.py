"""Evaluation jobs: confusion counts, metrics, curves, areas.

Curves start from totals per distinct score, so ties are one point and the rows
are aggregated before any ordering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ordering import running_sums


def label_scores(labels: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Labels with their scores; rows without a partner are left out."""
    return labels.join(scores, key, "inner")


def confusion(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    yes, one = F.col("score") >= threshold, F.col("label") == 1
    return df.agg(F.count_if(~yes & ~one).alias("tn"), F.count_if(yes & ~one).alias("fp"),
                  F.count_if(~yes & one).alias("fn"), F.count_if(yes & one).alias("tp"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from confusion counts; 0 where undefined."""
    return counts.select(*_metric_columns())


def _metric_columns() -> list[Column]:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return [_ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"),
            _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def class_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    one = lambda name, hit, extra, missed: F.struct(
        F.lit(name).alias("class"), _ratio(hit, hit + extra).alias("precision"), _ratio(hit, hit + missed).alias("recall"),
        _ratio(2 * hit, 2 * hit + extra + missed).alias("f1"), (hit + missed).alias("support"))
    pair = counts.select(one("legitimate", tn, fn, fp).alias("a"), one("phishing", tp, fp, fn).alias("b"))
    both = F.col("a.support") + F.col("b.support")
    mean = lambda m: ((F.col(f"a.{m}") + F.col(f"b.{m}")) / 2.0).alias(m)
    weighted = lambda m: _ratio(F.col(f"a.{m}") * F.col("a.support") + F.col(f"b.{m}") * F.col("b.support"), both).alias(m)
    names = ("precision", "recall", "f1")
    averages = [F.struct(F.lit("macro avg").alias("class"), *[mean(m) for m in names], both.alias("support")),
                F.struct(F.lit("weighted avg").alias("class"), *[weighted(m) for m in names], both.alias("support"))]
    return pair.select(F.explode(F.array("a", "b", *averages)).alias("r")).select("r.*")


def score_totals(df: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))


def cumulative(df: DataFrame) -> DataFrame:
    """Per distinct score, from the highest: its positives and negatives, and the
    true and false positives when it is the threshold.  ``P`` and ``N`` are the class sizes."""
    out = running_sums(score_totals(df), [F.col("score").desc()], ["pos", "neg"])
    # Doubles: products of class sizes can exceed a 64-bit integer.
    as_double = lambda c: F.col(c).cast("double")
    return out.select("score", as_double("pos").alias("pos"), as_double("neg").alias("neg"), as_double("cum_pos").alias("tp"),
                      as_double("cum_neg").alias("fp"), out.agg(F.sum("pos").cast("double")).scalar().alias("P"),
                      out.agg(F.sum("neg").cast("double")).scalar().alias("N"))


def roc_points(df: DataFrame) -> DataFrame:
    """ROC points (threshold, false and true positive rate), one per distinct score."""
    return cumulative(df).select("score", _ratio(F.col("fp"), F.col("N")).alias("fpr"), _ratio(F.col("tp"), F.col("P")).alias("tpr"))


def roc_auc(df: DataFrame) -> DataFrame:
    """Area under the ROC curve, ties by the trapezoid rule.

    Each score adds its negatives times the positives above it plus half of its
    own positives, so the sum needs no neighbour rows.
    """
    area = F.sum(F.col("neg") * ((F.col("tp") - F.col("pos")) + F.col("pos") / 2.0))
    return cumulative(df).agg(_ratio(area, F.max("P") * F.max("N")).alias("rocAuc"))


def pr_points(df: DataFrame) -> DataFrame:
    """Precision and recall at each distinct score."""
    return cumulative(df).select("score", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                                 _ratio(F.col("tp"), F.col("P")).alias("recall"))


def pr_auc(df: DataFrame) -> DataFrame:
    """Area under the precision-recall curve by trapezoids, from recall 0 with precision 1.

    The point before a score follows from the running sums and the score's own totals.
    """
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    before = F.when(tp0 + fp0 == 0, 1.0).otherwise(_ratio(tp0, tp0 + fp0))
    now = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    step = _ratio(F.col("pos"), F.col("P"))
    return cumulative(df).agg(F.coalesce(F.sum(step * (before + now) / 2.0), F.lit(0.0)).alias("prAuc"))


def evaluation_report(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: counts, metrics and areas."""
    return confusion(df, threshold).select("*", *_metric_columns(), roc_auc(df).scalar().alias("rocAuc"),
                                           pr_auc(df).scalar().alias("prAuc"))


def importance_rank(importances: DataFrame, group_of: dict[str, str] | None = None) -> DataFrame:
    """Features by falling importance with their rank (one row per feature)."""
    out = importances.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))
    if group_of is None:
        from ..rules import OSINT_FEATURES
        return out.withColumn("group", F.when(F.col("feature").isin(*OSINT_FEATURES), "OSINT").otherwise("URL"))
    table = F.create_map(*[F.lit(x) for pair in group_of.items() for x in pair])
    return out.withColumn("group", F.coalesce(F.try_element_at(table, F.col("feature")), F.lit("URL")))


def metric_deltas(metric_rows: DataFrame, base: str, other: str) -> DataFrame:
    """Difference of two runs (run, metric, value) per metric."""
    pick = lambda run: F.max(F.when(F.col("run") == run, F.col("value")))
    return metric_rows.groupBy("metric").agg((pick(other) - pick(base)).alias("delta"))
