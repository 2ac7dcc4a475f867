"""Model jobs with Spark ML: boosted trees, prediction, ablation, contributions, stored sets of a model and its tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import rules
from ..functions.ordering import hash_zones
from . import evaluate

def _columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Features as doubles, label as double, all other columns as they are."""
    out = df.withColumns({n: F.col(n).cast("double") for n in names})
    return out.withColumn("label", F.col("label").cast("double")) if "label" in df.columns else out


def pipeline(names: Sequence[str], seed: int = 42, **params) -> Pipeline:
    """Median imputation, assembly and boosted trees; unknown values are null, not NaN."""
    filled = [f"_in_{n}" for n in names]
    boost = GBTClassifier(featuresCol="_features", labelCol="label", seed=seed, **params)
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=list(names), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_features"), boost])


def train(train_rows: DataFrame, val_rows: DataFrame | None, names: Sequence[str], tolerance: float = 0.01,
          seed: int = 42, **params) -> PipelineModel:
    """Fit boosted trees; with validation rows boosting stops when they gain no more."""
    if val_rows is None:
        return pipeline(names, seed, **params).fit(_columns(train_rows, names))
    both = train_rows.withColumn("_val", F.lit(False)).unionByName(val_rows.withColumn("_val", F.lit(True)))
    return pipeline(names, seed, validationIndicatorCol="_val", validationTol=tolerance, **params).fit(_columns(both, names))


def add_probability(df: DataFrame, model: PipelineModel, name: str = "score") -> DataFrame:
    """Add the probability of class 1; helper columns are dropped again."""
    names = model.stages[0].getInputCols()
    keep = df.columns
    ready = df.withColumns({f"_raw_{n}": F.col(n) for n in names}).withColumns({n: F.col(n).cast("double") for n in names})
    out = model.transform(ready).withColumn(name, vector_to_array("probability")[1])
    return out.select(*[F.col(f"_raw_{c}").alias(c) if c in names else F.col(c) for c in keep], name)


def predict(df: DataFrame, model: PipelineModel, threshold: float = rules.PHISHING_THRESHOLD) -> DataFrame:
    """Probability and class for each row."""
    return add_probability(df, model).withColumn("prediction", (F.col("score") >= threshold).cast("int"))


def stratified_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` (0..k-1): per class, equal shares in hash order of a unique key."""
    cuts = lambda rows: {label: [n * i // k for i in range(1, k)] for label, n in rows.items()}
    keyed = df.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-fold-{seed}"))))
    return hash_zones(keyed, "label", "_h", cuts, "fold").drop("_h")


def spark_params(params: dict[str, float]) -> dict:
    """What a trial of ``search`` says to Spark's boosted trees; the penalties and the least gain have no counterpart there."""
    return {"maxDepth": int(params["maxDepth"]), "stepSize": float(params["stepSize"]), "maxIter": int(params["maxIter"]),
            "subsamplingRate": float(params["subsamplingRate"]), "featureSubsetStrategy": str(float(params["featureShare"]))}


def importances(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Gain importance per feature, ranked."""
    rows = [(n, float(v)) for n, v in zip(model.stages[0].getInputCols(), model.stages[-1].featureImportances.toArray())]
    return evaluate.importance_rank(df.sparkSession.createDataFrame(rows, "feature string, importance double"))


def ablation(train_rows: DataFrame, val_rows: DataFrame, test_rows: DataFrame, names: Sequence[str], key: str,
             k: int = 5, seed: int = 42, **params) -> DataFrame:
    """Metrics (run, metric, value) of the URL features alone and of all features.

    Early stopping uses the validation rows, in the folds too, never the test rows.  The deviation
    over folds is the population form.
    """
    runs = {"urlOnly": [n for n in names if n not in rules.OSINT_FEATURES], "urlPlusOsint": list(names)}
    folded = stratified_folds(train_rows, key, k, seed)
    out = None
    for run, features in runs.items():
        model = train(train_rows, val_rows, features, seed=seed, **params)
        report = evaluate.evaluation_report(add_probability(test_rows, model))
        scored = None
        for fold in range(k):
            fold_model = train(folded.where(F.col("fold") != fold).drop("fold"), val_rows, features, seed=seed, **params)
            auc = evaluate.roc_auc(add_probability(folded.where(F.col("fold") == fold), fold_model))
            scored = auc if scored is None else scored.unionByName(auc)
        cv = scored.agg(F.avg("rocAuc").alias("cvAucMean"), F.stddev_pop("rocAuc").alias("cvAucStd"))
        measured = ("accuracy", "precision", "recall", "f1", "rocAuc")
        long = lambda df, ms: df.select(F.explode(F.array(*[F.struct(F.lit(run).alias("run"), F.lit(m).alias("metric"),
                                                                     F.col(m).alias("value")) for m in ms])).alias("r")).select("r.*")
        rows = long(report, measured).unionByName(long(cv, ("cvAucMean", "cvAucStd")))
        out = rows if out is None else out.unionByName(rows)
    return out


def contributions(df: DataFrame, model: PipelineModel, baseline: dict[str, float], key: str) -> DataFrame:
    """Per row and feature: score of the row minus its score with the feature at the baseline.

    The row's own score travels with its variants, so nothing is joined or grouped.
    """
    names = model.stages[0].getInputCols()
    own = add_probability(df.select(key, *[F.col(n).cast("double").alias(n) for n in names]), model, "_own")
    variant = lambda f: F.struct(F.lit(f).alias("feature"), *[
        (F.lit(float(baseline[n])) if n == f else F.col(n)).alias(n) for n in names])
    variants = own.select(key, "_own", F.explode(F.array(*[variant(f) for f in names])).alias("v")).select(key, "_own", "v.*")
    return add_probability(variants, model, "_varied").select(
        key, "feature", (F.col("_own") - F.col("_varied")).alias("contribution"))


def save(model: PipelineModel, path: str, metadata: DataFrame, metadata_path: str) -> None:
    """Model, and its metadata or trial history as JSON rows."""
    model.write().save(path)
    metadata.select(F.to_json(F.struct(*metadata.columns)).alias("value")).write.mode("errorifexists").text(metadata_path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


SETS = "attempt string, number int"


def save_set(model: PipelineModel, root: str, **tables: DataFrame) -> int:
    """Model, metadata and trial history (any named tables) as one numbered set.

    All parts are written first; the set is there when its mark is, so a set that was
    written by half cannot be loaded.
    """
    spark = SparkSession.active()
    attempt = uuid.uuid4().hex
    for name, table in tables.items():
        table.write.parquet(f"{root}/parts/{attempt}/{name}")
    model.write().save(f"{root}/parts/{attempt}/model")
    number = 1 + max((r["number"] for r in _sets(spark, root).collect()), default=0)
    spark.createDataFrame([(attempt,)], "attempt string").coalesce(1).write.parquet(f"{root}/sets/number={number}")
    return number


def _sets(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(SETS).parquet(f"{root}/sets")
    except AnalysisException:  # no set yet
        return spark.createDataFrame([], SETS)


def load_set(spark: SparkSession, root: str, names: Sequence[str] = (), number: int | None = None) -> tuple[PipelineModel, dict[str, DataFrame]]:
    """Model and named tables of a set; of the newest where no number is given."""
    sets = {r["number"]: r["attempt"] for r in _sets(spark, root).collect()}
    if not sets or number is not None and number not in sets:
        raise ValueError(f"no set {number if number is not None else ''} below {root}")
    path = f"{root}/parts/{sets[max(sets) if number is None else number]}"
    return PipelineModel.load(f"{path}/model"), {n: spark.read.parquet(f"{path}/{n}") for n in names}
