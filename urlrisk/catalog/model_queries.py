"""Model jobs as registered queries (fits are iterative, so they have no SQL twin)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset as D, evaluate as V, model as M, search as P
from ..session import new_folder
from .dataset_queries import PREPARED, _F, prepared
from .registry import query
from .views import view, with_views

# The most rounds and levels that the search may draw; validation rows end the rounds.
_FULL = {name: high for name, _, high, _ in P.SPACE if name in ("maxIter", "maxDepth")}


def _parts(spark, folder):
    rows, _ = prepared(spark, folder)
    part = lambda name: rows.where(F.col("split") == name).drop("split")
    return part("train"), part("val"), part("test"), D.feature_names(rows)


@query("ml_01_train")
def _train(spark, folder):
    train, val, test, names = _parts(spark, folder)
    model = M.train(train, val, names, **_FULL)
    return V.evaluation_report(M.add_probability(test, model))


@query("ml_02_search")
def _search(spark, folder):
    train, _, _, names = _parts(spark, folder)
    return P.search(train, names, "row_key").select("trial", "meanAuc", "stdAuc")


@query("ml_03_best_trial")
def _best(spark, folder):
    """Reads the trials of ``ml_02_search`` where they are stored already."""
    train, _, _, names = _parts(spark, folder)
    return P.best_trial(P.search(train, names, "row_key")).select("trial", "meanAuc")


@query("ml_04_predict")
def _predict(spark, folder):
    train, val, test, names = _parts(spark, folder)
    return M.predict(test, M.train(train, val, names, **_FULL)).select("row_key", "score", "prediction")


@query("eva_07_importances")
def _importances(spark, folder):
    train, val, _, names = _parts(spark, folder)
    return M.importances(train, M.train(train, val, names, **_FULL))


@query("eva_08_ablation")
def _ablation(spark, folder):
    train, val, test, names = _parts(spark, folder)
    return M.ablation(train, val, test, names, "row_key", **_FULL)


@query("eva_08_metric_deltas", with_views("""
  WITH m AS (SELECT CASE WHEN l_linenumber <= 3 THEN 'urlOnly' ELSE 'urlPlusOsint' END AS run, avg(CAST((score >= 0.5) = (label = 1) AS INT)) AS accuracy, avg(score) AS mean
    FROM v_scored GROUP BY 1)
  SELECT 'accuracy' AS metric, round((SELECT accuracy FROM m WHERE run = 'urlPlusOsint') - (SELECT accuracy FROM m WHERE run = 'urlOnly'), 6) AS delta
  UNION ALL SELECT 'mean', round((SELECT mean FROM m WHERE run = 'urlPlusOsint') - (SELECT mean FROM m WHERE run = 'urlOnly'), 6)""", "v_scored"))
def _deltas(spark, folder):
    rows = view(spark, folder, "v_scored").withColumn("run", F.when(F.col("l_linenumber") <= 3, "urlOnly").otherwise("urlPlusOsint"))
    means = rows.groupBy("run").agg(F.avg(((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("int")).alias("accuracy"), F.avg("score").alias("mean"))
    long = means.select(F.explode(F.array(*[F.struct("run", F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("accuracy", "mean")])).alias("r")).select("r.*")
    return V.metric_deltas(long, "urlOnly", "urlPlusOsint").withColumn("delta", F.round("delta", 6))


@query("exp_01_contributions")
def _contributions(spark, folder):
    train, val, test, names = _parts(spark, folder)
    model = M.train(train, val, names, **_FULL)
    # One row of column means.
    means = train.agg(*[F.avg(n).alias(n) for n in names]).first().asDict()
    return M.contributions(test, model, means, "row_key")


@query("snk_07_model")
def _save(spark, folder):
    train, val, test, names = _parts(spark, folder)
    model = M.train(train, val, names, **_FULL)
    path, meta = new_folder(spark, "snk07"), new_folder(spark, "snk07-meta")
    M.save(model, path, M.importances(train, model), meta)
    return M.predict(test, M.load(path)).groupBy("prediction").agg(F.count("*").alias("n"))


@query("snk_07_artefacts", with_views(f"""WITH {PREPARED} SELECT 'rows with equal scores' AS part, count(*) AS n FROM sp WHERE split = 'test'
   UNION ALL SELECT 'trials', 50 UNION ALL SELECT 'features', {len(_F)}""", "v_feat"))
def _artefacts(spark, folder):
    """Model, metadata and trial history written as one set; the set read back."""
    train, val, test, names = _parts(spark, folder)
    model, trials, root = M.train(train, val, names, **_FULL), P.search(train, names, "row_key"), new_folder(spark, "snk07-set")
    M.save_set(model, root, metadata=M.importances(train, model), trials=trials)
    loaded, tables = M.load_set(spark, root, ["metadata", "trials"])
    own = M.predict(test, model).select("row_key", F.col("score").alias("own"))
    equal = M.predict(test, loaded).join(own, "row_key").agg(F.lit("rows with equal scores").alias("part"), F.count_if(F.col("score") == F.col("own")).alias("n"))
    count = lambda name, label: tables[name].agg(F.lit(label).alias("part"), F.count("*").alias("n"))
    return equal.unionByName(count("trials", "trials")).unionByName(count("metadata", "features"))


@query("ml_02_trials_in_range", with_views("SELECT i::INT AS trial, true AS \"inRange\", 5 AS folds FROM range(50) t(i) WHERE (SELECT count(*) FROM v_feat) > 0", "v_feat"))
def _trials_in_range(spark, folder):
    """Every trial of the stored search: parameters within their ranges, an area between 0 and 1, and all its folds."""
    train, _, _, names = _parts(spark, folder)
    value = lambda name: F.col("params")[name]
    inside = F.col("meanAuc").between(0, 1)
    for name, low, high, _ in P.SPACE:
        inside = inside & value(name).between(low * (1 - 1e-9), high * (1 + 1e-9))
    return P.search(train, names, "row_key").select("trial", inside.alias("inRange"), F.size("rounds").alias("folds"))


@query("ml_04_predict_checked", with_views(f"""WITH {PREPARED} SELECT row_key, true AS "inRange", true AS agrees FROM sp WHERE split = 'test'""", "v_feat"))
def _predict_checked(spark, folder):
    """One prediction for every row of the test split, with a probability and the class that goes with it."""
    train, val, test, names = _parts(spark, folder)
    rows = M.predict(test, M.train(train, val, names, **_FULL))
    return rows.select("row_key", F.col("score").between(0, 1).alias("inRange"), (F.col("prediction") == (F.col("score") >= 0.5).cast("int")).alias("agrees"))


@query("sco_05_model_score")
def _model_score(spark, folder):
    """URL scores where a fitted model replaces the weighted blend."""
    from ..plans.scoring import score_urls
    from .. import rules
    urls = view(spark, folder, "v_url").withColumnRenamed("page_id", "url_id")
    labelled = score_urls(urls).withColumn("label", (F.col("patternCount") > 1).cast("int"))
    path = new_folder(spark, "sco05")
    labelled.select(*rules.MODEL_FEATURES, "label").write.parquet(path)
    model = M.train(spark.read.parquet(path), None, rules.MODEL_FEATURES)
    return score_urls(urls, model=model).select("url_id", F.round("finalScore", 6).alias("finalScore"), "riskLevel", F.round("confidence", 6).alias("confidence"))


def _vector_sql():
    from .. import rules
    from .url_queries import from_urls
    value = lambda c: f'CAST("{c}" AS DOUBLE)' if c in rules.URL_FEATURES else "NULL::DOUBLE" if c == "domainAgeDays" else "0.0::DOUBLE"
    one = lambda names, label: (f"SELECT page_id AS url_id, '{label}' AS vector, {len(names)} AS width, "
                                + " || ',' || ".join(f"coalesce(CAST(round({value(c)}, 4) AS VARCHAR), '-')" for c in names) + " AS \"values\" FROM feats2")
    return from_urls(" UNION ALL ".join((one(rules.ALL_FEATURES, "all"), one(rules.MODEL_FEATURES, "model"), one(rules.OSINT_FEATURES, "osint"))))


@query("url_10_model_vectors", _vector_sql())
def _vectors(spark, folder):
    """The 29-, 21- and 12-wide vectors of URLs without enrichment."""
    from .. import rules
    from ..operators.urls import as_vector_columns
    from ..plans.scoring import score_urls
    rows = score_urls(view(spark, folder, "v_url").withColumnRenamed("page_id", "url_id"))
    one = lambda names, label: as_vector_columns(rows, names, "url_id").select(
        "url_id", F.lit(label).alias("vector"), F.lit(len(names)).alias("width"),
        F.concat_ws(",", *[F.coalesce(F.round(n, 4).cast("string"), F.lit("-")) for n in names]).alias("values"))
    return (one(rules.ALL_FEATURES, "all").unionByName(one(rules.MODEL_FEATURES, "model"))
            .unionByName(one(rules.OSINT_FEATURES, "osint")))
