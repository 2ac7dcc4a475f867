"""Dataset, evaluation and explanation jobs as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset as D, evaluate as V, explain as X, report
from ..session import new_folder
from ..sources import sinks
from .registry import query
from .views import view, with_views

_F = ("urlLength", "domainLength", "digitRatio", "isHttps", "dnsRecordCount")
_ALL = "urlLength, domainLength, digitRatio, hasEncodedChars, isHttps, dnsRecordCount, label"


def _q(names):
    return ", ".join(f'{n} AS "{n}"' for n in names)


def feats(spark, folder):
    return view(spark, folder, "v_feat")


def unique(spark, folder):
    return D.with_row_key(D.drop_duplicates(D.drop_constant(feats(spark, folder))[0]))


UNIQUE = f"""un AS MATERIALIZED (SELECT *, md5({" || '|' || ".join(f"coalesce(CAST({n} AS VARCHAR), '-')" for n in (*_F, 'label'))}) AS row_key
   FROM (SELECT DISTINCT {", ".join(_F)}, label FROM v_feat))"""
_CLIPPED = ("urlLength", "domainLength", "digitRatio", "dnsRecordCount")
_BOUND = ", ".join(f"avg({n}) - 5 * stddev_samp({n}) AS lo_{n}, avg({n}) + 5 * stddev_samp({n}) AS hi_{n}" for n in _CLIPPED)
_CUT = ", ".join(f"least(greatest({n}, lo_{n}), hi_{n}) AS {n}" if n != "digitRatio" else
                 f"CASE WHEN {n} IS NULL THEN NULL ELSE least(greatest({n}, lo_{n}), hi_{n}) END AS {n}" for n in _CLIPPED)
PREPARED = f"""{UNIQUE}, bd AS (SELECT {_BOUND} FROM un),
  cl AS MATERIALIZED (SELECT un.* REPLACE ({_CUT}) FROM un, bd),
  fi AS MATERIALIZED (SELECT * REPLACE (coalesce(digitRatio, (SELECT median(digitRatio) FROM cl)) AS digitRatio) FROM cl),
  ba AS MATERIALIZED (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(row_key || '-42')) AS r FROM fi)
    WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM fi GROUP BY label))),
  sp AS MATERIALIZED (SELECT * EXCLUDE (r, n), CASE WHEN r <= n * 70 // 100 THEN 'train' WHEN r <= n * 85 // 100 THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(row_key || '-43')) AS r, count(*) OVER (PARTITION BY label) AS n FROM ba))
"""


def prepared(spark, folder):
    return D.prepare(feats(spark, folder), new_folder(spark, "dst"))


@query("set_04_exact_duplicates", with_views(f"SELECT DISTINCT {_q(_ALL.split(', '))} FROM v_feat", "v_feat"))
def _exact_duplicates(spark, folder):
    return D.drop_duplicates(feats(spark, folder))


@query("dst_01_constant_columns", with_views("""SELECT name FROM (
    SELECT 'urlLength' AS name, count(DISTINCT urlLength) AS n FROM v_feat UNION ALL SELECT 'domainLength', count(DISTINCT domainLength) FROM v_feat
    UNION ALL SELECT 'digitRatio', count(DISTINCT digitRatio) FROM v_feat UNION ALL SELECT 'hasEncodedChars', count(DISTINCT hasEncodedChars) FROM v_feat
    UNION ALL SELECT 'isHttps', count(DISTINCT isHttps) FROM v_feat UNION ALL SELECT 'dnsRecordCount', count(DISTINCT dnsRecordCount) FROM v_feat) WHERE n <= 1""", "v_feat"))
def _constant(spark, folder):
    return spark.createDataFrame([(n,) for n in D.constant_columns(feats(spark, folder))], "name string")


@query("dst_02_dedupe", with_views(f"WITH {UNIQUE} SELECT {_q((*_F, 'label'))}, row_key FROM un", "v_feat"))
def _dedupe(spark, folder):
    return unique(spark, folder)


@query("dst_03_clip", with_views(f"WITH {PREPARED} SELECT row_key, " + ", ".join(f'round({n}, 6) AS "{n}"' for n in _CLIPPED) + " FROM cl", "v_feat"))
def _clip(spark, folder):
    rows = unique(spark, folder)
    return D.clip(rows, D.clip_bounds(rows)).select("row_key", *[F.round(n, 6).alias(n) for n in _CLIPPED])


@query("dst_03_clipped_count", with_views(f"""WITH {UNIQUE}, bd AS (SELECT {_BOUND} FROM un)
  SELECT {" + ".join(f"count(*) FILTER (WHERE {n} < lo_{n} OR {n} > hi_{n})" for n in _CLIPPED)} AS clipped FROM un, bd""", "v_feat"))
def _clipped(spark, folder):
    rows = unique(spark, folder)
    return D.clipped_count(rows, D.clip_bounds(rows))


@query("dst_04_fill_medians", with_views(f"WITH {PREPARED} SELECT row_key, round(digitRatio, 6) AS \"digitRatio\" FROM fi", "v_feat"))
def _fill(spark, folder):
    rows = unique(spark, folder)
    return D.fill_medians(D.clip(rows, D.clip_bounds(rows))).select("row_key", F.round("digitRatio", 6).alias("digitRatio"))


@query("dst_05_balance", with_views(f"WITH {PREPARED} SELECT label, row_key FROM ba", "v_feat"))
def _balance(spark, folder):
    return D.balance(unique(spark, folder)).select("label", "row_key")


@query("dst_06_shuffle", with_views(f"WITH {UNIQUE} SELECT row_key, label FROM un ORDER BY md5(row_key || '-42')", "v_feat"))
def _shuffle(spark, folder):
    return D.shuffled(unique(spark, folder)).select("row_key", "label")


@query("dst_07_split", with_views(f"WITH {PREPARED} SELECT row_key, label, split FROM sp", "v_feat"))
def _split(spark, folder):
    return prepared(spark, folder)[0].select("row_key", "label", "split")


@query("dst_08_split_counts", with_views(f"""WITH {PREPARED} SELECT split, count(*) AS total, count(*) FILTER (WHERE label = 1) AS phishing,
   count(*) FILTER (WHERE label = 0) AS legitimate FROM sp GROUP BY split""", "v_feat"))
def _split_counts(spark, folder):
    return D.split_stats(prepared(spark, folder)[0])


_STATS = " UNION ALL ".join(f"SELECT '{n}' AS \"column\", round(avg({n}), 6) AS mean, round(stddev_samp({n}), 6) AS std, round(min({n}), 6) AS min, "
                            f"round(max({n}), 6) AS max, round(median({n}), 6) AS median FROM sp WHERE split = 'train'" for n in _F)


@query("agg_08_feature_stats", with_views(f"WITH {PREPARED} {_STATS}", "v_feat"))
def _feature_stats(spark, folder):
    train = prepared(spark, folder)[0].where("split = 'train'")
    return D.feature_stats(train).select("column", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max", "median")])


@query("agg_08_medians", with_views("SELECT 'urlLength' AS \"column\", median(urlLength) AS median FROM v_feat UNION ALL SELECT 'domainLength', median(domainLength) FROM v_feat "
       "UNION ALL SELECT 'digitRatio', median(digitRatio) FROM v_feat UNION ALL SELECT 'dnsRecordCount', median(dnsRecordCount) FROM v_feat", "v_feat"))
def _medians(spark, folder):
    return D.exact_medians(feats(spark, folder), _CLIPPED)


@query("dst_08_record")
def _record(spark, folder):
    rows, dropped = prepared(spark, folder)
    return D.dataset_record(rows, dropped)


_SRC = ("page_id", "urlLength", "pathDepth", "subdomainCount", "queryParamCount", "specialCharCount", "label")
_DRAW = "(('0x' || substr(md5(page_id || '-variant'), 1, 8))::BIGINT)"


def _draw(salt):
    return f"(CAST('0x' || substr(md5(CAST(page_id AS VARCHAR) || '-' || CAST(variant AS VARCHAR) || '-42-{salt}'), 1, 8) AS BIGINT) % 1000000)"


def _pick(items, salt):
    from .url_queries import _lit
    return "[" + ", ".join(_lit(i) if isinstance(i, str) else str(i) for i in items) + f"][{_draw(salt)} % {len(items)} + 1]"


def _augment_sql():
    from .. import rules
    return f"""
  b AS (SELECT page_id, CAST(length(url) AS INT) AS "urlLength", CAST(page_id % 4 AS INT) AS "pathDepth", CAST(page_id % 3 AS INT) AS "subdomainCount",
      CAST(page_id % 5 AS INT) AS "queryParamCount", CAST(page_id % 2 AS INT) AS "specialCharCount", CAST(page_id % 2 AS INT) AS label FROM v_url),
  c AS (SELECT *, unnest([1, 2, 3, 4]) AS variant FROM b WHERE label = 0),
  k AS (SELECT *, {_draw('kind')} / 1000000.0 AS u, {_pick(rules.COMMON_PATHS, 'common')} AS p1, {_pick(rules.DEEP_PATHS, 'deep')} AS p2, {_pick((0, 1, 2), 'query')} AS q FROM c),
  s AS (SELECT *, CASE WHEN u < 0.3 THEN 'path' WHEN u < 0.55 THEN 'deep' WHEN u < 0.75 THEN 'query' ELSE 'subdomain' END AS shape FROM k),
  t AS (SELECT *, CASE WHEN shape = 'deep' THEN p2 ELSE p1 END AS p, CASE WHEN shape = 'deep' THEN length(p2) - length(replace(p2, '/', '')) ELSE 1 END AS d FROM s)
  SELECT page_id, "urlLength", "pathDepth", "subdomainCount", "queryParamCount", "specialCharCount", label, 0 AS variant FROM b
  UNION ALL SELECT page_id, CAST("urlLength" + length(p) + CASE WHEN shape = 'query' THEN [8, 16, 25][q + 1] WHEN shape = 'subdomain' THEN 4 ELSE 0 END AS INT), CAST(d AS INT),
    CASE WHEN shape = 'subdomain' THEN "subdomainCount" + 1 ELSE "subdomainCount" END, CASE WHEN shape = 'query' THEN q + 1 ELSE "queryParamCount" END,
    CAST(greatest(0, "specialCharCount" + d - 1) AS INT), label, variant FROM t"""


@query("dst_09_augment", with_views("WITH " + _augment_sql().strip(), "v_url"))
def _augment(spark, folder):
    p = F.col("page_id")
    base = view(spark, folder, "v_url").select(
        "page_id", F.length("url").alias("urlLength"), *[(p % m).cast("int").alias(n) for n, m in (
            ("pathDepth", 4), ("subdomainCount", 3), ("queryParamCount", 5), ("specialCharCount", 2), ("label", 2))])
    return D.augment_legitimate(base, "page_id")


@query("dst_10_feature_group", with_views(f"SELECT {_q([n for n in _F if n != 'dnsRecordCount'])}, label FROM v_feat", "v_feat"))
def _feature_group(spark, folder):
    table = feats(spark, folder).drop("hasEncodedChars")
    return table.select(*D.feature_group(D.feature_names(table), url_only=True), "label")


@query("dst_11_validate", with_views("""SELECT 7 AS columns, 7 AS expected, true AS complete, count(*) AS rows FROM v_feat
   UNION ALL SELECT 6, 7, false, count(*) FROM v_feat WHERE label = 1""", "v_feat"))
def _validate(spark, folder):
    """The whole table, and a part of it that lacks a column, next to the list of features."""
    table = feats(spark, folder)
    names = (*_F, "hasEncodedChars")
    return D.validate(table, names).unionByName(D.validate(table.where("label = 1").drop("digitRatio"), names))


@query("snk_03_splits", with_views(f"""WITH {PREPARED} SELECT split, count(*) AS total, count(*) FILTER (WHERE label = 1) AS phishing,
   count(*) FILTER (WHERE label = 0) AS legitimate FROM sp GROUP BY split""", "v_feat"))
def _write_splits(spark, folder):
    rows, dropped = prepared(spark, folder)
    path, stats = new_folder(spark, "snk03"), new_folder(spark, "snk03-stats")
    sinks.write_splits(rows, path, D.split_stats(rows), stats)
    return report.class_counts(spark.read.parquet(path), "split")


# ----------------------------------------------------------------- evaluation
def scored(spark, folder):
    return view(spark, folder, "v_scored").select("label", "score")


CM = """cm AS (SELECT count(*) FILTER (WHERE score < 0.5 AND label = 0) AS tn, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp,
    count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp FROM v_scored)"""
CURVE = """pt AS MATERIALIZED (SELECT score, sum(pos) OVER (ORDER BY score DESC)::DOUBLE AS tp, sum(neg) OVER (ORDER BY score DESC)::DOUBLE AS fp, pos, neg,
    sum(pos) OVER ()::DOUBLE AS p, sum(neg) OVER ()::DOUBLE AS n
  FROM (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM v_scored GROUP BY score))"""


@query("joi_08_labels_scores", "SELECT l.doc_id, l.quality, d.n_chars AS score FROM labels l JOIN documents d USING (doc_id)")
def _label_scores(spark, folder):
    from .views import table
    return V.label_scores(table(spark, folder, "labels").select("doc_id", "quality"),
                          table(spark, folder, "documents").select("doc_id", F.col("n_chars").alias("score")), "doc_id")


@query("eva_01_confusion", with_views(f"WITH {CM} SELECT * FROM cm", "v_scored"))
def _confusion(spark, folder):
    return V.confusion(scored(spark, folder))


@query("eva_02_metrics", with_views(f"""WITH {CM} SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision,
   round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM cm""", "v_scored"))
def _metrics(spark, folder):
    out = V.metrics(V.confusion(scored(spark, folder)))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("eva_03_class_report", with_views(f"""WITH {CM},
  a AS (SELECT 'legitimate' AS c, tn / (tn + fn) AS p, tn / (tn + fp) AS r, 2 * tn / (2 * tn + fn + fp) AS f, tn + fp AS s FROM cm
        UNION ALL SELECT 'phishing', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM cm),
  b AS (SELECT * FROM a UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM a
        UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM a)
  SELECT c AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(s AS BIGINT) AS support FROM b""", "v_scored"))
def _class_report(spark, folder):
    return V.class_report(V.confusion(scored(spark, folder))).select(
        "class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("win_03_cumulative", with_views(f"WITH {CURVE} SELECT score, tp, fp FROM pt", "v_scored"))
def _cumulative(spark, folder):
    return V.cumulative(scored(spark, folder)).select("score", "tp", "fp")


@query("eva_04_roc_points", with_views(f"WITH {CURVE} SELECT score, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM pt", "v_scored"))
def _roc_points(spark, folder):
    return V.roc_points(scored(spark, folder)).select("score", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("eva_05_roc_auc", with_views(f"""WITH {CURVE} SELECT round(sum((fp / n - coalesce(f0, 0)) * (tp / p + coalesce(t0, 0)) / 2), 6) AS "rocAuc"
   FROM (SELECT *, lag(fp / n) OVER (ORDER BY score DESC) AS f0, lag(tp / p) OVER (ORDER BY score DESC) AS t0 FROM pt)""", "v_scored"))
def _roc_auc(spark, folder):
    return V.roc_auc(scored(spark, folder)).select(F.round("rocAuc", 6).alias("rocAuc"))


@query("eva_06_pr_points", with_views(f"WITH {CURVE} SELECT score, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM pt", "v_scored"))
def _pr_points(spark, folder):
    return V.pr_points(scored(spark, folder)).select("score", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("eva_06_pr_auc", with_views(f"""WITH {CURVE} SELECT round(sum((tp / p - coalesce(r0, 0)) * (tp / (tp + fp) + coalesce(p0, 1)) / 2), 6) AS "prAuc"
   FROM (SELECT *, lag(tp / p) OVER (ORDER BY score DESC) AS r0, lag(tp / (tp + fp)) OVER (ORDER BY score DESC) AS p0 FROM pt)""", "v_scored"))
def _pr_auc(spark, folder):
    return V.pr_auc(scored(spark, folder)).select(F.round("prAuc", 6).alias("prAuc"))


@query("agg_07_class_counts", with_views("SELECT count(*) AS total, count(*) FILTER (WHERE label = 1) AS phishing, count(*) FILTER (WHERE label = 0) AS legitimate FROM v_scored", "v_scored"))
def _class_counts(spark, folder):
    return report.class_counts(scored(spark, folder))


@query("snk_04_report", with_views(f"WITH {CM} SELECT * FROM cm", "v_scored"))
def _write_report(spark, folder):
    path = new_folder(spark, "snk04")
    sinks.write_report(V.evaluation_report(scored(spark, folder)), path)
    return spark.read.schema("tn long, fp long, fn long, tp long").json(path)


# ---------------------------------------------------------------- explanation
_A = ("urlLength", "domainLength", "hasValidMx", "dnsRecordCount", "isHttps")
_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
LONG = "lg AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, CAST({n} AS DOUBLE) AS v FROM v_attr" for n in _A) + ")"


def attributions(spark, folder):
    return X.to_long(view(spark, folder, "v_attr"), _A, *_KEY)


@query("exp_02_mean_absolute", with_views(f'WITH {LONG} SELECT feature, round(avg(abs(v)), 6) AS "meanAbs" FROM lg GROUP BY feature', "v_attr"))
def _mean_absolute(spark, folder):
    return X.mean_absolute(attributions(spark, folder)).select("feature", F.round("meanAbs", 6).alias("meanAbs"))


@query("win_02_importance_rank", with_views(f"""WITH {LONG} SELECT feature, round(m, 6) AS importance, CAST(row_number() OVER (ORDER BY m DESC, feature) AS INT) AS rank,
   CASE WHEN feature IN ('hasValidMx', 'dnsRecordCount') THEN 'OSINT' ELSE 'URL' END AS "group" FROM (SELECT feature, avg(abs(v)) AS m FROM lg GROUP BY feature)""", "v_attr"))
def _importance_rank(spark, folder):
    means = X.mean_absolute(attributions(spark, folder)).withColumnRenamed("meanAbs", "importance")
    return V.importance_rank(means).withColumn("importance", F.round("importance", 6))


@query("exp_03_signed_mean", with_views(f'WITH {LONG} SELECT feature, round(avg(v), 6) AS "signedMean" FROM lg GROUP BY feature', "v_attr"))
def _signed_mean(spark, folder):
    return X.signed_mean(attributions(spark, folder)).select("feature", F.round("signedMean", 6).alias("signedMean"))


@query("exp_03_toward_each_class", with_views(f"""WITH {LONG}, m AS (SELECT feature, avg(v) AS s FROM lg GROUP BY feature)
  (SELECT feature, round(s, 6) AS "signedMean", 'phishing' AS direction FROM m ORDER BY s DESC, feature LIMIT 2)
  UNION ALL (SELECT feature, round(s, 6), 'legitimate' FROM m ORDER BY s, feature LIMIT 2)""", "v_attr"))
def _toward(spark, folder):
    return X.toward_each_class(attributions(spark, folder), 2).withColumn("signedMean", F.round("signedMean", 6))


@query("exp_04_instability", with_views(f"WITH {LONG} SELECT feature, round(stddev_pop(abs(v)), 6) AS instability FROM lg GROUP BY feature", "v_attr"))
def _instability(spark, folder):
    return X.instability(attributions(spark, folder)).withColumn("instability", F.round("instability", 6))


_R = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, " + ("max(0.0)" if "isHttps" in (a, b) else "max(1.0)" if a == b else f"round(corr({a}, {b}), 6)")
                        + " AS r FROM v_attr" for a in _A for b in _A)


@query("exp_05_correlations", with_views(_R, "v_attr"))
def _correlations(spark, folder):
    return X.correlations(view(spark, folder, "v_attr"), _A).withColumn("r", F.round("r", 6))


@query("exp_05_strong_pairs", with_views(f"SELECT * FROM ({_R}) WHERE abs(r) > 0.3 AND a < b", "v_attr"))
def _strong_pairs(spark, folder):
    return X.strong_pairs(X.correlations(view(spark, folder, "v_attr"), _A), 0.3).withColumn("r", F.round("r", 6))


@query("exp_06_group_share", with_views(f"""WITH {LONG}, m AS (SELECT feature, avg(abs(v)) AS m FROM lg GROUP BY feature),
  s AS (SELECT sum(m) AS total, sum(m) FILTER (WHERE feature IN ('hasValidMx', 'dnsRecordCount')) AS o, sum(m) FILTER (WHERE feature NOT IN ('hasValidMx', 'dnsRecordCount')) AS u FROM m)
  SELECT round(total, 6) AS total, round(o, 6) AS osint, round(u, 6) AS url, round(o * 100 / total, 2) AS "osintPercent", round(u * 100 / total, 2) AS "urlPercent" FROM s""", "v_attr"))
def _group_share(spark, folder):
    return X.group_share(attributions(spark, folder)).withColumns({c: F.round(c, 6) for c in ("total", "osint", "url")})
