"""History, batch and dashboard jobs as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H, history_table as HT, report, score as S, urls
from ..session import new_folder
from ..sources import sinks
from .registry import query
from .score_queries import SCO_16, over_verdicts, verdicts
from .text_queries import TEXT_VERDICT, _FULL, over_messages, messages
from .url_queries import HITS, from_urls, analysis
from .views import AS_OF, view, with_views


def _hist(spark, folder):
    return view(spark, folder, "v_hist")


_NEWEST = 'ORDER BY "analyzedAt" DESC, id'
_SHOWN = 'id, content, "threatLevel", round(score, 6) AS score, "analyzedAt"'


def _shown(df):
    return df.select("id", "content", "threatLevel", F.round("score", 6).alias("score"), "analyzedAt")


@query("his_01_append", with_views("""
  SELECT sha256(content || chr(1) || CAST(epoch_us(analyzedAt) AS VARCHAR)) AS id, content, contentType AS "contentType", threatLevel AS "threatLevel",
    round(score, 6) AS score, analyzedAt AS "analyzedAt" FROM v_hist""", "v_hist"))
def _append(spark, folder):
    path = new_folder(spark, "his01")
    rows = _hist(spark, folder).select("content", F.col("contentType").alias("kind"), "threatLevel", F.col("score").alias("confidenceScore"),
                                       "isPhishing", "analyzedAt")
    H.append(H.to_entries(rows), path)
    return spark.read.parquet(path).select("id", "content", "contentType", "threatLevel", F.round("score", 6).alias("score"), "analyzedAt")


@query("his_02_list", with_views(f"SELECT {_SHOWN} FROM v_hist {_NEWEST} LIMIT 25 OFFSET 50", "v_hist"))
def _list(spark, folder):
    return _shown(H.list_newest(_hist(spark, folder), 25, 50))


@query("his_02_total", with_views("SELECT count(*) AS total FROM v_hist", "v_hist"))
def _total(spark, folder):
    return H.total(_hist(spark, folder))


@query("his_03_get", with_views(f"SELECT {_SHOWN} FROM v_hist WHERE id = '77'", "v_hist"))
def _get(spark, folder):
    return _shown(H.get(_hist(spark, folder), "77"))


def _stored(spark, folder):
    """The history as a stored table, appended in two parts."""
    root = new_folder(spark, "history")
    rows = _hist(spark, folder).select("id", "content", "contentType", "threatLevel", "score", "isPhishing", F.col("analyzedAt").cast("timestamp").alias("analyzedAt"),
                                       F.lit("{}").alias("response"), F.to_date("analyzedAt").alias("date"))
    for part in range(2):
        HT.append(rows.where(F.pmod(F.xxhash64("id"), F.lit(2)) == part), root, f"part-{part}")
    return root


@query("his_04_delete", with_views(f"SELECT {_SHOWN} FROM v_hist WHERE id IS DISTINCT FROM '77'", "v_hist"))
def _delete(spark, folder):
    """The stored table read back after the deletion."""
    root = _stored(spark, folder)
    HT.delete_entry(spark, root, "77")
    return _shown(HT.read(spark, root))


@query("his_02_page", with_views(f"SELECT {_SHOWN} FROM v_hist {_NEWEST} LIMIT 40 OFFSET (SELECT count(*) // 2 FROM v_hist)", "v_hist"))
def _page(spark, folder):
    """A page from the middle of the stored table."""
    root = _stored(spark, folder)
    return _shown(HT.page(spark, root, 40, HT.total(spark, root) // 2, fine=100))


@query("his_02_page_after", with_views(f"""SELECT {_SHOWN} FROM (SELECT *, row_number() OVER ({_NEWEST}) AS place FROM v_hist) AS h
   WHERE place > (SELECT place FROM (SELECT id, row_number() OVER ({_NEWEST}) AS place FROM v_hist) AS p WHERE id = '77') {_NEWEST} LIMIT 30""", "v_hist"))
def _page_after(spark, folder):
    """The page after a row that is known by its time and id."""
    rows = HT.read(spark, _stored(spark, folder))
    last = H.get(rows, "77").select("analyzedAt", "id").first()
    return _shown(HT.page_after(rows, 30, last["analyzedAt"], last["id"]))


@query("his_06_expire_stored", with_views(f"SELECT {_SHOWN} FROM v_hist WHERE analyzedAt >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAYS", "v_hist"))
def _expire_stored(spark, folder):
    """The stored table read back after older rows have gone."""
    root = _stored(spark, folder)
    HT.expire(spark, root, 14, AS_OF)
    return _shown(HT.read(spark, root))


@query("his_05_keep_newest", with_views(f"SELECT {_SHOWN} FROM v_hist {_NEWEST} LIMIT 100", "v_hist"))
def _keep(spark, folder):
    return _shown(H.keep_newest(_hist(spark, folder), 100))


@query("his_06_expire", with_views(f"SELECT {_SHOWN} FROM v_hist WHERE analyzedAt >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAYS", "v_hist"))
def _expire(spark, folder):
    return _shown(H.unexpired(_hist(spark, folder), 14, AS_OF))


@query("his_06_pruned_count", with_views(f"""SELECT count(*) - least(count(*) FILTER (WHERE analyzedAt >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAYS), 100)
   AS removed FROM v_hist""", "v_hist"))
def _pruned(spark, folder):
    return H.pruned_count(_hist(spark, folder), 14, 100, AS_OF)


@query("his_07_search", with_views(f"SELECT {_SHOWN} FROM v_hist WHERE contains(lower(content), 'sign') AND threatLevel = 'dangerous'", "v_hist"))
def _search(spark, folder):
    return _shown(H.search(_hist(spark, folder), "SIGN", "dangerous"))


@query("his_08_display", with_views("""SELECT id, CASE WHEN length(content) > 60 THEN substr(content, 1, 57) || '…' ELSE content END AS content FROM v_hist""", "v_hist"))
def _display(spark, folder):
    return _hist(spark, folder).select("id", H.display_text(F.col("content")).alias("content"))


@query("his_09_reason_groups", over_verdicts("""
  SELECT "group", count(*) AS n FROM (SELECT CASE
      WHEN regexp_matches(r, '(?i)urgent|urgency|immediate|act now|hurry') THEN 'urgency'
      WHEN regexp_matches(r, '(?i)brand|impersonat|spoof') THEN 'impersonation'
      WHEN regexp_matches(r, '(?i)credential|password|login|account|verif') THEN 'credential'
      WHEN regexp_matches(r, '(?i)url|link|domain|redirect|suspicious.*tld') THEN 'link'
      WHEN regexp_matches(r, '(?i)osint|whois|dns|reputation|blacklist|age') THEN 'osint' ELSE 'other' END AS "group"
    FROM (SELECT unnest(vr) AS r FROM ver WHERE error IS NULL)) GROUP BY "group" """))
def _reason_groups(spark, folder):
    reasons = verdicts(spark, folder).where("success").select(F.explode_outer("reasons").alias("r")).where("r IS NOT NULL")
    return reasons.groupBy(S.reason_group(F.col("r")).alias("group")).agg(F.count("*").alias("n"))


@query("agg_09_batch_summary", with_views("""
  SELECT count(*) FILTER (WHERE status = 'done' AND threatLevel = 'safe') AS safe, count(*) FILTER (WHERE status = 'done' AND threatLevel = 'suspicious') AS suspicious,
    count(*) FILTER (WHERE status = 'done' AND threatLevel = 'dangerous') AS dangerous, count(*) FILTER (WHERE status = 'done' AND threatLevel = 'critical') AS critical,
    count(*) FILTER (WHERE status = 'error') AS failed, count(*) FILTER (WHERE status IN ('done', 'error')) AS completed, count(*) AS total FROM v_hist""", "v_hist"))
def _batch_summary(spark, folder):
    return report.batch_summary(_hist(spark, folder))


@query("agg_10_dashboard", with_views(f"""
  SELECT count(*) AS total, count(*) FILTER (WHERE threatLevel = 'safe') AS safe, count(*) FILTER (WHERE threatLevel = 'critical') AS critical,
    round(avg(score), 6) AS "avgScore", round(count(*) FILTER (WHERE threatLevel = 'safe') * 100.0 / count(*), 6) AS "safePercent"
  FROM (SELECT * FROM v_hist {_NEWEST} LIMIT 10)""", "v_hist"))
def _dashboard(spark, folder):
    return report.dashboard(_hist(spark, folder)).withColumns({
        "avgScore": F.round("avgScore", 6), "safePercent": F.round("safePercent", 6)})


@query("agg_11_day_labels", with_views("""
  SELECT CAST(analyzedAt AS DATE) AS day, CASE WHEN CAST(analyzedAt AS DATE) = DATE '2024-01-28' THEN 'Today' WHEN CAST(analyzedAt AS DATE) = DATE '2024-01-27' THEN 'Yesterday'
    ELSE strftime(analyzedAt, '%b %-d') END AS label, count(*) AS n, max(analyzedAt) AS newest FROM v_hist GROUP BY 1, 2""", "v_hist"))
def _day_labels(spark, folder):
    return report.by_day_label(_hist(spark, folder), "2024-01-28")


@query("agg_12_score_trend", with_views(f'SELECT "analyzedAt", id, round(score, 6) AS score FROM v_hist {_NEWEST} LIMIT 7', "v_hist"))
def _trend(spark, folder):
    return report.score_trend(_hist(spark, folder)).withColumn("score", F.round("score", 6))


@query("agg_13_hits_per_type", from_urls("SELECT type, count(*) AS n FROM hits GROUP BY type", HITS))
def _hits_per_type(spark, folder):
    return report.hits_per_type(analysis(spark, folder))


@query("agg_13_texts_per_tactic", over_messages(
    "SELECT tactic, count(*) AS n FROM (SELECT unnest(tl) AS tactic FROM tver) GROUP BY tactic", *_FULL))
def _texts_per_tactic(spark, folder):
    from ..operators.text import text_analysis
    return report.texts_per_tactic(text_analysis(messages(spark, folder)))


@query("agg_14_extraction_counters", with_views("""SELECT count(*) FILTER (WHERE page_id % 5 <> 0) AS ok, count(*) FILTER (WHERE page_id % 5 = 0) AS errors,
   true AS "columnsComplete" FROM v_url""", "v_url"))
def _counters(spark, folder):
    rows = urls.url_features(view(spark, folder, "v_url")).withColumn(
        "label", F.when(F.col("page_id") % 5 == 0, "bad").otherwise("1"))
    return report.extraction_counters(rows, urls.rules.URL_FEATURES)


@query("win_01_newest_ordinal", with_views(f'SELECT id, row_number() OVER ({_NEWEST}) AS "rowNo" FROM v_hist', "v_hist"))
def _ordinal(spark, folder):
    return H.number_newest_first(_hist(spark, folder)).select("id", "rowNo")


@query("srt_01_sort", with_views(f"SELECT {_SHOWN} FROM v_hist ORDER BY score DESC, id", "v_hist"))
def _sort(spark, folder):
    return _shown(H.sort_by(_hist(spark, folder), "score", descending=True))


@query("snk_05_history_csv", with_views(f"""SELECT row_number() OVER ({_NEWEST}) AS "#", '"' || replace(content, '"', '""') || '"' AS "Content",
   contentType AS "Type", threatLevel AS "Threat Level", printf('%.1f', score * 100) AS "Score", analyzedAt AS "Date" FROM v_hist""", "v_hist"))
def _history_csv(spark, folder):
    return sinks.history_export(_hist(spark, folder))


@query("snk_05_history_csv_file", with_views(f"""SELECT row_number() OVER ({_NEWEST}) || ',"' || replace(content, '"', '""') || '",' || contentType || ',' || threatLevel || ',' || printf('%.1f', score * 100)
   || ',' || regexp_replace(strftime(analyzedAt, '%Y-%m-%d %H:%M:%S.%f'), '[.]?0+$', '') AS line FROM v_hist""", "v_hist"))
def _history_csv_file(spark, folder):
    """The written file, read back line by line."""
    path = new_folder(spark, "history-csv")
    sinks.write_history_csv(_hist(spark, folder), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("snk_05_history_json", with_views("""SELECT id, content, contentType AS "contentType", threatLevel AS "threatLevel", round(score, 6) AS score, isPhishing AS "isPhishing" FROM v_hist""", "v_hist"))
def _history_json(spark, folder):
    """The whole history as JSON, written and read back."""
    path = new_folder(spark, "history-json")
    sinks.write_history_json(_hist(spark, folder), path)
    schema = "id string, content string, contentType string, threatLevel string, score double, isPhishing boolean"
    return spark.read.schema(schema).json(path).withColumn("score", F.round("score", 6))


@query("snk_06_batch_csv", with_views("""SELECT '"' || replace(content, '"', '""') || '",' || status || ',' || threatLevel || ',' || printf('%.3f', score)
   || ',' || isPhishing || ',' || printf('%.0f', score * 1000) AS line FROM v_hist WHERE status = 'done' AND contains(content, '"')
   UNION ALL SELECT content || ',' || status || ',' || threatLevel || ',' || printf('%.3f', score) || ',' || isPhishing || ',' || printf('%.0f', score * 1000)
   FROM v_hist WHERE status = 'done' AND NOT contains(content, '"')""", "v_hist"))
def _batch_csv(spark, folder):
    """The written file, read back line by line without its headings."""
    path = new_folder(spark, "snk06")
    rows = _hist(spark, folder).withColumns({"url": F.col("content"), "confidenceScore": F.col("score"), "analysisTime": F.col("score") * 1000})
    sinks.write_batch_csv(rows, path)
    return spark.read.text(path).where("NOT startswith(value, 'URL,')").select(F.col("value").alias("line"))


@query("snk_06_batch_json", with_views("""SELECT content AS url, threatLevel AS "threatLevel", round(score, 6) AS "confidenceScore", isPhishing AS "isPhishing",
   threatLevel || '|' || contentType AS reasons FROM v_hist WHERE status = 'done'""", "v_hist"))
def _batch_json(spark, folder):
    path = new_folder(spark, "snk06")
    rows = _hist(spark, folder).withColumns({"url": F.col("content"), "confidenceScore": F.col("score"),
                                             "analysisTime": F.col("score") * 1000, "reasons": F.array("threatLevel", "contentType")})
    sinks.write_batch_json(rows, path)
    table = spark.read.schema("url string, threatLevel string, confidenceScore double, isPhishing boolean, reasons array<string>").json(path)
    return table.withColumns({"confidenceScore": F.round("confidenceScore", 6), "reasons": F.array_join("reasons", "|")})
