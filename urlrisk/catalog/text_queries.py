"""Text jobs as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..operators import text as T
from .registry import query
from .url_queries import _alt, _lit
from .views import view, with_views

_TOKEN = (r"https?://\S+|[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
          r"|(?:[A-Za-z0-9-]+\.)+[a-z]{2,}(?:[/:?#]\S*)?")


def _phrase_rows() -> str:
    """One branch per lexicon: every phrase cuts the text, the pieces give the positions."""
    out = []
    for number, x in enumerate(rules.LEXICONS):
        phrases = ", ".join(_lit(p if x.case_sensitive else p.lower()) for p in x.phrases)
        source = "masked" if x.case_sensitive else "lower(masked)"
        out.append(f"""SELECT msg_id, content, masked, {source} AS hay, p AS phrase, {number} AS "listNo",
            '{x.category}' AS category, CAST({x.severity} AS DOUBLE) AS severity, '{x.tactic}' AS tactic
            FROM msk, (SELECT unnest([{phrases}]) AS p) q WHERE contains({source}, p)""")
    return " UNION ALL ".join(out)


_START = r"(^|[^A-Za-z0-9_.+-])"
_MASK = _lit(_START + "(?:" + _TOKEN + ")")
_MASK2 = _lit(_START + "(" + _TOKEN + ")")

# Positions come from cutting at each phrase; the neighbours of a hit must not be word characters.
TEXT_HITS = f"""
  msk0 AS (SELECT msg_id, content, string_split_regex(content, {_MASK}) AS cuts, regexp_extract_all(content, {_MASK2}, 0) AS whole,
      regexp_extract_all(content, {_MASK2}, 2) AS token FROM msgs),
  msk AS MATERIALIZED (SELECT msg_id, content, array_to_string(list_transform(cuts, lambda x, i:
      x || coalesce(left(whole[i], length(whole[i]) - length(token[i])), '') || repeat('_', coalesce(length(token[i]), 0))), '') AS masked FROM msk0),
  cand AS ({_phrase_rows()}),
  cut AS (SELECT *, string_split(hay, phrase) AS pieces FROM cand),
  pos AS (SELECT *, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + (i - 1) * length(phrase) AS start
          FROM (SELECT *, unnest(range(1, len(pieces))) AS i FROM cut)),
  thits AS MATERIALIZED (SELECT msg_id, "listNo", category, severity, tactic, CAST(start AS INT) AS position,
      substr(masked, CAST(start AS INT) + 1, length(phrase)) AS evidence FROM pos
    WHERE NOT regexp_matches(substr(' ' || masked, CAST(start AS INT) + 1, 1), '[\\p{{L}}\\p{{N}}_]')
      AND NOT regexp_matches(substr(masked || ' ', CAST(start AS INT) + length(phrase) + 1, 1), '[\\p{{L}}\\p{{N}}_]'))
"""
_WS = "' ' || chr(9) || chr(10) || chr(13)"
MSGS = "msgs AS MATERIALIZED (SELECT * FROM v_msg)"


def _attachment_rows() -> str:
    one = lambda w, sev: (f"SELECT msg_id, '{w}' AS evidence, CAST({sev} AS DOUBLE) AS severity, "
                          f"'attachment_malware' AS tactic FROM active WHERE contains(lower(content), '{w}')")
    return " UNION ALL ".join([one(w, 0.8) for w in rules.ATTACHMENT_EXTENSIONS]
                              + [one(w, 0.65) for w in rules.ATTACHMENT_PHRASES])


# Needs the table ``active``: the messages that are e-mail or text.
OTHER_HITS = f"""
  ahits AS MATERIALIZED ({_attachment_rows()}),
  links AS (SELECT msg_id, unnest(regexp_extract_all(content, 'https?://[!$-_a-z]+')) AS link FROM active),
  lhits AS MATERIALIZED (SELECT msg_id, link AS evidence, 0.75::DOUBLE AS severity, 'link_manipulation' AS tactic FROM links
      WHERE regexp_matches(link, '[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}')
    UNION ALL SELECT msg_id, link, 0.7::DOUBLE, 'link_manipulation' FROM links
      WHERE regexp_matches(lower(regexp_extract(link, '^https?://([^/?#]*)', 1)), '\\.(tk|ml|ga|cf|gq)$'))
"""
ALL_HITS = """
  ihits AS MATERIALIZED (SELECT msg_id, evidence, severity, tactic, "listNo", position FROM thits
    UNION ALL SELECT msg_id, evidence, severity, tactic, 9, NULL FROM lhits
    UNION ALL SELECT msg_id, evidence, severity, tactic, 10, NULL FROM ahits)
"""
_SEVERITIES = sorted({s for _, s, _ in T.KINDS})
# Severities are added per kind (count times severity), in the order of the kinds.
_KIND_SUM = " + ".join(
    [f"(count(*) FILTER (WHERE \"listNo\" = {i})) * {x.severity}::DOUBLE" for i, x in enumerate(rules.LEXICONS)]
    + ["(count(*) FILTER (WHERE \"listNo\" = 9 AND severity = 0.75)) * 0.75::DOUBLE",
       "(count(*) FILTER (WHERE \"listNo\" = 9 AND severity = 0.7)) * 0.7::DOUBLE",
       "(count(*) FILTER (WHERE \"listNo\" = 10 AND severity = 0.8)) * 0.8::DOUBLE",
       "(count(*) FILTER (WHERE \"listNo\" = 10 AND severity = 0.65)) * 0.65::DOUBLE"])
_REASONS = ",\n".join(f"CASE WHEN list_contains(tl, {_lit(t)}) THEN {_lit(s)} END" for t, s in rules.TACTIC_REASONS)
TEXT_VERDICT = f"""
  tagg AS (SELECT msg_id, count(*) AS n, {_KIND_SUM} AS sev, count(*) FILTER (WHERE severity > 0.7) AS high,
      list_sort(list_distinct(list(tactic))) AS tl FROM ihits GROUP BY msg_id),
  tconf AS (SELECT m.msg_id, coalesce(n, 0) AS n, coalesce(high, 0) AS high, coalesce(tl, []::VARCHAR[]) AS tl,
      CASE WHEN n > 0 THEN floor(least(sev / n + least(len(tl) * 0.1::DOUBLE, 0.3::DOUBLE), 1.0::DOUBLE) * 1000 + 0.5) / 1000 ELSE 0.0::DOUBLE END AS conf
    FROM msgs m LEFT JOIN tagg USING (msg_id)),
  tver AS MATERIALIZED (SELECT *, list_filter([{_REASONS},
      CASE WHEN high > 0 THEN 'Contains ' || high || ' high-severity indicators' END], lambda x: x IS NOT NULL)[1:10] AS reasons FROM tconf)
"""
ACTIVE = "active AS (SELECT * FROM msgs)"


def messages(spark, folder):
    return view(spark, folder, "v_msg")


def over_messages(body: str, *parts: str) -> str:
    return with_views("WITH " + ", ".join([MSGS, *parts]) + " " + body, "v_msg")


_FULL = (ACTIVE, TEXT_HITS, OTHER_HITS, ALL_HITS, TEXT_VERDICT)


@query("txt_01_phrase_hits", over_messages(
    'SELECT msg_id, category, evidence, position, severity FROM thits', TEXT_HITS))
def _phrase_hits(spark, folder):
    return T.phrase_hits(messages(spark, folder), "content", "msg_id").select(
        "msg_id", "category", "evidence", "position", "severity")


@query("txt_01_phrase_counts", over_messages(
    "SELECT m.msg_id, " + ", ".join(
        f'count(h.msg_id) FILTER (WHERE category = {_lit(x.category)}) AS "n_{x.category}"' for x in rules.LEXICONS)
    + " FROM msgs m LEFT JOIN thits h USING (msg_id) GROUP BY m.msg_id", TEXT_HITS))
def _phrase_counts(spark, folder):
    return T.add_phrase_counts(messages(spark, folder), "content").select(
        "msg_id", *[F.col(c).cast("bigint").alias(c) for c in T.COUNTS])


@query("txt_02_attachments", over_messages("SELECT msg_id, evidence, severity FROM ahits", ACTIVE, OTHER_HITS))
def _attachments(spark, folder):
    return T.attachment_hits(messages(spark, folder), "content", "msg_id").select("msg_id", "evidence", "severity")


@query("txt_03_links", over_messages("SELECT msg_id, evidence, severity FROM lhits", ACTIVE, OTHER_HITS))
def _link_hits(spark, folder):
    return T.link_hits(messages(spark, folder), "content", "msg_id").select("msg_id", "evidence", "severity")


def _verdicts(spark, folder):
    return T.text_analysis(messages(spark, folder))


@query("txt_04_tactics", over_messages("SELECT msg_id, array_to_string(tl, ',') AS tactics FROM tver", *_FULL))
def _tactics(spark, folder):
    return _verdicts(spark, folder).select("msg_id", F.array_join("tactics", ",").alias("tactics"))


@query("txt_05_confidence", over_messages(
    'SELECT msg_id, n AS "indicatorCount", conf AS "textConfidence" FROM tver', *_FULL))
def _confidence(spark, folder):
    return _verdicts(spark, folder).select(
        "msg_id", F.col("indicatorCount").cast("bigint").alias("indicatorCount"), "textConfidence")


@query("txt_06_text_verdict", over_messages("""
    SELECT conf >= 0.5 AS "textIsPhishing", CASE WHEN conf < 0.3 THEN 'safe' WHEN conf < 0.5 THEN 'suspicious'
       WHEN conf < 0.7 THEN 'dangerous' ELSE 'critical' END AS "textLevel", count(*) AS n FROM tver GROUP BY 1, 2""", *_FULL))
def _text_verdict(spark, folder):
    return _verdicts(spark, folder).groupBy("textIsPhishing", "textLevel").agg(F.count("*").alias("n"))


@query("txt_07_reasons", over_messages("SELECT msg_id, array_to_string(reasons, '|') AS reasons FROM tver", *_FULL))
def _reasons(spark, folder):
    return _verdicts(spark, folder).select("msg_id", F.array_join("textReasons", "|").alias("reasons"))


@query("txt_08_top_indicators", over_messages("""
    SELECT msg_id, evidence, severity, CAST(r AS INT) AS "indicatorNo" FROM (SELECT *, row_number() OVER (
      PARTITION BY msg_id ORDER BY severity DESC, "listNo", position NULLS FIRST, evidence) AS r FROM ihits) WHERE r <= 5""", *_FULL))
def _top_indicators(spark, folder):
    return T.top_indicators(T.indicators(messages(spark, folder), "content", "msg_id"), "msg_id").select(
        "msg_id", "evidence", "severity", "indicatorNo")


@query("txt_09_empty_content", over_messages(
    f"SELECT msg_id, 'Content cannot be empty' AS \"requestError\" FROM msgs WHERE trim(content, {_WS}) = ''"))
def _empty_content(spark, folder):
    from ..operators.content import split_requests
    rejected = split_requests(messages(spark, folder))[1]
    return rejected.where(F.col("content") == "").select("msg_id", "requestError")
