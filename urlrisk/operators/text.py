"""Text jobs: phrase hits, attachment and link indicators, tactics, verdict.

All phrase lists are matched in one pass per row.  A phrase must stand between
non-word characters; links, addresses and bare domains are one token each and
hold no phrases.  Counting hits needs no shuffle; only the long form with
positions groups the (few) hits of a text again.
"""

from __future__ import annotations

import itertools
import re
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import rules
from ..functions.staging import computed_once, explode_rows
from ..functions.strings import first_items, present, quote_all, round_half_up
from .urls import step_level

# Word characters.  The plain classes list their characters one by one: the regex
# engine then tests them with one table lookup, which decides the speed here.
WORD = r"[\p{L}\p{N}_]"
_PLAIN_WORD = string.ascii_letters + string.digits + "_"
_NOT_PLAIN_WORD = f"[^{_PLAIN_WORD}]"
_BEFORE_PHRASE = rf"(?<![\p{{L}}\p{{N}}])"

# Text that counts as one token: web addresses, mail addresses, bare domains.  A
# token starts the text or follows a character that none of them may hold.
_LABEL = string.ascii_letters + string.digits + r"\-"
_BEFORE_TOKEN = f"[^{_PLAIN_WORD}.+\\-]"
TOKEN = (rf"https?://\S+"
         rf"|[{_LABEL}_.+]++@[{_LABEL}]++(?:\.[{_LABEL}]++)+"
         rf"|(?:[{_LABEL}]++\.)+[a-z]{{2,}}(?:[/:?#]\S*)?")

COUNTS = tuple(f"n_{x.category}" for x in rules.LEXICONS)


def _alternation(phrases: Sequence[str]) -> str:
    """Longest phrase first, grouped by first letter so that a position is rejected quickly."""
    escape = lambda p: quote_all([p])
    ordered = sorted(set(phrases), key=lambda p: (p[0], -len(p), p))
    groups = []
    for first, members in itertools.groupby(ordered, key=lambda p: p[0]):
        groups.append(escape(first) + "(?:" + "|".join(escape(p[1:]) for p in members) + ")")
    return "|".join(groups)


def _categories_by_phrase(lexicons: Sequence[rules.Lexicon]) -> dict[str, list[str]]:
    """Phrase -> categories, counting a shorter phrase that starts a longer one."""
    fold = lambda x, p: p if x.case_sensitive else p.lower()
    pairs = [(x.category, fold(x, p)) for x in lexicons for p in x.phrases]
    out: dict[str, list[str]] = {}
    for _, phrase in pairs:
        out[phrase] = [c for c, p in pairs if p == phrase or
                       (phrase.startswith(p) and re.match(r"\W", phrase[len(p):]))]
    return out


def _may_hold_token(text: Column) -> Column:
    """Cheap test that spares most texts the token pattern."""
    return text.contains("@") | text.contains("://") | text.rlike(r"\.[A-Za-z0-9\-]")


def masked(text: Column) -> Column:
    """Text after one space, with every token replaced by one filler character."""
    spaced = F.concat(F.lit(" "), text)
    return F.when(_may_hold_token(text), F.regexp_replace(
        spaced, f"({_BEFORE_TOKEN})(?:{TOKEN})", "$1_")).otherwise(spaced)


def masked_in_place(text: Column) -> Column:
    """The same, keeping all positions."""
    spaced = F.concat(F.lit(" "), text)
    pattern = f"(?<={_BEFORE_TOKEN})(?:{TOKEN})"
    tokens = F.regexp_extract_all(spaced, F.lit(pattern), F.lit(0))
    filled = F.array_join(F.transform(F.split(spaced, pattern), lambda p, i: F.concat(
        p, F.repeat(F.lit("_"), F.coalesce(F.length(F.get(tokens, i)), F.lit(0))))), "")
    return F.when(_may_hold_token(text), filled).otherwise(spaced)


def _phrase_pattern(lexicons: Sequence[rules.Lexicon]) -> str:
    folded = _alternation([p.lower() for x in lexicons if not x.case_sensitive for p in x.phrases])
    exact = _alternation([p for x in lexicons if x.case_sensitive for p in x.phrases])
    parts = [p for p in (f"(?i:{folded})" if folded else "", exact) if p]
    return rf"(?:{'|'.join(parts)})(?!{WORD})"


def _count_in(array: str, words: Sequence[str]) -> Column:
    return F.size(F.filter(array, lambda item: item.isin(*words)))


def add_phrase_counts(df: DataFrame, text: str, lexicons: Sequence[rules.Lexicon] = rules.LEXICONS) -> DataFrame:
    """Add one count column ``n_<category>`` per lexicon."""
    folded = [x for x in lexicons if not x.case_sensitive]
    exact = [x for x in lexicons if x.case_sensitive]

    def found(source: Column, some: Sequence[rules.Lexicon], fold: bool) -> Column:
        phrases = [p.lower() if fold else p for x in some for p in x.phrases]
        # Only the character before a phrase is consumed, so overlapping phrases are all found.
        firsts = "".join(sorted({p[0] for p in phrases}))
        pattern = (rf"{_NOT_PLAIN_WORD}(?=[{firsts}]){_BEFORE_PHRASE}"
                   rf"(?=({_alternation(phrases)})(?!{WORD}))")
        return F.regexp_extract_all(source, F.lit(pattern), F.lit(1))

    empty = F.array().cast("array<string>")
    staged = df.withColumn("_masked", masked(F.coalesce(F.col(text), F.lit("")))).withColumns({
        "_folded": found(F.lower("_masked"), folded, True) if folded else empty,
        "_exact": found(F.col("_masked"), exact, False) if exact else empty,
    }).drop("_masked")
    staged = computed_once(staged, "_folded", "_exact")
    out = {}
    for some, source in ((folded, "_folded"), (exact, "_exact")):
        by_phrase = _categories_by_phrase(some)
        for x in some:
            mine = [p for p, cats in by_phrase.items() if x.category in cats]
            # A phrase counts once per matching phrase of the category (longer ones may hold shorter ones).
            out[f"n_{x.category}"] = _count_in(source, mine)
    return staged.withColumns(out).drop("_folded", "_exact")


def phrase_hits(df: DataFrame, text: str, *keys: str, lexicons: Sequence[rules.Lexicon] = rules.LEXICONS) -> DataFrame:
    """Long form: one row per hit with category, evidence, position and severity."""
    pattern = _phrase_pattern(lexicons)
    cut = rf"(?<={_NOT_PLAIN_WORD}){_BEFORE_PHRASE}(?={pattern})"
    # The masked text starts with a space, so the first piece never is a hit.
    pieces = F.split(F.col("_masked"), cut)
    long = (df.select(*keys, masked_in_place(F.coalesce(F.col(text), F.lit(""))).alias("_masked"))
            .select(*keys, pieces.alias("_pieces")).where(F.size("_pieces") > 1))
    long = computed_once(long, "_pieces")
    # A phrase spans at most as many pieces as it has words.
    words = max(len(re.split(r"\W+", p)) for x in lexicons for p in x.phrases)
    longest = max(len(p) for x in lexicons for p in x.phrases) + 1
    # Place and text of each hit come from its own row: no shuffle, and no more of the text than a phrase needs.
    long = computed_once(long.withColumn("_widths", F.transform("_pieces", F.length)), "_pieces", "_widths")
    place = lambda i: F.aggregate(F.slice("_widths", 1, i), F.lit(-1), lambda n, w: n + w)
    items = F.transform("_pieces", lambda p, i: F.when(i > 0, F.struct(
        place(i).alias("position"), F.left(F.array_join(F.slice("_pieces", i + 1, F.lit(words)), ""), F.lit(longest)).alias("ahead"))))
    located = long.select(*keys, F.explode(F.slice(items, 2, F.size("_pieces"))).alias("_i")).select(*keys, "_i.position", "_i.ahead")
    branches = []
    for order, x in enumerate(lexicons):
        one = "" if x.case_sensitive else "(?i)"
        # Several phrases of one list never start at the same place, so one evidence per list is enough.
        own = _alternation([p if x.case_sensitive else p.lower() for p in x.phrases])
        evidence = F.regexp_extract("ahead", rf"^{one}(?:{own})(?!{WORD})", 0)
        branches.append(F.when(evidence != "", F.struct(
            F.lit(order).alias("listNo"), F.lit(x.category).alias("category"), evidence.alias("evidence"),
            F.lit(x.severity).alias("severity"), F.lit(x.tactic).alias("tactic"),
            F.format_string(x.description, evidence).alias("description"))))
    return (explode_rows(located.withColumn("_hits", F.array(*branches)), "_hits", "_h", *keys, "position")
            .select(*keys, "position", "_h.*"))


def add_attachment_flags(df: DataFrame, text: str, active: Column | None = None) -> DataFrame:
    """Add how many suspicious extensions and attachment phrases occur (each counted once)."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    active = F.lit(True) if active is None else active
    staged = df.withColumn("_low", F.when(active, low).otherwise(""))
    hits = lambda words: sum((F.col("_low").contains(w).cast("int") for w in words[1:]),
                             F.col("_low").contains(words[0]).cast("int"))
    return staged.withColumns({"n_attachment_extension": hits(rules.ATTACHMENT_EXTENSIONS),
                               "n_attachment_phrase": hits(rules.ATTACHMENT_PHRASES)}).drop("_low")


def attachment_hits(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Long form of the attachment indicators."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    one = lambda w, sev, desc: F.when(F.col("_low").contains(w), F.struct(
        F.lit("attachment_malware").alias("category"), F.lit(w).alias("evidence"), F.lit(sev).alias("severity"),
        F.lit("attachment_malware").alias("tactic"), F.lit(desc % w).alias("description")))
    items = ([one(w, rules.ATTACHMENT_EXTENSION_SEVERITY, "Suspicious attachment extension detected: '%s'")
              for w in rules.ATTACHMENT_EXTENSIONS]
             + [one(w, rules.ATTACHMENT_PHRASE_SEVERITY, "Attachment action request: '%s'")
                for w in rules.ATTACHMENT_PHRASES])
    staged = df.select(*keys, low.alias("_low"))
    return explode_rows(staged.withColumn("_hits", F.array(*items)), "_hits", "_h", *keys).select(*keys, "_h.*")


def _links(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rules.LINK_PATTERN), F.lit(0))


def _link_host(link: Column) -> Column:
    return F.lower(F.regexp_extract(link, r"^https?://([^/?#]*)", 1))


def _link_has_ip(link: Column) -> Column:
    return link.rlike(rules.LINK_IP_PATTERN)


def _link_has_tld(link: Column) -> Column:
    return _link_host(link).rlike(rf"(?:{quote_all(rules.LINK_TLDS)})$")


def add_link_counts(df: DataFrame, text: str, active: Column | None = None) -> DataFrame:
    """Add how many links hold an address, how many end in a free TLD, and whether one cannot be parsed."""
    active = F.lit(True) if active is None else active
    links = F.when(active, _links(F.coalesce(F.col(text), F.lit("")))).otherwise(F.array().cast("array<string>"))
    staged = computed_once(df.withColumn("_links", links), "_links")
    count = lambda test: F.size(F.filter("_links", test))
    broken = lambda l: _link_host(l).contains("[") != _link_host(l).contains("]")
    return staged.withColumns({"n_link_ip": count(_link_has_ip), "n_link_tld": count(_link_has_tld),
                               "hasBrokenLink": F.exists("_links", broken)}).drop("_links")


def link_hits(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Long form of the link indicators."""
    staged = explode_rows(df.select(*keys, _links(F.coalesce(F.col(text), F.lit(""))).alias("_links")),
                          "_links", "_l", *keys)
    hit = lambda cond, sev, desc: F.when(cond, F.struct(
        F.lit("link_manipulation").alias("category"), F.col("_l").alias("evidence"), F.lit(sev).alias("severity"),
        F.lit("link_manipulation").alias("tactic"), desc.alias("description")))
    items = F.array(
        hit(_link_has_ip(F.col("_l")), rules.LINK_IP_SEVERITY,
            F.lit("URL uses IP address instead of domain name")),
        hit(_link_has_tld(F.col("_l")), rules.LINK_TLD_SEVERITY,
            F.concat(F.lit("URL uses suspicious TLD: "), _link_host(F.col("_l")))))
    return explode_rows(staged.withColumn("_hits", items), "_hits", "_h", *keys).select(*keys, "_h.*")


def indicators(df: DataFrame, text: str, *keys: str, message_type: str | None = None) -> DataFrame:
    """Long form of all indicators; links and attachments only for e-mail and text."""
    message = df if message_type is None else df.where(F.col(message_type).isin("email", "text"))
    n = len(rules.LEXICONS)
    return (phrase_hits(df, text, *keys)
            .unionByName(link_hits(message, text, *keys).withColumn("listNo", F.lit(n)), allowMissingColumns=True)
            .unionByName(attachment_hits(message, text, *keys).withColumn("listNo", F.lit(n + 1)),
                         allowMissingColumns=True))


def top_indicators(hits: DataFrame, *keys: str, n: int = 5) -> DataFrame:
    """The n most severe indicators of each text, earlier lists and places first."""
    order = Window.partitionBy(*keys).orderBy(F.col("severity").desc(), "listNo", "position", "evidence", "description")
    return hits.withColumn("indicatorNo", F.row_number().over(order)).where(F.col("indicatorNo") <= n)


# (count column, severity, tactic) of every indicator kind, in the order indicators are listed.
KINDS = tuple((f"n_{x.category}", x.severity, x.tactic) for x in rules.LEXICONS) + (
    ("n_link_ip", rules.LINK_IP_SEVERITY, "link_manipulation"),
    ("n_link_tld", rules.LINK_TLD_SEVERITY, "link_manipulation"),
    ("n_attachment_extension", rules.ATTACHMENT_EXTENSION_SEVERITY, "attachment_malware"),
    ("n_attachment_phrase", rules.ATTACHMENT_PHRASE_SEVERITY, "attachment_malware"),
)


def add_text_verdict(df: DataFrame, most: int | None = rules.TEXT_REASONS) -> DataFrame:
    """Tactics, confidence, level and reasons (the first ``most``; all for ``None``) from the indicator counts."""
    total = sum((F.col(c) for c, _, _ in KINDS[1:]), F.col(KINDS[0][0]))
    severity = sum((F.col(c) * F.lit(float(s)) for c, s, _ in KINDS[1:]), F.col(KINDS[0][0]) * F.lit(float(KINDS[0][1])))
    high = [F.col(c) for c, s, _ in KINDS if s > 0.7]
    names = sorted({t for _, _, t in KINDS})
    seen = lambda t: sum((F.col(c) for c, _, x in KINDS if x == t), F.lit(0)) > 0
    staged = df.withColumns({
        "indicatorCount": total, "_severity": severity, "highSeverityCount": sum(high[1:], high[0]),
        "tactics": present([F.when(seen(t), t) for t in names]),
    })
    raw = F.least(F.col("_severity") / F.col("indicatorCount")
                  + F.least(F.size("tactics") * F.lit(0.1), F.lit(0.3)), F.lit(1.0))
    reasons = present(
        [F.when(F.array_contains("tactics", t), sentence) for t, sentence in rules.TACTIC_REASONS]
        + [F.when(F.col("highSeverityCount") > 0, F.concat(
            F.lit("Contains "), F.col("highSeverityCount").cast("string"), F.lit(" high-severity indicators")))])
    return (staged
            .withColumn("textConfidence", F.when(F.col("indicatorCount") > 0, round_half_up(raw, 3)).otherwise(0.0))
            .withColumns({
                "textIsPhishing": F.col("textConfidence") >= rules.PHISHING_THRESHOLD,
                "textLevel": step_level(F.col("textConfidence"), rules.LEVELS, rules.LEVEL_BOUNDS),
                "textReasons": first_items(reasons, most),
            })
            .drop("_severity"))


def text_analysis(df: DataFrame, text: str = "content", message_type: str | None = None, most: int | None = rules.TEXT_REASONS) -> DataFrame:
    """Counts, tactics, confidence, level and reasons for each text, in one narrow stage."""
    active = None if message_type is None else F.col(message_type).isin("email", "text")
    out = add_phrase_counts(df, text)
    out = add_attachment_flags(out, text, active)
    return add_text_verdict(add_link_counts(out, text, active), most)
