"""License scans by ordered signature rules, in DataFrame functions only.

A text becomes its lower-case words, each with a space on both sides, so that a
rule is a regular expression over whole words whatever punctuation stood between
them.  Cheap searches come first: every form has a gate that each of its matches
passes, a text that passes none is never normalised, and a rule is only tried
where the gate of its form is passed and its keyword occurs.  Every match of a
rule is a detection, an interval of the text.  A detection that lies inside
another one is suppressed; of equal intervals the rule that stands first stays.

The rules are made of licenses and forms: every license has an identifier and a
name, both expressions, and five forms say how they occur, the most certain first.

Defined cases: a null text counts as empty: no words, no labels, score 0.  Letters
outside A-Z and all other characters from U+0080 on are parts of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.staging import computed_once

# Base phrases, licenses (label, keywords of which one must occur, identifier, name), forms (certainty, expression).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
_GPL = "(gnu )?(general public licen[cs]e|gpl)"
_LGPL = "(gnu )?((lesser|library) general public licen[cs]e|lgpl)"
_AGPL = "(gnu )?(affero general public licen[cs]e|agpl)"
LICENSES = (
    ("mit", " mit ", "mit", "mit (expat )?licen[cs]e"),
    ("mit-0", " mit ", "mit 0", "mit no attribution( licen[cs]e)?"),
    ("apache-1.0", "apache", "apache 1 0", "apache (software )?licen[cs]e (version 1 0|v1 0|1 0)"),
    ("apache-1.1", "apache", "apache 1 1", "apache (software )?licen[cs]e (version 1 1|v1 1|1 1)"),
    ("apache-2.0", "apache", "apache 2( 0)?", "apache (software )?licen[cs]e (version 2( 0)?|v2( 0)?|2( 0)?)"),
    ("apache", "apache", "apache", "apache (software )?licen[cs]e"),
    ("gpl-1.0", "gpl|general", "gpl 1 0( only| or later)?", _GPL + " (version 1|v1|1 0)( or later)?"),
    ("gpl-2.0", "gpl|general", "gpl 2 0( only| or later)?", "(" + _GPL + " (version 2|v2|2 0|2)|gplv2)( or later| only)?"),
    ("gpl-3.0", "gpl|general", "gpl 3 0( only| or later)?", "(" + _GPL + " (version 3|v3|3 0|3)|gplv3)( or later| only)?"),
    ("gpl", "gpl|general", "gpl", _GPL),
    ("lgpl-2.0", "lgpl|lesser|library", "lgpl 2 0( only| or later)?", "(" + _LGPL + " (version 2|v2|2 0)|lgplv2)( or later| only)?"),
    ("lgpl-2.1", "lgpl|lesser|library", "lgpl 2 1( only| or later)?", _LGPL + " (version 2 1|v2 1|2 1)( or later| only)?"),
    ("lgpl-3.0", "lgpl|lesser|library", "lgpl 3 0( only| or later)?", "(" + _LGPL + " (version 3|v3|3 0)|lgplv3)( or later| only)?"),
    ("lgpl", "lgpl|lesser|library", "lgpl", _LGPL),
    ("agpl-3.0", "agpl|affero", "agpl 3 0( only| or later)?", "(" + _AGPL + " (version 3|v3|3 0)|agplv3)( or later| only)?"),
    ("agpl", "agpl|affero", "agpl", _AGPL),
    ("bsd-2-clause", "bsd", "bsd 2 clause", "((2|two) clause bsd|simplified bsd|freebsd) licen[cs]e"),
    ("bsd-3-clause", "bsd", "bsd 3 clause", "((3|three) clause bsd|(new|revised|modified) bsd) licen[cs]e"),
    ("bsd-4-clause", "bsd", "bsd 4 clause", "((4|four) clause bsd|original bsd) licen[cs]e"),
    ("0bsd", "bsd", "0bsd", "zero clause bsd licen[cs]e|0bsd"),
    ("bsd", "bsd", "bsd", "bsd( style)? licen[cs]e"),
    ("mpl-1.0", " mpl ", "mpl 1 0", "mpl 1 0"),
    ("mpl-1.1", " mpl |mozilla", "mpl 1 1", "mozilla public licen[cs]e (version 1 1|v1 1|1 1)|mpl 1 1"),
    ("mpl-2.0", " mpl |mozilla", "mpl 2 0", "mozilla public licen[cs]e (version 2 0|v2 0|2 0|v 2 0)|mpl 2 0"),
    ("mpl", " mpl |mozilla", "mpl", "mozilla public licen[cs]e"),
    ("epl-1.0", " epl |eclipse", "epl 1 0", "eclipse public licen[cs]e (version 1 0|v1 0|1 0|v 1 0)|epl 1 0"),
    ("epl-2.0", " epl |eclipse", "epl 2 0", "eclipse public licen[cs]e (version 2 0|v2 0|2 0|v 2 0)|epl 2 0"),
    ("eupl-1.1", "eupl|european", "eupl 1 1", "european union public licen[cs]e (version 1 1|v1 1|1 1)|eupl 1 1"),
    ("eupl-1.2", "eupl|european", "eupl 1 2", "european union public licen[cs]e (version 1 2|v1 2|1 2)|eupl 1 2"),
    ("cddl-1.0", "cddl|distribution", "cddl 1 0", "common development and distribution licen[cs]e( version)?( 1 0)?|cddl 1 0"),
    ("cddl-1.1", "cddl|distribution", "cddl 1 1", "common development and distribution licen[cs]e (version )?1 1|cddl 1 1"),
    ("cpl-1.0", " cpl | common ", "cpl 1 0", "common public licen[cs]e( version 1 0| 1 0)?"),
    ("cc0-1.0", "cc0", "cc0 1 0", "cc0( 1 0)?( universal)?"),
    ("isc", " isc ", "isc", "isc licen[cs]e"),
    ("zlib", "zlib", "zlib", "zlib( libpng)? licen[cs]e"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl| want ", "wtfpl", "wtfpl|do what the f[^ ]+ you want to public licen[cs]e"),
    ("artistic-1.0", "artistic", "artistic 1 0", "artistic licen[cs]e( version)? 1 0"),
    ("artistic-2.0", "artistic", "artistic 2 0", "artistic licen[cs]e( version)? 2 0"),
    ("artistic", "artistic", "artistic", "artistic licen[cs]e"),
    ("bsl-1.0", " bsl | boost ", "bsl 1 0", "boost software licen[cs]e( version 1 0| 1 0)?"),
    ("busl-1.1", "busl|business", "busl 1 1", "business source licen[cs]e( version)?( 1 1)?"),
    ("python-2.0", "python", "python 2 0", "python software foundation licen[cs]e( version 2| 2 0)?"),
    ("psf-2.0", " psf ", "psf 2 0", "psf licen[cs]e( agreement)?"),
    ("ruby", " ruby ", "ruby", "ruby licen[cs]e"),
    ("php-3.01", "php", "php 3 01", "php licen[cs]e( version)?( 3 01)?"),
    ("ofl-1.1", " ofl | font ", "ofl 1 1", "sil open font licen[cs]e( version)?( 1 1)?|open font licen[cs]e"),
    ("ncsa", "ncsa", "ncsa", "(university of illinois ncsa|ncsa) open source licen[cs]e"),
    ("postgresql", "postgresql", "postgresql", "postgresql licen[cs]e"),
    ("openssl", "openssl", "openssl", "openssl licen[cs]e"),
    ("ms-pl", " ms |microsoft", "ms pl", "microsoft public licen[cs]e|ms pl"),
    ("ms-rl", " ms |microsoft", "ms rl", "microsoft reciprocal licen[cs]e|ms rl"),
    ("osl-3.0", " osl | software ", "osl 3 0", "open software licen[cs]e( version)?( 3 0)?"),
    ("afl-3.0", " afl |academic", "afl 3 0", "academic free licen[cs]e( version)?( 3 0)?"),
    ("ecl-2.0", " ecl |educational", "ecl 2 0", "educational community licen[cs]e( version)?( 2 0)?"),
    ("cecill-2.1", "cecill", "cecill 2 1", "cecill( free software)?( licen[cs]e)?( agreement)?"),
    ("vim", " vim ", "vim", "vim licen[cs]e"),
    ("tcl", " tcl ", "tcl", "tcl tk licen[cs]e"),
    ("x11", "x11", "x11", "x11 licen[cs]e"),
    ("libpng", "libpng", "libpng", "libpng licen[cs]e"),
    ("ijg", " ijg | jpeg ", "ijg", "independent jpeg group licen[cs]e"),
    ("w3c", "w3c", "w3c", "w3c software( notice and)? licen[cs]e"),
    ("json", " json ", "json", "json licen[cs]e"),
    ("beerware", " beer", "beerware", "beer ?ware licen[cs]e"),
    ("sleepycat", "sleepycat", "sleepycat", "sleepycat licen[cs]e"),
    ("qpl-1.0", " qpl | q ", "qpl 1 0", "q public licen[cs]e( version)?( 1 0)?"),
    ("sspl-1.0", "sspl| server ", "sspl 1 0", "server side public licen[cs]e( version)?( 1)?"),
    ("elastic-2.0", "elastic", "elastic 2 0", "elastic licen[cs]e( 2 0)?"),
    ("odbl-1.0", "odbl|database", "odbl 1 0", "open (data commons open )?database licen[cs]e( v1 0)?|odbl"),
    ("public-domain", "domain", "public domain", "(in|into|to) the public domain"),
    ("proprietary", "rights|proprietary", "proprietary", "all rights reserved"),
)
CC_TERMS = (("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(s|atives)"), ("by-nc", "attribution non ?commercial"),
            ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(s|atives)"))
CC_VERSIONS = ("4.0", "3.0", "2.5", "2.0", "1.0", "")
_VERBS = "(licensed|released|distributed|available|published|provided|offered|covered|governed|redistributed)"
_BY = "(under|by)"
FORMS = (
    (1.0, "spdx licen[cs]e identifier ({id})"),
    (0.95, _VERBS + " " + _BY + " (the )?(terms of )?(the )?({name}|{id})"),
    (0.9, "(opensource|spdx) org licenses? ({id})"),
    (0.9, "licen[cs]e ({id})"),
    (0.7, "({name})"),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text
WORDS = r"[0-9a-z\x{80}-\x{10FFFF}]+"  # all other characters
# Gates, over lower-cased text.  Names need one of these substrings or words.
GATES = ("licen", "spdx", "gpl", "attribution", "proprietary", "creative", "cc0", "wtfpl", "odbl", "cecill", "0bsd", "domain", "reserved", "eupl", "cddl")
GATE_WORDS = f"(?:^|{SEPARATORS})(?:mpl|epl|cc{SEPARATORS}by|ms{SEPARATORS}[pr]l)(?:$|{SEPARATORS})"
# The second form needs its verb; any identifier may follow.
GATE_VERBS = f"{_VERBS}{SEPARATORS}{_BY}{SEPARATORS}"


def creative_commons() -> list[tuple[str, str, str, str]]:
    """All terms in all versions, as licenses."""
    out = []
    for terms, name in CC_TERMS:
        for version in CC_VERSIONS:
            number, words = version.replace(".", " "), terms.replace("-", " ")
            ending = f" (version )?{number}" if version else ""
            out.append((f"cc-{terms}" + (f"-{version}" if version else ""), " cc |creative", f"cc {words}" + (f" {number}" if version else ""),
                        f"(cc {words}{' ' + number if version else ''}|creative commons {name}{ending}( international| unported| generic)?)"))
    return out


def gates(low: Column) -> Column:
    """For every form whether a lower-cased text passes its gate."""
    named = low.rlike(GATE_WORDS)
    for word in GATES:
        named = F.contains(low, F.lit(word)) | named
    licence = F.contains(low, F.lit("licen"))
    # In the order of FORMS.
    return F.array(F.contains(low, F.lit("spdx")), F.rlike(low, F.lit(GATE_VERBS)), licence & F.contains(low, F.lit("org")), licence, named)


def rules() -> list[tuple[int, str, str, float, str]]:
    """All rules in order: place, label, keywords, certainty, expression over spaced words."""
    out = []
    for certainty, form in FORMS:
        for label, keyword, identifier, name in (*LICENSES, *creative_commons()):
            pattern = form.replace("{id}", identifier).replace("{name}", name)
            # A word stands between spaces of its own: two between words, one at both ends.
            pattern = pattern.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(  )?")
            out.append((len(out), label, keyword, certainty, f" ({pattern}) "))
    return out


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rule_groups() -> Column:
    """The rules by keyword, as one constant."""
    groups: dict[str, list[str]] = {}
    for place, label, keyword, certainty, pattern in rules():
        form = place // (len(LICENSES) + len(CC_TERMS) * len(CC_VERSIONS))
        groups.setdefault(keyword, []).append(f"named_struct('place', {place}, 'form', {form}, 'label', {_literal(label)}, 'score', {certainty}D, 'regex', {_literal(pattern)})")
    return F.expr("array(" + ", ".join(f"named_struct('keywords', array({', '.join(map(_literal, k.split('|')))}), 'rules', array({', '.join(r)}))" for k, r in groups.items()) + ")")


def _length(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(p))


def _found(text: Column, rule: Column) -> Column:
    """Detections of a rule: from, to (negative), place, label, score; from and to in characters of the spaced text."""
    # The one-element array names both lists, so that each is made once.
    parts = F.array(F.struct(F.regexp_extract_all(text, rule["regex"], F.lit(0)).alias("hits"), F.split(text, rule["regex"], -1).alias("rest")))
    return F.flatten(F.transform(parts, lambda p: F.transform(p["hits"], lambda hit, i: F.struct(
        (_length(F.slice(p["rest"], 1, i + 1)) + _length(F.slice(p["hits"], 1, i))).alias("from"),
        (-(_length(F.slice(p["rest"], 1, i + 1)) + _length(F.slice(p["hits"], 1, i + 1)))).alias("minus_to"),
        rule["place"].alias("place"), rule["label"].alias("label"), rule["score"].alias("score")))))


def _surviving(found: Column) -> Column:
    """Detections not inside another one: in order of begin, longest first, those that end later than all before."""
    start = F.struct(F.lit(0).alias("till"), F.expr("cast(array() as array<struct<label: string, score: double>>)").alias("kept"))
    step = lambda acc, d: F.when(-d["minus_to"] <= acc["till"], acc).otherwise(
        F.struct((-d["minus_to"]).alias("till"), F.array_union(acc["kept"], F.array(F.struct(d["label"].alias("label"), d["score"].alias("score")))).alias("kept")))
    return F.aggregate(F.array_sort(found), start, step, lambda acc: acc["kept"])


def _word_at(text: Column, characters: Column) -> Column:
    """Number of words before a place of the spaced text."""
    before = F.substring(text, F.lit(1), characters)
    return F.floor((F.length(before) - F.length(F.replace(before, F.lit(" ")))) / 2)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels (array), detections (array of label and score)."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = computed_once(docs.select(F.col(doc_id).alias("doc_id"), low.alias("low")), "low")
    rows = computed_once(rows.select("doc_id", "low", gates(F.col("low")).alias("gates")), "low", "gates")
    spaced = F.regexp_replace("low", SEPARATORS, " ")
    spaced = F.concat(F.lit(" "), F.replace(F.trim(spaced), F.lit(" "), F.lit("  ")), F.lit(" "))
    rows = rows.select("doc_id", F.regexp_count("low", F.lit(WORDS)).cast("long").alias("n_words"),
                       "gates", F.when(F.array_contains("gates", True), spaced).otherwise("").alias("spaced"))
    rows = computed_once(rows, "n_words", "gates", "spaced")

    col = F.col("spaced")
    pieces = [F.split(col, " " + phrase.replace(" ", "  ") + " ", -1).alias(f"p{k}") for k, (phrase, _) in enumerate(BASE)]
    groups = F.filter(_rule_groups(), lambda g: F.exists(g["keywords"], lambda k: F.contains(col, k)))
    tried = lambda g: F.filter(g["rules"], lambda r: F.get("gates", r["form"]))
    found = F.flatten(F.transform(groups, lambda g: F.flatten(F.transform(tried(g), lambda r: _found(col, r)))))
    rows = computed_once(rows.select("doc_id", "n_words", "spaced", *pieces, F.when(col != "", found).alias("found")), "n_words", "spaced", *(f"p{k}" for k in range(len(BASE))), "found")

    counts = [F.size(f"p{k}") - 1 for k in range(len(BASE))]
    firsts = [F.when(n > 0, _word_at(col, F.length(F.col(f"p{k}")[0]))) for k, n in enumerate(counts)]
    lasts = [F.when(n > 0, F.col("n_words") - _word_at(F.element_at(f"p{k}", -1), F.length(F.element_at(f"p{k}", -1))) - len(BASE[k][0].split())) for k, n in enumerate(counts)]
    labels = F.array_compact(F.array(*(F.when(n > 0, F.lit(label)) for n, (_, label) in zip(counts, BASE))))
    return rows.select("doc_id", "n_words", sum(counts[1:], counts[0]).cast("long").alias("n_base"), F.least(*firsts).cast("long").alias("first_word"),
                       F.greatest(*lasts).cast("long").alias("last_word"), labels.alias("base_labels"),
                       _surviving(F.coalesce("found", F.expr("cast(array() as array<struct<from: int, minus_to: int, place: int, label: string, score: double>>)"))).alias("detections"))
