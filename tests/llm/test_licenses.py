"""License scans next to their SQL and a plain reading of the contract."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import compare, duck  # noqa: E402
import duckdb
from pyspark.sql import functions as F

from urlrisk.llm import licenses as L
from urlrisk.llm.queries import QUERIES, op10

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    "Released under the MIT License.", "MIT\nlicense, mit-license; MIT LICENSE", "permit license", "the apache license of the apache license", "ümit license", "mİt license",
    "Licensed under the Apache License, Version 2.0 (the \"License\")", "This work is licensed under the GNU General Public License, version 3.", "GNU Lesser General Public License v2.1 or later",
    "SPDX-License-Identifier: BSD-3-Clause", "Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-ShareAlike 3.0 Unported", "cc0", "MPL-2.0 or EPL-1.0", "Ms-PL", "CeCILL", "ODbL", "dedicated to the public domain",
    "All rights reserved.", "https://opensource.org/licenses/ISC", "EUPL 1.2", "cddl 1.0", "WTFPL", "", "no words of that kind", "license license license", "general public license " * 40, "mit license " * 3, "EPL",
]
EXPECTED = {0: "mit", 6: "apache,apache-2.0", 7: "gpl,gpl-3.0", 8: "gpl,lgpl-2.1", 9: "bsd-3-clause", 10: "cc-by-nc-4.0", 11: "cc-by-sa-3.0", 12: "cc0-1.0", 13: "epl-1.0,mpl-2.0", 14: "ms-pl", 15: "cecill-2.1",
            16: "odbl-1.0", 17: "public-domain", 18: "proprietary", 19: "isc", 20: "eupl-1.2", 21: "cddl-1.0", 22: "wtfpl", 23: "", 24: "", 25: ""}


def plain(text):
    words = [w for w in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    at, labels = [], set()
    for phrase, label in L.BASE:
        p = phrase.split()
        here = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def folder(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, low string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_written_texts(spark, tmp_path):
    rows = [(i, t, None, None, None, "x") for i, t in enumerate(TEXTS)] + [(None, None, None, None, None, None), (1, TEXTS[1], None, None, None, None)]
    found = op10(spark, folder(spark, tmp_path, rows)).collect()
    assert len(found) == len(rows)
    for row in found:
        text = TEXTS[row["doc_id"]] if row["doc_id"] is not None else None
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == plain(text), text
        assert 0 <= row["score"] <= 1 and set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(","))
        if row["doc_id"] in EXPECTED:
            assert row["labels"] == EXPECTED[row["doc_id"]], text


def test_same_rows_as_sql(spark):
    ok, _, info = compare(spark, duck(FOLDER), FOLDER, "op10_licenses", QUERIES["op10_licenses"])
    assert ok, info


def test_hundreds_of_ordered_rules():
    rules = L.rules()
    assert len(rules) > 300 and [r[0] for r in rules] == list(range(len(rules)))
    assert all(re.compile(r[4]) for r in rules)
    assert [r[3] for r in rules] == sorted((r[3] for r in rules), reverse=True)


def test_plan_is_native(spark):
    plan = L.scan(spark.read.parquet(f"{FOLDER}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Exchange"))


def test_no_rows(spark, tmp_path):
    assert op10(spark, folder(spark, tmp_path, [])).select(F.count("*")).first()[0] == 0


def samples(pattern):
    """Texts of a rule: every alternative of every group once, with optional parts and without."""
    from re import _parser as P

    def of(parsed):
        outs = [""]
        for op, value in parsed:
            if op is P.LITERAL:
                parts = [chr(value)]
            elif op is P.IN:
                parts = [chr(v) for o, v in value if o is P.LITERAL] if value[0][0] is not P.NEGATE else ["k"]
            elif op is P.NOT_LITERAL:
                parts = ["k"]
            elif op is P.SUBPATTERN:
                parts = of(value[3])
            elif op is P.BRANCH:
                parts = [t for branch in value[1] for t in of(branch)]
            else:  # a repeat
                parts = ([""] if value[0] == 0 else []) + of(value[2])
            outs = [a + b for a in outs[:40] for b in dict.fromkeys(parts)][:4000]
        return outs
    return of(P.parse(pattern))


def test_gate_and_keywords_let_every_rule_through():
    gate = re.compile(L.GATE_WORDS)
    for _, label, keywords, _, pattern in L.rules():
        for text in samples(pattern):
            assert re.fullmatch(pattern, text), (label, text)
            assert any(k in text for k in keywords.split("|")), (label, text)
            plain_text = re.sub(" +", " ", text)
            assert any(g in plain_text for g in L.GATES) or gate.search(plain_text), (label, text)


def test_every_verb_with_every_identifier(spark, tmp_path):
    verbs = [re.sub(r"[()]", "", v).split("|") for v in (L._VERBS, L._BY)]
    texts = []
    for _, _, identifier, _ in (*L.LICENSES, *L.creative_commons()):
        for name in samples(identifier):
            texts += [f"{verb} {by} {name}" for verb in verbs[0] for by in verbs[1]]
    texts += [f"{verb}_{by}_the_terms_of the-{name}" for verb in verbs[0] for by in verbs[1] for name in ("mit", "Apache 2.0", "x11", "PSF 2.0")]
    texts += ["see_mpl_1_0_", "_MPL_2.0_", "_ms_pl_", "cc_by_4.0", "Released under MIT", "distributed under Apache 2.0"]
    assert len(texts) > 2000
    rows = [(i, t, None, None, None, "x") for i, t in enumerate(texts)]
    where = folder(spark, tmp_path, rows)
    unlabelled = [texts[r["doc_id"]] for r in op10(spark, where).where("labels = ''").collect()]
    assert not unlabelled, unlabelled[:5]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{where}/documents.parquet'")
    ok, _, info = compare(spark, con, where, "op10_licenses", QUERIES["op10_licenses"])
    assert ok, info
