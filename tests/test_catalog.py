"""Registered queries next to their SQL on the smallest tables, and the shape of the main plan."""

import os

import pytest

from compare import compare, duck
from urlrisk.catalog import load

FOLDER = "/root/testdata/sf0.001"
QUERIES = load()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
# Every part of the engine once; ``python tests/compare.py FOLDER`` runs all queries.
CHOSEN = ("url_01_features", "url_04_pattern_hits", "url_07_notes", "osi_13_osint_quality", "joi_01_features_with_dns", "joi_05_as_of_enrichment",
          "txt_08_top_indicators", "sco_08_ranked_reasons", "sco_16_score_messages", "set_02_dedupe_urls", "src_04_tagged_csv", "win_01_newest_ordinal",
          "dst_07_split", "dst_09_augment", "agg_08_feature_stats", "eva_06_pr_auc", "exp_05_correlations", "his_01_append", "str_01_score_stream")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows_as_sql(spark, con, name):
    ok, _, info = compare(spark, con, FOLDER, name, QUERIES[name])
    assert ok, info


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_main_plan_has_no_python_and_no_nested_loop(spark):
    plan = plan_of(QUERIES["sco_16_score_messages"].run(spark, FOLDER))
    for word in ("EvalPython", "InPandas", "CartesianProduct", "NestedLoop"):
        assert word not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(QUERIES["txt_05_confidence"].run(spark, FOLDER))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_content_is_dropped_before_the_join(spark):
    from urlrisk.catalog import score_queries as Q, text_queries as X
    from urlrisk.plans import scoring
    assert "content" not in scoring.content_signals(X.messages(spark, FOLDER)).columns
    assert Q.verdicts(spark, FOLDER).columns == list(scoring.RESULT)
