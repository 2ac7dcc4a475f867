"""Benchmark: headline jobs, warm, on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from urlrisk.catalog import load  # noqa: E402
from urlrisk.session import local_session  # noqa: E402

HEADLINE = (
    "url_01_features", "url_04_pattern_hits", "url_06_structural_score", "url_11_link_features",
    "osi_05_dns_summary", "osi_10_reputation_score", "joi_01_features_with_dns", "joi_05_as_of_enrichment",
    "txt_05_confidence", "sco_08_ranked_reasons", "sco_16_score_messages", "set_02_dedupe_urls",
    "win_01_newest_ordinal", "dst_05_balance", "dst_07_split", "agg_08_medians", "eva_05_roc_auc", "eva_06_pr_auc",
    "exp_05_correlations",
)
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench")
    registered = load()
    times: dict[str, float] = {}

    def once(name: str) -> float:
        start = time.perf_counter()
        # The noop sink computes every column of every row and keeps nothing.
        registered[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in HEADLINE:
        once(name)  # warm-up
        times[name] = round(statistics.median(once(name) for _ in range(RUNS)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline jobs, warm, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
