"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores.  Each query is run to completion without keeping its rows:
BENCH_RUNS times (default 1), of which the median counts, after one untimed
run of a few queries that compiles the common code.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siteval.plans import catalog  # noqa: E402
from siteval.plans.session import local_session  # noqa: E402
from siteval.plans.tables import Tables  # noqa: E402

HEADLINE = [
    "entry_site_exposure", "u15_parse_urls", "f01_f22_url_features", "g02_duplicate_groups", "g06_multiplicity",
    "g09_concentration", "g10_site_exposure", "g16_template_overlap", "sp03_stratified", "sp06_group_best",
    "sp07_group_prefix", "sp07_group_greedy", "sp08_split_grid", "sp10_cap_hot_site", "sp16_dedup", "j07_composite_lookup", "w03_running_total",
    "w04_average_rank", "w10_ordinal", "k01_k10_all_metrics", "k12_spearman", "b04_draw_clusters",
    "b05_j11_replicate_metrics", "b06_replicate_rank_metrics", "m04_char_tfidf", "m04_char_tfidf_documents", "a03_local_change",
    "a05_permutation_importance", "e07_category_counts", "e10_w07_site_errors", "i08_fingerprint",
]
WARM_UP = ["entry_site_exposure", "k01_k10_all_metrics", "e07_category_counts"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus=cpus, shuffle=int(cpus) if cpus.isdigit() else 8)
    Tables(spark, sf_dir).read("orders").count()  # session start is not a query
    times: dict[str, float] = {}

    def run(name: str) -> float:
        start = time.perf_counter()
        catalog.QUERIES[name](Tables(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in WARM_UP:
        run(name)
    for name in sys.argv[1:] or HEADLINE:
        times[name] = round(median(run(name) for _ in range(int(os.environ.get("BENCH_RUNS", "1")))), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
