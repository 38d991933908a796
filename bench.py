"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the cores.  The enriched report table,
which all analytics read, is built once and timed on its own.  Each query runs
BENCH_RUNS times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

HEADLINE = [
    "d1_density_by_site", "d2_density_by_hazards", "d2_density_all_dimensions", "d6_site_profile",
    "d8_activity_profile", "d14_overall_summary", "p4_all_patterns", "p6_emerging_by_quarter", "p8_priority_scores",
    "t7_all_periods", "t5_monthly_frequency", "r1_report_page", "r3_filtered_reports", "c3_clean_documents",
    "c19_clauses", "x1_activities", "x4_barrier_failures", "x5_hazards", "x11_normalized_sentences", "q1_dimension_overlap",
    "q6_report_metrics", "q7_q8_report_ranking_metrics", "q11_multilabel_metrics", "v3_nearest_to_label_centres",
    "v4_nearest_without_itself", "g1_assessment_agreement", "m8_split_sizes", "p12_frequent_itemsets",
]


def main() -> None:
    from incident_signals.catalog import QUERIES
    from incident_signals.catalog.adapter import enriched
    from incident_signals.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")

    def timed(action) -> float:
        start = time.perf_counter()
        action()
        return time.perf_counter() - start

    seconds = {"enriched_build": round(timed(lambda: enriched(spark, sf_dir)), 3)}
    for name in HEADLINE:
        times = [
            timed(lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
            for _ in range(runs)
        ]
        seconds[name] = round(statistics.median(times), 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
