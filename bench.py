"""Headline queries, each run once warm-up and timed once: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from contentlake import plans
from contentlake.session import local_session

HEADLINE = (
    "q1_name_search", "q1_name_search_stemmed", "q3_combined_search", "q5_file_count", "q6_ranked_page",
    "q7_first_files", "q7_search_page", "q8_video_items", "t7_extract_title", "t8_keyword_weight", "t9_regex_weight",
    "t11_special_ratio", "f1_heuristic_score", "f2_layered_decision", "f5_accuracy", "s1_decode_records",
    "s5_explode_ids", "s6_explode_peers", "d2_encode_prefixes", "d4_bloom_table", "d5_drop_seen", "d6_drop_confirmed",
    "d9_upsert_items", "d13_two_strike", "k1_xor_distance", "k2_closest", "k9_eviction", "k21_bounded_buckets",
    "p1_peer_lists", "p11_attempt_rollup", "p13_refresh_report", "m2_rolling_hour", "m4_ema_values", "m5_low_rate", "m7_hysteresis",
    "m8_low_streak", "m13_fetch_stats", "z3_minute_counts", "z5_two_strike",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE
    times: dict[str, float] = {}
    for name in names:
        run = plans.QUERIES[name]
        for _ in range(2):
            start = time.perf_counter()
            run(spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    items = spark.read.parquet(f"{folder}/orders.parquet").count()
    report = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    if "f2_layered_decision" in times:
        report["filter_items_per_sec"] = round(items / times["f2_layered_decision"])
    print(json.dumps(report))


if __name__ == "__main__":
    main()
