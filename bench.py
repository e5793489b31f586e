"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from mxposture import get_session
from mxposture.plans import registry

HEADLINE = [
    "a01_flow_event_fold",
    "f01_flow_quality",
    "j05_frame_to_flow",
    "f19_key_exchange",
    "f20_forward_secrecy",
    "j07_nth_frame_attach",
    "f12_upgrade_outcome",
    "f12_dialogue_outcome",
    "j06_second_source_merge",
    "e2_build_sessions",
    "j08_fingerprint_join",
    "j09_file_fallback",
    "j24_identity_match",
    "j25_chain_walk",
    "f29_handshake_rules",
    "f29_session_rules",
    "e1_score_findings",
    "a06_cluster_ids",
    "a07_coverage_cube",
    "a08_posture",
    "a09_case_summaries",
    "j15_finding_protocol",
    "j17_lineage",
    "a04_endpoint_rollup",
    "w02_robust_z",
    "w04_categorical_rarity",
    "m1_baseline_scores",
    "m2_isolation_forest",
    "a24_alert_rates",
    "a26_bootstrap_lift",
    "m5_compare_detectors",
    "f40_forensic_report_text",
    "v05_document_diff",
    "st02_tcp_reconstruction",
    "st04_protocol_events",
    "st06_st09_daily_windows_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            # A few MB per query: keep one task per core instead of coalescing to one task.
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    # One query before the clock starts the JVM's code paths.
    registry.QUERIES["e1_score_findings"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
