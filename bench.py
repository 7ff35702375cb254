"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "literal_entropy", "sha256_dedup", "byte_ratios", "vocabulary_match", "longest_prefix_join", "upsert_overlay", "confusion_metrics", "reachability", "rarest_item",
    "head_and_tail", "overlap_suppression", "placeholder_shadowing", "context_window", "roundtrip_carve", "call_sites", "verdict_counts", "synthetic_verdicts", "reach_records", "item_table",
    "pattern_candidates", "slice_arguments", "literal_evidence", "compacted_leaves", "detection_table",
]


def main() -> None:
    from carvelake.session import session, ship

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    from carvelake.plans.queries import QUERIES

    ship(spark).range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
