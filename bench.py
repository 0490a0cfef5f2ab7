"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from obsfuse.plans.catalogue import REGISTRY  # noqa: E402
from obsfuse.runtime import session  # noqa: E402

HEADLINE = [
    "residual_scorecard",
    "uncertainty_by_group",
    "risk_coverage_auc",
    "fuse_uniform",
    "fuse_precision",
    "fuse_ci_pair",
    "overlap_correspondences",
    "overlap_disagreement",
    "common_support",
    "sequence_scorecard",
    "group_scale",
    "pathwise_max",
    "paired_contrast",
    "group_competence",
    "group_bootstrap",
    "joint_gaussian_groups",
    "triangle_cycles",
    "link_candidates",
    "nearest_units",
    "robust_alignment",
    "stream_window_counts",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", cores=cpus)
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count().collect()  # start the JVM
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        REGISTRY[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
