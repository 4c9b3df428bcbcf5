"""Benchmark the headline queries.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints
ONE JSON line: {"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}.
Each query is run once to warm up (plan compilation, Python workers) and then timed; results are
fully evaluated through the no-op sink, nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "item_uncertainty",
    "silhouette",
    "knn_exact",
    "cluster_keywords",
    "resolve_links",
    "kmeans_fit",
    "metric_fit_epoch",
    "clustering_quality",
    "constraint_satisfaction",
    "apply_actions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    from steerclust.plans.registry import queries
    from steerclust.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 8)
    qs = queries()
    timings: dict[str, float] = {}
    for name in HEADLINE:
        if name not in qs:
            continue
        fn = qs[name]
        try:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.perf_counter() - t0, 3)
        except Exception as exc:  # noqa: BLE001
            print(f"bench: {name} failed: {exc}", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "total_sec",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
