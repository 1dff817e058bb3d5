"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. Each query is executed completely with the ``noop``
sink (no collect); shared tables (labelled points, features, neighbours,
device-days) are built by the first query that needs them, so per-query
times are incremental and ``value`` is the end-to-end wall time.

Before timing, the same queries run once over the smallest input
(``$BENCH_WARMUP_DIR``, default sf0.001; a different dataset, so no result is
reused) to warm the JVM's JIT and Spark's code generation. Its time is
reported as ``warmup_sec`` and is not part of ``value``; set
``BENCH_WARMUP_DIR=`` (empty) for a cold measurement.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "eval_split_labels",
    "scalar_features",
    "nearest_neighbours",
    "enriched_points",
    "daily_frame",
    "split_summary",
    "drift_vs_train",
    "irradiance_baseline",
    "policy_predictions",
    "experiment_metrics",
    "daily_predictions",
    "blend_weight_scan",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pvlake.plans.registry import REGISTRY
    from pvlake.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    w0 = time.time()
    spark.range(1).count()
    if warm_dir and os.path.isdir(warm_dir) and os.path.abspath(warm_dir) != os.path.abspath(sf_dir):
        for name in HEADLINE:
            REGISTRY[name].build(spark, warm_dir).write.format("noop").mode("overwrite").save()
    warmup = round(time.time() - w0, 3)
    times: dict[str, float] = {}
    start = time.time()
    for name in HEADLINE:
        t0 = time.time()
        REGISTRY[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(time.time() - start, 3)
    points = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "end_to_end_wall",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "rows_per_sec": round(points / total, 1) if total else None,
        "warmup_sec": warmup,
    }))


if __name__ == "__main__":
    main()
