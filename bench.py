"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores.  Each
query runs twice, writing to a sink that keeps nothing, so the time covers
planning and every row; ``first`` has the cold runs, ``queries`` the warm ones.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from flowloom.plans import registry  # noqa: E402

HEADLINE = (
    "flow_assign",
    "flow_sessions",
    "flow_concurrency",
    "windows_release",
    "iat_features",
    "active_idle_features",
    "aggregate_features",
    "feature_vectors",
    "window_summary",
    "split_candidates",
    "partition_join",
    "standardize",
    "prototype_probs",
    "class_covariance",
    "kde_ood_score",
    "score_batch",
    "flag_rates",
    "session_snapshot",
    "lifecycle_violations",
    "event_retention",
    "packet_violations",
    "decode_frames",
    "packet_messages",
    "stream_flow_windows",
    "stream_events_sink",
    "stream_predictions",
    "episode_sample",
    "logistic_balanced",
    "split_assign",
)


def main() -> None:
    with tempfile.TemporaryDirectory(prefix="bench-") as scratch:
        run(scratch)


def run(scratch: str) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("flowloom-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.checkpoint.dir", scratch)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = registry.queries()
    chosen = sys.argv[1:] or HEADLINE
    first: dict[str, float] = {}
    seconds: dict[str, float] = {}
    for name in chosen:
        for times in (first, seconds):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    events = spark.read.parquet(f"{folder}/events.parquet").count()
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").count()
    windows = queries["windows_release"](spark, folder).count()
    rates = {}
    if "feature_vectors" in seconds:
        rates["feature_windows_per_sec"] = round(windows / seconds["feature_vectors"], 1)
        rates["feature_packets_per_sec"] = round(events / seconds["feature_vectors"], 1)
    if "flow_sessions" in seconds:
        rates["flow_packets_per_sec"] = round(events / seconds["flow_sessions"], 1)
    if "windows_release" in seconds:
        rates["window_packets_per_sec"] = round(events / seconds["windows_release"], 1)
    if "stream_flow_windows" in seconds:
        rates["stream_packets_per_sec"] = round(events / seconds["stream_flow_windows"], 1)
    if "score_batch" in seconds:
        rates["scored_rows_per_sec"] = round(vectors / seconds["score_batch"], 1)
    print(
        json.dumps(
            {
                "metric": "headline query seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first": first,
                "sf": Path(folder).name.removeprefix("sf"),
                "rates": rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
