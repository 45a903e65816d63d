"""Time the headline queries: one JSON line with seconds per query.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of local cores. Every query is run to the end through a
no-op sink, once to warm the JVM and then timed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "score_ticks", "validated_tick", "align_tumbling", "lkv_fill", "consensus_class", "candles_multi", "indicator_snapshot", "trade_signal",
    "order_flow_imbalance", "mad_detector", "cusum_detector", "ewma_detector", "decision_gate", "risk_checks", "risk_breaker", "fill_cost",
    "scenario_sweep", "detection_rates", "sharpe", "trust_statistics", "verify_chain", "alert_rules", "counter_rate", "normalize_binance",
    "quality_events", "ingestion_summary", "quarantine_consensus", "position_ledger", "build_chain", "stream_score",
]


def main() -> None:
    from tidewatch.workload import load

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tidewatch-bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    seconds = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        seconds[name] = round(best, 3)
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
        "cores": int(cpus), "shuffle_partitions": int(cpus), "score_ticks_per_second": round(ticks / seconds["score_ticks"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
