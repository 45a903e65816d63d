"""Aggregates behind soak and quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.plans.layout import Layout
from tidewatch.plans.quantiles import exact_quantiles
from tidewatch.plans.scans import Scan, running


def nearest_rank(rows: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Values at the half-even rounded position ``(n - 1) * p``."""
    return exact_quantiles(rows, keys, value, probs, method="nearest")


def ingestion_summary(ticks: DataFrame, layout: Layout) -> DataFrame:
    """Per source: ticks, rate, arrival and event gaps (p50, p95), out-of-order events."""
    keys = list(layout.keys)
    rows = running(
        ticks, layout, _last=Scan("last", F.struct(F.col(layout.ts).alias("ts"), F.col("exchange_ts_ms").alias("ex")), exclusive=True)
    )
    rows = rows.withColumn("_arrival", F.col(layout.ts) - F.col("_last.ts")).withColumn("_event", F.col("exchange_ts_ms") - F.col("_last.ex"))
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("ticks"), (F.max(layout.ts) - F.min(layout.ts)).alias("_span"), F.count_if(F.col("_event") < 0).alias("out_of_order"))
    base = base.withColumn("rate_per_s", F.when(F.col("_span") > 0, F.col("ticks") / (F.col("_span") / 1000.0))).withColumn(
        "out_of_order_pct", F.col("out_of_order") / F.col("ticks") * 100.0).drop("_span")
    for name in ("arrival", "event"):
        pct = nearest_rank(rows, keys, f"_{name}", {f"{name}_gap_p50": 0.5, f"{name}_gap_p95": 0.95})
        base = base.join(pct, keys)
    return base


def alignment_summary(filled: DataFrame) -> DataFrame:
    """Per symbol: windows, real and filled quotes, age of filled ones."""
    return filled.groupBy("symbol").agg(
        F.count_distinct("window_end_ms").alias("windows"), F.count_if("fresh").alias("real_quotes"), F.count_if(~F.col("fresh")).alias("filled_quotes"),
        F.max(F.when(~F.col("fresh"), F.col("age_ms"))).alias("max_age_ms"), F.avg(F.when(~F.col("fresh"), F.col("age_ms"))).alias("mean_age_ms"))


def fills_by_source(filled: DataFrame) -> DataFrame:
    """Filled quotes per venue and their share of all fills."""
    counts = filled.where(~F.col("fresh")).groupBy("exchange_id").agg(F.count(F.lit(1)).alias("fills"))
    total = counts.agg(F.sum("fills").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("fills") / F.col("_all")).drop("_all")


def consensus_summary(decided: DataFrame) -> DataFrame:
    """Window counts and shares by class, and windows with divergent venues."""
    one = F.col("consensus_class")
    out = decided.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(one == "consensus").alias("true_consensus"), F.count_if(one == "degraded").alias("degraded"),
        F.count_if(one == "none").alias("no_consensus"), F.count_if(F.size("divergent_sources") > 0).alias("divergent_windows"))
    return out.withColumn("true_pct", F.col("true_consensus") / F.col("windows") * 100.0)


def divergence_by_source(decided: DataFrame) -> DataFrame:
    return decided.select(F.explode("divergent_sources").alias("exchange_id")).groupBy("exchange_id").agg(F.count(F.lit(1)).alias("windows"))


def used_sources_histogram(decided: DataFrame) -> DataFrame:
    counts = decided.groupBy(F.size("used_sources").alias("used")).agg(F.count(F.lit(1)).alias("windows"))
    total = counts.agg(F.sum("windows").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("windows") / F.col("_all")).drop("_all")


def trust_table(validated: DataFrame, names: list[str]) -> DataFrame:
    """Percentiles, mean and range of every sub-score, in long form."""
    long = validated.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], names, "score", "value")
    base = long.groupBy("score").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    return base.join(exact_quantiles(long, ["score"], "value", {"p5": 0.05, "median": 0.5, "p95": 0.95}), "score")


def trace_summary(validated: DataFrame) -> DataFrame:
    base = validated.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("windows"), F.min(F.size("used_sources")).alias("used_min"), F.max(F.size("used_sources")).alias("used_max"),
        F.min("trust_score").alias("trust_min"), F.max("trust_score").alias("trust_max"))
    return base.join(exact_quantiles(validated, ["symbol"], "trust_score", {"trust_median": 0.5}), "symbol")


def log_level_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    text = F.upper(column)
    return lines.agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.contains(text, F.lit("ERROR"))).alias("errors"), F.count_if(F.contains(text, F.lit("WARN"))).alias("warnings"))


def scored_sample_stats(scored: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    v = F.col("anomaly_score")
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.avg((F.col("regime") == 1).cast("double")).alias("high_share"), F.min(v).alias("min_score"),
        F.max(v).alias("max_score"), F.avg(v).alias("mean_score"))
