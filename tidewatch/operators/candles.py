"""Candles over ticks and order-flow imbalance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidewatch.plans.layout import TICKS, Layout
from tidewatch.plans.scans import Scan, following, over_rows, previous, running

# Candles of a key are few; thirty days of them make one slot.
CANDLES = Layout(keys=("symbol", "timeframe_ms"), order=("start_ms",), slot_ms=30 * 86_400_000)


@dataclass(frozen=True)
class ReliabilityConfig:
    min_ticks: int = 3
    min_trust: float = 0.5
    max_anomaly: float = 0.8
    override_after: int = 50


def candles(ticks: DataFrame, timeframes: tuple[int, ...] = (300_000, 3_600_000), cfg: ReliabilityConfig = ReliabilityConfig()) -> DataFrame:
    """OHLCV and reliability per (symbol, timeframe, floor bucket).

    One partial/final aggregation for all timeframes; a hot symbol is combined map-side and never gathered.
    """
    when = F.struct("ts_ms", "tick_id")
    start = F.floor(F.col("ts_ms") / F.col("timeframe_ms")) * F.col("timeframe_ms")
    bars = (
        ticks.withColumn("timeframe_ms", F.explode(F.array(*[F.lit(t).cast("long") for t in timeframes])))
        .groupBy("symbol", "timeframe_ms", start.cast("long").alias("start_ms"))
        .agg(
            F.min_by("mid", when).alias("open"),
            F.max("mid").alias("high"),
            F.min("mid").alias("low"),
            F.max_by("mid", when).alias("close"),
            F.sum(F.greatest(F.lit(0.0), F.coalesce("volume_24h", F.lit(0.0)))).alias("volume"),
            F.count(F.lit(1)).alias("tick_count"),
            F.avg("trust_score").alias("avg_trust"),
            F.max("anomaly_score").alias("max_anomaly"),
            F.min(when).alias("_first"),
            F.max(when).alias("_last"),
        )
    )
    return bars.select(
        "symbol", "timeframe_ms", "start_ms", (F.col("start_ms") + F.col("timeframe_ms")).alias("end_ms"),
        "open", "high", "low", "close", "volume", "tick_count", "avg_trust", "max_anomaly",
        is_reliable(cfg).alias("is_reliable"), (F.col("tick_count") < cfg.min_ticks).alias("discarded"),
        F.col("_first.ts_ms").alias("first_ts_ms"), F.col("_first.tick_id").alias("first_tick_id"),
        F.col("_last.ts_ms").alias("last_ts_ms"), F.col("_last.tick_id").alias("last_tick_id"),
    )


def is_reliable(cfg: ReliabilityConfig = ReliabilityConfig()) -> Column:
    return (
        (F.col("tick_count") >= cfg.min_ticks)
        & (F.col("avg_trust") >= cfg.min_trust)
        & (F.col("max_anomaly") <= cfg.max_anomaly)
    )


def unreliable_streak(bars: DataFrame, layout: Layout = CANDLES, cfg: ReliabilityConfig = ReliabilityConfig()) -> DataFrame:
    """Consecutive unreliable candles so far; from the limit on, the candle overrides the state with DEGRADED."""
    out = running(bars, layout, consecutive_unreliable=Scan("streak", ~F.col("is_reliable")))
    override = F.when(F.col("consecutive_unreliable") >= cfg.override_after, "DEGRADED")
    return out.withColumn("state_override", override)


def with_close(bars: DataFrame, layout: Layout = CANDLES) -> DataFrame:
    """Add the tick that closes each candle: the first tick of the next one, or the end of data for the last."""
    out = following(bars, layout, close_ts_ms="first_ts_ms", close_tick_id="first_tick_id")
    return out.withColumn("close_tick_id", F.coalesce("close_tick_id", "last_tick_id")).withColumn(
        "close_ts_ms", F.coalesce("close_ts_ms", F.col("last_ts_ms") + 1)
    )


def candle_continuity(bars: DataFrame, layout: Layout = CANDLES) -> DataFrame:
    out = previous(bars, layout, previous_end_ms="end_ms")
    step = F.col("start_ms") - F.col("previous_end_ms")
    return out.withColumn(
        "continuity", F.when(step.isNull(), "first").when(step == 0, "ok").when(step < 0, "overlap").otherwise("gap")
    )


def order_flow_imbalance(ticks: DataFrame, layout: Layout = TICKS, *, window: int = 50, z_window: int = 50) -> DataFrame:
    """Signed volume balance of the last ticks and its z-score. A tick that does not rise counts as a sale."""
    moved = previous(ticks, layout, _before="mid")
    size = F.greatest(F.lit(0.0), F.coalesce(F.col("volume_24h"), F.lit(1.0)))
    buy = F.when(F.col("mid") > F.col("_before"), size).otherwise(F.lit(0.0))
    sell = F.when(F.col("mid") <= F.col("_before"), size).otherwise(F.lit(0.0))
    moved = moved.withColumn("_buy", buy).withColumn("_sell", sell)

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        frame = w.rowsBetween(-(window - 1), 0)
        df = (
            df.withColumn("buy_volume", F.sum("_buy").over(frame))
            .withColumn("sell_volume", F.sum("_sell").over(frame))
            .withColumn("ofi_ticks", F.count(F.lit(1)).over(frame))
        )
        both = F.col("buy_volume") + F.col("sell_volume")
        df = df.withColumn("ofi", F.when(both == 0, 0.0).otherwise((F.col("buy_volume") - F.col("sell_volume")) / both))
        z = w.rowsBetween(-(z_window - 1), 0)
        sd = F.stddev_samp("ofi").over(z)
        score = F.when(sd > 0, (F.col("ofi") - F.avg("ofi").over(z)) / sd).otherwise(F.lit(0.0))
        return df.withColumn("ofi_zscore", score)

    return over_rows(moved, layout, window + z_window, build).drop("_before", "_buy", "_sell", "_rn")
