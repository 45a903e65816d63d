"""Trade signals from two candle timeframes, and position sizes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidewatch.functions.scalar import clip01
from tidewatch.operators.candles import CANDLES
from tidewatch.plans.asof import asof_join
from tidewatch.plans.layout import Layout
from tidewatch.plans.scans import over_rows

SIGNALS = Layout(keys=("symbol",), order=("close_ts_ms", "start_ms"), slot_ms=30 * 86_400_000)


@dataclass(frozen=True)
class SignalConfig:
    normal_rsi_long: float = 35.0
    normal_rsi_short: float = 65.0
    conservative_rsi_long: float = 30.0
    conservative_rsi_short: float = 70.0
    bollinger_buffer: float = 0.01
    bollinger_strong: float = 0.01
    cross_window: int = 3
    cross_margin: float = 0.005
    ofi_long: float = 0.10
    ofi_short: float = 0.10
    higher_rsi_long: float = 55.0
    higher_rsi_short: float = 45.0
    # Strength scale of the relative strength index; the source rules name these without giving values.
    long_rsi_max: float = 35.0
    long_rsi_min: float = 20.0
    short_rsi_min: float = 65.0
    short_rsi_max: float = 80.0


@dataclass(frozen=True)
class SizingConfig:
    base: float = 0.20
    conservative: float = 0.5
    partial: float = 0.5


def primary_columns(snaps: DataFrame, layout: Layout = CANDLES, cfg: SignalConfig = SignalConfig()) -> DataFrame:
    """Add the previous histogram and whether the averages crossed in the last candles."""
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        recent = w.rowsBetween(-(cfg.cross_window - 1), 0)
        crossed = lambda side: F.coalesce(F.max(F.col("ema_cross") == side).over(recent), F.lit(False))
        return (
            df.withColumn("prev_histogram", F.lag("macd_histogram").over(w))
            .withColumn("crossed_up", crossed("bullish"))
            .withColumn("crossed_down", crossed("bearish"))
        )

    return over_rows(snaps, layout, cfg.cross_window, build)


def higher_timeframe_asof(primary: DataFrame, higher: DataFrame, layout: Layout = SIGNALS) -> DataFrame:
    """Give each primary candle the last higher candle (and its previous histogram) closed by an earlier tick."""
    names = {"h_start_ms": "start_ms", "h_rsi": "rsi", "h_histogram": "macd_histogram", "h_prev_histogram": "prev_histogram",
             "h_middle": "bollinger_middle", "h_close": "close", "h_reliable": "is_reliable"}
    return asof_join(primary, higher, layout, {k: v for k, v in names.items() if v in higher.columns}, strict=True)


def signal_ofi_asof(primary: DataFrame, ofi: DataFrame) -> DataFrame:
    """Attach order flow, state and trust of the tick that closed the candle: an equi join on the tick id."""
    cols = [c for c in ("ofi", "system_state", "trust_score") if c in ofi.columns]
    return primary.join(ofi.select(F.col("tick_id").alias("close_tick_id"), *cols), "close_tick_id", "left")


def effective_state() -> Column:
    """A candle's override takes the place of the tick's state."""
    return F.coalesce("state_override", "system_state")


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def turning(now: str, before: str, side: str) -> Column:
    """Histogram beyond zero and growing, or just arrived at zero."""
    h, p = F.col(now), F.col(before)
    if side == "LONG":
        return _true(((h > 0) & (h > p)) | ((p < 0) & (h >= 0)))
    return _true(((h < 0) & (h < p)) | ((p > 0) & (h <= 0)))


def gate_conditions(side: str, cfg: SignalConfig = SignalConfig()) -> dict[str, Column]:
    """The four conditions of the primary gate."""
    tight = F.col("effective_state") == "CONSERVATIVE"
    apart = F.abs(F.col("ema_fast") - F.col("ema_slow")) / F.abs("ema_slow")
    close_by = F.when(F.col("ema_slow") != 0, apart <= cfg.cross_margin)
    if side == "LONG":
        rsi = F.col("rsi") < F.when(tight, cfg.conservative_rsi_long).otherwise(cfg.normal_rsi_long)
        band = F.col("close") <= F.col("bollinger_lower") * (1.0 + cfg.bollinger_buffer)
        crossed = F.col("crossed_up")
    else:
        rsi = F.col("rsi") > F.when(tight, cfg.conservative_rsi_short).otherwise(cfg.normal_rsi_short)
        band = F.col("close") >= F.col("bollinger_upper") * (1.0 - cfg.bollinger_buffer)
        crossed = F.col("crossed_down")
    return {
        "rsi_ok": _true(rsi), "macd_ok": turning("macd_histogram", "prev_histogram", side), "bollinger_ok": _true(band),
        "ema_ok": crossed | _true(close_by),
    }


def primary_gate(side: str, cfg: SignalConfig = SignalConfig()) -> Column:
    a, b, c, d = gate_conditions(side, cfg).values()
    return a & b & c & d


def higher_confluence(side: str, cfg: SignalConfig = SignalConfig()) -> Column:
    """How many of the three higher-timeframe conditions hold."""
    h, p = F.col("h_histogram"), F.col("h_prev_histogram")
    if side == "LONG":
        conds = (F.col("h_rsi") < cfg.higher_rsi_long, (h > 0) | ((p < 0) & (h >= 0)), F.col("h_close") < F.col("h_middle"))
    else:
        conds = (F.col("h_rsi") > cfg.higher_rsi_short, (h < 0) | ((p > 0) & (h <= 0)), F.col("h_close") > F.col("h_middle"))
    return sum((_true(c).cast("int") for c in conds), F.lit(0))


def signal_strength(side: str, cfg: SignalConfig = SignalConfig()) -> Column:
    """Mean of four scores in [0, 1]."""
    h, p = F.col("macd_histogram"), F.col("prev_histogram")
    apart = F.abs(F.col("ema_fast") - F.col("ema_slow")) / F.abs("ema_slow")
    ema = F.when(F.col("ema_slow") != 0, clip01(1.0 - apart / cfg.cross_margin))
    scale = cfg.bollinger_strong + cfg.bollinger_buffer
    if side == "LONG":
        rsi = clip01((cfg.long_rsi_max - F.col("rsi")) / (cfg.long_rsi_max - cfg.long_rsi_min))
        macd = F.when((h > 0) & (h > p), clip01((h - p) / (F.abs(h) + F.abs(p))))
        lower = F.col("bollinger_lower")
        band = F.when(lower != 0, clip01(((lower - F.col("close")) / lower + cfg.bollinger_buffer) / scale))
        crossed = F.col("crossed_up")
    else:
        rsi = clip01((F.col("rsi") - cfg.short_rsi_min) / (cfg.short_rsi_max - cfg.short_rsi_min))
        macd = F.when((h < 0) & (h < p), clip01((p - h) / (F.abs(h) + F.abs(p))))
        upper = F.col("bollinger_upper")
        band = F.when(upper != 0, clip01(((F.col("close") - upper) / upper + cfg.bollinger_buffer) / scale))
        crossed = F.col("crossed_down")
    zero = F.lit(0.0)
    # greatest/least ignore nulls, so a score without its inputs is set to zero explicitly.
    parts = (
        F.when(F.col("rsi").isNotNull(), rsi).otherwise(zero),
        F.when(h.isNotNull() & p.isNotNull(), F.coalesce(macd, zero)).otherwise(zero),
        F.coalesce(band, zero),
        F.when(crossed, 1.0).when(F.col("ema_fast").isNotNull(), F.coalesce(ema, zero)).otherwise(zero),
    )
    return clip01(sum(parts, zero) / 4.0)


def trade_signal(rows: DataFrame, cfg: SignalConfig = SignalConfig()) -> DataFrame:
    """Decide every primary candle: one ordered rule chain, no shuffle.

    Expects primary snapshot columns, ``h_*`` of the as-of joined higher candle, ``ofi`` and ``effective_state``.
    """
    long, short, ofi = F.col("_long"), F.col("_short"), F.col("ofi")
    rows = rows.withColumn("_long", primary_gate("LONG", cfg)).withColumn("_short", primary_gate("SHORT", cfg))
    rows = rows.withColumn("_up", higher_confluence("LONG", cfg)).withColumn("_down", higher_confluence("SHORT", cfg))
    failing = F.concat_ws(",", *[F.when(~c, n) for n, c in gate_conditions("LONG", cfg).items()])
    rows = rows.withColumn("_failing", failing)
    reason = (
        F.when(F.col("h_start_ms").isNull(), "missing higher timeframe snapshot")
        .when(F.col("effective_state") == "HALT", "system_state=HALT")
        .when(F.col("effective_state") == "DEGRADED", "system_state=DEGRADED")
        .when(~F.col("is_reliable"), "primary candle not reliable")
        .when(long & (ofi <= cfg.ofi_long), "OFI long gate failed")
        .when(short & (ofi >= cfg.ofi_short), "OFI short gate failed")
        .when(long & (F.col("_up") < 2), "higher timeframe disagreement")
        .when(long, "long signal")
        .when(short & (F.col("_down") < 2), "higher timeframe disagreement")
        .when(short, "short signal")
        .when(F.col("_failing") == "", "primary gate failed")
        .otherwise(F.concat(F.lit("primary gate failed|"), F.col("_failing")))
    )
    rows = rows.withColumn("reason", reason)
    direction = (
        F.when(F.col("reason") == "system_state=HALT", "CLOSE_ALL")
        .when(F.col("reason") == "long signal", "LONG")
        .when(F.col("reason") == "short signal", "SHORT")
        .otherwise("HOLD")
    )
    level = F.when(F.col("direction") == "LONG", F.col("_up")).when(F.col("direction") == "SHORT", F.col("_down"))
    strength = (
        F.when(F.col("direction") == "LONG", signal_strength("LONG", cfg))
        .when(F.col("direction") == "SHORT", signal_strength("SHORT", cfg))
        .otherwise(F.lit(0.0))
    )
    return (
        rows.withColumn("direction", direction)
        .withColumn("confluence", F.when(level == 3, "FULL").when(level == 2, "PARTIAL").otherwise("NONE"))
        .withColumn("signal_strength", strength)
        .drop("_long", "_short", "_up", "_down", "_failing")
    )


def position_size(
    direction: str = "direction", state: str = "effective_state", confluence: str = "confluence",
    strength: str = "signal_strength", cfg: SizingConfig = SizingConfig(),
) -> Column:
    by_state = F.when(F.col(state) == "NORMAL", 1.0).when(F.col(state) == "CONSERVATIVE", cfg.conservative).otherwise(0.0)
    by_level = F.when(F.col(confluence) == "FULL", 1.0).when(F.col(confluence) == "PARTIAL", cfg.partial).otherwise(0.0)
    size = clip01(cfg.base * by_state * by_level * clip01(strength))
    return F.when(F.col(direction) == "HOLD", 0.0).otherwise(size)


def hold_reasons(signals: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Counts per hold reason; a failed primary gate counts once more for each of its failing conditions."""
    held = signals.where(F.col("direction") == "HOLD")
    parts = F.split("reason", r"\|")
    details = F.when(
        F.size(parts) > 1, F.transform(F.split(F.get(parts, F.lit(1)), ","), lambda c: F.concat(F.lit("primary gate: "), c))
    ).otherwise(F.array())
    cells = F.concat(F.array(F.get(parts, F.lit(0))), details)
    return held.select(*keys, F.explode(cells).alias("cause")).groupBy(*keys, "cause").agg(F.count(F.lit(1)).alias("n"))
