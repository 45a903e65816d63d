"""Technical indicators over candles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewatch.operators.candles import CANDLES
from tidewatch.plans.layout import Layout
from tidewatch.plans.recurrence import Recurrence, recur
from tidewatch.plans.scans import INDEX, Scan, over_rows, running


@dataclass(frozen=True)
class IndicatorConfig:
    rsi: int = 14
    macd_fast: int = 12
    macd_slow: int = 26
    macd_signal: int = 9
    bollinger: int = 20
    bollinger_sd: float = 2.0
    ema_fast: int = 9
    ema_slow: int = 21
    atr: int = 14
    adx: int = 14


def prepare(bars: DataFrame, layout: Layout = CANDLES) -> DataFrame:
    """Number the candles of each key and add the previous close, high and low."""
    out = running(
        bars, layout, **{INDEX: Scan("count"), "_before": Scan("last", F.struct("close", "high", "low"), exclusive=True)}
    )
    for c in ("close", "high", "low"):
        out = out.withColumn(f"prev_{c}", F.col(f"_before.{c}"))
    return out.drop("_before")


def true_range() -> Column:
    wide = F.col("high") - F.col("low")
    return F.when(F.col("prev_close").isNull(), wide).otherwise(
        F.greatest(wide, F.abs(F.col("high") - F.col("prev_close")), F.abs(F.col("low") - F.col("prev_close")))
    )


def directional_movement() -> tuple[Column, Column]:
    """Upward and downward movement; null in the first row."""
    up, down = F.col("high") - F.col("prev_high"), F.col("prev_low") - F.col("low")
    zero = F.lit(0.0)
    return (
        F.when(up.isNotNull(), F.when(up > down, F.greatest(up, zero)).otherwise(zero)),
        F.when(up.isNotNull(), F.when(down > up, F.greatest(down, zero)).otherwise(zero)),
    )


def _drive(w: WindowSpec, value: Column, start: int, n: int, gain: float, total: bool = False) -> Column:
    """Driving term of a smoothed series whose first ``n`` values end in row ``start``: their mean (or sum), then gain * value."""
    frame = w.rowsBetween(-(n - 1), 0)
    seed = F.sum(value).over(frame) if total else F.avg(value).over(frame)
    return F.when(F.col(INDEX) == start, seed).when(F.col(INDEX) > start, value * gain)


def ema_drive(w: WindowSpec, value: Column, n: int, offset: int = 0) -> Column:
    return _drive(w, value, n + offset, n, 2.0 / (n + 1))


def ema_decay(n: int) -> float:
    return 1.0 - 2.0 / (n + 1)


def wilder_drive(w: WindowSpec, value: Column, n: int, offset: int = 0, total: bool = False) -> Column:
    return _drive(w, value, n + offset, n, 1.0 / n, total)


def wilder_decay(n: int) -> float:
    return (n - 1) / n


def ema(prepared: DataFrame, n: int, layout: Layout = CANDLES, *, value: str = "close", out: str = "ema") -> DataFrame:
    driven = over_rows(prepared, layout, n, lambda df, w: df.withColumn("_b", ema_drive(w, F.col(value), n)))
    return recur(driven, layout, **{out: Recurrence("_b", ema_decay(n))}).drop("_b")


def _strength(gain: Column, loss: Column) -> Column:
    return F.when(loss == 0, F.when(gain == 0, 50.0).otherwise(100.0)).otherwise(100.0 - 100.0 / (1.0 + gain / loss))


def gain_loss() -> tuple[Column, Column]:
    move = F.col("close") - F.col("prev_close")
    return F.greatest(move, F.lit(0.0)), F.greatest(-move, F.lit(0.0))


def rsi(prepared: DataFrame, layout: Layout = CANDLES, *, n: int = 14) -> DataFrame:
    gain, loss = gain_loss()

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("_bg", wilder_drive(w, gain, n, 1)).withColumn("_bl", wilder_drive(w, loss, n, 1))

    a = wilder_decay(n)
    out = recur(over_rows(prepared, layout, n, build), layout, _gain=Recurrence("_bg", a), _loss=Recurrence("_bl", a))
    return out.withColumn("rsi", F.when(F.col("_gain").isNotNull(), _strength(F.col("_gain"), F.col("_loss")))).drop(
        "_bg", "_bl", "_gain", "_loss"
    )


def bollinger_columns(df: DataFrame, w: WindowSpec, n: int = 20, k: float = 2.0) -> DataFrame:
    frame = w.rowsBetween(-(n - 1), 0)
    full = F.col(INDEX) >= n
    mid, sd = F.avg("close").over(frame), F.stddev_pop("close").over(frame)
    return (
        df.withColumn("bollinger_middle", F.when(full, mid))
        .withColumn("bollinger_upper", F.when(full, mid + sd * k))
        .withColumn("bollinger_lower", F.when(full, mid - sd * k))
    )


def bollinger(prepared: DataFrame, layout: Layout = CANDLES, *, n: int = 20, k: float = 2.0) -> DataFrame:
    return over_rows(prepared, layout, n, lambda df, w: bollinger_columns(df, w, n, k))


def bollinger_width() -> Column:
    width = (F.col("bollinger_upper") - F.col("bollinger_lower")) / F.col("bollinger_middle")
    return F.when(F.col("bollinger_middle") > 0, width)


def atr(prepared: DataFrame, layout: Layout = CANDLES, *, n: int = 14) -> DataFrame:
    driven = over_rows(prepared, layout, n, lambda df, w: df.withColumn("_b", wilder_drive(w, true_range(), n)))
    return recur(driven, layout, atr=Recurrence("_b", wilder_decay(n))).drop("_b")


def macd(prepared: DataFrame, layout: Layout = CANDLES, cfg: IndicatorConfig = IndicatorConfig()) -> DataFrame:
    def first(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("_bf", ema_drive(w, F.col("close"), cfg.macd_fast)).withColumn(
            "_bs", ema_drive(w, F.col("close"), cfg.macd_slow))

    lines = recur(
        over_rows(prepared, layout, cfg.macd_slow, first), layout,
        _fast=Recurrence("_bf", ema_decay(cfg.macd_fast)), _slow=Recurrence("_bs", ema_decay(cfg.macd_slow)),
    ).withColumn("macd", F.col("_fast") - F.col("_slow"))

    def second(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("_b", ema_drive(w, F.col("macd"), cfg.macd_signal, cfg.macd_slow - 1))

    out = recur(over_rows(lines, layout, cfg.macd_signal, second), layout, macd_signal=Recurrence("_b", ema_decay(cfg.macd_signal)))
    return out.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal")).drop("_bf", "_bs", "_fast", "_slow", "_b")


def directional_index() -> Column:
    """DX from the smoothed movement sums; null before they exist."""
    tr = F.col("_tr")
    plus = F.when(tr > 0, 100.0 * F.col("_pdm") / tr).otherwise(F.lit(0.0))
    minus = F.when(tr > 0, 100.0 * F.col("_mdm") / tr).otherwise(F.lit(0.0))
    both = F.when(plus + minus > 0, plus + minus).otherwise(F.lit(1.0))
    return F.when(tr.isNotNull(), 100.0 * F.abs(plus - minus) / both)


def adx(prepared: DataFrame, layout: Layout = CANDLES, *, n: int = 14) -> DataFrame:
    plus, minus = directional_movement()

    def first(df: DataFrame, w: WindowSpec) -> DataFrame:
        for name, value in (("_bp", plus), ("_bm", minus), ("_bt", true_range())):
            df = df.withColumn(name, wilder_drive(w, value, n, 1, total=True))
        return df

    a = wilder_decay(n)
    sums = recur(
        over_rows(prepared, layout, n, first), layout,
        _pdm=Recurrence("_bp", a), _mdm=Recurrence("_bm", a), _tr=Recurrence("_bt", a),
    ).withColumn("dx", directional_index())
    driven = over_rows(sums, layout, n, lambda df, w: df.withColumn("_b", wilder_drive(w, F.col("dx"), n, n)))
    return recur(driven, layout, adx=Recurrence("_b", a)).drop("_bp", "_bm", "_bt", "_pdm", "_mdm", "_tr", "_b")


def ema_cross_columns(df: DataFrame, w: WindowSpec) -> DataFrame:
    """Alignment of the two averages and the side they changed to in this candle."""
    fast, slow = F.col("ema_fast"), F.col("ema_slow")
    was_fast, was_slow = F.lag("ema_fast").over(w), F.lag("ema_slow").over(w)
    ready = fast.isNotNull() & slow.isNotNull()
    return df.withColumn(
        "ema_alignment",
        F.when(ready & (fast > slow), "bullish").when(ready & (fast < slow), "bearish").when(ready, "neutral"),
    ).withColumn(
        "ema_cross",
        F.when(ready & (fast > slow) & (was_fast <= was_slow), "bullish").when(
            ready & (fast < slow) & (was_fast >= was_slow), "bearish"),
    )


def adx_regime(value: str = "adx") -> Column:
    x = F.col(value)
    return F.when(x < 25, "RANGING").when(x < 50, "TRENDING").when(x.isNotNull(), "STRONG_TREND")


def indicator_snapshot(bars: DataFrame, layout: Layout = CANDLES, cfg: IndicatorConfig = IndicatorConfig()) -> DataFrame:
    """All indicators for every candle that is not discarded: two frame passes, two recurrence passes."""
    kept = bars.where(~F.col("discarded")) if "discarded" in bars.columns else bars
    gain, loss = gain_loss()
    plus, minus = directional_movement()
    close = F.col("close")
    drives = {
        "ema_fast": (lambda w: ema_drive(w, close, cfg.ema_fast), ema_decay(cfg.ema_fast)),
        "ema_slow": (lambda w: ema_drive(w, close, cfg.ema_slow), ema_decay(cfg.ema_slow)),
        "_fast": (lambda w: ema_drive(w, close, cfg.macd_fast), ema_decay(cfg.macd_fast)),
        "_slow": (lambda w: ema_drive(w, close, cfg.macd_slow), ema_decay(cfg.macd_slow)),
        "_gain": (lambda w: wilder_drive(w, gain, cfg.rsi, 1), wilder_decay(cfg.rsi)),
        "_loss": (lambda w: wilder_drive(w, loss, cfg.rsi, 1), wilder_decay(cfg.rsi)),
        "atr": (lambda w: wilder_drive(w, true_range(), cfg.atr), wilder_decay(cfg.atr)),
        "_pdm": (lambda w: wilder_drive(w, plus, cfg.adx, 1, True), wilder_decay(cfg.adx)),
        "_mdm": (lambda w: wilder_drive(w, minus, cfg.adx, 1, True), wilder_decay(cfg.adx)),
        "_tr": (lambda w: wilder_drive(w, true_range(), cfg.adx, 1, True), wilder_decay(cfg.adx)),
    }
    reach = max(cfg.macd_slow, cfg.ema_slow, cfg.bollinger, cfg.rsi, cfg.atr, cfg.adx) + 1

    def first(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = bollinger_columns(df, w, cfg.bollinger, cfg.bollinger_sd)
        return df.select("*", *[make(w).alias(f"_b{n}") for n, (make, _) in drives.items()])

    smooth = recur(
        over_rows(prepare(kept, layout), layout, reach, first), layout,
        **{n: Recurrence(f"_b{n}", a) for n, (_, a) in drives.items()},
    )
    smooth = (
        smooth.withColumn("rsi", F.when(F.col("_gain").isNotNull(), _strength(F.col("_gain"), F.col("_loss"))))
        .withColumn("macd", F.col("_fast") - F.col("_slow"))
        .withColumn("_dx", directional_index())
        .drop("_gain", "_loss", "_fast", "_slow", "_pdm", "_mdm", "_tr", *[f"_b{n}" for n in drives])
    )

    def second(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = ema_cross_columns(df, w)
        return df.withColumn("_bsig", ema_drive(w, F.col("macd"), cfg.macd_signal, cfg.macd_slow - 1)).withColumn(
            "_badx", wilder_drive(w, F.col("_dx"), cfg.adx, cfg.adx))

    out = recur(
        over_rows(smooth, layout, max(cfg.macd_signal, cfg.adx) + 1, second), layout,
        macd_signal=Recurrence("_bsig", ema_decay(cfg.macd_signal)), adx=Recurrence("_badx", wilder_decay(cfg.adx)),
    )
    return (
        out.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))
        .withColumn("regime", adx_regime())
        .withColumn("bollinger_width", bollinger_width())
        .drop("_bsig", "_badx", "_dx", "prev_close", "prev_high", "prev_low")
    )
