"""Candle, indicator and order-flow queries; bars of one and twelve hours."""

from pyspark.sql import functions as F

from tidewatch.operators import anomaly as A
from tidewatch.operators import candles as C
from tidewatch.operators import indicators as I
from tidewatch.workload.anomalies import FEAT_SQL, SIMPLE_SQL, simple
from tidewatch.workload.registry import query
from tidewatch.workload.scalars import r
from tidewatch.workload.ticks import HOUR_MS, LAYOUT, ticks, with_ticks

FRAMES = (HOUR_MS, 12 * HOUR_MS)
BARS_SQL = f"""bars AS MATERIALIZED (
  SELECT *, tick_count >= 3 AND avg_trust >= 0.5 AND max_anomaly <= 0.8 AS is_reliable, tick_count < 3 AS discarded
  FROM (SELECT symbol, timeframe_ms, ts_ms // timeframe_ms * timeframe_ms AS start_ms, ts_ms // timeframe_ms * timeframe_ms + timeframe_ms AS end_ms,
               arg_min(mid, (ts_ms, tick_id)) AS open, max(mid) AS high, min(mid) AS low, arg_max(mid, (ts_ms, tick_id)) AS close,
               sum(greatest(0, volume_24h)) AS volume, count(*) AS tick_count, avg(trust_score) AS avg_trust, max(anomaly_score) AS max_anomaly,
               arg_min(tick_id, (ts_ms, tick_id)) AS first_tick_id, arg_max(tick_id, (ts_ms, tick_id)) AS last_tick_id, min(ts_ms) AS first_ts_ms, max(ts_ms) AS last_ts_ms
        FROM simple, (VALUES ({FRAMES[0]}), ({FRAMES[1]})) f(timeframe_ms) GROUP BY ALL))"""
STREAK_SQL = """streaks AS MATERIALIZED (
  SELECT * EXCLUDE (island), CASE WHEN is_reliable THEN 0 ELSE row_number() OVER (PARTITION BY symbol, timeframe_ms, island ORDER BY start_ms)
         - CAST(island > 0 AS INTEGER) END AS consecutive_unreliable
  FROM (SELECT *, sum(CAST(is_reliable AS INTEGER)) OVER (PARTITION BY symbol, timeframe_ms ORDER BY start_ms) AS island FROM bars))"""
KEPT_SQL = """kept AS MATERIALIZED (
  SELECT *, greatest(close - pc, 0.0) AS gain, greatest(pc - close, 0.0) AS loss,
    CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
    CASE WHEN ph IS NOT NULL THEN CASE WHEN high - ph > pl - low THEN greatest(high - ph, 0.0) ELSE 0.0 END END AS pdm,
    CASE WHEN ph IS NOT NULL THEN CASE WHEN pl - low > high - ph THEN greatest(pl - low, 0.0) ELSE 0.0 END END AS mdm,
    CASE WHEN rn >= 20 THEN avg(close) OVER b END AS bollinger_middle, CASE WHEN rn >= 20 THEN stddev_pop(close) OVER b END AS sd
  FROM (SELECT *, row_number() OVER k AS rn, lag(close) OVER k AS pc, lag(high) OVER k AS ph, lag(low) OVER k AS pl
        FROM bars WHERE NOT discarded WINDOW k AS (PARTITION BY symbol, timeframe_ms ORDER BY start_ms))
  WINDOW b AS (PARTITION BY symbol, timeframe_ms ORDER BY start_ms ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


def smooth_sql(name: str, source: str, value: str, start: int, n: int, gain: str, seed: str = "avg") -> str:
    """A smoothed series as a recursion: the seed over the first n values ending in row ``start``, then one step per row."""
    return f"""{name}_d AS MATERIALIZED (
  SELECT symbol, timeframe_ms, rn, {value} AS x, {seed}({value}) OVER (PARTITION BY symbol, timeframe_ms ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS seed FROM {source}),
{name} AS (
  SELECT symbol, timeframe_ms, rn, seed AS y FROM {name}_d WHERE rn = {start}
  UNION ALL SELECT d.symbol, d.timeframe_ms, d.rn, y + (d.x - y) * {gain} FROM {name} p JOIN {name}_d d ON d.symbol = p.symbol AND d.timeframe_ms = p.timeframe_ms AND d.rn = p.rn + 1)"""


def _ema(name, n, value="close", source="kept", start=None):
    return smooth_sql(name, source, value, start or n, n, f"(2.0::DOUBLE / {n + 1})")


def _wilder(name, n, value, start, seed="avg", source="kept"):
    return smooth_sql(name, source, value, start, n, f"(1.0::DOUBLE / {n})", seed)


# Directional sums start from plain sums and are then divided by n each step, so their step is (s * 13 + x) / 14.
SMOOTH = {
    "ema9": _ema("ema9", 9), "ema21": _ema("ema21", 21), "ema12": _ema("ema12", 12), "ema26": _ema("ema26", 26),
    "ag": _wilder("ag", 14, "gain", 15), "al": _wilder("al", 14, "loss", 15), "atrs": _wilder("atrs", 14, "tr", 14),
    "sp": _wilder("sp", 14, "pdm", 15, "sum"), "sm": _wilder("sm", 14, "mdm", 15, "sum"), "st": _wilder("st", 14, "tr", 15, "sum"),
}
RSI_SQL = """rsis AS MATERIALIZED (SELECT symbol, timeframe_ms, rn, CASE WHEN al.y = 0 THEN CASE WHEN ag.y = 0 THEN 50.0 ELSE 100.0 END
   ELSE 100 - 100 / (1 + ag.y / al.y) END AS rsi FROM ag JOIN al USING (symbol, timeframe_ms, rn))"""
MACD_SQL = ("macds AS MATERIALIZED (SELECT symbol, timeframe_ms, rn, ema12.y - ema26.y AS macd FROM ema12 JOIN ema26 USING (symbol, timeframe_ms, rn))",
            _ema("sig", 9, "macd", "macds", 34))
DX_SQL = ("""dxs AS MATERIALIZED (SELECT symbol, timeframe_ms, rn, CASE WHEN st.y > 0 AND sp.y + sm.y > 0 THEN 100 * abs(100 * sp.y / st.y - 100 * sm.y / st.y)
   / (100 * sp.y / st.y + 100 * sm.y / st.y) ELSE 0.0 END AS dx FROM sp JOIN sm USING (symbol, timeframe_ms, rn) JOIN st USING (symbol, timeframe_ms, rn))""",
          _wilder("adxs", 14, "dx", 28, source="dxs"))
CROSS_SQL = """crosses AS MATERIALIZED (
  SELECT symbol, timeframe_ms, rn, f AS ema_fast, s AS ema_slow, CASE WHEN s IS NULL THEN NULL WHEN f > s THEN 'bullish' WHEN f < s THEN 'bearish' ELSE 'neutral' END AS ema_alignment,
    CASE WHEN f > s AND pf <= ps THEN 'bullish' WHEN f < s AND pf >= ps THEN 'bearish' END AS ema_cross
  FROM (SELECT symbol, timeframe_ms, rn, ema9.y AS f, ema21.y AS s, lag(ema9.y) OVER k AS pf, lag(ema21.y) OVER k AS ps
        FROM ema9 LEFT JOIN ema21 USING (symbol, timeframe_ms, rn) WINDOW k AS (PARTITION BY symbol, timeframe_ms ORDER BY rn)))"""
BASE = (FEAT_SQL, SIMPLE_SQL, BARS_SQL)
SNAP_SQL = """snaps AS MATERIALIZED (
  SELECT k.*, bollinger_middle + 2 * sd AS bollinger_upper, bollinger_middle - 2 * sd AS bollinger_lower, rsi, m.macd, sig.y AS macd_signal, m.macd - sig.y AS macd_histogram,
    c.ema_fast, c.ema_slow, c.ema_alignment, c.ema_cross, atrs.y AS atr, adxs.y AS adx,
    CASE WHEN adxs.y < 25 THEN 'RANGING' WHEN adxs.y < 50 THEN 'TRENDING' WHEN adxs.y IS NOT NULL THEN 'STRONG_TREND' END AS regime
  FROM kept k LEFT JOIN rsis USING (symbol, timeframe_ms, rn) LEFT JOIN macds m USING (symbol, timeframe_ms, rn) LEFT JOIN sig USING (symbol, timeframe_ms, rn)
  LEFT JOIN crosses c USING (symbol, timeframe_ms, rn) LEFT JOIN atrs USING (symbol, timeframe_ms, rn) LEFT JOIN adxs USING (symbol, timeframe_ms, rn))"""
ALL_SMOOTH = (*SMOOTH.values(), RSI_SQL, *MACD_SQL, *DX_SQL, CROSS_SQL, SNAP_SQL)


def bars(spark, sf, frames=FRAMES):
    return C.candles(simple(spark, sf), frames)


def kept(spark, sf):
    return I.prepare(bars(spark, sf).where(~F.col("discarded")).select("symbol", "timeframe_ms", "start_ms", "close", "high", "low"))


BAR_COLS = """symbol, timeframe_ms, start_ms, end_ms, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close,
  round(volume, 4) AS volume, tick_count, round(avg_trust, 8) AS avg_trust, round(max_anomaly, 8) AS max_anomaly"""


def bar_cols(df):
    return df.select("symbol", "timeframe_ms", "start_ms", "end_ms", *[r(F.col(c)).alias(c) for c in ("open", "high", "low", "close")],
                     r(F.col("volume"), 4).alias("volume"), "tick_count", r(F.col("avg_trust")).alias("avg_trust"), r(F.col("max_anomaly")).alias("max_anomaly"))


@query("candles", with_ticks(f"SELECT {BAR_COLS} FROM bars WHERE timeframe_ms = {HOUR_MS}", *BASE))
def candles(spark, sf):
    return bar_cols(bars(spark, sf, (HOUR_MS,)))


@query("candles_multi", with_ticks(f"SELECT {BAR_COLS} FROM bars", *BASE))
def candles_multi(spark, sf):
    return bar_cols(bars(spark, sf))


@query("candle_reliability", with_ticks("SELECT symbol, timeframe_ms, start_ms, is_reliable, discarded FROM bars", *BASE))
def candle_reliability(spark, sf):
    return bars(spark, sf).select("symbol", "timeframe_ms", "start_ms", "is_reliable", "discarded")


@query("unreliable_streak", with_ticks("""
SELECT symbol, timeframe_ms, start_ms, consecutive_unreliable, CASE WHEN consecutive_unreliable >= 5 THEN 'DEGRADED' END AS state_override FROM streaks""",
    *BASE, STREAK_SQL))
def unreliable_streak(spark, sf):
    out = C.unreliable_streak(bars(spark, sf), cfg=C.ReliabilityConfig(override_after=5))
    return out.select("symbol", "timeframe_ms", "start_ms", "consecutive_unreliable", "state_override")


@query("candle_continuity", with_ticks("""
SELECT symbol, timeframe_ms, start_ms, prev AS previous_end_ms,
  CASE WHEN prev IS NULL THEN 'first' WHEN start_ms = prev THEN 'ok' WHEN start_ms < prev THEN 'overlap' ELSE 'gap' END AS continuity
FROM (SELECT *, lag(end_ms) OVER (PARTITION BY symbol, timeframe_ms ORDER BY start_ms) AS prev FROM bars)""", *BASE))
def candle_continuity(spark, sf):
    return C.candle_continuity(bars(spark, sf)).select("symbol", "timeframe_ms", "start_ms", "previous_end_ms", "continuity")


def series(df, *cols, places=7):
    return df.select("symbol", "timeframe_ms", "start_ms", *[r(F.col(c), places).alias(c) for c in cols])


@query("ema", with_ticks("SELECT symbol, timeframe_ms, start_ms, round(y, 7) AS ema FROM kept LEFT JOIN ema12 USING (symbol, timeframe_ms, rn)",
                         *BASE, KEPT_SQL, SMOOTH["ema12"]))
def ema(spark, sf):
    return series(I.ema(kept(spark, sf), 12), "ema")


@query("rsi", with_ticks("SELECT symbol, timeframe_ms, start_ms, round(rsi, 7) AS rsi FROM kept LEFT JOIN rsis USING (symbol, timeframe_ms, rn)",
                         *BASE, KEPT_SQL, SMOOTH["ag"], SMOOTH["al"], RSI_SQL))
def rsi(spark, sf):
    return series(I.rsi(kept(spark, sf)), "rsi")


@query("bollinger", with_ticks("""SELECT symbol, timeframe_ms, start_ms, round(bollinger_middle, 7) AS bollinger_middle,
  round(bollinger_middle + 2 * sd, 7) AS bollinger_upper, round(bollinger_middle - 2 * sd, 7) AS bollinger_lower FROM kept""", *BASE, KEPT_SQL))
def bollinger(spark, sf):
    return series(I.bollinger(kept(spark, sf)), "bollinger_middle", "bollinger_upper", "bollinger_lower")


@query("bollinger_width", with_ticks(
    "SELECT symbol, timeframe_ms, start_ms, round(4 * sd / bollinger_middle, 7) AS bollinger_width FROM kept", *BASE, KEPT_SQL))
def bollinger_width(spark, sf):
    return series(I.bollinger(kept(spark, sf)).withColumn("bollinger_width", I.bollinger_width()), "bollinger_width")


@query("true_range", with_ticks("SELECT symbol, timeframe_ms, start_ms, round(tr, 7) AS true_range FROM kept", *BASE, KEPT_SQL))
def true_range(spark, sf):
    return series(kept(spark, sf).withColumn("true_range", I.true_range()), "true_range")


@query("atr", with_ticks("SELECT symbol, timeframe_ms, start_ms, round(y, 7) AS atr FROM kept LEFT JOIN atrs USING (symbol, timeframe_ms, rn)",
                         *BASE, KEPT_SQL, SMOOTH["atrs"]))
def atr(spark, sf):
    return series(I.atr(kept(spark, sf)), "atr")


@query("macd", with_ticks("""SELECT symbol, timeframe_ms, start_ms, round(macd, 7) + 0.0 AS macd, round(sig.y, 7) + 0.0 AS macd_signal, round(macd - sig.y, 7) + 0.0 AS macd_histogram
FROM kept LEFT JOIN macds USING (symbol, timeframe_ms, rn) LEFT JOIN sig USING (symbol, timeframe_ms, rn)""",
    *BASE, KEPT_SQL, SMOOTH["ema12"], SMOOTH["ema26"], *MACD_SQL))
def macd(spark, sf):
    return series(I.macd(kept(spark, sf)), "macd", "macd_signal", "macd_histogram")


@query("directional_movement", with_ticks(
    "SELECT symbol, timeframe_ms, start_ms, round(pdm, 7) AS plus_dm, round(mdm, 7) AS minus_dm FROM kept", *BASE, KEPT_SQL))
def directional_movement(spark, sf):
    plus, minus = I.directional_movement()
    return series(kept(spark, sf).withColumn("plus_dm", plus).withColumn("minus_dm", minus), "plus_dm", "minus_dm")


@query("adx", with_ticks("SELECT symbol, timeframe_ms, start_ms, round(y, 6) AS adx FROM kept LEFT JOIN adxs USING (symbol, timeframe_ms, rn)",
                         *BASE, KEPT_SQL, SMOOTH["sp"], SMOOTH["sm"], SMOOTH["st"], *DX_SQL))
def adx(spark, sf):
    return series(I.adx(kept(spark, sf)), "adx", places=6)


SNAP_COLS = ("bollinger_middle", "bollinger_upper", "bollinger_lower", "rsi", "macd", "macd_signal", "macd_histogram", "ema_fast", "ema_slow", "atr", "adx")


@query("ema_cross", with_ticks("""SELECT symbol, timeframe_ms, start_ms, ema_alignment, ema_cross FROM kept LEFT JOIN crosses USING (symbol, timeframe_ms, rn)""",
    *BASE, KEPT_SQL, SMOOTH["ema9"], SMOOTH["ema21"], CROSS_SQL))
def ema_cross(spark, sf):
    from tidewatch.plans.scans import over_rows

    both = I.ema(I.ema(kept(spark, sf), 9, out="ema_fast"), 21, out="ema_slow")
    return over_rows(both, C.CANDLES, 1, I.ema_cross_columns).select("symbol", "timeframe_ms", "start_ms", "ema_alignment", "ema_cross")


@query("adx_regime", with_ticks("SELECT symbol, timeframe_ms, start_ms, regime FROM snaps", *BASE, KEPT_SQL, *ALL_SMOOTH))
def adx_regime(spark, sf):
    return I.adx(kept(spark, sf)).select("symbol", "timeframe_ms", "start_ms", I.adx_regime().alias("regime"))


@query("indicator_snapshot", with_ticks(
    f"SELECT symbol, timeframe_ms, start_ms, is_reliable, ema_alignment, ema_cross, regime, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in SNAP_COLS)} FROM snaps",
    *BASE, KEPT_SQL, *ALL_SMOOTH))
def indicator_snapshot(spark, sf):
    return I.indicator_snapshot(bars(spark, sf)).select(
        "symbol", "timeframe_ms", "start_ms", "is_reliable", "ema_alignment", "ema_cross", "regime", *[r(F.col(c), 6).alias(c) for c in SNAP_COLS])


OFI_SQL = """ofis AS MATERIALIZED (
  SELECT *, CASE WHEN buy + sell = 0 THEN 0.0 ELSE (buy - sell) / (buy + sell) END AS ofi
  FROM (SELECT *, coalesce(sum(CASE WHEN mid > pm THEN volume_24h ELSE 0 END) OVER w, 0) AS buy, coalesce(sum(CASE WHEN mid <= pm THEN volume_24h ELSE 0 END) OVER w, 0) AS sell,
               count(*) OVER w AS n
        FROM (SELECT *, lag(mid) OVER (PARTITION BY symbol ORDER BY ts_ms, tick_id) AS pm FROM ticks)
        WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, tick_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)))"""


@query("order_flow_imbalance", with_ticks(
    "SELECT tick_id, round(ofi, 8) + 0.0 AS ofi, round(buy, 4) AS buy_volume, round(sell, 4) AS sell_volume, n AS ofi_ticks FROM ofis", OFI_SQL))
def order_flow_imbalance(spark, sf):
    return C.order_flow_imbalance(ticks(spark, sf), LAYOUT).select(
        "tick_id", r(F.col("ofi")).alias("ofi"), r(F.col("buy_volume"), 4).alias("buy_volume"), r(F.col("sell_volume"), 4).alias("sell_volume"), "ofi_ticks")


@query("ofi_zscore", with_ticks("""
SELECT tick_id, round(CASE WHEN stddev_samp(ofi) OVER w > 1e-12 THEN (ofi - avg(ofi) OVER w) / stddev_samp(ofi) OVER w ELSE 0.0 END, 7) + 0.0 AS ofi_zscore
FROM ofis WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, tick_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""", OFI_SQL))
def ofi_zscore(spark, sf):
    return C.order_flow_imbalance(ticks(spark, sf), LAYOUT).select("tick_id", r(F.col("ofi_zscore"), 7).alias("ofi_zscore"))
