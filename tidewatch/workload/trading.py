"""Signal, sizing and risk queries: signals on one- and twelve-hour bars, risk rows out of ``lineitem`` and ``orders``."""

from pyspark.sql import functions as F

from tidewatch.operators import anomaly as A
from tidewatch.operators import candles as C
from tidewatch.operators import indicators as I
from tidewatch.operators import risk as R
from tidewatch.operators import signals as S
from tidewatch.plans.layout import Layout
from tidewatch.plans.store import materialise
from tidewatch.workload.anomalies import gate_sql, simple
from tidewatch.workload.bars import ALL_SMOOTH, BASE, FRAMES, KEPT_SQL, OFI_SQL, STREAK_SQL
from tidewatch.workload.registry import query
from tidewatch.workload.scalars import r
from tidewatch.workload.ticks import HOUR_MS, LAYOUT, table, with_ticks

CFG = S.SignalConfig(
    normal_rsi_long=48.0, normal_rsi_short=52.0, conservative_rsi_long=45.0, conservative_rsi_short=55.0, ofi_long=-0.30, ofi_short=0.30,
    long_rsi_max=48.0, short_rsi_min=52.0)
RELIABLE = C.ReliabilityConfig(override_after=5)

CLOSED_SQL = """closed AS MATERIALIZED (
  SELECT s.*, coalesce(lead(first_ts_ms) OVER k, last_ts_ms + 1) AS close_ts_ms, coalesce(lead(first_tick_id) OVER k, last_tick_id) AS close_tick_id,
         CASE WHEN consecutive_unreliable >= 5 THEN 'DEGRADED' END AS state_override
  FROM streaks s WINDOW k AS (PARTITION BY symbol, timeframe_ms ORDER BY start_ms))"""
PRIM_SQL = f"""ext AS MATERIALIZED (
  SELECT s.*, c.close_ts_ms, c.close_tick_id, c.state_override, lag(macd_histogram) OVER k AS prev_histogram,
         coalesce(bool_or(ema_cross = 'bullish') OVER (k ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), false) AS crossed_up,
         coalesce(bool_or(ema_cross = 'bearish') OVER (k ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), false) AS crossed_down
  FROM snaps s JOIN closed c USING (symbol, timeframe_ms, start_ms) WINDOW k AS (PARTITION BY s.symbol, s.timeframe_ms ORDER BY s.start_ms)),
joined AS MATERIALIZED (
  SELECT p.*, h.start_ms AS h_start_ms, h.rsi AS h_rsi, h.macd_histogram AS h_histogram, h.prev_histogram AS h_prev_histogram, h.bollinger_middle AS h_middle,
         h.close AS h_close, h.is_reliable AS h_reliable
  FROM (SELECT * FROM ext WHERE timeframe_ms = {FRAMES[0]}) p ASOF LEFT JOIN (SELECT * FROM ext WHERE timeframe_ms = {FRAMES[1]}) h
    ON p.symbol = h.symbol AND p.close_ts_ms > h.close_ts_ms),
inputs AS MATERIALIZED (
  SELECT j.*, o.ofi, g.system_state, g.trust_score, coalesce(j.state_override, g.system_state) AS state
  FROM joined j JOIN ofis o ON o.tick_id = j.close_tick_id JOIN gated g ON g.tick_id = j.close_tick_id)"""


def _side(side: str) -> dict[str, str]:
    up = side == "LONG"
    lt, gt, cmp_ = ("<", ">", "<=") if up else (">", "<", ">=")
    rsi = ("45.0", "48.0") if up else ("55.0", "52.0")
    band = "bollinger_lower * 1.01" if up else "bollinger_upper * 0.99"
    return {
        "rsi_ok": f"coalesce(rsi {lt} CASE WHEN state = 'CONSERVATIVE' THEN {rsi[0]} ELSE {rsi[1]} END, false)",
        "macd_ok": f"coalesce((macd_histogram {gt} 0 AND macd_histogram {gt} prev_histogram) OR (prev_histogram {lt} 0 AND macd_histogram {gt}= 0), false)",
        "bollinger_ok": f"coalesce(close {cmp_} {band}, false)",
        "ema_ok": f"({'crossed_up' if up else 'crossed_down'} OR coalesce(abs(ema_fast - ema_slow) / abs(ema_slow) <= 0.005, false))",
    }


def _conf(side: str) -> str:
    lt, gt, lim = ("<", ">", "55.0") if side == "LONG" else (">", "<", "45.0")
    return (f"CAST(coalesce(h_rsi {lt} {lim}, false) AS INTEGER) + CAST(coalesce(h_histogram {gt} 0 OR (h_prev_histogram {lt} 0 AND h_histogram {gt}= 0), false) AS INTEGER)"
            f" + CAST(coalesce(h_close {lt} h_middle, false) AS INTEGER)")


def _clip(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def _strength(side: str) -> str:
    up = side == "LONG"
    rsi = _clip("(48.0 - rsi) / 28.0") if up else _clip("(rsi - 52.0) / 28.0")
    grow = "macd_histogram > 0 AND macd_histogram > prev_histogram" if up else "macd_histogram < 0 AND macd_histogram < prev_histogram"
    band = _clip("((bollinger_lower - close) / bollinger_lower + 0.01) / 0.02") if up else _clip("((close - bollinger_upper) / bollinger_upper + 0.01) / 0.02")
    crossed = "crossed_up" if up else "crossed_down"
    return _clip(f"""((CASE WHEN rsi IS NULL THEN 0 ELSE {rsi} END)
      + (CASE WHEN {grow} THEN {_clip('abs(macd_histogram - prev_histogram) / (abs(macd_histogram) + abs(prev_histogram))')} ELSE 0 END)
      + (CASE WHEN bollinger_lower IS NULL THEN 0 ELSE {band} END)
      + (CASE WHEN {crossed} THEN 1.0 WHEN ema_slow IS NULL THEN 0 ELSE {_clip('1 - abs(ema_fast - ema_slow) / abs(ema_slow) / 0.005')} END)) / 4""")


L, H = _side("LONG"), _side("SHORT")
SIGNAL_SQL = f"""decided AS MATERIALIZED (
  SELECT *, CASE WHEN h_start_ms IS NULL THEN 'missing higher timeframe snapshot' WHEN state = 'HALT' THEN 'system_state=HALT' WHEN state = 'DEGRADED' THEN 'system_state=DEGRADED'
      WHEN NOT is_reliable THEN 'primary candle not reliable' WHEN lg AND ofi <= -0.30 THEN 'OFI long gate failed' WHEN sg AND ofi >= 0.30 THEN 'OFI short gate failed'
      WHEN lg AND up < 2 THEN 'higher timeframe disagreement' WHEN lg THEN 'long signal' WHEN sg AND down < 2 THEN 'higher timeframe disagreement' WHEN sg THEN 'short signal'
      WHEN failing = '' THEN 'primary gate failed' ELSE 'primary gate failed|' || failing END AS reason
  FROM (SELECT *, {' AND '.join(L.values())} AS lg, {' AND '.join(H.values())} AS sg, {_conf('LONG')} AS up, {_conf('SHORT')} AS down,
               {_strength('LONG')} AS ls, {_strength('SHORT')} AS ss,
               concat_ws(',', {', '.join(f"CASE WHEN NOT {c} THEN '{n}' END" for n, c in L.items())}) AS failing FROM inputs)),
signals AS MATERIALIZED (
  SELECT *, CASE WHEN direction = 'HOLD' THEN 0.0 ELSE {_clip("0.20 * (CASE state WHEN 'NORMAL' THEN 1.0 WHEN 'CONSERVATIVE' THEN 0.5 ELSE 0 END) * (CASE confluence WHEN 'FULL' THEN 1.0 WHEN 'PARTIAL' THEN 0.5 ELSE 0 END) * strength")} END AS size_pct
  FROM (SELECT *, CASE direction WHEN 'LONG' THEN CASE up WHEN 3 THEN 'FULL' ELSE 'PARTIAL' END WHEN 'SHORT' THEN CASE down WHEN 3 THEN 'FULL' ELSE 'PARTIAL' END ELSE 'NONE' END AS confluence,
               CASE direction WHEN 'LONG' THEN ls WHEN 'SHORT' THEN ss ELSE 0.0 END AS strength
        FROM (SELECT *, CASE reason WHEN 'system_state=HALT' THEN 'CLOSE_ALL' WHEN 'long signal' THEN 'LONG' WHEN 'short signal' THEN 'SHORT' ELSE 'HOLD' END AS direction FROM decided)))"""
INPUTS = (*BASE, STREAK_SQL, CLOSED_SQL, KEPT_SQL, *ALL_SMOOTH, OFI_SQL, gate_sql("simple"), PRIM_SQL)
ALL = (*INPUTS, SIGNAL_SQL)


def inputs(spark, sf):
    ticks = simple(spark, sf)
    bars = materialise(C.with_close(C.unreliable_streak(C.candles(ticks, FRAMES), cfg=RELIABLE)))
    snaps = materialise(S.primary_columns(I.indicator_snapshot(bars), cfg=CFG).drop("_rn"))
    primary = snaps.where(F.col("timeframe_ms") == FRAMES[0])
    higher = snaps.where(F.col("timeframe_ms") == FRAMES[1])
    joined = S.higher_timeframe_asof(primary, higher.select(
        "symbol", "close_ts_ms", "start_ms", "rsi", "macd_histogram", "prev_histogram", "bollinger_middle", "close", "is_reliable"))
    flow = C.order_flow_imbalance(ticks, LAYOUT).withColumn("base_state", A.gate_base_state())
    states = A.decision_gate(flow.select("symbol", "ts_ms", "tick_id", "ofi", "trust_score", "base_state"), LAYOUT)
    return S.signal_ofi_asof(joined, states).withColumn("effective_state", S.effective_state())


def signals(spark, sf):
    return S.trade_signal(inputs(spark, sf), CFG).withColumn("size_pct", S.position_size())


KEY = ("symbol", "start_ms")


@query("higher_timeframe_asof", with_ticks("SELECT symbol, start_ms, h_start_ms, round(h_rsi, 6) AS h_rsi FROM inputs", *INPUTS))
def higher_timeframe_asof(spark, sf):
    return inputs(spark, sf).select(*KEY, "h_start_ms", r(F.col("h_rsi"), 6).alias("h_rsi"))


@query("signal_ofi_asof", with_ticks("SELECT symbol, start_ms, close_tick_id, round(ofi, 8) + 0.0 AS ofi FROM inputs", *INPUTS))
def signal_ofi_asof(spark, sf):
    return inputs(spark, sf).select(*KEY, "close_tick_id", r(F.col("ofi")).alias("ofi"))


@query("effective_state", with_ticks("SELECT symbol, start_ms, state AS effective_state FROM inputs", *INPUTS))
def effective_state(spark, sf):
    return inputs(spark, sf).select(*KEY, "effective_state")


@query("primary_gate", with_ticks("SELECT symbol, start_ms, lg AS long_gate, sg AS short_gate FROM decided", *ALL))
def primary_gate(spark, sf):
    return inputs(spark, sf).select(*KEY, S.primary_gate("LONG", CFG).alias("long_gate"), S.primary_gate("SHORT", CFG).alias("short_gate"))


@query("higher_confluence", with_ticks("SELECT symbol, start_ms, up AS long_count, down AS short_count FROM decided", *ALL))
def higher_confluence(spark, sf):
    return inputs(spark, sf).select(*KEY, S.higher_confluence("LONG", CFG).alias("long_count"), S.higher_confluence("SHORT", CFG).alias("short_count"))


@query("signal_strength", with_ticks("SELECT symbol, start_ms, round(ls, 7) AS long_strength, round(ss, 7) AS short_strength FROM decided", *ALL))
def signal_strength(spark, sf):
    return inputs(spark, sf).select(
        *KEY, r(S.signal_strength("LONG", CFG), 7).alias("long_strength"), r(S.signal_strength("SHORT", CFG), 7).alias("short_strength"))


@query("trade_signal", with_ticks("SELECT symbol, start_ms, direction, confluence, reason, round(strength, 7) AS signal_strength FROM signals", *ALL))
def trade_signal(spark, sf):
    return signals(spark, sf).select(*KEY, "direction", "confluence", "reason", r(F.col("signal_strength"), 7).alias("signal_strength"))


@query("position_size", with_ticks("SELECT symbol, start_ms, round(size_pct, 8) AS size_pct FROM signals", *ALL))
def position_size(spark, sf):
    return signals(spark, sf).select(*KEY, r(F.col("size_pct")).alias("size_pct"))


@query("hold_reasons", with_ticks("""
SELECT symbol, cause, count(*) AS n FROM (
  SELECT symbol, split_part(reason, '|', 1) AS cause FROM signals WHERE direction = 'HOLD'
  UNION ALL SELECT symbol, 'primary gate: ' || unnest(string_split(split_part(reason, '|', 2), ',')) FROM signals WHERE direction = 'HOLD' AND contains(reason, '|'))
GROUP BY ALL""", *ALL))
def hold_reasons(spark, sf):
    return S.hold_reasons(signals(spark, sf))


# ------------------------------------------------------------------------------------------------- risk rows

RISK_IN = """rin AS (
  SELECT l_orderkey, l_linenumber, 'S' || (l_suppkey % 4) AS symbol,
    CASE WHEN l_partkey % 13 = 0 THEN 'CLOSE_ALL' WHEN l_partkey % 13 = 1 THEN 'HOLD' WHEN l_returnflag = 'R' THEN 'SHORT' ELSE 'LONG' END AS direction,
    l_discount * 3.0::DOUBLE AS size_pct, CASE l_partkey % 11 WHEN 0 THEN 'HALT' WHEN 1 THEN 'DEGRADED' WHEN 2 THEN 'CONSERVATIVE' ELSE 'NORMAL' END AS system_state,
    0.3::DOUBLE + l_tax * 8.0::DOUBLE AS trust_score, CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_quantity / 5.0::DOUBLE END AS atr,
    CASE WHEN l_partkey % 29 = 0 THEN 0.0::DOUBLE ELSE l_extendedprice / 500.0::DOUBLE END AS price, (l_suppkey % 65) / 100.0::DOUBLE AS exposure,
    CASE l_orderkey % 7 WHEN 0 THEN 'HALTED' WHEN 1 THEN 'REDUCED' WHEN 2 THEN 'REDUCED' ELSE 'NORMAL' END AS breaker,
    CASE WHEN l_orderkey % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS last_loss FROM lineitem),
rsz AS (
  SELECT *, CASE WHEN base * unit > 0.02 THEN base * 0.02 / (base * unit) ELSE base END AS size, base * unit > 0.02 AS capped
  FROM (SELECT *, least(size_pct, 0.20) * CASE WHEN breaker = 'REDUCED' THEN 0.5 ELSE 1.0 END AS base, CASE WHEN price > 0 THEN abs(1.5 * atr) / price END AS unit FROM rin)),
rdec AS MATERIALIZED (
  SELECT *, CASE WHEN direction = 'HOLD' THEN 'hold signal' WHEN breaker = 'HALTED' THEN 'circuit breaker halted' WHEN system_state = 'HALT' THEN 'upstream system_state=HALT'
    WHEN system_state = 'DEGRADED' AND direction <> 'CLOSE_ALL' THEN 'upstream system_state=DEGRADED' WHEN direction <> 'CLOSE_ALL' AND trust_score < 0.40 THEN 'trust floor breached'
    WHEN direction = 'CLOSE_ALL' THEN NULL WHEN atr IS NULL OR atr <= 0 THEN 'missing atr' WHEN price <= 0 THEN 'invalid reference price'
    WHEN breaker = 'REDUCED' AND last_loss = direction THEN 'reduced state blocks same-direction trades' WHEN exposure + size > 0.60 THEN 'portfolio exposure cap breached'
    WHEN size <= 0 THEN 'non-positive approved size' END AS reject,
    CASE WHEN direction = 'CLOSE_ALL' THEN 'close all' ELSE concat_ws('; ', CASE WHEN size_pct > 0.20 THEN 'position size capped at 20%' END,
      CASE WHEN breaker = 'REDUCED' THEN 'reduced state size cut by 50%' END, CASE WHEN capped THEN 'per-trade loss resized to 2% cap' END) END AS notes FROM rsz)"""


def risk_rows(spark, sf):
    part, sup, order = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    state = F.when(part % 11 == 0, "HALT").when(part % 11 == 1, "DEGRADED").when(part % 11 == 2, "CONSERVATIVE").otherwise("NORMAL")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("S"), (sup % 4).cast("string")).alias("symbol"),
        F.when(part % 13 == 0, "CLOSE_ALL").when(part % 13 == 1, "HOLD").when(F.col("l_returnflag") == "R", "SHORT").otherwise("LONG").alias("direction"),
        (F.col("l_discount") * 3.0).alias("size_pct"), state.alias("system_state"), (0.3 + F.col("l_tax") * 8.0).alias("trust_score"),
        F.when(part % 17 != 0, F.col("l_quantity") / 5.0).alias("atr"),
        F.when(part % 29 == 0, 0.0).otherwise(F.col("l_extendedprice") / 500.0).alias("reference_price"), ((sup % 65) / 100.0).alias("exposure_pct"),
        F.when(order % 7 == 0, "HALTED").when((order % 7).isin(1, 2), "REDUCED").otherwise("NORMAL").alias("breaker_state"),
        F.when(order % 2 == 0, "LONG").otherwise("SHORT").alias("last_loss_direction"))


def decisions(spark, sf):
    return R.risk_checks(risk_rows(spark, sf))


IDS = ("l_orderkey", "l_linenumber")


def with_risk(body):
    return f"WITH {RISK_IN}\n{body}"


@query("stop_levels", with_risk("""SELECT l_orderkey, l_linenumber, round(price - CASE direction WHEN 'LONG' THEN 1.5 ELSE -1.5 END * atr, 6) AS stop_loss,
  round(price + CASE direction WHEN 'LONG' THEN 2.5 ELSE -2.5 END * atr, 6) AS take_profit FROM rin WHERE direction IN ('LONG', 'SHORT') AND atr IS NOT NULL"""))
def stop_levels(spark, sf):
    stop, target = R.stop_levels(F.col("direction"), F.col("reference_price"), F.col("atr"))
    rows = risk_rows(spark, sf).where(F.col("direction").isin("LONG", "SHORT") & F.col("atr").isNotNull())
    return rows.select(*IDS, r(stop, 6).alias("stop_loss"), r(target, 6).alias("take_profit"))


@query("risk_checks", with_risk("""
SELECT l_orderkey, l_linenumber, reject IS NULL AS approved, coalesce(reject, CASE WHEN direction = 'CLOSE_ALL' THEN 'approved close all' WHEN notes = '' THEN 'approved' ELSE notes END) AS reason,
  round(CASE WHEN reject IS NULL THEN CASE WHEN direction = 'CLOSE_ALL' THEN greatest(0.0, least(exposure, 0.60)) ELSE size END END, 12) AS approved_size,
  CASE WHEN reject IS NULL THEN notes END AS adjustments FROM rdec"""))
def risk_checks(spark, sf):
    return decisions(spark, sf).select(*IDS, "approved", "reason", r(F.col("approved_size"), 12).alias("approved_size"),
                                       F.when(F.col("approved"), F.concat_ws("; ", "adjustments")).alias("adjustments"))


@query("close_all", with_risk("SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(exposure, 0.60)), 8) AS size_pct FROM rin WHERE direction = 'CLOSE_ALL'"))
def close_all(spark, sf):
    return risk_rows(spark, sf).where(F.col("direction") == "CLOSE_ALL").select(*IDS, r(R.close_all(F.col("exposure_pct"))).alias("size_pct"))


@query("risk_telemetry", with_risk("""
SELECT symbol, count(*) FILTER (breaker = 'NORMAL') AS state_normal, count(*) FILTER (breaker = 'REDUCED') AS state_reduced, count(*) FILTER (breaker = 'HALTED') AS state_halted,
  count(*) FILTER (reject IS NULL) AS approved_orders, count(reject) AS rejected_orders FROM rdec GROUP BY symbol"""))
def risk_telemetry(spark, sf):
    return R.risk_telemetry(decisions(spark, sf))


@query("reject_reasons", with_risk("SELECT symbol, reject AS reason, count(*) AS n FROM rdec WHERE reject IS NOT NULL GROUP BY ALL"))
def reject_reasons(spark, sf):
    return R.reject_reasons(decisions(spark, sf))


@query("limit_violations", with_risk("""
SELECT symbol, CASE WHEN contains(reject, 'trust floor') THEN 'trust_floor' ELSE 'exposure_cap' END AS violation, count(*) AS n FROM rdec
WHERE contains(reject, 'trust floor') OR contains(reject, 'exposure') GROUP BY ALL"""))
def limit_violations(spark, sf):
    return R.limit_violations(decisions(spark, sf))


@query("reference_price", """
SELECT l_orderkey, l_linenumber, round(coalesce(CASE WHEN l_partkey % 3 > 0 THEN l_extendedprice END, CASE WHEN l_partkey % 5 > 0 THEN l_quantity END, 0.0), 4) AS reference_price,
  round(coalesce(CASE WHEN l_partkey % 7 > 0 THEN l_extendedprice END, CASE WHEN l_partkey % 2 > 0 THEN l_tax END, l_quantity), 4) AS consensus_price FROM lineitem""")
def reference_price(spark, sf):
    p = F.col("l_partkey")
    rows = table(spark, sf, "lineitem").select(
        *IDS, F.when(p % 3 > 0, F.col("l_extendedprice")).alias("close"), F.when(p % 5 > 0, F.col("l_quantity")).alias("entry_price"),
        F.when(p % 7 > 0, F.col("l_extendedprice")).alias("consensus_mid"), F.when(p % 2 > 0, F.col("l_tax")).alias("mid"), "l_quantity")
    return rows.select(*IDS, r(R.reference_price(), 4).alias("reference_price"), r(R.consensus_price(entry="l_quantity"), 4).alias("consensus_price"))


# Portfolio equity: profits in millionths, so that sums are exact on every engine.
EQUITY_SQL = """eq AS MATERIALIZED (
  SELECT *, 1 + sum(pnl_u) OVER (PARTITION BY portfolio ORDER BY ts_ms, event_id) / 1000000.0::DOUBLE AS equity
  FROM (SELECT 'P' || (o_custkey % 300) AS portfolio, epoch_us(o_orderdate) // 1000 AS ts_ms, o_orderkey AS event_id, (o_orderkey * 7919) % 8001 - 4000 AS pnl_u FROM orders))"""
PORTFOLIO = Layout(keys=("portfolio",), order=("ts_ms", "event_id"), slot_ms=86_400_000)


def trades(spark, sf):
    return table(spark, sf, "orders").select(
        F.concat(F.lit("P"), (F.col("o_custkey") % 300).cast("string")).alias("portfolio"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"), F.col("o_orderkey").alias("event_id"),
        ((F.col("o_orderkey") * 7919) % 8001 - 4000).alias("pnl_u"))


def equity(spark, sf):
    from tidewatch.plans.scans import Scan, running

    out = running(trades(spark, sf), PORTFOLIO, _sum=Scan("sum", F.col("pnl_u")))
    return out.withColumn("equity", 1 + F.col("_sum") / 1_000_000.0).drop("_sum")


@query("drawdown", f"""WITH {EQUITY_SQL}
SELECT event_id, round(equity, 8) AS equity, round(greatest(0.0, (peak - equity) / peak), 8) AS drawdown_pct
FROM (SELECT *, greatest(1.0, max(equity) OVER (PARTITION BY portfolio ORDER BY ts_ms, event_id)) AS peak FROM eq)""")
def drawdown(spark, sf):
    return R.drawdown(equity(spark, sf), PORTFOLIO).select("event_id", r(F.col("equity")).alias("equity"), r(F.col("drawdown_pct")).alias("drawdown_pct"))


@query("daily_loss_halt", f"""WITH {EQUITY_SQL}
SELECT event_id, bool_or(equity <= 0.98::DOUBLE) OVER (PARTITION BY portfolio ORDER BY ts_ms, event_id) AS daily_loss_halted FROM eq""")
def daily_loss_halt(spark, sf):
    return R.daily_loss_halt(equity(spark, sf), PORTFOLIO, limit=0.02).select("event_id", "daily_loss_halted")


@query("loss_streak", f"""WITH {EQUITY_SQL}
SELECT event_id, CASE WHEN pnl_u >= 0 THEN 0 ELSE row_number() OVER (PARTITION BY portfolio, island, pnl_u >= 0 ORDER BY ts_ms, event_id) END AS losing_streak
FROM (SELECT *, sum(CAST(pnl_u >= 0 AS INTEGER)) OVER (PARTITION BY portfolio ORDER BY ts_ms, event_id) AS island FROM eq)""")
def loss_streak(spark, sf):
    return R.loss_streak(trades(spark, sf), PORTFOLIO, value="pnl_u").select("event_id", "losing_streak")


def observed(spark, sf):
    obs = equity(spark, sf).withColumn("upstream_state", F.when(F.col("event_id") % 40 == 0, "HALT").otherwise("NORMAL"))
    return R.risk_breaker(obs.withColumn("pnl", F.col("pnl_u") / 1_000_000.0), PORTFOLIO)


# Peak, fall and daily limit do not depend on the breaker; its state, pause, losses and calm rows are a recursion over row numbers.
BREAKER_SQL = f"""WITH RECURSIVE {EQUITY_SQL},
seen AS MATERIALIZED (
  SELECT *, greatest(0, (peak - equity) / peak) AS fall, event_id % 40 = 0 AS upstream_halt FROM (
    SELECT *, row_number() OVER w AS rn, greatest(1.0::DOUBLE, max(equity) OVER w) AS peak, bool_or(equity <= 1.0::DOUBLE - 0.08::DOUBLE) OVER w AS halted
    FROM eq WINDOW w AS (PARTITION BY portfolio ORDER BY ts_ms, event_id))),
breaker AS (
  SELECT portfolio, 0::BIGINT AS rn, 0::BIGINT AS event_id, 'NORMAL' AS state, '' AS reason, CAST(NULL AS BIGINT) AS until, 0 AS losses, 0 AS calm FROM (SELECT DISTINCT portfolio FROM seen)
  UNION ALL
  SELECT portfolio, rn, event_id,
    CASE WHEN halted OR upstream_halt THEN 'HALTED' WHEN recovers THEN 'NORMAL' WHEN losses >= 5 THEN 'HALTED' WHEN hit THEN 'REDUCED' ELSE 'NORMAL' END,
    CASE WHEN halted THEN 'daily_loss_limit' WHEN upstream_halt THEN 'upstream_halt' WHEN recovers THEN 'recovered' WHEN losses >= 5 THEN 'loss_streak_pause'
         WHEN losses >= 3 THEN 'loss_streak_reduced' WHEN hit THEN 'drawdown_reduced' ELSE 'normal' END,
    CASE WHEN recovers THEN NULL WHEN starts THEN ts_ms + 1800000 ELSE until END, CASE WHEN recovers THEN 0 ELSE losses END, CASE WHEN recovers THEN 0 ELSE calm END
  FROM (SELECT *, NOT halted AND NOT upstream_halt AND calm >= 10 AND NOT starts AND (hit OR was <> 'NORMAL') AS recovers
        FROM (SELECT *, hit AND until IS NULL AND NOT halted AND NOT upstream_halt AS starts
              FROM (SELECT *, losses >= 3 OR fall >= 0.03::DOUBLE AS hit
                    FROM (SELECT s.portfolio, s.rn, s.event_id, s.ts_ms, s.fall, s.halted, s.upstream_halt, b.state AS was, b.until, CASE WHEN s.pnl_u < 0 THEN b.losses + 1 ELSE 0 END AS losses,
                            CASE WHEN NOT s.halted AND NOT s.upstream_halt AND s.fall < 0.03::DOUBLE AND (b.until IS NULL OR s.ts_ms >= b.until) THEN b.calm + 1 ELSE 0 END AS calm
                          FROM breaker b JOIN seen s ON s.portfolio = b.portfolio AND s.rn = b.rn + 1)))))
"""


@query("risk_breaker", BREAKER_SQL + "SELECT portfolio, event_id, state AS breaker_state, reason AS breaker_reason FROM breaker WHERE rn > 0")
def risk_breaker(spark, sf):
    return observed(spark, sf).select("portfolio", "event_id", "breaker_state", "breaker_reason")


@query("breaker_transitions", BREAKER_SQL + """SELECT portfolio, was AS from_value, state AS to_value, count(*) AS n
FROM (SELECT *, lag(state) OVER (PARTITION BY portfolio ORDER BY rn) AS was FROM breaker WHERE rn > 0) WHERE was <> state GROUP BY ALL""")
def breaker_transitions(spark, sf):
    return A.transitions(observed(spark, sf).drop("_rn"), "breaker_state", PORTFOLIO)


@query("risk_gauges", f"""WITH {EQUITY_SQL}
SELECT event_id, CAST(event_id % 7 < 2 AS INTEGER) AS breaker_active, round(greatest(0.0, (peak - equity) / peak) * 100, 6) AS drawdown_percent,
  round(greatest(0.0, (1 - equity) * 100), 6) AS daily_loss_percent
FROM (SELECT *, greatest(1.0, max(equity) OVER (PARTITION BY portfolio ORDER BY ts_ms, event_id)) AS peak FROM eq)""")
def risk_gauges(spark, sf):
    rows = R.drawdown(equity(spark, sf), PORTFOLIO).withColumn("breaker_state", F.when(F.col("event_id") % 7 < 2, "REDUCED").otherwise("NORMAL"))
    return R.risk_gauges(rows).select("event_id", "breaker_active", r(F.col("drawdown_percent"), 6).alias("drawdown_percent"),
                                      r(F.col("daily_loss_percent"), 6).alias("daily_loss_percent"))
