"""Injection, episode, ledger, metric and comparison queries."""

from pyspark.sql import functions as F

from tidewatch.operators import backtest as B
from tidewatch.plans.store import materialise
from tidewatch.workload.anomalies import FEAT_SQL, SIMPLE_SQL, gate_sql, simple
from tidewatch.workload.registry import query
from tidewatch.workload.scalars import r
from tidewatch.workload.ticks import DAY_MS, LAYOUT, as_union, table, ticks, with_ticks
from tidewatch.workload.trading import EQUITY_SQL, PORTFOLIO, equity, trades

WIN_SQL = """win AS MATERIALIZED (
  SELECT *, p BETWEEN 0.35 AND 0.65 AS active, (p - 0.35) / 0.30 AS x
  FROM (SELECT *, greatest(0.0, least(1.0, (ts_ms - min(ts_ms) OVER ()) / CAST(max(ts_ms) OVER () - min(ts_ms) OVER () AS DOUBLE))) AS p FROM ticks))"""
T_COLS = "tick_id, ts_ms, exchange_ts_ms, round(last_price, 8) AS last_price, round(bid, 8) AS bid, round(ask, 8) AS ask, round(volume_24h, 4) AS volume_24h, injected"


def tick_cols(df, *more):
    return df.select(*more, "tick_id", "ts_ms", "exchange_ts_ms", *[r(F.col(c)).alias(c) for c in ("last_price", "bid", "ask")],
                     r(F.col("volume_24h"), 4).alias("volume_24h"), "injected")


def _reprice_sql(cond: str, price: str) -> str:
    half = "greatest(1e-8, (ask - bid) / 2)"
    return f"""SELECT tick_id, ts_ms, exchange_ts_ms, CASE WHEN {cond} THEN {price} ELSE last_price END AS last_price, CASE WHEN {cond} THEN greatest(1e-8, {price} - {half}) ELSE bid END AS bid,
      CASE WHEN {cond} THEN {price} + {half} ELSE ask END AS ask, volume_24h, {cond} AS injected FROM win"""


INJECT_SQL = {
    "flash_crash": _reprice_sql("active", "greatest(1e-8, last_price * (1 - 0.10 * greatest(0.2, 1 - abs(x * 2 - 1))))"),
    "feed_corruption": _reprice_sql("active", "last_price * 1.05::DOUBLE"),
    "replay_attack": """SELECT tick_id, CASE WHEN active THEN greatest(0, ts_ms - 200) ELSE ts_ms END AS ts_ms, CASE WHEN active THEN greatest(0, exchange_ts_ms - 200) ELSE exchange_ts_ms END AS exchange_ts_ms,
      last_price, bid, ask, volume_24h, active AS injected FROM win""",
    "gradual_drift": _reprice_sql("active", "last_price * (1 + 0.001::DOUBLE * greatest(0.0, round_even(x * 19, 0)))"),
    "coordinated_spoofing": _reprice_sql("(active AND exchange_id IN ('binance', 'coinbase'))", "last_price * 1.03::DOUBLE"),
    "spread_spike": """SELECT tick_id, ts_ms, exchange_ts_ms, last_price, CASE WHEN active THEN last_price - last_price * 0.02 / 2 ELSE bid END AS bid,
      CASE WHEN active THEN last_price + last_price * 0.02 / 2 ELSE ask END AS ask, volume_24h, active AS injected FROM win""",
    "multi_source_disagreement": _reprice_sql("(active AND exchange_id <> 'binance')", "last_price * 1.005::DOUBLE"),
    "volume_spike": "SELECT tick_id, ts_ms, exchange_ts_ms, last_price, bid, ask, volume_24h * CASE WHEN active THEN 10 ELSE 1 END AS volume_24h, active AS injected FROM win",
}
QUERY_OF = {"flash_crash": "inject_flash_crash", "feed_corruption": "inject_feed_corruption", "replay_attack": "inject_replay", "gradual_drift": "inject_gradual_drift",
            "coordinated_spoofing": "inject_spoofing", "spread_spike": "inject_spread_spike", "multi_source_disagreement": "inject_disagreement", "volume_spike": "inject_volume_spike"}


@query("attack_window", with_ticks("SELECT tick_id, round(p, 8) AS progress, active FROM win", WIN_SQL))
def attack_window(spark, sf):
    return B.attack_window(ticks(spark, sf)).select("tick_id", r(F.col("progress")).alias("progress"), "active")


def _register(scenario: str) -> None:
    @query(QUERY_OF[scenario], with_ticks(f"SELECT {T_COLS} FROM ({INJECT_SQL[scenario]})", WIN_SQL))
    def run(spark, sf):
        return tick_cols(B.inject(B.attack_window(ticks(spark, sf)), scenario))


for _name in QUERY_OF:
    _register(_name)


@query("scenario_sweep", with_ticks(
    "SELECT scenario, injected, count(*) AS n, round(sum(last_price), 3) AS price_sum, round(sum(ask - bid), 4) AS spread_sum, round(sum(volume_24h), 2) AS volume_sum FROM ("
    + " UNION ALL ".join(f"SELECT '{s}' AS scenario, * FROM ({q})" for s, q in INJECT_SQL.items())
    + " UNION ALL SELECT 'baseline', tick_id, ts_ms, exchange_ts_ms, last_price, bid, ask, volume_24h, false FROM win) GROUP BY ALL", WIN_SQL))
def scenario_sweep(spark, sf):
    grid = spark.createDataFrame([(s,) for s in ["baseline", *QUERY_OF]], "scenario string")
    out = B.scenario_sweep(B.attack_window(ticks(spark, sf)), grid)
    return out.groupBy("scenario", "injected").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("last_price"), 3).alias("price_sum"), F.round(F.sum(F.col("ask") - F.col("bid")), 4).alias("spread_sum"),
        F.round(F.sum("volume_24h"), 2).alias("volume_sum"))


SHAPES = ["crash", "liquidity", "volume", "drift", "volatility", "combined"]


@query("inject_validated", """
WITH s AS (SELECT p_partkey, ['crash', 'liquidity', 'volume', 'drift', 'volatility', 'combined'][p_partkey % 6 + 1] AS shape, 100.0 + p_partkey AS base, 0.1::DOUBLE AS depth FROM part),
e AS (SELECT s.*, step, step / 4.0::DOUBLE AS x FROM s, range(0, 5) t(step))
SELECT p_partkey, shape, CAST(step AS INTEGER) AS step, round(base * (1 + CASE WHEN shape IN ('crash', 'combined') THEN -depth * (1 - abs(2 * x - 1)) WHEN shape = 'drift' THEN depth * x
  WHEN shape = 'volatility' THEN depth * CASE WHEN step % 2 = 0 THEN 1 ELSE -1 END ELSE 0 END), 6) AS mid, CASE WHEN shape IN ('liquidity', 'combined') THEN depth ELSE 0.0001::DOUBLE END AS spread,
  CASE WHEN shape IN ('volume', 'combined') THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END AS volume_24h FROM e""")
def inject_validated(spark, sf):
    shapes = table(spark, sf, "part").select(
        "p_partkey", F.element_at(F.array(*[F.lit(s) for s in SHAPES]), (F.col("p_partkey") % 6 + 1).cast("int")).alias("shape"),
        (100.0 + F.col("p_partkey")).alias("base"), F.lit(0.1).alias("depth"), F.lit(5).alias("steps"))
    return B.inject_validated(shapes).select("p_partkey", "shape", "step", r(F.col("mid"), 6).alias("mid"), "spread", "volume_24h")


SYN = [("binance", 0.01, 2.0, 0), ("kraken", 0.20, 5.0, 40), ("okx", 0.05, 3.0, 15)]


def _unit(purpose: str) -> str:
    return f"(CAST('0x' || substr(sha256(tick_id || '|' || venue || '|{purpose}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


@query("synthesize_sources", with_ticks(f"""
SELECT tick_id, symbol, venue AS exchange_id, round(m, 7) AS mid, round(m - h, 7) AS bid, round(m + h, 7) AS ask, round(volume_24h * (1 + ({_unit('volume')} * 2 - 1) * 0.05), 6) AS volume_24h,
  CAST(ts_ms + delay_ms AS BIGINT) AS ts_ms
FROM (SELECT *, mid * (1 + ({_unit('price')} * 2 - 1) * jitter_bps / 10000) AS m, (ask - bid) / 2 * (1 + ({_unit('spread')} * 2 - 1) * 0.10) AS h
      FROM ticks, {as_union(SYN, ['venue', 'outage', 'jitter_bps', 'delay_ms'])} WHERE {_unit('outage')} >= outage)"""))
def synthesize_sources(spark, sf):
    venues = spark.createDataFrame(SYN, "venue string, outage double, jitter_bps double, delay_ms long")
    out = B.synthesize_sources(ticks(spark, sf), venues)
    return out.select("tick_id", "symbol", "exchange_id", *[r(F.col(c), 7).alias(c) for c in ("mid", "bid", "ask")], r(F.col("volume_24h"), 6).alias("volume_24h"), "ts_ms")


EP_SQL = """epi AS MATERIALIZED (SELECT *, tick_id % 23 < 2 AS injected FROM simple),
ep AS MATERIALIZED (
  SELECT *, coalesce(rn - lasti < 5, false) AS in_episode, CASE WHEN rn - lasti < 5 THEN sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY symbol ORDER BY rn) END AS episode
  FROM (SELECT *, injected AND (prevl IS NULL OR rn - prevl >= 5) AS fresh, CASE WHEN injected THEN rn ELSE prevl END AS lasti
        FROM (SELECT *, max(CASE WHEN injected THEN rn END) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prevl FROM epi)))"""
EP = (FEAT_SQL, SIMPLE_SQL, EP_SQL)


def episodes(spark, sf):
    return B.attack_episodes(simple(spark, sf).withColumn("injected", F.col("tick_id") % 23 < 2), LAYOUT)


@query("attack_episodes", with_ticks("SELECT tick_id, in_episode, CAST(episode AS BIGINT) AS episode FROM ep", *EP))
def attack_episodes(spark, sf):
    return episodes(spark, sf).select("tick_id", "in_episode", "episode")


@query("detection_latency", with_ticks("""
SELECT symbol, CAST(episode AS BIGINT) AS episode, min(ts_ms) AS start_ms, min(ts_ms) FILTER (anomaly_score >= 0.55) - min(ts_ms) AS latency_ms FROM ep WHERE episode IS NOT NULL GROUP BY ALL""", *EP))
def detection_latency(spark, sf):
    return B.detection_latency(episodes(spark, sf))


@query("detection_rates", with_ticks("""
SELECT *, round(detected / CAST(injected AS DOUBLE), 8) AS detection_rate, round(false_positives / CAST(total_ticks - injected AS DOUBLE), 8) AS false_positive_rate FROM (
  SELECT symbol, count(*) AS total_ticks, count(*) FILTER (injected) AS injected, count(*) FILTER (in_episode AND anomaly_score >= 0.55) AS detected,
    count(*) FILTER (NOT in_episode AND anomaly_score >= 0.55 AND trust_score >= 0.6) AS false_positives FROM ep GROUP BY symbol)""", *EP))
def detection_rates(spark, sf):
    out = B.detection_rates(episodes(spark, sf))
    return out.withColumn("detection_rate", r(F.col("detection_rate"))).withColumn("false_positive_rate", r(F.col("false_positive_rate")))


def ledger(spark, sf):
    t = ticks(spark, sf)
    side = F.when(F.col("k") % 20 == 0, "LONG").when(F.col("k") % 20 == 1, "SHORT").when(F.col("k") == 50, "CLOSE_ALL")
    rows = t.select("symbol", "ts_ms", "tick_id", "mid", side.alias("direction"), F.lit(0.2).alias("size_pct"),
                    (F.col("mid") - F.when(F.col("k") % 20 == 1, -0.2).otherwise(0.2)).alias("stop"), (F.col("mid") + F.when(F.col("k") % 20 == 1, -0.3).otherwise(0.3)).alias("target"))
    return B.close_at_end(B.position_ledger(rows, LAYOUT), LAYOUT)


# One position per symbol as a recursion over row numbers; what is still open after the last tick closes in a row of its own.
LEDGER_CTES = ("""orders AS MATERIALIZED (
  SELECT symbol, tick_id, mid, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms, tick_id) AS rn, CASE k % 20 WHEN 0 THEN 1 WHEN 1 THEN -1 END AS wanted, k = 50 AND k % 20 > 1 AS leave,
    mid - CASE WHEN k % 20 = 1 THEN -0.2::DOUBLE ELSE 0.2::DOUBLE END AS stop, mid + CASE WHEN k % 20 = 1 THEN -0.3::DOUBLE ELSE 0.3::DOUBLE END AS target FROM ticks)""", """
book AS (
  SELECT symbol, 0::BIGINT AS rn, CAST(NULL AS BIGINT) AS tick_id, NULL::DOUBLE AS mid, NULL::INTEGER AS side, NULL::DOUBLE AS entry, NULL::DOUBLE AS stop, NULL::DOUBLE AS target,
    NULL::VARCHAR AS exit_reason, NULL::DOUBLE AS realised, 0::DOUBLE AS cash FROM (SELECT DISTINCT symbol FROM orders)
  UNION ALL
  SELECT symbol, rn, tick_id, mid, CASE WHEN opens THEN wanted WHEN exit_reason IS NULL THEN side END, CASE WHEN opens THEN mid WHEN exit_reason IS NULL THEN entry END,
    CASE WHEN opens THEN new_stop WHEN exit_reason IS NULL THEN stop END, CASE WHEN opens THEN new_target WHEN exit_reason IS NULL THEN target END,
    exit_reason, realised, coalesce(realised, 0) - CASE WHEN opens THEN 0.2::DOUBLE * 0.001::DOUBLE ELSE 0 END
  FROM (SELECT *, wanted IS NOT NULL AND (side IS NULL OR exit_reason IS NOT NULL) AS opens,
          CASE WHEN exit_reason IS NOT NULL THEN 0.2::DOUBLE * side * (mid - entry) / entry - 0.2::DOUBLE * 0.001::DOUBLE END AS realised
        FROM (SELECT o.symbol, o.rn, o.tick_id, o.mid, o.wanted, o.stop AS new_stop, o.target AS new_target, b.side, b.entry, b.stop, b.target,
                CASE WHEN (o.mid - b.stop) * b.side <= 0 THEN 'STOP_HIT' WHEN (o.mid - b.target) * b.side >= 0 THEN 'TP_HIT' WHEN b.side IS NOT NULL AND o.leave THEN 'CLOSE_ALL'
                     WHEN o.wanted = -b.side THEN 'FLIP' END AS exit_reason
              FROM book b JOIN orders o ON o.symbol = b.symbol AND o.rn = b.rn + 1)))""", """
final AS (
  SELECT symbol, tick_id, 0 AS closing, coalesce(0.2::DOUBLE * side, 0) AS position, entry, realised, cash, exit_reason FROM book WHERE rn > 0
  UNION ALL
  SELECT symbol, tick_id, 1, 0, NULL, result, result, 'END_OF_RUN'
  FROM (SELECT *, 0.2::DOUBLE * side * (mid - entry) / entry - 0.2::DOUBLE * 0.001::DOUBLE AS result FROM book JOIN (SELECT symbol, max(rn) AS rn FROM orders GROUP BY symbol) USING (symbol, rn) WHERE side IS NOT NULL))""")


@query("position_ledger", with_ticks("""SELECT symbol, tick_id, closing, round(position, 8) + 0.0 AS position, round(entry, 8) AS entry_price, round(realised, 8) + 0.0 AS realised,
  round(cash, 8) + 0.0 AS cash_change, exit_reason FROM final""", *LEDGER_CTES))
def position_ledger(spark, sf):
    return ledger(spark, sf).select("symbol", "tick_id", "closing", *[r(F.col(c)).alias(c) for c in ("position", "entry_price", "realised", "cash_change")], "exit_reason")


@query("equity_curve", with_ticks("""
SELECT tick_id, round(1 + sum(cash) OVER (PARTITION BY symbol ORDER BY ts_ms, tick_id) + pos * (mid - entry) / entry, 8) AS equity
FROM (SELECT *, (k % 7 - 3) / 1000.0::DOUBLE AS cash, (k % 5 - 2) / 10.0::DOUBLE AS pos, 100.0 + k / 100.0::DOUBLE AS entry FROM ticks)"""))
def equity_curve(spark, sf):
    rows = ticks(spark, sf).select("symbol", "ts_ms", "tick_id", "mid", ((F.col("k") % 7 - 3) / 1000.0).alias("cash_change"),
                                   ((F.col("k") % 5 - 2) / 10.0).alias("position"), (100.0 + F.col("k") / 100.0).alias("entry_price"))
    return B.equity_curve(rows, LAYOUT).select("tick_id", r(F.col("equity")).alias("equity"))


STEP_SQL = """steps AS MATERIALIZED (SELECT *, equity - lag(equity) OVER (PARTITION BY portfolio ORDER BY ts_ms, event_id) AS step,
  greatest(0, max(equity) OVER (PARTITION BY portfolio ORDER BY ts_ms, event_id)) - equity AS fall FROM eq)"""
SHARPE = "CASE WHEN stddev_pop(step) > 1e-12 THEN avg(step) / stddev_pop(step) * sqrt(count(step)) ELSE 0 END"


@query("sharpe", f"WITH {EQUITY_SQL}, {STEP_SQL} SELECT portfolio, count(step) AS steps, round({SHARPE}, 7) + 0.0 AS sharpe_ratio FROM steps GROUP BY portfolio")
def sharpe(spark, sf):
    return B.sharpe(equity(spark, sf), PORTFOLIO).withColumn("sharpe_ratio", r(F.col("sharpe_ratio"), 7))


@query("max_drawdown", f"WITH {EQUITY_SQL}, {STEP_SQL} SELECT portfolio, round(max(fall), 8) AS max_drawdown FROM steps GROUP BY portfolio")
def max_drawdown(spark, sf):
    return B.max_drawdown(equity(spark, sf), PORTFOLIO).withColumn("max_drawdown", r(F.col("max_drawdown")))


@query("win_rate", f"WITH {EQUITY_SQL} SELECT portfolio, count(*) AS closed_trades, round(avg(CASE WHEN pnl_u > 0 THEN 1.0 ELSE 0 END), 8) AS win_rate FROM eq GROUP BY portfolio")
def win_rate(spark, sf):
    return B.win_rate(trades(spark, sf), ("portfolio",), "pnl_u").withColumn("win_rate", r(F.col("win_rate")))


@query("state_share", with_ticks("SELECT symbol, round(avg(CASE WHEN base_state = 'NORMAL' THEN 1.0 ELSE 0 END), 8) AS state_share FROM gated GROUP BY symbol",
                                 FEAT_SQL, SIMPLE_SQL, gate_sql("simple")))
def state_share(spark, sf):
    from tidewatch.operators.anomaly import gate_base_state

    rows = simple(spark, sf).withColumn("system_state", gate_base_state())
    return B.state_share(rows, ("symbol",)).withColumn("state_share", r(F.col("state_share")))


@query("stage_latency", with_ticks("SELECT symbol, round(avg(greatest(0, ts_ms - exchange_ts_ms)), 6) AS mean_latency_ms FROM ticks GROUP BY symbol"))
def stage_latency(spark, sf):
    return B.stage_latency(ticks(spark, sf), ("symbol",), "exchange_ts_ms", "ts_ms").withColumn("mean_latency_ms", r(F.col("mean_latency_ms"), 6))


PCT = ", ".join(f"round(quantile_cont(trust_score, {p}), 8) AS p{n}" for n, p in ((5, 0.05), (25, 0.25), (50, 0.5), (75, 0.75), (95, 0.95)))


@query("trust_statistics", with_ticks(f"""
SELECT symbol, round(avg(trust_score), 8) AS mean, round(stddev_samp(trust_score), 8) AS std, round(min(trust_score), 8) AS min, round(max(trust_score), 8) AS max,
  {PCT}, round(max(trust_score) - min(trust_score), 8) AS range FROM simple GROUP BY symbol""", FEAT_SQL, SIMPLE_SQL))
def trust_statistics(spark, sf):
    out = B.trust_statistics(simple(spark, sf), ("symbol",))
    return out.select("symbol", *[r(F.col(c)).alias(c) for c in out.columns if c != "symbol"])


@query("soak_checklist", with_ticks("""
SELECT symbol, stddev_samp(trust_score) > 0 AS trust_score_std_gt_zero, max(trust_score) - min(trust_score) > 0.01 AS trust_score_range_gt_001,
  quantile_cont(trust_score, 0.95) - quantile_cont(trust_score, 0.05) > 0.01 AS trust_score_p95_minus_p5_gt_001,
  max(anomaly_score) - min(anomaly_score) > 0.01 AS t2_range_gt_001, max(volume_24h) - min(volume_24h) > 0.01 AS t3_range_gt_001 FROM simple GROUP BY symbol""", FEAT_SQL, SIMPLE_SQL))
def soak_checklist(spark, sf):
    return B.soak_checklist(simple(spark, sf).withColumn("detector_score", F.col("volume_24h")), ("symbol",))


@query("permutation_test")
def permutation_test(spark, sf):
    from tidewatch.plans.scans import previous

    steps = previous(equity(spark, sf), PORTFOLIO, before="equity").select("portfolio", "event_id", (F.col("equity") - F.col("before")).alias("step"))
    out = B.permutation_test(steps, ("portfolio",), shuffles=1_000, row_id="event_id")
    return out.select("portfolio", "steps", r(F.col("sharpe_ratio"), 7).alias("sharpe_ratio"), "p_value")


START, END = 1_704_067_200_000, 1_704_067_200_000 + 30 * DAY_MS


@query("walk_forward_windows", with_ticks(f"""
SELECT f AS fold, {START} + f * {7 * DAY_MS} AS start_ms, least({START} + (f + 1) * {7 * DAY_MS}, {END}) AS end_ms, count(tick_id) AS ticks
FROM range(0, 5) t(f) LEFT JOIN ticks ON ts_ms >= {START} + f * {7 * DAY_MS} AND ts_ms < least({START} + (f + 1) * {7 * DAY_MS}, {END}) GROUP BY ALL"""))
def walk_forward_windows(spark, sf):
    folds = B.walk_forward_windows(START, END, spark, fold_days=7)
    rows = ticks(spark, sf).where(F.col("ts_ms").between(START, END - 1)).groupBy(B.fold_id(START, fold_days=7).alias("fold")).agg(F.count(F.lit(1)).alias("ticks"))
    return folds.join(rows, "fold", "left").withColumn("ticks", F.coalesce("ticks", F.lit(0)))


FOLD_MS, FOLD_START = 365 * DAY_MS, 788_918_400_000


@query("walk_forward_summary", f"""WITH {EQUITY_SQL},
st AS (SELECT *, equity - lag(equity) OVER (PARTITION BY portfolio, fold ORDER BY ts_ms, event_id) AS step, greatest(0, max(equity) OVER (PARTITION BY portfolio, fold ORDER BY ts_ms, event_id)) - equity AS fall
       FROM (SELECT *, (ts_ms - {FOLD_START}) // {FOLD_MS} AS fold FROM eq)),
f AS (SELECT portfolio, fold, count(step) AS steps, {SHARPE} AS s, max(fall) AS d FROM st GROUP BY ALL)
SELECT portfolio, CAST(fold AS BIGINT) AS fold, steps, round(coalesce(s, 0), 6) + 0.0 AS sharpe_ratio, round(d, 8) AS max_drawdown, round(avg(coalesce(s, 0)) OVER (PARTITION BY portfolio), 6) + 0.0 AS mean_sharpe FROM f""")
def walk_forward_summary(spark, sf):
    curve = equity(spark, sf).withColumn("fold", B.fold_id(FOLD_START, fold_days=365))
    out = B.walk_forward_summary(curve, PORTFOLIO)
    return out.select("portfolio", "fold", "steps", (r(F.col("sharpe_ratio"), 6) + 0.0).alias("sharpe_ratio"), r(F.col("max_drawdown")).alias("max_drawdown"),
                      (r(F.col("mean_sharpe"), 6) + 0.0).alias("mean_sharpe"))


NAMES = ["net_pnl", "win_rate", "max_drawdown", "end_to_end_latency_ms"]
ATTACKS = ["flash_crash", "volume_spike"]
RUNS_SQL = """runs AS MATERIALIZED (
  SELECT c_nationkey AS nation, CASE o_orderstatus WHEN 'F' THEN 'baseline' WHEN 'O' THEN 'flash_crash' ELSE 'volume_spike' END AS scenario,
    sum((o_orderkey * 7919) % 8001 - 4000) / 1000000.0::DOUBLE AS net_pnl, avg(CASE WHEN (o_orderkey * 7919) % 8001 > 4000 THEN 1.0 ELSE 0 END) AS win_rate,
    max((o_orderkey * 7919) % 8001) / 100000.0::DOUBLE AS max_drawdown, CAST(count(*) AS DOUBLE) AS end_to_end_latency_ms
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""


def runs(spark, sf):
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    u = (F.col("o_orderkey") * 7919) % 8001
    scenario = F.when(F.col("o_orderstatus") == "F", "baseline").when(F.col("o_orderstatus") == "O", "flash_crash").otherwise("volume_spike")
    return joined.groupBy(F.col("c_nationkey").alias("nation"), scenario.alias("scenario")).agg(
        (F.sum(u - 4000) / 1_000_000.0).alias("net_pnl"), F.avg((u > 4000).cast("double")).alias("win_rate"), (F.max(u) / 100_000.0).alias("max_drawdown"),
        F.count(F.lit(1)).cast("double").alias("end_to_end_latency_ms"))


@query("compare_scenarios", f"""WITH {RUNS_SQL},
long AS (UNPIVOT runs ON net_pnl, win_rate, max_drawdown, end_to_end_latency_ms INTO NAME metric_name VALUE v),
cmp AS (SELECT a.nation, a.scenario, a.metric_name, a.v AS av, b.v AS bv, CASE WHEN abs(b.v) >= 1e-12 THEN (a.v - b.v) / b.v * 100 WHEN abs(a.v - b.v) < 1e-12 THEN 0 WHEN a.v > b.v THEN 100 ELSE -100 END AS pc
        FROM long a JOIN long b USING (nation, metric_name) WHERE a.scenario <> 'baseline' AND b.scenario = 'baseline')
SELECT nation, scenario, metric_name, round(bv, 7) AS baseline_value, round(av, 7) AS attack_value, round(av - bv, 7) + 0.0 AS delta, round(pc, 5) + 0.0 AS percent_change,
  CASE WHEN abs(pc) < 0.01 THEN 'neutral' WHEN (pc > 0) = (metric_name IN ('net_pnl', 'win_rate')) THEN 'better' ELSE 'worse' END AS direction FROM cmp""")
def compare_scenarios(spark, sf):
    out = B.compare_scenarios(runs(spark, sf), NAMES, ("nation",))
    return out.select("nation", "scenario", "metric_name", *[(r(F.col(c), 7) + 0.0).alias(c) for c in ("baseline_value", "attack_value", "delta")],
                      (r(F.col("percent_change"), 5) + 0.0).alias("percent_change"), "direction")


@query("compare_runs", f"""WITH {RUNS_SQL},
long AS (UNPIVOT runs ON net_pnl, win_rate, max_drawdown, end_to_end_latency_ms INTO NAME metric_name VALUE v)
SELECT nation, scenario, metric_name, round(coalesce(a.v, 0), 7) AS baseline, round(coalesce(b.v, 0), 7) AS live, round(coalesce(b.v, 0) - coalesce(a.v, 0), 6) + 0.0 AS delta
FROM (SELECT l.nation, l.metric_name, l.v, s.scenario FROM long l, (SELECT DISTINCT scenario FROM runs WHERE scenario <> 'baseline') s WHERE l.scenario = 'baseline') a
FULL JOIN (SELECT * FROM long WHERE scenario <> 'baseline') b USING (nation, scenario, metric_name)""")
def compare_runs(spark, sf):
    both = runs(spark, sf)
    attacks = F.explode(F.array(*[F.lit(s) for s in ATTACKS])).alias("scenario")
    base = both.where("scenario = 'baseline'").select("nation", attacks, *NAMES)
    out = B.compare_runs(base, both.where("scenario <> 'baseline'"), NAMES, ("nation", "scenario"))
    return out.select("nation", "scenario", "metric_name", r(F.col("baseline"), 7).alias("baseline"), r(F.col("live"), 7).alias("live"), (F.col("delta") + 0.0).alias("delta"))


@query("run_verdict", f"""WITH {RUNS_SQL},
v AS (SELECT nation, scenario, net_pnl > 0 OR win_rate < 0.05 AS a, end_to_end_latency_ms / 10000 < 0.02 AS b, max_drawdown < 0.08 AS c, nation % 5 = 0 AS d FROM runs)
SELECT nation, scenario, a AS profit_or_significance, b AS false_positives_ok, c AS drawdown_ok, d AS reconciled,
  CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(c AS INTEGER) + CAST(d AS INTEGER) AS passed_checks, a AND b AND c AND d AS passed FROM v""")
def run_verdict(spark, sf):
    rows = runs(spark, sf).withColumn("p_value", F.col("win_rate")).withColumn("false_positive_rate", F.col("end_to_end_latency_ms") / 10_000).withColumn(
        "unresolved", F.col("nation") % 5)
    return B.run_verdict(rows).select("nation", "scenario", "profit_or_significance", "false_positives_ok", "drawdown_ok", "reconciled", "passed_checks", "passed")


@query("layer_statistics", with_ticks("""
SELECT symbol, round(avg(trust_score), 8) AS trust_score_mean, round(min(trust_score), 8) AS trust_score_min, round(max(trust_score), 8) AS trust_score_max,
  round(avg(anomaly_score), 8) AS anomaly_score_mean, round(min(anomaly_score), 8) AS anomaly_score_min, round(max(anomaly_score), 8) AS anomaly_score_max,
  count(*) FILTER (base_state = 'NORMAL') AS n_normal, count(*) FILTER (base_state = 'CONSERVATIVE') AS n_conservative, count(*) FILTER (base_state = 'DEGRADED') AS n_degraded,
  count(*) FILTER (base_state = 'HALT') AS n_halt FROM gated GROUP BY symbol""", FEAT_SQL, SIMPLE_SQL, gate_sql("simple")))
def layer_statistics(spark, sf):
    from tidewatch.operators.anomaly import gate_base_state

    out = B.layer_statistics(simple(spark, sf).withColumn("system_state", gate_base_state()), ("symbol",))
    return out.select("symbol", *[r(F.col(c)).alias(c) if c.endswith(("mean", "min", "max")) else F.col(c) for c in out.columns if c != "symbol"])


@query("last_n_events", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def last_n_events(spark, sf):
    return B.last_n_events(table(spark, sf, "events"), [F.desc("ts"), F.desc("event_id")]).select("event_id", "event_type")
