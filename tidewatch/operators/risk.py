"""Pre-trade risk checks and the portfolio circuit breaker."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.plans.fold import keyed_fold
from tidewatch.plans.layout import Layout
from tidewatch.plans.scans import Scan, running

PORTFOLIO = Layout(keys=("portfolio",), order=("ts_ms", "event_id"), slot_ms=86_400_000)


@dataclass(frozen=True)
class RiskConfig:
    trust_floor: float = 0.40
    max_position: float = 0.20
    max_trade_loss: float = 0.02
    max_exposure: float = 0.60
    pause_losses: int = 5
    reduce_losses: int = 3
    recovery_ticks: int = 10
    pause_ms: int = 1_800_000
    daily_loss: float = 0.08
    release_drawdown: float = 0.03
    reduced_size: float = 0.5
    close_all_on_halt: bool = False


def stop_levels(direction: Column, price: Column, atr: Column) -> tuple[Column, Column]:
    """Stop and target: 1.5 and 2.5 true ranges away, mirrored for shorts."""
    side = F.when(direction == "LONG", 1.0).otherwise(-1.0)
    return price - side * 1.5 * atr, price + side * 2.5 * atr


def close_all(exposure: Column, cfg: RiskConfig = RiskConfig()) -> Column:
    return F.greatest(F.lit(0.0), F.least(exposure, F.lit(cfg.max_exposure)))


def risk_checks(signals: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """Ordered checks over rows with ``direction, size_pct, system_state, trust_score, atr, reference_price, exposure_pct,
    breaker_state, last_loss_direction``. Adds ``approved``, ``reason``, ``approved_size``, ``adjustments``, stops.
    """
    d, state, breaker = F.col("direction"), F.col("system_state"), F.col("breaker_state")
    price, atr, exposure = F.col("reference_price"), F.col("atr"), F.col("exposure_pct")
    closing = d == "CLOSE_ALL"
    halted = (breaker == "HALTED") & ~(closing & F.lit(cfg.close_all_on_halt))
    upstream = (state == "HALT") & ~(closing & F.lit(cfg.close_all_on_halt))
    stop, target = stop_levels(d, price, atr)
    over = F.col("size_pct") > cfg.max_position
    reduced = breaker == "REDUCED"
    base = F.least(F.col("size_pct"), F.lit(cfg.max_position)) * F.when(reduced, cfg.reduced_size).otherwise(1.0)
    unit_loss = F.when(price > 0, F.abs(price - stop) / price)
    rows = signals.withColumn("_base", base).withColumn("_loss", F.col("_base") * unit_loss)
    capped = F.col("_loss") > cfg.max_trade_loss
    rows = rows.withColumn("_size", F.when(capped, F.col("_base") * cfg.max_trade_loss / F.col("_loss")).otherwise(F.col("_base")))
    reject = (
        F.when(d == "HOLD", "hold signal")
        .when(halted, "circuit breaker halted")
        .when(upstream, "upstream system_state=HALT")
        .when((state == "DEGRADED") & ~closing, "upstream system_state=DEGRADED")
        .when(~closing & (F.col("trust_score") < cfg.trust_floor), "trust floor breached")
        .when(closing, F.lit(None))
        .when(atr.isNull() | (atr <= 0), "missing atr")
        .when(price <= 0, "invalid reference price")
        .when(reduced & F.col("last_loss_direction").eqNullSafe(d), "reduced state blocks same-direction trades")
        .when(exposure + F.col("_size") > cfg.max_exposure, "portfolio exposure cap breached")
        .when(F.col("_size") <= 0, "non-positive approved size")
    )
    notes = F.filter(
        F.array(
            F.when(over, "position size capped at 20%"),
            F.when(reduced, "reduced state size cut by 50%"),
            F.when(capped, "per-trade loss resized to 2% cap"),
        ),
        lambda x: x.isNotNull(),
    )
    rows = rows.withColumn("_reject", reject).withColumn("_notes", F.when(closing, F.array(F.lit("close all"))).otherwise(notes))
    ok = F.col("_reject").isNull()
    approved_reason = F.when(closing, "approved close all").when(F.size("_notes") == 0, "approved").otherwise(F.concat_ws("; ", "_notes"))
    open_order = ok & ~closing
    return (
        rows.withColumn("approved", ok)
        .withColumn("reason", F.coalesce("_reject", approved_reason))
        .withColumn("approved_size", F.when(ok & closing, close_all(exposure, cfg)).when(ok, F.col("_size")))
        .withColumn("adjustments", F.when(ok, F.col("_notes")))
        .withColumn("stop_loss", F.when(open_order, stop))
        .withColumn("take_profit", F.when(open_order, target))
        .drop("_base", "_loss", "_size", "_reject", "_notes")
    )


def drawdown(equity: DataFrame, layout: Layout = PORTFOLIO, *, value: str = "equity", start: float | None = 1.0) -> DataFrame:
    """Distance from the highest equity so far, as a share of it."""
    out = running(equity, layout, peak_equity=Scan("max", F.col(value)))
    if start is not None:
        out = out.withColumn("peak_equity", F.greatest("peak_equity", F.lit(start)))
    peak = F.col("peak_equity")
    return out.withColumn(
        "drawdown_pct", F.when(peak <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), (peak - F.col(value)) / peak))
    )


def daily_loss_halt(equity: DataFrame, layout: Layout = PORTFOLIO, *, value: str = "equity", start: float = 1.0, limit: float = 0.08) -> DataFrame:
    """Latch once equity has lost the daily limit."""
    return running(equity, layout, daily_loss_halted=Scan("any", F.col(value) <= start * (1.0 - limit)))


def loss_streak(trades: DataFrame, layout: Layout = PORTFOLIO, *, value: str = "pnl") -> DataFrame:
    return running(trades, layout, losing_streak=Scan("streak", F.col(value) < 0))


def breaker_step(s: dict, ts: int, equity: float, upstream: str, pnl: float | None, cfg: RiskConfig) -> str:
    """One market observation of the breaker, after an optional closed trade; updates ``s``, returns the reason."""
    if pnl is not None:
        s["losses"] = s["losses"] + 1 if pnl < 0 else 0
    s["peak"] = max(s["peak"], equity)
    fall = max(0.0, (s["peak"] - equity) / s["peak"]) if s["peak"] > 0 else 0.0
    s["halted"] = s["halted"] or equity <= s["start"] * (1.0 - cfg.daily_loss)
    calm = not s["halted"] and fall < cfg.release_drawdown and (s["until"] is None or ts >= s["until"])
    s["calm"] = s["calm"] + 1 if upstream == "NORMAL" and calm else 0
    rested = calm and s["calm"] >= cfg.recovery_ticks
    if s["halted"]:
        s["state"] = "HALTED"
        return "daily_loss_limit"
    if upstream == "HALT":
        s["state"] = "HALTED"
        return "upstream_halt"
    many = s["losses"] >= cfg.pause_losses
    some = s["losses"] >= cfg.reduce_losses
    if many or some or fall >= cfg.release_drawdown:
        if s["until"] is None:
            s["until"] = ts + cfg.pause_ms
            rested = rested and cfg.pause_ms <= 0
        s["state"] = "HALTED" if many else "REDUCED"
        reason = "loss_streak_pause" if many else ("loss_streak_reduced" if some else "drawdown_reduced")
    elif s["state"] != "NORMAL" and rested:
        reason = "recovered"
    else:
        # Without a matching rule the state falls back at once; a running pause stays noted.
        s["state"] = "NORMAL"
        return "normal"
    if rested:
        s.update(state="NORMAL", until=None, losses=0, calm=0)
        return "recovered"
    return reason


def risk_breaker(observations: DataFrame, layout: Layout = PORTFOLIO, cfg: RiskConfig = RiskConfig(), *, start: float = 1.0) -> DataFrame:
    """Fold market observations (``equity``, ``upstream_state``, optional ``pnl`` of a trade closed then) per portfolio."""
    initial = json.dumps({"state": "NORMAL", "until": None, "losses": 0, "calm": 0, "start": start, "peak": start, "halted": False})

    def fold(cols: dict[str, list], state: str) -> tuple[dict[str, list], str]:
        s = json.loads(state)
        states, reasons = [], []
        for ts, equity, upstream, pnl in zip(cols[layout.ts], cols["equity"], cols["upstream_state"], cols["pnl"]):
            reasons.append(breaker_step(s, ts, equity, upstream, pnl, cfg))
            states.append(s["state"])
        return {"breaker_state": states, "breaker_reason": reasons}, json.dumps(s, sort_keys=True)

    return keyed_fold(
        observations, layout, fold, json.dumps(json.loads(initial), sort_keys=True),
        [layout.ts, "equity", "upstream_state", "pnl"], "breaker_state string, breaker_reason string",
    )


def risk_telemetry(decisions: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Counts of decisions per breaker state and verdict, one column each."""
    states = ["NORMAL", "REDUCED", "HALTED"]
    per_state = decisions.groupBy(*keys).pivot("breaker_state", states).agg(F.count(F.lit(1)))
    per_state = per_state.select(*keys, *[F.coalesce(F.col(s), F.lit(0)).alias(f"state_{s.lower()}") for s in states])
    verdicts = decisions.groupBy(*keys).agg(
        F.count_if("approved").alias("approved_orders"), F.count_if(~F.col("approved")).alias("rejected_orders")
    )
    return per_state.join(verdicts, list(keys))


def reject_reasons(decisions: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return decisions.where(~F.col("approved")).groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))


def reference_price(close: str = "close", entry: str = "entry_price") -> Column:
    return F.coalesce(F.col(close), F.col(entry), F.lit(0.0))


def consensus_price(consensus: str = "consensus_mid", mid: str = "mid", entry: str = "entry_price") -> Column:
    return F.coalesce(F.col(consensus), F.col(mid), F.col(entry))


def risk_gauges(rows: DataFrame, *, start: float = 1.0) -> DataFrame:
    return rows.select(
        "*", (F.col("breaker_state") != "NORMAL").cast("int").alias("breaker_active"),
        (F.col("drawdown_pct") * 100.0).alias("drawdown_percent"),
        F.greatest(F.lit(0.0), (F.lit(start) - F.col("equity")) / F.lit(start) * 100.0).alias("daily_loss_percent"),
    )


def limit_violations(decisions: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Rejections by the limit their reason names."""
    text = F.lower("reason")
    kind = (
        F.when(F.contains(text, F.lit("trust floor")), "trust_floor")
        .when(F.contains(text, F.lit("exposure")), "exposure_cap")
        .when(F.contains(text, F.lit("drawdown")), "drawdown")
    )
    hit = decisions.where(~F.col("approved")).withColumn("violation", kind).where(F.col("violation").isNotNull())
    return hit.groupBy(*keys, "violation").agg(F.count(F.lit(1)).alias("n"))
