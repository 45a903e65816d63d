"""Attack injection, ledgers, metrics and run comparison; runs, scenarios and parameters are keys, never loops."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.plans.fold import keyed_fold
from tidewatch.plans.layout import TICKS, Layout
from tidewatch.plans.quantiles import exact_quantiles
from tidewatch.plans.scans import Scan, index_rows, previous, running
from tidewatch.plans.store import broadcast_if_small, materialise

TINY = 1e-8


# --------------------------------------------------------------------------------------------------- injection


def attack_window(ticks: DataFrame, *, lo: float = 0.35, hi: float = 0.65) -> DataFrame:
    """Add ``progress`` through the whole period and whether the attack window is open; the period is one aggregate row."""
    bounds = ticks.agg(F.min("ts_ms").alias("_start"), F.max("ts_ms").alias("_end"))
    span = F.col("_end") - F.col("_start")
    p = F.when(span > 0, (F.col("ts_ms") - F.col("_start")) / span).otherwise(F.lit(0.0))
    out = ticks.crossJoin(F.broadcast(bounds)).withColumn("progress", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
    return out.withColumn("active", F.col("progress").between(lo, hi)).drop("_start", "_end")


def _reprice(mid: Column) -> dict[str, Column]:
    half = F.greatest(F.lit(TINY), (F.col("ask") - F.col("bid")) / 2.0)
    m = F.greatest(F.lit(TINY), mid)
    return {"last_price": m, "bid": F.greatest(F.lit(TINY), m - half), "ask": m + half}


def scenario_changes() -> dict[str, tuple[Column, dict[str, Column]]]:
    """Per scenario: which active ticks it touches and the columns it replaces."""
    last, p, every = F.col("last_price"), (F.col("progress") - 0.35) / 0.30, F.lit(True)
    shock = 0.10 * F.greatest(F.lit(0.2), 1.0 - F.abs(p * 2.0 - 1.0))
    drift = 1.0 + 0.001 * F.greatest(F.lit(0.0), F.bround(p * 19.0, 0))
    mid = F.greatest(F.lit(TINY), last)
    wide = F.greatest(F.lit(TINY), mid * 0.02)
    zero = F.lit(0)
    return {
        "flash_crash": (every, _reprice(last * (1.0 - shock))),
        "feed_corruption": (every, _reprice(last * 1.05)),
        "replay_attack": (every, {
            "ts_ms": F.greatest(zero, F.col("ts_ms") - 200), "exchange_ts_ms": F.greatest(zero, F.col("exchange_ts_ms") - 200)}),
        "gradual_drift": (every, _reprice(last * drift)),
        "coordinated_spoofing": (F.col("exchange_id").isin("binance", "coinbase"), _reprice(last * 1.03)),
        "spread_spike": (every, {"bid": F.greatest(F.lit(TINY), mid - wide / 2.0), "ask": mid + wide / 2.0}),
        "multi_source_disagreement": (F.col("exchange_id") != "binance", _reprice(last * 1.005)),
        "volume_spike": (every, {"volume_24h": F.col("volume_24h") * 10.0}),
    }


def inject(windowed: DataFrame, scenario: Column | str) -> DataFrame:
    """Apply the scenario named per row (or for all rows) to ticks of :func:`attack_window`; adds ``injected``.

    All scenarios are one ``CASE`` per column, so a table carrying many scenarios is rewritten in a single pass.
    """
    name = F.lit(scenario) if isinstance(scenario, str) else scenario
    changes = scenario_changes()
    hits = {s: (name == s) & F.col("active") & touched for s, (touched, _) in changes.items()}
    injected = F.lit(False)
    for h in hits.values():
        injected = injected | h
    targets = sorted({c for _, new in changes.values() for c in new})
    cols = {}
    for c in targets:
        value = F.col(c)
        for s, (_, new) in changes.items():
            if c in new:
                value = F.when(hits[s], new[c]).otherwise(value)
        cols[c] = value
    rest = [c for c in windowed.columns if c not in cols]
    return windowed.select(*rest, *[v.alias(c) for c, v in cols.items()], injected.alias("injected"))


def scenario_sweep(windowed: DataFrame, grid: DataFrame) -> DataFrame:
    """Every scenario (and parameter set) of ``grid`` over the same ticks; the grid is configuration."""
    return inject(windowed.crossJoin(broadcast_if_small(grid)), F.col("scenario"))


def inject_validated(shapes: DataFrame) -> DataFrame:
    """Expand anomaly shapes (``shape, base, depth, steps``) into validated ticks, one row per step.

    Shapes: ``crash`` drops and recovers, ``liquidity`` widens the spread, ``volume`` multiplies volume, ``drift`` rises
    evenly, ``volatility`` alternates, ``combined`` drops with wide spread and volume.
    """
    rows = shapes.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)))
    x = F.col("step") / F.greatest(F.lit(1), F.col("steps") - 1)
    tent = 1.0 - F.abs(2.0 * x - 1.0)
    falls = F.col("shape").isin("crash", "combined")
    move = (
        F.when(falls, -F.col("depth") * tent)
        .when(F.col("shape") == "drift", F.col("depth") * x)
        .when(F.col("shape") == "volatility", F.col("depth") * F.when(F.col("step") % 2 == 0, 1.0).otherwise(-1.0))
        .otherwise(F.lit(0.0))
    )
    return (
        rows.withColumn("mid", F.col("base") * (1.0 + move))
        .withColumn("spread", F.when(F.col("shape").isin("liquidity", "combined"), F.col("depth")).otherwise(F.lit(0.0001)))
        .withColumn("volume_24h", F.when(F.col("shape").isin("volume", "combined"), 10.0).otherwise(1.0))
    )


def synthesize_sources(ticks: DataFrame, venues: DataFrame) -> DataFrame:
    """Fan one anchor stream out to several venues with outages, price jitter, spread, volume and delay.

    ``venues``: ``venue, outage, jitter_bps, delay_ms``. Every draw is a hash of tick, venue and purpose, so the result
    does not depend on partitioning and a retried task repeats it.
    """
    def unit(purpose: str) -> Column:
        text = F.concat_ws("|", F.col("tick_id").cast("string"), F.col("venue"), F.lit(purpose))
        return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)

    def around(purpose: str) -> Column:
        return unit(purpose) * 2.0 - 1.0

    rows = ticks.crossJoin(broadcast_if_small(venues)).where(unit("outage") >= F.col("outage"))
    mid = F.col("mid") * (1.0 + around("price") * F.col("jitter_bps") / 10_000.0)
    half = (F.col("ask") - F.col("bid")) / 2.0 * (1.0 + around("spread") * 0.10)
    return rows.select(
        "tick_id", "symbol", F.col("venue").alias("exchange_id"), mid.alias("mid"), (mid - half).alias("bid"), (mid + half).alias("ask"),
        (F.col("volume_24h") * (1.0 + around("volume") * 0.05)).alias("volume_24h"), (F.col("ts_ms") + F.col("delay_ms")).alias("ts_ms"),
    )


# ---------------------------------------------------------------------------------------------------- episodes


def attack_episodes(scored: DataFrame, layout: Layout = TICKS, *, budget: int = 5) -> DataFrame:
    """Number the attack episodes over scored ticks with an ``injected`` flag.

    An injected tick keeps an episode alive for ``budget`` scored ticks; the first one after that starts a new episode.
    Adds ``in_episode`` and ``episode`` (null outside).
    """
    base = materialise(index_rows(scored, layout))
    at = running(base, layout, _last=Scan("max", F.when(F.col("injected"), F.col("_rn")), exclusive=True))
    fresh = F.col("injected") & (F.col("_last").isNull() | (F.col("_rn") - F.col("_last") >= budget))
    out = running(at.withColumn("_fresh", fresh.cast("int")), layout, _no=Scan("sum", F.col("_fresh")))
    last = F.when(F.col("injected"), F.col("_rn")).otherwise(F.col("_last"))
    alive = F.coalesce(F.col("_rn") - last < budget, F.lit(False))
    return (
        out.withColumn("in_episode", alive).withColumn("episode", F.when(alive, F.col("_no")))
        .drop("_rn", "_last", "_fresh", "_no")
    )


def detection_latency(episodes: DataFrame, keys: tuple[str, ...] = ("symbol",), *, threshold: float = 0.55) -> DataFrame:
    """Per episode, time from its start to the first tick that reaches the threshold; null where none does."""
    return (
        episodes.where(F.col("episode").isNotNull())
        .groupBy(*keys, "episode")
        .agg(F.min("ts_ms").alias("start_ms"), F.min(F.when(F.col("anomaly_score") >= threshold, F.col("ts_ms"))).alias("_hit"))
        .select(*keys, "episode", "start_ms", (F.col("_hit") - F.col("start_ms")).alias("latency_ms"))
    )


def detection_rates(episodes: DataFrame, keys: tuple[str, ...] = ("symbol",), *, threshold: float = 0.55, trust: float = 0.60) -> DataFrame:
    odd = F.col("anomaly_score") >= threshold
    out = episodes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_ticks"), F.count_if("injected").alias("injected"), F.count_if(odd & F.col("in_episode")).alias("detected"),
        F.count_if(odd & ~F.col("in_episode") & (F.col("trust_score") >= trust)).alias("false_positives"),
    )
    rest = F.col("total_ticks") - F.col("injected")
    return out.withColumn("detection_rate", F.when(F.col("injected") > 0, F.col("detected") / F.col("injected")).otherwise(0.0)).withColumn(
        "false_positive_rate", F.when(rest > 0, F.col("false_positives") / rest).otherwise(0.0))


# ------------------------------------------------------------------------------------------------------ ledger


def position_ledger(rows: DataFrame, layout: Layout = TICKS, *, fee: float = 0.001) -> DataFrame:
    """Fold ticks with optional signals into one position per key.

    Rows: ``mid``, ``direction`` (LONG, SHORT, CLOSE_ALL or null), ``size_pct``, ``stop``, ``target``. A position opens at the
    tick price, closes on stop, target, opposite signal or CLOSE_ALL; each side costs ``fee`` of its size. Adds ``position``
    (signed size after the tick), ``entry_price``, ``exit_reason``, ``realised`` (net of the exit fee) and ``cash_change``.
    """

    def fold(cols: dict[str, list], state: str) -> tuple[dict[str, list], str]:
        held = json.loads(state)  # [sign, size, entry, stop, target] or null
        out = {c: [] for c in ("position", "entry_price", "exit_reason", "realised", "cash_change")}
        for mid, direction, size, stop, target in zip(*(cols[c] for c in ("mid", "direction", "size_pct", "stop", "target"))):
            reason = realised = None
            cash = 0.0
            wanted = {"LONG": 1, "SHORT": -1}.get(direction)
            if held:
                sign = held[0]
                if held[3] is not None and (mid - held[3]) * sign <= 0:
                    reason = "STOP_HIT"
                elif held[4] is not None and (mid - held[4]) * sign >= 0:
                    reason = "TP_HIT"
                elif direction == "CLOSE_ALL":
                    reason = "CLOSE_ALL"
                elif wanted == -sign:
                    reason = "FLIP"
                if reason:
                    realised = held[1] * sign * (mid - held[2]) / held[2] - held[1] * fee
                    cash += realised
                    held = None
            if not held and wanted and size and size > 0:
                held = [wanted, size, mid, stop, target]
                cash -= size * fee
            out["position"].append(held[0] * held[1] if held else 0.0)
            out["entry_price"].append(held[2] if held else None)
            out["exit_reason"].append(reason)
            out["realised"].append(realised)
            out["cash_change"].append(cash)
        return out, json.dumps(held)

    return keyed_fold(
        rows, layout, fold, "null", ["mid", "direction", "size_pct", "stop", "target"],
        "position double, entry_price double, exit_reason string, realised double, cash_change double",
    )


def close_at_end(ledger: DataFrame, layout: Layout = TICKS, *, fee: float = 0.001) -> DataFrame:
    """Add a row for each key whose position is open after its last tick: it closes at that price, for the fee of one side.

    The row carries key, order columns and ``mid`` of the last tick, ``exit_reason`` END_OF_RUN and ``closing`` 1 (0 for ticks), the last
    order column of a curve; other columns are null. Keys without an open position get no row.
    """
    last = ledger.groupBy(*layout.keys).agg(F.max(F.struct(*layout.order, "mid", "position", "entry_price")).alias("_last"))
    held, mid, entry = (F.col(f"_last.{c}") for c in ("position", "mid", "entry_price"))
    realised = held * (mid - entry) / entry - F.abs(held) * fee
    closing = last.where(held != 0).select(
        *layout.keys, *[F.col(f"_last.{c}").alias(c) for c in (*layout.order, "mid")], F.lit(0.0).alias("position"), F.lit("END_OF_RUN").alias("exit_reason"),
        realised.alias("realised"), realised.alias("cash_change"), F.lit(1).alias("closing"))
    return ledger.withColumn("closing", F.lit(0)).unionByName(closing, allowMissingColumns=True)


def equity_curve(ledger: DataFrame, layout: Layout = TICKS, *, capital: float = 1.0) -> DataFrame:
    """Capital plus cash so far plus the open position's unrealised result."""
    out = running(ledger, layout, _cash=Scan("sum", F.col("cash_change")))
    open_result = F.when(F.col("entry_price") > 0, F.col("position") * (F.col("mid") - F.col("entry_price")) / F.col("entry_price"))
    return out.withColumn("equity", F.lit(capital) + F.col("_cash") + F.coalesce(open_result, F.lit(0.0))).drop("_cash")


# ----------------------------------------------------------------------------------------------------- metrics


def sharpe(curve: DataFrame, layout: Layout = TICKS, *, value: str = "equity") -> DataFrame:
    """Mean over population deviation of equity steps, times the root of their number; 0 for a flat curve."""
    steps = previous(curve, layout, _before=value).withColumn("_step", F.col(value) - F.col("_before"))
    out = steps.groupBy(*layout.keys).agg(
        F.avg("_step").alias("_mean"), F.stddev_pop("_step").alias("_sd"), F.count("_step").alias("steps"))
    ratio = F.when(F.col("_sd") > 1e-12, F.col("_mean") / F.col("_sd") * F.sqrt("steps")).otherwise(F.lit(0.0))
    return out.select(*layout.keys, "steps", ratio.alias("sharpe_ratio"))


def max_drawdown(curve: DataFrame, layout: Layout = TICKS, *, value: str = "equity") -> DataFrame:
    """Largest absolute fall from the running peak, which starts at 0."""
    out = running(curve, layout, _peak=Scan("max", F.col(value)))
    fall = F.greatest(F.col("_peak"), F.lit(0.0)) - F.col(value)
    return out.groupBy(*layout.keys).agg(F.greatest(F.lit(0.0), F.max(fall)).alias("max_drawdown"))


def win_rate(trades: DataFrame, keys: tuple[str, ...], value: str = "realised") -> DataFrame:
    closed = trades.where(F.col(value).isNotNull())
    return closed.groupBy(*keys).agg(F.count(F.lit(1)).alias("closed_trades"), F.avg((F.col(value) > 0).cast("double")).alias("win_rate"))


def state_share(rows: DataFrame, keys: tuple[str, ...], column: str = "system_state", state: str = "NORMAL") -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg((F.col(column) == state).cast("double")).alias("state_share"))


def stage_latency(rows: DataFrame, keys: tuple[str, ...], start: str, end: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(F.greatest(F.lit(0), F.col(end) - F.col(start))).alias("mean_latency_ms"))


def trust_statistics(rows: DataFrame, keys: tuple[str, ...], value: str = "trust_score") -> DataFrame:
    """Mean, deviation, extremes and exact percentiles of a large group without collecting it."""
    v = F.col(value)
    base = rows.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    pct = exact_quantiles(rows, list(keys), value, {"p5": 0.05, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95})
    return base.join(pct, list(keys)).withColumn("range", F.col("max") - F.col("min"))


def soak_checklist(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Variability checks of a run: trust spread, and ranges of agreement and of a detector score."""
    stats = trust_statistics(rows, keys)
    t2 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("anomaly_score")))
    more = rows.groupBy(*keys).agg(
        (F.max(t2) - F.min(t2) > 0.01).alias("t2_range_gt_001"),
        (F.max("detector_score") - F.min("detector_score") > 0.01).alias("t3_range_gt_001"),
    )
    return stats.join(more, list(keys)).select(
        *keys, (F.col("std") > 0).alias("trust_score_std_gt_zero"), (F.col("range") > 0.01).alias("trust_score_range_gt_001"),
        (F.col("p95") - F.col("p5") > 0.01).alias("trust_score_p95_minus_p5_gt_001"), "t2_range_gt_001", "t3_range_gt_001")


def permutation_test(steps: DataFrame, keys: tuple[str, ...], *, shuffles: int = 1000, value: str = "step", row_id: str = "tick_id", seed: int = 42) -> DataFrame:
    """Share of sign-flipped curves whose Sharpe ratio reaches the actual one.

    A reordering leaves the ratio as it is, so the null model flips the sign of each step by a hash of step and shuffle.
    Flipping keeps the sum of squares, so per shuffle only the signed sum is needed: every task reduces its rows to one
    vector of sums per key, and only those vectors are shuffled.
    """
    words = -(-shuffles // 64)
    rows = steps.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("_x"), *[F.xxhash64(F.col(row_id), F.lit(seed + i)).alias(f"_h{i}") for i in range(words)]
    )
    key_names = list(keys)
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("_v", T.ArrayType(T.DoubleType()))])

    def signed_sums(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            x = batch["_x"].to_numpy(zero_copy_only=False)
            words_ = np.stack([batch[f"_h{i}"].to_numpy(zero_copy_only=False) for i in range(words)], axis=1)
            bits = np.unpackbits(words_.view(np.uint8), axis=1)[:, :shuffles]
            names = list(zip(*[batch[k].to_pylist() for k in key_names]))
            order: dict[tuple, list[int]] = {}
            for i, name in enumerate(names):
                order.setdefault(name, []).append(i)
            for name, at in order.items():
                part = x[at] @ (bits[at] * 2.0 - 1.0)
                head = np.array([len(at), x[at].sum(), (x[at] ** 2).sum()])
                sums[name] = sums.get(name, 0.0) + np.concatenate([head, part])
        if sums:
            cols = [pa.array(c) for c in zip(*sums)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([v.tolist() for v in sums.values()])], names=[*key_names, "_v"])

    cells = rows.mapInArrow(signed_sums, schema).select(*keys, F.posexplode("_v").alias("_i", "_s"))
    totals = cells.groupBy(*keys, "_i").agg(F.sum("_s").alias("_s"))
    head = totals.where("_i < 3").groupBy(*keys).agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_s"))).alias(n) for i, n in enumerate(("_n", "_sum", "_sq"))])

    def ratio(total: Column) -> Column:
        mean = total / F.col("_n")
        var = F.col("_sq") / F.col("_n") - mean * mean
        return F.when(var > 1e-24, mean / F.sqrt(var) * F.sqrt("_n")).otherwise(F.lit(0.0))

    hits = totals.where("_i >= 3").join(head, list(keys)).groupBy(*keys).agg(
        F.first("_n").cast("long").alias("steps"), F.first(ratio(F.col("_sum"))).alias("sharpe_ratio"),
        (F.count_if(ratio(F.col("_s")) >= ratio(F.col("_sum"))) / F.lit(float(shuffles))).alias("p_value"))
    return hits


def walk_forward_windows(start_ms: int, end_ms: int, spark, *, fold_days: int = 15, minimum: int = 3) -> DataFrame:
    """Contiguous folds; the last one may be shorter."""
    width = fold_days * 86_400_000
    folds = -(-(end_ms - start_ms) // width)
    if folds < minimum:
        raise ValueError(f"{folds} folds, need {minimum}")
    f = F.col("id")
    return spark.range(folds).select(
        f.alias("fold"), (F.lit(start_ms) + f * width).alias("start_ms"), F.least(F.lit(start_ms) + (f + 1) * width, F.lit(end_ms)).alias("end_ms"))


def fold_id(start_ms: int, *, fold_days: int = 15, ts: str = "ts_ms") -> Column:
    """Fold of a row by division: no range join."""
    return F.floor((F.col(ts) - F.lit(start_ms)) / F.lit(fold_days * 86_400_000)).cast("long")


def walk_forward_summary(curve: DataFrame, layout: Layout, *, fold: str = "fold", value: str = "equity") -> DataFrame:
    """Metrics of every fold and their mean Sharpe ratio."""
    per_fold = layout.with_(keys=(*layout.keys, fold))
    out = sharpe(curve, per_fold, value=value).join(max_drawdown(curve, per_fold, value=value), list(per_fold.keys))
    mean = out.groupBy(*layout.keys).agg(F.avg("sharpe_ratio").alias("mean_sharpe"))
    return out.join(mean, list(layout.keys))


# -------------------------------------------------------------------------------------------------- comparison

# Which way each compared metric is better.
HIGHER_IS_BETTER = ("sharpe_ratio", "win_rate", "normal_state_pct", "net_pnl", "gross_pnl", "detection_rate")
LOWER_IS_BETTER = ("max_drawdown", "false_positives", "end_to_end_latency_ms", "permutation_p_value")


def compare_scenarios(metrics: DataFrame, names: list[str], keys: tuple[str, ...] = (), baseline: str = "baseline") -> DataFrame:
    """Long comparison of every scenario with the baseline of the same keys."""
    cast = metrics.select(*keys, "scenario", *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])
    long = cast.unpivot([*keys, "scenario"], names, "metric_name", "value")
    base = long.where(F.col("scenario") == baseline).select(*keys, "metric_name", F.col("value").alias("baseline_value"))
    out = long.where(F.col("scenario") != baseline).join(base, [*keys, "metric_name"]).withColumnRenamed("value", "attack_value")
    delta, b = F.col("attack_value") - F.col("baseline_value"), F.col("baseline_value")
    change = F.when(F.abs(b) >= 1e-12, delta / b * 100.0).when(F.abs(delta) < 1e-12, 0.0).when(delta > 0, 100.0).otherwise(-100.0)
    out = out.withColumn("delta", delta).withColumn("percent_change", change)
    up, m = F.col("percent_change") > 0, F.col("metric_name")
    direction = (
        F.when(F.abs("percent_change") < 0.01, "neutral")
        .when(m.isin(*HIGHER_IS_BETTER), F.when(up, "better").otherwise("worse"))
        .when(m.isin(*LOWER_IS_BETTER), F.when(up, "worse").otherwise("better"))
        .otherwise("neutral")
    )
    return out.withColumn("direction", direction)


def compare_runs(base: DataFrame, live: DataFrame, names: list[str], keys: tuple[str, ...]) -> DataFrame:
    """Two runs side by side: missing counts as 0, differences rounded to six places."""
    def long(df: DataFrame, out: str) -> DataFrame:
        cols = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) if n in df.columns else F.lit(0.0).alias(n) for n in names]
        return df.select(*keys, *cols).unpivot(list(keys), names, "metric_name", out)

    both = long(base, "baseline").join(long(live, "live"), [*keys, "metric_name"], "full")
    return both.na.fill(0.0, ["baseline", "live"]).withColumn("delta", F.round(F.col("live") - F.col("baseline"), 6))


def run_verdict(runs: DataFrame) -> DataFrame:
    """The four acceptance checks of a run."""
    checks = {
        "profit_or_significance": (F.col("net_pnl") > 0) | (F.col("p_value") < 0.05),
        "false_positives_ok": F.col("false_positive_rate") < 0.02,
        "drawdown_ok": F.col("max_drawdown") < 0.08,
        "reconciled": F.col("unresolved") == 0,
    }
    out = runs.select("*", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    passed = sum((F.col(n).cast("int") for n in checks), F.lit(0))
    return out.withColumn("passed_checks", passed).withColumn("passed", passed == len(checks))


def layer_statistics(events: DataFrame, keys: tuple[str, ...], states: tuple[str, ...] = ("NORMAL", "CONSERVATIVE", "DEGRADED", "HALT")) -> DataFrame:
    stats = [f(c).alias(f"{c}_{n}") for c in ("trust_score", "anomaly_score") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return events.groupBy(*keys).agg(*stats, *[F.count_if(F.col("system_state") == s).alias(f"n_{s.lower()}") for s in states])


def last_n_events(events: DataFrame, order: list[Column], n: int = 25) -> DataFrame:
    """A top-k report: the planner keeps ``n`` rows per task before merging them."""
    return events.orderBy(*order).limit(n)
