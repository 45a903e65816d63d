"""Anomaly detectors, score fusion and the state gate over validated ticks."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewatch.functions.arrays import array_median
from tidewatch.functions.scalar import log_return, price_jump_bps, spread_bps
from tidewatch.plans.fold import keyed_fold
from tidewatch.plans.frames import moments
from tidewatch.plans.layout import TICKS, Layout
from tidewatch.plans.machine import Machine, machine_fold
from tidewatch.plans.memory import passed
from tidewatch.plans.recurrence import Recurrence, recur
from tidewatch.plans.scans import INDEX, Scan, following, over_range, over_rows, running
from tidewatch.plans.store import materialise

WARMUP = 30


@dataclass(frozen=True)
class AbsoluteConfig:
    price_jump_bps: float = 200.0
    spread_bps: float = 100.0
    volume_spike_x: float = 15.0
    volume_window: int = 300


@dataclass(frozen=True)
class MadConfig:
    window: int = 100
    k_low_vol: float = 4.0
    k_high_vol: float = 8.0


@dataclass(frozen=True)
class VolRatioConfig:
    short_window: int = 30
    long_window: int = 300
    spike_ratio: float = 2.0
    extreme_ratio: float = 5.0
    normalize: bool = False


@dataclass(frozen=True)
class CusumConfig:
    threshold: float = 5.0
    drift: float = 0.5
    w_price: float = 0.5
    w_spread: float = 0.3
    w_volume: float = 0.2
    history: int = 1000


@dataclass(frozen=True)
class EwmaConfig:
    lam: float = 0.2
    limit: float = 3.0
    history: int = 1000

    @property
    def control(self) -> float:
        return self.limit * math.sqrt(self.lam / (2.0 - self.lam))


@dataclass(frozen=True)
class GateConfig:
    trust: float = 0.60
    anomaly: float = 0.55
    regime_shift: float = 0.10
    streak: int = 10


@dataclass(frozen=True)
class RegimeModel:
    """Two-state Gaussian model of realised volatility; means as published, the rest from ``fit_regimes``."""

    means: tuple[float, float] = (0.00270, 0.00679)
    sds: tuple[float, float] = (0.0010, 0.0030)
    start: tuple[float, float] = (0.5, 0.5)
    stay: tuple[float, float] = (0.95, 0.95)
    window: int = 30


@dataclass(frozen=True)
class ScoringConfig:
    absolute: AbsoluteConfig = AbsoluteConfig(price_jump_bps=100.0, spread_bps=50.0, volume_spike_x=10.0)
    mad: MadConfig = MadConfig()
    vol_ratio: VolRatioConfig = VolRatioConfig()
    cusum: CusumConfig = CusumConfig()
    ewma: EwmaConfig = EwmaConfig()
    gate: GateConfig = GateConfig()
    regime: RegimeModel = RegimeModel()
    rv_window_ms: int = 1_800_000
    memory: int = 30
    spread_unit: str = "relative"
    weights: dict[str, float] = field(
        default_factory=lambda: {"absolute": 0.35, "mad": 0.30, "vol_ratio": 0.15, "cusum": 0.10, "ewma": 0.10}
    )


DETECTORS = ("absolute", "mad", "vol_ratio", "cusum", "ewma")


def verdict(score: Column, triggered: bool | Column, reason: str | Column) -> Column:
    """A detector result struct."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        score.cast("double").alias("score"), as_col(triggered).alias("triggered"), as_col(reason).alias("reason")
    )


# ---------------------------------------------------------------------------------------------------- features


def tick_features(ticks: DataFrame, layout: Layout = TICKS, *, spread_unit: str = "relative") -> DataFrame:
    """Return, jump, spread and volume of each tick, and its row number within the key."""
    out = running(
        ticks,
        layout,
        _prev_mid=Scan("last", F.struct(F.col("mid").alias("v")), exclusive=True),
        **{INDEX: Scan("count")},
    )
    before = F.coalesce(F.col("_prev_mid.v"), F.col("mid"))
    return (
        out.withColumn("ret", log_return("mid", before))
        .withColumn("jump_bps", price_jump_bps("mid", before))
        .withColumn("spread_bps", spread_bps("spread", "mid", spread_unit))
        .withColumn("volume", F.coalesce(F.col("volume_24h"), F.lit(0.0)))
        .drop("_prev_mid")
    )


def rv(features: DataFrame, layout: Layout = TICKS, *, window_ms: int = 1_800_000, out: str = "rv") -> DataFrame:
    """Realised volatility: root of the summed squared returns within the time window, ends included.

    The window sum is the difference of two growing sums, so its cost does not depend on how many ticks it spans.
    Ticks with equal times share a frame; give ``layout.ts`` unique times per key where that matters.
    """

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        square = F.col("ret") * F.col("ret")
        upto = F.sum(square).over(w.rangeBetween(Window.unboundedPreceding, 0))
        before = F.sum(square).over(w.rangeBetween(Window.unboundedPreceding, -window_ms - 1))
        return df.withColumn(out, F.sqrt(F.greatest(F.lit(0.0), upto - F.coalesce(before, F.lit(0.0)))))

    return over_range(features, layout, window_ms, build)


def volume_ratio(features: DataFrame, layout: Layout = TICKS, *, window: int = 300) -> DataFrame:
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        mean = F.coalesce(F.col("_vol.mean"), F.lit(1.0))
        ratio = F.when(mean > 0, F.col("volume") / mean).otherwise(F.lit(1.0))
        return moments(df, w, window, lagged=True, _vol="volume").withColumn("volume_ratio", ratio).drop("_vol")

    return over_rows(features, layout, window, build)


# --------------------------------------------------------------------------------------------------- detectors
# Each ``*_columns`` function adds its result struct inside a prepared row window and states how far it looks back.


def absolute_columns(df: DataFrame, w: WindowSpec, cfg: AbsoluteConfig = AbsoluteConfig()) -> DataFrame:
    df = moments(df, w, cfg.volume_window, lagged=True, _vol="volume")
    return absolute_verdict(df.withColumn("_vol", F.col("_vol.mean")), cfg)


def absolute_verdict(df: DataFrame, cfg: AbsoluteConfig = AbsoluteConfig()) -> DataFrame:
    """The detector's struct from ``_vol``, the mean volume of the rows before."""
    jump = F.abs("jump_bps") / F.lit(cfg.price_jump_bps)
    wide = F.col("spread_bps") / F.lit(cfg.spread_bps)
    mean = F.coalesce(F.col("_vol"), F.lit(1.0))
    spike = F.when(mean > 0, F.col("volume") / mean / F.lit(cfg.volume_spike_x)).otherwise(F.lit(0.0))
    closest = F.greatest(jump, wide, spike)
    limit = F.lit(0.95)
    return df.withColumn(
        "absolute",
        F.when(jump > 1, verdict(F.least(limit, 0.40 + 0.35 * (jump - 1)), True, "flash_crash_price"))
        .when(wide > 1, verdict(F.least(limit, 0.40 + 0.30 * (wide - 1)), True, "liquidity_spread"))
        .when(spike > 1, verdict(F.least(limit, 0.35 + 0.25 * (spike - 1)), True, "volume_spike"))
        .otherwise(verdict(F.least(F.lit(0.49), closest * 0.49), False, "normal")),
    ).drop("_vol")


def mad_columns(df: DataFrame, w: WindowSpec, cfg: MadConfig = MadConfig()) -> DataFrame:
    frame = w.rowsBetween(-(cfg.window - 1), 0)
    df = (
        df.withColumn("_rets", F.collect_list("ret").over(frame))
        .withColumn("_med", array_median(F.col("_rets")))
        .withColumn("_mad", array_median(F.transform("_rets", lambda x: F.abs(x - F.col("_med")))))
        .withColumn("_rets", F.size("_rets"))
    )
    return mad_verdict(df, cfg)


def mad_verdict(df: DataFrame, cfg: MadConfig = MadConfig()) -> DataFrame:
    """The detector's struct from the number, median and median deviation of the window's returns."""
    z = F.abs(F.col("ret") - F.col("_med")) / (F.lit(1.4826) * F.col("_mad"))
    k = F.when(F.col("regime") == 1, F.lit(cfg.k_high_vol)).otherwise(F.lit(cfg.k_low_vol))
    return df.withColumn(
        "mad",
        F.when(F.col("_rets") < WARMUP, verdict(F.lit(0.25), False, "warming_up"))
        .when(F.col("_mad") < 1e-12, verdict(F.lit(0.3), False, "flat_market"))
        .when(z > k, verdict(F.least(F.lit(0.95), 0.50 + 0.35 * ((z - k) / k)), True, "mad_outlier"))
        .otherwise(verdict(F.least(F.lit(0.49), z / k * 0.49), False, "normal")),
    ).drop("_rets", "_med", "_mad")


def vol_ratio_columns(df: DataFrame, w: WindowSpec, cfg: VolRatioConfig = VolRatioConfig()) -> DataFrame:
    df = df.withColumn("_square", F.col("ret") * F.col("ret"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_all", F.struct(F.sum("_square").over(upto).alias("s"), F.count("_square").over(upto).alias("n")))
    for name, n in (("_short", cfg.short_window), ("_long", cfg.long_window)):
        old = F.lag("_all", n).over(w)
        total = F.greatest(F.lit(0.0), F.col("_all.s") - F.coalesce(old["s"], F.lit(0.0)))
        size = F.col("_all.n") - F.coalesce(old["n"], F.lit(0)) if cfg.normalize else F.lit(1.0)
        df = df.withColumn(name, F.sqrt(total / size))
    return vol_ratio_verdict(df.drop("_square", "_all"), cfg)


def vol_ratio_verdict(df: DataFrame, cfg: VolRatioConfig = VolRatioConfig()) -> DataFrame:
    """The detector's struct from the volatilities ``_short`` and ``_long``."""
    ratio = F.col("_short") / F.col("_long")
    spike, extreme = cfg.spike_ratio, cfg.extreme_ratio
    return df.withColumn(
        "vol_ratio",
        F.when(F.least(F.col(INDEX), F.lit(cfg.short_window)) < WARMUP, verdict(F.lit(0.25), False, "warming_up"))
        .when((F.col("_long") < 1e-12) & (F.col("_short") > 1e-8), verdict(F.lit(0.7), True, "vol_from_zero"))
        .when(F.col("_long") < 1e-12, verdict(F.lit(0.0), False, "normal"))
        .when(
            ratio >= extreme,
            verdict(F.least(F.lit(0.95), 0.70 + 0.15 * ((ratio - extreme) / extreme)), True, "vol_explosion"),
        )
        .when(ratio >= spike, verdict(0.45 + 0.25 * ((ratio - spike) / (extreme - spike)), True, "vol_spike"))
        .otherwise(verdict(F.least(F.lit(0.49), ratio / spike * 0.49), False, "normal")),
    ).drop("_short", "_long")


def _z(value: str, m: str, flat: float) -> Column:
    """Sample z-score against a moments column; the deviation counts as ``flat`` where it vanishes (0: no score)."""
    off, sd = F.col(value) - F.col(f"{m}.mean"), F.col(f"{m}.sd")
    if flat:
        return off / F.when(sd < 1e-9, F.lit(flat)).otherwise(sd)
    return F.when(sd < 1e-9, F.lit(0.0)).otherwise(off / sd)


def cusum_input(df: DataFrame, w: WindowSpec, cfg: CusumConfig = CusumConfig()) -> DataFrame:
    """Add the weighted z-score against earlier rows that the accumulators consume."""
    warm = F.col(INDEX) - 1 >= WARMUP
    df = moments(df, w, cfg.history, lagged=True, _mj="jump_bps", _ms="spread_bps", _mv="volume")
    parts = ((cfg.w_price, "jump_bps", "_mj"), (cfg.w_spread, "spread_bps", "_ms"), (cfg.w_volume, "volume", "_mv"))
    z = sum((F.lit(k) * F.when(warm, _z(v, m, 0.0)).otherwise(F.lit(0.0)) for k, v, m in parts), F.lit(0.0))
    return df.withColumn("cusum_z", z).drop("_mj", "_ms", "_mv")


def ewma_input(df: DataFrame, w: WindowSpec, cfg: EwmaConfig = EwmaConfig()) -> DataFrame:
    """Add the two driving terms of the control charts: the first z-score itself, then ``lam * z``."""
    df = moments(df, w, cfg.history, _mj="jump_bps", _ms="spread_bps")
    for name, value, m in (("price", "jump_bps", "_mj"), ("spread", "spread_bps", "_ms")):
        z = _z(value, m, 1.0)
        df = df.withColumn(
            f"ewma_{name}_b",
            F.when(F.col(INDEX) == WARMUP, z).when(F.col(INDEX) > WARMUP, F.lit(cfg.lam) * z),
        )
    return df.drop("_mj", "_ms")


def ewma_columns(df: DataFrame, cfg: EwmaConfig = EwmaConfig()) -> DataFrame:
    def channel(name: str) -> Column:
        e, limit = F.abs(f"ewma_{name}"), cfg.control
        return (
            F.when(F.col(INDEX) < WARMUP, F.lit(0.25))
            .when(e > limit, F.least(F.lit(0.95), 0.5 + 0.5 * ((e - limit) / limit)))
            .otherwise(F.least(F.lit(0.49), e / limit * 0.49))
        )

    df = df.withColumn("_p", channel("price")).withColumn("_s", channel("spread"))
    score = F.greatest("_p", "_s")
    reason = F.when(score < 0.5, "normal").when(F.col("_s") >= F.col("_p"), "ewma_spread").otherwise("ewma_price")
    return df.withColumn("ewma", verdict(score, score >= 0.5, reason)).drop("_p", "_s")


def absolute_detector(features: DataFrame, layout: Layout = TICKS, *, cfg: AbsoluteConfig = AbsoluteConfig()) -> DataFrame:
    return over_rows(features, layout, cfg.volume_window, lambda df, w: absolute_columns(df, w, cfg))


def mad_detector(features: DataFrame, layout: Layout = TICKS, *, cfg: MadConfig = MadConfig()) -> DataFrame:
    return over_rows(features, layout, cfg.window, lambda df, w: mad_columns(df, w, cfg))


def vol_ratio_detector(features: DataFrame, layout: Layout = TICKS, *, cfg: VolRatioConfig = VolRatioConfig()) -> DataFrame:
    return over_rows(features, layout, cfg.long_window, lambda df, w: vol_ratio_columns(df, w, cfg))


def ewma_detector(features: DataFrame, layout: Layout = TICKS, *, cfg: EwmaConfig = EwmaConfig()) -> DataFrame:
    prepared = over_rows(features, layout, cfg.history, lambda df, w: ewma_input(df, w, cfg))
    charts = recur(
        prepared,
        layout,
        ewma_price=Recurrence("ewma_price_b", 1.0 - cfg.lam),
        ewma_spread=Recurrence("ewma_spread_b", 1.0 - cfg.lam),
    )
    return ewma_columns(charts, cfg).drop("ewma_price_b", "ewma_spread_b")


def cusum_accumulate(df: DataFrame, layout: Layout = TICKS, *, cfg: CusumConfig = CusumConfig()) -> DataFrame:
    """Fold ``cusum_z`` into the two accumulators, which restart after each alarm; adds ``cusum_pos``, ``cusum_neg``."""

    def fold(cols: dict[str, list], state: str) -> tuple[dict[str, list], str]:
        up, down = json.loads(state)
        ups, downs = [], []
        for n, z in zip(cols[INDEX], cols["cusum_z"]):
            if n >= WARMUP:
                up, down = max(0.0, up + z - cfg.drift), max(0.0, down - z - cfg.drift)
            ups.append(up)
            downs.append(down)
            if max(up, down) >= cfg.threshold:
                up = down = 0.0
        return {"cusum_pos": ups, "cusum_neg": downs}, json.dumps([up, down])

    return keyed_fold(df, layout, fold, "[0.0, 0.0]", [INDEX, "cusum_z"], "cusum_pos double, cusum_neg double")


def cusum_columns(df: DataFrame, cfg: CusumConfig = CusumConfig()) -> DataFrame:
    top = F.greatest("cusum_pos", "cusum_neg") / F.lit(cfg.threshold)
    side = F.when(F.col("cusum_pos") >= F.col("cusum_neg"), "cusum_drift_up").otherwise("cusum_drift_down")
    return df.withColumn(
        "cusum",
        F.when(F.col(INDEX) < WARMUP, verdict(F.lit(0.25), False, "warming_up"))
        .when(top >= 1, verdict(F.least(F.lit(0.95), top), True, side))
        .otherwise(verdict(F.least(F.lit(0.64), top * 0.64), False, "normal")),
    )


def cusum_detector(features: DataFrame, layout: Layout = TICKS, *, cfg: CusumConfig = CusumConfig()) -> DataFrame:
    prepared = over_rows(features, layout, cfg.history, lambda df, w: cusum_input(df, w, cfg))
    narrow = prepared.select(*layout.keys, *layout.order, INDEX, "cusum_z")
    return cusum_columns(cusum_accumulate(narrow, layout, cfg=cfg), cfg)


def cusum_lindley(prepared: DataFrame, layout: Layout = TICKS, *, cfg: CusumConfig = CusumConfig()) -> DataFrame:
    """Accumulators without restart: a prefix sum minus its running minimum, no sequential fold."""
    steps = materialise(prepared).withColumn("_up", F.col("cusum_z") - cfg.drift).withColumn("_down", -F.col("cusum_z") - cfg.drift)
    sums = running(steps, layout, _su=Scan("sum", F.col("_up")), _sd=Scan("sum", F.col("_down")))
    lows = running(sums, layout, _mu=Scan("min", F.col("_su")), _md=Scan("min", F.col("_sd")))
    return (
        lows.withColumn("cusum_pos", F.col("_su") - F.least(F.lit(0.0), "_mu"))
        .withColumn("cusum_neg", F.col("_sd") - F.least(F.lit(0.0), "_md"))
        .drop("_up", "_down", "_su", "_sd", "_mu", "_md")
    )


# ------------------------------------------------------------------------------------------------------ regime


def _last_state(model: RegimeModel):
    """Vectorised decoder: for every list of recent values, the best path's last state and its filtered probability.

    Runs over Arrow batches: one numpy step per position of the window, for all rows of a batch at once. Lists are read as their
    flat values and sizes, so no row becomes an object of Python.
    """
    ln, n = math.log, model.window
    stay0, stay1 = model.stay
    move = np.array([[ln(stay0), ln(1 - stay0)], [ln(1 - stay1), ln(stay1)]])

    def decode(recent: pa.Array) -> pa.Array:
        passed(recent.nbytes)
        sizes = pc.list_value_length(recent).to_numpy(zero_copy_only=False)
        x = np.full((len(recent), n), np.nan)
        x[np.arange(n)[None, :] >= n - sizes[:, None]] = recent.flatten().to_numpy(zero_copy_only=False)
        z = [(x - m) / s for m, s in zip(model.means, model.sds)]
        emit = [-ln(s) - 0.5 * ln(2 * math.pi) - q * q / 2.0 for s, q in zip(model.sds, z)]
        f = v = None
        for t in range(n):
            e = np.stack([emit[0][:, t], emit[1][:, t]])
            begin = e + np.log(np.array(model.start))[:, None]
            if f is None:
                f, v = begin, begin
                continue
            starts = (sizes == n - t)[None, :]
            steps = f[:, None, :] + move[:, :, None]
            with np.errstate(invalid="ignore"):  # positions before the window starts
                f = np.where(starts, begin, e + np.logaddexp(steps[0], steps[1]))
            v = np.where(starts, begin, e + (v[:, None, :] + move[:, :, None]).max(axis=0))
        high = 1.0 / (1.0 + np.exp(f[0] - f[1]))
        return pa.StructArray.from_arrays([pa.array((v[1] > v[0]).astype("int32")), pa.array(high)], ["regime", "high"])

    return F.arrow_udf(decode, "regime int, high double")


def regime_columns(df: DataFrame, w: WindowSpec, model: RegimeModel = RegimeModel(), value: str = "rv") -> DataFrame:
    """Most likely path's last state and the filtered probability over the last ``model.window`` values."""
    return regime_verdict(df.withColumn("_recent", F.collect_list(value).over(w.rowsBetween(-(model.window - 1), 0))), model)


def regime_verdict(df: DataFrame, model: RegimeModel = RegimeModel()) -> DataFrame:
    """The same from ``_recent``, the list of those values."""
    out = df.withColumn("_hmm", _last_state(model)("_recent"))
    return (
        out.withColumn("regime", F.col("_hmm.regime"))
        .withColumn("regime_posterior", F.array(1.0 - F.col("_hmm.high"), F.col("_hmm.high")))
        .drop("_hmm", "_recent")
    )


def hmm_regime(features: DataFrame, layout: Layout = TICKS, *, model: RegimeModel = RegimeModel(), value: str = "rv") -> DataFrame:
    return over_rows(features, layout, model.window, lambda df, w: regime_columns(df, w, model, value))


# ------------------------------------------------------------------------------------------------------ fusion


def fuse_scores(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Combine the five detector structs into ``fused_score``, ``reason``, ``triggered_count``, ``max_detector_score``."""
    weights = weights or ScoringConfig().weights
    on = {d: F.col(f"{d}.triggered") for d in DETECTORS}
    score = {d: F.col(f"{d}.score") for d in DETECTORS}

    def total(terms) -> Column:
        return sum(terms, F.lit(0.0))

    hit_weight = total(F.when(on[d], F.lit(weights[d])).otherwise(F.lit(0.0)) for d in DETECTORS)
    hit_sum = total(F.when(on[d], F.lit(weights[d]) * score[d]).otherwise(F.lit(0.0)) for d in DETECTORS)
    all_sum = total(F.lit(weights[d]) * score[d] for d in DETECTORS) / F.lit(sum(weights.values()))
    count = sum((on[d].cast("int") for d in DETECTORS), F.lit(0))
    top = F.greatest(*score.values())
    hit_reasons = F.concat_ws(" + ", *[F.when(on[d], F.col(f"{d}.reason")) for d in DETECTORS])
    first_top = F.coalesce(*[F.when(score[d] == top, F.col(f"{d}.reason")) for d in DETECTORS])
    return (
        df.withColumn("triggered_count", count)
        .withColumn("max_detector_score", top)
        .withColumn(
            "fused_score",
            F.when(count >= 2, F.least(F.lit(0.85), hit_sum / hit_weight)).otherwise(F.least(F.lit(0.70), all_sum)),
        )
        .withColumn(
            "reason",
            F.when(count >= 2, F.concat(F.lit("coincidence: "), hit_reasons))
            .when(count == 1, hit_reasons)
            .when(top < 0.20, "normal")
            .otherwise(first_top),
        )
    )


def score_memory(df: DataFrame, layout: Layout = TICKS, *, window: int = 30, value: str = "fused_score") -> DataFrame:
    return over_rows(
        df, layout, window, lambda d, w: d.withColumn("anomaly_score", F.max(value).over(w.rowsBetween(-(window - 1), 0)))
    )


def spc_combined() -> Column:
    """Mean of the two control-chart scores."""
    return (F.col("cusum.score") + F.col("ewma.score")) / 2.0


# -------------------------------------------------------------------------------------------------------- gate

SEVERITY = ("NORMAL", "CONSERVATIVE", "DEGRADED", "HALT")


def gate_base_state(
    trust: str = "trust_score", anomaly: str = "anomaly_score", regime: str = "regime", cfg: GateConfig = GateConfig()
) -> Column:
    trusted = F.col(trust) >= cfg.trust
    shift = F.when(F.col(regime) == 0, F.lit(-cfg.regime_shift)).otherwise(F.lit(cfg.regime_shift))
    odd = F.col(anomaly) >= F.lit(cfg.anomaly) + shift
    return (
        F.when(trusted & ~odd, "NORMAL").when(trusted, "CONSERVATIVE").when(~odd, "DEGRADED").otherwise("HALT")
    )


def gate_step(state: int, target: int, streak: int, base: int, needed: int) -> tuple[int, int, int]:
    """One move of the gate: worse at once, better after ``needed`` equal wishes in a row, out of HALT only to NORMAL."""
    if base > state:
        return base, -1, 0
    if state == 3:
        streak = streak + 1 if base == 0 else 0
        return (0, target, 0) if streak >= needed else (3, target, streak)
    if base == state:
        return state, -1, 0
    streak = streak + 1 if target == base else 1
    return (base, -1, 0) if streak >= needed else (state, base, streak)


def decision_gate(df: DataFrame, layout: Layout = TICKS, *, cfg: GateConfig = GateConfig(), base: str = "base_state") -> DataFrame:
    """Add ``system_state``: the base state passed through the gate of each key."""
    levels = range(len(SEVERITY))
    machine = Machine.of((0, -1, 0), levels, lambda now, wish: gate_step(*now, wish, cfg.streak), lambda now: SEVERITY[now[0]])
    wish = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col(base)).cast("int") - 1
    return machine_fold(df.withColumn("_wish", wish), layout, machine, "_wish", "system_state").drop("_wish")


# --------------------------------------------------------------------------------------------------- composite


def score_ticks(validated: DataFrame, layout: Layout = TICKS, *, cfg: ScoringConfig | None = None) -> DataFrame:
    """Score validated ticks (key, order, ``mid``, ``trust_score``, ``volume_24h``, ``spread``) end to end.

    One scan for lags and row numbers, one time-slot pass for realised volatility, one chunked pass for every bounded
    window, one recurrence pass, and two folds over narrow tables.
    """
    cfg = cfg or ScoringConfig()
    names = [*layout.keys, *layout.order]
    narrow = validated.select(*names, "mid", "trust_score", "volume_24h", "spread")
    features = rv(tick_features(narrow, layout, spread_unit=cfg.spread_unit), layout, window_ms=cfg.rv_window_ms)

    def windows(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = regime_columns(df, w, cfg.regime)
        df = absolute_columns(df, w, cfg.absolute)
        df = mad_columns(df, w, cfg.mad)
        df = vol_ratio_columns(df, w, cfg.vol_ratio)
        df = cusum_input(df, w, cfg.cusum)
        return ewma_input(df, w, cfg.ewma)

    reach = max(
        cfg.regime.window, cfg.absolute.volume_window, cfg.mad.window, cfg.vol_ratio.long_window,
        cfg.cusum.history, cfg.ewma.history,
    )
    prepared = over_rows(features, layout, reach, windows)
    charts = recur(
        prepared,
        layout,
        ewma_price=Recurrence("ewma_price_b", 1.0 - cfg.ewma.lam),
        ewma_spread=Recurrence("ewma_spread_b", 1.0 - cfg.ewma.lam),
    ).drop("ewma_price_b", "ewma_spread_b")
    scored = ewma_columns(cusum_columns(cusum_accumulate(charts, layout, cfg=cfg.cusum), cfg.cusum), cfg.ewma)
    fused = score_memory(fuse_scores(scored, cfg.weights), layout, window=cfg.memory)
    gated = decision_gate(
        fused.select(
            *names, INDEX, "mid", "trust_score", "volume_24h", "spread", "ret", "rv", "regime", "jump_bps", "spread_bps",
            "fused_score", "anomaly_score", "reason", "triggered_count", "max_detector_score",
            *[F.col(f"{d}.score").alias(f"{d}_score") for d in DETECTORS],
            gate_base_state(cfg=cfg.gate).alias("base_state"),
        ),
        layout,
        cfg=cfg.gate,
    )
    return gated


# ----------------------------------------------------------------------------------------------- telemetry jobs


def transitions(df: DataFrame, column: str, layout: Layout = TICKS) -> DataFrame:
    """Counts of value changes by key, old and new value."""
    w = running(df, layout, _was=Scan("last", F.struct(F.col(column).alias("v")), exclusive=True))
    return (
        w.withColumn("from_value", F.col("_was.v"))
        .where(F.col("_was").isNotNull() & ~F.col("from_value").eqNullSafe(F.col(column)))
        .groupBy(*layout.keys, "from_value", F.col(column).alias("to_value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def gate_triggers(scored: DataFrame, layout: Layout = TICKS, *, trust: float = 0.6, anomaly: float = 0.8) -> DataFrame:
    """On each state change, count low trust and high anomaly as causes."""
    w = running(scored, layout, _was=Scan("last", F.col("system_state"), exclusive=True))
    changed = w.where(F.col("_was").isNotNull() & (F.col("_was") != F.col("system_state")))
    return changed.groupBy(*layout.keys).agg(
        F.count_if(F.col("trust_score") < trust).alias("trust_low"),
        F.count_if(F.col("anomaly_score") > anomaly).alias("anomaly_high"),
    )


def anomaly_reasons(scored: DataFrame, keys: tuple[str, ...] = ("symbol",), *, above: float = 0.5) -> DataFrame:
    return scored.where(F.col("anomaly_score") > above).groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))


def score_histogram(scored: DataFrame, keys: tuple[str, ...] = ("symbol",), *, value: str = "anomaly_score") -> DataFrame:
    """Cumulative counts at 0, 0.1, ... 1: one pass of conditional counts, turned into rows."""
    bounds = [i / 10 for i in range(11)]
    wide = scored.groupBy(*keys).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    cells = F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]))
    return wide.select(*keys, cells.alias("c")).select(*keys, "c.le", "c.n")


def coincidence_counts(scored: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return scored.groupBy(*keys).agg(
        F.count_if(F.col("triggered_count") >= 2).alias("coincidences"), F.count(F.lit(1)).alias("ticks")
    )


def silence_watchdog(ticks: DataFrame, layout: Layout = TICKS, *, silence_ms: int = 30_000, end_ms: int | None = None) -> DataFrame:
    """One forced HALT row per silent episode, stamped when the silence limit passed."""
    after = following(ticks, layout, next_ts=layout.ts)
    limit = F.col(layout.ts) + F.lit(silence_ms)
    until = F.coalesce("next_ts", F.lit(end_ms).cast("long"))
    return after.where(until > limit).select(
        *layout.keys, limit.alias("halt_ts_ms"), F.col(layout.ts).alias("last_ts_ms"), F.col("next_ts").alias("resumed_ts_ms"),
        F.lit("HALT").alias("system_state"), F.lit("silence_watchdog").alias("reason"),
    )
