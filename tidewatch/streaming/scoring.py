"""The scoring engine as a stream: windows and accumulators in state, verdicts and fusion as column expressions.

Rows of a key are held until the watermark has passed them and are then taken in event order, so the result is that of the
batch operator on those rows, however the input is cut into batches. The state of a key is bounded: the rows of the longest window, the
rows of the volatility's time range and those the watermark hasn't passed. A second stage remembers the last scores and moves the gate.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidewatch.operators import anomaly as A
from tidewatch.plans.scans import INDEX
from tidewatch.streaming.held import HeldRows
from tidewatch.streaming.operators import with_event_time

_INPUT = "ts_ms long, tick_id long, mid double, trust_score double, volume_24h double, spread double"
_NUMBERS = ("ret", "jump_bps", "spread_bps", "volume", "rv", "_vol", "_med", "_mad", "_short", "_long", "cusum_pos", "cusum_neg", "ewma_price", "ewma_spread")
_FEATURES = f"symbol string, {_INPUT}, {INDEX} long, {', '.join(f'{n} double' for n in _NUMBERS)}, _rets int, _recent array<double>"
#: Rows whose windows are laid out as one matrix.
SLICE = 1_000


def _window_stats(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of each row, leaving out NaN; NaN where too few values are left."""
    n = (~np.isnan(x)).sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.nansum(x, axis=1) / n
        sd = np.sqrt(np.nansum((x - mean[:, None]) ** 2, axis=1) / (n - 1))
    return mean, sd


def _moving_stats(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_window_stats` of every window of ``size`` values at a cost that does not grow with it.

    Windows are differences of growing sums about the mean. Where a window's squares are too small a part of the sum to keep their
    digits, the window is summed on its own; windows of equal values deviate by exactly 0.
    """
    known = ~np.isnan(x)
    frames, at = np.lib.stride_tricks.sliding_window_view(x, size), np.arange(len(x) - size + 1)
    if not np.isfinite(x[known]).all():
        return _window_stats(frames)
    centre = x[known].mean() if known.any() else 0.0
    off = np.where(known, x - centre, 0.0)
    grow = lambda v: np.r_[0, np.cumsum(v)]
    counts, sums, squares = grow(known), grow(off), grow(off * off)
    n, s1, s2 = counts[at + size] - counts[at], sums[at + size] - sums[at], squares[at + size] - squares[at]
    place = np.where(known, np.arange(len(x)), -1)
    before = np.r_[-1, np.maximum.accumulate(place)[:-1]]  # the last value before this one
    changes = grow(known & (before >= 0) & (x != x[np.maximum(before, 0)]))
    first = np.minimum.accumulate(np.where(known, np.arange(len(x)), len(x))[::-1])[::-1][at]  # the first value of the window
    flat = changes[at + size] == changes[np.minimum(first + 1, at + size)]
    with np.errstate(invalid="ignore", divide="ignore"):
        left = np.maximum(0.0, s2 - s1 * s1 / n)
        mean, sd = centre + s1 / n, np.where(n > 1, np.where(flat, 0.0, np.sqrt(left / (n - 1))), np.nan)
    weak = ~flat & (left < 1e-5 * squares[at + size])
    for i in range(0, len(at), SLICE):
        some = np.flatnonzero(weak[i:i + SLICE]) + i
        if len(some):
            mean[some], sd[some] = _window_stats(frames[some])
    return mean, sd


def _median(x: np.ndarray) -> np.ndarray:
    """Median of each row, leaving out NaN (which sort last); every row holds a number."""
    x, n = np.sort(x, axis=1), (~np.isnan(x)).sum(axis=1)
    at = np.arange(len(x))
    return (x[at, (n - 1) // 2] + x[at, n // 2]) / 2


class FeatureProcessor(StatefulProcessor):
    """Per symbol: the inputs of every detector for the rows the watermark has passed."""

    def __init__(self, cfg: A.ScoringConfig) -> None:
        self.cfg = cfg
        self.reach = max(cfg.absolute.volume_window, cfg.mad.window, cfg.vol_ratio.long_window, cfg.cusum.history, cfg.ewma.history)

    def init(self, handle) -> None:
        self.handle = handle
        self.held = HeldRows(handle, tuple(c.split()[0] for c in _INPUT.split(", "))[2:])
        self.memory = handle.getValueState("memory", "body string")

    def handleInputRows(self, key, rows, timerValues):
        self.held.add(rows)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        memory = None
        for table in self.held.passed(timerValues.getCurrentWatermarkInMs()):
            if memory is None:
                memory = json.loads(self.memory.get()[0]) if self.memory.exists() else {"n": 0, "mid": None, "rows": [], "times": [], "squares": [], "rv": [], "up": 0.0, "down": 0.0, "price": None, "spread": None}
            out = self.advance(table, memory)
            out.insert(0, "symbol", key[0])
            yield out
        if memory is not None:
            self.memory.update((json.dumps(memory, default=np.ndarray.tolist),))

    def features(self, t: pd.DataFrame, m: dict) -> pd.DataFrame:
        """:meth:`advance` with a memory of plain lists."""
        out = self.advance(t, m)
        m.update({k: v.tolist() for k, v in m.items() if isinstance(v, np.ndarray)})
        return out

    def advance(self, t: pd.DataFrame, m: dict) -> pd.DataFrame:
        """Windows over the remembered rows and the new ones; updates the memory."""
        cfg, n = self.cfg, len(t)
        mid, volume = t["mid"].to_numpy(float), t["volume_24h"].fillna(0.0).to_numpy(float)
        before = np.r_[mid[0] if m["mid"] is None else m["mid"], mid[:-1]]
        spread = t["spread"].fillna(0.0).to_numpy(float) * 10000.0
        with np.errstate(invalid="ignore", divide="ignore"):  # the branches taken where prices aren't positive
            new = np.column_stack([
                np.where((mid > 0) & (before > 0), np.log(mid / before), 0.0), np.where(before > 0, (mid - before) / before * 10000.0, 0.0),
                np.where(mid > 0, spread / mid if cfg.spread_unit == "relative" else spread, 0.0), volume])
        old = np.array(m["rows"], float).reshape(-1, 4)
        rows = np.vstack([np.full((self.reach - len(old), 4), np.nan), old, new])
        t["_rn"] = m["n"] + 1 + np.arange(n)
        for k, name in enumerate(("ret", "jump_bps", "spread_bps", "volume")):
            t[name] = new[:, k]

        times, squares = np.r_[np.array(m["times"], np.int64), t["ts_ms"].to_numpy(np.int64)], np.r_[np.array(m["squares"], float), new[:, 0] ** 2]
        sums, own = np.r_[0.0, np.cumsum(squares)], times[len(times) - n:]
        lo, hi = np.searchsorted(times, own - cfg.rv_window_ms, "left"), np.searchsorted(times, own, "right")
        t["rv"] = np.sqrt(np.maximum(0.0, sums[hi] - sums[lo]))
        levels = np.r_[np.array(m["rv"], float), t["rv"].to_numpy(float)]
        t["_recent"] = [levels[max(0, i + 1 - cfg.regime.window):i + 1] for i in range(len(m["rv"]), len(levels))]

        parts = [self.windows(rows[i:i + self.reach + SLICE], t["_rn"].to_numpy()[i:i + SLICE]) for i in range(0, n, SLICE)]
        for name in parts[0]:
            t[name] = np.concatenate([p[name] for p in parts])
        self.accumulate(t, m)
        keep = int(np.searchsorted(times, own[-1] - cfg.rv_window_ms, "left"))
        m.update(n=m["n"] + n, mid=float(mid[-1]), rows=np.vstack([old, new])[-self.reach:], times=times[keep:], squares=squares[keep:], rv=levels[-(cfg.regime.window - 1):] if cfg.regime.window > 1 else levels[:0])
        return t[[c.split()[0] for c in _FEATURES.replace("array<double>", "array").split(", ")[1:]]]

    def windows(self, rows: np.ndarray, rn: np.ndarray) -> dict[str, np.ndarray]:
        """Statistics of the last rows at each new row; ``rows`` starts ``reach`` rows earlier."""
        cfg, n = self.cfg, len(rows) - self.reach

        def ending(column: int, size: int, lag: int = 0) -> np.ndarray:
            at = self.reach - size + 1 - lag
            return np.lib.stride_tricks.sliding_window_view(rows[:, column], size)[at:at + n]

        def stats(column: int, size: int, lag: int = 0) -> tuple[np.ndarray, np.ndarray]:
            at = self.reach - size + 1 - lag
            return _moving_stats(rows[at:at + n + size - 1, column], size)

        rets = ending(0, cfg.mad.window)
        med = _median(rets)
        out = {"_vol": stats(3, cfg.absolute.volume_window, 1)[0], "_rets": np.minimum(rn, cfg.mad.window).astype(np.int32), "_med": med, "_mad": _median(np.abs(rets - med[:, None]))}
        for name, size in (("_short", cfg.vol_ratio.short_window), ("_long", cfg.vol_ratio.long_window)):
            square = ending(0, size) ** 2
            out[name] = np.sqrt(np.nansum(square, axis=1) / ((~np.isnan(square)).sum(axis=1) if cfg.vol_ratio.normalize else 1.0))
        own = rows[self.reach:]
        z = np.zeros(n)
        for weight, k in ((cfg.cusum.w_price, 1), (cfg.cusum.w_spread, 2), (cfg.cusum.w_volume, 3)):
            mean, sd = stats(k, cfg.cusum.history, 1)
            z += weight * np.where((rn - 1 >= A.WARMUP) & (sd >= 1e-9), (own[:, k] - mean) / np.where(sd >= 1e-9, sd, 1.0), 0.0)
        out["_z"] = z
        for name, k in (("_zp", 1), ("_zs", 2)):
            mean, sd = stats(k, cfg.ewma.history)
            out[name] = (own[:, k] - mean) / np.where(sd < 1e-9, 1.0, sd)
        return out

    def accumulate(self, t: pd.DataFrame, m: dict) -> None:
        """Sums that restart after an alarm, and the two control charts."""
        c, lam, up, down, charts = self.cfg.cusum, self.cfg.ewma.lam, m["up"], m["down"], [m["price"], m["spread"]]
        out = []
        for rn, z, *pair in zip(t["_rn"], t["_z"], t["_zp"], t["_zs"]):
            if rn >= A.WARMUP:
                up, down = max(0.0, up + z - c.drift), max(0.0, down - z - c.drift)
                charts = [x if y is None else lam * x + (1.0 - lam) * y for x, y in zip(pair, charts)]
            out.append((up, down, *charts))
            if max(up, down) >= c.threshold:
                up = down = 0.0
        t[["cusum_pos", "cusum_neg", "ewma_price", "ewma_spread"]] = np.array(out, float)
        m.update(up=float(up), down=float(down), price=None if charts[0] is None else float(charts[0]), spread=None if charts[1] is None else float(charts[1]))

    def close(self) -> None:
        pass


_SCORES = ", ".join(f"{d}_score double" for d in A.DETECTORS)
_FUSED = f"ts_ms long, tick_id long, row_number long, mid double, trust_score double, rv double, regime int, fused_score double, reason string, triggered_count int, max_detector_score double, {_SCORES}"
_SCORED = f"symbol string, {_FUSED}, anomaly_score double, base_state string, system_state string"


class MemoryGateProcessor(StatefulProcessor):
    """Per symbol: the largest of the last fused scores, the base state and the gate, in row order."""

    def __init__(self, cfg: A.ScoringConfig) -> None:
        self.cfg = cfg

    def init(self, handle) -> None:
        self.memory = handle.getValueState("memory", "body string")

    def handleInputRows(self, key, rows, timerValues):
        recent, now = json.loads(self.memory.get()[0]) if self.memory.exists() else ([], [0, -1, 0])
        pdf, gate, size = pd.concat(list(rows)).sort_values("row_number"), self.cfg.gate, self.cfg.memory
        seen = np.r_[np.full(size - 1 - len(recent[-(size - 1):]) if size > 1 else 0, -np.inf), recent[-(size - 1):] if size > 1 else [], pdf["fused_score"].to_numpy(float)]
        top = np.fmax.reduce(np.lib.stride_tricks.sliding_window_view(seen, size), axis=1)
        shift = np.where(pdf["regime"].to_numpy() == 0, -gate.regime_shift, gate.regime_shift)
        odd, trusted = top >= gate.anomaly + shift, pdf["trust_score"].to_numpy(float) >= gate.trust
        base = np.where(trusted, np.where(odd, 1, 0), np.where(odd, 3, 2)).tolist()
        states = []
        for wish in base:
            now = A.gate_step(*now, wish, gate.streak)
            states.append(A.SEVERITY[now[0]])
        recent = [x for x in seen[-size:].tolist() if x != -np.inf]
        out = {"anomaly_score": top, "base_state": np.array(A.SEVERITY, object)[base], "system_state": states}
        self.memory.update((json.dumps([recent, list(now)]),))
        made = pd.DataFrame(out, index=pdf.index)
        yield pd.concat([pdf, made], axis=1)[[c.split()[0] for c in _SCORED.split(", ")]]

    def close(self) -> None:
        pass


def stream_score(validated: DataFrame, *, delay: str = "1 minute", cfg: A.ScoringConfig | None = None) -> DataFrame:
    """Score a stream of validated ticks (symbol, ``ts_ms``, ``tick_id``, ``mid``, ``trust_score``, ``volume_24h``, ``spread``).

    A tick is scored once the watermark (latest event time minus ``delay``) is beyond it; later ones are dropped.
    """
    cfg = cfg or A.ScoringConfig()
    names = [c.split()[0] for c in _INPUT.split(", ")]
    rows = with_event_time(validated.select("symbol", *names), delay)
    out = rows.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=FeatureProcessor(cfg), outputStructType=_FEATURES, outputMode="Append", timeMode="EventTime")
    out = out.select(*[F.nanvl(F.col(c), F.lit(None)).alias(c) if c in _NUMBERS else c for c in out.columns])
    out = A.absolute_verdict(A.regime_verdict(out, cfg.regime), cfg.absolute)
    out = A.vol_ratio_verdict(A.mad_verdict(out, cfg.mad), cfg.vol_ratio)
    out = A.fuse_scores(A.ewma_columns(A.cusum_columns(out, cfg.cusum), cfg.ewma), cfg.weights)
    scores = [F.col(f"{d}.score").alias(f"{d}_score") for d in A.DETECTORS]
    out = out.withColumn("row_number", F.col(INDEX))
    fused = out.select("symbol", *[c for c in (x.split()[0] for x in _FUSED.split(", ")) if not c.endswith("_score") or c in ("trust_score", "fused_score", "max_detector_score")], *scores)
    return fused.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=MemoryGateProcessor(cfg), outputStructType=_SCORED, outputMode="Append", timeMode="None")
