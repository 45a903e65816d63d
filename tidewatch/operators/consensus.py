"""Consensus price of each window, with and without quarantine of divergent venues.

A window is one row holding at most one quote per configured venue, so its array stays small whatever the volume.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.arrays import array_median, weighted_median
from tidewatch.plans.fold import keyed_fold
from tidewatch.plans.layout import Layout
from tidewatch.plans.scans import Scan, running

WINDOWS = Layout(keys=("symbol",), order=("window_end_ms",))


@dataclass(frozen=True)
class ConsensusConfig:
    tolerance: float = 0.003
    min_sources: int = 2
    escalate_after: int = 3
    breaker_after: int = 10


def windows(filled: DataFrame) -> DataFrame:
    """One row per window with its quotes in venue order."""
    cols = [c for c in filled.columns if c not in ("symbol", "window_start_ms", "window_end_ms", "exchange_id")]
    return filled.groupBy("symbol", "window_end_ms").agg(
        F.sort_array(F.collect_list(F.struct("exchange_id", *cols))).alias("quotes")
    )


def names(quotes: Column) -> Column:
    return F.transform(quotes, lambda q: q["exchange_id"])


def median_mid(quotes: str = "quotes") -> Column:
    return array_median(F.transform(F.col(quotes), lambda q: q["mid"]))


def is_divergent(mid: Column, centre: Column, tolerance: float) -> Column:
    return (centre != 0) & (F.abs(mid - centre) / F.abs(centre) > tolerance)


def consensus(wins: DataFrame, cfg: ConsensusConfig = ConsensusConfig()) -> DataFrame:
    """Stateless consensus: venues far from the plain median are left out of the weighted median.

    Adds ``median_mid``, ``divergent_sources``, ``used_sources``, ``consensus_mid``, ``consensus_class``.
    """
    out = wins.withColumn("median_mid", median_mid())
    far = lambda q: is_divergent(q["mid"], F.col("median_mid"), cfg.tolerance)
    out = out.withColumn("divergent_sources", names(F.filter("quotes", far))).withColumn(
        "_usable", F.filter("quotes", lambda q: ~far(q))
    )
    count = F.size("_usable")
    return (
        out.withColumn("used_sources", names(F.col("_usable")))
        .withColumn(
            "consensus_mid",
            F.when(count >= cfg.min_sources, weighted_median(F.col("_usable"))).when(count == 1, F.col("_usable")[0]["mid"]),
        )
        .withColumn("consensus_class", consensus_class(count, cfg))
        .drop("_usable")
    )


def consensus_class(count: Column, cfg: ConsensusConfig = ConsensusConfig()) -> Column:
    return F.when(count >= cfg.min_sources, "consensus").when(count == 1, "degraded").otherwise("none")


def max_divergence_bps() -> Column:
    """Largest distance of a divergent venue from the consensus."""
    bad = F.filter("quotes", lambda q: F.array_contains(F.col("divergent_sources"), q["exchange_id"]))
    gaps = F.transform(bad, lambda q: F.abs(q["mid"] - F.col("consensus_mid")) / F.col("consensus_mid") * 10_000.0)
    return F.coalesce(F.array_max(gaps), F.lit(0.0))


def _weighted_median(quotes: list[tuple[float, float]]) -> float:
    ordered = sorted((m, max(0.0, w or 0.0)) for m, w in quotes)
    half, cum = sum(w for _, w in ordered) / 2.0, 0.0
    if half <= 0:
        return median(m for m, _ in ordered)
    for m, w in ordered:
        cum += w
        if cum >= half:
            return m
    return ordered[-1][0]


def judge_window(quotes: dict[str, tuple[float, float]], held: dict, streaks: dict, cfg: ConsensusConfig) -> tuple:
    """One window of the quarantine rule; updates ``held`` (venue to quote) and ``streaks`` in place.

    Held venues stay out of the first median. New divergents are held. Then every held venue is compared with the
    median of the rest (of the held ones if none is left) and is released, or its streak grows once per window.
    """
    far = lambda m, c: c != 0 and abs(m - c) / abs(c) > cfg.tolerance
    free = {v: q for v, q in quotes.items() if v not in held}
    held.update({v: q for v, q in quotes.items() if v in held})
    pool = free or held
    centre = median(q[0] for q in pool.values()) if pool else 0.0
    caught = [v for v, q in free.items() if far(q[0], centre)]
    for v in caught:
        held[v] = free.pop(v)
        streaks[v] = streaks.get(v, 0) + 1
    rest = free or held
    centre = median(q[0] for q in rest.values()) if rest else 0.0
    divergent = set(caught)
    for v in list(held):
        if far(held[v][0], centre):
            divergent.add(v)
            if v not in caught:
                streaks[v] = streaks.get(v, 0) + 1
        else:
            free[v] = held.pop(v)
            streaks.pop(v, None)
    escalated = [v for v in divergent if streaks.get(v) == cfg.escalate_after and v in held]
    if len(free) >= cfg.min_sources:
        price = _weighted_median(list(free.values()))
    else:
        price = next(iter(free.values()))[0] if free else None
    return price, sorted(free) if free else [], sorted(divergent), sorted(held), sorted(escalated)


def quarantine_consensus(wins: DataFrame, layout: Layout = WINDOWS, cfg: ConsensusConfig = ConsensusConfig()) -> DataFrame:
    """Stateful consensus; adds price, used, divergent, quarantined and escalated venues to each window."""

    def fold(cols: dict[str, list], state: str) -> tuple[dict[str, list], str]:
        held, streaks = json.loads(state)
        out = {c: [] for c in ("consensus_mid", "used_sources", "divergent_sources", "quarantined_sources", "escalated_sources")}
        for quotes in cols["quotes"]:
            now = {q["exchange_id"]: (q["mid"], q["volume_24h"]) for q in quotes}
            for name, value in zip(out, judge_window(now, held, streaks, cfg)):
                out[name].append(value)
        return out, json.dumps([held, streaks], sort_keys=True)

    return keyed_fold(
        wins, layout, fold, "[{}, {}]", ["quotes"],
        "consensus_mid double, used_sources array<string>, divergent_sources array<string>, "
        "quarantined_sources array<string>, escalated_sources array<string>",
    )


def divergence_escalation(wins: DataFrame, cfg: ConsensusConfig = ConsensusConfig(), slot_ms: int = 3_600_000) -> DataFrame:
    """Stateless form: windows in which a venue is divergent for exactly the nth time in a row."""
    quotes = wins.select(
        "symbol", "window_end_ms", "divergent_sources", F.explode(names(F.col("quotes"))).alias("exchange_id")
    ).withColumn("divergent", F.array_contains("divergent_sources", F.col("exchange_id")))
    layout = Layout(keys=("symbol", "exchange_id"), order=("window_end_ms",), slot_ms=slot_ms)
    runs = running(quotes, layout, streak=Scan("streak", F.col("divergent")))
    return runs.where(F.col("streak") == cfg.escalate_after).select("symbol", "exchange_id", "window_end_ms", "streak")


def consensus_breaker(wins: DataFrame, failed: Column, layout: Layout = WINDOWS, cfg: ConsensusConfig = ConsensusConfig()) -> DataFrame:
    """Add the run of failed windows and whether the breaker is open; the first success closes it."""
    out = running(wins.withColumn("_failed", failed), layout, failures=Scan("streak", F.col("_failed")))
    return out.withColumn("breaker_open", F.col("failures") >= cfg.breaker_after).drop("_failed")
