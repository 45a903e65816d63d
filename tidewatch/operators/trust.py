"""Trust score of a window and feed quality events."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.arrays import array_median, total
from tidewatch.functions.scalar import clip01
from tidewatch.operators.consensus import WINDOWS, ConsensusConfig
from tidewatch.plans.layout import Layout
from tidewatch.plans.scans import Scan, following, running
from tidewatch.plans.store import materialise


@dataclass(frozen=True)
class TrustConfig:
    w_tls: float = 0.20
    w_agreement: float = 0.25
    w_freshness: float = 0.20
    w_sequence: float = 0.15
    w_chain: float = 0.10
    w_availability: float = 0.10
    agreement_half_life_ms: float = 7500.0
    latency_half_life_ms: float = 500.0


def t1_tls(quotes: Column) -> Column:
    return F.when((F.size(quotes) > 0) & F.forall(quotes, lambda q: F.coalesce(q["tls_ok"], F.lit(False))), 1.0).otherwise(0.0)


def age_weight(age_ms: Column, half_life_ms: float = 7500.0) -> Column:
    return F.exp(-age_ms / F.lit(half_life_ms) * F.lit(math.log(2.0)))


def t2_agreement(quotes: Column, centre: Column, tolerance: Column, *, half_life_ms: float = 7500.0) -> Column:
    """Share of the age-weighted quotes that lie within the tolerance of the consensus."""
    start = F.struct(F.lit(0.0).alias("agree"), F.lit(0.0).alias("all"))

    def step(acc: Column, q: Column) -> Column:
        near = F.when(F.abs(q["mid"] - centre) <= tolerance, 1.0).otherwise(0.0)
        w = age_weight(q["age_ms"], half_life_ms)
        return F.struct((acc["agree"] + w * near).alias("agree"), (acc["all"] + w).alias("all"))

    return F.aggregate(
        quotes, start, step, lambda acc: F.when(acc["all"] > 0, acc["agree"] / acc["all"]).otherwise(F.lit(0.0))
    )


def t2_ratio(agreeing: Column, sources: Column) -> Column:
    return F.when(sources <= 0, 0.0).otherwise(F.greatest(F.lit(0), F.least(agreeing, sources)) / sources)


def t3_freshness(latency_ms: Column, half_life_ms: float = 500.0) -> Column:
    """Halves with every half life; 0 without a latency."""
    return F.coalesce(F.exp(-F.greatest(F.lit(0.0), latency_ms) * F.lit(math.log(2.0) / half_life_ms)), F.lit(0.0))


def t4_sequence(gap: Column) -> Column:
    return (
        F.when(gap.isNull(), 1.0).when(gap <= 0, 0.0).when(gap == 1, 1.0).when(gap >= 10, 0.0).otherwise(1.0 / gap)
    )


def t5_chain(ok: Column) -> Column:
    return F.when(ok, 1.0).otherwise(0.0)


def t_availability(active: Column, configured: Column) -> Column:
    return F.when(F.size(configured) == 0, 1.0).otherwise(F.size(F.array_intersect(active, configured)) / F.size(configured))


def trust_score(t1: Column, t2: Column, t3: Column, t4: Column, t5: Column, availability: Column, cfg: TrustConfig = TrustConfig()) -> Column:
    return clip01(
        cfg.w_tls * t1 + cfg.w_agreement * t2 + cfg.w_freshness * t3 + cfg.w_sequence * t4 + cfg.w_chain * t5
        + cfg.w_availability * F.coalesce(availability, F.lit(1.0))
    )


def quote_latency(window_end: Column):
    """Latency of a quote by the venue clock where it stamps its quotes, else by the receive time."""
    return lambda q: F.greatest(
        F.lit(0), window_end - F.when(q["timestamp_source"] == "exchange", q["exchange_ts_ms"]).otherwise(q["ts_ms"])
    ).cast("double")


def latency_exchange_first(quotes: Column, window_end: Column) -> Column:
    """Median latency of venue-stamped quotes only, of receive times where no venue stamps."""
    stamped = F.filter(quotes, lambda q: q["timestamp_source"] == "exchange")
    by_venue = array_median(F.transform(stamped, lambda q: F.greatest(F.lit(0), window_end - q["exchange_ts_ms"]).cast("double")))
    received = array_median(F.transform(quotes, lambda q: F.greatest(F.lit(0), window_end - q["ts_ms"]).cast("double")))
    return F.coalesce(by_venue, received)


def median_spread(quotes: Column) -> Column:
    valid = F.filter(quotes, lambda q: q["bid"] + q["ask"] > 0)
    spreads = F.transform(valid, lambda q: F.greatest(F.lit(0.0), (q["ask"] - q["bid"]) / ((q["bid"] + q["ask"]) / 2.0)))
    return F.coalesce(array_median(spreads), F.lit(0.0))


def median_volume(quotes: Column) -> Column:
    return F.coalesce(array_median(F.transform(quotes, lambda q: F.greatest(F.lit(0.0), q["volume_24h"]))), F.lit(0.0))


def validated_tick(
    decided: DataFrame,
    venues: list[str],
    *,
    liveness_ms: int = 30_000,
    chain_ok: Column | None = None,
    cfg: TrustConfig = TrustConfig(),
    consensus_cfg: ConsensusConfig = ConsensusConfig(),
) -> DataFrame:
    """Validated tick of each window that has a consensus.

    ``decided`` is a window table with ``quotes``, ``consensus_mid``, ``used_sources`` and ``divergent_sources`` from either
    consensus operator. Everything is an expression over the window's own row: no shuffle.
    """
    end, price = F.col("window_end_ms"), F.col("consensus_mid")
    rows = decided.where(price.isNotNull()).withColumn(
        "_used", F.filter("quotes", lambda q: F.array_contains(F.col("used_sources"), q["exchange_id"]))
    )
    used = F.col("_used")
    alive = lambda q: end - q["ts_ms"] <= liveness_ms
    active = F.transform(F.filter(used, alive), lambda q: q["exchange_id"])
    rows = rows.where(F.size("_used") > 0).select(
        "*",
        t1_tls(used).alias("t1"),
        t2_agreement(
            F.filter("quotes", alive), price, F.abs(price) * consensus_cfg.tolerance, half_life_ms=cfg.agreement_half_life_ms
        ).alias("t2"),
        array_median(F.transform(used, quote_latency(end))).alias("latency_ms"),
        t4_sequence(F.array_max(F.transform("quotes", lambda q: q["gap"]))).alias("t4"),
        t5_chain(F.lit(True) if chain_ok is None else chain_ok).alias("t5"),
        t_availability(active, F.array(*[F.lit(v) for v in venues])).alias("t_availability"),
        median_spread(used).alias("spread"),
        median_volume(used).alias("volume_24h"),
        F.map_from_entries(F.transform("quotes", lambda q: F.struct(q["exchange_id"], q["mid"]))).alias("execution_venue_prices"),
    ).withColumn("t3", t3_freshness(F.col("latency_ms"), cfg.latency_half_life_ms))
    score = trust_score(*[F.col(c) for c in ("t1", "t2", "t3", "t4", "t5", "t_availability")], cfg)
    return rows.withColumn("trust_score", score).withColumn("mid", price).drop("_used")


def primary_filter(decided: DataFrame, venue: str = "binance") -> DataFrame:
    """Keep windows whose primary venue is present and used; price, latency, spread and volume then come from it alone."""
    one = F.filter("quotes", lambda q: q["exchange_id"] == venue)
    rows = decided.where(F.array_contains("used_sources", venue) & (F.size(one) > 0)).withColumn("_q", one[0])
    q = F.col("_q")
    return rows.select(
        "symbol", "window_end_ms", q["mid"].alias("mid"), quote_latency(F.col("window_end_ms"))(q).alias("latency_ms"),
        F.greatest(F.lit(0.0), (q["ask"] - q["bid"]) / ((q["bid"] + q["ask"]) / 2.0)).alias("spread"),
        F.greatest(F.lit(0.0), q["volume_24h"]).alias("volume_24h"),
    )


SUB_SCORES = {"T1": "t1", "T2": "t2", "T3": "t3", "T4": "t4", "T5": "t5", "T_availability": "t_availability"}


def trust_degradation(validated: DataFrame, layout: Layout = WINDOWS, *, drop: float = 0.1) -> DataFrame:
    """Windows whose trust fell by more than ``drop``, with the lowest sub-score as cause."""
    before = running(validated, layout, previous_trust=Scan("last", F.col("trust_score"), exclusive=True))
    worst = F.array_min(F.array(*[F.struct(F.col(c).alias("s"), F.lit(n).alias("name")) for n, c in SUB_SCORES.items()]))
    fall = F.col("previous_trust") - F.col("trust_score")
    return before.where(fall > drop).select(
        *layout.keys, "window_end_ms", "previous_trust", "trust_score", fall.alias("trust_drop"), worst["name"].alias("primary_cause")
    )


# Milliseconds between ticks expected from each venue.
EXPECTED_INTERVAL_MS = {"binance": 500, "coinbase": 15_000, "kraken": 20_000, "okx": 500, "bybit": 500}


def liveness(
    ticks: DataFrame, layout: Layout = Layout(keys=("exchange_id",)), *, expected_ms: dict[str, int] | None = None,
    default_ms: int = 10_000, multiplier: float = 5.0,
) -> DataFrame:
    """One silent and one recovered row per gap longer than the venue's limit; an open gap at the end is not judged."""
    table = EXPECTED_INTERVAL_MS if expected_ms is None else expected_ms
    limit = F.lit(default_ms * multiplier)
    for venue, ms in table.items():
        limit = F.when(F.col("exchange_id") == venue, F.lit(ms * multiplier)).otherwise(limit)
    after = following(ticks, layout, next_ts=layout.ts).withColumn("threshold_ms", limit.cast("long"))
    silent = after.where(F.col("next_ts") - F.col(layout.ts) > F.col("threshold_ms"))
    pair = F.explode(F.array(
        F.struct(F.lit("exchange_silent").alias("event"), (F.col(layout.ts) + F.col("threshold_ms")).alias("event_ts_ms")),
        F.struct(F.lit("exchange_recovered").alias("event"), F.col("next_ts").alias("event_ts_ms")),
    ))
    return silent.select(
        *layout.keys, pair.alias("e"), (F.col("next_ts") - F.col(layout.ts)).alias("silence_ms"), "threshold_ms"
    ).select(*layout.keys, "e.event", "e.event_ts_ms", "silence_ms", "threshold_ms")


def stale_sources(ticks: DataFrame, configured: DataFrame, *, end_ms: Column | int, max_age_ms: int = 120_000) -> DataFrame:
    """Configured venues without ticks, or whose last tick is too old at the end."""
    last = ticks.groupBy("exchange_id").agg(F.max("ts_ms").alias("last_ts_ms"), F.count(F.lit(1)).alias("ticks"))
    end = F.lit(end_ms) if isinstance(end_ms, int) else end_ms
    out = configured.join(last, "exchange_id", "left").withColumn("ticks", F.coalesce("ticks", F.lit(0)))
    return out.withColumn("failed", (F.col("ticks") == 0) | (end - F.col("last_ts_ms") > max_age_ms))


def quality_events(
    gaps: DataFrame, validated: DataFrame, silences: DataFrame, breaker: DataFrame, escalations: DataFrame, layout: Layout = WINDOWS,
) -> DataFrame:
    """One event table ``(event, symbol, ts_ms, payload)`` out of the quality operators' results.

    Tables that feed more than one kind of event are stored once.
    """
    validated, breaker = materialise(validated), materialise(breaker)
    def event(df: DataFrame, name: Column | str, ts: str, *payload: str) -> DataFrame:
        label = name if isinstance(name, Column) else F.lit(name)
        symbol = F.col("symbol") if "symbol" in df.columns else F.lit(None).cast("string")
        return df.select(label.alias("event"), symbol.alias("symbol"), F.col(ts).alias("ts_ms"), F.to_json(F.struct(*payload)).alias("payload"))

    late = F.col("gap") == 10
    jumps = gaps.where(F.col("gap") > 1)
    unhealthy = validated.where(F.col("t1") == 0)
    failing = running(breaker, layout, _was=Scan("last", F.col("breaker_open"), exclusive=True))
    was = F.coalesce(F.col("_was"), F.lit(False))
    state = (
        F.when(F.col("breaker_open") & ~was, "consensus.circuit_breaker.open")
        .when(F.col("breaker_open"), "consensus.circuit_breaker.skip")
        .when(was, "consensus.circuit_breaker.close")
    )
    parts = [
        event(jumps, F.when(late, "sequence.non_monotonic").otherwise("sequence.gap"), "ts_ms", "exchange_id", "gap"),
        event(unhealthy, "tls.unhealthy", "window_end_ms", "used_sources"),
        event(trust_degradation(validated, layout), "trust_degradation", "window_end_ms", "primary_cause"),
        event(silences, F.col("event"), "event_ts_ms", "exchange_id", "silence_ms"),
        event(failing.withColumn("_state", state).where(F.col("_state").isNotNull()), F.col("_state"), "window_end_ms", "failures"),
        event(escalations, "consensus.divergence.escalated", "window_end_ms", "exchange_id", "streak"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
