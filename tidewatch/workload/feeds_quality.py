"""Alignment, consensus and trust queries: one-hour windows, six hours of last known values."""

from pyspark.sql import functions as F

from tidewatch.operators import align as L
from tidewatch.operators import consensus as C
from tidewatch.operators import trust as T
from tidewatch.plans.layout import Layout
from tidewatch.plans.store import materialise
from tidewatch.workload.registry import query
from tidewatch.workload.scalars import r
from tidewatch.workload.ticks import DAY_MS, HOUR_MS, LAYOUT, SLOT_MS, VENUE_LAYOUT, VENUES, VENUES_SQL, table, ticks, with_ticks

STALE_MS, LIVE_MS, SILENT_MS = 6 * HOUR_MS, 12 * HOUR_MS, 4 * HOUR_MS
WIN_LAYOUT = Layout(keys=("symbol",), order=("window_end_ms",), slot_ms=10 * DAY_MS)
VENUE_WINDOWS = Layout(keys=("symbol", "exchange_id"), order=("ts_ms",), slot_ms=10 * DAY_MS)

AL_SQL = f"""al AS MATERIALIZED (
  SELECT *, CASE WHEN sequence_id IS NULL THEN NULL WHEN seen IS NULL THEN 1 WHEN sequence_id - seen <= 0 THEN 10 ELSE sequence_id - seen END AS gap
  FROM (SELECT *, max(sequence_id) OVER (PARTITION BY symbol, exchange_id ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
        FROM (SELECT *, ts_ms // {HOUR_MS} AS win, row_number() OVER (PARTITION BY symbol, exchange_id, ts_ms // {HOUR_MS} ORDER BY ts_ms DESC, tick_id DESC) AS back,
                     count(*) OVER (PARTITION BY symbol, exchange_id, ts_ms // {HOUR_MS}) AS ticks_in_window FROM ticks) WHERE back = 1))"""
LATEST_SQL = f"""spine AS (SELECT s.symbol, s.win, v.exchange_id, (s.win + 1) * {HOUR_MS} AS e FROM (SELECT DISTINCT symbol, win FROM al) s CROSS JOIN venues v),
latest AS MATERIALIZED (
  SELECT s.symbol, s.win, s.e AS window_end_ms, s.exchange_id, a.* EXCLUDE (symbol, exchange_id, win, seen, back), a.win = s.win AS fresh,
         CASE WHEN a.win = s.win THEN 0 ELSE s.e - a.ts_ms END AS age_ms
  FROM spine s ASOF LEFT JOIN al a ON a.symbol = s.symbol AND a.exchange_id = s.exchange_id AND s.e > a.ts_ms),
filled AS MATERIALIZED (SELECT * FROM latest WHERE fresh OR age_ms <= {STALE_MS})"""
CONS_SQL = """judged AS MATERIALIZED (
  SELECT *, abs(mid - centre) / abs(centre) > 0.003 AS divergent
  FROM (SELECT *, median(mid) OVER (PARTITION BY symbol, win) AS centre FROM filled)),
usable AS (SELECT *, sum(volume_24h) OVER (PARTITION BY symbol, win ORDER BY mid, volume_24h ROWS UNBOUNDED PRECEDING) AS cum,
                  sum(volume_24h) OVER (PARTITION BY symbol, win) AS tot FROM judged WHERE NOT divergent),
cons AS MATERIALIZED (
  SELECT j.symbol, j.win, j.window_end_ms, any_value(j.centre) AS median_mid, count(*) FILTER (NOT j.divergent) AS used_n,
         coalesce(string_agg(j.exchange_id, ',' ORDER BY j.exchange_id) FILTER (NOT j.divergent), '') AS used_sources,
         coalesce(string_agg(j.exchange_id, ',' ORDER BY j.exchange_id) FILTER (j.divergent), '') AS divergent_sources,
         any_value(u.pick) AS consensus_mid
  FROM judged j LEFT JOIN (SELECT symbol, win, min(mid) FILTER (cum >= tot / 2) AS pick FROM usable GROUP BY ALL) u USING (symbol, win) GROUP BY ALL)"""
ALIGNED = (VENUES_SQL, AL_SQL, LATEST_SQL)
CONSENSUS = (*ALIGNED, CONS_SQL)


def aligned(spark, sf):
    rows = L.align_tumbling(ticks(spark, sf), window_ms=HOUR_MS)
    return L.sequence_gap(rows, VENUE_WINDOWS)


def latest(spark, sf):
    return L.latest_by_venue(aligned(spark, sf), VENUES, VENUE_WINDOWS)


def filled(spark, sf):
    return L.lkv_fill(latest(spark, sf), staleness_ms=STALE_MS)


def decided(spark, sf, wins=None):
    return C.consensus(C.windows(filled(spark, sf)) if wins is None else wins)


def validated(spark, sf, wins=None):
    return T.validated_tick(decided(spark, sf, wins), VENUES, liveness_ms=SILENT_MS, cfg=TRUST)


TRUST = T.TrustConfig(agreement_half_life_ms=3 * HOUR_MS, latency_half_life_ms=HOUR_MS / 2)
TICK_COLS = ("symbol", "exchange_id", "window_end_ms", "tick_id", "mid")


def csv(c):
    return F.concat_ws(",", c)


@query("align_tumbling", with_ticks(
    f"SELECT symbol, exchange_id, (win + 1) * {HOUR_MS} AS window_end_ms, tick_id, round(mid, 8) AS mid, ticks_in_window FROM al", AL_SQL))
def align_tumbling(spark, sf):
    out = L.align_tumbling(ticks(spark, sf), window_ms=HOUR_MS)
    return out.select("symbol", "exchange_id", "window_end_ms", "tick_id", r(F.col("mid")).alias("mid"), "ticks_in_window")


@query("last_per_exchange", with_ticks(
    f"SELECT symbol, exchange_id, (win + 1) * {HOUR_MS} AS window_end_ms, ts_ms, tick_id FROM al", AL_SQL))
def last_per_exchange(spark, sf):
    return L.align_tumbling(ticks(spark, sf), window_ms=HOUR_MS, fields=("ts_ms", "tick_id")).select(
        "symbol", "exchange_id", "window_end_ms", "ts_ms", "tick_id")


ANCHOR_SQL = f"""numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms, tick_id) AS rn FROM ticks),
anchored AS (
  SELECT symbol, rn, ts_ms AS opened, ts_ms FROM numbered WHERE rn = 1
  UNION ALL SELECT n.symbol, n.rn, CASE WHEN a.ts_ms - a.opened >= {HOUR_MS} THEN n.ts_ms ELSE a.opened END, n.ts_ms
  FROM anchored a JOIN numbered n ON n.symbol = a.symbol AND n.rn = a.rn + 1)"""


@query("align_anchored", with_ticks(f"""
SELECT n.symbol, opened AS window_open_ms, arg_max(n.tick_id, (n.ts_ms, n.tick_id)) AS tick_id, n.exchange_id,
       any_value(e.window_end_ms) AS window_end_ms
FROM anchored a JOIN numbered n USING (symbol, rn)
JOIN (SELECT symbol, opened, max(ts_ms) AS window_end_ms FROM anchored WHERE ts_ms - opened >= {HOUR_MS} GROUP BY ALL) e USING (symbol, opened)
GROUP BY n.symbol, opened, n.exchange_id""", ANCHOR_SQL))
def align_anchored(spark, sf):
    marked = L.align_anchored(ticks(spark, sf).select("symbol", "ts_ms", "tick_id", "exchange_id", "mid"), LAYOUT, window_ms=HOUR_MS)
    return L.anchored_windows(marked).select("symbol", "window_open_ms", "exchange_id", "tick_id", "window_end_ms")


@query("window_override", """
WITH t AS (SELECT o_orderkey, 'S' || (c_nationkey) AS symbol FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, symbol, CAST(CASE WHEN n_regionkey = 1 THEN 100 + n_nationkey ELSE 50 END AS INTEGER) AS window_ms
FROM t JOIN nation ON symbol = 'S' || n_nationkey""")
def window_override(spark, sf):
    t = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    t = t.select("o_orderkey", F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("symbol"))
    own = table(spark, sf, "nation").where("n_regionkey = 1").select(
        F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("symbol"), (100 + F.col("n_nationkey")).alias("window_ms"))
    return L.window_override(t, own).select("o_orderkey", "symbol", F.col("window_ms").cast("int").alias("window_ms"))


@query("lkv_fill", with_ticks("SELECT symbol, exchange_id, window_end_ms, tick_id, fresh, age_ms FROM filled", *ALIGNED))
def lkv_fill(spark, sf):
    return filled(spark, sf).select("symbol", "exchange_id", "window_end_ms", "tick_id", "fresh", "age_ms")


@query("active_sources", with_ticks(f"""
SELECT symbol, window_end_ms, coalesce(string_agg(exchange_id, ',' ORDER BY exchange_id) FILTER (window_end_ms - ts_ms <= {HOUR_MS // 2}), '') AS active_sources
FROM latest GROUP BY ALL""", *ALIGNED))
def active_sources(spark, sf):
    return L.active_sources(latest(spark, sf), liveness_ms=HOUR_MS // 2).withColumn("active_sources", csv("active_sources"))


@query("missing_sources", with_ticks("""
SELECT s.symbol, s.e AS window_end_ms, coalesce(string_agg(s.exchange_id, ',' ORDER BY s.exchange_id) FILTER (al.tick_id IS NULL), '') AS missing_sources
FROM spine s LEFT JOIN al USING (symbol, win, exchange_id) GROUP BY ALL""", *ALIGNED))
def missing_sources(spark, sf):
    out = L.missing_sources(L.align_tumbling(ticks(spark, sf), window_ms=HOUR_MS), VENUES)
    return out.withColumn("missing_sources", csv("missing_sources"))


MATCH_E = "SELECT tick_id AS row_id, symbol, exchange_id, round(mid, 2) AS mid, 1.0::DOUBLE AS volume_24h, k % 3 / 2.0::DOUBLE AS score FROM ticks"
MATCH_P = """SELECT tick_id AS row_id, symbol, exchange_id, round(mid, 2) + CASE WHEN k % 11 = 0 THEN 0.001 ELSE 0 END AS mid, 1.0::DOUBLE AS volume_24h,
  k % 3 / 2.0::DOUBLE AS score FROM ticks WHERE tick_id % 7 <> 0"""


@query("match_validated", with_ticks("""
SELECT e.row_id, p.row_id AS p_id, CASE WHEN p.row_id IS NULL THEN 'unmatched' WHEN e.row_id IS NULL THEN 'missing' ELSE 'matched' END AS class
FROM (SELECT *, row_number() OVER (PARTITION BY symbol, exchange_id, mid, score ORDER BY row_id) AS n FROM ex) e
FULL JOIN (SELECT *, row_number() OVER (PARTITION BY symbol, exchange_id, mid, score ORDER BY row_id) AS n FROM pub) p
  ON e.symbol = p.symbol AND e.exchange_id = p.exchange_id AND abs(e.mid - p.mid) < 1e-7 AND e.score = p.score AND e.n = p.n""",
    f"ex AS ({MATCH_E})", f"pub AS ({MATCH_P})"))
def match_validated(spark, sf):
    t = ticks(spark, sf)
    e = t.select(F.col("tick_id").alias("row_id"), "symbol", "exchange_id", F.round("mid", 2).alias("mid"), F.lit(1.0).alias("volume_24h"),
                 ((F.col("k") % 3) / 2.0).alias("score"))
    p = t.where("tick_id % 7 <> 0").select(
        F.col("tick_id").alias("row_id"), "symbol", "exchange_id",
        (F.round("mid", 2) + F.when(F.col("k") % 11 == 0, 0.001).otherwise(F.lit(1e-9))).alias("mid"),
        F.lit(1.0 + 1e-9).alias("volume_24h"), ((F.col("k") % 3) / 2.0).alias("score"))
    return L.match_validated(e, p)


@query("median_mid", with_ticks("SELECT symbol, window_end_ms, round(median(mid), 8) AS median_mid FROM filled GROUP BY ALL", *ALIGNED))
def median_mid(spark, sf):
    return C.windows(filled(spark, sf)).select("symbol", "window_end_ms", r(C.median_mid()).alias("median_mid"))


@query("volume_weighted_median", with_ticks("""
SELECT symbol, window_end_ms, round(min(mid) FILTER (cum >= tot / 2), 8) AS weighted_mid
FROM (SELECT *, sum(volume_24h) OVER (PARTITION BY symbol, win ORDER BY mid, volume_24h ROWS UNBOUNDED PRECEDING) AS cum,
             sum(volume_24h) OVER (PARTITION BY symbol, win) AS tot FROM filled) GROUP BY ALL""", *ALIGNED))
def volume_weighted_median(spark, sf):
    from tidewatch.functions.arrays import weighted_median

    return C.windows(filled(spark, sf)).select("symbol", "window_end_ms", r(weighted_median(F.col("quotes"))).alias("weighted_mid"))


@query("divergent_sources", with_ticks("SELECT symbol, window_end_ms, divergent_sources FROM cons", *CONSENSUS))
def divergent_sources(spark, sf):
    return decided(spark, sf).select("symbol", "window_end_ms", csv("divergent_sources").alias("divergent_sources"))


@query("consensus_class", with_ticks("""
SELECT symbol, window_end_ms, CASE WHEN used_n >= 2 THEN 'consensus' WHEN used_n = 1 THEN 'degraded' ELSE 'none' END AS consensus_class,
       round(consensus_mid, 8) AS consensus_mid, used_sources FROM cons""", *CONSENSUS))
def consensus_class(spark, sf):
    return decided(spark, sf).select(
        "symbol", "window_end_ms", "consensus_class", r(F.col("consensus_mid")).alias("consensus_mid"), csv("used_sources").alias("used_sources"))


@query("max_divergence_bps", with_ticks("""
SELECT symbol, window_end_ms, round(coalesce(max(abs(j.mid - c.consensus_mid) / c.consensus_mid * 10000) FILTER (j.divergent), 0), 6) AS max_divergence_bps
FROM judged j JOIN cons c USING (symbol, window_end_ms) GROUP BY ALL""", *CONSENSUS))
def max_divergence_bps(spark, sf):
    return decided(spark, sf).select("symbol", "window_end_ms", r(C.max_divergence_bps(), 6).alias("max_divergence_bps"))


@query("quarantine_consensus")
def quarantine_consensus(spark, sf):
    out = C.quarantine_consensus(C.windows(filled(spark, sf)), WIN_LAYOUT)
    lists = ("used_sources", "divergent_sources", "quarantined_sources", "escalated_sources")
    return out.select("symbol", "window_end_ms", r(F.col("consensus_mid")).alias("consensus_mid"), *[csv(c).alias(c) for c in lists])


ESC = C.ConsensusConfig(tolerance=0.0006)


@query("divergence_escalation", with_ticks("""
SELECT symbol, exchange_id, window_end_ms, 3 AS streak FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, exchange_id, island, divergent ORDER BY win) AS run
  FROM (SELECT *, sum(CAST(NOT divergent AS INTEGER)) OVER (PARTITION BY symbol, exchange_id ORDER BY win) AS island
        FROM (SELECT * EXCLUDE (divergent), abs(mid - centre) / abs(centre) > 0.0006 AS divergent FROM judged))) WHERE divergent AND run = 3""", *CONSENSUS))
def divergence_escalation(spark, sf):
    wins = C.consensus(materialise(C.windows(filled(spark, sf))), ESC)
    out = C.divergence_escalation(wins, ESC, slot_ms=10 * DAY_MS)
    return out.withColumn("streak", F.col("streak").cast("int"))


BREAKER_SQL = """breaker AS MATERIALIZED (
  SELECT symbol, window_end_ms, used_n, failed, CASE WHEN failed THEN row_number() OVER (PARTITION BY symbol, island, failed ORDER BY win) ELSE 0 END AS failures
  FROM (SELECT *, sum(CAST(NOT failed AS INTEGER)) OVER (PARTITION BY symbol ORDER BY win) AS island FROM (SELECT *, used_n < 5 AS failed FROM cons)))"""


def broken(spark, sf, wins=None):
    cfg = C.ConsensusConfig(breaker_after=3)
    wins = materialise(C.windows(filled(spark, sf))) if wins is None else wins
    return C.consensus_breaker(decided(spark, sf, wins), F.size("used_sources") < 5, WIN_LAYOUT, cfg)


@query("consensus_breaker", with_ticks("SELECT symbol, window_end_ms, failures, failures >= 3 AS breaker_open FROM breaker", *CONSENSUS, BREAKER_SQL))
def consensus_breaker(spark, sf):
    return broken(spark, sf).select("symbol", "window_end_ms", "failures", "breaker_open")


Q = "quotes"
SCORES_SQL = f"""scored AS MATERIALIZED (
  SELECT c.symbol, c.win, c.window_end_ms, any_value(c.consensus_mid) AS consensus_mid, any_value(c.used_sources) AS used_sources, any_value(c.divergent_sources) AS divergent_sources,
    CASE WHEN bool_and(j.tls_ok) FILTER (NOT j.divergent) THEN 1.0 ELSE 0.0 END AS t1,
    coalesce(sum(exp(-j.age_ms / {3 * HOUR_MS}.0 * ln(2.0))) FILTER (j.window_end_ms - j.ts_ms <= {SILENT_MS} AND abs(j.mid - c.consensus_mid) <= abs(c.consensus_mid) * 0.003)
      / nullif(sum(exp(-j.age_ms / {3 * HOUR_MS}.0 * ln(2.0))) FILTER (j.window_end_ms - j.ts_ms <= {SILENT_MS}), 0), 0) AS t2,
    median(greatest(0, j.window_end_ms - CASE WHEN j.timestamp_source = 'exchange' THEN j.exchange_ts_ms ELSE j.ts_ms END)) FILTER (NOT j.divergent) AS latency_ms,
    max(j.gap) AS gap, count(*) FILTER (NOT j.divergent AND j.window_end_ms - j.ts_ms <= {SILENT_MS}) / 5.0::DOUBLE AS t_availability,
    median(greatest(0.0, (j.ask - j.bid) / ((j.bid + j.ask) / 2))) FILTER (NOT j.divergent) AS spread, median(greatest(0.0, j.volume_24h)) FILTER (NOT j.divergent) AS volume_24h,
    string_agg(j.exchange_id || ':' || CAST(CAST(round(j.mid * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY j.exchange_id) AS venue_prices
  FROM cons c JOIN judged j ON j.symbol = c.symbol AND j.win = c.win WHERE c.consensus_mid IS NOT NULL GROUP BY c.symbol, c.win, c.window_end_ms),
subs AS MATERIALIZED (
  SELECT *, exp(-greatest(0.0, latency_ms) * ln(2.0) / {HOUR_MS / 2}) AS t3,
    CASE WHEN gap IS NULL THEN 1.0 WHEN gap <= 0 THEN 0.0 WHEN gap = 1 THEN 1.0 WHEN gap >= 10 THEN 0.0 ELSE 1.0::DOUBLE / gap END AS t4, 1.0::DOUBLE AS t5 FROM scored),
valids AS MATERIALIZED (
  SELECT *, greatest(0.0, least(1.0, 0.20 * t1 + 0.25 * t2 + 0.20 * t3 + 0.15 * t4 + 0.10 * t5 + 0.10 * t_availability)) AS trust_score FROM subs)"""
VALID = (*CONSENSUS, SCORES_SQL)


def sub(name):
    return with_ticks(f"SELECT symbol, window_end_ms, round({name}, 8) AS {name} FROM valids", *VALID)


def pick(spark, sf, name):
    return validated(spark, sf).select("symbol", "window_end_ms", r(F.col(name)).alias(name))


@query("t1_tls", sub("t1"))
def t1_tls(spark, sf):
    return pick(spark, sf, "t1")


@query("t2_agreement", sub("t2"))
def t2_agreement(spark, sf):
    return pick(spark, sf, "t2")


@query("t2_ratio", with_ticks("""
SELECT symbol, window_end_ms, round(count(*) FILTER (NOT divergent) / CAST(count(*) AS DOUBLE), 8) AS t2_ratio FROM judged GROUP BY ALL""", *CONSENSUS))
def t2_ratio(spark, sf):
    return decided(spark, sf).select("symbol", "window_end_ms", r(T.t2_ratio(F.size("used_sources"), F.size("quotes"))).alias("t2_ratio"))


@query("t3_freshness", sub("t3"))
def t3_freshness(spark, sf):
    return pick(spark, sf, "t3")


@query("latency_exchange_first", with_ticks("""
SELECT symbol, window_end_ms, round(coalesce(median(greatest(0, window_end_ms - exchange_ts_ms)) FILTER (timestamp_source = 'exchange'),
  median(greatest(0, window_end_ms - ts_ms))), 4) AS latency_ms FROM filled GROUP BY ALL""", *ALIGNED))
def latency_exchange_first(spark, sf):
    return C.windows(filled(spark, sf)).select(
        "symbol", "window_end_ms", r(T.latency_exchange_first(F.col(Q), F.col("window_end_ms")), 4).alias("latency_ms"))


GAP_SQL = """gaps AS MATERIALIZED (
  SELECT *, CASE WHEN sequence_id IS NULL THEN NULL WHEN seen IS NULL THEN 1 WHEN sequence_id - seen <= 0 THEN 10 ELSE sequence_id - seen END AS gap
  FROM (SELECT *, max(sequence_id) OVER (PARTITION BY symbol, exchange_id ORDER BY ts_ms, tick_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ticks))"""


def tick_gaps(spark, sf):
    return L.sequence_gap(ticks(spark, sf), VENUE_LAYOUT)


@query("sequence_gap", with_ticks("SELECT tick_id, gap FROM gaps", GAP_SQL))
def sequence_gap(spark, sf):
    return tick_gaps(spark, sf).select("tick_id", "gap")


@query("t4_sequence", sub("t4"))
def t4_sequence(spark, sf):
    return pick(spark, sf, "t4")


@query("t_availability", sub("t_availability"))
def t_availability(spark, sf):
    return pick(spark, sf, "t_availability")


@query("trust_score", sub("trust_score"))
def trust_score(spark, sf):
    return pick(spark, sf, "trust_score")


DEGRADE_SQL = """degraded AS MATERIALIZED (
  SELECT symbol, window_end_ms, prev, trust_score, prev - trust_score AS fall,
    list_sort([{'s': t1, 'n': 'T1'}, {'s': t2, 'n': 'T2'}, {'s': t3, 'n': 'T3'}, {'s': t4, 'n': 'T4'}, {'s': t5, 'n': 'T5'}, {'s': t_availability, 'n': 'T_availability'}])[1].n AS cause
  FROM (SELECT *, lag(trust_score) OVER (PARTITION BY symbol ORDER BY window_end_ms) AS prev FROM valids) WHERE prev - trust_score > 0.1)"""


@query("trust_degradation", with_ticks("""
SELECT symbol, window_end_ms, round(prev, 7) AS previous_trust, round(trust_score, 7) AS trust_score, round(fall, 7) AS trust_drop, cause AS primary_cause FROM degraded""",
    *VALID, DEGRADE_SQL))
def trust_degradation(spark, sf):
    out = T.trust_degradation(materialise(validated(spark, sf)), WIN_LAYOUT)
    return out.select("symbol", "window_end_ms", *[r(F.col(c), 7).alias(c) for c in ("previous_trust", "trust_score", "trust_drop")], "primary_cause")


@query("validated_tick", with_ticks("""
SELECT symbol, window_end_ms, round(consensus_mid, 8) AS consensus_mid, used_sources, divergent_sources, venue_prices, round(spread, 8) AS spread,
  round(volume_24h, 6) AS volume_24h, round(latency_ms, 4) AS latency_ms, round(trust_score, 7) AS trust_score FROM valids""", *VALID))
def validated_tick(spark, sf):
    from tidewatch.functions.scalar import micros

    pairs = F.transform(Q, lambda q: F.concat(q["exchange_id"], F.lit(":"), micros(q["mid"]).cast("string")))
    return validated(spark, sf).select(
        "symbol", "window_end_ms", r(F.col("consensus_mid")).alias("consensus_mid"), csv("used_sources").alias("used_sources"),
        csv("divergent_sources").alias("divergent_sources"), csv(pairs).alias("venue_prices"), r(F.col("spread")).alias("spread"),
        r(F.col("volume_24h"), 6).alias("volume_24h"), r(F.col("latency_ms"), 4).alias("latency_ms"), r(F.col("trust_score"), 7).alias("trust_score"))


@query("primary_filter", with_ticks("""
SELECT symbol, window_end_ms, round(mid, 8) AS mid, CAST(greatest(0, window_end_ms - exchange_ts_ms) AS DOUBLE) AS latency_ms,
  round(greatest(0.0, (ask - bid) / ((bid + ask) / 2)), 8) AS spread, round(volume_24h, 6) AS volume_24h FROM judged WHERE exchange_id = 'binance' AND NOT divergent""", *CONSENSUS))
def primary_filter(spark, sf):
    return T.primary_filter(decided(spark, sf)).select(
        "symbol", "window_end_ms", r(F.col("mid")).alias("mid"), "latency_ms", r(F.col("spread")).alias("spread"), r(F.col("volume_24h"), 6).alias("volume_24h"))


@query("median_volume", sub("volume_24h"))
def median_volume(spark, sf):
    return pick(spark, sf, "volume_24h")


EXPECTED = {"binance": 900_000, "coinbase": 1_200_000, "kraken": 1_500_000}
LIVE_SQL = """silences AS MATERIALIZED (
  SELECT exchange_id, ts_ms, nxt, lim FROM (SELECT *, lead(ts_ms) OVER (PARTITION BY exchange_id ORDER BY ts_ms, tick_id) AS nxt,
    CASE exchange_id WHEN 'binance' THEN 4500000 WHEN 'coinbase' THEN 6000000 WHEN 'kraken' THEN 7500000 ELSE 5000000 END AS lim FROM ticks) WHERE nxt - ts_ms > lim)"""


def silences(spark, sf):
    layout = Layout(keys=("exchange_id",), slot_ms=SLOT_MS)
    return T.liveness(ticks(spark, sf), layout, expected_ms=EXPECTED, default_ms=1_000_000)


@query("liveness", with_ticks("""
SELECT exchange_id, 'exchange_silent' AS event, ts_ms + lim AS event_ts_ms, nxt - ts_ms AS silence_ms, CAST(lim AS BIGINT) AS threshold_ms FROM silences
UNION ALL SELECT exchange_id, 'exchange_recovered', nxt, nxt - ts_ms, CAST(lim AS BIGINT) FROM silences""", LIVE_SQL))
def liveness(spark, sf):
    return silences(spark, sf)


@query("stale_sources", with_ticks("""
SELECT v.exchange_id, max(ts_ms) AS last_ts_ms, count(tick_id) AS ticks, count(tick_id) = 0 OR 1706659200000 - max(ts_ms) > 600000 AS failed
FROM (SELECT exchange_id FROM venues UNION ALL SELECT 'deribit') v LEFT JOIN ticks USING (exchange_id) GROUP BY v.exchange_id""", VENUES_SQL))
def stale_sources(spark, sf):
    configured = spark.createDataFrame([(v,) for v in [*VENUES, "deribit"]], "exchange_id string")
    return T.stale_sources(ticks(spark, sf), configured, end_ms=1_706_659_200_000, max_age_ms=600_000)


@query("quality_events", with_ticks("""
SELECT event, symbol, ts_ms, payload FROM (
  SELECT CASE WHEN gap = 10 THEN 'sequence.non_monotonic' ELSE 'sequence.gap' END AS event, symbol, ts_ms, '{"exchange_id":"' || exchange_id || '","gap":' || gap || '}' AS payload FROM gaps WHERE gap > 1
  UNION ALL SELECT 'tls.unhealthy', symbol, window_end_ms, '{"used_sources":["' || replace(used_sources, ',', '","') || '"]}' FROM valids WHERE t1 = 0
  UNION ALL SELECT 'trust_degradation', symbol, window_end_ms, '{"primary_cause":"' || cause || '"}' FROM degraded
  UNION ALL SELECT 'exchange_silent', NULL, ts_ms + lim, '{"exchange_id":"' || exchange_id || '","silence_ms":' || (nxt - ts_ms) || '}' FROM silences
  UNION ALL SELECT 'exchange_recovered', NULL, nxt, '{"exchange_id":"' || exchange_id || '","silence_ms":' || (nxt - ts_ms) || '}' FROM silences
  UNION ALL SELECT * FROM (SELECT CASE WHEN failures >= 3 AND NOT was THEN 'consensus.circuit_breaker.open' WHEN failures >= 3 THEN 'consensus.circuit_breaker.skip' WHEN was THEN 'consensus.circuit_breaker.close' END AS event,
      symbol, window_end_ms, '{"failures":' || failures || '}' FROM (SELECT *, coalesce(lag(failures >= 3) OVER (PARTITION BY symbol ORDER BY window_end_ms), false) AS was FROM breaker)) WHERE event IS NOT NULL
  UNION ALL SELECT 'consensus.divergence.escalated', symbol, window_end_ms, '{"exchange_id":"' || exchange_id || '","streak":3}' FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol, exchange_id, island, divergent ORDER BY win) AS run
    FROM (SELECT * EXCLUDE (divergent), d AS divergent, sum(CAST(NOT d AS INTEGER)) OVER (PARTITION BY symbol, exchange_id ORDER BY win) AS island
          FROM (SELECT *, abs(mid - centre) / abs(centre) > 0.0006 AS d FROM judged))) WHERE divergent AND run = 3)""",
    *VALID, GAP_SQL, DEGRADE_SQL, LIVE_SQL, BREAKER_SQL))
def quality_events(spark, sf):
    wins = materialise(C.windows(filled(spark, sf)))
    return T.quality_events(
        tick_gaps(spark, sf), validated(spark, sf, wins), silences(spark, sf), broken(spark, sf, wins),
        C.divergence_escalation(C.consensus(wins, ESC), ESC, slot_ms=10 * DAY_MS), WIN_LAYOUT)
