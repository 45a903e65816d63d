"""Anomaly scoring queries. Thresholds are scaled to the sample, whose ticks are minutes apart."""

from pyspark.sql import functions as F

from tidewatch.functions import scalar as S
from tidewatch.operators import anomaly as A
from tidewatch.workload.registry import query
from tidewatch.workload.scalars import r
from tidewatch.workload.ticks import DAY_MS, LAYOUT, ticks, with_ticks

ABSOLUTE = A.AbsoluteConfig(price_jump_bps=40.0, spread_bps=1.9, volume_spike_x=1.9)
REGIME = A.RegimeModel(means=(0.0075, 0.0090), sds=(0.0010, 0.0015))
SCORING = A.ScoringConfig(absolute=ABSOLUTE, regime=REGIME, rv_window_ms=DAY_MS)


def validated(spark, sf):
    return as_validated(ticks(spark, sf))


def as_validated(rows):
    """Ticks seen as validated ticks: a spread in price units and a trust score that dips for hours at a time."""
    low = F.pmod(F.floor(F.col("ts_ms") / 21_600_000), F.lit(5)) == 0
    trust = F.when(low, 0.5).otherwise(0.9) + (F.col("k") % 10) / 200.0
    return rows.select(
        "symbol", "ts_ms", "tick_id", "exchange_id", "k", "mid", "volume_24h", (F.col("ask") - F.col("bid")).alias("spread"),
        trust.alias("trust_score"),
    )


FEAT_SQL = """valid AS MATERIALIZED (
  SELECT symbol, ts_ms, tick_id, exchange_id, k, mid, volume_24h, ask - bid AS spread,
         CASE WHEN (ts_ms // 21600000) % 5 = 0 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END + (k % 10) / 200.0::DOUBLE AS trust_score
  FROM ticks),
feat AS MATERIALIZED (
  SELECT *, ln(mid / prev_mid) AS ret, (mid - prev_mid) / prev_mid * 10000 AS jump_bps, spread / mid * 10000 AS spread_bps,
         volume_24h AS volume
  FROM (SELECT *, coalesce(lag(mid) OVER w, mid) AS prev_mid, row_number() OVER w AS rn FROM valid
        WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, tick_id)))"""
RV_SQL = f"""rvs AS MATERIALIZED (SELECT *, sqrt(sum(ret * ret) OVER (PARTITION BY symbol ORDER BY ts_ms
     RANGE BETWEEN {DAY_MS} PRECEDING AND CURRENT ROW)) AS rv FROM feat)"""
HMM_SQL = """emit AS (
  SELECT *, {'a': -ln(0.0010) - 0.5 * ln(2 * pi()) - ((rv - 0.0075) / 0.0010) * ((rv - 0.0075) / 0.0010) / 2,
             'b': -ln(0.0015) - 0.5 * ln(2 * pi()) - ((rv - 0.0090) / 0.0015) * ((rv - 0.0090) / 0.0015) / 2} AS e FROM rvs),
paths AS (
  SELECT *, list({'a': e.a, 'b': e.b, 'f0': ln(0.5) + e.a, 'f1': ln(0.5) + e.b, 'v0': ln(0.5) + e.a, 'v1': ln(0.5) + e.b})
              OVER (PARTITION BY symbol ORDER BY ts_ms, tick_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS recent FROM emit),
lastp AS (
  SELECT *, list_reduce(recent, lambda p, x: {'a': x.a, 'b': x.b,
      'f0': x.a + ln(exp(p.f0 + ln(0.95) - greatest(p.f0, p.f1)) + exp(p.f1 + ln(0.05) - greatest(p.f0, p.f1))) + greatest(p.f0, p.f1),
      'f1': x.b + ln(exp(p.f0 + ln(0.05) - greatest(p.f0, p.f1)) + exp(p.f1 + ln(0.95) - greatest(p.f0, p.f1))) + greatest(p.f0, p.f1),
      'v0': x.a + greatest(p.v0 + ln(0.95), p.v1 + ln(0.05)),
      'v1': x.b + greatest(p.v0 + ln(0.05), p.v1 + ln(0.95))}) AS z FROM paths),
regimes AS MATERIALIZED (
  SELECT * EXCLUDE (e, recent, z), CASE WHEN z.v1 > z.v0 THEN 1 ELSE 0 END AS regime, 1 / (1 + exp(z.f0 - z.f1)) AS p1 FROM lastp)"""


def abs_sql(source: str) -> str:
    return f"""absd AS MATERIALIZED (
  SELECT *, CASE WHEN jr > 1 THEN least(0.95, 0.40 + 0.35 * (jr - 1)) WHEN sr > 1 THEN least(0.95, 0.40 + 0.30 * (sr - 1))
                 WHEN vr > 1 THEN least(0.95, 0.35 + 0.25 * (vr - 1)) ELSE least(0.49, greatest(jr, sr, vr) * 0.49) END AS absolute_score,
         jr > 1 OR sr > 1 OR vr > 1 AS absolute_on,
         CASE WHEN jr > 1 THEN 'flash_crash_price' WHEN sr > 1 THEN 'liquidity_spread' WHEN vr > 1 THEN 'volume_spike' ELSE 'normal' END AS absolute_reason
  FROM (SELECT *, abs(jump_bps) / 40.0 AS jr, spread_bps / 1.9 AS sr,
               volume / coalesce(avg(volume) OVER (PARTITION BY symbol ORDER BY ts_ms, tick_id ROWS BETWEEN 300 PRECEDING AND 1 PRECEDING), 1.0) / 1.9 AS vr
        FROM {source}))"""


def mad_sql(source: str, regime: str) -> str:
    return f"""madd AS MATERIALIZED (
  SELECT * EXCLUDE (rets, med, mad, z, kk),
    CASE WHEN rn < 30 THEN 0.25 WHEN mad < 1e-12 THEN 0.3 WHEN z > kk THEN least(0.95, 0.50 + 0.35 * ((z - kk) / kk)) ELSE least(0.49, z / kk * 0.49) END AS mad_score,
    rn >= 30 AND mad >= 1e-12 AND z > kk AS mad_on,
    CASE WHEN rn < 30 THEN 'warming_up' WHEN mad < 1e-12 THEN 'flat_market' WHEN z > kk THEN 'mad_outlier' ELSE 'normal' END AS mad_reason
  FROM (SELECT *, CASE WHEN mad >= 1e-12 THEN abs(ret - med) / (1.4826 * mad) END AS z, CASE WHEN {regime} = 1 THEN 8.0 ELSE 4.0 END AS kk
        FROM (SELECT *, list_median(list_transform(rets, lambda x: abs(x - med))) AS mad
              FROM (SELECT *, list_median(rets) AS med
                    FROM (SELECT *, list(ret) OVER (PARTITION BY symbol ORDER BY ts_ms, tick_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS rets FROM {source})))))"""


def vol_sql(source: str, normal: bool = False) -> str:
    agg = "avg" if normal else "sum"
    return f"""vold AS MATERIALIZED (
  SELECT * EXCLUDE (s, l, q),
    CASE WHEN rn < 30 THEN 0.25 WHEN l < 1e-12 AND s > 1e-8 THEN 0.7 WHEN l < 1e-12 THEN 0.0 WHEN q >= 5 THEN least(0.95, 0.70 + 0.15 * ((q - 5) / 5))
         WHEN q >= 2 THEN 0.45 + 0.25 * ((q - 2) / 3) ELSE least(0.49, q / 2 * 0.49) END AS vol_ratio_score,
    rn >= 30 AND CASE WHEN l < 1e-12 THEN s > 1e-8 ELSE q >= 2 END AS vol_ratio_on,
    CASE WHEN rn < 30 THEN 'warming_up' WHEN l < 1e-12 AND s > 1e-8 THEN 'vol_from_zero' WHEN l < 1e-12 THEN 'normal'
         WHEN q >= 5 THEN 'vol_explosion' WHEN q >= 2 THEN 'vol_spike' ELSE 'normal' END AS vol_ratio_reason
  FROM (SELECT *, CASE WHEN l > 0 THEN s / l END AS q FROM (
        SELECT *, sqrt({agg}(ret * ret) OVER (PARTITION BY symbol ORDER BY ts_ms, tick_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) AS s,
               sqrt({agg}(ret * ret) OVER (PARTITION BY symbol ORDER BY ts_ms, tick_id ROWS BETWEEN 299 PRECEDING AND CURRENT ROW)) AS l FROM {source})))"""


def _zsql(col: str) -> str:
    return f"CASE WHEN rn - 1 < 30 THEN 0.0 WHEN stddev_samp({col}) OVER b < 1e-9 THEN 0.0 ELSE ({col} - avg({col}) OVER b) / stddev_samp({col}) OVER b END"


def cusum_sql(source: str) -> str:
    return f"""cz AS MATERIALIZED (
  SELECT symbol, rn, 0.5 * {_zsql('jump_bps')} + 0.3 * {_zsql('spread_bps')} + 0.2 * {_zsql('volume')} AS z
  FROM {source} WINDOW b AS (PARTITION BY symbol ORDER BY ts_ms, tick_id ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING)),
cs AS (
  SELECT symbol, rn, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS neg FROM cz WHERE rn = 1
  UNION ALL
  SELECT cz.symbol, cz.rn,
    CASE WHEN cz.rn < 30 THEN 0.0 ELSE greatest(0.0, CASE WHEN greatest(cs.pos, cs.neg) >= 5 THEN 0.0 ELSE cs.pos END + cz.z - 0.5) END,
    CASE WHEN cz.rn < 30 THEN 0.0 ELSE greatest(0.0, CASE WHEN greatest(cs.pos, cs.neg) >= 5 THEN 0.0 ELSE cs.neg END - cz.z - 0.5) END
  FROM cs JOIN cz ON cz.symbol = cs.symbol AND cz.rn = cs.rn + 1),
cusd AS MATERIALIZED (
  SELECT symbol, rn, pos, neg,
    CASE WHEN rn < 30 THEN 0.25 WHEN greatest(pos, neg) >= 5 THEN least(0.95, greatest(pos, neg) / 5) ELSE least(0.64, greatest(pos, neg) / 5 * 0.64) END AS cusum_score,
    rn >= 30 AND greatest(pos, neg) >= 5 AS cusum_on,
    CASE WHEN rn < 30 THEN 'warming_up' WHEN greatest(pos, neg) < 5 THEN 'normal' WHEN pos >= neg THEN 'cusum_drift_up' ELSE 'cusum_drift_down' END AS cusum_reason FROM cs)"""


def ewma_sql(source: str) -> str:
    return f"""ez AS MATERIALIZED (
  SELECT symbol, rn, (jump_bps - avg(jump_bps) OVER b) / CASE WHEN stddev_samp(jump_bps) OVER b < 1e-9 THEN 1.0 ELSE stddev_samp(jump_bps) OVER b END AS zp,
         (spread_bps - avg(spread_bps) OVER b) / CASE WHEN stddev_samp(spread_bps) OVER b < 1e-9 THEN 1.0 ELSE stddev_samp(spread_bps) OVER b END AS zs
  FROM {source} WINDOW b AS (PARTITION BY symbol ORDER BY ts_ms, tick_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)),
es AS (
  SELECT symbol, rn, zp AS ep, zs AS es FROM ez WHERE rn = 30
  UNION ALL
  SELECT ez.symbol, ez.rn, 0.2 * ez.zp + 0.8 * es.ep, 0.2 * ez.zs + 0.8 * es.es FROM es JOIN ez ON ez.symbol = es.symbol AND ez.rn = es.rn + 1),
ec AS (SELECT symbol, rn, abs(ep) AS p, abs(es) AS s, 3 * sqrt(0.2::DOUBLE / 1.8) AS lim FROM es),
ewmd AS MATERIALIZED (
  SELECT symbol, rn, greatest(ps, ss) AS ewma_score, greatest(ps, ss) >= 0.5 AS ewma_on,
         CASE WHEN greatest(ps, ss) < 0.5 THEN 'normal' WHEN ss >= ps THEN 'ewma_spread' ELSE 'ewma_price' END AS ewma_reason
  FROM (SELECT symbol, rn, CASE WHEN p > lim THEN least(0.95, 0.5 + 0.5 * ((p - lim) / lim)) ELSE least(0.49, p / lim * 0.49) END AS ps,
               CASE WHEN s > lim THEN least(0.95, 0.5 + 0.5 * ((s - lim) / lim)) ELSE least(0.49, s / lim * 0.49) END AS ss FROM ec
        UNION ALL SELECT symbol, rn, 0.25, 0.25 FROM {source} WHERE rn < 30))"""


D = A.DETECTORS
W = dict(zip(D, (0.35, 0.30, 0.15, 0.10, 0.10)))
FUSE_SQL = f"""fused AS MATERIALIZED (
  SELECT *, CASE WHEN hits >= 2 THEN least(0.85, ({' + '.join(f'CASE WHEN {d}_on THEN {W[d]} * {d}_score ELSE 0 END' for d in D)})
                       / ({' + '.join(f'CASE WHEN {d}_on THEN {W[d]}::DOUBLE ELSE 0 END' for d in D)}))
              ELSE least(0.70, {' + '.join(f'{W[d]} * {d}_score' for d in D)}) END AS fused_score,
         CASE WHEN hits >= 2 THEN 'coincidence: ' || concat_ws(' + ', {', '.join(f'CASE WHEN {d}_on THEN {d}_reason END' for d in D)})
              WHEN hits = 1 THEN concat_ws('', {', '.join(f'CASE WHEN {d}_on THEN {d}_reason END' for d in D)})
              WHEN top < 0.20 THEN 'normal' ELSE coalesce({', '.join(f'CASE WHEN {d}_score = top THEN {d}_reason END' for d in D)}) END AS reason
  FROM (SELECT *, {' + '.join(f'CAST({d}_on AS INTEGER)' for d in D)} AS hits, greatest({', '.join(f'{d}_score' for d in D)}) AS top FROM detected)),
remembered AS MATERIALIZED (
  SELECT *, max(fused_score) OVER (PARTITION BY symbol ORDER BY ts_ms, tick_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS anomaly_score FROM fused)"""


def gate_sql(source: str) -> str:
    """Base states numbered by severity, then the gate as a recursion over row numbers."""
    worse = "b.base > g.state"
    return f"""based AS MATERIALIZED (
  SELECT *, CASE WHEN trust_score >= 0.6 THEN CASE WHEN anomaly_score >= CASE WHEN regime = 0 THEN 0.55::DOUBLE - 0.1::DOUBLE ELSE 0.55::DOUBLE + 0.1::DOUBLE END THEN 1 ELSE 0 END
            ELSE CASE WHEN anomaly_score >= CASE WHEN regime = 0 THEN 0.55::DOUBLE - 0.1::DOUBLE ELSE 0.55::DOUBLE + 0.1::DOUBLE END THEN 3 ELSE 2 END END AS base FROM {source}),
gs AS (
  SELECT symbol, 0::BIGINT AS rn, 0 AS state, -1 AS target, 0 AS streak FROM (SELECT DISTINCT symbol FROM based)
  UNION ALL
  SELECT b.symbol, b.rn,
    CASE WHEN {worse} THEN b.base WHEN g.state = 3 THEN CASE WHEN b.base = 0 AND g.streak + 1 >= 10 THEN 0 ELSE 3 END
         WHEN b.base = g.state THEN g.state
         WHEN (CASE WHEN g.target = b.base THEN g.streak + 1 ELSE 1 END) >= 10 THEN b.base ELSE g.state END,
    CASE WHEN {worse} THEN -1 WHEN g.state = 3 THEN g.target WHEN b.base = g.state THEN -1
         WHEN (CASE WHEN g.target = b.base THEN g.streak + 1 ELSE 1 END) >= 10 THEN -1 ELSE b.base END,
    CASE WHEN {worse} THEN 0 WHEN g.state = 3 THEN CASE WHEN b.base <> 0 OR g.streak + 1 >= 10 THEN 0 ELSE g.streak + 1 END
         WHEN b.base = g.state THEN 0
         WHEN (CASE WHEN g.target = b.base THEN g.streak + 1 ELSE 1 END) >= 10 THEN 0
         ELSE CASE WHEN g.target = b.base THEN g.streak + 1 ELSE 1 END END
  FROM gs g JOIN based b ON b.symbol = g.symbol AND b.rn = g.rn + 1),
gated AS MATERIALIZED (
  SELECT based.*, ['NORMAL', 'CONSERVATIVE', 'DEGRADED', 'HALT'][gs.state + 1] AS system_state,
         ['NORMAL', 'CONSERVATIVE', 'DEGRADED', 'HALT'][based.base + 1] AS base_state
  FROM based JOIN gs ON gs.symbol = based.symbol AND gs.rn = based.rn)"""


DETECTED_SQL = """detected AS MATERIALIZED (
  SELECT v.*, c.* EXCLUDE (symbol, rn), e.* EXCLUDE (symbol, rn) FROM vold v JOIN cusd c USING (symbol, rn) JOIN ewmd e USING (symbol, rn))"""
SCORE_CTES = (FEAT_SQL, RV_SQL, HMM_SQL, abs_sql("regimes"), mad_sql("absd", "regime"), vol_sql("madd"), cusum_sql("regimes"),
              ewma_sql("regimes"), DETECTED_SQL, FUSE_SQL, gate_sql("remembered"))


def features(spark, sf):
    return A.tick_features(validated(spark, sf), LAYOUT)


def flat(df, detector):
    d = F.col(detector)
    return df.select("tick_id", r(d["score"]).alias("score"), d["triggered"].alias("triggered"), d["reason"].alias("reason"))


def detector_sql(name: str, source: str) -> str:
    return f"SELECT tick_id, round({name}_score, 8) AS score, {name}_on AS triggered, {name}_reason AS reason FROM {source}"


@query("rv_30m", with_ticks("SELECT tick_id, round(rv, 9) AS rv FROM rvs", FEAT_SQL, RV_SQL))
def rv_30m(spark, sf):
    return A.rv(features(spark, sf), LAYOUT, window_ms=DAY_MS).select("tick_id", r(F.col("rv"), 9).alias("rv"))


@query("volume_ratio", with_ticks("""
SELECT tick_id, round(volume / coalesce(avg(volume) OVER (PARTITION BY symbol ORDER BY ts_ms, tick_id ROWS BETWEEN 300 PRECEDING AND 1 PRECEDING), 1.0), 8)
  AS volume_ratio FROM feat""", FEAT_SQL))
def volume_ratio(spark, sf):
    return A.volume_ratio(features(spark, sf), LAYOUT).select("tick_id", r(F.col("volume_ratio")).alias("volume_ratio"))


@query("hmm_regime", with_ticks("SELECT tick_id, regime, round(p1, 7) AS p_high FROM regimes", FEAT_SQL, RV_SQL, HMM_SQL))
def hmm_regime(spark, sf):
    out = A.hmm_regime(A.rv(features(spark, sf), LAYOUT, window_ms=DAY_MS), LAYOUT, model=REGIME)
    return out.select("tick_id", "regime", r(F.col("regime_posterior")[1], 7).alias("p_high"))


@query("absolute_detector", with_ticks(detector_sql("absolute", "absd"), FEAT_SQL, abs_sql("feat")))
def absolute_detector(spark, sf):
    return flat(A.absolute_detector(features(spark, sf), LAYOUT, cfg=ABSOLUTE), "absolute")


@query("mad_detector", with_ticks(detector_sql("mad", "madd"), FEAT_SQL, mad_sql("feat", "k % 2")))
def mad_detector(spark, sf):
    return flat(A.mad_detector(features(spark, sf).withColumn("regime", F.col("k") % 2), LAYOUT), "mad")


@query("vol_ratio_detector", with_ticks(detector_sql("vol_ratio", "vold"), FEAT_SQL, vol_sql("feat")))
def vol_ratio_detector(spark, sf):
    return flat(A.vol_ratio_detector(features(spark, sf), LAYOUT), "vol_ratio")


@query("vol_ratio_normalized", with_ticks(detector_sql("vol_ratio", "vold"), FEAT_SQL, vol_sql("feat", True)))
def vol_ratio_normalized(spark, sf):
    return flat(A.vol_ratio_detector(features(spark, sf), LAYOUT, cfg=A.VolRatioConfig(normalize=True)), "vol_ratio")


@query("cusum_detector", with_ticks(
    "SELECT f.tick_id, round(cusum_score, 8) AS score, cusum_on AS triggered, cusum_reason AS reason FROM cusd JOIN feat f USING (symbol, rn)",
    FEAT_SQL, cusum_sql("feat")))
def cusum_detector(spark, sf):
    return flat(A.cusum_detector(features(spark, sf), LAYOUT), "cusum")


@query("cusum_lindley", with_ticks("""
SELECT tick_id, round(su - least(0.0, min(su) OVER w), 6) + 0.0 AS pos, round(sd - least(0.0, min(sd) OVER w), 6) + 0.0 AS neg
FROM (SELECT f.symbol, f.ts_ms, f.tick_id, sum(z - 0.5) OVER w AS su, sum(-z - 0.5) OVER w AS sd FROM cz JOIN feat f USING (symbol, rn)
      WINDOW w AS (PARTITION BY f.symbol ORDER BY f.ts_ms, f.tick_id)) WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, tick_id)""",
    FEAT_SQL, cusum_sql("feat")))
def cusum_lindley(spark, sf):
    from tidewatch.plans.scans import over_rows

    z = over_rows(features(spark, sf), LAYOUT, 1000, A.cusum_input).select("symbol", "ts_ms", "tick_id", "cusum_z")
    out = A.cusum_lindley(z, LAYOUT)
    return out.select("tick_id", (r(F.col("cusum_pos"), 6) + 0.0).alias("pos"), (r(F.col("cusum_neg"), 6) + 0.0).alias("neg"))


@query("ewma_detector", with_ticks(
    "SELECT f.tick_id, round(ewma_score, 8) AS score, ewma_on AS triggered, ewma_reason AS reason FROM ewmd JOIN feat f USING (symbol, rn)",
    FEAT_SQL, ewma_sql("feat")))
def ewma_detector(spark, sf):
    return flat(A.ewma_detector(features(spark, sf), LAYOUT), "ewma")


# Detector results made from tick fields, so that every fusion branch has rows.
def _made(df):
    k, i = F.col("k"), F.col("tick_id")
    out = df
    for n, d in enumerate(D):
        score = ((i * (2 * n + 3) + k * (n + 1)) % 101) / 125.0
        hit = (i * (n + 2) + k) % 5 == 0
        out = out.withColumn(d, A.verdict(score, hit, F.concat(F.lit(f"{d}_"), F.when(hit, "hit").otherwise("normal"))))
    return out


MADE_SQL = "detected AS MATERIALIZED (SELECT *" + "".join(
    f", ((tick_id * {2 * n + 3} + k * {n + 1}) % 101) / 125.0::DOUBLE AS {d}_score, (tick_id * {n + 2} + k) % 5 = 0 AS {d}_on,"
    f" '{d}_' || CASE WHEN (tick_id * {n + 2} + k) % 5 = 0 THEN 'hit' ELSE 'normal' END AS {d}_reason"
    for n, d in enumerate(D)) + " FROM feat)"


@query("fuse_scores", with_ticks(
    "SELECT tick_id, round(fused_score, 8) AS fused_score, reason, hits AS triggered_count, round(top, 8) AS max_detector_score FROM fused",
    FEAT_SQL, MADE_SQL, FUSE_SQL))
def fuse_scores(spark, sf):
    out = A.fuse_scores(_made(ticks(spark, sf)))
    return out.select("tick_id", r(F.col("fused_score")).alias("fused_score"), "reason", "triggered_count",
                      r(F.col("max_detector_score")).alias("max_detector_score"))


@query("score_memory", with_ticks("SELECT tick_id, round(anomaly_score, 8) AS anomaly_score FROM remembered", FEAT_SQL, MADE_SQL, FUSE_SQL))
def score_memory(spark, sf):
    out = A.score_memory(A.fuse_scores(_made(ticks(spark, sf))), LAYOUT)
    return out.select("tick_id", r(F.col("anomaly_score")).alias("anomaly_score"))


SIMPLE_SQL = """simple AS MATERIALIZED (SELECT *, CASE WHEN (ts_ms // 36000000) % 4 = 0 THEN 0.8 ELSE 0.2 END + k / 1000.0::DOUBLE AS anomaly_score,
   CAST((ts_ms // 86400000) % 2 AS INTEGER) AS regime FROM feat)"""


def simple(spark, sf):
    odd = F.pmod(F.floor(F.col("ts_ms") / 36_000_000), F.lit(4)) == 0
    return validated(spark, sf).withColumn("anomaly_score", F.when(odd, 0.8).otherwise(0.2) + F.col("k") / 1000.0).withColumn(
        "regime", F.pmod(F.floor(F.col("ts_ms") / DAY_MS), F.lit(2)).cast("int"))


@query("gate_base_state", with_ticks("SELECT tick_id, base_state FROM gated", FEAT_SQL, SIMPLE_SQL, gate_sql("simple")))
def gate_base_state(spark, sf):
    return simple(spark, sf).select("tick_id", A.gate_base_state().alias("base_state"))


@query("decision_gate", with_ticks("SELECT tick_id, base_state, system_state FROM gated", FEAT_SQL, SIMPLE_SQL, gate_sql("simple")))
def decision_gate(spark, sf):
    base = simple(spark, sf).select("symbol", "ts_ms", "tick_id", A.gate_base_state().alias("base_state"))
    return A.decision_gate(base, LAYOUT).select("tick_id", "base_state", "system_state")


def scored(spark, sf):
    return A.score_ticks(validated(spark, sf), LAYOUT, cfg=SCORING)


@query("score_ticks", with_ticks(f"""
SELECT tick_id, symbol, ts_ms, round(anomaly_score, 7) AS anomaly_score, reason, regime, system_state, hits AS triggered_count,
       {', '.join(f'round({d}_score, 7) AS {d}_score' for d in D)} FROM gated""", *SCORE_CTES))
def score_ticks(spark, sf):
    return scored(spark, sf).select(
        "tick_id", "symbol", "ts_ms", r(F.col("anomaly_score"), 7).alias("anomaly_score"), "reason", "regime", "system_state",
        "triggered_count", *[r(F.col(f"{d}_score"), 7).alias(f"{d}_score") for d in D])


@query("spc_combined", with_ticks("SELECT tick_id, round((cusum_score + ewma_score) / 2, 8) AS spc_score FROM detected", FEAT_SQL, MADE_SQL))
def spc_combined(spark, sf):
    return _made(ticks(spark, sf)).select("tick_id", r(A.spc_combined()).alias("spc_score"))


@query("silence_watchdog", with_ticks("""
SELECT symbol, ts_ms + 3600000 AS halt_ts_ms, ts_ms AS last_ts_ms, nxt AS resumed_ts_ms, 'HALT' AS system_state, 'silence_watchdog' AS reason
FROM (SELECT *, lead(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms, tick_id) AS nxt FROM ticks) WHERE nxt > ts_ms + 3600000"""))
def silence_watchdog(spark, sf):
    return A.silence_watchdog(ticks(spark, sf), LAYOUT, silence_ms=3_600_000)


def _transition_sql(col: str) -> str:
    return f"""SELECT symbol, was AS from_value, {col} AS to_value, count(*) AS n
FROM (SELECT *, lag({col}) OVER (PARTITION BY symbol ORDER BY ts_ms, tick_id) AS was FROM gated) WHERE was <> {col} GROUP BY ALL"""


def _simple_gated(spark, sf):
    return A.decision_gate(simple(spark, sf).withColumn("base_state", A.gate_base_state()), LAYOUT)


@query("regime_transitions", with_ticks(_transition_sql("regime"), FEAT_SQL, SIMPLE_SQL, gate_sql("simple")))
def regime_transitions(spark, sf):
    return A.transitions(simple(spark, sf), "regime", LAYOUT)


@query("gate_transitions", with_ticks(_transition_sql("system_state"), FEAT_SQL, SIMPLE_SQL, gate_sql("simple")))
def gate_transitions(spark, sf):
    return A.transitions(_simple_gated(spark, sf), "system_state", LAYOUT)


@query("gate_triggers", with_ticks("""
SELECT symbol, count(*) FILTER (trust_score < 0.6) AS trust_low, count(*) FILTER (anomaly_score > 0.8) AS anomaly_high
FROM (SELECT *, lag(system_state) OVER (PARTITION BY symbol ORDER BY ts_ms, tick_id) AS was FROM gated) WHERE was <> system_state GROUP BY symbol""",
    FEAT_SQL, SIMPLE_SQL, gate_sql("simple")))
def gate_triggers(spark, sf):
    return A.gate_triggers(_simple_gated(spark, sf), LAYOUT)


@query("anomaly_reasons", with_ticks(
    "SELECT symbol, reason, count(*) AS n FROM fused WHERE fused_score > 0.5 GROUP BY ALL", FEAT_SQL, MADE_SQL, FUSE_SQL))
def anomaly_reasons(spark, sf):
    return A.anomaly_reasons(A.fuse_scores(_made(ticks(spark, sf))).withColumnRenamed("fused_score", "anomaly_score"))


@query("score_histogram", with_ticks("""
SELECT symbol, b / 10.0::DOUBLE AS le, count(*) FILTER (anomaly_score <= b / 10.0::DOUBLE) AS n FROM simple, range(0, 11) t(b) GROUP BY ALL""",
    FEAT_SQL, SIMPLE_SQL))
def score_histogram(spark, sf):
    return A.score_histogram(simple(spark, sf))


@query("coincidence_counts", with_ticks(
    "SELECT symbol, count(*) FILTER (hits >= 2) AS coincidences, count(*) AS ticks FROM fused GROUP BY symbol", FEAT_SQL, MADE_SQL, FUSE_SQL))
def coincidence_counts(spark, sf):
    return A.coincidence_counts(A.fuse_scores(_made(ticks(spark, sf))))


@query("input_lag_ms", with_ticks("""
SELECT symbol, arg_max(greatest(0, ts_ms - exchange_ts_ms), (ts_ms, tick_id)) AS input_lag_ms FROM ticks GROUP BY symbol"""))
def input_lag_ms(spark, sf):
    # In batch the receive time stands for the processing time.
    lag = F.greatest(F.lit(0), F.col("ts_ms") - F.col("exchange_ts_ms"))
    return ticks(spark, sf).groupBy("symbol").agg(F.max_by(lag, F.struct("ts_ms", "tick_id")).alias("input_lag_ms"))
