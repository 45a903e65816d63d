"""Scalar expression queries."""

from pyspark.sql import functions as F

from tidewatch.functions import scalar as S
from tidewatch.operators import anomaly as A
from tidewatch.plans.scans import previous
from tidewatch.workload.registry import query
from tidewatch.workload.ticks import HOUR_MS, LAYOUT, table, ticks, with_ticks

PREV_SQL = """moves AS (
  SELECT *, coalesce(lag(mid) OVER (PARTITION BY symbol ORDER BY ts_ms, tick_id), mid) AS prev_mid FROM ticks)"""


def r(col, places=8):
    return F.round(col, places)


@query("mid_price", with_ticks("SELECT tick_id, round((bid + ask) / 2, 8) AS mid_price FROM ticks"))
def mid_price(spark, sf):
    return ticks(spark, sf).select("tick_id", r(S.mid_price()).alias("mid_price"))


@query("relative_spread", with_ticks("""
SELECT tick_id, round(greatest(0.0, (ask - bid) / ((bid + ask) / 2)), 9) AS relative_spread FROM ticks
WHERE (bid + ask) / 2 > 0"""))
def relative_spread(spark, sf):
    out = ticks(spark, sf).select("tick_id", r(S.relative_spread(), 9).alias("relative_spread"))
    return out.where(F.col("relative_spread").isNotNull())


@query("tick_latency", with_ticks(f"""
SELECT tick_id, CAST(greatest(0, (ts_ms // {HOUR_MS} + 1) * {HOUR_MS}
       - CASE WHEN timestamp_source = 'exchange' THEN exchange_ts_ms ELSE ts_ms END) AS DOUBLE) AS latency_ms FROM ticks"""))
def tick_latency(spark, sf):
    end = (F.floor(F.col("ts_ms") / HOUR_MS) + 1) * HOUR_MS
    return ticks(spark, sf).select("tick_id", S.tick_latency(end).alias("latency_ms"))


@query("log_return", with_ticks("SELECT tick_id, round(ln(mid / prev_mid), 9) + 0.0 AS ret FROM moves", PREV_SQL))
def log_return(spark, sf):
    t = previous(ticks(spark, sf).select("symbol", "ts_ms", "tick_id", "mid"), LAYOUT, prev_mid="mid")
    return t.select("tick_id", r(S.log_return("mid", F.coalesce("prev_mid", "mid")), 9).alias("ret"))


@query("price_jump_bps", with_ticks(
    "SELECT tick_id, round((mid - prev_mid) / prev_mid * 10000, 6) AS jump_bps FROM moves", PREV_SQL))
def price_jump_bps(spark, sf):
    t = previous(ticks(spark, sf).select("symbol", "ts_ms", "tick_id", "mid"), LAYOUT, prev_mid="mid")
    return t.select("tick_id", r(S.price_jump_bps("mid", F.coalesce("prev_mid", "mid")), 6).alias("jump_bps"))


@query("spread_bps", with_ticks("""
SELECT tick_id, round((ask - bid) / mid * 10000, 6) AS relative_bps,
       round(greatest(0.0, (ask - bid) / ((bid + ask) / 2)) * 10000, 6) AS price_bps FROM ticks"""))
def spread_bps(spark, sf):
    return ticks(spark, sf).select(
        "tick_id",
        r(S.spread_bps(F.col("ask") - F.col("bid"), "mid"), 6).alias("relative_bps"),
        r(S.spread_bps(S.relative_spread(), "mid", "price"), 6).alias("price_bps"),
    )


@query("clip01", with_ticks("SELECT tick_id, round(greatest(0.0, least(1.0, (mid - 100.02) * 10)), 8) AS clipped FROM ticks"))
def clip01(spark, sf):
    return ticks(spark, sf).select("tick_id", r(S.clip01((F.col("mid") - 100.02) * 10)).alias("clipped"))


@query("venue_price_check", with_ticks("""
SELECT bucket, symbol, CASE WHEN NOT bool_or(exchange_id = 'binance') THEN 'execution_venue_binance_not_in_prices'
         WHEN bool_or(last_mid < 100.0005) THEN 'execution_venue_prices_invalid' ELSE 'ok' END AS verdict
FROM (SELECT symbol, ts_ms // 3600000 AS bucket, exchange_id, arg_max(mid, (ts_ms, tick_id)) AS last_mid
      FROM ticks GROUP BY ALL) GROUP BY bucket, symbol"""))
def venue_price_check(spark, sf):
    last = ticks(spark, sf).groupBy(
        "symbol", F.floor(F.col("ts_ms") / HOUR_MS).cast("long").alias("bucket"), "exchange_id"
    ).agg(F.max_by("mid", F.struct("ts_ms", "tick_id")).alias("last_mid"))
    # Prices are shifted so that the smallest ones are not positive and the last rule has rows to find.
    prices = F.map_from_entries(F.collect_list(F.struct("exchange_id", r(F.col("last_mid") - 100.0005, 6))))
    return last.groupBy("symbol", "bucket").agg(prices.alias("m")).select(
        "bucket", "symbol", S.venue_price_check("m", F.lit("binance")).alias("verdict")
    )


@query("canonical_json", with_ticks("""
SELECT tick_id, '{"exchange_id":"' || exchange_id || '","mid":' || CAST(round(mid * 1000000) AS BIGINT)
  || CASE WHEN sequence_id IS NULL THEN '' ELSE ',"sequence_id":' || sequence_id END
  || ',"symbol":"' || symbol || '","ts_ms":' || ts_ms || '}' AS body FROM ticks"""))
def canonical_json(spark, sf):
    return ticks(spark, sf).select(
        "tick_id",
        S.canonical_json(
            symbol=F.col("symbol"), mid=S.micros("mid"), ts_ms=F.col("ts_ms"), sequence_id=F.col("sequence_id"),
            exchange_id=F.col("exchange_id"),
        ).alias("body"),
    )


@query("time_of_day_features", with_ticks("""
SELECT tick_id, round(sin((ts_ms // 1000) % 86400 / 86400.0 * 2 * pi()), 8) AS tod_sin,
       round(cos((ts_ms // 1000) % 86400 / 86400.0 * 2 * pi()), 8) AS tod_cos FROM ticks"""))
def time_of_day_features(spark, sf):
    sin, cos = S.time_of_day("ts_ms")
    return ticks(spark, sf).select("tick_id", r(sin).alias("tod_sin"), r(cos).alias("tod_cos"))


@query("normalize_epoch_ms", with_ticks("SELECT tick_id, ts_ms AS ms, ts_ms AS from_us, ts_ms AS from_ns FROM ticks"))
def normalize_epoch_ms(spark, sf):
    t = F.col("ts_ms")
    return ticks(spark, sf).select(
        "tick_id", S.epoch_ms(t).alias("ms"), S.epoch_ms(t * 1000 + 7).alias("from_us"),
        S.epoch_ms(t * 1_000_000 + 7).alias("from_ns"),
    )


@query("client_order_id", """
SELECT l_orderkey, l_linenumber, sha256('S' || (l_suppkey % 4) || '|' || CASE WHEN l_returnflag = 'R' THEN 'SHORT' ELSE 'LONG' END
   || '|' || printf('%.8f', l_discount) || '|' || (epoch_us(l_shipdate) // 1000) || '|session-1') AS client_order_id FROM lineitem""")
def client_order_id(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        S.client_order_id(
            F.concat(F.lit("S"), (F.col("l_suppkey") % 4).cast("string")),
            F.when(F.col("l_returnflag") == "R", "SHORT").otherwise("LONG"),
            F.col("l_discount"), F.unix_millis(F.col("l_shipdate").cast("timestamp")), "session-1",
        ).alias("client_order_id"),
    )


@query("hash_jitter", """
SELECT o_orderkey, round((CAST('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE * 2 - 1) * 25.0, 8)
  AS jitter_ms FROM orders""")
def hash_jitter(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", r(S.hash_jitter(F.col("o_orderkey").cast("string"))).alias("jitter_ms")
    )


@query("source_layer", with_ticks("""
SELECT tick_id, CASE WHEN k % 8 < 7 THEN k % 8 ELSE 6 END AS layer FROM ticks"""))
def source_layer(spark, sf):
    name = F.when(F.col("k") % 8 < 7, F.concat(F.lit("layer"), (F.col("k") % 8).cast("string"), F.lit("_x"))).otherwise("core")
    return ticks(spark, sf).select("tick_id", S.source_layer(name).alias("layer"))


@query("symbol_map", """
SELECT l_partkey AS id, 'A' || l_partkey || '-USDT' AS dashed, 'A' || l_partkey || 'USDT' AS compact,
       'XBT' || l_partkey || '/USDT' AS kraken, 'BTC' || l_partkey || '-USDT' AS back FROM (SELECT DISTINCT l_partkey FROM lineitem)""")
def symbol_map(spark, sf):
    ids = table(spark, sf, "lineitem").select("l_partkey").distinct()
    base = F.col("l_partkey").cast("string")
    dashed = S.dashed_symbol(F.concat(F.lit("a"), base, F.lit("usdt")))
    kraken = S.kraken_pair(F.concat(F.lit("BTC"), base, F.lit("-USDT")))
    return ids.select(
        F.col("l_partkey").alias("id"), dashed.alias("dashed"), S.compact_symbol(dashed).alias("compact"),
        kraken.alias("kraken"), S.from_kraken_pair(kraken).alias("back"),
    )
