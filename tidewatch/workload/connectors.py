"""Source, sink and venue message queries. Files are written from the supplied tables by Spark and read back."""

import uuid

from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.functions import scalar as S
from tidewatch.operators import backtest as B
from tidewatch.plans.layout import Layout
from tidewatch.plans.store import materialise, shared_folder
from tidewatch.sources import messages as M
from tidewatch.sources import results as R
from tidewatch.sources import ticks as K
from tidewatch.sources import topics as P
from tidewatch.workload.registry import query
from tidewatch.workload.scalars import r
from tidewatch.workload.ticks import DAY_MS, HOUR_MS, SLOT_MS, VENUE_LAYOUT, VENUES, table, ticks, with_ticks
from tidewatch.workload.trading import EQUITY_SQL, equity


def scratch(spark):
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def history(spark, sf):
    iso = F.concat(F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    stamp = F.when(F.col("k") % 3 == 0, F.col("ts_ms").cast("string")).when(F.col("k") % 3 == 1, (F.col("ts_ms") * 1000).cast("string")).otherwise(iso)
    return ticks(spark, sf).select(stamp.alias("timestamp"), F.col("exchange_id").alias("source"), F.col("symbol").alias("pair"), F.col("bid").alias("best_bid"),
                                   F.col("ask").alias("best_ask"), F.col("last_price").alias("price"), F.col("volume_24h").alias("qty"))


HIST = "ts_ms, exchange_id, symbol, round(bid, 8) AS bid, round(ask, 8) AS ask, round(last_price, 8) AS last_price, round(volume_24h, 4) AS volume"


def hist(df):
    return df.select("ts_ms", "exchange_id", "symbol", *[r(F.col(c)).alias(c) for c in ("bid", "ask", "last_price")], r(F.col("volume"), 4).alias("volume"))


@query("scan_csv_ticks", with_ticks(f"SELECT {HIST} FROM ticks"))
def scan_csv_ticks(spark, sf):
    path = scratch(spark)
    history(spark, sf).write.option("header", True).csv(path)
    return hist(K.scan_csv_ticks(spark, path))


@query("scan_jsonl_ticks", with_ticks(f"SELECT {HIST} FROM ticks"))
def scan_jsonl_ticks(spark, sf):
    path = scratch(spark)
    rows = history(spark, sf)
    rows.write.json(path)
    return hist(K.scan_jsonl_ticks(spark, path, "timestamp string, source string, pair string, best_bid double, best_ask double, price double, qty double"))


def cache(spark, sf):
    path = scratch(spark)
    K.write_tick_cache(ticks(spark, sf).withColumnRenamed("volume_24h", "volume"), path)
    return path


LO, HI = 1_704_067_200_000 + 5 * DAY_MS, 1_704_067_200_000 + 9 * DAY_MS


@query("write_tick_cache", with_ticks(f"SELECT {HIST} FROM ticks"))
def write_tick_cache(spark, sf):
    return hist(spark.read.parquet(cache(spark, sf)))


@query("scan_cached_ticks", with_ticks(f"SELECT {HIST} FROM ticks WHERE ts_ms BETWEEN {LO} AND {HI} AND symbol = 'S1'"))
def scan_cached_ticks(spark, sf):
    return hist(K.scan_cached_ticks(spark, cache(spark, sf), start_ms=LO, end_ms=HI, symbol="S1"))


@query("union_exchange_files", with_ticks(f"SELECT {HIST} FROM ticks WHERE ts_ms BETWEEN {LO} AND {HI} AND symbol = 'S1'"))
def union_exchange_files(spark, sf):
    base = scratch(spark)
    paths = [f"{base}/{v}_ticks.csv" for v in VENUES]
    rows = history(spark, sf)
    for v, path in zip(VENUES, paths):
        rows.where(F.col("source") == v).write.option("header", True).csv(path)
    return hist(K.union_exchange_files(spark, paths, symbol="S1", start_ms=LO, end_ms=HI))


def klines(spark, sf):
    start = F.floor(F.col("ts_ms") / HOUR_MS) * HOUR_MS
    rank = F.struct("ts_ms", "tick_id")
    return ticks(spark, sf).groupBy("symbol", start.cast("long").alias("open_time_ms")).agg(
        F.min_by("mid", rank).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", rank).alias("close"),
        F.sum("volume_24h").alias("volume")).withColumn("close_time_ms", F.col("open_time_ms") + HOUR_MS - 1)


KL_SQL = f"""kl AS (SELECT symbol, ts_ms // {HOUR_MS} * {HOUR_MS} AS o, arg_min(mid, (ts_ms, tick_id)) AS open, max(mid) AS high, min(mid) AS low, arg_max(mid, (ts_ms, tick_id)) AS close, sum(volume_24h) AS volume
  FROM ticks GROUP BY ALL)"""


def _zip_day(rows):
    """The klines of one symbol and day as a zipped file; run once per group, returns the file's bytes."""
    import io
    import zipfile

    import pandas as pd

    lines = "\n".join(",".join(map(str, (int(o), a, b, c, d, v, int(e)))) for o, a, b, c, d, v, e in
                      rows.sort_values("open_time_ms")[K.KLINE_NAMES].itertuples(index=False))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("klines.csv", lines)
    return pd.DataFrame({"symbol": [rows["symbol"].iloc[0]], "day": [rows["day"].iloc[0]], "content": [buffer.getvalue()]})


def write_kline_archives(spark, sf):
    """One archive per symbol and day in a new folder of the shared one, written by the tasks that zip them.

    The bytes go through the text writer as they are; the line end behind an archive is no part of it, and readers of archives pass over it.
    """
    path = scratch(spark)
    days = klines(spark, sf).withColumn("day", F.floor(F.col("open_time_ms") / DAY_MS).cast("long"))
    archives = days.groupBy("symbol", "day").applyInPandas(_zip_day, "symbol string, day long, content binary")
    name = F.concat("symbol", F.lit("-1h-"), F.col("day").cast("string"), F.lit(".zip"))
    archives.select(F.col("content").cast("string").alias("value"), name.alias("archive")).write.partitionBy("archive").text(path)
    return path


def archived_klines(spark, sf):
    """The klines of all symbols, read back from their archives."""
    return K.scan_kline_archive(spark, write_kline_archives(spark, sf), symbol=r"archive=([^/]+)-1h-[0-9]+\.zip/", files="part-*")


def all_kline_ticks(spark, sf):
    # Archive prices have two decimals.
    k = klines(spark, sf)
    for c in ("high", "low", "close"):
        k = k.withColumn(c, F.ceil(F.col(c) * 100 - 0.0001) / 100)
    return K.kline_to_ticks(k)


def all_kline_candles(spark, sf):
    k = klines(spark, sf)
    hour = F.col("open_time_ms") / HOUR_MS
    cells = [F.col(c).cast("string") for c in K.KLINE_NAMES]
    row = F.when(hour % 5 == 0, F.array(*cells[:5])).when(hour % 2 == 0, F.array(*cells, F.lit("0"), F.lit("7"))).otherwise(F.array(*cells, F.lit("0")))
    return K.kline_rows_to_candles(k.select("symbol", row.alias("row")), timeframe_ms=HOUR_MS)


@query("scan_kline_archive", with_ticks(f"SELECT symbol, o AS open_time_ms, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, round(volume, 4) AS volume, o + {HOUR_MS - 1} AS close_time_ms FROM kl", KL_SQL))
def scan_kline_archive(spark, sf):
    rows = archived_klines(spark, sf)
    return rows.select("symbol", "open_time_ms", *[r(F.col(c)).alias(c) for c in ("open", "high", "low", "close")], r(F.col("volume"), 4).alias("volume"), "close_time_ms")


@query("kline_to_ticks", with_ticks("""
SELECT symbol, o AS ts_ms, ceil(low * 100 - 0.0001) / 100 AS bid, ceil(high * 100 - 0.0001) / 100 AS ask, ceil(close * 100 - 0.0001) / 100 AS last_price FROM kl""", KL_SQL))
def kline_to_ticks(spark, sf):
    return all_kline_ticks(spark, sf).select("symbol", "ts_ms", "bid", "ask", "last_price")


@query("trade_to_ticks", "SELECT epoch_us(l_shipdate) // 1000 AS ts_ms, 'P' || l_partkey AS symbol, l_extendedprice AS bid, l_extendedprice AS ask, l_extendedprice AS last_price, l_quantity AS volume FROM lineitem")
def trade_to_ticks(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts_ms"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol"),
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    return K.trade_to_ticks(rows)


@query("kline_rows_to_candles", with_ticks(f"""SELECT symbol, o AS start_ms, o + {HOUR_MS} AS end_ms, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close,
  round(volume, 4) AS volume, CASE WHEN (o // {HOUR_MS}) % 2 = 0 THEN 7 ELSE 0 END AS trade_count FROM kl WHERE (o // {HOUR_MS}) % 5 <> 0""", KL_SQL))
def kline_rows_to_candles(spark, sf):
    out = all_kline_candles(spark, sf)
    return out.select("symbol", "start_ms", "end_ms", *[r(F.col(c)).alias(c) for c in ("open", "high", "low", "close")], r(F.col("volume"), 4).alias("volume"), "trade_count")


# ------------------------------------------------------------------------------------------ topics and checks

TICK_DDL = "tick_id long, exchange_id string, symbol string, ts_ms long, mid double"


def published(spark, sf):
    return P.encode_json(ticks(spark, sf).select("tick_id", "exchange_id", "symbol", "ts_ms", r(F.col("mid"), 6).alias("mid")), key=F.col("symbol"))


@query("kafka_json_source", with_ticks("SELECT symbol AS key, tick_id, exchange_id, symbol, ts_ms, round(mid, 6) AS mid FROM ticks"))
def kafka_json_source(spark, sf):
    # The message frame a topic delivers: a key and the value as bytes.
    messages = published(spark, sf).withColumn("value", F.col("value").cast("binary"))
    return P.decode_json(messages, TICK_DDL).drop("_corrupt_record")


@query("kafka_json_sink", with_ticks("""
SELECT symbol AS key, '{"exchange_id":"' || exchange_id || '","symbol":"' || symbol || '","tick_id":' || tick_id || ',"ts_ms":' || ts_ms || '}' AS value FROM ticks"""))
def kafka_json_sink(spark, sf):
    return P.encode_json(ticks(spark, sf).select("tick_id", "exchange_id", "symbol", "ts_ms"), key=F.col("symbol"))


def inbox(spark, sf):
    good = F.to_json(F.struct("tick_id", "exchange_id", "symbol", "ts_ms", r(F.col("mid"), 6).alias("mid")))
    lost = F.to_json(F.struct("tick_id", "exchange_id", "ts_ms"))
    value = F.when(F.col("tick_id") % 17 == 0, F.lit("{broken")).when(F.col("tick_id") % 19 == 0, lost).otherwise(good)
    return ticks(spark, sf).select(F.col("exchange_id").alias("venue"), value.alias("value"))


@query("dead_letter_split", with_ticks("""
SELECT exchange_id AS venue, CASE WHEN tick_id % 17 = 0 THEN 'malformed' WHEN tick_id % 19 = 0 THEN 'schema_error' ELSE 'accepted' END AS reason, count(*) AS n FROM ticks GROUP BY ALL"""))
def dead_letter_split(spark, sf):
    good, bad = M.dead_letter_split(inbox(spark, sf), TICK_DDL, ("tick_id", "symbol", "mid"))
    return bad.groupBy("venue", "reason").agg(F.count(F.lit(1)).alias("n")).unionByName(
        good.groupBy("venue").agg(F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit("accepted")))


@query("schema_version_check", with_ticks("""
SELECT tick_id, CASE WHEN k % 3 = 2 THEN 'unknown_model_Quote' WHEN k % 2 = 0 THEN 'ok' ELSE 'version_mismatch_' || CASE k % 3 WHEN 0 THEN 'RawTick' ELSE 'ScoredTick' END || '_expected_v1_got_v0' END AS verdict FROM ticks"""))
def schema_version_check(spark, sf):
    k = F.col("k")
    model = F.when(k % 3 == 0, "RawTick").when(k % 3 == 1, "ScoredTick").otherwise("Quote")
    return ticks(spark, sf).select("tick_id", M.schema_version_check(model, F.when(k % 2 == 0, "v1").otherwise("v0"), schemas.EXPECTED_VERSIONS).alias("verdict"))


def run_store(spark, sf):
    path = scratch(spark)
    orders = table(spark, sf, "orders").withColumn("run_id", F.concat(F.lit("run"), (F.col("o_custkey") % 12).cast("string")))
    events = orders.select("run_id", F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("score"))
    runs = orders.groupBy("run_id").agg(F.max("o_orderkey").alias("created_ms"), F.lit("S0").alias("symbol"))
    R.write_run_results(runs, events, path)
    # A second write of one run replaces that run only.
    again = orders.where("run_id = 'run3'")
    R.write_run_results(again.groupBy("run_id").agg(F.lit(10**9).cast("long").alias("created_ms"), F.lit("S1").alias("symbol")), events.where("run_id = 'run3' AND event_id % 2 = 0"), path)
    return path


@query("write_run_results", """
SELECT 'run' || (o_custkey % 12) AS run_id, count(*) AS events FROM orders WHERE o_custkey % 12 <> 3 OR o_orderkey % 2 = 0 GROUP BY ALL""")
def write_run_results(spark, sf):
    path = run_store(spark, sf)
    return spark.read.parquet(f"{path}/events").groupBy("run_id").agg(F.count(F.lit(1)).alias("events"))


@query("list_runs", """
SELECT 'run' || (o_custkey % 12) AS run_id, CASE WHEN o_custkey % 12 = 3 THEN 1000000000 ELSE max(o_orderkey) END AS created_ms FROM orders GROUP BY o_custkey % 12""")
def list_runs(spark, sf):
    return R.list_runs(spark, run_store(spark, sf))


CURVE_SQL = {
    "ts_ms": "ts_ms", "symbol": "portfolio", "state": "CASE WHEN equity >= 1.0 THEN 'NORMAL' ELSE 'CONSERVATIVE' END", "risk_state": "CASE WHEN equity < 0.9 THEN 'HALT' ELSE 'OPEN' END",
    "signal_direction": "CASE WHEN ts_ms % 2 = 0 THEN 'LONG' ELSE 'SHORT' END", "signal_size_pct": "round((ts_ms % 21) / 1e2, 2)", "position": "CASE WHEN ts_ms % 3 = 0 THEN 'FLAT' ELSE 'OPEN' END",
    "position_size_pct": "round((ts_ms % 11) / 1e2, 2)", "anomaly_score": "round((ts_ms % 101) / 1e2, 2)", "gross_pnl": "round(equity - 1e0, 8)", "net_pnl": "round(equity - 1.001e0, 8)",
    "equity_gross": "round(equity + 0.001e0, 8)", "equity_net": "round(equity, 8)"}
MS = "unix_millis(cast(l_shipdate AS timestamp))"
LEDGER_SQL = {
    "trade_id": "l_orderkey", "client_order_id": "concat('C', l_orderkey, '-', l_linenumber)", "signal_ts": MS, "submit_ts": f"{MS} + 5", "ack_ts": f"{MS} + 10 + l_linenumber", "first_fill_ts": f"{MS} + 20",
    "last_fill_ts": f"{MS} + 20 + l_linenumber", "fill_price": "round(l_extendedprice, 2)", "fill_fraction": "round(l_quantity / 5e1, 2)", "side": "l_returnflag", "size_pct": "round(l_discount, 2)", "fee": "round(l_tax, 2)",
    "slippage_pct": "round(l_discount / 1e1, 3)", "final_state": "l_linestatus", "exit_reason": "CASE WHEN l_linenumber % 2 = 0 THEN 'signal' ELSE 'stop' END", "net_pnl": "cast(floor(l_extendedprice * l_discount) AS bigint)"}


def columns_sql(cells):
    return ", ".join(f"{sql} AS {name}" for name, sql in cells.items())


def read_back(spark, path, written):
    """The rows of a written table in the types they had."""
    back = spark.read.option("header", True).csv(path)
    return back.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in written.schema.fields])


@query("write_equity_curve", f"WITH {EQUITY_SQL} SELECT {columns_sql(CURVE_SQL)} FROM eq")
def write_equity_curve(spark, sf):
    path = scratch(spark)
    rows = equity(spark, sf).selectExpr(*[f"{sql} AS {name}" for name, sql in CURVE_SQL.items()])
    R.write_equity_curve(rows, path)
    return read_back(spark, path, rows)


@query("write_trade_ledger", f"SELECT {columns_sql(LEDGER_SQL)} FROM lineitem".replace(MS, "epoch_us(l_shipdate) // 1000"))
def write_trade_ledger(spark, sf):
    path = scratch(spark)
    rows = table(spark, sf, "lineitem").selectExpr(*[f"{sql} AS {name}" for name, sql in LEDGER_SQL.items()])
    R.write_trade_ledger(rows, path)
    return read_back(spark, path, rows)


# ------------------------------------------------------------------------------------------------ venue feeds

OUT = "tick_id, symbol_out AS symbol, round(bid, 6) AS bid, round(ask, 6) AS ask, round(last_price, 6) AS last_price, round(volume_24h, 4) AS volume_24h"


def raw(spark, sf, venue, build):
    t = ticks(spark, sf).where(F.col("exchange_id") == venue)
    six = {c: F.format_string("%.8f", F.col(c)) for c in ("bid", "ask", "last_price", "volume_24h")}
    return t.select("tick_id", F.col("ts_ms").alias("received_ts_ms"), build(six).alias("raw"))


def feed(df):
    return df.select("tick_id", "symbol", *[r(F.col(c), 6).alias(c) for c in ("bid", "ask", "last_price")], r(F.col("volume_24h"), 4).alias("volume_24h"),
                     "exchange_ts_ms", "received_ts_ms", "timestamp_source", "sequence_id")


def feed_sql(venue, symbol, ts="exchange_ts_ms", source="exchange", seq="CAST(NULL AS BIGINT)", where="true"):
    return with_ticks(f"""SELECT {OUT}, {ts} AS exchange_ts_ms, ts_ms AS received_ts_ms, '{source}' AS timestamp_source, {seq} AS sequence_id
FROM (SELECT *, {symbol} AS symbol_out FROM ticks WHERE exchange_id = '{venue}' AND {where})""")


@query("normalize_binance", feed_sql("binance", "symbol || '-USDT'", where="k % 13 <> 0"))
def normalize_binance(spark, sf):
    def build(n):
        body = F.struct(n["bid"].alias("b"), n["ask"].alias("a"), n["last_price"].alias("c"), F.when(F.col("k") % 13 != 0, n["volume_24h"]).alias("v"),
                        F.col("exchange_ts_ms").alias("E"), F.concat(F.lower("symbol"), F.lit("usdt")).alias("s"))
        return F.when(F.col("k") % 2 == 0, F.to_json(body)).otherwise(F.to_json(F.struct(F.lit("x@ticker").alias("stream"), body.alias("data"))))
    return feed(M.normalize_binance(raw(spark, sf, "binance", build)))


@query("normalize_coinbase", feed_sql("coinbase", "symbol || '-USD'", seq="sequence_id", where="k % 7 <> 0"))
def normalize_coinbase(spark, sf):
    def build(n):
        iso = F.concat(F.date_format(F.timestamp_millis("exchange_ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
        return F.to_json(F.struct(
            F.when(F.col("k") % 7 == 0, "heartbeat").otherwise("ticker").alias("type"), F.concat(F.lower("symbol"), F.lit("-usd")).alias("product_id"), n["bid"].alias("best_bid"),
            n["ask"].alias("best_ask"), n["last_price"].alias("price"), n["volume_24h"].alias("volume_24h"), iso.alias("time"), F.col("sequence_id").alias("sequence")))
    return feed(M.normalize_coinbase(raw(spark, sf, "coinbase", build)))


@query("normalize_kraken", feed_sql("kraken", "'BTC-' || symbol", ts="ts_ms", source="receive", where="k % 11 <> 0"))
def normalize_kraken(spark, sf):
    def build(n):
        q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
        volume = F.when(F.col("k") % 2 == 0, F.concat(F.lit('["1",'), q(n["volume_24h"]), F.lit("]"))).otherwise(F.concat(F.lit("["), q(n["volume_24h"]), F.lit("]")))
        body = F.concat(F.lit('[340,{"a":['), q(n["ask"]), F.lit(',1],"b":['), q(n["bid"]), F.lit(',1],"c":['), q(n["last_price"]), F.lit('],"v":'), volume, F.lit('},"ticker","XBT/'), F.col("symbol"), F.lit('"]'))
        return F.when(F.col("k") % 11 == 0, F.lit('{"event":"heartbeat"}')).otherwise(body)
    return feed(M.normalize_kraken(raw(spark, sf, "kraken", build)))


@query("normalize_okx", feed_sql("okx", "symbol || '-USDT'", where="k % 9 <> 0"))
def normalize_okx(spark, sf):
    def build(n):
        row = F.struct(n["last_price"].alias("last"), F.when(F.col("k") % 9 == 0, F.lit("")).otherwise(n["bid"]).alias("bidPx"), n["ask"].alias("askPx"),
                       F.col("exchange_ts_ms").cast("string").alias("ts"), F.when(F.col("k") % 2 == 0, n["volume_24h"]).alias("vol24h"), n["volume_24h"].alias("volCcy24h"))
        arg = F.struct(F.lit("tickers").alias("channel"), F.concat("symbol", F.lit("-usdt")).alias("instId"))
        return F.to_json(F.struct(arg.alias("arg"), F.array(row).alias("data")))
    return feed(M.normalize_okx(raw(spark, sf, "okx", build)))


@query("normalize_bybit", feed_sql("bybit", "symbol || '-USDT'", where="k % 8 <> 0"))
def normalize_bybit(spark, sf):
    def build(n):
        row = F.struct(F.concat("symbol", F.lit("USDT")).alias("symbol"), n["last_price"].alias("lastPrice"), n["bid"].alias("bid1Price"), n["ask"].alias("ask1Price"),
                       F.when(F.col("k") % 3 == 0, n["volume_24h"]).alias("turnover24h"), n["volume_24h"].alias("volume24h"))
        topic = F.when(F.col("k") % 8 == 0, F.lit("orderbook.")).otherwise(F.lit("tickers."))
        one = F.to_json(F.struct(F.concat(topic, F.col("symbol")).alias("topic"), F.col("exchange_ts_ms").alias("ts"), row.alias("data")))
        many = F.to_json(F.struct(F.concat(topic, F.col("symbol")).alias("topic"), F.col("exchange_ts_ms").alias("ts"), F.array(row).alias("data")))
        return F.when(F.col("k") % 2 == 0, one).otherwise(many)
    return feed(M.normalize_bybit(raw(spark, sf, "bybit", build)))


@query("merge_deltas", with_ticks("""
SELECT * FROM (SELECT tick_id, exchange_id, last_value(CASE WHEN k % 2 = 0 THEN round(last_price, 6) END IGNORE NULLS) OVER w AS last, last_value(CASE WHEN k % 3 = 0 THEN round(bid, 6) END IGNORE NULLS) OVER w AS bid,
  last_value(CASE WHEN k % 5 = 0 THEN round(ask, 6) END IGNORE NULLS) OVER w AS ask, last_value(CASE WHEN k % 4 = 0 THEN volume_24h END IGNORE NULLS) OVER w AS volume, exchange_ts_ms
  FROM ticks WINDOW w AS (PARTITION BY symbol, exchange_id ORDER BY ts_ms, tick_id)) WHERE last IS NOT NULL AND bid IS NOT NULL AND ask IS NOT NULL"""))
def merge_deltas(spark, sf):
    k = F.col("k")
    updates = ticks(spark, sf).select(
        "symbol", "exchange_id", "ts_ms", "tick_id", F.when(k % 2 == 0, r(F.col("last_price"), 6)).alias("last"), F.when(k % 3 == 0, r(F.col("bid"), 6)).alias("bid"),
        F.when(k % 5 == 0, r(F.col("ask"), 6)).alias("ask"), F.when(k % 4 == 0, F.col("volume_24h")).alias("volume"), "exchange_ts_ms")
    return M.merge_deltas(updates, VENUE_LAYOUT).select("tick_id", "exchange_id", "last", "bid", "ask", "volume", "exchange_ts_ms")


@query("stamp_tls_health", with_ticks("""
SELECT t.tick_id, coalesce(v.healthy, false) AS tls_ok FROM ticks t ASOF LEFT JOIN (SELECT exchange_id, ts_ms, k % 5 <> 0 AS healthy FROM ticks WHERE tick_id % 25 = 3 AND exchange_id <> 'okx') v
  ON v.exchange_id = t.exchange_id AND t.ts_ms >= v.ts_ms"""))
def stamp_tls_health(spark, sf):
    t = ticks(spark, sf)
    verdicts = t.where("tick_id % 25 = 3 AND exchange_id <> 'okx'").select("exchange_id", "ts_ms", (F.col("k") % 5 != 0).alias("healthy"))
    return M.stamp_tls_health(t, verdicts, Layout(keys=("exchange_id",), slot_ms=SLOT_MS)).select("tick_id", "tls_ok")
