"""Execution queries over ``orders`` and ``lineitem`` read as an order ledger."""

from pyspark.sql import functions as F

from tidewatch.operators import execution as X
from tidewatch.workload.registry import query
from tidewatch.workload.scalars import r
from tidewatch.workload.ticks import table

LEDGER_SQL = """ledger AS (
  SELECT l_orderkey, l_linenumber, 'S' || (l_suppkey % 4) AS symbol, ['binance', 'bybit', 'coinbase', 'kraken', 'okx'][l_partkey % 5 + 1] AS exchange_id,
    CASE WHEN l_returnflag = 'R' THEN 'SHORT' WHEN l_partkey % 13 = 0 THEN 'CLOSE_ALL' ELSE 'LONG' END AS direction, l_quantity / 60.0::DOUBLE AS size_pct,
    l_extendedprice / 100.0::DOUBLE AS price, epoch_us(l_shipdate) // 1000 AS ts_ms, l_tax, l_discount, l_linestatus, l_partkey, l_suppkey FROM lineitem)"""
FEES = [("binance", 0.001), ("kraken", 0.0026)]
COST_SQL = f"""{LEDGER_SQL},
costs AS (
  SELECT *, CASE WHEN size_pct > 0.5 THEN 0.5 ELSE size_pct END AS filled_pct, price * (1 + CASE direction WHEN 'LONG' THEN 0.0005::DOUBLE ELSE -0.0005::DOUBLE END) AS fill_price,
    CASE direction WHEN 'LONG' THEN 0.0005::DOUBLE ELSE -0.0005::DOUBLE END AS slippage_pct, CASE WHEN size_pct > 0.5 THEN 'partial' ELSE 'full' END AS fill_note,
    CASE WHEN size_pct > 0.5 THEN 0.5 ELSE size_pct END * 1000.0 * CASE exchange_id WHEN 'binance' THEN 0.001 WHEN 'kraken' THEN 0.0026 ELSE 0.00075 END AS fee_paid FROM ledger)"""
IDS = ("l_orderkey", "l_linenumber")
VENUE_NAMES = ("binance", "bybit", "coinbase", "kraken", "okx")


def ledger(spark, sf):
    part = F.col("l_partkey")
    return table(spark, sf, "lineitem").select(
        *IDS, F.concat(F.lit("S"), (F.col("l_suppkey") % 4).cast("string")).alias("symbol"),
        F.element_at(F.array(*[F.lit(v) for v in VENUE_NAMES]), (part % 5 + 1).cast("int")).alias("exchange_id"),
        F.when(F.col("l_returnflag") == "R", "SHORT").when(part % 13 == 0, "CLOSE_ALL").otherwise("LONG").alias("direction"),
        (F.col("l_quantity") / 60.0).alias("size_pct"), (F.col("l_extendedprice") / 100.0).alias("reference_price"),
        F.lit(1000.0).alias("portfolio_value"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts_ms"),
        "l_tax", "l_discount", "l_linestatus", "l_partkey", "l_suppkey")


def fills(spark, sf):
    return X.fill_cost(ledger(spark, sf), spark.createDataFrame(FEES, "exchange_id string, fee double"))


@query("fill_cost", f"""WITH {COST_SQL}
SELECT l_orderkey, l_linenumber, round(filled_pct, 8) AS filled_pct, round(fill_price, 9) AS fill_price, round(slippage_pct, 8) AS slippage_pct, round(fee_paid, 6) AS fee_paid, fill_note FROM costs""")
def fill_cost(spark, sf):
    return fills(spark, sf).select(*IDS, r(F.col("filled_pct")).alias("filled_pct"), r(F.col("fill_price"), 9).alias("fill_price"),
                                   r(F.col("slippage_pct")).alias("slippage_pct"), r(F.col("fee_paid"), 6).alias("fee_paid"), "fill_note")


DIV_SQL = f"""{LEDGER_SQL},
div AS (SELECT *, CASE WHEN l_partkey % 7 = 0 THEN 'no_venue_prices_available' WHEN exchange_id = 'okx' THEN 'execution_venue_okx_not_in_consensus'
    WHEN bps > 50 THEN printf('divergence_%.1fbps_exceeds_max_50.0bps', bps) ELSE 'acceptable' END AS reason,
  CASE WHEN l_partkey % 7 = 0 THEN 0.0 WHEN exchange_id <> 'okx' THEN bps END AS divergence_bps
  FROM (SELECT *, abs(price * (1 + (l_suppkey % 9) / 1000.0::DOUBLE) - price) / price * 10000 AS bps FROM ledger))"""


def checked(spark, sf):
    own = F.col("reference_price") * (1.0 + (F.col("l_suppkey") % 9) / 1000.0)
    prices = F.when(F.col("l_partkey") % 7 != 0, F.when(F.col("exchange_id") != "okx", F.create_map("exchange_id", own)).otherwise(
        F.create_map(F.lit("binance"), F.col("reference_price"))))
    rows = ledger(spark, sf).withColumn("execution_venue_prices", prices).withColumn("consensus_price", F.col("reference_price"))
    return X.venue_divergence(rows)


@query("venue_divergence", f"""WITH {DIV_SQL}
SELECT l_orderkey, l_linenumber, reason LIKE 'no_venue%' OR reason = 'acceptable' AS acceptable, regexp_replace(reason, '_[0-9.]+bps_', '_') AS reason, round(divergence_bps, 5) AS divergence_bps FROM div""")
def venue_divergence(spark, sf):
    return checked(spark, sf).select(*IDS, "acceptable", F.regexp_replace("divergence_reason", "_[0-9.]+bps_", "_").alias("reason"),
                                     r(F.col("divergence_bps"), 5).alias("divergence_bps"))


@query("divergence_profile", f"""WITH {DIV_SQL}
SELECT symbol, exchange_id, le, count(*) FILTER (NOT (reason LIKE 'no_venue%' OR reason = 'acceptable')) AS rejected, count(*) FILTER (round(divergence_bps, 5) <= le) AS n
FROM div, (VALUES (5.5::DOUBLE), (15.5), (25.5), (35.5), (55.5), (75.5)) b(le) GROUP BY ALL""")
def divergence_profile(spark, sf):
    return X.divergence_profile(checked(spark, sf), bounds=(5.5, 15.5, 25.5, 35.5, 55.5, 75.5))


@query("order_status", f"""WITH {LEDGER_SQL}
SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' AND l_partkey % 10 = 0 THEN 'REJECTED' WHEN l_partkey % 9 = 0 THEN 'CANCELLED' WHEN l_discount * 15 >= 1 THEN 'FILLED'
  WHEN l_discount > 0 THEN 'PARTIALLY_FILLED' ELSE 'PENDING' END AS status FROM ledger""")
def order_status(spark, sf):
    accepted = ~((F.col("l_linestatus") == "F") & (F.col("l_partkey") % 10 == 0))
    return ledger(spark, sf).select(*IDS, X.order_status(accepted, F.col("l_partkey") % 9 == 0, F.col("l_discount") * 15).alias("status"))


@query("slippage_bps", f"""WITH {LEDGER_SQL}
SELECT l_orderkey, l_linenumber, round(CASE direction WHEN 'LONG' THEN 1 ELSE -1 END * ((price + l_tax) - price) / price * 10000, 5) + 0.0 AS slippage_bps,
  round(abs(((price + l_tax) - price) / price * 10000), 5) AS abs_bps FROM ledger""")
def slippage_bps(spark, sf):
    signed, size = X.slippage_bps(F.col("direction"), F.col("reference_price") + F.col("l_tax"), F.col("reference_price"))
    return ledger(spark, sf).select(*IDS, r(signed, 5).alias("slippage_bps"), r(size, 5).alias("abs_bps"))


@query("filled_size", f"""WITH {COST_SQL} SELECT l_orderkey, l_linenumber, round(filled_pct * size_pct * 1000.0 / price, 8) AS filled_size FROM costs""")
def filled_size(spark, sf):
    size = X.filled_size(F.col("filled_pct"), F.col("size_pct"), F.col("portfolio_value"), F.col("reference_price"))
    return fills(spark, sf).select(*IDS, r(size).alias("filled_size"))


@query("execution_summary", f"""WITH {COST_SQL}
SELECT symbol, count(*) AS executed_orders, count(*) FILTER (direction = 'CLOSE_ALL') AS close_all_orders, round(avg(filled_pct), 8) AS average_fill_fraction,
  round(avg(abs(slippage_pct)), 8) AS average_slippage_pct, round(avg(fee_paid), 6) AS average_fee_paid FROM costs GROUP BY symbol""")
def execution_summary(spark, sf):
    out = X.execution_summary(fills(spark, sf))
    return out.select("symbol", "executed_orders", "close_all_orders", r(F.col("average_fill_fraction")).alias("average_fill_fraction"),
                      r(F.col("average_slippage_pct")).alias("average_slippage_pct"), r(F.col("average_fee_paid"), 6).alias("average_fee_paid"))


# An order id repeated by the lines of an order: part of them are resubmissions.
REPEAT_SQL = f"""{LEDGER_SQL},
reps AS (SELECT 'C' || (l_orderkey * 4 + l_partkey % 2) AS client_order_id, l_linenumber + 10 * l_orderkey AS row_id, ts_ms, size_pct, CASE WHEN l_linestatus = 'F' THEN 'FILLED' ELSE 'ACCEPTED' END AS status FROM ledger)"""


def repeats(spark, sf):
    return ledger(spark, sf).select(
        F.concat(F.lit("C"), (F.col("l_orderkey") * 4 + F.col("l_partkey") % 2).cast("string")).alias("client_order_id"),
        (F.col("l_linenumber") + 10 * F.col("l_orderkey")).alias("row_id"), F.col("ts_ms"), F.col("size_pct"),
        F.when(F.col("l_linestatus") == "F", "FILLED").otherwise("ACCEPTED").alias("status"))


# Lines of an order may share number and date; the order key and line number make rows unique up to that.
@query("idempotent_orders", f"""WITH {REPEAT_SQL}
SELECT client_order_id, min((ts_ms, row_id, size_pct))[1] AS ts_ms, arg_max(status, (ts_ms, row_id, size_pct)) AS status, count(*) - 1 AS duplicates,
  round(arg_min(size_pct, (ts_ms, row_id, size_pct)), 8) AS size_pct FROM reps GROUP BY client_order_id""")
def idempotent_orders(spark, sf):
    out = X.idempotent_orders(repeats(spark, sf), order=("ts_ms", "row_id", "size_pct"))
    return out.select("client_order_id", "ts_ms", "status", "duplicates", r(F.col("size_pct")).alias("size_pct"))


RECON_SQL = """pend AS (SELECT o_orderkey, epoch_us(o_orderdate) // 1000 AS ts_ms FROM orders WHERE o_orderstatus = 'P'),
seen AS (SELECT l_orderkey, arg_max(CASE WHEN l_returnflag = 'R' THEN 'DUPLICATE' WHEN l_returnflag = 'A' THEN 'FILLED' ELSE 'UNKNOWN' END, (l_shipdate, l_linenumber, l_partkey)) AS venue_status,
   max(epoch_us(l_shipdate) // 1000) AS adapter_ts_ms FROM lineitem WHERE l_quantity > 20 GROUP BY l_orderkey)"""


def pending(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("client_order_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"))


def venue_view(spark, sf):
    return table(spark, sf, "lineitem").where("l_quantity > 20").groupBy(F.col("l_orderkey").alias("client_order_id")).agg(
        F.max_by(F.when(F.col("l_returnflag") == "R", "DUPLICATE").when(F.col("l_returnflag") == "A", "FILLED").otherwise("UNKNOWN"),
                 F.struct("l_shipdate", "l_linenumber", "l_partkey")).alias("venue_status"),
        F.max(F.unix_millis(F.col("l_shipdate").cast("timestamp"))).alias("venue_ts_ms"))


@query("reconcile_orders", f"""WITH {RECON_SQL}
SELECT o_orderkey AS client_order_id, CASE venue_status WHEN 'FILLED' THEN 'confirmed' WHEN 'DUPLICATE' THEN 'duplicate' ELSE 'unresolved' END AS outcome,
  coalesce(venue_status IN ('FILLED', 'DUPLICATE'), false) AS resolved, adapter_ts_ms - ts_ms AS delta_ms FROM pend LEFT JOIN seen ON l_orderkey = o_orderkey""")
def reconcile_orders(spark, sf):
    return X.reconcile_orders(pending(spark, sf), venue_view(spark, sf)).select("client_order_id", "outcome", "resolved", "delta_ms")


@query("unresolved_orders", f"WITH {RECON_SQL} SELECT o_orderkey AS client_order_id, ts_ms FROM pend WHERE o_orderkey NOT IN (SELECT l_orderkey FROM seen)")
def unresolved_orders(spark, sf):
    return X.unresolved_orders(pending(spark, sf), venue_view(spark, sf))


@query("dead_letters", """
SELECT o_orderkey AS client_order_id, max(epoch_us(l_shipdate) // 1000) AS failed_ts_ms FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 45 GROUP BY o_orderkey""")
def dead_letters(spark, sf):
    failed = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 45").select(
        F.col("l_orderkey").alias("client_order_id"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("failed_ts_ms"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("client_order_id"))
    return X.dead_letters(orders, failed)[1].orderBy("failed_ts_ms")


@query("verify_wal_order", """
SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE epoch_us(o_orderdate) > epoch_us(l_shipdate) + 5000000""")
def verify_wal_order(spark, sf):
    recon = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        *IDS, F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("wal_ts_ms"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("adapter_ts_ms"))
    return X.verify_wal_order(recon).select(*IDS)


@query("verify_idempotency", f"""WITH {REPEAT_SQL}
SELECT client_order_id, row_id, round(size_pct, 8) AS fill_fraction, round(f, 8) AS first_fill FROM reps JOIN (SELECT client_order_id, arg_min(size_pct, (ts_ms, row_id, size_pct)) AS f FROM reps GROUP BY ALL) USING (client_order_id)
WHERE abs(size_pct - f) > 1e-6""")
def verify_idempotency(spark, sf):
    rows = repeats(spark, sf).withColumnRenamed("size_pct", "fill_fraction")
    out = X.verify_idempotency(rows, order=("ts_ms", "row_id", "fill_fraction"))
    return out.select("client_order_id", "row_id", r(F.col("fill_fraction")).alias("fill_fraction"), r(F.col("first_fill")).alias("first_fill"))


@query("verify_balance", "SELECT c_custkey, round(c_acctbal, 2) AS portfolio_value, c_acctbal > 0 AS passed FROM customer")
def verify_balance(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("portfolio_value"), (F.col("c_acctbal") > 0).alias("passed"))


@query("verify_close_all", f"WITH {LEDGER_SQL} SELECT symbol, count(*) FILTER (direction = 'CLOSE_ALL') AS close_count FROM ledger GROUP BY symbol")
def verify_close_all(spark, sf):
    return ledger(spark, sf).groupBy("symbol").agg(F.count_if(F.col("direction") == "CLOSE_ALL").alias("close_count"))


@query("verify_primary_presence", """
SELECT c_nationkey, round(missing / CAST(windows AS DOUBLE), 8) AS ratio, missing / CAST(windows AS DOUBLE) <= 0.35 AS passed FROM (
  SELECT c_nationkey, count(*) AS windows, count(*) FILTER (o_orderstatus = 'P') AS missing FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)""")
def verify_primary_presence(spark, sf):
    runs = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(F.col("o_orderstatus") == "P").alias("missing"))
    return X.primary_presence(runs, limit=0.35).select("c_nationkey", r(F.col("ratio")).alias("ratio"), "passed")
