"""The tick view of the ``events`` table, in Spark and in SQL, and shared readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.plans.layout import Layout

DAY_MS = 86_400_000
HOUR_MS = 3_600_000

# At 10^12 ticks in 30 days the busiest symbol has about a million of them in ten seconds, one sort of one task, while its slots
# stay a few hundred thousand summary rows. Folds and chunks are small enough to be split in the sample.
SLOT_MS = 10_000
LAYOUT = Layout(slot_ms=SLOT_MS, chunk_rows=6_000, fold_rows=2_000)
VENUE_LAYOUT = LAYOUT.with_(keys=("symbol", "exchange_id"))

# Which venue each event type stands for.
VENUE_OF_EVENT = {"click": "binance", "view": "bybit", "purchase": "coinbase", "signup": "kraken", "error": "okx"}
VENUES = sorted(VENUE_OF_EVENT.values())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ticks(events: DataFrame) -> DataFrame:
    """Project events (batch or stream) onto the tick schema."""
    venue = F.create_map(*[F.lit(x) for pair in VENUE_OF_EVENT.items() for x in pair])
    # Two steps, so that the JSON field is parsed once per row and not once per use.
    base = events.select(
        F.col("event_id").alias("tick_id"),
        F.try_element_at(venue, F.col("event_type")).alias("exchange_id"),
        F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("symbol"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.lit(100.0) + F.col("value") / F.lit(500.0)).alias("mid"),
    )
    k, mid, ts = F.col("k"), F.col("mid"), F.col("ts_ms")
    half = (F.lit(0.01) + k / F.lit(10000.0)) / F.lit(2.0)
    receive = F.col("exchange_id") == "kraken"
    return base.select(
        *base.columns,
        (mid - half).alias("bid"),
        (mid + half).alias("ask"),
        mid.alias("last_price"),
        (F.lit(1.0) + k).alias("volume_24h"),
        F.when(receive, ts).otherwise(ts - 10 * k).alias("exchange_ts_ms"),
        F.when(receive, "receive").otherwise("exchange").alias("timestamp_source"),
        F.when(F.col("exchange_id") == "coinbase", F.floor(F.col("tick_id") / 5)).cast("long").alias("sequence_id"),
        (k % 20 != 0).alias("tls_ok"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_ticks(table(spark, sf_dir, "events"))


TICKS_SQL = """ticks AS (
  SELECT tick_id, exchange_id, symbol, ts_ms, k, mid, mid - half AS bid, mid + half AS ask, mid AS last_price,
         1.0::DOUBLE + k AS volume_24h,
         CASE WHEN event_type = 'signup' THEN ts_ms ELSE ts_ms - 10 * k END AS exchange_ts_ms,
         CASE WHEN event_type = 'signup' THEN 'receive' ELSE 'exchange' END AS timestamp_source,
         CASE WHEN event_type = 'purchase' THEN tick_id // 5 END AS sequence_id,
         k % 20 <> 0 AS tls_ok
  FROM (SELECT event_id AS tick_id, event_type, 'S' || (user_id % 4) AS symbol,
               CASE event_type WHEN 'click' THEN 'binance' WHEN 'view' THEN 'bybit' WHEN 'purchase' THEN 'coinbase'
                               WHEN 'signup' THEN 'kraken' WHEN 'error' THEN 'okx' END AS exchange_id,
               epoch_us(ts) // 1000 AS ts_ms, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
               100.0::DOUBLE + value / 500.0::DOUBLE AS mid,
               (0.01::DOUBLE + CAST(json_extract_string(props, '$.k') AS INTEGER) / 10000.0::DOUBLE) / 2.0::DOUBLE AS half
        FROM events))"""


def with_ticks(body: str, *ctes: str) -> str:
    """``WITH ticks, <ctes> <body>``."""
    return "WITH RECURSIVE " + ",\n".join([TICKS_SQL, *ctes]) + "\n" + body


def as_union(rows: list[tuple], names: list[str]) -> str:
    """A small constant relation as SQL."""
    def lit(x):
        if x is None:
            return "NULL"
        return f"'{x}'" if isinstance(x, str) else repr(x)
    return "(VALUES " + ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows) + f") AS t({', '.join(names)})"


VENUES_SQL = "venues AS (SELECT * FROM " + as_union([(v,) for v in VENUES], ["exchange_id"]) + ")"
