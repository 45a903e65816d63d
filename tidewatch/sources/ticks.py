"""Reading and writing historical ticks."""

from __future__ import annotations

import csv
import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.scalar import epoch_ms

# Accepted column names of each field, first match wins.
ALIASES = {
    "timestamp": ("timestamp_utc", "timestamp", "ts", "open_time", "open_time_ms"),
    "exchange_id": ("exchange", "exchange_id", "source"),
    "symbol": ("symbol", "pair"),
    "bid": ("bid", "best_bid"),
    "ask": ("ask", "best_ask"),
    "last_price": ("last_price", "last", "close", "price"),
    "volume": ("volume", "volume_24h", "qty"),
}
COLUMNS = ("ts_ms", "exchange_id", "symbol", "bid", "ask", "last_price", "volume")


def parse_time(value: Column) -> Column:
    """Epoch digits of any unit, or an ISO time, to milliseconds."""
    text = value.cast("string")
    iso = F.unix_millis(F.try_to_timestamp(text))
    return F.when(text.rlike(r"^\d+$"), epoch_ms(text.try_cast("long"))).otherwise(iso)


def resolve(df: DataFrame) -> DataFrame:
    """Pick the first present alias of every field; a missing field is an error, raised before any row is read."""
    picked = {}
    for field, names in ALIASES.items():
        hit = next((n for n in names if n in df.columns), None)
        if hit is None:
            raise ValueError(f"no column for {field}: expected one of {', '.join(names)}")
        picked[field] = F.col(hit)
    return df.select(
        parse_time(picked["timestamp"]).alias("ts_ms"), picked["exchange_id"].cast("string").alias("exchange_id"),
        picked["symbol"].cast("string").alias("symbol"), *[picked[c].cast("double").alias(c) for c in ("bid", "ask", "last_price", "volume")],
    )


def scan_csv_ticks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return resolve(spark.read.option("header", True).csv(path))


def scan_jsonl_ticks(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """JSON lines; give a schema in production, so that no pass over the data infers it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.json(path)
    return resolve(rows)


def write_tick_cache(ticks: DataFrame, path: str) -> None:
    """Replace the cache; one folder per symbol, so that readers prune by symbol and push down the time range."""
    ticks.select(*COLUMNS).write.mode("overwrite").partitionBy("symbol").parquet(path)


def scan_cached_ticks(spark: SparkSession, path: str, *, start_ms: int, end_ms: int, symbol: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path).where(F.col("ts_ms").between(start_ms, end_ms))
    if symbol is not None:
        rows = rows.where(F.col("symbol") == symbol)
    return rows.select(*COLUMNS).orderBy("ts_ms", "exchange_id")


def union_exchange_files(spark: SparkSession, paths: list[str], *, symbol: str, start_ms: int, end_ms: int) -> DataFrame:
    """One multi-path read of per-venue files, cut to a symbol and a closed time range, in (time, venue) order."""
    rows = scan_csv_ticks(spark, paths)
    keep = (F.col("symbol") == symbol) & F.col("ts_ms").between(start_ms, end_ms)
    return rows.where(keep).orderBy("ts_ms", "exchange_id")


# ------------------------------------------------------------------------------------------------------ klines

KLINE = "open_time_ms long, open double, high double, low double, close double, volume double, close_time_ms long"
KLINE_NAMES = [field.split()[0] for field in KLINE.split(", ")]


REJECT = "path string, line long, reason string"


def _kline(row: list[str]) -> list:
    """Volume and close time may be missing; a row needs a time and four prices."""
    return [int(row[0]), *map(float, row[1:5]), float(row[5]) if len(row) > 5 else None, int(row[6]) if len(row) > 6 else None]


def _lines(path: str, content: bytes):
    """``(line, row, reason)`` of each line of an archive; a header has neither row nor reason."""
    line = 0
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for member in archive.namelist():
                for row in csv.reader(io.TextIOWrapper(archive.open(member), "utf-8")):
                    line += 1
                    if len(row) < 5:
                        yield line, None, "fewer than 5 fields"
                    elif row[0].lstrip("-").isdigit():
                        try:
                            yield line, _kline(row), None
                        except ValueError as error:
                            yield line, None, str(error)
                    elif line > 1:
                        yield line, None, "no time"
    except (zipfile.BadZipFile, UnicodeDecodeError) as error:
        yield line + 1, None, f"unreadable: {error}"


def _unzip(batches):
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            rows = pd.DataFrame([row for _, row, _ in _lines(path, content) if row is not None], columns=KLINE_NAMES)
            yield rows.astype({"close_time_ms": "Int64"})


def _rejects(batches):
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            yield pd.DataFrame([(path, line, reason) for line, row, reason in _lines(path, content) if reason], columns=["path", "line", "reason"])


def _archives(spark: SparkSession, path: str, files: str = "*.zip") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", files).load(path).select("path", "content")


def scan_kline_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The lines that ``scan_kline_archive`` leaves out, with file, line and reason."""
    return _archives(spark, path).mapInPandas(_rejects, REJECT)


def _unzip_named(batches):
    for pdf in batches:
        for path, symbol, content in zip(pdf["path"], pdf["symbol"], pdf["content"]):
            for rows in _unzip([pd.DataFrame({"path": [path], "content": [content]})]):
                yield rows.assign(symbol=symbol)


def scan_kline_archive(spark: SparkSession, path: str, *, symbol: str | None = None, files: str = "*.zip") -> DataFrame:
    """Zipped daily kline files: each archive is one task-local unzip, a few megabytes at most. Bad lines are in ``scan_kline_rejects``.

    ``symbol`` is a pattern whose first group finds the symbol in a file's path; with it the rows carry a ``symbol``. ``files`` is the pattern of file names.
    """
    archives = _archives(spark, path, files)
    if symbol is None:
        rows = archives.mapInPandas(_unzip, KLINE)
    else:
        rows = archives.withColumn("symbol", F.regexp_extract("path", symbol, 1)).mapInPandas(_unzip_named, f"{KLINE}, symbol string")
    return rows.withColumn("open_time_ms", epoch_ms("open_time_ms")).withColumn("close_time_ms", epoch_ms("close_time_ms"))


def kline_to_ticks(klines: DataFrame) -> DataFrame:
    mid, wide = (F.col("high") + F.col("low")) / 2.0, F.col("high") - F.col("low")
    return klines.select(
        *[c for c in ("symbol",) if c in klines.columns], F.col("open_time_ms").alias("ts_ms"), F.round(mid - wide / 2.0, 2).alias("bid"), F.round(mid + wide / 2.0, 2).alias("ask"),
        F.round("close", 2).alias("last_price"), F.col("volume"),
    )


def trade_to_ticks(trades: DataFrame) -> DataFrame:
    p = F.col("price")
    return trades.select("ts_ms", "symbol", p.alias("bid"), p.alias("ask"), p.alias("last_price"), F.col("quantity").alias("volume"))


def kline_rows_to_candles(rows: DataFrame, *, timeframe_ms: int, column: str = "row") -> DataFrame:
    """Positional kline rows (eight fields, a trade count may follow) to candles."""
    at = lambda i: F.get(F.col(column), F.lit(i))
    start = at(0).cast("long")
    return rows.where(F.size(column) >= 8).select(
        *[c for c in rows.columns if c != column], start.alias("start_ms"), (start + timeframe_ms).alias("end_ms"),
        *[at(i + 1).cast("double").alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"))],
        F.coalesce(at(8).cast("int"), F.lit(0)).alias("trade_count"),
    )
