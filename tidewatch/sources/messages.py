"""Venue messages (JSON text) to ticks: one projection per venue, rejected rows dropped by predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalar import dashed_symbol, from_kraken_pair
from tidewatch.plans.asof import asof_join
from tidewatch.plans.layout import Layout
from tidewatch.plans.scans import Scan, running

RAW = "raw"
RECEIVED = "received_ts_ms"
FIELDS = ("exchange_id", "symbol", "bid", "ask", "last_price", "volume_24h", "exchange_ts_ms", "received_ts_ms", "timestamp_source", "sequence_id")


def _json(path: str, source: Column | str = RAW) -> Column:
    return F.get_json_object(F.col(source) if isinstance(source, str) else source, path)


def _parsed(df: DataFrame, schema: str) -> DataFrame:
    """Parse each message once; fields of any JSON type arrive as text.

    The one-element explode keeps the optimizer from pushing the checks below the parse, which would parse per check.
    """
    return df.withColumn("_m", F.explode(F.array(F.from_json(RAW, schema))))


def _number(text: Column) -> Column:
    return text.try_cast("double")


def _filled(text: Column) -> Column:
    """Null where a field is missing or empty."""
    return F.nullif(text, F.lit(""))


def _tick(
    df: DataFrame, venue: str, keep: Column, symbol: Column, bid: Column, ask: Column, last: Column, volume: Column, ts: Column,
    *, source: str = "exchange", sequence: Column | None = None,
) -> DataFrame:
    extra = [c for c in df.columns if c not in (RAW, RECEIVED, "_m", "_d")]
    return df.where(F.coalesce(keep, F.lit(False))).select(
        *extra, F.lit(venue).alias("exchange_id"), symbol.alias("symbol"), _number(bid).alias("bid"), _number(ask).alias("ask"),
        _number(last).alias("last_price"), _number(volume).alias("volume_24h"), ts.try_cast("long").alias("exchange_ts_ms"),
        F.col(RECEIVED), F.lit(source).alias("timestamp_source"),
        (F.lit(None) if sequence is None else sequence).cast("long").alias("sequence_id"),
    )


def normalize_binance(df: DataFrame) -> DataFrame:
    """Single or combined stream; all six fields are required."""
    fields = "b string, a string, c string, v string, E string, s string"
    df = _parsed(df, f"{fields}, data struct<{fields.replace(' string', ': string')}>")
    wrapped = F.col("_m.data").isNotNull()
    f = {k: F.when(wrapped, F.col(f"_m.data.{k}")).otherwise(F.col(f"_m.{k}")) for k in ("b", "a", "c", "v", "E", "s")}
    keep = F.lit(True)
    for col in f.values():
        keep = keep & col.isNotNull()
    return _tick(df, "binance", keep, dashed_symbol(f["s"]), f["b"], f["a"], f["c"], f["v"], f["E"])


def normalize_coinbase(df: DataFrame) -> DataFrame:
    """Ticker messages with ISO times; the only venue with a sequence."""
    names = ("product_id", "best_bid", "best_ask", "price", "volume_24h", "time")
    df = _parsed(df, ", ".join(f"{n} string" for n in (*names, "type", "sequence")))
    f = {k: F.col(f"_m.{k}") for k in names}
    keep = F.col("_m.type") == "ticker"
    for col in f.values():
        keep = keep & col.isNotNull()
    ts = F.unix_millis(F.try_to_timestamp(f["time"]))
    return _tick(df, "coinbase", keep, F.upper(f["product_id"]), f["best_bid"], f["best_ask"], f["price"], f["volume_24h"], ts, sequence=F.col("_m.sequence"))


def normalize_kraken(df: DataFrame) -> DataFrame:
    """Positional arrays ``[id, data, "ticker", pair]``; without a venue time the receive time stands in."""
    bid, ask, last = _json("$[1].b[0]"), _json("$[1].a[0]"), _json("$[1].c[0]")
    volume = F.coalesce(_json("$[1].v[1]"), _json("$[1].v[0]"))
    keep = (_json("$[2]") == "ticker") & _json("$[3]").isNotNull() & bid.isNotNull() & ask.isNotNull() & last.isNotNull() & volume.isNotNull()
    return _tick(df, "kraken", keep, from_kraken_pair(_json("$[3]")), bid, ask, last, volume, F.col(RECEIVED), source="receive")


def normalize_okx(df: DataFrame) -> DataFrame:
    """First row of a tickers push; control events drop out."""
    names = ("last", "bidPx", "askPx", "ts", "instId", "vol24h", "volCcy24h")
    row = ", ".join(f"{n}: string" for n in names)
    df = _parsed(df, f"event string, arg struct<channel: string, instId: string>, data array<struct<{row}>>")
    first = F.get("_m.data", F.lit(0))
    f = {n: _filled(first[n]) for n in names}
    symbol = F.upper(F.coalesce(f["instId"], _filled(F.col("_m.arg.instId"))))
    event = F.coalesce(F.col("_m.event"), F.lit(""))
    keep = ~event.isin("subscribe", "pong") & (F.col("_m.arg.channel") == "tickers")
    for col in (f["last"], f["bidPx"], f["askPx"], f["ts"], symbol):
        keep = keep & col.isNotNull()
    volume = F.coalesce(f["vol24h"], f["volCcy24h"], F.lit("0"))
    return _tick(df, "okx", keep, symbol, f["bidPx"], f["askPx"], f["last"], volume, f["ts"])


def normalize_bybit(df: DataFrame) -> DataFrame:
    """Data is an object or a list whose first element counts."""
    names = ("lastPrice", "bid1Price", "ask1Price", "symbol", "turnover24h", "volume24h")
    row = "struct<" + ", ".join(f"{n}: string" for n in names) + ">"
    df = _parsed(df, "topic string, ts string, data string")
    body = F.col("_m.data")
    df = df.withColumn("_d", F.when(F.startswith(body, F.lit("[")), F.get(F.from_json(body, f"array<{row}>"), F.lit(0))).otherwise(F.from_json(body, row)))
    f = {n: _filled(F.col(f"_d.{n}")) for n in names}
    keep = F.startswith(F.col("_m.topic"), F.lit("tickers."))
    for col in (f["lastPrice"], f["bid1Price"], f["ask1Price"], F.col("_m.ts"), f["symbol"]):
        keep = keep & col.isNotNull()
    volume = F.coalesce(f["turnover24h"], f["volume24h"], F.lit("0"))
    return _tick(df, "bybit", keep, dashed_symbol(f["symbol"]), f["bid1Price"], f["ask1Price"], f["lastPrice"], volume, F.col("_m.ts"))


def merge_deltas(updates: DataFrame, layout: Layout, fields: tuple[str, ...] = ("last", "bid", "ask", "volume", "exchange_ts_ms"), required: tuple[str, ...] = ("last", "bid", "ask", "exchange_ts_ms")) -> DataFrame:
    """Carry the last non-empty value of every field forward; rows before all required fields are known drop out."""
    known = {f"_m_{f}": Scan("last", F.nullif(F.col(f).cast("string"), F.lit(""))) for f in fields}
    out = running(updates, layout, **known)
    for f in fields:
        out = out.withColumn(f, F.col(f"_m_{f}").cast(updates.schema[f].dataType))
    for f in required:
        out = out.where(F.col(f"_m_{f}").isNotNull())
    return out.drop(*known)


def stamp_tls_health(ticks: DataFrame, verdicts: DataFrame, layout: Layout = Layout(keys=("exchange_id",))) -> DataFrame:
    """Each tick takes its venue's latest health verdict; unknown counts as unhealthy."""
    out = asof_join(ticks.drop("tls_ok"), verdicts, layout, {"tls_ok": "healthy"})
    return out.withColumn("tls_ok", F.coalesce("tls_ok", F.lit(False)))


# ------------------------------------------------------------------------------------------------- validation


def dead_letter_split(messages: DataFrame, schema: str, required: tuple[str, ...], column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Typed good rows, and rejected rows with reason ``malformed`` or ``schema_error``."""
    parsed = messages.withColumn("_r", F.from_json(F.col(column), f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"}))
    is_json = F.get_json_object(F.col(column), "$").isNotNull()
    complete = F.lit(True)
    for name in required:
        complete = complete & F.col(f"_r.{name}").isNotNull()
    good = is_json & F.col("_r._corrupt_record").isNull() & complete
    marked = parsed.withColumn("_good", F.coalesce(good, F.lit(False)))
    rest = [c for c in messages.columns if c != column]
    typed = marked.where("_good").select(*rest, "_r.*").drop("_corrupt_record")
    rejected = marked.where("NOT _good").select(*rest, column, F.when(is_json, "schema_error").otherwise("malformed").alias("reason"))
    return typed, rejected


def schema_version_check(model: Column, version: Column, expected: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in expected.items() for x in pair])
    want = F.try_element_at(table, model)
    return (
        F.when(want.isNull(), F.concat(F.lit("unknown_model_"), model))
        .when(want == version, "ok")
        .otherwise(F.concat(F.lit("version_mismatch_"), model, F.lit("_expected_"), want, F.lit("_got_"), F.coalesce(version, F.lit("None"))))
    )
