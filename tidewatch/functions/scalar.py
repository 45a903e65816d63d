"""Column expressions: prices, times, identifiers, canonical text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip01(x: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(x)))


def mid_price(bid: Column | str = "bid", ask: Column | str = "ask") -> Column:
    return (_c(bid) + _c(ask)) / 2.0


def relative_spread(bid: Column | str = "bid", ask: Column | str = "ask") -> Column:
    """Spread over mid, never negative; null where the mid is not positive."""
    mid = mid_price(bid, ask)
    return F.when(mid > 0, F.greatest(F.lit(0.0), (_c(ask) - _c(bid)) / mid))


def tick_latency(
    window_end: Column | str,
    exchange_ts: Column | str = "exchange_ts_ms",
    received_ts: Column | str = "ts_ms",
    source: Column | str = "timestamp_source",
) -> Column:
    """Age of a quote at the window end, by the venue's clock where the venue stamps its quotes."""
    stamp = F.when(_c(source) == "exchange", _c(exchange_ts)).otherwise(_c(received_ts))
    return F.greatest(F.lit(0), _c(window_end) - stamp).cast("double")


def log_return(price: Column | str, previous: Column | str) -> Column:
    p, q = _c(price), _c(previous)
    return F.when((p > 0) & (q > 0), F.log(p / q)).otherwise(F.lit(0.0))


def price_jump_bps(price: Column | str, previous: Column | str) -> Column:
    p, q = _c(price), _c(previous)
    return F.when(q > 0, (p - q) / q * 10_000.0).otherwise(F.lit(0.0))


def spread_bps(spread: Column | str, mid: Column | str, unit: str = "relative") -> Column:
    """Spread in basis points of the mid.

    ``relative`` divides by the price, as done for a price spread; ``price`` takes a spread already relative to it.
    """
    s = F.coalesce(_c(spread), F.lit(0.0))
    value = s / _c(mid) if unit == "relative" else s
    return F.when(_c(mid) > 0, value * 10_000.0).otherwise(F.lit(0.0))


def epoch_ms(value: Column | str) -> Column:
    """Integer epoch of unknown unit to milliseconds: nanoseconds from 1e17, microseconds from 1e14."""
    v = _c(value).cast("long")
    return (
        F.when(v >= 10**17, F.floor(v / F.lit(10**6)))
        .when(v >= 10**14, F.floor(v / F.lit(1000)))
        .otherwise(v)
        .cast("long")
    )


def time_of_day(ts_ms: Column | str) -> tuple[Column, Column]:
    """Sine and cosine of the time of day."""
    angle = F.pmod(F.floor(_c(ts_ms) / F.lit(1000)), F.lit(86_400)) / F.lit(86_400.0) * F.lit(2.0) * F.pi()
    return F.sin(angle), F.cos(angle)


def venue_price_check(prices: Column | str, venue: Column | str) -> Column:
    """``ok`` or the first reason why a venue price map cannot be used."""
    m, v = _c(prices), _c(venue)
    return (
        F.when(m.isNull() | (F.size(m) == 0), "execution_venue_prices_empty")
        .when(~F.map_contains_key(m, v), F.concat(F.lit("execution_venue_"), v, F.lit("_not_in_prices")))
        .when(F.exists(F.map_values(m), lambda p: p <= 0), "execution_venue_prices_invalid")
        .otherwise("ok")
    )


def micros(x: Column | str) -> Column:
    """A double as an integer number of millionths: text of it is the same on every engine."""
    return F.round(_c(x) * 1e6, 0).cast("long")


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys, nulls left out. Pass doubles through :func:`micros`."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "true"})


def client_order_id(symbol: Column, direction: Column, size_pct: Column, ts_ms: Column, session: str) -> Column:
    text = F.concat_ws(
        "|", symbol, direction, F.format_string("%.8f", size_pct), ts_ms.cast("long").cast("string"), F.lit(session)
    )
    return F.sha2(text, 256)


def hash_jitter(text: Column, jitter: float = 25.0) -> Column:
    """A value in ``[-jitter, jitter]`` that depends on ``text`` only."""
    unit = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF))
    return (unit * 2.0 - 1.0) * F.lit(jitter)


def source_layer(source: Column | str) -> Column:
    """Layer number named in a source, 6 where there is none."""
    digit = F.regexp_extract(_c(source), r"layer(\d)", 1)
    return F.when(digit != "", digit.cast("int")).otherwise(F.lit(6))


def dashed_symbol(raw: Column | str) -> Column:
    """``BTCUSDT`` to ``BTC-USDT``; other quotes stay as they are."""
    s = F.upper(_c(raw))
    return F.when(s.endswith("USDT") & ~F.contains(s, F.lit("-")), F.regexp_replace(s, "USDT$", "-USDT")).otherwise(s)


def compact_symbol(symbol: Column | str) -> Column:
    """``BTC-USDT`` to ``BTCUSDT``."""
    return F.regexp_replace(F.upper(_c(symbol)), "-", "")


def kraken_pair(symbol: Column | str) -> Column:
    """``BTC-USDT`` to ``XBT/USDT``."""
    return F.regexp_replace(F.regexp_replace(F.upper(_c(symbol)), "BTC", "XBT"), "-", "/")


def from_kraken_pair(pair: Column | str) -> Column:
    """``XBT/USDT`` to ``BTC-USDT``."""
    return F.regexp_replace(F.regexp_replace(F.upper(_c(pair)), "XBT", "BTC"), "/", "-")
