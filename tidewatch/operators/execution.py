"""Execution quality over order and fill tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.plans.layout import Layout
from tidewatch.plans.scans import Scan, running


@dataclass(frozen=True)
class CostConfig:
    slippage: float = 0.0005
    fee: float = 0.00075
    partial_above: float = 0.5
    partial_ratio: float = 0.0


def fill_cost(orders: DataFrame, fees: DataFrame | None = None, cfg: CostConfig = CostConfig()) -> DataFrame:
    """Cost model of a fill: adverse slippage, venue fee on the notional, partial fills of large orders."""
    rows = orders
    fee = F.lit(cfg.fee)
    if fees is not None:
        rows = rows.join(fees.select("exchange_id", F.col("fee").alias("_fee")), "exchange_id", "left")
        fee = F.coalesce("_fee", fee)
    size = F.col("size_pct")
    cut = F.lit(cfg.partial_above)
    filled = F.when(size > cut, F.least(size, cut + (size - cut) * cfg.partial_ratio)).otherwise(size)
    side = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)
    return rows.select(
        *orders.columns, filled.alias("filled_pct"), (F.col("reference_price") * (1.0 + side * cfg.slippage)).alias("fill_price"),
        (side * cfg.slippage).alias("slippage_pct"), (F.abs(filled * F.col("portfolio_value")) * fee).alias("fee_paid"),
        F.when(size > cut, "partial").otherwise("full").alias("fill_note"),
    )


def venue_divergence(orders: DataFrame, *, max_bps: float = 50.0) -> DataFrame:
    """Compare the execution venue's price with the consensus; adds ``acceptable``, ``divergence_bps``, ``divergence_reason``."""
    prices, venue, price = F.col("execution_venue_prices"), F.col("exchange_id"), F.col("consensus_price")
    own = F.try_element_at(prices, venue)
    bps = F.abs(own - price) / price * 10_000.0
    none = prices.isNull() | (F.size(prices) == 0)
    reason = (
        F.when(none, "no_venue_prices_available")
        .when(own.isNull(), F.concat(F.lit("execution_venue_"), venue, F.lit("_not_in_consensus")))
        .when(price <= 0, "invalid_consensus_price")
        .when(bps > max_bps, F.format_string(f"divergence_%.1fbps_exceeds_max_{max_bps:.1f}bps", bps))
        .otherwise("acceptable")
    )
    return (
        orders.withColumn("divergence_reason", reason)
        .withColumn("acceptable", F.col("divergence_reason").isin("no_venue_prices_available", "acceptable"))
        .withColumn("divergence_bps", F.when(none, 0.0).when(own.isNotNull() & (price > 0), bps))
    )


def order_status(accepted: Column, cancelled: Column, filled_share: Column) -> Column:
    return (
        F.when(~accepted, "REJECTED").when(cancelled, "CANCELLED").when(filled_share >= 1, "FILLED")
        .when(filled_share > 0, "PARTIALLY_FILLED").otherwise("PENDING")
    )


def slippage_bps(direction: Column, fill: Column, entry: Column) -> tuple[Column, Column]:
    """Signed (positive is adverse) and absolute distance of the fill from the entry price."""
    move = F.when(entry > 0, (fill - entry) / entry * 10_000.0).otherwise(F.lit(0.0))
    return F.when(direction == "LONG", move).otherwise(-move), F.abs(move)


def filled_size(filled_pct: Column, size_pct: Column, portfolio: Column, price: Column) -> Column:
    return F.when(price > 0, filled_pct * size_pct * portfolio / price).otherwise(F.lit(0.0))


def execution_summary(fills: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return fills.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("executed_orders"), F.count_if(F.col("direction") == "CLOSE_ALL").alias("close_all_orders"),
        F.avg("filled_pct").alias("average_fill_fraction"), F.avg(F.abs("slippage_pct")).alias("average_slippage_pct"),
        F.avg("fee_paid").alias("average_fee_paid"),
    )


def divergence_profile(checked: DataFrame, keys: tuple[str, ...] = ("symbol", "exchange_id"), bounds: tuple[float, ...] = (5, 10, 25, 50, 100, 250)) -> DataFrame:
    """Cumulative divergence counts per bound and rejections."""
    wide = checked.groupBy(*keys).agg(
        F.count_if(~F.col("acceptable")).alias("rejected"),
        *[F.count_if(F.col("divergence_bps") <= b).alias(f"b{i}") for i, b in enumerate(bounds)],
    )
    cells = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]))
    return wide.select(*keys, "rejected", cells.alias("c")).select(*keys, "rejected", "c.le", "c.n")


def idempotent_orders(orders: DataFrame, id_column: str = "client_order_id", order: tuple[str, ...] = ("ts_ms", "row_id")) -> DataFrame:
    """First row of each order id, the number of repeats, and the status of the last one.

    An aggregation with map-side combine, so a heavily repeated id never gathers in one task.
    """
    rank = F.struct(*order)
    rest = [c for c in orders.columns if c not in (id_column, "status")]
    return (
        orders.groupBy(id_column)
        .agg(
            F.min_by(F.struct(*rest), rank).alias("_first"), F.max_by("status", rank).alias("status"),
            (F.count(F.lit(1)) - 1).alias("duplicates"),
        )
        .select(id_column, "_first.*", "status", "duplicates")
    )


def reconcile_orders(pending: DataFrame, venue: DataFrame) -> DataFrame:
    """Match pending orders with the venue's view: confirmed, duplicate or unresolved."""
    seen = venue.groupBy("client_order_id").agg(
        F.max_by("venue_status", "venue_ts_ms").alias("venue_status"), F.max("venue_ts_ms").alias("adapter_ts_ms")
    )
    out = pending.join(seen, "client_order_id", "left")
    verdict = (
        F.when(F.col("venue_status").isin("FILLED", "ACCEPTED", "CONFIRMED"), "confirmed")
        .when(F.col("venue_status") == "DUPLICATE", "duplicate")
        .otherwise("unresolved")
    )
    return (
        out.withColumn("outcome", verdict).withColumn("resolved", F.col("outcome") != "unresolved")
        .withColumn("delta_ms", F.col("adapter_ts_ms") - F.col("ts_ms"))
    )


def unresolved_orders(pending: DataFrame, venue: DataFrame) -> DataFrame:
    return pending.join(venue.select("client_order_id").distinct(), "client_order_id", "left_anti")


def dead_letters(orders: DataFrame, failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into live orders and failed ones with their failure time."""
    last = failures.groupBy("client_order_id").agg(F.max("failed_ts_ms").alias("failed_ts_ms"))
    return orders.join(last, "client_order_id", "left_anti"), orders.join(last, "client_order_id")


# ------------------------------------------------------------------------------------------------ run checks


def verify_wal_order(recon: DataFrame, *, skew_ms: int = 5000) -> DataFrame:
    """Orders logged after the venue saw them, beyond clock skew."""
    return recon.where(F.col("wal_ts_ms") > F.col("adapter_ts_ms") + skew_ms)


def verify_idempotency(ledger: DataFrame, order: tuple[str, ...] = ("ts_ms", "row_id"), slot_ms: int = 86_400_000) -> DataFrame:
    """Repeats of an order id whose fill differs from its first row."""
    layout = Layout(keys=("client_order_id",), order=order, slot_ms=slot_ms)
    first = ledger.groupBy(*layout.keys).agg(F.min_by("fill_fraction", F.struct(*order)).alias("first_fill"))
    return ledger.join(first, "client_order_id").where(F.abs(F.col("fill_fraction") - F.col("first_fill")) > 1e-6)


def primary_presence(runs: DataFrame, *, limit: float = 0.05) -> DataFrame:
    share = F.when(F.col("windows") > 0, F.col("missing") / F.col("windows")).otherwise(F.lit(0.0))
    return runs.withColumn("ratio", share).withColumn("passed", F.col("ratio") <= limit)
