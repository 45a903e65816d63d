"""Aligning ticks of several venues into windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.plans.anchors import anchor_fold
from tidewatch.plans.asof import asof_join
from tidewatch.plans.layout import TICKS, Layout
from tidewatch.plans.scans import Scan, running
from tidewatch.plans.store import materialise

VENUE = Layout(keys=("symbol", "exchange_id"), order=("ts_ms",))
FIELDS = ("tick_id", "ts_ms", "mid", "bid", "ask", "volume_24h", "exchange_ts_ms", "timestamp_source", "tls_ok", "sequence_id")


def window_override(ticks: DataFrame, overrides: DataFrame, *, default_ms: int = 50) -> DataFrame:
    """Add ``window_ms``: the symbol's own window length or the default. The planner sizes the join by ``overrides``."""
    table = overrides.select("symbol", F.col("window_ms").alias("_own"))
    return ticks.join(table, "symbol", "left").withColumn("window_ms", F.coalesce("_own", F.lit(default_ms))).drop("_own")


def align_tumbling(ticks: DataFrame, *, window_ms: int | Column = 50, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Last tick of each venue per epoch-aligned window; combined map-side, at most one row per venue and window."""
    width = F.lit(window_ms) if isinstance(window_ms, int) else window_ms
    start = (F.floor(F.col("ts_ms") / width) * width).cast("long")
    last = F.max_by(F.struct(*fields), F.struct("ts_ms", "tick_id"))
    return (
        ticks.withColumn("window_start_ms", start)
        .withColumn("window_end_ms", (start + width).cast("long"))
        .groupBy("symbol", "exchange_id", "window_start_ms", "window_end_ms")
        .agg(last.alias("_t"), F.count(F.lit(1)).alias("ticks_in_window"))
        .select("symbol", "exchange_id", "window_start_ms", "window_end_ms", "ticks_in_window", "_t.*")
    )


def align_anchored(ticks: DataFrame, layout: Layout = TICKS, *, window_ms: int = 50) -> DataFrame:
    """Add ``window_open_ms`` and ``closes`` per tick.

    A window opens at the first tick after the previous one closed and closes with the first tick at least ``window_ms``
    later, which still belongs to it. Where it ends depends on where it began, so chunks are composed as maps
    (:mod:`tidewatch.plans.anchors`): no chunk runs on a guess.
    """
    return anchor_fold(ticks, layout, window_ms, opened="window_open_ms", closes="closes")


def anchored_windows(marked: DataFrame) -> DataFrame:
    """Closed windows of :func:`align_anchored`: the last tick of each venue, ending with the closing tick."""
    last = F.max_by(F.struct("mid", "ts_ms", "tick_id"), F.struct("ts_ms", "tick_id"))
    per_venue = marked.groupBy("symbol", "window_open_ms", "exchange_id").agg(
        last.alias("_t"), F.max(F.when(F.col("closes"), F.col("ts_ms"))).alias("_end")
    )
    ends = per_venue.groupBy("symbol", "window_open_ms").agg(F.max("_end").alias("window_end_ms"))
    rows = per_venue.select("symbol", "window_open_ms", "exchange_id", "_t.*")
    return rows.join(ends.where(F.col("window_end_ms").isNotNull()), ["symbol", "window_open_ms"])


def latest_by_venue(aligned: DataFrame, venues: list[str], layout: Layout = VENUE, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """For every window and configured venue, the venue's last tick before the window's end, and its age.

    An as-of join on already reduced rows: windows times venues against one tick per venue and window. Those rows feed
    the spine and both levels of the join, so they are stored once instead of being reduced from the ticks each time.
    """
    aligned = materialise(aligned)
    spine = (
        aligned.select("symbol", "window_start_ms", "window_end_ms").distinct()
        .withColumn("exchange_id", F.explode(F.array(*[F.lit(v) for v in venues])))
        .withColumn("ts_ms", F.col("window_end_ms"))
    )
    extra = [c for c in ("gap",) if c in aligned.columns]
    names = {f"_{c}": c for c in (*fields, *extra)}
    # Times are unique per venue and window; the window end breaks what could still tie.
    hit = asof_join(spine, aligned, layout.with_(order=("ts_ms", "window_end_ms")), names, strict=True)
    out = hit.drop("ts_ms").select(
        "symbol", "window_start_ms", "window_end_ms", "exchange_id", *[F.col(f"_{c}").alias(c) for c in (*fields, *extra)]
    )
    fresh = F.col("ts_ms") >= F.col("window_start_ms")
    age = F.when(fresh, F.lit(0)).otherwise(F.col("window_end_ms") - F.col("ts_ms"))
    return out.withColumn("fresh", F.coalesce(fresh, F.lit(False))).withColumn("age_ms", age.cast("long"))


def lkv_fill(latest: DataFrame, *, staleness_ms: int = 15_000) -> DataFrame:
    """Keep fresh ticks and last known values that are not too old."""
    return latest.where(F.col("fresh") | (F.col("age_ms") <= staleness_ms))


def active_sources(latest: DataFrame, *, liveness_ms: int = 30_000) -> DataFrame:
    """Venues seen shortly before each window's end; one row per venue in a group."""
    seen = F.col("window_end_ms") - F.col("ts_ms") <= liveness_ms
    return latest.groupBy("symbol", "window_end_ms").agg(
        F.sort_array(F.collect_set(F.when(seen, F.col("exchange_id")))).alias("active_sources")
    )


def missing_sources(aligned: DataFrame, venues: list[str]) -> DataFrame:
    """Configured venues without a tick in the window."""
    have = aligned.groupBy("symbol", "window_end_ms").agg(F.collect_set("exchange_id").alias("_have"))
    wanted = F.array(*[F.lit(v) for v in sorted(venues)])
    return have.select("symbol", "window_end_ms", F.array_except(wanted, "_have").alias("missing_sources"))


def sequence_gap(ticks: DataFrame, layout: Layout, *, value: str = "sequence_id", out: str = "gap") -> DataFrame:
    """Step from the highest sequence id seen so far: 1 for the first, 10 where it does not rise, null without id."""
    seen = running(ticks, layout, _max=Scan("max", F.col(value), exclusive=True))
    step = F.col(value) - F.col("_max")
    gap = (
        F.when(F.col(value).isNull(), F.lit(None))
        .when(F.col("_max").isNull(), F.lit(1))
        .when(step <= 0, F.lit(10))
        .otherwise(step)
    )
    return seen.withColumn(out, gap.cast("long")).drop("_max")


def match_validated(
    expected: DataFrame, published: DataFrame, *, rel_price: float = 1e-8, rel_other: float = 1e-6, slot: int = 100_000
) -> DataFrame:
    """Pair expected and published rows of a (symbol, exchange): price, volume and score nearly equal, each row used once.

    The nth expected row of a rounded (price, volume, score) meets the nth published one, so copies pair one to one and a
    group of copies never multiplies. Rows left over are tried against the neighbouring price steps under the exact
    tolerances. Classes: matched, unmatched (expected only), missing (published only).
    """
    group = ["symbol", "exchange_id", "_kp", "_kv", "_ks"]

    def numbered(df: DataFrame, shift: int = 0) -> DataFrame:
        keyed = (
            df.withColumn("_kp", F.round(F.col("mid") * 1e6).cast("long") + shift)
            .withColumn("_kv", F.round(F.col("volume_24h") * 1e3).cast("long"))
            .withColumn("_ks", F.round(F.col("score") * 1e5).cast("long"))
        )
        return running(keyed, Layout(keys=tuple(group), order=("row_id",), slot_ms=slot), _n=Scan("count"))

    def near(a: str, b: str, rel: float) -> Column:
        return F.abs(F.col(a) - F.col(b)) <= F.lit(rel) * F.greatest(F.abs(a), F.abs(b))

    def join(e: DataFrame, p: DataFrame, shift: int) -> DataFrame:
        right = numbered(p, shift).select(
            *group, "_n", F.col("row_id").alias("p_id"), F.col("mid").alias("p_mid"),
            F.col("volume_24h").alias("p_volume"), F.col("score").alias("p_score"),
        )
        return numbered(e).join(right, [*group, "_n"]).where(
            near("mid", "p_mid", rel_price) & near("volume_24h", "p_volume", rel_other) & near("score", "p_score", rel_other)
        ).select("row_id", "p_id")

    def rest(df: DataFrame, hits: DataFrame, column: str) -> DataFrame:
        return df.join(hits.select(F.col(column).alias("row_id")), "row_id", "left_anti")

    hits = join(expected, published, 0)
    for shift in (-1, 1):
        hits = materialise(hits)
        hits = hits.unionByName(join(rest(expected, hits, "row_id"), rest(published, hits, "p_id"), shift))
    hits = materialise(hits)
    none = F.lit(None).cast("long")
    return (
        hits.select("row_id", "p_id", F.lit("matched").alias("class"))
        .unionByName(rest(expected, hits, "row_id").select("row_id", none.alias("p_id"), F.lit("unmatched").alias("class")))
        .unionByName(rest(published, hits, "p_id").select(none.alias("row_id"), F.col("row_id").alias("p_id"), F.lit("missing").alias("class")))
    )
