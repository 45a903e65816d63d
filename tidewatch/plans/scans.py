"""Ordered scans that split a hot key.

``running`` covers frames that start at the first row of a key, ``over_rows`` bounded ROWS frames and ``over_range``
time frames. All are exact; none puts a whole key into one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewatch.plans.layout import Layout

INDEX = "_rn"
_SLOT = "_slot"


@dataclass(frozen=True)
class Scan:
    """One running value. ``kind``: sum, count, max, min, last (ignores nulls), any, streak."""

    kind: str
    value: Column | None = None
    exclusive: bool = False


def _window(layout: Layout, *extra: str) -> WindowSpec:
    return Window.partitionBy(*layout.keys, *extra).orderBy(*layout.order)


def running(df: DataFrame, layout: Layout, slot: Column | None = None, **scans: Scan) -> DataFrame:
    """Add running values over each key, computed in two levels.

    Level one scans every time slot on its own; level two scans one summary row per (key, slot) and hands each slot
    the value carried in. Both the join and the window use the (key, slot) distribution, so rows move once.
    """
    keys = [*layout.keys, _SLOT]
    base = df.withColumn(_SLOT, layout.slot() if slot is None else slot)
    for name, scan in scans.items():
        if scan.value is not None:
            base = base.withColumn(f"_in_{name}", scan.value)
    rank = F.struct(*layout.order)

    summaries = []
    for name, scan in scans.items():
        v = F.col(f"_in_{name}") if scan.value is not None else None
        if scan.kind == "sum":
            summaries.append(F.sum(v).alias(f"_t_{name}"))
        elif scan.kind == "count":
            summaries.append(F.count(F.lit(1)).alias(f"_t_{name}"))
        elif scan.kind == "max":
            summaries.append(F.max(v).alias(f"_t_{name}"))
        elif scan.kind == "min":
            summaries.append(F.min(v).alias(f"_t_{name}"))
        elif scan.kind == "any":
            summaries.append(F.max(v).alias(f"_t_{name}"))
        elif scan.kind == "last":
            summaries.append(F.max_by(v, F.when(v.isNotNull(), rank)).alias(f"_t_{name}"))
        elif scan.kind == "streak":
            summaries.append(F.count(F.lit(1)).alias(f"_n_{name}"))
            summaries.append(F.max(F.when(~v, rank)).alias(f"_f_{name}"))
        else:
            raise ValueError(f"unknown scan kind {scan.kind}")
    totals = base.groupBy(*keys).agg(*summaries)

    # A streak needs the rows after the last break of each slot: count them against that break.
    streaks = [n for n, s in scans.items() if s.kind == "streak"]
    if streaks:
        breaks = totals.select(*keys, *[f"_f_{n}" for n in streaks])
        tails = (
            base.join(breaks, keys)
            .groupBy(*keys)
            .agg(*[
                F.count(F.when(F.col(f"_f_{n}").isNull() | (rank > F.col(f"_f_{n}")), 1)).alias(f"_t_{n}")
                for n in streaks
            ])
        )
        totals = totals.join(tails, keys)

    over_slots = Window.partitionBy(*layout.keys).orderBy(_SLOT)
    before = over_slots.rowsBetween(Window.unboundedPreceding, -1)
    upto = over_slots.rowsBetween(Window.unboundedPreceding, 0)
    carried = totals
    carry_cols = []
    for name, scan in scans.items():
        t, c = F.col(f"_t_{name}"), f"_c_{name}"
        if scan.kind in ("sum", "count"):
            carried = carried.withColumn(c, F.sum(t).over(before))
        elif scan.kind in ("max", "any"):
            carried = carried.withColumn(c, F.max(t).over(before))
        elif scan.kind == "min":
            carried = carried.withColumn(c, F.min(t).over(before))
        elif scan.kind == "last":
            carried = carried.withColumn(c, F.last(t, ignorenulls=True).over(before))
        else:
            carried = (
                carried.withColumn("_cum", F.sum(f"_n_{name}").over(upto))
                .withColumn("_start", F.last(F.when(F.col(f"_f_{name}").isNotNull(), F.col("_cum") - t), ignorenulls=True).over(upto))
                .withColumn("_end", F.col("_cum") - F.coalesce("_start", F.lit(0)))
                .withColumn(c, F.lag("_end", 1, 0).over(over_slots))
                .drop("_cum", "_start", "_end")
            )
        carry_cols.append(c)
    carried = carried.select(*keys, *carry_cols)

    out = base.join(carried, keys, "left")
    w = _window(layout, _SLOT)
    for name, scan in scans.items():
        frame = w.rowsBetween(Window.unboundedPreceding, -1 if scan.exclusive else 0)
        v = F.col(f"_in_{name}") if scan.value is not None else None
        c = F.col(f"_c_{name}")
        if scan.kind == "sum":
            here = F.sum(v).over(frame)
            col = F.when(here.isNull(), c).when(c.isNull(), here).otherwise(here + c)
        elif scan.kind == "count":
            col = F.count(F.lit(1)).over(frame) + F.coalesce(c, F.lit(0))
        elif scan.kind in ("max", "any"):
            col = F.greatest(F.max(v).over(frame), c)
        elif scan.kind == "min":
            col = F.least(F.min(v).over(frame), c)
        elif scan.kind == "last":
            col = F.coalesce(F.last(v, ignorenulls=True).over(frame), c)
        else:
            position = F.row_number().over(w)
            stop = F.max(F.when(~v, position)).over(w.rowsBetween(Window.unboundedPreceding, 0))
            col = F.when(stop.isNull(), c + position).otherwise(position - stop)
        out = out.withColumn(name, col)
    return out.drop(_SLOT, *carry_cols, *[f"_in_{n}" for n in scans])


def previous(df: DataFrame, layout: Layout, **columns: str) -> DataFrame:
    """Add the previous row's value of each column (``out=source``), null in the first row of a key."""
    packed = F.struct(*[F.col(src).alias(out) for out, src in columns.items()])
    out = running(df, layout, _prev=Scan("last", packed, exclusive=True))
    for name in columns:
        out = out.withColumn(name, F.col(f"_prev.{name}"))
    return out.drop("_prev")


def index_rows(df: DataFrame, layout: Layout, name: str = INDEX) -> DataFrame:
    """Add the 1-based row number within each key."""
    return running(df, layout, **{name: Scan("count")})


def run_starts(df: DataFrame, layout: Layout, holds: str, out: str) -> DataFrame:
    """Add the event time at which the current run of rows with ``holds`` began, null in other rows. ``holds`` is never null.

    One scan of rows: every slot finds the runs that begin in it, and a summary row per slot says what a run that goes on from
    slot to slot began with.
    """
    keys, ts, h = [*layout.keys, _SLOT], F.col(layout.ts), F.col(holds)
    w = _window(layout, _SLOT)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn(_SLOT, layout.slot()).withColumn("_begin", F.when(h & ~F.coalesce(F.lag(holds).over(w), F.lit(False)), ts))
    rows = rows.withColumn("_own", F.last("_begin", ignorenulls=True).over(upto)).withColumn("_broken", F.max(~h).over(upto))

    ends = F.max_by(holds, F.struct(*layout.order))
    slots = rows.groupBy(*keys).agg(F.max(~h).alias("_broke"), F.when(ends, F.max("_begin")).alias("_last"), F.min(ts).alias("_first"))
    by_slot = Window.partitionBy(*layout.keys).orderBy(_SLOT)
    slots = slots.withColumn("_part", F.sum(F.col("_broke").cast("long")).over(by_slot.rowsBetween(Window.unboundedPreceding, 0)))
    # A part is one slot with a break and the slots without any that follow it.
    part = Window.partitionBy(*layout.keys, "_part").orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, 0)
    slots = slots.withColumn("_open", F.min(F.when(F.col("_broke"), F.col("_last")).otherwise(F.col("_first"))).over(part))
    carried = slots.select(*keys, F.lag("_open").over(by_slot).alias("_carry"))
    joined = rows.join(carried, keys, "left")
    since = F.when(h, F.when(F.col("_broken"), F.col("_own")).otherwise(F.coalesce("_carry", "_own")))
    return joined.withColumn(out, since).drop(_SLOT, "_begin", "_own", "_broken", "_carry")


def chunk_rows(layout: Layout, reach: int) -> int:
    """Chunk length for frames that reach ``reach`` rows back: never shorter than four reaches."""
    return max(layout.chunk_rows, 4 * reach)


def over_rows(
    df: DataFrame,
    layout: Layout,
    reach: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    size: int | None = None,
) -> DataFrame:
    """Apply ``build(df, window)`` where frames look back at most ``reach`` rows (summed over nested frames).

    Rows are cut into chunks by row number; the last ``reach`` rows of a chunk are also sent to the next one and
    dropped afterwards, so every frame is complete and a hot key spreads over many tasks.
    """
    indexed = df if INDEX in df.columns else index_rows(df, layout)
    out = build(*split_rows(indexed, layout, reach, size))
    return out.where(~F.col("_halo")).drop("_chunk", "_halo")


def split_rows(indexed: DataFrame, layout: Layout, reach: int, size: int | None = None) -> tuple[DataFrame, WindowSpec]:
    """Chunk an indexed table, repeating the last ``reach`` rows of each chunk at the head of the next (``_halo``)."""
    size = max(size, reach) if size else chunk_rows(layout, reach)
    own = F.floor((F.col(INDEX) - 1) / F.lit(size)).cast("long")
    near_end = F.pmod(F.col(INDEX) - 1, F.lit(size)) >= F.lit(size - reach)
    homes = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    split = indexed.withColumn("_chunk", F.explode(homes)).withColumn("_halo", F.col("_chunk") != own)
    return split, _window(layout, "_chunk")


def over_range(
    df: DataFrame,
    layout: Layout,
    reach_ms: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
) -> DataFrame:
    """Apply ``build(df, window)`` where RANGE frames on the event time look back at most ``reach_ms``.

    Each row is also sent to the later time slots its value can reach; the copies are dropped afterwards.
    """
    width = max(layout.slot_ms, reach_ms)
    own = F.floor(F.col(layout.ts) / F.lit(width)).cast("long")
    last = F.floor((F.col(layout.ts) + F.lit(reach_ms)) / F.lit(width)).cast("long")
    split = (
        df.withColumn("_home", own)
        .withColumn("_chunk", F.explode(F.sequence(own, last)))
        .withColumn("_halo", F.col("_chunk") != F.col("_home"))
        .drop("_home")
    )
    w = Window.partitionBy(*layout.keys, "_chunk").orderBy(layout.ts)
    out = build(split, w)
    return out.where(~F.col("_halo")).drop("_chunk", "_halo")


def following(df: DataFrame, layout: Layout, **columns: str) -> DataFrame:
    """Add the next row's value of each column (``out=source``), null in the last row of a key. Orders must be numeric."""
    back = [f"_back_{i}" for i in range(len(layout.order))]
    turned = df.select("*", *[(-F.col(c)).alias(b) for c, b in zip(layout.order, back)])
    return previous(turned, layout.with_(order=tuple(back)), **columns).drop(*back)
