"""Moments of long row frames and of time ranges at a cost that does not grow with their length.

Each row frame is the difference of two growing sums of the chunk. Values are centred on the chunk mean first, so the
difference keeps its digits, and a growing count of changes tells an exactly constant frame apart. A time range is two
growing sums that meet, see :func:`range_moments`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewatch.plans.layout import Layout

#: Most slots of one time range. Shorter ones would cost a long range a summary for every few rows.
SLOTS = 256


def moments(df: DataFrame, w: WindowSpec, n: int, *, lagged: bool = False, **values: str) -> DataFrame:
    """Add a struct ``(n, mean, sd)`` per ``out=value`` over the last ``n`` rows, current one included.

    ``lagged`` shifts the frame to the rows before the current one. ``sd`` is the sample deviation, null below two rows
    and exactly 0 where all values are equal.
    """
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    names = list(values)
    df = df.select(
        "*",
        *[F.avg(values[o]).over(whole).alias(f"_mid_{o}") for o in names],
        *[F.coalesce((F.lag(values[o]).over(w) != F.col(values[o])).cast("int"), F.lit(0)).alias(f"_new_{o}") for o in names],
        F.row_number().over(w).alias("_pos"),
    )
    df = df.select(
        "*",
        *[
            F.struct(
                F.sum(F.col(values[o]) - F.col(f"_mid_{o}")).over(upto).alias("s1"),
                F.sum(F.pow(F.col(values[o]) - F.col(f"_mid_{o}"), 2)).over(upto).alias("s2"),
                F.sum(f"_new_{o}").over(upto).alias("c"),
            ).alias(f"_sum_{o}")
            for o in names
        ],
    )
    df = df.select(
        "*",
        *[F.lag(f"_sum_{o}", n).over(w).alias(f"_old_{o}") for o in names],
        *[F.coalesce(F.lag(f"_sum_{o}", n - 1).over(w)["c"], F.lit(0)).alias(f"_was_{o}") for o in names],
    )
    size = F.least(F.col("_pos"), F.lit(n))

    def result(o: str) -> Column:
        s1 = F.col(f"_sum_{o}.s1") - F.coalesce(F.col(f"_old_{o}.s1"), F.lit(0.0))
        s2 = F.col(f"_sum_{o}.s2") - F.coalesce(F.col(f"_old_{o}.s2"), F.lit(0.0))
        flat = F.col(f"_sum_{o}.c") == F.col(f"_was_{o}")
        spread = F.sqrt(F.greatest(F.lit(0.0), s2 - s1 * s1 / size) / (size - 1))
        return F.struct(
            size.alias("n"),
            (F.col(f"_mid_{o}") + s1 / size).alias("mean"),
            F.when(size > 1, F.when(flat, F.lit(0.0)).otherwise(spread)).alias("sd"),
        ).alias(o)

    work = [f"_{part}_{o}" for part in ("mid", "new", "sum", "old", "was") for o in names]
    df = df.select("*", *[result(o) for o in names]).drop("_pos", *work)
    if lagged:
        for o in names:
            df = df.withColumn(o, F.lag(o).over(w))
    return df


def range_moments(df: DataFrame, layout: Layout, range_ms: int | Column, value: str, out: str) -> DataFrame:
    """Add a struct ``(n, total, mean, sd)`` of ``value`` over the times ``(t - range_ms, t]`` of each row's key.

    Time is cut into blocks as long as the range, so a range is the end of one block and the beginning of the next. A row
    enters its own block at its time and leaves the next block one range later: what entered up to ``t`` and what has yet to
    leave after ``t`` make up the range. Both sums only grow, so nothing cancels, and the work is linear in rows however many
    a range holds. Slots, at most ``SLOTS``, split a block; one summary row per slot carries the sums across.

    Rows of the same time see each other. Null values count as absent, and a row without a time sees nothing: ``n`` is 0 and
    the rest null where nothing was seen. ``sd`` is the deviation of the population. ``range_ms`` may be a column that is the same
    in all rows of a key.
    """
    ts, x, keys = F.col(layout.ts), F.col(value).cast("double"), list(layout.keys)
    reach = range_ms if isinstance(range_ms, Column) else F.lit(range_ms)
    enters, known = F.col("_enters"), x.isNotNull() & ts.isNotNull()
    # A row is sent once as it enters, with its columns, and once more, as a bare value, as it leaves.
    events = df.select("*", F.explode(F.when(known, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("_enters"))
    at = ts + F.when(enters, F.lit(0)).otherwise(reach)
    events = events.select(
        *[F.col(c) if c in keys else F.when(enters, F.col(c)).alias(c) for c in df.columns], "_enters",
        (F.floor(ts / reach).cast("long") + F.when(enters, F.lit(0)).otherwise(F.lit(1))).alias("_block"), at.cast("long").alias("_at"),
        F.floor(F.pmod(at, reach) / F.greatest(F.lit(layout.slot_ms), reach / F.lit(SLOTS))).cast("long").alias("_slot"), F.when(enters & known, x).alias("_in"), F.when(~enters, x).alias("_off"))

    home = [*keys, "_block"]
    totals = events.groupBy(*home, "_slot").agg(*[
        f(c).alias(f"{name}{c}") for c in ("_in", "_off") for name, f in (("n", F.count), ("t", F.sum), ("m", F.avg), ("v", F.var_pop))])
    whole = Window.partitionBy(*home)
    sums, counts = F.coalesce("t_in", F.lit(0.0)) + F.coalesce("t_off", F.lit(0.0)), F.col("n_in") + F.col("n_off")
    middle = F.try_divide(F.sum(sums).over(whole), F.sum(counts).over(whole))
    totals = totals.withColumn("_mid", middle)
    before = whole.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    after = whole.orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*home, "_slot", "_mid", *[
        F.sum(part).over(frame).alias(f"_{name}{c}")
        for c, frame in (("_in", before), ("_off", after))
        for name, part in (
            ("n", F.col(f"n{c}")), ("t", F.col(f"t{c}")), ("s", F.col(f"n{c}") * (F.col(f"m{c}") - F.col("_mid"))),
            ("q", F.col(f"n{c}") * (F.col(f"v{c}") + F.pow(F.col(f"m{c}") - F.col("_mid"), 2))))])

    # Inside a slot sums are taken about the slot's own mean and moved to the block's afterwards: the scans come before the join,
    # which then finds its rows sorted and no longer has those that leave.
    cell = Window.partitionBy(*home, "_slot")
    by_time = cell.orderBy("_at")
    upto = by_time.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    later = cell.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, -1)
    events = events.withColumn("_own", F.avg(F.coalesce("_in", "_off")).over(by_time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    parts = (("n", lambda v: v.isNotNull().cast("long")), ("t", lambda v: v), ("s", lambda v: v - F.col("_own")), ("q", lambda v: F.pow(v - F.col("_own"), 2)))
    rows = events.select(
        *df.columns, "_enters", *home[len(keys):], "_slot", "_own",
        *[F.sum(part(F.col(c))).over(frame).alias(f"_here_{name}{c}") for c, frame in (("_in", upto), ("_off", later)) for name, part in parts])
    rows = rows.where("_enters").join(carried, [*home, "_slot"], "left")

    def seen(name: str) -> Column:
        return sum((F.coalesce(f"_here_{name}{c}", F.lit(0)) + F.coalesce(f"_{name}{c}", F.lit(0)) for c in ("_in", "_off")), F.lit(0))

    def here(name: str) -> Column:
        return F.coalesce(f"_here_{name}_in", F.lit(0)) + F.coalesce(f"_here_{name}_off", F.lit(0))

    moved = F.coalesce(F.col("_own") - F.col("_mid"), F.lit(0.0))
    n, some = seen("n"), seen("n") > 0
    first = (seen("s") + here("n") * moved) / n
    second = (seen("q") + 2 * moved * here("s") + here("n") * moved * moved) / n
    result = F.struct(
        n.alias("n"), F.when(some, seen("t")).alias("total"), F.when(some, F.col("_mid") + first).alias("mean"),
        F.when(some, F.sqrt(F.greatest(F.lit(0.0), second - F.pow(first, 2)))).alias("sd"))
    return rows.select(*df.columns, result.alias(out))
