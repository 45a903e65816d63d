"""Expressions over small arrays, such as the quotes of one window (at most one per venue)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def array_median(a: Column) -> Column:
    """Mean of the middle two values; null for an empty array."""
    def middle(s: Column) -> Column:
        n = F.size(s)
        low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
        return F.when(n > 0, (low + high) / 2.0)

    return bind(F.sort_array(a), middle)


def total(a: Column, value: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + value(x))


def weighted_median(quotes: Column, mid: str = "mid", weight: str = "volume_24h") -> Column:
    """First value, by size, whose cumulative weight reaches half; the plain median where no weight is positive."""
    pairs = F.sort_array(
        F.transform(
            quotes,
            lambda q: F.struct(
                q[mid].alias("m"), F.greatest(F.lit(0.0), F.coalesce(q[weight].cast("double"), F.lit(0.0))).alias("w")
            ),
        )
    )
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("pick"))

    def pick(p: Column, half: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            cum = acc["cum"] + x["w"]
            return F.struct(cum.alias("cum"), F.coalesce(acc["pick"], F.when(cum >= half, x["m"])).alias("pick"))

        return F.when(half > 0, F.aggregate(p, start, step, lambda acc: acc["pick"])).otherwise(
            array_median(F.transform(p, lambda x: x["m"]))
        )

    return bind(pairs, lambda p: bind(total(p, lambda x: x["w"]) / 2.0, lambda half: pick(p, half)))
