"""Exact quantiles of large groups.

Values are counted and stored, cut into bins of equal width on a signed logarithmic scale, so that a heavy tail spreads over
many bins, and these into bins of equal width of their own range, so that close values part. A running count over the bins
finds the value at each rank. No group is collected or sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.plans.layout import Layout
from tidewatch.plans.scans import Scan, running
from tidewatch.plans.store import materialise

_BINS = 1024
#: Values nearer to zero than this share the bins around it.
_SMALL = 1e-9


def _log(v: Column) -> Column:
    """Never falls where ``v`` rises."""
    return F.signum(v) * F.log1p(F.abs(v) / F.lit(_SMALL))


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    position = F.floor((v - lo) / (hi - lo) * F.lit(_BINS)).cast("long")
    return F.when(hi > lo, F.least(position, F.lit(_BINS - 1))).otherwise(F.lit(0))


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], *, method: str = "linear"
) -> DataFrame:
    """One row per group with a column per probability.

    ``method``: ``linear`` interpolates between ranks (position ``(n - 1) * p``), ``nearest`` takes the value at the
    half-even rounded position.
    """
    group = list(keys) or ["_all"]
    source = df if keys else df.withColumn("_all", F.lit(0))
    v = F.col("_v")
    counts = materialise(
        source.select(*group, F.col(value).cast("double").alias("_v"))
        .where(v.isNotNull())
        .groupBy(*group, "_v")
        .agg(F.count(F.lit(1)).alias("_k"))
    )
    totals = counts.groupBy(*group).agg(F.sum("_k").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    coarse = counts.join(totals, group).withColumn("_b1", _bin(_log(v), _log(F.col("_lo")), _log(F.col("_hi")))).drop("_lo", "_hi")
    ranges = coarse.groupBy(*group, "_b1").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    fine = coarse.join(ranges, [*group, "_b1"])
    slot = F.col("_b1") * F.lit(_BINS) + _bin(v, F.col("_lo"), F.col("_hi"))
    ranked = running(
        fine, Layout(keys=tuple(group), order=("_v",)), slot=slot, _cum=Scan("sum", F.col("_k"))
    )

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_cum") > rank, v))

    picks = []
    for i, p in enumerate(probs.values()):
        pos = (F.col("_n") - 1) * F.lit(p)
        if method == "nearest":
            picks.append(at(F.bround(pos, 0)).alias(f"_q{i}"))
        else:
            picks += [at(F.floor(pos)).alias(f"_lo{i}"), at(F.ceil(pos)).alias(f"_hi{i}"),
                      F.first(pos - F.floor(pos)).alias(f"_w{i}")]
    out = ranked.groupBy(*group).agg(*picks)
    cols = []
    for i, name in enumerate(probs):
        if method == "nearest":
            cols.append(F.col(f"_q{i}").alias(name))
        else:
            lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
            cols.append((lo + (hi - lo) * F.col(f"_w{i}")).alias(name))
    return out.select(*keys, *cols)
