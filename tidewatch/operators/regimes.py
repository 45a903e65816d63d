"""Features for regime models and the regime fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidewatch.functions.scalar import time_of_day
from tidewatch.operators.anomaly import RegimeModel, tick_features
from tidewatch.plans.frames import moments
from tidewatch.plans.layout import TICKS, Layout
from tidewatch.plans.scans import Scan, over_rows, previous, running


def rv_buckets(prices: DataFrame, layout: Layout = TICKS, *, bucket_ms: int = 1_800_000, value: str = "mid", minimum: int = 31) -> DataFrame:
    """Realised volatility of non-overlapping buckets from returns inside the bucket; short series give nothing."""
    bucket = (F.floor(F.col(layout.ts) / bucket_ms) * bucket_ms).cast("long")
    rows = previous(prices.withColumn("bucket_ms", bucket), layout, _p="" + value, _b="bucket_ms")
    inside = (F.col("_b") == F.col("bucket_ms")) & (F.col(value) > 0) & (F.col("_p") > 0)
    ret = F.when(inside, F.log(F.col(value) / F.col("_p")))
    buckets = rows.groupBy(*layout.keys, "bucket_ms").agg(F.sqrt(F.sum(ret * ret)).alias("rv"), F.count(F.lit(1)).alias("prices"))
    enough = rows.groupBy(*layout.keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum)
    return buckets.where(F.col("rv").isNotNull()).join(enough.drop("_n"), list(layout.keys), "left_semi")


def concat_symbols(series: list[DataFrame]) -> DataFrame:
    """One table out of the volatility series of all symbols."""
    out = series[0]
    for s in series[1:]:
        out = out.unionByName(s)
    return out


def regime_moves(labelled: DataFrame, layout: Layout, column: str = "regime") -> DataFrame:
    """Empirical transition matrix: counts and shares per regime."""
    w = running(labelled, layout, _was=Scan("last", F.col(column), exclusive=True)).where(F.col("_was").isNotNull())
    counts = w.groupBy(F.col("_was").alias("from_regime"), F.col(column).alias("to_regime")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("from_regime").agg(F.sum("n").alias("_all"))
    return counts.join(totals, "from_regime").withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def fit_regimes(series: DataFrame, layout: Layout, *, seed: int = 42, value: str = "rv") -> tuple[RegimeModel, DataFrame]:
    """Two volatility regimes, low first: a Gaussian mixture for levels, observed moves for persistence."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=[value], outputCol="_x").transform(series)
    model = GaussianMixture(k=2, seed=seed, featuresCol="_x", predictionCol="_c", probabilityCol="_p").fit(rows)
    parts = sorted(
        ((g.mean.toArray()[0], g.cov.toArray()[0][0] ** 0.5, i) for i, g in enumerate(model.gaussians)), key=lambda t: t[0]
    )
    low = parts[0][2]
    labelled = model.transform(rows).withColumn("regime", F.when(F.col("_c") == low, 0).otherwise(1)).drop("_x", "_c", "_p")
    stay = {r.from_regime: r.share for r in regime_moves(labelled, layout).where("from_regime = to_regime").collect()}
    keep = tuple(min(0.999, max(0.001, stay.get(i, 0.5))) for i in (0, 1))
    return RegimeModel(means=(parts[0][0], parts[1][0]), sds=(parts[0][1], parts[1][1]), stay=keep), labelled


def feature_vector(ticks: DataFrame, layout: Layout = TICKS, *, window: int = 300) -> DataFrame:
    """Eight model inputs: jump, volume and spread against their means, spread, trust, regime, time of day."""
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return moments(df, w, window, _v="volume", _s="spread_bps")

    rows = over_rows(tick_features(ticks, layout), layout, window, build)
    sin, cos = time_of_day(layout.ts)
    against = lambda value, m: F.when(F.col(f"{m}.mean") > 0, F.col(value) / F.col(f"{m}.mean")).otherwise(F.lit(1.0))
    return rows.withColumn(
        "features",
        F.array(
            F.col("jump_bps"), against("volume", "_v"), F.col("spread_bps"), against("spread_bps", "_s"), F.lit(1.0),
            F.col("regime").cast("double"), sin, cos,
        ),
    ).drop("_v", "_s")


def stratified_sample(rows: DataFrame, strata: str, n: int, *, row_id: str = "tick_id", seed: int = 42, slots: int = 4096) -> DataFrame:
    """At most ``n`` rows per stratum, chosen by hash order.

    The order is a hash, so its slots are equally full: a running count over slots numbers a stratum of any size without
    sorting it in one task.
    """
    hashed = rows.withColumn("_h", F.pmod(F.xxhash64(F.col(row_id), F.lit(seed)), F.lit(2**40)))
    layout = Layout(keys=(strata,), order=("_h", row_id), slot_ms=2**40 // slots)
    return running(hashed, layout, _n=Scan("count")).where(F.col("_n") <= n).drop("_h", "_n")


def regime_distribution(rows: DataFrame, column: str = "regime") -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
