"""Time-series queries and alert rules over metric samples ``(metric, labels, ts_ms, value)``."""

from __future__ import annotations

import math
from dataclasses import astuple, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewatch.operators import alerting as A
from tidewatch.plans.frames import range_moments
from tidewatch.plans.layout import Layout
from tidewatch.plans.scans import previous
from tidewatch.plans.store import broadcast_if_small, materialise

SERIES = Layout(keys=("metric", "series"), order=("ts_ms",))


def series_id(labels: Column | str = "labels") -> Column:
    """Labels as text, sorted by name: a groupable identity of a series."""
    m = F.col(labels) if isinstance(labels, str) else labels
    return F.array_join(F.transform(F.sort_array(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def latest_gauge(samples: DataFrame) -> DataFrame:
    return samples.groupBy("metric", "series").agg(F.max_by("value", "ts_ms").alias("value"), F.max("ts_ms").alias("ts_ms"))


def counter_steps(samples: DataFrame, layout: Layout = SERIES) -> DataFrame:
    """Add ``step``: growth since the previous sample; after a reset the new value itself."""
    rows = previous(samples, layout, _was="value")
    return rows.withColumn("step", F.when(F.col("value") < F.col("_was"), F.col("value")).otherwise(F.col("value") - F.col("_was"))).drop("_was")


def counter_increase(samples: DataFrame, layout: Layout = SERIES, *, range_ms: int = 300_000) -> DataFrame:
    """Growth over the time range that ends at each sample, linear in samples whatever the range."""
    rows = range_moments(counter_steps(samples, layout), layout, range_ms, "step", "_range")
    return rows.withColumn("increase", F.coalesce("_range.total", F.lit(0.0))).drop("_range")


def counter_rate(samples: DataFrame, layout: Layout = SERIES, *, range_ms: int = 300_000) -> DataFrame:
    return counter_increase(samples, layout, range_ms=range_ms).withColumn("rate", F.col("increase") / (range_ms / 1000.0))


def sum_by_label(steps: DataFrame, label: str, *, bucket_ms: int = 300_000) -> DataFrame:
    """Growth per metric, label value and time bucket."""
    bucket = (F.floor(F.col("ts_ms") / bucket_ms) * bucket_ms).cast("long")
    return steps.groupBy("metric", F.try_element_at("labels", F.lit(label)).alias(label), bucket.alias("bucket_ms")).agg(F.sum("step").alias("increase"))


def bucketize(observations: DataFrame, keys: tuple[str, ...], value: str, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative ``le`` counts, infinity included, from one conditional aggregation."""
    wide = observations.groupBy(*keys).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("b_inf"))
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit(float("inf")).alias("le"), F.col("b_inf").alias("n")))
    return wide.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.le", "c.n")


def bucket_quantile(rows: DataFrame, cells: str, q: float | Column, out: str) -> DataFrame:
    """Quantile ``q`` of cumulative bucket counts, an array of ``(le, n)`` sorted by ``le``: linear inside the bucket that holds the
    rank, the last finite bound where it is the open one, null without observations."""
    total = F.try_element_at(cells, F.lit(-1))["n"]
    rows = rows.withColumn("_total", total).withColumn("_at", F.array_position(F.transform(cells, lambda b: b["n"] >= total * q), True).cast("int"))
    rank = F.col("_total") * q
    here, before = F.try_element_at(cells, F.col("_at")), F.try_element_at(cells, F.greatest(F.lit(1), F.col("_at") - 1))
    low = F.when(F.col("_at") > 1, before["le"]).otherwise(F.lit(0.0))
    seen = F.when(F.col("_at") > 1, before["n"]).otherwise(F.lit(0))
    inside = here["n"] - seen
    value = F.when(F.isnan(here["le"]) | (here["le"] == float("inf")), before["le"]).when(inside == 0, here["le"]).otherwise(
        low + (here["le"] - low) * (rank - seen) / inside)
    return rows.withColumn(out, F.when(F.col("_total") > 0, value)).drop("_total", "_at")


def histogram_quantile(buckets: DataFrame, keys: tuple[str, ...], q: float) -> DataFrame:
    """:func:`bucket_quantile` per group. The buckets of a group are its bounds, a handful, whatever the number of observations."""
    rows = buckets.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("le", "n"))).alias("_b"))
    return bucket_quantile(rows, "_b", q, "quantile").select(*keys, "quantile")


def range_stats(samples: DataFrame, layout: Layout = SERIES, *, range_ms: int = 300_000) -> DataFrame:
    """Average and population deviation over the range that ends at each sample, linear in samples whatever the range."""
    rows = range_moments(samples, layout, range_ms, "value", "_range")
    return rows.withColumn("range_avg", F.col("_range.mean")).withColumn("range_stddev", F.col("_range.sd")).drop("_range")


def range_max_by(samples: DataFrame, label: str, *, bucket_ms: int = 300_000) -> DataFrame:
    bucket = (F.floor(F.col("ts_ms") / bucket_ms) * bucket_ms).cast("long")
    return samples.groupBy("metric", F.try_element_at("labels", F.lit(label)).alias(label), bucket.alias("bucket_ms")).agg(F.max("value").alias("max_value"))


def ratio_alert(steps: DataFrame, above: str, below: str, *, threshold: float, bucket_ms: int = 300_000) -> DataFrame:
    """Share of two counters' growth per bucket, with the alert flag; one pass over both counters."""
    bucket = (F.floor(F.col("ts_ms") / bucket_ms) * bucket_ms).cast("long")
    both = steps.where(F.col("metric").isin(above, below)).groupBy(bucket.alias("bucket_ms")).agg(
        F.sum(F.when(F.col("metric") == above, F.col("step"))).alias("_a"), F.sum(F.when(F.col("metric") == below, F.col("step"))).alias("_b"))
    ratio = F.when(F.col("_b") > 0, F.coalesce("_a", F.lit(0.0)) / F.col("_b"))
    return both.select("bucket_ms", ratio.alias("ratio")).where(F.col("ratio").isNotNull()).withColumn("firing", F.col("ratio") > threshold)


def default_zero(values: DataFrame, spark: SparkSession, start_ms: int, end_ms: int, *, bucket_ms: int, value: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """A value for every bucket of the period, 0 where nothing was measured; with ``keys``, for every bucket of each key that was ever measured."""
    first, last = start_ms // bucket_ms, -(-end_ms // bucket_ms) - 1
    buckets = F.explode(F.sequence(F.lit(first * bucket_ms), F.lit(last * bucket_ms), F.lit(bucket_ms))).alias("bucket_ms")
    known = values.select(*keys).distinct() if keys else spark.range(1).select()
    return known.select(*keys, buckets).join(values, [*keys, "bucket_ms"], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


@dataclass(frozen=True)
class Rule:
    """One alert: a series derived from a metric, a condition on it, and how long the condition has to hold.

    ``over``: the ``value`` itself, or the ``increase`` or ``rate`` of a counter over ``range_ms``. ``other`` divides it by the same of
    another metric with equal labels; ``quantile`` takes that quantile over the ``le`` buckets of a histogram. ``matches`` is a
    pattern for the whole of ``label``; a missing label is empty text.
    """

    alert: str
    metric: str
    op: str
    threshold: float
    hold_ms: int
    severity: str
    over: str = "value"
    range_ms: int = 300_000
    other: str | None = None
    quantile: float | None = None
    label: str | None = None
    matches: str | None = None


# Metrics, thresholds, hold times, ranges and label patterns of the alerts.
RULES = [
    Rule("SystemStateHALT", "layer2_system_state", "==", 3.0, 10_000, "critical"),
    Rule("AuditChainIntegrityFailure", "audit_chain_valid", "==", 0.0, 0, "critical"),
    Rule("KafkaBrokerDown", "kafka_brokers", "<", 1.0, 30_000, "critical"),
    Rule("LayerServiceDown", "up", "==", 0.0, 30_000, "critical", label="job", matches="layer.*"),
    Rule("ReplayAttackDetected", "replay_suspicion_total", ">", 0.0, 0, "critical", over="increase", range_ms=60_000),
    Rule("TrustScoreLow", "trust_score", "<", 0.6, 60_000, "high"),
    Rule("AnomalyScoreHigh", "anomaly_fused_score", ">", 0.8, 30_000, "high"),
    Rule("ConsensusDivergenceHigh", "consensus_divergence", ">", 0.01, 60_000, "high"),
    Rule("KafkaConsumerLagHigh", "kafka_consumergroup_lag", ">", 1000.0, 120_000, "high"),
    Rule("ExchangeWebsocketDisconnected", "websocket_connected", "==", 0.0, 30_000, "high", label="exchange", matches=".*"),
    Rule("TLSPinningFailures", "tls_pinning_failures_total", ">", 5.0, 0, "high", over="increase"),
    Rule("ExecutionRetriesHigh", "execution_retries_total", ">", 10.0, 0, "medium", over="increase"),
    Rule("RiskCircuitBreakerOpen", "risk_circuit_breaker_state", "==", 1.0, 60_000, "medium"),
    Rule("ContainerHighCPU", "container_cpu_usage_seconds_total", ">", 0.8, 300_000, "medium", over="rate", label="name", matches="algo-trading.*"),
    Rule("ContainerHighMemory", "container_memory_usage_bytes", ">", 0.8, 300_000, "medium", other="container_spec_memory_limit_bytes", label="name", matches="algo-trading.*"),
    Rule("SystemStateDegraded", "layer2_system_state", "==", 2.0, 300_000, "medium"),
    Rule("RiskRejectionsHigh", "risk_rejections_total", ">", 20.0, 0, "medium", over="increase", range_ms=600_000),
    Rule("ModelInferenceLatencyHigh", "anomaly_model_inference_duration_ms_bucket", ">", 50.0, 300_000, "medium", over="rate", quantile=0.95),
    Rule("ExecutionLatencyHigh", "execution_latency_ms_bucket", ">", 100.0, 300_000, "medium", over="rate", quantile=0.95),
    Rule("SequenceGapsDetected", "sequence_gaps_total", ">", 10.0, 0, "high", over="increase"),
    Rule("QuarantinedTicksHigh", "quarantined_ticks_total", ">", 50.0, 0, "medium", over="increase"),
    Rule("BadMessageRateHigh", "layer2_bad_in_total", ">", 0.05, 120_000, "medium", over="rate", other="layer2_raw_in_total"),
]
RULE_SCHEMA = """alert string, metric string, op string, threshold double, hold_ms long, severity string, over string, range_ms long,
  other string, quantile double, label string, matches string, role string"""


def rule_table(spark: SparkSession, rules: list[Rule] = RULES) -> DataFrame:
    """One row per metric that a rule reads; ``role`` tells its main metric from its divisor."""
    rows = [(*astuple(rule), "main") for rule in rules]
    rows += [(*astuple(replace(rule, metric=rule.other)), "other") for rule in rules if rule.other]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _label_hash() -> Column:
    return F.xxhash64("metric", F.col("_names").isNull(), "_names", "_values")


def _pairs(samples: DataFrame, rules: DataFrame, layout: Layout) -> tuple[DataFrame, DataFrame, list[A.Kind], list, bool]:
    """``(entries, pairs, kinds, conditions, apart)``: the label sets that rules read, by the numbers of their pairs, curves and kinds; rule,
    series and curves of every pair; how pairs are cut; the main rows of the rules; and whether a hash tells all label sets of their metrics apart.

    A pair is a rule and a series, a curve one metric of a ratio or one bound of a histogram. Text is worked on once per label set here.
    The length of a pair's chunks follows its number of samples: a slot or a range, doubled or halved, but no less than a slot.
    """
    ts = F.col(layout.ts)
    read = rules.select("metric", "alert", "role", "over", "range_ms", "label", "matches")
    sets = materialise(samples.join(broadcast_if_small(read.select("metric").distinct()), "metric", "left_semi").groupBy(
        "metric", F.map_keys("labels").alias("_names"), F.map_values("labels").alias("_values")).agg(F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_lo"), F.max(ts).alias("_hi")))
    apart = sets.count() == sets.select(_label_hash()).distinct().count()
    label = F.coalesce(F.try_element_at("labels", F.col("label")), F.lit(""))
    wanted = F.col("matches").isNull() | F.regexp_like(label, F.concat(F.lit("^(?:"), F.col("matches"), F.lit(")$")))
    sets = materialise(sets.withColumn("labels", F.map_from_arrays("_names", "_values")).join(broadcast_if_small(read), "metric").where(wanted).select(
        "metric", "_names", "_values", "_n", "_lo", "_hi", "alert", "role", "over", "range_ms", series_id(F.map_filter("labels", lambda k, _: k != "le")).alias("series"),
        F.coalesce(F.try_element_at("labels", F.lit("le")), F.lit("")).alias("le")).distinct())

    named = ["alert", "over", "range_ms", "series"]
    curves = sets.groupBy(*named, "role", "le").agg(F.sum("_n").alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    curve = F.struct("role", "le")
    pairs = curves.groupBy(*named).agg(F.sort_array(F.collect_list(curve)).alias("_curves"), F.sum("_n").alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    slot, reach = F.lit(layout.slot_ms), F.when(F.col("over") != "value", F.col("range_ms")).otherwise(F.lit(0))
    aim = F.coalesce(F.lit(float(A.CHUNK_ROWS)) * (F.col("_hi") - F.col("_lo") + 1) / F.col("_n"), F.lit(1.0))
    unit = F.when(F.col("_reach") > 0, F.col("_reach")).otherwise(slot)
    doubled = F.greatest(F.lit(0), F.floor(F.log2(F.col("_aim") / unit)))
    halved = F.greatest(F.lit(0), F.least(
        F.ceil(F.log2(unit / F.col("_aim"))), F.floor(F.log2(unit / slot)), F.round(F.log2(unit.bitwiseAND(-unit)))))
    span = F.when(F.col("_aim") >= unit, unit * F.pow(F.lit(2.0), doubled)).otherwise(unit / F.pow(F.lit(2.0), halved)).cast("long")
    pairs = materialise(pairs.withColumns({"_reach": reach.cast("long"), "_aim": aim}).withColumn("_span", span).withColumns(
        {"_rate": F.col("over") == "rate", "_pair": F.monotonically_increasing_id()}).drop("_aim"))
    cuts = [tuple(row) for row in pairs.select("_reach", "_span", "_rate").distinct().collect()]
    main = rules.where("role = 'main'").select("alert", "over", "range_ms", "op", "threshold", "hold_ms", "severity", F.col("other").isNotNull().alias("other"), "quantile").distinct().collect()
    if len(cuts) > 2**16 or pairs.where(F.size("_curves") > 2**16).limit(1).count():
        raise ValueError("more than 65,536 kinds of chunks or curves of a pair")

    spark, same = samples.sparkSession, lambda left, right, names: [left[c].eqNullSafe(right[c]) for c in names]
    kind = spark.createDataFrame([(*cut, i) for i, cut in enumerate(cuts)], "_reach long, _span long, _rate boolean, _kind int")
    of = spark.createDataFrame([(*row[:3], i) for i, row in enumerate(main)], "alert string, over string, range_ms long, _condition int")
    of = of.groupBy("alert", "over", "range_ms").agg(F.sort_array(F.collect_list("_condition")).alias("conditions"))
    pairs = materialise(pairs.join(F.broadcast(kind), ["_reach", "_span", "_rate"]).join(F.broadcast(of), same(pairs, of, ["alert", "over", "range_ms"])).select(
        "_pair", "_kind", "_reach", "_span", "_n", pairs["alert"], pairs["over"], pairs["range_ms"], "series", "_curves", "conditions"))
    numbered = pairs.select(*named, "_pair", "_kind", "_reach", "_span", F.posexplode("_curves").alias("_i", "_c")).select(
        *named, F.col("_c.role").alias("role"), F.col("_c.le").alias("le"), "_pair", "_reach", "_span", (F.shiftleft(F.col("_i").cast("long"), 16) + F.col("_kind")).alias("_code"))
    keys = [*named, "role", "le"]
    entries = materialise(sets.join(numbered, same(sets, numbered, keys)).select(
        "metric", "_names", "_values", "_pair", "_reach", "_span", "_code"))
    return entries, pairs, [A.Kind(*cut) for cut in cuts], main, apart


def _schema(ddl: str):
    return to_arrow_schema(StructType.fromDDL(ddl))


def _judged(samples: DataFrame, rules: DataFrame, layout: Layout, value_only: bool = False) -> tuple[DataFrame, DataFrame, list]:
    """``(points, pairs, conditions)``: value, condition and start of its run for every pair, condition number and time."""
    entries, pairs, kinds, main, apart = _pairs(samples, rules, layout)
    if value_only:
        conditions = [A.Condition(None, None, row["other"], row["quantile"]) for row in main]
        # Rules that differ in their condition only have one value.
        first = {tuple(row[c] for c in ("alert", "over", "range_ms", "other", "quantile")): i for i, row in reversed(list(enumerate(main)))}
        pairs = pairs.withColumn("conditions", F.array_intersect("conditions", F.array(*[F.lit(i) for i in first.values()]).cast("array<int>")))
    else:
        conditions = [A.Condition(row["op"], row["threshold"], row["other"], row["quantile"]) for row in main]
    ts = F.col(layout.ts).cast("long")
    read = samples.join(broadcast_if_small(rules.select("metric").distinct()), "metric", "left_semi")
    labels = read.select("metric", F.map_keys("labels").alias("_names"), F.map_values("labels").alias("_values"), ts.alias("_ts"), F.col("value").cast("double").alias("_x"))
    entries = broadcast_if_small(entries)
    if apart:
        rows = labels.select(_label_hash().alias("_hash"), "_ts", "_x").join(entries.withColumn("_hash", _label_hash()), "_hash")
    else:
        rows = labels.join(entries, [labels[c].eqNullSafe(entries[c]) for c in ("metric", "_names", "_values")])
    rows = rows.select("_pair", "_code", "_ts", "_x", "_reach", "_span")
    own = F.col("_ts") - F.pmod("_ts", "_span")
    # What a later chunk still sees of this one is sent there too.
    seen = (F.col("_reach") > 0) & ((F.col("_span") < F.col("_reach")) | (F.pmod("_ts", "_span") > F.col("_span") - F.col("_reach")))
    homes = F.explode(F.when(seen, F.array(own, own + F.greatest("_span", "_reach"))).otherwise(F.array(own)))
    none = F.lit(A.NO_TIME).cast("long")
    rows = rows.select("_pair", "_code", homes.alias("_start"), "_ts", "_x").select(
        "_pair", "_code", F.coalesce("_start", none).alias("_start"), F.coalesce("_ts", none).alias("_ts"), "_x")
    spark = samples.sparkSession
    size = pairs.agg(F.sum("_n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(1.5 * size / A.TASK_ROWS))
    chunks = rows.repartition(parts, "_pair", "_start").mapInArrow(A.pack(kinds, _schema(A.PACKED)), A.PACKED)
    # Few chunks at a time when they are read again: one may hold megabytes.
    packed = materialise(chunks, compression="zstd", **{"parquet.block.row.count.limit": "16"})

    few = packed.select("_pair").count() <= 1_000_000
    near = F.broadcast if few else lambda df: df
    narrow = packed.select("_pair", "_start", "_kind", "curves", "first_ts", "first_x", "last_x", "total", "tail", "tail_step")
    carried = materialise(narrow.groupBy("_pair").applyInArrow(A.carry(kinds, _schema(A.CARRIED)), A.CARRIED))
    bound = lambda f: F.transform("_curves", f)
    of = pairs.select(
        "_pair", "conditions", bound(lambda c: c["role"] == "main").alias("mains"), bound(lambda c: (c["role"] == "main") & (c["le"] != "")).alias("cells"),
        bound(lambda c: F.when(c["le"] != "", c["le"].try_cast("double"))).alias("les"))
    whole = packed.drop("first_x", "last_x", "total", "tail", "tail_step").join(near(carried.join(of, "_pair")), ["_pair", "_start"])
    ends = whole.mapInArrow(A.judge(kinds, conditions, _schema(A.RUNS), True), A.RUNS)
    opened = ends.groupBy("_pair").applyInArrow(A.open_runs(_schema(A.OPEN)), A.OPEN)
    points = f"_pair long, _condition int, {layout.ts} long, value double, holds boolean, active_since_ms long"
    out = whole.join(near(opened), ["_pair", "_start"]).mapInArrow(A.judge(kinds, conditions, _schema(points), False), points)
    return out, pairs, main


def rule_series(samples: DataFrame, rules: DataFrame, layout: Layout = SERIES) -> DataFrame:
    """The value of every rule's series at each of its sample times: ``(alert, series, ts_ms, value)``.

    All rules are compiled into one plan. The label sets of the samples meet the rules by metric and pattern once, and from then on a sample
    is five numbers. Samples move once, to their chunk of a series and to the one that still sees them, and are packed there into arrays:
    growth and sums over ranges inside the chunk, and for each chunk the few numbers that reach into the next ones. A last pass brings together
    the two metrics of a ratio and the buckets of a histogram, which need samples at the same time. Samples of one series at one time count
    as their maximum. A ratio is null without its divisor and for 0/0, infinite for a divisor of 0.
    """
    points, pairs, _ = _judged(samples, rules, layout, value_only=True)
    return points.join(broadcast_if_small(pairs.select("_pair", "alert", "series")), "_pair").select("alert", "series", layout.ts, "value")


def alert_rules(samples: DataFrame, rules: DataFrame, layout: Layout = SERIES) -> DataFrame:
    """Evaluate every rule on all its series (:func:`rule_series`); a rule fires once its condition has held for its hold time.

    ``rules`` is configuration. Of the run of true samples a chunk ends with, only its start goes on to the next chunk, so one busy
    series spreads over chunks. A null value is no condition met.
    """
    points, pairs, main = _judged(samples, rules, layout)
    conditions = samples.sparkSession.createDataFrame(
        [(i, row["op"], row["threshold"], row["hold_ms"], row["severity"]) for i, row in enumerate(main)], "_condition int, op string, threshold double, hold_ms long, severity string")
    pairs = pairs.select("_pair", "alert", "series", F.explode("conditions").alias("_condition")).join(F.broadcast(conditions), "_condition")
    firing = F.col("holds") & (F.col(layout.ts) - F.col("active_since_ms") >= F.col("hold_ms"))
    return points.join(broadcast_if_small(pairs), ["_pair", "_condition"]).select(
        "alert", "series", layout.ts, "value", "op", "threshold", "hold_ms", "severity", "holds", "active_since_ms", firing.alias("firing"))


def metrics_text_parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Exposition text to (name, labels text, value); comments and malformed lines drop out."""
    pattern = r"^([A-Za-z_:][A-Za-z0-9_:]*)(\{[^}]*\})?\s+([-+0-9.eE]+|NaN|[+-]?Inf)\s*$"
    part = lambda i: F.regexp_extract(F.trim(column), pattern, i)
    return lines.where(F.trim(column).rlike(pattern)).select(
        *[c for c in lines.columns if c != column], part(1).alias("name"), part(2).alias("label_text"), part(3).cast("double").alias("metric_value"))
