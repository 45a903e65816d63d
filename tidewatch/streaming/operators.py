"""Streaming forms of the operators. Late rows are those behind the watermark; they are dropped and can be counted."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidewatch.operators.anomaly import SEVERITY, GateConfig, gate_base_state, gate_step
from tidewatch.operators.chain import audit_enrich, build_chain
from tidewatch.operators.consensus import ConsensusConfig, judge_window
from tidewatch.plans.layout import Layout

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
AUDIT = Layout(keys=("event_type",))


def with_event_time(ticks: DataFrame, delay: str) -> DataFrame:
    return ticks.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", delay)


def _ms(column: str) -> Column:
    return F.unix_millis(F.col(column))


def stream_candles(ticks: DataFrame, *, timeframe: str = "5 minutes", delay: str = "1 minute") -> DataFrame:
    """Candles emitted when their window closes; partial aggregation before the shuffle, one state row per open candle."""
    when = F.struct("ts_ms", "tick_id")
    return (
        with_event_time(ticks, delay)
        .groupBy(F.window("event_time", timeframe), "symbol")
        .agg(
            F.min_by("mid", when).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", when).alias("close"),
            F.sum("volume_24h").alias("volume"), F.count(F.lit(1)).alias("tick_count"),
        )
        .select("symbol", _ms("window.start").alias("start_ms"), _ms("window.end").alias("end_ms"), "open", "high", "low", "close", "volume", "tick_count")
    )


def stream_align(ticks: DataFrame, *, window: str = "1 second", delay: str = "1 second") -> DataFrame:
    """Last tick of each venue per tumbling window, emitted when the window closes."""
    return (
        with_event_time(ticks, delay)
        .groupBy(F.window("event_time", window), "symbol", "exchange_id")
        .agg(F.max_by(F.struct("mid", "volume_24h", "ts_ms", "tick_id"), F.struct("ts_ms", "tick_id")).alias("_t"))
        .select("symbol", "exchange_id", F.col("window.end").alias("window_end"), _ms("window.end").alias("window_end_ms"), "_t.*")
    )


class QuarantineProcessor(StatefulProcessor):
    """Per symbol: last known values, held venues and their streaks; judges the windows that arrive, in order."""

    def __init__(self, staleness_ms: int, cfg: ConsensusConfig) -> None:
        self.staleness_ms, self.cfg = staleness_ms, cfg

    def init(self, handle) -> None:
        self.memory = handle.getValueState("memory", "body string")

    def handleInputRows(self, key, rows, timerValues):
        held, streaks, known = json.loads(self.memory.get()[0]) if self.memory.exists() else ({}, {}, {})
        pdf = pd.concat(list(rows)).sort_values(["window_end_ms", "exchange_id"])
        out = []
        for end, group in pdf.groupby("window_end_ms", sort=True):
            for row in group.itertuples():
                known[row.exchange_id] = [row.mid, row.volume_24h, int(row.ts_ms), int(row.window_end_ms)]
            quotes = {v: (q[0], q[1]) for v, q in known.items() if q[3] == end or end - q[2] <= self.staleness_ms}
            price, used, divergent, quarantined, _ = judge_window(quotes, held, streaks, self.cfg)
            out.append((key[0], int(end), price, ",".join(used), ",".join(divergent), ",".join(quarantined)))
        self.memory.update((json.dumps([held, streaks, known], sort_keys=True),))
        yield pd.DataFrame(out, columns=["symbol", "window_end_ms", "consensus_mid", "used_sources", "divergent_sources", "quarantined_sources"])

    def close(self) -> None:
        pass


def stream_consensus(ticks: DataFrame, *, window: str = "1 second", delay: str = "1 second", staleness_ms: int = 15_000, cfg: ConsensusConfig = ConsensusConfig()) -> DataFrame:
    """Quarantine consensus per window. Only one row per venue and window reaches the stateful stage."""
    aligned = stream_align(ticks, window=window, delay=delay)
    return aligned.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=QuarantineProcessor(staleness_ms, cfg),
        outputStructType="symbol string, window_end_ms long, consensus_mid double, used_sources string, divergent_sources string, quarantined_sources string",
        outputMode="Append", timeMode="None",
    )


class WatchdogProcessor(StatefulProcessor):
    """Emits one HALT per silent episode of a key, when event time passes the limit without a tick."""

    def __init__(self, silence_ms: int) -> None:
        self.silence_ms = silence_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long")

    def _row(self, key, last: int) -> pd.DataFrame:
        return pd.DataFrame([(key[0], last, last + self.silence_ms, "HALT")], columns=["symbol", "last_ts_ms", "halt_ts_ms", "system_state"])

    def handleInputRows(self, key, rows, timerValues):
        seen = sorted(int(t) for pdf in rows for t in pdf["ts_ms"])
        before = self.last.get()[0] if self.last.exists() else None
        if before is not None:
            self.handle.deleteTimer(before + self.silence_ms)
        times = ([before] if before is not None else []) + [t for t in seen if before is None or t >= before]
        for a, b in zip(times, times[1:]):
            if b - a > self.silence_ms:
                yield self._row(key, a)
        if times:
            self.last.update((times[-1],))
            self.handle.registerTimer(times[-1] + self.silence_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.last.exists():
            last = self.last.get()[0]
            self.last.clear()
            yield self._row(key, last)

    def close(self) -> None:
        pass


def stream_watchdog(ticks: DataFrame, *, silence_ms: int = 30_000, delay: str = "1 second") -> DataFrame:
    timed = with_event_time(ticks.select("symbol", "ts_ms"), delay)
    return timed.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=WatchdogProcessor(silence_ms),
        outputStructType="symbol string, last_ts_ms long, halt_ts_ms long, system_state string",
        outputMode="Append", timeMode="EventTime",
    )


class GateProcessor(StatefulProcessor):
    """The decision gate of a key over scored ticks, in event order within each batch."""

    def __init__(self, cfg: GateConfig) -> None:
        self.cfg = cfg

    def init(self, handle) -> None:
        self.memory = handle.getValueState("gate", "state int, target int, streak int")

    def handleInputRows(self, key, rows, timerValues):
        now = tuple(self.memory.get()) if self.memory.exists() else (0, -1, 0)
        pdf = pd.concat(list(rows)).sort_values(["ts_ms", "tick_id"])
        level = {s: i for i, s in enumerate(SEVERITY)}
        states = []
        for wish in pdf["base_state"]:
            now = gate_step(*now, level[wish], self.cfg.streak)
            states.append(SEVERITY[now[0]])
        self.memory.update(now)
        yield pdf[["symbol", "ts_ms", "tick_id", "base_state"]].assign(system_state=states)

    def close(self) -> None:
        pass


def stream_gate(scored: DataFrame, *, cfg: GateConfig = GateConfig()) -> DataFrame:
    """State gate over a stream that carries trust, anomaly and regime; the base state is a column expression."""
    rows = scored.select("symbol", "ts_ms", "tick_id", gate_base_state(cfg=cfg).alias("base_state"))
    return rows.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=GateProcessor(cfg), outputStructType="symbol string, ts_ms long, tick_id long, base_state string, system_state string",
        outputMode="Append", timeMode="None",
    )


def stream_dedup(orders: DataFrame, key: str = "client_order_id", *, delay: str = "10 minutes") -> DataFrame:
    """First row of each order id; ids are remembered for the watermark delay."""
    return with_event_time(orders, delay).dropDuplicatesWithinWatermark([key]).drop("event_time")


def late_batch(path: str, delay_ms: int, keys: tuple[str, ...] = ("symbol",)):
    """A batch handler that counts, per key, the rows a watermark drops.

    The watermark of a batch is what all batches before it set: their latest event time less the delay. A row at or behind it is
    late, as for a stateful operator. Each batch commits the counts and then the mark for the next one, both by replacing its own
    folder, so a batch that is run again writes the same. Rows without a time set no mark and are never late.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = spark.read.parquet(f"{path}/mark/batch={batch_id - 1}").first()["mark_ms"] if batch_id else None
        late = batch.where(F.col("ts_ms") <= F.lit(mark).cast("long")).groupBy(*keys).agg(F.count(F.lit(1)).alias("late_rows"))
        late.write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        latest = F.greatest(F.max("ts_ms") - delay_ms, F.lit(mark).cast("long")).alias("mark_ms")
        batch.agg(latest).write.mode("overwrite").parquet(f"{path}/mark/batch={batch_id}")

    return handle


def audit_batch(path: str, layout: Layout = AUDIT, *, segment_rows: int = 100_000):
    """A batch handler that enriches audit messages and chains them across batches, one chain per key of ``layout``.

    The entries of a batch are a bucket of their chain (:func:`build_chain`) that starts from the head of the batch before it. The
    entries are written first and the heads of all keys after them; the next batch reads those. Both replace the batch's own
    folder, so a batch that is run again reads the same heads and writes the same entries. The heads table has one row per key.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, keys = batch.sparkSession, list(layout.keys)
        entries = audit_enrich(batch).fillna("unknown", ["event_type"])
        before = spark.read.parquet(f"{path}/heads/batch={batch_id - 1}") if batch_id else None
        chained, segments = build_chain(entries, layout, audit_text(), segment_rows=segment_rows, bucket=F.lit(batch_id), start=before)
        chained.write.mode("overwrite").parquet(f"{path}/entries/batch={batch_id}")
        heads = segments.groupBy(*keys).agg(F.max_by("tip", "segment").alias("head"))
        if before is not None:
            heads = before.join(heads, keys, "left_anti").unionByName(heads)
        heads.write.mode("overwrite").parquet(f"{path}/heads/batch={batch_id}")

    return handle


def audit_text() -> Column:
    """Text of an audit entry that goes into its hash."""
    names = ["tick_id", "event_type", "source_layer", "ts_ms", "trust_score", "anomaly_score", "system_state"]
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
