"""Streams that commit what the next batch starts from, run batch by batch and again after a failure."""

import json
import random
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import chain
from tidewatch.plans.layout import Layout
from tidewatch.streaming import operators as O
from tidewatch.streaming import held
from tidewatch.streaming.runs import drain_batches, file_stream
from tidewatch.streaming.scoring import _moving_stats, _window_stats


def messages(spark, ids):
    rows = [(i, json.dumps({"event_type": f"t{i % 2}", "source": "layer1", "timestamp_ms": 1000 + i})) for i in ids]
    return spark.createDataFrame(rows, "tick_id long, value string")


def test_audit_links_batches_and_a_replay_changes_nothing(spark, tmp_path):
    path, layout = str(tmp_path / "log"), Layout(keys=("event_type",), slot_ms=5)
    handle = O.audit_batch(path, layout, segment_rows=4)
    batches = [messages(spark, range(0, 20)), messages(spark, [21]), messages(spark, range(30, 45)), messages(spark, [])]
    for i, batch in enumerate(batches):
        handle(batch, i)
    log = lambda: sorted(tuple(r) for r in spark.read.parquet(f"{path}/entries").collect())
    first = log()
    assert len(first) == 36
    for i in (1, 2):
        handle(batches[i], i)
    assert log() == first
    stored = spark.read.parquet(f"{path}/entries")
    verdict = chain.verify_segments(stored, layout, O.audit_text())
    assert verdict.where("not passed").count() == 0
    # The second batch has entries of one type only; the other type is carried past it.
    assert {r.event_type for r in spark.read.parquet(f"{path}/heads/batch=3").collect()} == {"t0", "t1"}
    broken = chain.verify_segments(stored.where("batch <> 1"), layout, O.audit_text()).where("not passed").collect()
    assert [(r.event_type, r.segment) for r in broken] == [("t1", 2 * chain.PIECES)]


def test_late_counts_are_what_the_watermark_drops(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", O.STATE_STORE)
    rnd = random.Random(3)
    parts = [[(f"s{rnd.randrange(3)}", rnd.randrange(0, 40_000) + 10_000 * p, 1000 * p + i) for i in range(200)] for p in range(4)]
    folder, schema = str(tmp_path / "in"), "symbol string, ts_ms long, tick_id long"
    # A row exactly at the watermark is late too.
    parts[1].append(("edge", max(t for _, t, _ in parts[0]) - 5_000, 9_999))

    def arrivals():
        for part in parts:
            yield spark.createDataFrame(part, schema).coalesce(2).write.mode("append").parquet(folder)

    spark.createDataFrame([], schema).write.parquet(folder)
    drain_batches(file_stream(spark, folder, schema), O.late_batch(str(tmp_path / "out"), 5_000), arrivals())
    got = {(r.symbol, r.batch): r.late_rows for r in spark.read.parquet(str(tmp_path / "out" / "late")).collect()}
    want, mark = {}, None
    for p, part in enumerate(parts):
        for symbol, t, _ in part:
            if mark is not None and t <= mark:
                want[symbol, p] = want.get((symbol, p), 0) + 1
        mark = max([m for m in (mark, max(t for _, t, _ in part) - 5_000) if m is not None])
    assert got == want and got["edge", 1] == 1

    # What a stateful operator of Spark reports as dropped over the same arrivals.
    dropped = 0
    again = str(tmp_path / "again")
    spark.createDataFrame([], schema).write.parquet(again)
    stream = O.with_event_time(file_stream(spark, again, schema), "5 seconds").dropDuplicates(["tick_id", "event_time"])
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(2).write.mode("append").parquet(again)
        query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        dropped += sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress for op in json.loads(progress.json)["stateOperators"])
    assert dropped == sum(want.values())


class _Handle:
    """The state of one key, which counts the rows that move in and out of it."""

    def __init__(self):
        self.rows, self.timers, self.moved = [], [], 0

    def getListState(self, name, schema):
        return self

    def exists(self):
        return bool(self.rows)

    def appendValue(self, row):
        self.rows.append(row)
        self.moved += 1

    def get(self):
        self.moved += len(self.rows)
        return iter(list(self.rows))

    def clear(self):
        self.rows = []

    def registerTimer(self, at):
        self.timers.append(at)


@pytest.mark.parametrize("size", [7, 1_000])
def test_rows_wait_in_batches(monkeypatch, size):
    monkeypatch.setattr(held, "PASS", size)
    rnd = random.Random(5)
    rows = [(rnd.randrange(0, 1_000), i + 2**53, None if i % 9 == 0 else float(i)) for i in range(500)]
    handle, got = _Handle(), []
    waiting = held.HeldRows(handle, ("x",))
    for at, mark in ((0, 300), (250, 900), (500, 2_000)):
        waiting.add(iter([pd.DataFrame(rows[at:at + 250], columns=["ts_ms", "tick_id", "x"])] if at < 500 else []))
        due = sorted(r for r in rows[:at + 250] if r[0] < mark and r not in got)
        out = [(int(t), int(i), None if np.isnan(x) else x) for table in waiting.passed(mark) for t, i, x in table.itertuples(index=False)]
        assert [r[:2] for r in out] == [r[:2] for r in due] and {r[1]: r[2] for r in out} == {r[1]: r[2] for r in due}
        got += due
    assert len(got) == 500 and handle.rows == [] and list(waiting.passed(10_000)) == []
    assert handle.moved <= (10 if size == 1_000 else 200)


class _Store(_Handle):
    """The state of one key by name and user key; ``largest`` is the most bytes that ever lay under one of them."""

    def __init__(self):
        super().__init__()
        self.entries, self.largest, self.reads = {}, 0, 0

    def getListState(self, name, schema):
        return _Cell(self, name)

    getValueState = getListState

    def getMapState(self, name, key_schema, schema):
        return _Cell(self, name)

    def put(self, key, value):
        self.entries[key] = value
        self.largest = max(self.largest, sum(len(x) for row in value for x in row if isinstance(x, bytes)))


class _Cell:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def exists(self):
        return (self.name, None) in self.store.entries

    def get(self):
        rows = self.store.entries[self.name, None]
        return rows[0] if self.name not in ("held", "pieces") else iter(rows)

    def appendValue(self, row):
        self.store.put((self.name, None), [*self.store.entries.get((self.name, None), []), row])

    def update(self, row):
        self.store.put((self.name, None), [row])

    def clear(self):
        self.store.entries.pop((self.name, None), None)

    def keys(self):
        return iter([k for name, k in self.store.entries if name == self.name and k is not None])

    def getValue(self, key):
        self.store.reads += 1
        return self.store.entries[self.name, key][0]

    def updateValue(self, key, row):
        self.store.put((self.name, key), [row])

    def removeKey(self, key):
        del self.store.entries[self.name, key]


def test_a_busy_key_is_no_single_state_value(monkeypatch):
    """Ticks of one symbol lie in state as small entries, in whatever order they come, and those that wait longer are not read."""
    from tidewatch.operators.anomaly import GateConfig
    from tidewatch.streaming import signals

    for name, value in (("PASS", 300), ("RUN", 1_000), ("PIECE", 100)):
        monkeypatch.setattr(held, name, value, raising=False)
    rnd = random.Random(8)
    rows = [(rnd.randrange(10_000), i, 100.0 + rnd.random(), None if i % 7 == 0 else 2.0, 0.9, 0.1, 0) for i in range(6_000)]
    store = _Store()
    flow = signals.FlowProcessor(5, GateConfig())
    flow.init(store)
    got, due = [], lambda mark: sorted(r for r in rows if r[0] < mark)
    for at, mark in ((0, 3_000), (3_000, 3_001), (6_000, 20_000)):
        if at < 6_000:
            flow.held.add(pd.DataFrame(rows[i:i + 250], columns=signals._TICK_NAMES) for i in range(at, at + 3_000, 250))
        tables = list(flow.held.passed(mark))
        assert all(len(t) <= 300 for t in tables)
        passed = [(int(t), int(i)) for table in tables for t, i in table[["ts_ms", "tick_id"]].itertuples(index=False)]
        assert passed == sorted(passed)
        got += passed
        assert sorted(got) == [r[:2] for r in due(mark) if r[1] < at + 3_000]
        if at == 0:
            assert store.reads < 20 and store.timers[-1] == min(r[0] for r in rows[:3_000] if r[0] >= mark)
    assert store.largest <= 100 * 7 * 8 and len(got) == 6_000
    assert not list(flow.held.state.keys())


def test_moving_statistics_equal_separate_windows():
    rnd = np.random.default_rng(1)
    with warnings.catch_warnings(), np.errstate(all="ignore"):
        warnings.simplefilter("ignore")
        for case in range(200):
            n = int(rnd.integers(5, 400))
            size = int(rnd.integers(1, min(n, 60) + 1))
            x = rnd.normal(size=n) * 10.0 ** int(rnd.integers(-3, 6)) + 10.0 ** int(rnd.integers(0, 5))
            if case % 3 == 0:
                x[rnd.integers(0, n, n // 3)] = np.nan
            if case % 4 == 0:
                x[n // 4:n // 2] = 7.0
            if case % 5 == 0:
                x[n // 2] = 1e13
            if case % 11 == 0:
                x[0] = np.inf
            mean, sd = _moving_stats(x.copy(), size)
            want, spread = _window_stats(np.lib.stride_tricks.sliding_window_view(x, size))
            some, far = np.isfinite(want), spread > 1e-9 * np.abs(want)
            np.testing.assert_allclose(sd[some & far], spread[some & far], rtol=1e-7)
            off = np.abs(mean - want)[some]
            assert (off <= 1e-9 * np.nan_to_num(spread)[some] + 1e-9 * np.abs(want[some]).clip(1e-3)).all() or case % 5 == 0
            assert (sd[some & (spread == 0)] == 0).all()
