"""The plan shapes against brute force, with slots and chunks so small that every key is split many times."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.plans import anchors
from tidewatch.plans.asof import asof_join
from tidewatch.plans.fold import keyed_fold
from tidewatch.plans.frames import moments, range_moments
from tidewatch.plans.layout import Layout
from tidewatch.plans.quantiles import exact_quantiles
from tidewatch.plans.recurrence import Recurrence, horizon, recur
from tidewatch.plans.scans import Scan, index_rows, over_range, over_rows, previous, run_starts, running

LAYOUT = Layout(slot_ms=50, chunk_rows=16, fold_rows=16)


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 else rnd.choice(["a", "b"])
        rows.append((key, rnd.randrange(0, 3000), i, round(rnd.uniform(-5, 5), 3), rnd.random() < 0.3))
    return rows


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "symbol string, ts_ms long, tick_id long, x double, flag boolean").repartition(5)


def by_key(data):
    ordered = sorted(data, key=lambda r: (r[0], r[1], r[2]))
    return {k: list(g) for k, g in itertools.groupby(ordered, key=lambda r: r[0])}


def test_running_scans(frame, data):
    out = running(
        frame, LAYOUT, total=Scan("sum", F.col("x")), peak=Scan("max", F.col("x")), n=Scan("count"),
        seen=Scan("last", F.when(F.col("flag"), F.col("x"))), run=Scan("streak", F.col("flag")),
        low_before=Scan("min", F.col("x"), exclusive=True), ever=Scan("any", F.col("flag")),
    )
    got = {r.tick_id: r for r in out.collect()}
    for rows in by_key(data).values():
        total, peak, seen, run, low, ever = 0.0, None, None, 0, None, False
        for n, (_, _, i, x, flag) in enumerate(rows, 1):
            before = low
            total += x
            peak = x if peak is None else max(peak, x)
            low = x if low is None else min(low, x)
            seen = x if flag else seen
            run = run + 1 if flag else 0
            ever = ever or flag
            r = got[i]
            assert (r.n, r.peak, r.seen, r.run, r.low_before, r.ever) == (n, peak, seen, run, before, ever)
            assert r.total == pytest.approx(total)


def test_previous_and_index(frame, data):
    out = {r.tick_id: r for r in previous(index_rows(frame, LAYOUT), LAYOUT, before="x").collect()}
    for rows in by_key(data).values():
        last = None
        for n, (_, _, i, x, _) in enumerate(rows, 1):
            assert out[i]._rn == n and out[i].before == last
            last = x


def test_over_rows_matches_one_window(frame, data):
    out = over_rows(
        frame, LAYOUT, 7, lambda df, w: df.withColumn("avg7", F.avg("x").over(w.rowsBetween(-7, -1)))
    ).collect()
    assert len(out) == len(data)
    got = {r.tick_id: r.avg7 for r in out}
    for rows in by_key(data).values():
        for n, r in enumerate(rows):
            part = [q[3] for q in rows[max(0, n - 7):n]]
            want = sum(part) / len(part) if part else None
            assert got[r[2]] == (pytest.approx(want) if part else None)


@pytest.mark.parametrize("lagged", [False, True])
def test_moments(frame, data, lagged):
    steps = frame.withColumn("x", F.when(F.col("ts_ms") < 1500, F.lit(4.25)).otherwise(F.col("x")))
    out = over_rows(steps, LAYOUT, 7, lambda df, w: moments(df, w, 6, lagged=lagged, m="x")).collect()
    got = {r.tick_id: r.m for r in out}
    assert len(got) == len(data)
    for rows in by_key(data).values():
        xs = [4.25 if r[1] < 1500 else r[3] for r in rows]
        for i, r in enumerate(rows):
            part = xs[max(0, i - 6):i] if lagged else xs[max(0, i - 5):i + 1]
            m = got[r[2]]
            if not part:
                assert m is None
                continue
            assert m.n == len(part) and m.mean == pytest.approx(sum(part) / len(part))
            if len(part) > 1:
                assert m.sd == pytest.approx(pd.Series(part).std(), abs=1e-9)
                assert (m.sd == 0) == (len(set(part)) == 1)


def test_over_range(frame, data):
    out = over_range(
        frame, LAYOUT, 120, lambda df, w: df.withColumn("s", F.sum("x").over(w.rangeBetween(-120, 0)))
    ).collect()
    assert len(out) == len(data)
    for r in out:
        want = sum(q[3] for q in data if q[0] == r.symbol and r.ts_ms - 120 <= q[1] <= r.ts_ms)
        assert r.s == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, frame, data, strict):
    facts = spark.createDataFrame(
        [(k, t, t * 10) for k in ("hot", "a") for t in range(0, 3000, 37)], "symbol string, ts_ms long, v long"
    )
    out = asof_join(frame, facts, LAYOUT, {"v": "v"}, strict=strict, tolerance_ms=20).collect()
    assert len(out) == len(data)
    for r in out:
        t = r.ts_ms - (1 if strict else 0)
        hit = t - t % 37 if t >= 0 and r.symbol != "b" else None
        if hit is not None and r.ts_ms - hit > 20:
            hit = None
        assert r.v == (None if hit is None else hit * 10)


def test_recurrence_survives_splitting(spark):
    n, a = 9000, 0.8
    rows = [("hot", i, i, None if i < 3 else float((i * 37) % 11)) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, ts_ms long, tick_id long, b double")
    layout = Layout(slot_ms=1000, chunk_rows=10)
    assert 4 * horizon(a) < n * 2
    got = {r.tick_id: r.y for r in recur(df, layout, y=Recurrence("b", a)).collect()}
    y = None
    for _, _, i, b in rows:
        if b is not None:
            y = b if y is None else a * y + b
        assert got[i] == y


def test_keyed_fold_equals_sequential(frame, data):
    def fold(cols, state):
        level = float(state)
        out = []
        for x in cols["x"]:
            level = max(0.0, level + x)
            out.append(level)
            if level > 9:
                level = 0.0
        return {"level": out}, repr(level)

    got = {r.tick_id: r.level for r in keyed_fold(frame, LAYOUT, fold, "0.0", ["x"], "level double").collect()}
    assert len(got) == len(data)
    for rows in by_key(data).values():
        level = 0.0
        for r in rows:
            level = max(0.0, level + r[3])
            assert got[r[2]] == level
            level = 0.0 if level > 9 else level


def test_exact_quantiles(frame, data):
    spiked = frame.withColumn("x", F.when(F.col("tick_id") == 5, 1e12).otherwise(F.col("x")))
    out = {r.symbol: r for r in exact_quantiles(spiked, ["symbol"], "x", {"p5": 0.05, "p50": 0.5, "p95": 0.95}).collect()}
    near = {r.symbol: r for r in exact_quantiles(spiked, ["symbol"], "x", {"p50": 0.5}, method="nearest").collect()}
    for key, rows in by_key(data).items():
        s = pd.Series([1e12 if r[2] == 5 else r[3] for r in rows])
        for name, p in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95)):
            assert out[key][name] == pytest.approx(s.quantile(p))
        assert near[key].p50 == sorted(s)[round((len(s) - 1) * 0.5)]


def test_one_symbol_and_day_spreads(spark):
    from tidewatch.workload.ticks import LAYOUT as WORK

    rows = spark.range(20_000).select(F.lit("hot").alias("symbol"), (F.col("id") * 4_000).alias("ts_ms"), F.col("id").alias("tick_id"))
    out = rows.groupBy("symbol", WORK.slot()).count().collect()
    assert len(out) >= 8_000 and max(r["count"] for r in out) <= 3
    assert index_rows(rows, WORK).where(F.col("_rn") != F.col("tick_id") + 1).isEmpty()


@pytest.mark.parametrize("sigma", [3.0, 5.0])
def test_no_quantile_bin_holds_much_of_a_heavy_tail(spark, sigma, monkeypatch):
    from tidewatch.plans import quantiles

    rnd = random.Random(3)
    values = [rnd.lognormvariate(0.0, sigma) for _ in range(40_000)]
    held = {}

    def spy(df, layout, slot=None, **scans):
        held["most"] = df.groupBy(slot).count().agg(F.max("count")).first()[0]
        return running(df, layout, slot, **scans)

    monkeypatch.setattr(quantiles, "running", spy)
    got = exact_quantiles(spark.createDataFrame([(x,) for x in values], "x double"), [], "x", {"p50": 0.5, "p99": 0.99}).first()
    assert (got.p50, got.p99) == (pytest.approx(pd.Series(values).quantile(0.5)), pytest.approx(pd.Series(values).quantile(0.99)))
    assert held["most"] <= 400  # 1 %


def test_stored_tables_go_with_the_run(spark, tmp_path, monkeypatch):
    from tidewatch.plans import store

    monkeypatch.setattr(store, "shared_folder", lambda spark: str(tmp_path))
    assert store.materialise(spark.range(5)).count() == 5 and len([p for p in tmp_path.iterdir() if p.is_dir()]) == 1
    store.clear(spark)
    assert not [p for p in tmp_path.iterdir() if p.is_dir()]


def test_only_small_tables_are_broadcast(spark):
    from tidewatch.plans.store import broadcast_if_small

    def hinted(n):
        return "ResolvedHint" in broadcast_if_small(spark.range(n), 10)._jdf.queryExecution().analyzed().toString()

    assert hinted(10) and not hinted(11)


@pytest.mark.parametrize("size, fan", [(1, 2), (3, 2), (7, 1000), (1000, 1000)])
def test_machines_equal_a_plain_loop(spark, monkeypatch, size, fan):
    """Chunks of any length and groups of any number of chunks give what one pass over each key gives."""
    from tidewatch.plans import machine as P

    monkeypatch.setattr(P, "FAN", fan)
    step = lambda now, s: (now[0] + 1, s) if s == now[1] and now[0] < 4 else (0, s)
    made = P.Machine.of((0, 0), range(3), step, lambda now: f"{now[0]}:{now[1]}")
    rng = random.Random(size)
    rows = [(k, t, rng.choice([0, 0, 1, 2])) for k, n in (("hot", 60), ("cold", 5), ("one", 1)) for t in range(n)]
    want = {}
    for key in ("hot", "cold", "one"):
        now = (0, 0)
        for _, t, s in (r for r in rows if r[0] == key):
            now = step(now, s)
            want[key, t] = f"{now[0]}:{now[1]}"
    frame = spark.createDataFrame(rng.sample(rows, len(rows)), "symbol string, ts_ms long, s int").withColumn("tick_id", F.col("ts_ms"))
    out = P.machine_fold(frame, Layout(slot_ms=7, fold_rows=size), made, "s", "shown")
    assert {(r["symbol"], r["ts_ms"]): r["shown"] for r in out.collect()} == want
    assert P.machine_fold(frame.limit(0), Layout(slot_ms=7, fold_rows=size), made, "s", "shown").count() == 0


@pytest.mark.parametrize("reach", [1, 37, 400, 10_000])
def test_range_moments_equal_brute_force(spark, data, reach):
    rows = [(k, t if i % 50 else None, i, None if i % 11 == 0 else 1e6 + x) for k, t, i, x, _ in data]
    df = spark.createDataFrame(rows, "symbol string, ts_ms long, tick_id long, x double").repartition(5)
    out = range_moments(df, LAYOUT, reach, "x", "m")
    assert out.columns == ["symbol", "ts_ms", "tick_id", "x", "m"]
    got = {r.tick_id: r.m for r in out.collect()}
    assert len(got) == len(rows)
    for k, t, i, _ in rows:
        near = [x for k2, t2, _, x in rows if t is not None and t2 is not None and x is not None and k2 == k and t - reach < t2 <= t]
        assert got[i].n == len(near)
        if not near:
            assert (got[i].total, got[i].mean, got[i].sd) == (None, None, None)
            continue
        mean = sum(near) / len(near)
        sd = (sum((x - mean) ** 2 for x in near) / len(near)) ** 0.5
        assert got[i].total == pytest.approx(sum(near), rel=1e-12) and got[i].mean == pytest.approx(mean, rel=1e-13) and got[i].sd == pytest.approx(sd, abs=1e-6)


def test_range_moments_of_no_rows(spark):
    empty = spark.createDataFrame([], "symbol string, ts_ms long, tick_id long, x double")
    assert range_moments(empty, LAYOUT, 50, "x", "m").collect() == []


def test_range_moments_move_each_row_twice_and_only_wanted_columns(spark, frame):
    out = range_moments(frame.withColumn("wide", F.repeat(F.col("tick_id").cast("string"), 50)), LAYOUT, 400, "x", "m")
    plan = out.select("tick_id", "m.sd")._jdf.queryExecution().optimizedPlan().toString()
    moved = [line for line in plan.splitlines() if "Generate explode" in line or "Join" in line or "Window" in line]
    assert moved and not any("wide" in line for line in plan.splitlines())
    assert "array(true, false)" in plan or "[true,false]" in plan


@pytest.mark.parametrize("slot", [1, 50, 100_000])
def test_run_starts_equal_a_plain_loop(spark, data, slot):
    rows = [(k, t, i, flag or t % 700 < 300) for k, t, i, _, flag in data]
    df = spark.createDataFrame(rows, "symbol string, ts_ms long, tick_id long, holds boolean").repartition(5)
    got = {r.tick_id: r.since for r in run_starts(df, LAYOUT.with_(slot_ms=slot), "holds", "since").collect()}
    want = {}
    for _, group in by_key(rows).items():
        since = None
        for _, t, i, holds in group:
            since = (t if since is None else since) if holds else None
            want[i] = since
    assert got == want and any(v is not None for v in got.values())


@pytest.mark.parametrize("window, size, fan", [(0, 3, 2), (40, 1, 3), (40, 16, 2), (700, 2, 4), (10_000, 5, 100)])
def test_anchored_windows_equal_a_plain_loop(spark, data, monkeypatch, window, size, fan):
    monkeypatch.setattr(anchors, "FAN", fan)
    df = spark.createDataFrame([r[:3] for r in data], "symbol string, ts_ms long, tick_id long").repartition(5)
    out = anchors.anchor_fold(df, LAYOUT.with_(fold_rows=size), window, opened="opened", closes="closes")
    got = {r.tick_id: (r.opened, r.closes) for r in out.collect()}
    want = {}
    for group in by_key(data).values():
        start = None
        for _, t, i, *_ in group:
            start = t if start is None else start
            want[i] = (start, t - start >= window)
            start = None if want[i][1] else start
    assert got == want


def test_anchored_windows_never_wait_for_their_start(spark, monkeypatch):
    """Chunks far shorter than a window and ticks without a gap: the number of tables written does not grow with the chunks."""
    written = []
    monkeypatch.setattr(anchors, "materialise", lambda df, real=anchors.materialise: written.append(1) or real(df))
    for rows in (40, 400):
        written.clear()
        df = spark.createDataFrame([("a", 10 * i, i) for i in range(rows)], "symbol string, ts_ms long, tick_id long")
        out = anchors.anchor_fold(df, LAYOUT.with_(fold_rows=4), 1_005, opened="opened", closes="closes")
        assert out.where("closes").count() == rows // 102 and len(written) == 3


def test_workers_hand_memory_back(monkeypatch):
    import pyarrow as pa

    from tidewatch.plans import memory

    calls = []
    monkeypatch.setattr(memory, "hand_back", lambda: calls.append(1))
    monkeypatch.setattr(memory, "HAND_BACK", 1_000)
    monkeypatch.setattr(memory, "_seen", [0])
    run = memory.frugal(lambda rows: rows.slice(0, 1))
    rows = pa.table({"x": pa.array(range(50), pa.int64())})
    assert all(run(rows).num_rows == 1 for _ in range(10))
    assert len(calls) == 10 * rows.nbytes // 1_200


def test_groups_hand_memory_back(spark, frame, monkeypatch):
    """Every grouped function of the plans is wrapped."""
    from tidewatch.plans import fold, machine, recurrence

    for module in (fold, machine, recurrence, anchors):
        wrapped = []
        monkeypatch.setattr(module, "frugal", lambda run, real=module.frugal: wrapped.append(run) or real(run))
        monkeypatch.setattr(module, "materialise", lambda df: df, raising=False)
        if module is recurrence:
            recur(frame, LAYOUT, y=Recurrence("x", 0.5))
        elif module is machine:
            made = module.Machine.of(0, range(2), lambda s, x: (s + x) % 3, str)
            module.machine_fold(frame.withColumn("s", F.col("flag").cast("int")), LAYOUT, made, "s", "shown")
        elif module is anchors:
            anchors.anchor_fold(frame, LAYOUT, 40, opened="o", closes="c")
        else:
            keyed_fold(frame.limit(0), LAYOUT, lambda cols, state: ({"y": cols["x"]}, state), "", ["x"], "y double")
        assert len(wrapped) >= 1
