"""Hand-computed cases of single rules, on tables of a few rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import align, anomaly, backtest, candles, chain, consensus, execution, indicators, metrics, risk, signals, trust
from tidewatch.plans.layout import Layout
from tidewatch.sources import messages, ticks as tick_files


def quote_windows(spark, *mids):
    rows = [("X", 1000 * (i + 1), v, m, 1.0) for i, line in enumerate(mids) for v, m in zip("abc", line)]
    df = spark.createDataFrame(rows, "symbol string, window_end_ms long, exchange_id string, mid double, volume_24h double")
    return consensus.windows(df)


def judged(spark, *mids):
    out = consensus.quarantine_consensus(quote_windows(spark, *mids)).orderBy("window_end_ms").collect()
    return out


def test_outlier_is_quarantined(spark):
    (row,) = judged(spark, (100.00, 100.05, 101.00))
    assert row.quarantined_sources == ["c"] and row.divergent_sources == ["c"]
    assert 100.0 <= row.consensus_mid <= 100.05


def test_release_and_escalation(spark):
    rows = judged(spark, (200.00, 200.01, 202.00), (200.02, 200.03, 200.04))
    assert rows[0].quarantined_sources == ["c"] and rows[1].quarantined_sources == []
    rows = judged(spark, *[(100.0, 100.01, 101.5)] * 3)
    assert [r.escalated_sources for r in rows] == [[], [], ["c"]]


def sequential_quarantine(lines):
    """Straight reading of the rule, kept apart from the operator's code."""
    held, streak, out = {}, {}, []
    med = lambda xs: sorted(xs)[len(xs) // 2] if len(xs) % 2 else sum(sorted(xs)[len(xs) // 2 - 1:len(xs) // 2 + 1]) / 2
    far = lambda m, c: c != 0 and abs(m - c) / abs(c) > 0.003
    for line in lines:
        free = {}
        for v, m in line.items():
            if v in held:
                held[v] = m
            else:
                free[v] = m
        c = med(list(free.values()) or list(held.values()))
        new = {v: m for v, m in free.items() if far(m, c)}
        for v in new:
            held[v] = free.pop(v)
            streak[v] = streak.get(v, 0) + 1
        c = med(list(free.values()) or list(held.values()))
        for v in list(held):
            if far(held[v], c):
                if v not in new:
                    streak[v] = streak.get(v, 0) + 1
            else:
                free[v] = held.pop(v)
                streak[v] = 0
        out.append((sorted(free), sorted(held)))
    return out


def test_quarantine_over_chunks_matches_sequential_reading(spark):
    rnd = random.Random(3)
    lines = []
    for _ in range(120):
        line = {v: 100 + rnd.choice([0, 0, 0, 0.6]) + rnd.random() / 100 for v in "abcd" if rnd.random() < 0.8}
        lines.append(line or {"a": 100.0})
    rows = [("X", i, v, m, 1.0) for i, line in enumerate(lines) for v, m in line.items()]
    df = consensus.windows(spark.createDataFrame(rows, "symbol string, window_end_ms long, exchange_id string, mid double, volume_24h double"))
    layout = Layout(order=("window_end_ms",), slot_ms=10, fold_rows=9)
    got = consensus.quarantine_consensus(df, layout).orderBy("window_end_ms").collect()
    assert [(r.used_sources, r.quarantined_sources) for r in got] == sequential_quarantine(lines)


def test_last_known_value(spark):
    rows = [("X", "b", 0, 1, 100.0), ("X", "a", 10, 2, 100.0), ("X", "a", 100, 3, 100.0), ("X", "a", 20_000, 4, 100.0)]
    t = spark.createDataFrame(rows, "symbol string, exchange_id string, ts_ms long, tick_id long, mid double")
    fields = ("tick_id", "ts_ms", "mid")
    latest = align.latest_by_venue(align.align_tumbling(t, window_ms=50, fields=fields), ["a", "b"], fields=fields)
    got = {(r.window_end_ms, r.exchange_id): r.age_ms for r in align.lkv_fill(latest).collect()}
    assert got[(50, "b")] == 0 and got[(150, "b")] == 150 and (20_050, "b") not in got and got[(20_050, "a")] == 0


def test_trust_terms(spark):
    df = spark.createDataFrame([(0.0, None, 1), (500.0, 2, 2), (1000.0, 10, 3)], "latency double, gap long, i int")
    got = df.orderBy("i").select(trust.t3_freshness(F.col("latency")).alias("t3"), trust.t4_sequence(F.col("gap")).alias("t4")).collect()
    assert [r.t3 for r in got] == pytest.approx([1.0, 0.5, 0.25]) and [r.t4 for r in got] == [1.0, 0.5, 0.0]
    quotes = spark.createDataFrame([([(100.0, 0), (101.0, 7500)],)], "quotes array<struct<mid: double, age_ms: long>>")
    t2 = quotes.select(trust.t2_agreement(F.col("quotes"), F.lit(100.0), F.lit(0.3)).alias("t2")).first().t2
    assert t2 == pytest.approx(2 / 3)


def test_gate_upgrades_on_tenth_tick(spark):
    wishes = ["DEGRADED", *["NORMAL"] * 10, "HALT", *["CONSERVATIVE"] * 12, *["NORMAL"] * 10]
    rows = [("X", i, i, w) for i, w in enumerate(wishes)]
    df = spark.createDataFrame(rows, "symbol string, ts_ms long, tick_id long, base_state string")
    for size in (5, 500):
        out = anomaly.decision_gate(df, Layout(slot_ms=7, fold_rows=size)).orderBy("ts_ms").collect()
        states = [r.system_state for r in out]
        assert states[:11] == ["DEGRADED"] * 10 + ["NORMAL"]
        assert states[11:24] == ["HALT"] * 13 and states[-2:] == ["HALT", "NORMAL"]


def scored(spark, rows):
    return spark.createDataFrame(rows, "symbol string, ts_ms long, tick_id long, mid double, volume_24h double, trust_score double, anomaly_score double")


def test_candle_boundaries(spark):
    t = scored(spark, [("X", ts, i, m, 1.0, 0.9, 0.1) for i, (ts, m) in enumerate([(0, 100.0), (60_000, 102.0), (120_000, 99.0), (300_000, 101.0)])])
    bars = {(r.timeframe_ms, r.start_ms): r for r in candles.candles(t).collect()}
    first = bars[(300_000, 0)]
    assert (first.open, first.high, first.low, first.close, first.tick_count, first.is_reliable) == (100.0, 102.0, 99.0, 99.0, 3, True)
    assert bars[(3_600_000, 0)].tick_count == 4 and bars[(300_000, 300_000)].discarded


def test_unreliable_streak_override(spark):
    rows = [("X", 300_000 * i, i, 100.0, 1.0, 0.9, 0.1) for i in range(50)]
    bars = candles.candles(scored(spark, rows), (300_000,))
    out = candles.unreliable_streak(bars, candles.CANDLES.with_(slot_ms=1_000_000)).orderBy("start_ms").collect()
    assert [r.consecutive_unreliable for r in out] == list(range(1, 51))
    assert out[-1].state_override == "DEGRADED" and out[-2].state_override is None


def test_order_flow(spark):
    for sign, side in ((1, "buy_volume"), (-1, "sell_volume")):
        rows = [("X", i, i, 100.0 + sign * i, 1.0, 0.9, 0.1) for i in range(60)]
        last = candles.order_flow_imbalance(scored(spark, rows)).orderBy(F.desc("ts_ms")).first()
        assert last.ofi == sign and last[side] == 50 and last.ofi_ticks == 50


def test_rsi_and_ema_against_plain_loops(spark):
    rnd = random.Random(1)
    closes = [100 + rnd.uniform(-2, 2) for _ in range(80)]
    rows = [("X", 60_000, i * 60_000, c, c + 1, c - 1) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "symbol string, timeframe_ms long, start_ms long, close double, high double, low double")
    got = indicators.rsi(indicators.ema(indicators.prepare(df), 12)).orderBy("start_ms").collect()
    ema = None
    for i, c in enumerate(closes):
        if i == 11:
            ema = sum(closes[:12]) / 12
        elif i > 11:
            ema += (c - ema) * 2 / 13
        assert got[i].ema == (None if ema is None else pytest.approx(ema))
    moves = [b - a for a, b in zip(closes, closes[1:])]
    gain, loss = sum(max(m, 0) for m in moves[:14]) / 14, sum(max(-m, 0) for m in moves[:14]) / 14
    assert got[13].rsi is None and got[14].rsi == pytest.approx(100 - 100 / (1 + gain / loss))
    for i in range(14, len(moves)):
        gain, loss = (gain * 13 + max(moves[i], 0)) / 14, (loss * 13 + max(-moves[i], 0)) / 14
        assert got[i + 1].rsi == pytest.approx(100 - 100 / (1 + gain / loss))


def test_scores_do_not_depend_on_splitting(spark):
    rnd = random.Random(5)
    price, rows = 100.0, []
    for i in range(400):
        price *= 1 + rnd.gauss(0, 2e-4) + (0.02 if i in (150, 310) else 0)
        rows.append(("hot" if i % 4 else "b", i * 1000, i, price, 0.9 if i % 50 > 10 else 0.5, 1.0 + i % 7, 0.01 + (i % 5) / 1000))
    df = spark.createDataFrame(rows, "symbol string, ts_ms long, tick_id long, mid double, trust_score double, volume_24h double, spread double")
    cfg = anomaly.ScoringConfig(
        absolute=anomaly.AbsoluteConfig(volume_window=40), mad=anomaly.MadConfig(window=30), vol_ratio=anomaly.VolRatioConfig(long_window=60),
        cusum=anomaly.CusumConfig(history=60), ewma=anomaly.EwmaConfig(lam=0.9995, history=60), rv_window_ms=20_000,
    )
    results = []
    for layout in (Layout(slot_ms=10**9, chunk_rows=10**6), Layout(slot_ms=9_000, chunk_rows=1, fold_rows=37)):
        out = anomaly.score_ticks(df, layout, cfg=cfg).orderBy("tick_id")
        results.append([(r.tick_id, round(r.anomaly_score, 9), r.reason, r.system_state, r.regime) for r in out.collect()])
    assert results[0] == results[1] and len(results[0]) == 400
    assert len({r[3] for r in results[0]}) > 1


def test_signal_chain(spark):
    names = ("rsi macd_histogram prev_histogram close bollinger_lower bollinger_upper ema_fast ema_slow ofi effective_state is_reliable crossed_up "
             "crossed_down h_start_ms h_rsi h_histogram h_prev_histogram h_middle h_close").split()
    long = dict(zip(names, (30.0, 0.2, 0.1, 99.0, 99.5, 105.0, 100.0, 100.1, 0.25, "NORMAL", True, True, False, 1, 40.0, 0.1, -0.1, 101.0, 99.0)))
    cases = [
        (long, "LONG", "FULL", "long signal"),
        ({**long, "effective_state": "HALT"}, "CLOSE_ALL", "NONE", "system_state=HALT"),
        ({**long, "effective_state": "DEGRADED"}, "HOLD", "NONE", "system_state=DEGRADED"),
        ({**long, "is_reliable": False}, "HOLD", "NONE", "primary candle not reliable"),
        ({**long, "ofi": 0.1}, "HOLD", "NONE", "OFI long gate failed"),
        ({**long, "h_start_ms": None}, "HOLD", "NONE", "missing higher timeframe snapshot"),
        ({**long, "rsi": 40.0, "prev_histogram": 0.3}, "HOLD", "NONE", "primary gate failed|rsi_ok,macd_ok"),
        ({**long, "h_rsi": 60.0}, "LONG", "PARTIAL", "long signal"),
    ]
    kinds = {"effective_state": "string", "is_reliable": "boolean", "crossed_up": "boolean", "crossed_down": "boolean", "h_start_ms": "long"}
    schema = "i int, " + ", ".join(f"{n} {kinds.get(n, 'double')}" for n in names)
    df = spark.createDataFrame([(i, *[c[0][n] for n in names]) for i, c in enumerate(cases)], schema)
    out = signals.trade_signal(df).withColumn("size", signals.position_size()).orderBy("i").collect()
    assert [(r.direction, r.confluence, r.reason) for r in out] == [c[1:] for c in cases]
    assert out[0].size == pytest.approx(0.2 * out[0].signal_strength) and out[7].size == pytest.approx(0.1 * out[7].signal_strength)


def test_breaker_pause_and_recovery(spark):
    rows = [("p", i, i, 1.0, "NORMAL", -0.001 if i < 5 else None) for i in range(40)]
    rows += [("p", 1_800_010 + i, 100 + i, 1.0, "NORMAL", None) for i in range(12)]
    df = spark.createDataFrame(rows, "portfolio string, ts_ms long, event_id long, equity double, upstream_state string, pnl double")
    for size in (6, 1000):
        out = risk.risk_breaker(df, risk.PORTFOLIO.with_(fold_rows=size)).orderBy("event_id").collect()
        states = [r.breaker_state for r in out]
        assert states[:5] == ["NORMAL", "NORMAL", "REDUCED", "REDUCED", "HALTED"]
        assert states[39] == "HALTED" and states[-12:] == ["HALTED"] * 9 + ["NORMAL"] * 3


def test_ledger_exits(spark):
    mids = [100.0, 101.0, 98.0, 98.0, 97.0, 99.5, 99.5]
    sides = ["LONG", None, None, "SHORT", None, "LONG", "CLOSE_ALL"]
    rows = [("X", i, i, m, s, 0.2, (m - 1.5) if s == "LONG" else (m + 1.9 if s else None), (m + 9) if s == "LONG" else (m - 9 if s else None))
            for i, (m, s) in enumerate(zip(mids, sides))]
    df = spark.createDataFrame(rows, "symbol string, ts_ms long, tick_id long, mid double, direction string, size_pct double, stop double, target double")
    for size in (2, 100):
        out = backtest.position_ledger(df, Layout(slot_ms=3, fold_rows=size)).orderBy("ts_ms").collect()
        assert [r.exit_reason for r in out] == [None, None, "STOP_HIT", None, None, "FLIP", "CLOSE_ALL"]
        assert out[2].realised == pytest.approx(0.2 * (98 - 100) / 100 - 0.0002)
        assert out[5].realised == pytest.approx(-0.2 * (99.5 - 98) / 98 - 0.0002) and out[6].realised == pytest.approx(-0.0002)
        assert [r.position for r in out] == pytest.approx([0.2, 0.2, 0, -0.2, -0.2, 0.2, 0])


def test_open_positions_close_at_the_end(spark):
    rows = [("X", i, i, m, s, 0.2, None, None) for i, (m, s) in enumerate([(100.0, "LONG"), (103.0, None), (101.0, "SHORT"), (99.0, None)])]
    rows += [("Y", 0, 7, 50.0, "LONG", 0.1, None, None), ("Y", 1, 8, 51.0, "CLOSE_ALL", None, None, None), ("Z", 0, 9, 10.0, "SHORT", 0.3, None, None)]
    df = spark.createDataFrame(rows, "symbol string, ts_ms long, tick_id long, mid double, direction string, size_pct double, stop double, target double")
    layout = Layout(slot_ms=3, fold_rows=2)
    out = backtest.close_at_end(backtest.position_ledger(df, layout), layout)
    ends = {r.symbol: r for r in out.where("closing = 1").collect()}
    assert set(ends) == {"X", "Z"} and all(r.exit_reason == "END_OF_RUN" and r.position == 0 and r.entry_price is None for r in ends.values())
    # a short of 0.2 opened at 101 and closed at 99; one that opens on the last tick pays both fees
    assert ends["X"].realised == pytest.approx(0.2 * 2 / 101 - 0.0002) and (ends["X"].ts_ms, ends["X"].tick_id, ends["X"].mid) == (3, 3, 99.0)
    assert ends["Z"].realised == pytest.approx(-0.0003)
    curve = backtest.equity_curve(out, layout.with_(order=("ts_ms", "tick_id", "closing")))
    final = {r.symbol: r.equity for r in curve.where("closing = 1").collect()}
    cash = {r.symbol: r.cash for r in out.groupBy("symbol").agg(F.sum("cash_change").alias("cash")).collect()}
    assert out.count() == 9 and final == pytest.approx({s: 1 + cash[s] for s in ends})
    assert backtest.close_at_end(backtest.position_ledger(df.limit(0), layout), layout).count() == 0


def test_sign_flip_p_value(spark):
    rnd = random.Random(2)
    rows = [("up", i, 1.0 + rnd.random()) for i in range(200)] + [("flat", i, rnd.uniform(-1, 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, tick_id long, step double").repartition(4)
    out = {r.k: r for r in backtest.permutation_test(df, ("k",), shuffles=300).collect()}
    assert out["up"].p_value == 0.0 and 0.02 < out["flat"].p_value < 0.98 and out["up"].steps == 200


def test_chain_finds_the_changed_entry(spark):
    rows = [("X", i * 10, i, f"m{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "symbol string, ts_ms long, tick_id long, body string")
    layout = Layout(slot_ms=70)
    stored, _ = chain.build_chain(df, layout, F.col("body"), segment_ms=10_000)
    clean = chain.verify_chain(stored, layout, F.col("body")).first()
    assert clean.bad_entries == 0 and clean.entries == 30
    changed = stored.withColumn("body", F.when(F.col("tick_id") == 17, "x").otherwise(F.col("body")))
    bad = chain.verify_chain(changed, layout, F.col("body")).first()
    assert (bad.first_bad, bad.first_problem, bad.bad_entries) == (17, "hash_mismatch", 1)
    cut = chain.verify_chain(stored.where("tick_id <> 9"), layout, F.col("body")).first()
    assert (cut.first_bad, cut.first_problem) == (10, "broken_link")


def test_chain_of_two_levels(spark):
    rows = [(k, t, t, f"{k}{t}") for k in "XY" for t in range(100)]
    df = spark.createDataFrame(rows, "symbol string, ts_ms long, tick_id long, body string").repartition(5)
    layout, body = Layout(slot_ms=7), F.col("body")
    stored, segments = chain.build_chain(df, layout, body, segment_ms=40, segment_rows=15)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for k in "XY":
        header = chain.GENESIS
        for b, first, end in [(0, 0, 15), (0, 15, 30), (0, 30, 40), (1, 40, 55), (1, 55, 70), (1, 70, 80), (2, 80, 95), (2, 95, 100)]:
            tip = header
            for t in range(first, end):
                want[k, t] = (tip, sha(f"{tip}|{k}{t}"))
                tip = want[k, t][1]
            header = sha(header + "|" + sha("".join(f"{k}{t}\n" for t in range(first, end))))
    assert {(r.symbol, r.tick_id): (r.previous_hash, r.current_hash) for r in stored.collect()} == want
    assert segments.count() == 16

    def failed(kept, **kw):
        return sorted((r.symbol, r.segment) for r in chain.verify_segments(kept, layout, body, **kw).where(~F.col("passed")).collect())

    gone = lambda number: ~((F.col("symbol") == "X") & (F.col("segment") == number))
    million = chain.PIECES
    assert failed(stored) == []
    assert failed(stored.where(gone(million))) == [("X", million + 1)]
    assert failed(stored.where(gone(0))) == [("X", 1)] and failed(stored.where(gone(0)), start=None) == []
    rewritten = stored.withColumn("body", F.when((F.col("symbol") == "Y") & (F.col("tick_id") == 20), "new").otherwise(body))
    assert failed(rewritten) == [("Y", 1), ("Y", 2)]
    more, _ = chain.build_chain(df.where("tick_id < 10").withColumn("ts_ms", F.col("ts_ms") + 120), layout, body, segment_ms=40, segment_rows=15,
                                start=segments.groupBy("symbol").agg(F.max_by("tip", "segment").alias("head")))
    assert failed(stored.unionByName(more)) == []
    assert chain.build_chain(df.limit(0), layout, body)[0].count() == 0


def test_matching_pairs_copies_one_to_one(spark):
    schema = "row_id long, symbol string, exchange_id string, mid double, volume_24h double, score double"
    e = spark.createDataFrame([(i, "X", "a", 100.0, 1.0, 0.5) for i in range(50)], schema)
    p = spark.createDataFrame([(100 + i, "X", "a", 100.0 + 4e-7, 1.0, 0.5) for i in range(40)] + [(999, "X", "a", 107.0, 1.0, 0.5)], schema)
    got = [(r["class"], r.row_id, r.p_id) for r in align.match_validated(e, p, slot=7).collect()]
    hits = [g for g in got if g[0] == "matched"]
    assert len(hits) == 40 and len({h[1] for h in hits}) == 40 and len({h[2] for h in hits}) == 40
    assert sum(g[0] == "unmatched" for g in got) == 10 and [g for g in got if g[0] == "missing"] == [("missing", None, 999)]


def test_fill_cost_and_divergence(spark):
    df = spark.createDataFrame([("LONG", 0.6, 100.0, 1.0), ("SHORT", 0.2, 100.0, 1.0)], "direction string, size_pct double, reference_price double, portfolio_value double")
    out = {r.direction: r for r in execution.fill_cost(df).collect()}
    assert (out["LONG"].filled_pct, out["LONG"].fill_note) == (0.5, "partial") and out["LONG"].fill_price == pytest.approx(100.05)
    assert out["SHORT"].fill_price == pytest.approx(99.95) and out["SHORT"].fee_paid == pytest.approx(0.2 * 0.00075)


def test_messages(spark):
    raw = ['{"data":{"b":"1","a":"2","c":"1.5","v":"9","E":1700000000123,"s":"btcusdt"}}', '{"b":"1","a":"2"}', "not json"]
    df = spark.createDataFrame([(r, 5) for r in raw], "raw string, received_ts_ms long")
    (row,) = messages.normalize_binance(df).collect()
    assert (row.symbol, row.bid, row.ask, row.exchange_ts_ms) == ("BTC-USDT", 1.0, 2.0, 1700000000123)
    kraken = spark.createDataFrame([('[1,{"a":["2"],"b":["1"],"c":["1.5"],"v":["3","4"]},"ticker","XBT/USDT"]', 7), ('{"event":"x"}', 7)], "raw string, received_ts_ms long")
    (row,) = messages.normalize_kraken(kraken).collect()
    assert (row.symbol, row.volume_24h, row.exchange_ts_ms, row.timestamp_source) == ("BTC-USDT", 4.0, 7, "receive")


def test_csv_needs_every_field(spark, tmp_path):
    (tmp_path / "t.csv").write_text("timestamp_utc,exchange,symbol,bid,ask,last,volume\n2024-01-01T00:00:00Z,a,X,1,2,1.5,3\n")
    (row,) = tick_files.scan_csv_ticks(spark, str(tmp_path / "t.csv")).collect()
    assert (row.ts_ms, row.bid, row.volume) == (1704067200000, 1.0, 3.0)
    (tmp_path / "u.csv").write_text("timestamp_utc,exchange\n1,a\n")
    with pytest.raises(ValueError, match="symbol"):
        tick_files.scan_csv_ticks(spark, str(tmp_path / "u.csv"))


def test_kline_archive_files(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("k.csv", "open_time,o,h,l,c,v,ct\n1700000000000,1,3,0.5,2,10,1700000059999\n17,bad\n")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    (row,) = tick_files.scan_kline_archive(spark, str(tmp_path)).collect()
    assert (row.open_time_ms, row.high, row.close) == (1700000000000, 3.0, 2.0)


def test_walk_forward(spark):
    day = 86_400_000
    rows = backtest.walk_forward_windows(0, 3 * day, spark, fold_days=1).collect()
    assert [(r.start_ms, r.end_ms) for r in rows] == [(0, day), (day, 2 * day), (2 * day, 3 * day)]
    with pytest.raises(ValueError):
        backtest.walk_forward_windows(0, 2 * day, spark, fold_days=1)


def test_kline_archive_keeps_good_lines_and_names_bad_ones(spark, tmp_path):
    import zipfile

    from tidewatch.sources.ticks import scan_kline_archive, scan_kline_rejects

    lines = "open_time,o,h,l,c,v,t\n1704067200000,1,2,0.5,1.5,9,1704070799999\n1704070800000,1,2,0.5,1.5\n1704074400000,1,2\n1704078000000,1,x,0.5,1.5,9,1\n"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("k.csv", lines)
    (tmp_path / "b.zip").write_bytes(b"no archive")
    good = {r["open_time_ms"]: (r["close"], r["volume"]) for r in scan_kline_archive(spark, str(tmp_path)).collect()}
    assert good == {1_704_067_200_000: (1.5, 9.0), 1_704_070_800_000: (1.5, None)}
    bad = sorted((r["path"][-5:], r["line"]) for r in scan_kline_rejects(spark, str(tmp_path)).collect())
    assert bad == [("a.zip", 4), ("a.zip", 5), ("b.zip", 1)]


def test_stream_features_do_not_depend_on_how_rows_arrive():
    import json

    import numpy as np
    import pandas as pd

    from tidewatch.operators.anomaly import ScoringConfig
    from tidewatch.streaming.scoring import FeatureProcessor

    rnd, n = np.random.default_rng(3), 1700
    rows = pd.DataFrame({"ts_ms": np.arange(n) // 2 * 2_000, "tick_id": np.arange(n), "mid": 100 + rnd.normal(size=n), "trust_score": 0.9, "volume_24h": rnd.uniform(1, 9, n), "spread": 0.01})

    def run(size):
        memory, out = {"n": 0, "mid": None, "rows": [], "times": [], "squares": [], "rv": [], "up": 0.0, "down": 0.0, "price": None, "spread": None}, []
        for i in range(0, n, size):
            out.append(FeatureProcessor(ScoringConfig()).features(rows.iloc[i:i + size].reset_index(drop=True), memory))
            memory = json.loads(json.dumps(memory))
        return pd.concat(out, ignore_index=True), memory

    (whole, _), (parts, memory) = run(n), run(250)
    numbers = [c for c in whole.columns if c != "_recent"]
    np.testing.assert_allclose(whole[numbers].to_numpy(float), parts[numbers].to_numpy(float), atol=1e-9)
    assert whole["_rn"].tolist() == list(range(1, n + 1)) and len(memory["rows"]) == 1000 and len(memory["times"]) <= 1802
    square = whole["ret"] ** 2
    assert whole["rv"].iloc[-1] == pytest.approx(np.sqrt(square[rows["ts_ms"] >= rows["ts_ms"].iloc[-1] - 1_800_000].sum()))
    assert whole["_med"].iloc[-1] == pytest.approx(whole["ret"].iloc[-100:].median())


def test_klines_of_all_symbols_are_archived_read_and_converted(spark):
    from tidewatch.workload import connectors

    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, connectors.klines(spark, sf).select("symbol", "open_time_ms", "close", "volume").collect()))
    assert len({w[0] for w in want}) == 4
    assert sorted(map(tuple, connectors.archived_klines(spark, sf).select("symbol", "open_time_ms", "close", "volume").collect())) == want
    assert sorted(map(tuple, connectors.all_kline_ticks(spark, sf).select("symbol", "ts_ms").collect())) == [w[:2] for w in want]
    hours = [w[:2] for w in want if w[1] // 3_600_000 % 5]
    assert sorted(map(tuple, connectors.all_kline_candles(spark, sf).select("symbol", "start_ms").collect())) == hours


def test_rules_are_compiled_into_series(spark):
    rules = [
        metrics.Rule("gauge", "up", "==", 0.0, 20, "high", label="job", matches="layer.*"),
        metrics.Rule("grown", "c_total", ">", 4.0, 0, "high", over="increase", range_ms=30),
        metrics.Rule("speed", "c_total", ">", 100.0, 0, "high", over="rate", range_ms=20),
        metrics.Rule("share", "used", ">", 0.5, 0, "high", other="limit"),
        metrics.Rule("slow", "ms_bucket", ">", 12.0, 0, "high", over="rate", range_ms=1000, quantile=0.5),
    ]
    rows = [("up", {"job": j}, t, v) for j, vs in (("layer1", [1, 0, 0, 0, 1, 0]), ("node", [0] * 6)) for t, v in enumerate(vs)] + [("up", {}, 0, 0)]
    rows += [("c_total", {"x": "1"}, t, v) for t, v in enumerate([0, 3, 5, 1, 4])]
    rows += [("used", {"m": "1"}, t, v) for t, v in enumerate([6, 2, 1, 0])] + [("limit", {"m": "1"}, t, v) for t, v in enumerate([10, 10, 0, 0])] + [("used", {"m": "2"}, 0, 9)]
    rows += [("ms_bucket", {"le": le, "s": "a"}, t, n * t) for le, n in (("10", 1), ("20", 3), ("+Inf", 4)) for t in (0, 1)]
    rows = [(m, labels, 10 * t, float(v)) for m, labels, t, v in rows]
    df = spark.createDataFrame(rows, "metric string, labels map<string, string>, ts_ms long, value double").repartition(3)
    layout = metrics.SERIES.with_(slot_ms=15)
    out = {(r.alert, r.series, r.ts_ms // 10): r for r in metrics.alert_rules(df, metrics.rule_table(spark, rules), layout).collect()}
    value = lambda a, s: [out[a, s, t].value for t in range(6) if (a, s, t) in out]
    assert {k[:2] for k in out} == {("gauge", "job=layer1"), ("grown", "x=1"), ("speed", "x=1"), ("share", "m=1"), ("share", "m=2"), ("slow", "s=a")}
    assert [out["gauge", "job=layer1", t].firing for t in range(6)] == [False, False, False, True, False, False]
    assert value("grown", "x=1") == [0.0, 3.0, 5.0, 6.0, 6.0] and value("speed", "x=1") == [0.0, 150.0, 250.0, 150.0, 200.0]
    assert [out["grown", "x=1", t].firing for t in range(5)] == [False, False, True, True, True]
    assert value("share", "m=1") == [0.6, 0.2, float("inf"), None] and value("share", "m=2") == [None]
    assert [out["share", "m=1", t].firing for t in range(4)] == [True, False, True, False]
    assert value("slow", "s=a") == [None, 15.0]
    assert metrics.alert_rules(df.limit(0), metrics.rule_table(spark, rules), layout).count() == 0
    assert len({r.alert for r in metrics.RULES}) == 22


def test_rows_of_rules_move_without_text(spark):
    rows = [("c_total", {"x": str(i % 2)}, 10 * i, float(i)) for i in range(40)] + [("up", {"job": "layer1"}, 10 * i, 0.0) for i in range(9)]
    df = spark.createDataFrame(rows, "metric string, labels map<string, string>, ts_ms long, value double")
    rules = [metrics.Rule("gauge", "up", "==", 0.0, 20, "high"), metrics.Rule("grown", "c_total", ">", 4.0, 0, "high", over="increase", range_ms=30)]
    out = metrics.alert_rules(df, metrics.rule_table(spark, rules), metrics.SERIES.with_(slot_ms=15))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" in plan
    assert not any(text in line for line in plan.splitlines() if "Exchange hashpartitioning" in line for text in ("series", "alert", "role"))
    assert out.count() == 49


@pytest.mark.parametrize("rows_of_chunk", [4, 40, 100_000])
def test_rules_over_chunks_equal_a_plain_reading(spark, monkeypatch, rows_of_chunk):
    """Ranges, resets, missing values, equal times, gaps, runs and label sets without a value, whatever the length of the chunks; no window over samples."""
    import math
    import random

    from tidewatch.operators import alerting

    monkeypatch.setattr(alerting, "CHUNK_ROWS", rows_of_chunk)
    rnd = random.Random(rows_of_chunk)
    rules = [
        metrics.Rule("grown", "c_total", ">", 6.0, 40, "high", over="increase", range_ms=64),
        metrics.Rule("speed", "c_total", ">", 100.0, 0, "high", over="rate", range_ms=20),
        metrics.Rule("share", "used", ">", 0.5, 30, "high", over="increase", range_ms=32, other="limit"),
        metrics.Rule("gauge", "up", "==", 0.0, 25, "high"),
        metrics.Rule("strict", "up", "==", 0.0, 90, "low"),
        metrics.Rule("slow", "ms_bucket", ">", 12.0, 0, "high", over="increase", range_ms=128, quantile=0.5),
    ]
    rows, n = [], {}
    for t in sorted({rnd.randrange(600) for _ in range(170)} | {1_500, 1_501, 4_000}):
        for x in "12":
            n[x] = 0 if rnd.random() < 0.1 else n.get(x, 0) + rnd.randrange(4)
            rows += [("c_total", {"x": x}, t, None if rnd.random() < 0.05 else float(n[x]))]
            if rnd.random() < 0.8:
                rows += [("used", {"x": x}, t, float(n[x] // 2)), ("limit", {"x": x}, t, float(n[x]))]
        rows += [("up", {"job": "a"}, t, None if t % 31 == 0 else float(t // 60 % 3 == 0)), ("up", {"a": None, "b": "1"}, t, 1.0), ("up", {"a": "1", "b": None}, t, 0.0)]
        rows += [("up", {"job": "a"}, t, 0.0)] * (t % 13 == 0)
        rows += [("ms_bucket", {"le": le, "s": "a"}, t, float(k * t)) for k, le in ((1, "10"), (3, "20"), (4, "+Inf"))]
    rows += [("up", {"job": "a"}, None, 0.0), ("c_total", {"x": "1"}, None, 3.0)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "metric string, labels map<string, string>, ts_ms long, value double").repartition(3)
    out = metrics.alert_rules(df, metrics.rule_table(spark, rules), metrics.SERIES.with_(slot_ms=8))
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()

    def grown(curve, reach):
        """Growth by time of one curve of (time, value)."""
        curve, steps = sorted(curve, key=lambda p: (p[0], math.inf if p[1] is None else p[1])), []
        for (_, was), (t, v) in zip(curve, curve[1:]):
            steps.append((t, 0.0 if v is None or was is None else v if v < was else v - was))
        return {t: sum(s for at, s in steps if t - reach < at <= t) for t, _ in curve}

    def curves(metric, drop=()):
        found = {}
        for m, labels, t, v in rows:
            if m == metric:
                key = tuple(sorted((k, x) for k, x in labels.items() if k not in drop and x is not None)) if not drop else labels["le"]
                found.setdefault(key, []).append((t, v))
        return found

    want = {}
    for rule in rules:
        series = {}
        if rule.alert == "slow":
            cells = {float(le.replace("+Inf", "inf")): grown(c, rule.range_ms) for le, c in curves(rule.metric, ("le",)).items()}
            points = {}
            for t in cells[10.0]:
                total = cells[math.inf][t]
                le, low, before = next((le, low, b) for le, low, b in ((10.0, 0.0, None), (20.0, 10.0, 10.0), (math.inf, 20.0, 20.0)) if cells[le][t] >= total / 2)
                inside = cells[le][t] - (cells[before][t] if before else 0.0)
                points[t] = (20.0 if le == math.inf else low + (le - low) * (total / 2 - (cells[before][t] if before else 0.0)) / inside) if total else None
            series["s=a"] = points
        else:
            other = curves(rule.other) if rule.other else {}
            for key, curve in curves(rule.metric).items():
                timed = [p for p in curve if p[0] is not None]
                if rule.over == "value":
                    points = {t: max((v for at, v in curve if at == t and v is not None), default=None) for t, _ in curve}
                else:
                    points = grown(timed, rule.range_ms) | {t: 0.0 for t, _ in curve if t is None}
                if rule.over == "rate":
                    points = {t: v / (rule.range_ms / 1000.0) for t, v in points.items()}
                if rule.other:
                    below = grown(other[key], rule.range_ms)
                    points = {t: v / below[t] if below[t] else math.inf if v > 0 else None for t, v in points.items()}
                series[",".join(f"{k}={x}" for k, x in key)] = points
        for name, points in series.items():
            since = None
            for t in sorted(points, key=lambda t: math.inf if t is None else t):
                v = points[t]
                holds = v is not None and (v > rule.threshold if rule.op == ">" else v == rule.threshold)
                if t is not None:
                    since = (t if since is None else since) if holds else None
                want[rule.alert, name, t] = (v, holds, since if t is not None else None, None if holds and t is None else holds and t - since >= rule.hold_ms)
    got = {(r.alert, r.series, r.ts_ms): (r.value, r.holds, r.active_since_ms, r.firing) for r in out.collect()}
    assert got.keys() == want.keys()
    for key, row in got.items():
        assert row[1:] == want[key][1:] and row[0] == (want[key][0] if want[key][0] is None else pytest.approx(want[key][0], rel=1e-12)), (key, row, want[key])
    assert sum(w[3] is True for w in want.values()) > 50
    rules.append(metrics.Rule("gauge", "up", "==", 1.0, 0, "low"))
    points = metrics.rule_series(df, metrics.rule_table(spark, rules), metrics.SERIES.with_(slot_ms=8))
    assert points.count() == len(got)
    assert {(r.alert, r.series, r.ts_ms): r.value for r in points.collect()} == {key: row[0] for key, row in got.items()}


def test_label_sets_of_the_platform_are_built_once(spark):
    from tidewatch.workload import reporting

    df = reporting.platform_samples(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map(exchange,") <= 10 and df.count() == len(reporting.PLATFORM) * 1_000


def test_regimes_are_decoded_without_an_object_per_row():
    """Lists of growing length against a decoder of single lists; the decoder takes and gives Arrow arrays."""
    import math

    import numpy as np
    import pyarrow as pa

    model = anomaly.RegimeModel(window=5)
    decode = anomaly._last_state(model).func
    values = np.random.default_rng(2).uniform(0.0005, 0.004, 40).tolist()
    lists = [values[max(0, i - 4):i + 1] for i in range(40)]
    out = decode(pa.array(lists, pa.list_(pa.float64()))).to_pylist()
    density = lambda x, k: -math.log(model.sds[k]) - 0.5 * math.log(2 * math.pi) - ((x - model.means[k]) / model.sds[k]) ** 2 / 2
    stay = [[model.stay[0], 1 - model.stay[0]], [1 - model.stay[1], model.stay[1]]]
    for xs, got in zip(lists, out):
        f = [model.start[k] * math.exp(density(xs[0], k)) for k in (0, 1)]
        best = list(f)
        for x in xs[1:]:
            f = [math.exp(density(x, k)) * sum(f[j] * stay[j][k] for j in (0, 1)) for k in (0, 1)]
            best = [math.exp(density(x, k)) * max(best[j] * stay[j][k] for j in (0, 1)) for k in (0, 1)]
        assert got["regime"] == int(best[1] > best[0]) and got["high"] == pytest.approx(f[1] / (f[0] + f[1]), abs=1e-9)


def test_regime_decoder_hands_memory_back(spark, monkeypatch):
    """A worker that decodes batch after batch gives freed memory back as it goes, not at its end."""
    import pyarrow as pa

    from tidewatch.plans import memory

    batch = pa.array([[0.002] * 5] * 40, pa.list_(pa.float64()))
    calls = []
    monkeypatch.setattr(memory, "hand_back", lambda: calls.append(1))
    monkeypatch.setattr(memory, "HAND_BACK", 3 * batch.nbytes)
    monkeypatch.setattr(memory, "_seen", [0])
    decode = anomaly._last_state(anomaly.RegimeModel(window=5)).func
    assert all(len(decode(batch)) == 40 for _ in range(12))
    assert len(calls) == 4
