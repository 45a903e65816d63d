"""A cross-section of the registered queries against their SQL on the smallest sample."""

import pytest

from tests.oracle import connect, difference
from tidewatch.workload import load

SF = "/root/testdata/sf0.001"
NAMES = ["candles", "validated_tick", "decision_gate", "rsi", "risk_checks", "verify_chain", "alert_rules", "stream_candles", "normalize_okx", "trust_statistics", "stream_signals", "scan_kline_archive", "default_zero", "merge_deltas", "compare_runs", "write_equity_curve", "write_trade_ledger", "verify_segments", "stream_audit", "stream_late_counts", "counter_increase"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    queries, sql = load()
    assert difference(queries[name](spark, SF), connect(SF), sql[name]) is None


def test_every_sql_has_a_query():
    queries, sql = load()
    assert set(sql) <= set(queries) and len(queries) > 200
