"""Tables of backtest results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_run_results(runs: DataFrame, events: DataFrame, path: str) -> None:
    """Upsert run rows and replace the scoring events of the same runs: only the written ``run_id`` partitions change."""
    for name, df in (("runs", runs), ("events", events)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}")


def list_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run ids, newest first."""
    rows = spark.read.option("basePath", f"{path}/runs").parquet(f"{path}/runs")
    return rows.groupBy("run_id").agg(F.max("created_ms").alias("created_ms")).orderBy(F.desc("created_ms"), F.desc("run_id"))


CURVE = ["ts_ms", "symbol", "state", "risk_state", "signal_direction", "signal_size_pct", "position", "position_size_pct", "anomaly_score", "gross_pnl", "net_pnl", "equity_gross", "equity_net"]
LEDGER = ["trade_id", "client_order_id", "signal_ts", "submit_ts", "ack_ts", "first_fill_ts", "last_fill_ts", "fill_price", "fill_fraction", "side", "size_pct", "fee", "slippage_pct", "final_state", "exit_reason", "net_pnl"]


def _write_csv(df: DataFrame, columns: list[str], path: str) -> None:
    have = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    df.select(*have).write.mode("overwrite").option("header", True).csv(path)


def write_equity_curve(curve: DataFrame, path: str) -> None:
    _write_csv(curve, CURVE, path)


def write_trade_ledger(trades: DataFrame, path: str) -> None:
    _write_csv(trades, LEDGER, path)
