"""Sinks. Batch writes are idempotent: a batch that is written again replaces itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_by_class(df: DataFrame, path: str, batch_id: int, topic: str = "topic") -> None:
    """One folder per class inside the batch's own, payload and key as they came.

    The rebalance hint lets AQE split a class that dominates and merge small
    ones, so neither a single writer nor a flood of small files results.
    """
    df.hint("rebalance", F.col(topic)).write.mode("overwrite").partitionBy(topic).parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def write_logs(df: DataFrame, path: str, batch_id: int) -> None:
    """Append a batch of log rows; replaying the batch after a failure leaves no duplicates."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def write_alerts(df: DataFrame, path: str, batch_id: int, ts_ns: str = "timestamp_ns") -> None:
    """Append a batch of alerts, in folders by batch and by day."""
    day = F.expr(f"cast(timestamp_micros({ts_ns} div 1000) as date)")
    (df.withColumn("alert_date", day).hint("rebalance", F.col("alert_date"))
       .write.mode("overwrite").partitionBy("alert_date").parquet(f"{path.rstrip('/')}/batch_id={batch_id}"))
