"""User code on the record path, and splitting the two log kinds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from fleetscope.sources.sinks import write_logs

HOOK_SCHEMA = "key string, payload string, topic string, partition int, offset bigint, result string, error string"


def process_with(df: DataFrame, fn: Callable[[str, str, str, int, int], str | None]) -> DataFrame:
    """Run ``fn(key, payload, topic, partition, offset)`` on every record.

    Its return value lands in ``result``. A record on which it raises is skipped
    by the caller's rules but not lost: its message is in ``error``. ``df`` needs
    the five columns named as the arguments. Arrow batches flow through Python
    workers; no record is collected or shuffled.
    """
    def run(batches):
        import pandas as pd
        for pdf in batches:
            results, errors = [], []
            for key, payload, topic, partition, offset in zip(
                    pdf["key"], pdf["payload"], pdf["topic"], pdf["partition"], pdf["offset"]):
                try:
                    results.append(fn(key, payload, topic, partition, offset))
                    errors.append(None)
                except Exception as exc:  # the hook's failure is data here
                    results.append(None)
                    errors.append(f"{type(exc).__name__}: {exc}")
            yield pdf.assign(result=pd.Series(results, index=pdf.index, dtype="object"),
                             error=pd.Series(errors, index=pdf.index, dtype="object"))

    return df.select("key", "payload", "topic", F.col("partition").cast("int").alias("partition"),
                     F.col("offset").cast("bigint").alias("offset")).mapInPandas(run, HOOK_SCHEMA)


def split_processed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Processed records, and the quarantine of those on which the hook failed."""
    return df.filter(F.col("error").isNull()), df.filter(F.col("error").isNotNull())


def split_logs(df: DataFrame, source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Query results and status lines of a mixed log."""
    return df.filter(F.col(source) == "query_result"), df.filter(F.col(source) == "status_log")


def result_status_sink(results_path: str, status_path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes the two log kinds apart; replays replace themselves."""
    def write(df: DataFrame, batch_id: int) -> None:
        results, status = split_logs(df)
        write_logs(results, results_path, batch_id)
        write_logs(status, status_path, batch_id)
    return write
