"""A frequency baseline kept current from batches of events (E8): counts per window, never the events again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fleetscope.operators.rates import anomalies_of, window_counts
from fleetscope.sources.versioned import BucketedTable


class RunningBaseline:
    """Counts per (keys, window) under ``path``. A batch adds to the windows it has events of, late ones too, and counts once."""

    def __init__(self, spark: SparkSession, path: str, window: str = "1 day", keys: Sequence[T.StructField] | None = None, ts: str = "ts",
                 time: T.DataType | None = None, buckets: int = 16):
        self.window, self.ts = window, ts
        fields = list(keys or [T.StructField("node_id", T.StringType()), T.StructField("event_type", T.StringType())])
        self.keys = [f.name for f in fields]
        schema = T.StructType([*fields, T.StructField("window_start", time or T.TimestampNTZType()), T.StructField("events", T.LongType())])
        self.counts = BucketedTable(spark, path, schema, self.keys, buckets)

    def fold(self, events: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` step."""
        new = window_counts(events, self.window, self.keys, self.ts).persist()
        try:
            self.counts.fold(new, lambda held, more: held.unionByName(more).groupBy(*self.keys, "window_start").agg(
                F.sum("events").alias("events")), "events", batch_id)
        finally:
            new.unpersist()

    def forget(self, before) -> None:
        """Drop windows that no trailing baseline needs any more."""
        held = self.counts.read()
        self.counts.fold(held.select(*self.keys).distinct(), lambda now, _: now.filter(F.col("window_start") >= F.lit(before)), "forget",
                         self.counts.commit().batches.get("forget", -1) + 1)

    def anomalies(self, history: int = 7, k: float = 2.0) -> DataFrame:
        return anomalies_of(self.counts.read(), history, k, self.keys)
