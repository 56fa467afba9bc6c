"""The node registry kept current from streams of enrolment requests and heartbeats (G1, G3).

Nodes live in a table bucketed by machine id, what agents last reported in one
bucketed by node id: heartbeats come all the time and must not rewrite the
registry. Audit, health series and rejected heartbeats are append-only, one
folder a batch. They are written before the table's commit, and readers take
only the folders of committed batches, so each batch shows as a whole or not at
all, however often it is run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fleetscope.operators.registry import NODE_COLUMNS, apply_heartbeats, enroll
from fleetscope.sources.versioned import BucketedTable, Folder

NODE_TABLE = T.StructType([T.StructField(c, T.TimestampNTZType() if c in ("first_seen_at", "last_enrolled_at") else T.StringType())
                           for c in NODE_COLUMNS])
REPORTED = T.StructType([
    T.StructField("node_id", T.StringType()), T.StructField("agent_status", T.StringType()),
    T.StructField("recorded_at", T.TimestampNTZType()), T.StructField("event_id", T.LongType())])
AUDIT = ("event_id bigint, node_id string, event_type string, hostname string, os_version string, agent_version string, "
         "enrolled_at timestamp_ntz")
HEALTH = "health_id bigint, node_id string, agent_status string, events_buffered bigint, recorded_at timestamp_ntz"
REJECTED = "event_id bigint, node_id string, status string, events_buffered bigint, recorded_at timestamp_ntz, reason string"


class RegistryUpkeep:
    """Registry under ``path``. ``enrolments`` and ``heartbeats`` are ``foreachBatch`` functions."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        self.node_table = BucketedTable(spark, f"{self.path}/nodes", NODE_TABLE, ["machine_id"], buckets)
        self.reported = BucketedTable(spark, f"{self.path}/reported", REPORTED, ["node_id"], buckets)

    def enrolments(self, batch: DataFrame, batch_id: int) -> None:
        """Fold a batch of requests (as ``registry.enroll`` takes them). Newer host data than the batch's stays."""
        if self.node_table.seen("enrolments", batch_id):
            return
        batch = batch.persist()
        try:
            known = self.node_table.read(only=self._touched(batch, self.node_table))
            _, audit = enroll(known, batch)
            self._write(audit, "audit", batch_id)
            self.node_table.fold(batch, lambda current, new: enroll(current, new)[0], "enrolments", batch_id)
        finally:
            batch.unpersist()

    def heartbeats(self, batch: DataFrame, batch_id: int) -> None:
        """Fold a batch of heartbeats. Those of nodes that are not enrolled yet are rejected, as at the server's door."""
        if self.reported.seen("heartbeats", batch_id):
            return
        batch = batch.persist()
        try:
            _, health, rejected = apply_heartbeats(self.node_table.read(), batch)
            self._write(health, "health", batch_id)
            self._write(rejected, "rejected", batch_id)
            good = health.select("node_id", "agent_status", "recorded_at", F.col("health_id").alias("event_id"))
            self.reported.fold(good, newest_report, "heartbeats", batch_id)
        finally:
            batch.unpersist()

    def nodes(self) -> DataFrame:
        """The registry with each agent's last report; ``operator_status`` is the registry's own."""
        last = self.reported.read().select("node_id", F.col("agent_status").alias("__said"))
        return self.node_table.read().join(last, "node_id", "left").withColumn(
            "agent_status", F.coalesce("__said", "agent_status")).select(*NODE_COLUMNS)

    def audit(self) -> DataFrame:
        return self._read("audit", AUDIT, self.node_table, "enrolments")

    def health(self) -> DataFrame:
        return self._read("health", HEALTH, self.reported, "heartbeats")

    def rejected(self) -> DataFrame:
        return self._read("rejected", REJECTED, self.reported, "heartbeats")

    @staticmethod
    def _touched(batch: DataFrame, table: BucketedTable) -> list[int]:
        return [r[0] for r in batch.select(table.bucket()).distinct().collect()]

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch_id={batch_id}")

    def _read(self, name: str, schema: str, table: BucketedTable, stream: str) -> DataFrame:
        last = table.commit().batches.get(stream, -1)
        if last < 0 or not Folder(self.spark, f"{self.path}/{name}").names():
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, batch_id bigint").option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        return rows.filter(F.col("batch_id") <= last).drop("batch_id")


def newest_report(current: DataFrame, new: DataFrame) -> DataFrame:
    """One row a node, the newest by (time, id); a late heartbeat does not turn the clock back."""
    rows = current.unionByName(new)
    last = rows.groupBy("node_id").agg(F.max_by(F.struct("agent_status", "recorded_at", "event_id"), F.struct("recorded_at", "event_id")).alias("v"))
    return last.select("node_id", "v.agent_status", "v.recorded_at", "v.event_id")
