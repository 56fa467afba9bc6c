"""Streaming forms of the operators.

Each function takes or returns a streaming DataFrame; the caller picks trigger
and sink. Event time is an argument, and so is the watermark: agents do not
repair clock jumps, so how late a row may be is the operator's decision.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetscope.operators.envelope import decode_envelope, route_class, sanitise_status, split_malformed
from fleetscope.operators.joins import HOST, enrich_events
from fleetscope.operators.registry import has_id
from fleetscope.sources.events import read_events_stream
from fleetscope.sources.versioned import BucketedTable, Folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of the state store. Counting all rows that it holds would cost a lookup for each row that is written or removed.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
               "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a TIMESTAMP; times without zone are read as UTC session time."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append", partition_by: Sequence[str] = ()) -> None:
    """Process everything available into a parquet folder (exactly once) and stop."""
    writer = (df.writeStream.format("parquet").outputMode(mode).option("path", path)
              .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start().awaitTermination()


def run_batches(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything available through ``write(batch, batch_id)`` and stop."""
    (df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
       .trigger(availableNow=True).start().awaitTermination())


def replace_table(path: str, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer for complete mode: each batch is the whole result, in a folder of its own.

    A crash leaves the result before it in place; a batch that is run again
    replaces its own folder. The ``keep`` newest results stay, for readers that
    are at one of them; older ones go. ``read_replaced`` takes the newest finished one.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        folder = Folder(batch.sparkSession, path)
        for old in [n for n in finished_batches(folder) if n <= batch_id][:-keep]:
            folder.delete(f"batch_id={old}")
    return write


def finished_batches(folder: Folder) -> list[int]:
    """Numbers of the batch folders that were written to their end, oldest first."""
    found = [int(n.removeprefix("batch_id=")) for n in folder.names() if n.startswith("batch_id=")]
    return sorted(n for n in found if "_SUCCESS" in folder.names(f"batch_id={n}"))


def read_replaced(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole result of ``replace_table``; no other folder is looked into."""
    return spark.read.parquet(f"{path}/batch_id={finished_batches(Folder(spark, path))[-1]}")


def route_stream(spark: SparkSession, conf, prefix: str = "") -> DataFrame:
    """Source to routed envelopes, ready for a sink partitioned by ``topic``.

    ``conf`` is that of ``read_events_stream``; with ``raw`` naming the text
    column the envelope is decoded first. Unknown types go to class raw once:
    nothing here reads its own output.
    """
    src = read_events_stream(spark, conf)
    raw = conf.get("raw", "raw" if conf.get("format", "kafka") == "kafka" else None)
    return route_class(decode_envelope(split_malformed(src, raw)[0], raw) if raw else src, prefix=prefix)


def quarantine_stream(spark: SparkSession, conf) -> DataFrame:
    """What ``route_stream`` leaves out: source records that are not one JSON value, with the reason."""
    src = read_events_stream(spark, conf)
    raw = conf.get("raw", "raw")
    return split_malformed(src, raw)[1].select(*[c for c in src.columns if c != raw], F.col(raw).alias("raw"), "reason")


def start_route(spark: SparkSession, conf, path: str, checkpoint: str, prefix: str = "", every: str = "5 seconds") -> StreamingQuery:
    """Run the router until it is stopped; offsets and output commit together."""
    return (route_stream(spark, conf, prefix).writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).partitionBy("topic").trigger(processingTime=every).start())


def dedup_stream(df: DataFrame, delay: str, key: str = "sequence_id", ts: str = "ts") -> DataFrame:
    """One row per sequence id among rows no further apart than ``delay``; later rows are late.

    Rows without an id pass: they have no key to share, nor a place in the state.
    """
    timed = event_time(df, ts).withWatermark(ts, delay)
    named = has_id(timed, key)
    return timed.filter(named).dropDuplicatesWithinWatermark([key]).union(timed.filter(~named))


def health_stream(df: DataFrame, ts: str = "recorded_at", ident: str = "event_id") -> DataFrame:
    """Newest status per node, for update or complete mode. State is one row per node."""
    clean = sanitise_status(df)
    last = clean.groupBy("node_id").agg(
        F.max_by(F.struct("status", "events_buffered", ts), F.struct(ts, ident)).alias("v"))
    return last.select("node_id", F.col("v.status").alias("agent_status"), F.col("v.events_buffered").alias("events_buffered"),
                       F.col(f"v.{ts}").alias(ts))


def volume_stream(df: DataFrame, window: str = "1 minute", ts: str = "ts", topic: str = "topic") -> DataFrame:
    """Events per class and window. The partial aggregate runs before the shuffle, so a busy class is no hot spot."""
    return df.groupBy(F.window(ts, window).alias("w"), topic).agg(F.count(F.lit(1)).alias("events")).select(
        F.col("w.start").alias("window_start"), topic, "events")


def execution_slots(df: DataFrame, catalogue: DataFrame, ts: str = "ts", name: str = "query_name") -> DataFrame:
    """Number the run of its query that each row belongs to: epoch seconds over the query's interval."""
    intervals = catalogue.filter(F.col("interval_secs") > 0).select(F.col("name").alias(name), "interval_secs")
    secs = F.expr(f"unix_micros(cast(`{ts}` as timestamp)) div 1000000")
    return df.join(intervals, name).withColumn("__s", secs).withColumn(
        "execution_no", F.expr("__s div interval_secs")).drop("__s")


def write_outcomes(df: DataFrame, path: str, checkpoint: str) -> None:
    """The rows of ``stateful.split_stream`` into one folder an outcome (kept, duplicate, late), from one read of the source."""
    run_to_end(df, path, checkpoint, partition_by=["outcome"])


def enrich_from_table(table: BucketedTable, write: Callable[[DataFrame, int], None], host: Sequence[str] = HOST,
                      cols: Sequence[str] = ("name", "path")) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: events of a micro-batch with columns of their process, from the table's newest commit.

    The table may move on while the stream runs; each micro-batch sees one whole
    commit of it, and only the buckets that its events fall in.
    """
    def enrich(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            touched = [r[0] for r in batch.select(table.bucket()).distinct().collect()]
            write(enrich_events(batch, table.read(only=touched), host, cols), batch_id)
        finally:
            batch.unpersist()
    return enrich


def enrich_from_starts(events: DataFrame, starts: DataFrame, within: str, delay: str, start_delay: str | None = None,
                       host: Sequence[str] = HOST, cols: Sequence[str] = ("name", "path"), ts: str = "ts", how: str = "leftOuter") -> DataFrame:
    """Events with the process-start event of their pid on the same host, at most ``within`` before them: a join of two streams.

    Both sides keep rows only as long as the range and the watermarks
    (``delay`` for events, ``start_delay`` for starts) ask for. An event without a start comes
    out once the watermark has passed the range, with NULLs. A pid that is used
    again within the range gives a row for each start.
    """
    keys = [*host, "pid"]
    right = event_time(starts, ts).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(ts).alias("started_at"),
                                          *[F.col(c).alias(f"process_{c}") for c in cols]).withWatermark("started_at", start_delay or delay)
    left = event_time(events, ts).withWatermark(ts, delay)
    on = (F.col("started_at") <= F.col(ts)) & (F.col("started_at") >= F.col(ts) - F.expr(f"interval {within}"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return left.join(right, on, how).drop(*[f"__{k}" for k in keys])
