"""Telemetry source, series generator and result-log reader."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetscope.schemas import RESULT_LOG


def read_events_stream(spark: SparkSession, conf: Mapping) -> DataFrame:
    """Telemetry as a stream, from the earliest record.

    ``conf``: ``format`` and either ``topics`` and ``servers`` (Kafka; needs the
    connector on the class path) or ``path`` and ``schema`` (a file directory,
    with an optional ``glob``). ``options`` go to the source, for instance
    ``maxOffsetsPerTrigger`` or ``maxFilesPerTrigger`` to bound a batch.
    """
    fmt = conf.get("format", "kafka")
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        reader = (reader.option("kafka.bootstrap.servers", conf["servers"])
                        .option("subscribe", ",".join(conf["topics"]))
                        .option("startingOffsets", "earliest"))
        for key, value in conf.get("options", {}).items():
            reader = reader.option(key, value)
        return reader.load().select(
            F.col("key").cast("string").alias("node_key"), F.col("value").cast("string").alias("raw"),
            "topic", "partition", "offset", "timestamp")
    reader = reader.schema(conf["schema"])
    if conf.get("glob"):
        reader = reader.option("pathGlobFilter", conf["glob"])
    for key, value in conf.get("options", {}).items():
        reader = reader.option(key, value)
    return reader.load(conf["path"])


def read_result_log(spark: SparkSession, path: str) -> DataFrame:
    """The host daemon's result log (one JSON object a line).

    ``unixTime`` is the event time, whatever ``calendarTime`` says; actions are
    upper-cased. Lines that do not parse stay, in ``_corrupt_record``.
    """
    raw = (spark.read.schema(RESULT_LOG).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    return raw.select(
        F.col("name").alias("query_name"), F.col("hostIdentifier").alias("node_id"),
        F.expr("cast(timestamp_seconds(nullif(unixTime, 0)) as timestamp_ntz)").alias("event_time"),
        "epoch", "counter", F.upper("action").alias("action"), "decorations", "columns", "_corrupt_record")


def generate_series(df: DataFrame, n: int, as_of: Column, step: str = "1 minute", out: str = "recorded_at") -> DataFrame:
    """``n`` rows per input row, one ``step`` apart and going back from ``as_of``."""
    numbered = df.withColumn("step_no", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn(
        "step_no", F.col("step_no").cast("bigint"))
    return numbered.withColumn(out, as_of - F.expr(f"interval {step}") * F.col("step_no"))


def heartbeat_series(nodes: DataFrame, as_of: Column, n: int = 60) -> DataFrame:
    """A heartbeat a minute per node; the buffered count is hashed from node and time instead of random."""
    series = generate_series(nodes, n, as_of)
    seed = F.md5(F.concat_ws(":", F.col("node_id").cast("string"), F.col("step_no").cast("string")))
    return series.withColumn("events_buffered", F.conv(F.substring(seed, 1, 6), 16, 10).cast("bigint") % 100)
