"""Retention of stored classes: whole folders go, only the border is filtered (G7).

``sinks.write_by_class`` leaves one folder for each batch and class. A folder whose
newest row is past its class's limit holds nothing that a reader may see, as readers
filter by the same limit; so it can be deleted at any time, and a deletion that
stops half way changes no result. Running it again goes on.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fleetscope.operators.registry import RETENTION_DAYS, apply_retention
from fleetscope.sources.versioned import Folder


def class_folders(spark: SparkSession, path: str, ts: str = "ts") -> DataFrame:
    """(batch_id, topic, newest) of each folder. Only the time column is read; where Spark pushes aggregates down, only the footers."""
    schema = T.StructType([T.StructField(ts, T.TimestampType()), T.StructField("batch_id", T.LongType()), T.StructField("topic", T.StringType())])
    rows = spark.read.schema(schema).option("basePath", path).parquet(path)
    return rows.groupBy("batch_id", "topic").agg(F.max(ts).alias("newest"))


def expired_folders(spark: SparkSession, path: str, as_of, retention: Mapping[str, int] | None = None, ts: str = "ts") -> DataFrame:
    """Folders in which no row is inside the retention of its class at ``as_of``; those without a time are kept, as are classes without a limit."""
    folders = class_folders(spark, path, ts).filter(F.col("newest").isNotNull())
    kept = apply_retention(folders, as_of, retention, ts="newest").select("batch_id", "topic")
    return folders.join(kept, ["batch_id", "topic"], "left_anti")


def drop_expired(spark: SparkSession, path: str, as_of, retention: Mapping[str, int] | None = None, ts: str = "ts") -> list[tuple[int, str]]:
    """Delete the expired folders and say which; a row a batch and class comes to the driver."""
    gone = sorted((r.batch_id, r.topic) for r in expired_folders(spark, path, as_of, retention, ts).collect())
    store = Folder(spark, path)
    for batch_id, topic in gone:
        store.delete(f"batch_id={batch_id}/topic={topic}")
    return gone


def read_retained(spark: SparkSession, path: str, as_of, schema: T.StructType, retention: Mapping[str, int] | None = None, ts: str = "ts") -> DataFrame:
    """Stored rows inside their retention: folders of the class prune, the limit filters the border."""
    limits = RETENTION_DAYS if retention is None else retention
    rows = spark.read.schema(T.StructType([*(f for f in schema.fields if f.name not in ("batch_id", "topic")), T.StructField("batch_id", T.LongType()),
                                           T.StructField("topic", T.StringType())])).option("basePath", path).parquet(path)
    return apply_retention(rows, as_of, limits, ts=ts)
