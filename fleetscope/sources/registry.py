"""Registry tables: parquet folders or a relational database."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetscope.schemas import REGISTRY


def read_registry(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``nodes``, ``enrollment_events`` and ``node_health`` from ``path``, with their fixed schemas."""
    return {name: spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{name}") for name, schema in REGISTRY.items()}


def read_registry_jdbc(spark: SparkSession, url: str, options: Mapping[str, str] | None = None,
                       health_split: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """The same tables over JDBC, cast to the same schemas.

    ``health_split`` holds Spark's ``partitionColumn``, ``lowerBound``,
    ``upperBound`` and ``numPartitions`` for the growing health series.
    """
    out = {}
    for name, schema in REGISTRY.items():
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
        extra = {**(options or {}), **(health_split or {} if name == "node_health" else {})}
        df = reader.options(**extra).load()
        out[name] = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return out


def write_registry(tables: Mapping[str, DataFrame], path: str) -> None:
    """Write registry tables where ``read_registry`` finds them."""
    for name, df in tables.items():
        schema = REGISTRY[name]
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).write.mode("overwrite").parquet(
            f"{path.rstrip('/')}/{name}")
