"""Session defaults and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "fleetscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on; anything in ``conf`` wins.

    Shuffle partition counts are left to the cluster: AQE coalesces small
    shuffles and splits skewed join and rebalance partitions.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own:
    on a cluster the executors could not see it.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="fleetscope-")
        spark.conf.set(CHECKPOINT_CONF, base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
