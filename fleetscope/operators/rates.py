"""Counts, rates and simple statistics over telemetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetscope.functions.ordered import lag_in_slots, time_slot

# Consumer scaling.
LAG_PER_REPLICA = 10_000
MIN_REPLICAS, MAX_REPLICAS = 2, 64


def pending_count(df: DataFrame, key: str = "node_id") -> DataFrame:
    """Events waiting per node."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("pending"))


def event_rate(df: DataFrame, key: str = "node_id", ts: str = "ts", window: str = "1 minute") -> DataFrame:
    """Average events per second, over the windows in which the node sent anything."""
    secs = F.unix_micros(F.col("w.end").cast("timestamp")) - F.unix_micros(F.col("w.start").cast("timestamp"))
    per_window = df.groupBy(key, F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return per_window.groupBy(key).agg(
        F.count(F.lit(1)).alias("windows"), F.sum("n").alias("events"),
        (F.sum("n") * 1_000_000 / F.sum(secs)).alias("events_per_sec"))


def consumer_lag(latest: DataFrame, committed: DataFrame, group: str = "group_id") -> DataFrame:
    """Messages not yet consumed per group, over all partitions of the topics it reads.

    ``latest``: topic, partition, latest. ``committed``: group, topic, partition,
    committed; a partition without a commit counts in full.
    """
    reads = committed.select(group, "topic").distinct()
    both = latest.select("topic", "partition", "latest").join(reads, "topic").join(
        committed.select(group, "topic", "partition", "committed"), [group, "topic", "partition"], "left")
    return both.groupBy(group).agg(
        F.sum(F.greatest(F.col("latest") - F.coalesce("committed", F.lit(0)), F.lit(0))).alias("lag"))


def replicas(lag: Column) -> Column:
    """Consumers needed for a lag."""
    wanted = F.ceil(lag / F.lit(LAG_PER_REPLICA)).cast("bigint")
    return F.least(F.lit(MAX_REPLICAS), F.greatest(F.lit(MIN_REPLICAS), wanted)).cast("bigint")


def counter_rates(df: DataFrame, cols: Sequence[str], key: str | Sequence[str] = "node_id", ts: str = "ts",
                  ident: str = "event_id", slot_seconds: int = 10) -> DataFrame:
    """Per-second rate of growing counters; a reset (smaller value) or a zero time step gives NULL."""
    keys = [key] if isinstance(key, str) else list(key)
    lagged = lag_in_slots(df, keys, [ts, ident], time_slot(F.col(ts), slot_seconds, F.col(ident)),
                          {"__t": ts, **{f"__{c}": c for c in cols}})
    dt = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("__t").cast("timestamp"))
    rates = []
    for c in cols:
        step = F.col(c) - F.col(f"__{c}")
        rates.append(F.when(step >= 0, F.try_divide(step * 1_000_000, dt)).alias(f"{c}_per_sec"))
    return lagged.select(*df.columns, *rates)


def memory_percent(df: DataFrame, total: str = "memory_total", free: str = "memory_free",
                   out: str = "memory_percent") -> DataFrame:
    """Share of memory in use, in percent."""
    return df.withColumn(out, F.try_divide((F.col(total) - F.col(free)) * 100, F.col(total)))


def query_cost(df: DataFrame, n: int | None = 10) -> DataFrame:
    """Queries by average wall time per run, most expensive first."""
    ranked = df.withColumn("avg_wall_ms", F.expr("wall_time div nullif(executions, 0)")).withColumn(
        "avg_user_ms", F.expr("user_time div nullif(executions, 0)"))
    ordered = ranked.orderBy(F.desc_nulls_last("avg_wall_ms"), "name")
    return ordered.limit(n) if n else ordered


def window_counts(df: DataFrame, window: str = "1 day", keys: Sequence[str] = ("node_id", "event_type"), ts: str = "ts") -> DataFrame:
    """Events per (node, name, window): all that a baseline needs of them."""
    counts = df.groupBy(*keys, F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return counts.select(*keys, F.col("w.start").alias("window_start"), "events")


def anomalies_of(counts: DataFrame, history: int = 7, k: float = 2.0, keys: Sequence[str] = ("node_id", "event_type")) -> DataFrame:
    """Windows whose count is ``k`` deviations above the trailing mean, from counts as ``window_counts`` gives them."""
    w = Window.partitionBy(*keys).orderBy("window_start").rowsBetween(-history, -1)
    stats = (counts.withColumn("__n", F.count("events").over(w))
                   .withColumn("__mean", F.avg("events").over(w))
                   .withColumn("__spread", F.stddev_samp("events").over(w)))
    spread = F.nanvl(F.col("__spread"), F.lit(0.0))
    scored = stats.filter(F.col("__n") >= 3).withColumn("z_score", F.round(F.when(
        spread > 0, (F.col("events") - F.col("__mean")) / spread), 6))
    return scored.filter(F.col("z_score") >= k).select(*keys, "window_start", "events", "z_score")


def frequency_anomalies(df: DataFrame, window: str = "1 day", history: int = 7, k: float = 2.0,
                        keys: Sequence[str] = ("node_id", "event_type"), ts: str = "ts") -> DataFrame:
    """Windows in which a (node, name) count is ``k`` deviations above its trailing mean.

    Our own formula: z = (count - mean) / sample deviation over the up to
    ``history`` previous windows that hold events, at least three of them.
    Rows are counted first, so the ordered step sees one row per window.
    ``sources.baseline`` keeps the counts, so that events need not be read again.
    """
    return anomalies_of(window_counts(df, window, keys, ts), history, k, keys)


def class_volume(df: DataFrame, topic: str = "topic", node: str = "node_id") -> DataFrame:
    """Events and distinct nodes per class; counted per (class, node) first."""
    per_node = df.groupBy(topic, node).agg(F.count(F.lit(1)).alias("n"))
    return per_node.groupBy(topic).agg(F.sum("n").alias("events"), F.count(node).alias("nodes"))
