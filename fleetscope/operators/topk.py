"""Per-node top-k, latest values, pages, caps and first-in-first-out batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetscope.functions.ordered import id_slot, newest_in_slots, number_in_slots, top_per_key


def top_n_per_node(df: DataFrame, by: Column | str, n: int = 25, keys: Sequence[str] = ("node_id",),
                   tie: str = "pid") -> DataFrame:
    """The ``n`` largest rows per node; equal values are taken in ``tie`` order."""
    value = F.expr(by) if isinstance(by, str) else by
    return top_per_key(df, keys, [value.desc_nulls_last(), F.col(tie)], n)


def first_n_per_node(df: DataFrame, order: Sequence[str], n: int = 1000, keys: Sequence[str] = ("node_id",)) -> DataFrame:
    """The first ``n`` rows per node in ascending order."""
    return top_per_key(df, keys, [F.col(c) for c in order], n)


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Newest values per key through a combining aggregate, not a sorted window."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("__v"))
    return best.select(*keys, *[F.col(f"__v.{c}").alias(c) for c in cols])


def active_user(sessions: DataFrame, key: str = "node_id", ident: str = "event_id") -> DataFrame:
    """User of the newest interactive session per node."""
    live = sessions.filter((F.col("user") != "") & (F.col("type") == "user"))
    return live.groupBy(key).agg(F.max_by("user", F.struct("time", ident)).alias("active_user"))


def latest_health(df: DataFrame, key: str = "node_id", ident: str = "event_id") -> DataFrame:
    """Newest heartbeat per node."""
    cols = ["recorded_at", *[c for c in ("status", "agent_status", "events_buffered") if c in df.columns]]
    return latest_by(df, [key], ["recorded_at", ident], cols)


def page(df: DataFrame, node, limit: int, offset: int, key: str = "node_id", order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """One page of a node's log in time order."""
    return df.filter(F.col(key) == F.lit(node)).orderBy(*order).offset(offset).limit(limit)


def keep_newest(df: DataFrame, n: int, keys: Sequence[str] = ("node_id",), ident: str = "event_id",
                width: int = 1 << 18) -> DataFrame:
    """The ``n`` newest rows per node by id; older ones are evicted first."""
    return newest_in_slots(df, keys, [ident], id_slot(F.col(ident), width), n)


def fifo_batches(df: DataFrame, n: int, keys: Sequence[str] = ("node_id",), ident: str = "event_id",
                 width: int = 1 << 18) -> DataFrame:
    """Oldest-first batches of ``n`` rows per node, with first and last id and size."""
    numbered = number_in_slots(df.select(*keys, ident), keys, [ident], id_slot(F.col(ident), width))
    return numbered.withColumn("batch_no", F.expr(f"(row_no - 1) div {int(n)}")).groupBy(*keys, "batch_no").agg(
        F.min(ident).alias("batch_start"), F.max(ident).alias("batch_end"), F.count(F.lit(1)).alias("batch_count"))


def order_by(df: DataFrame, cols: Sequence[Column | str]) -> DataFrame:
    """A global order for the reader; Spark range-partitions it, so no task holds everything."""
    return df.orderBy(*cols)
