"""Joins between host tables. Every one of them matches inside a host.

On one machine ``pid`` or ``uid`` is a key; in a fleet it is not, so ``keys``
always holds the host (and the run, for histories). No side is forced to
broadcast: Spark does so below its size threshold and AQE splits skewed keys
above it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

HOST = ("node_id",)


def join_on_host(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner",
                 host: Sequence[str] = HOST) -> DataFrame:
    """``JOIN … USING (keys)`` within a host."""
    return a.join(b, [*host, *[k for k in keys if k not in host]], how)


def join_on_host_expr(a: DataFrame, b: DataFrame, cond: Column, how: str = "inner",
                      host: Sequence[str] = HOST, left: str = "a", right: str = "b") -> DataFrame:
    """``JOIN … ON cond`` within a host; refer to the sides as ``a.…`` and ``b.…``."""
    for h in host:
        cond = cond & (F.col(f"{left}.{h}") == F.col(f"{right}.{h}"))
    return a.alias(left).join(b.alias(right), cond, how)


def port_owners(ports: DataFrame, procs: DataFrame, host: Sequence[str] = HOST) -> DataFrame:
    """Listening ports with name, path and command line of the owner; ports without owner stay."""
    wanted = [c for c in ("name", "path", "cmdline") if c in procs.columns]
    return join_on_host(ports, procs.select(*host, "pid", *wanted), ["pid"], "left", host)


def parent_child(procs: DataFrame, state: str = "T", host: Sequence[str] = HOST) -> DataFrame:
    """Tracer and tracee: processes in ``state`` with their parent on the same host."""
    has_cmd = "cmdline" in procs.columns
    tracee = procs.filter(F.col("state") == state).select(
        *host, F.col("parent").alias("tracer_pid"), F.col("pid").alias("tracee_pid"), F.col("name").alias("tracee_name"))
    tracer = procs.select(*host, F.col("pid").alias("tracer_pid"), F.col("name").alias("tracer_name"),
                          *([F.col("cmdline").alias("tracer_cmd")] if has_cmd else []))
    out = tracer.join(tracee, [*host, "tracer_pid"])
    return out.select(*host, "tracer_pid", "tracer_name", *(["tracer_cmd"] if has_cmd else []), "tracee_pid", "tracee_name")


def first_path_entry(value: Column) -> Column:
    """Text before the first ``:``."""
    return F.substring_index(value, ":", 1)


def writable_path_dirs(files: DataFrame, envs: DataFrame, pid: int | None = 1, host: Sequence[str] = HOST) -> DataFrame:
    """World-writable entries in the directory that comes first in PATH on the same host."""
    paths = envs.filter(F.col("key") == "PATH")
    if pid is not None:
        paths = paths.filter(F.col("pid") == pid)
    dirs = paths.select(*host, first_path_entry(F.col("value")).alias("directory")).filter(
        F.col("directory").isNotNull())
    return files.filter(F.col("writable") == 1).join(dirs, [*host, "directory"], "left_semi")


def unusual_modules(mods: DataFrame, host: Sequence[str] = HOST) -> DataFrame:
    """Kernel modules that are not live, or whose name is nowhere live on the host.

    A module with another status passes on that alone, and a live one is always
    in the live list; only a NULL status needs the lookup. The lookup has NOT
    EXISTS semantics, so a NULL name in the list hides nothing.
    """
    not_live = mods.filter(F.col("status") != "Live")
    live = mods.filter(F.col("status") == "Live").select(*host, "name")
    unknown = mods.filter(F.col("status").isNull()).join(live, [*host, "name"], "left_anti")
    return not_live.unionByName(unknown.select(*mods.columns))


def enrich_events(events: DataFrame, procs: DataFrame, host: Sequence[str] = HOST,
                  cols: Sequence[str] = ("name", "path")) -> DataFrame:
    """Events with columns of the process that raised them; works on a stream of events too."""
    side = procs.select(*host, "pid", *[F.col(c).alias(f"process_{c}") for c in cols])
    return events.join(side, [*host, "pid"], "left")


def enrich_alerts(alerts: DataFrame, events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Alerts with their triggering event and the host name of the node. Event ids are a node's own.

    Alerts are few: the events they name are picked by key first, and only those
    carry their payload on.
    """
    key = ["node_id", "triggering_event_id"]
    named = events.withColumnRenamed("event_id", "triggering_event_id")
    ev = named.select(*key, "event_type", "payload").join(alerts.select(*key).distinct(), key, "left_semi")
    return alerts.drop("hostname").join(ev, key, "left").join(nodes.select("node_id", "hostname"), "node_id", "left")


def split_known_nodes(df: DataFrame, nodes: DataFrame, key: str = "node_id") -> tuple[DataFrame, DataFrame]:
    """Rows whose node is registered, and orphans (also those with a NULL node)."""
    ids = nodes.select(key)
    return df.join(ids, key, "left_semi"), df.join(ids, key, "left_anti")
