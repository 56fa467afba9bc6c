"""Node registry, health state, retention and delivery."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from fleetscope.functions.ordered import first_per_key, newest_in_slots, time_slot
from fleetscope.functions.rowkey import stable_uuid
from fleetscope.operators.envelope import sanitise_status, valid_id
from fleetscope.operators.joins import split_known_nodes
from fleetscope.operators.topk import latest_by

# Days each class is kept.
RETENTION_DAYS = {
    "raw": 7,
    "process": 14,
    "network": 14,
    "file": 14,
    "auth": 30,
    "heartbeats": 3,
    "alerts": 90,
    "dlq": 30,
}

# Schedule of an agent that has none yet.
DEFAULT_SCHEDULE = [
    ("running_processes", "SELECT pid, name, path, cmdline, uid FROM processes;", 30, False),
    ("listening_ports", "SELECT pid, port, protocol, address FROM listening_ports;", 30, False),
    ("users", "SELECT username, uid, gid, shell, directory FROM users;", 300, False),
]

NODE_COLUMNS = ("node_id", "machine_id", "hostname", "os_version", "agent_version", "agent_status",
                "operator_status", "first_seen_at", "last_enrolled_at")


def node_id_of(machine_id: Column) -> Column:
    """Stable node id of a machine, so that a rerun enrols the same node."""
    return stable_uuid(F.concat(F.lit("node:"), machine_id))


def enroll(nodes: DataFrame | None, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold enrolment requests into the registry: ``(nodes, audit)``.

    ``requests``: event_id, machine_id, hostname, os_version, agent_version,
    requested_at. Requests of a machine apply in (time, id) order. A new machine
    gets a node; a known one keeps id, status and first-seen time and takes over
    the newest host data, unless what it has is newer (requests may arrive late).
    Each request leaves one audit row.
    """
    order = F.struct("requested_at", "event_id")
    latest = requests.groupBy("machine_id").agg(
        F.min("requested_at").alias("__first"),
        F.max_by(F.struct("hostname", "os_version", "agent_version", "requested_at"), order).alias("__new"),
        F.min_by("event_id", order).alias("__first_id"))
    if nodes is None:
        merged = latest.select(
            "*", F.lit(False).alias("__known"),
            *[F.lit(None).cast("string").alias(f"__{c}") for c in ("node_id", "agent_status", "operator_status")],
            F.lit(None).cast("timestamp_ntz").alias("__seen"), F.lit(None).cast("timestamp_ntz").alias("__last"),
            F.col("__new").alias("__had"))
        untouched = None
    else:
        old = nodes.select("machine_id", *[F.col(c).alias(f"__{c}") for c in ("node_id", "agent_status", "operator_status")],
                           F.col("first_seen_at").alias("__seen"), F.col("last_enrolled_at").alias("__last"),
                           F.struct("hostname", "os_version", "agent_version", F.col("last_enrolled_at").alias("requested_at")).alias("__had"),
                           F.lit(True).alias("__old"))
        merged = latest.join(old, "machine_id", "left").withColumn("__known", F.coalesce("__old", F.lit(False))).drop("__old")
        untouched = nodes.join(latest.select("machine_id"), "machine_id", "left_anti").select(*NODE_COLUMNS)
    node = F.coalesce("__node_id", node_id_of(F.col("machine_id")))
    newer = F.coalesce(F.col("__last") > F.col("__new.requested_at"), F.lit(False))
    state = merged.withColumn("__new", F.when(newer, F.col("__had")).otherwise(F.col("__new"))).select(
        node.alias("node_id"), "machine_id", *[F.col(f"__new.{c}").alias(c) for c in ("hostname", "os_version", "agent_version")],
        F.coalesce("__agent_status", F.lit("healthy")).alias("agent_status"),
        F.coalesce("__operator_status", F.lit("active")).alias("operator_status"),
        F.coalesce("__seen", "__first").alias("first_seen_at"), F.col("__new.requested_at").alias("last_enrolled_at"))
    if untouched is not None:
        state = untouched.unionByName(state)

    # The first request of a new machine is found by id, so no join is keyed on a busy machine alone.
    firsts = merged.filter(~F.col("__known")).select(
        "machine_id", F.col("__first_id").alias("event_id"), F.lit("new_enrollment").alias("__type"))
    audit = requests.join(firsts, ["machine_id", "event_id"], "left")
    if nodes is None:
        audit = audit.withColumn("node_id", node_id_of(F.col("machine_id")))
    else:
        audit = audit.join(nodes.select("machine_id", F.col("node_id").alias("__nid")), "machine_id", "left").withColumn(
            "node_id", F.coalesce("__nid", node_id_of(F.col("machine_id"))))
    audit = audit.select(
        "event_id", "node_id", F.coalesce("__type", F.lit("re_enrollment")).alias("event_type"),
        "hostname", "os_version", "agent_version", F.col("requested_at").alias("enrolled_at"))
    return state, audit


def upsert_schedule(current: DataFrame, new: DataFrame, seed: bool = True) -> DataFrame:
    """Schedule after an upsert by name; the defaults enter only an empty schedule.

    Both sides: name, query, interval_secs, snapshot, updated_at. The row with
    the newest ``updated_at`` wins, and the new one where they tie.
    """
    cols = ["name", "query", "interval_secs", "snapshot", "updated_at"]
    parts = current.select(*cols, F.lit(1).alias("__prio"))
    if seed:
        spark = current.sparkSession
        defaults = spark.createDataFrame(
            [(*row, 0) for row in DEFAULT_SCHEDULE], "name string, query string, interval_secs bigint, snapshot boolean, __x int")
        typed = defaults.select("name", "query", "interval_secs", "snapshot",
                                F.lit(None).cast(current.schema["updated_at"].dataType).alias("updated_at"),
                                F.lit(0).alias("__prio"))
        empty = current.agg(F.count(F.lit(1))).scalar() == 0
        parts = parts.unionByName(typed.filter(empty))
    parts = parts.unionByName(new.select(*cols, F.lit(2).alias("__prio")))
    return first_per_key(parts, ["name"], [F.desc_nulls_last("updated_at"), F.desc("__prio")]).select(*cols)


def apply_heartbeats(nodes: DataFrame, hb: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fold heartbeats: ``(nodes, health, rejected)``.

    A heartbeat with a malformed id or of an unknown node is rejected whole. The
    others extend the health series and set ``agent_status`` to the newest
    report; ``operator_status`` is never touched.
    """
    clean = sanitise_status(hb)
    wellformed = clean.filter(valid_id(F.col("node_id")))
    health, orphans = split_known_nodes(wellformed, nodes)
    rejected = clean.filter(~valid_id(F.col("node_id"))).withColumn("reason", F.lit("invalid_id")).unionByName(
        orphans.withColumn("reason", F.lit("unknown_node")).select(*clean.columns, "reason"))
    newest = latest_by(health, ["node_id"], ["recorded_at", "event_id"], ["status"]).withColumnRenamed("status", "__status")
    updated = nodes.join(newest, "node_id", "left").withColumn(
        "agent_status", F.coalesce("__status", "agent_status")).select(*nodes.columns)
    series = health.select(
        F.col("event_id").alias("health_id"), "node_id", F.col("status").alias("agent_status"), "events_buffered", "recorded_at")
    return updated, series, rejected


def stale_nodes(nodes: DataFrame, health: DataFrame, as_of, minutes: int = 5) -> DataFrame:
    """Nodes without a heartbeat in the last ``minutes`` before ``as_of``, with the time they were last seen."""
    ref = F.lit(as_of)
    seen = health.groupBy("node_id").agg(F.max("recorded_at").alias("last_seen"))
    return nodes.select("node_id").join(seen, "node_id", "left").filter(
        F.col("last_seen").isNull() | (F.col("last_seen") < ref - F.make_dt_interval(mins=F.lit(minutes))))


def effective_status(nodes: DataFrame) -> DataFrame:
    """Operator and agent state side by side, and one label: isolation wins over agent health."""
    return nodes.select("node_id", "operator_status", "agent_status", F.when(
        F.col("operator_status") == "isolated", "isolated").otherwise(F.col("agent_status")).alias("effective_status"))


def has_id(df: DataFrame, key: str) -> Column:
    """Whether a row has an id: neither NULL nor blank text."""
    known = F.col(key).isNotNull()
    return known & (F.trim(F.col(key)) != "") if isinstance(df.schema[key].dataType, T.StringType) else known


def dedup_events(df: DataFrame, key: str = "sequence_id", order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """One row per sequence id, the first by ``order``; time alone never makes a duplicate.

    Rows without an id (NULL or blank) can't be told apart by it: all of them
    stay. Each gets a number of its own beside the id, so the input is read
    once and such rows don't meet in one task.
    """
    alone = F.when(~has_id(df, key), F.monotonically_increasing_id())
    return first_per_key(df.withColumn("__alone", alone), [key, "__alone"], [F.col(c) for c in order]).drop("__alone")


def apply_retention(df: DataFrame, as_of, retention: Mapping[str, int] | None = None, topic: str = "topic",
                    ts: str = "ts") -> DataFrame:
    """Rows still inside the retention of their class at ``as_of``; a class without a limit is kept.

    The caller gives the time: the newest time in the data may come from a host
    whose clock runs ahead, and would throw everything else away.

    The limits are configuration and become literals: no join, and on data
    partitioned by class and day only the kept folders are read.
    """
    limits = RETENTION_DAYS if retention is None else retention
    ref = F.lit(as_of)
    keep = ~F.col(topic).isin(list(limits)) | F.col(topic).isNull()
    for days in sorted(set(limits.values())):
        names = [c for c, d in limits.items() if d == days]
        keep = keep | (F.col(topic).isin(names) & (F.col(ts) >= ref - F.make_dt_interval(days=F.lit(days))))
    return df.filter(keep)


def reconcile(sent: DataFrame, acks: DataFrame, key: str = "sequence_no") -> DataFrame:
    """Delivery state per sequence id: how often sent and acknowledged, and what that means.

    Both sides are counted before they meet, so copies cost nothing. ``lost`` is
    for ids sent but not acknowledged, ``unknown`` for acknowledgements of ids
    never sent.
    """
    a = sent.groupBy(key).agg(F.count(F.lit(1)).alias("sent"))
    b = acks.groupBy(key).agg(F.count(F.lit(1)).alias("acked"))
    both = a.join(b, key, "full").select(key, F.coalesce("sent", F.lit(0)).alias("sent"), F.coalesce("acked", F.lit(0)).alias("acked"))
    return both.withColumn("delivery", F.when(F.col("sent") == 0, "unknown").when(F.col("acked") == 0, "lost")
                           .when((F.col("sent") > 1) | (F.col("acked") > 1), "duplicate").otherwise("delivered"))


def unacknowledged(df: DataFrame, up_to: DataFrame, key: str = "node_id", ident: str = "event_id") -> DataFrame:
    """Rows not covered by a node's cumulative acknowledgement (``id <= up_to``)."""
    mark = up_to.groupBy(key).agg(F.max("up_to").alias("__up_to"))
    return df.join(mark, key, "left").filter(
        F.col("__up_to").isNull() | (F.col(ident) > F.col("__up_to"))).select(*df.columns)


def expire_events(df: DataFrame, as_of, max_age: int = 3600, cap: int = 500_000, key: str = "node_id",
                  ts: str = "ts", ident: str = "event_id", slot_seconds: int = 60) -> DataFrame:
    """Events younger than ``max_age`` seconds at ``as_of``, and of those the ``cap`` newest per node."""
    young = df.filter(F.col(ts) >= F.lit(as_of) - F.make_dt_interval(secs=F.lit(max_age)))
    return newest_in_slots(young, [key], [ts, ident], time_slot(F.col(ts), slot_seconds, F.col(ident)), cap)


def operator_status(nodes: DataFrame, commands: DataFrame) -> DataFrame:
    """Operator state after all isolate / release commands; the last one wins."""
    last = commands.groupBy("node_id").agg(F.max_by("isolate", F.struct("issued_at", "event_id")).alias("__iso"))
    old = F.col("operator_status") if "operator_status" in nodes.columns else F.lit("active")
    return nodes.join(last, "node_id", "left").withColumn("operator_status", F.when(F.col("__iso"), "isolated")
                      .when(~F.col("__iso"), "active").otherwise(old)).drop("__iso")
