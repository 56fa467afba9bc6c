"""Explicit schemas. Nothing in the library infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

STRING_MAP = T.MapType(T.StringType(), T.StringType())

# Envelope as it arrives on the wire, after decoding.
ENVELOPE = T.StructType([
    T.StructField("node_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("timestamp_ns", T.LongType()),
    T.StructField("sequence_id", T.StringType()),
])

# Payload of a query-result event.
QUERY_RESULT = T.StructType([
    T.StructField("query_name", T.StringType()),
    T.StructField("agent_uuid", T.StringType()),
    T.StructField("timestamp_ns", T.LongType()),
    T.StructField("rows", T.ArrayType(T.StructType([
        T.StructField("columns", T.ArrayType(T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("value", T.StringType()),
        ]))),
    ]))),
    T.StructField("action", T.StringType()),
])

# One line of the host daemon's result log.
RESULT_LOG = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("hostIdentifier", T.StringType()),
    T.StructField("calendarTime", T.StringType()),
    T.StructField("unixTime", T.LongType()),
    T.StructField("epoch", T.LongType()),
    T.StructField("counter", T.LongType()),
    T.StructField("numerics", T.BooleanType()),
    T.StructField("decorations", STRING_MAP),
    T.StructField("action", T.StringType()),
    T.StructField("columns", STRING_MAP),
    T.StructField("_corrupt_record", T.StringType()),
])

# Typed events: column -> type, in the order of the event definitions.
PROCESS_EVENT = {
    "pid": "bigint", "ppid": "bigint", "name": "string", "cmdline": "string",
    "uid": "bigint", "exe_path": "string", "working_dir": "string",
}
FILE_EVENT = {
    "path": "string", "operation": "string", "pid": "bigint",
    "process_name": "string", "return_code": "int",
}
NETWORK_EVENT = {
    "src_ip": "string", "dst_ip": "string", "src_port": "bigint", "dst_port": "bigint",
    "protocol": "string", "pid": "bigint", "direction": "string",
}
EVENT_KINDS = {"process": PROCESS_EVENT, "file": FILE_EVENT, "network": NETWORK_EVENT}

# Other names under which collectors report the same column.
COLUMN_ALIASES = {
    "ppid": ("parent",), "parent": ("ppid",), "exe_path": ("path", "exe"), "working_dir": ("cwd",),
    "src_ip": ("local_address",), "dst_ip": ("remote_address",),
    "src_port": ("local_port",), "dst_port": ("remote_port",),
}

NODES = T.StructType([
    T.StructField("node_id", T.StringType()),
    T.StructField("machine_id", T.StringType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("os_version", T.StringType()),
    T.StructField("agent_version", T.StringType()),
    T.StructField("agent_status", T.StringType()),
    T.StructField("operator_status", T.StringType()),
    T.StructField("first_seen_at", T.TimestampNTZType()),
    T.StructField("last_enrolled_at", T.TimestampNTZType()),
])
ENROLLMENT_EVENTS = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("node_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("os_version", T.StringType()),
    T.StructField("agent_version", T.StringType()),
    T.StructField("enrolled_at", T.TimestampNTZType()),
])
NODE_HEALTH = T.StructType([
    T.StructField("health_id", T.StringType()),
    T.StructField("node_id", T.StringType()),
    T.StructField("agent_status", T.StringType()),
    T.StructField("events_buffered", T.LongType()),
    T.StructField("recorded_at", T.TimestampNTZType()),
])
REGISTRY = {"nodes": NODES, "enrollment_events": ENROLLMENT_EVENTS, "node_health": NODE_HEALTH}

CATALOGUE = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("query", T.StringType()),
    T.StructField("interval_secs", T.LongType()),
    T.StructField("snapshot", T.BooleanType()),
    T.StructField("removed", T.BooleanType()),
    T.StructField("platform", T.StringType()),
    T.StructField("description", T.StringType()),
])

ALERT_COLUMNS = (
    "id", "node_id", "hostname", "timestamp_ns", "severity", "source", "mitre_technique_id",
    "mitre_tactic", "description", "triggering_event_id", "threat_score", "status",
)
