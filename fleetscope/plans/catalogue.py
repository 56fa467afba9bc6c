"""The shipped host queries, run for all hosts at once, and readers for query configuration.

A query is a function from host tables (name -> DataFrame) to a DataFrame. Host
tables hold rows of many hosts, so ``node_id`` comes along everywhere, and
``execution_no`` where the tables have it.
"""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetscope.operators import joins, predicates as P, topk
from fleetscope.schemas import CATALOGUE

HOST_KEYS = ("node_id", "execution_no")
Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class HostQuery:
    """A scheduled query: what it reads, how often it runs and how its results are reported."""

    name: str
    reads: Mapping[str, tuple[str, ...]]
    build: Callable[[Tables, object], DataFrame]
    interval: int
    snapshot: bool = False
    removed: bool = True
    columns: tuple[str, ...] = ()
    #: Of a plain projection: the condition on its one table, made from the clock of the run.
    where: Callable[[object], Column] | None = None
    #: What its rows are ordered by when it runs alone.
    order: tuple = ()
    #: Whether it compares times with the clock.
    timed: bool = False

    def run(self, tables: Tables, as_of=None) -> DataFrame:
        """Its rows, in no order."""
        if self.timed and as_of is None:
            raise ValueError(f"{self.name} compares times with the clock: give as_of")
        return self.build(tables, as_of)


def _keys(df: DataFrame) -> list[str]:
    return [k for k in HOST_KEYS if k in df.columns]


def _project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return P.inventory(df, cols, HOST_KEYS)


def plain(name: str, table: str, cols: str, interval: int, where: Callable[[object], Column] | None = None,
          extra: str = "", **flags) -> HostQuery:
    """Projection of one host table, after an optional condition on it (``extra``: columns only the condition reads)."""
    names = tuple(cols.split())

    def build(t: Tables, as_of) -> DataFrame:
        df = t[table]
        return _project(df.filter(where(as_of)) if where else df, names)

    return HostQuery(name, {table: tuple(dict.fromkeys((*names, *extra.split())))}, build, interval,
                     columns=names, where=where, **flags)


def _using(left: str, lcols: str, right: str, rcols: str, key: str, how: str = "inner",
           where: Callable[[], Column] | None = None) -> Callable[[Tables, object], DataFrame]:
    """``left JOIN right USING (key)`` inside each host and run."""
    def build(t: Tables, as_of=None) -> DataFrame:
        a, b = t[left], t[right]
        if where:
            a = a.filter(where())
        host = [k for k in _keys(a) if k in b.columns]
        a = a.select(*host, *dict.fromkeys((key, *lcols.split())))
        b = b.select(*host, *dict.fromkeys((key, *rcols.split())))
        cols = [c for c in (*lcols.split(), *rcols.split())]
        return joins.join_on_host(a, b, [key], how, host).select(*host, *dict.fromkeys(cols))
    return build


def _reads(**tables: str) -> dict[str, tuple[str, ...]]:
    return {t: tuple(c.split()) for t, c in tables.items()}


def _outside(patterns: Sequence[str]) -> Callable[[object], Column]:
    return lambda now: P.like("path", patterns, negate=True)


# File, address and name lists of the shipped queries.
CRITICAL_FILES = ["/etc/passwd", "/etc/shadow", "/etc/sudoers", "/etc/crontab", "/etc/hosts", "/etc/resolv.conf",
                  "/etc/nsswitch.conf", "/etc/pam.conf", "/etc/ssh/sshd_config", "/etc/fstab", "/etc/ld.so.conf"]
HASHED_ETC = CRITICAL_FILES[:9]
SHELL_DIRS = ["/tmp/%", "/dev/shm/%", "/run/%", "/var/tmp/%"]
SHELLS = ["sh", "bash", "zsh", "fish", "dash", "ksh"]
ANY_ADDRESS = ["0.0.0.0", "::"]
NO_LOGIN_SHELLS = ["/sbin/nologin", "/bin/false", "/usr/sbin/nologin"]
EXPECTED_PORTS = [22, 80, 443, 8080, 8443, 9090]
CRON_PATTERNS = ["%curl%", "%wget%", "%nc %", "%bash -i%", "%/tmp/%", "%python%", "%perl%"]
LINKER_VARIABLES = ["LD_PRELOAD", "LD_LIBRARY_PATH", "LD_AUDIT", "DYLD_INSERT_LIBRARIES"]

PROCESS_COLUMNS = ("pid parent name path cmdline state uid gid euid egid start_time resident_size user_time "
                   "system_time disk_bytes_read disk_bytes_written on_disk")
FEED_PROCESS = "tid pid parent uid gid cid exit_code probe_error syscall path cwd cmdline duration ntime time"


def _mapped(*outside: str) -> Callable[[object], Column]:
    return lambda now: P.like("permissions", ["%x%"]) & (F.col("path") != "") & P.like("path", outside, negate=True)


def _open_files(t: Tables, as_of=None) -> DataFrame:
    df = t["process_open_files"]
    kept = _project(P.filter_like(df, "path", ["/proc/%", "/dev/%"], negate=True), ("pid", "fd", "path"))
    return topk.first_n_per_node(kept, ["pid", "fd", "path"], 1000, _keys(df))


def _cpu(t: Tables, as_of=None) -> DataFrame:
    df = P.with_total_cpu(t["processes"])
    cols = "pid name uid user_time system_time resident_size total_size total_cpu_time".split()
    return topk.top_n_per_node(_project(df, cols), "total_cpu_time", 25, _keys(df))


def _memory(t: Tables, as_of=None) -> DataFrame:
    df = t["processes"]
    return topk.top_n_per_node(_project(df, "pid name uid resident_size total_size".split()), "resident_size", 25, _keys(df))


def _health(*extra: str) -> Callable[[Tables, object], DataFrame]:
    def build(t: Tables, as_of=None) -> DataFrame:
        df = P.with_cost(t["osquery_schedule"])
        if extra:
            df = P.with_cost(df, "system_time", "executions", "avg_system_ms")
        cols = ("name", "interval", "executions", "output_size", "wall_time", "avg_user_ms", *extra, "average_memory", "last_executed")
        return _project(df, cols)
    return build


DEPLOYED = [
    plain("bpf_process_events", "bpf_process_events", FEED_PROCESS, 30, removed=False),
    plain("bpf_socket_events", "bpf_socket_events",
          "tid pid parent uid gid cid exit_code probe_error syscall local_address remote_address local_port remote_port time",
          30, removed=False),
    plain("running_processes", "processes", PROCESS_COLUMNS, 60),
    plain("deleted_binaries", "processes", "pid name path cmdline uid gid", 60,
          lambda now: P.equals({"on_disk": 0}), "on_disk", snapshot=True, removed=False),
    HostQuery("listening_ports", _reads(listening_ports="pid port protocol family address", processes="pid name path cmdline"),
              _using("listening_ports", "pid port protocol family address", "processes", "name path cmdline", "pid", "left"), 60),
    plain("open_sockets", "process_open_sockets",
          "pid fd socket family protocol local_address remote_address local_port remote_port state", 60,
          lambda now: F.col("family") != 1),
    plain("logged_in_users", "logged_in_users", "type user tty host time pid", 60, removed=False),
    plain("memory_mapped_executables", "process_memory_map", "pid start end permissions offset path", 120,
          _mapped("/usr/%", "/lib%", "/lib64%")),
    HostQuery("process_open_files", _reads(process_open_files="pid fd path"), _open_files, 120),
    HostQuery("cpu_utilization", _reads(processes="pid name uid user_time system_time resident_size total_size"), _cpu, 60, True),
    HostQuery("memory_utilization", _reads(processes="pid name uid resident_size total_size"), _memory, 60, True),
    plain("system_memory", "memory_info", "memory_total memory_free memory_available swap_total swap_free buffers cached", 60,
          snapshot=True),
    plain("disk_io", "disk_events", "name reads_completed writes_completed read_bytes write_bytes read_time write_time", 60),
    plain("crontab_snapshot", "crontab", "command path minute hour day_of_month month day_of_week", 300, snapshot=True),
    plain("docker_containers", "docker_containers", "id name image image_id command created state status", 300),
    plain("users_snapshot", "users", "uid gid username description directory shell type", 3600, snapshot=True),
    plain("groups_snapshot", "groups", "gid gid_signed groupname", 3600, snapshot=True),
    plain("sudoers", "sudoers", "header rule_details", 3600),
    HostQuery("authorized_keys", _reads(users="uid username", authorized_keys="uid key key_type comment key_file"),
              _using("users", "username", "authorized_keys", "key key_type comment key_file", "uid"), 3600),
    plain("user_ssh_keys", "user_ssh_keys", "uid path encrypted", 3600),
    plain("kernel_modules", "kernel_modules", "name size used_by status address", 3600),
    plain("suid_bins", "suid_bin", "path username groupname permissions pid_with_namespace", 3600),
    plain("startup_items", "startup_items", "name type path args status", 3600),
    plain("systemd_units", "systemd_units", "id description load_state active_state sub_state", 3600,
          lambda now: P.equals({"active_state": "active"})),
    plain("deb_packages_snapshot", "deb_packages", "name version source arch revision status", 3600, snapshot=True),
    plain("rpm_packages_snapshot", "rpm_packages", "name version release arch epoch install_time vendor package_group source",
          3600, snapshot=True),
    plain("apt_sources", "apt_sources", "name source base_uri release maintainer type", 3600),
    plain("yum_sources", "yum_sources", "name baseurl enabled gpgcheck", 3600),
    plain("mounts", "mounts", "device device_alias path type flags", 3600),
    plain("interface_details", "interface_details", "interface mac ip_mask flags type", 3600, snapshot=True),
    plain("routes", "routes", "destination netmask gateway source flags interface mtu", 3600),
    plain("arp_cache", "arp_cache", "address mac interface", 300, removed=False),
    plain("dns_resolvers", "dns_resolvers", "id type address", 3600),
    plain("fim_critical_files", "hash", "path sha256", 300, lambda now: P.one_of("path", CRITICAL_FILES)),
    plain("shadow_hashes", "shadow", "username password_status last_change expire", 3600, snapshot=True),
    plain("system_info_snapshot", "system_info",
          "hostname cpu_brand cpu_physical_cores cpu_logical_cores physical_memory hardware_vendor hardware_model "
          "hardware_serial computer_name", 86400, snapshot=True),
    plain("os_version_snapshot", "os_version", "name version major minor patch platform platform_like codename", 86400, snapshot=True),
    plain("kernel_info", "kernel_info", "version arguments path device", 86400, snapshot=True),
    plain("last_logins", "last", "username tty pid type time host", 86400, snapshot=True),
    HostQuery("osquery_health", _reads(osquery_schedule="name interval executions output_size wall_time user_time average_memory last_executed"),
              _health(), 3600, True),
    plain("uptime", "uptime", "total_seconds days hours minutes", 3600, snapshot=True),
    plain("disk_info", "disk_info", "disk_index type id disk_size hardware_model name serial vendor", 86400, snapshot=True),
]

AGENT_DEFAULTS = [
    plain("running_processes", "processes", "pid name path cmdline uid", 30),
    plain("open_files", "process_open_files", "pid fd path", 60, _outside(["/dev/%"])),
    plain("tmp_file_activity", "file", "path size mtime atime", 60,
          lambda now: P.recent("mtime", 3600, now) & P.equals({"directory": "/tmp"}), "directory", snapshot=True, timed=True),
    plain("listening_ports", "listening_ports", "pid port protocol address", 30),
    plain("open_sockets", "process_open_sockets", "pid local_address local_port remote_address remote_port state", 30),
    plain("process_env_path", "process_envs", "pid key value", 120, lambda now: P.equals({"key": "PATH"})),
    plain("etc_file_changes", "file", "path size mtime", 120,
          lambda now: P.recent("mtime", 86400, now) & P.equals({"directory": "/etc"}), "directory", snapshot=True, timed=True),
    plain("users", "users", "username uid gid shell directory", 300),
    plain("init_children", "processes", "pid name cmdline parent", 60, lambda now: P.equals({"parent": 1})),
    plain("crontab", "crontab", "event minute hour day_of_month month day_of_week command path", 300),
]


def _ptrace(t: Tables, as_of=None) -> DataFrame:
    df = t["processes"]
    return joins.parent_child(df, "T", _keys(df))


def _suid_writable(t: Tables, as_of=None) -> DataFrame:
    sb, f = t["suid_bin"], t["file"]
    host = [k for k in _keys(sb) if k in f.columns]
    out = joins.join_on_host_expr(sb, f.filter(F.col("writable") == 1).select(*host, "path", "size"),
                                  F.col("a.path") == F.col("b.path"), host=host)
    cols = [F.col(f"a.{c}") for c in (*host, "path", "username", "groupname", "permissions")]
    return out.select(*cols, F.col("b.size")).distinct()


def _path_dirs(t: Tables, as_of=None) -> DataFrame:
    files, envs = t["file"], t["process_envs"]
    host = [k for k in _keys(files) if k in envs.columns]
    return _project(joins.writable_path_dirs(files.filter(F.col("type") == "directory"), envs, 1, host), ("directory", "path"))


def _modules(t: Tables, as_of=None) -> DataFrame:
    mods = t["kernel_modules"]
    return _project(joins.unusual_modules(mods.select(*_keys(mods), "name", "address", "used_by", "status"), _keys(mods)),
                    ("name", "address", "used_by"))


def _listeners(t: Tables, as_of=None) -> DataFrame:
    return _using("listening_ports", "pid port protocol address socket", "processes", "name path", "pid",
                  where=lambda: P.one_of("port", EXPECTED_PORTS, negate=True))(t)


def _privileged(t: Tables, as_of=None) -> DataFrame:
    dc, dcs = t["docker_containers"], t["docker_container_security_options"]
    host = [k for k in _keys(dc) if k in dcs.columns]
    out = joins.join_on_host_expr(dc, dcs.filter(F.col("privileged") == 1).select(*host, "id", "privileged"),
                                  F.col("a.id") == F.col("b.id"), host=host)
    return out.select(*[F.col(f"a.{c}") for c in (*host, "id", "name", "image", "status")], F.col("b.privileged"))


def _namespaces(t: Tables, as_of=None) -> DataFrame:
    shared = (F.col("host_pid") == 1) | (F.col("host_net") == 1) | (F.col("host_ipc") == 1)
    return _using("process_namespaces", "host_ipc host_net host_pid host_uts", "processes", "pid name cmdline", "pid",
                  where=lambda: shared)(t)


def _recent_logins(t: Tables, as_of=None) -> DataFrame:
    return _project(P.filter_recent(t["last"], "time", 86400, as_of), "username tty pid type time host".split())


DETECTION_PACK = [
    plain("shell_in_unusual_dir", "processes", "pid parent name path cmdline uid gid", 60,
          lambda now: P.like("path", SHELL_DIRS) & P.one_of("name", SHELLS)),
    plain("process_with_deleted_binary", "processes", "pid name path cmdline uid gid start_time", 120,
          lambda now: P.equals({"on_disk": 0}), "on_disk", snapshot=True),
    HostQuery("ptrace_activity", _reads(processes="pid parent name cmdline state"), _ptrace, 60),
    HostQuery("listening_on_all_interfaces",
              _reads(listening_ports="pid port protocol address", processes="pid name path cmdline uid"),
              _using("listening_ports", "pid port protocol address", "processes", "name path cmdline uid", "pid",
                     where=lambda: P.one_of("address", ANY_ADDRESS)), 300),
    HostQuery("suid_writable", _reads(suid_bin="path username groupname permissions", file="path size writable"),
              _suid_writable, 3600),
    plain("new_users_since_baseline", "users", "uid gid username description directory shell", 3600,
          lambda now: (F.col("uid") >= 1000) & P.one_of("shell", NO_LOGIN_SHELLS, negate=True)),
    plain("uid_0_accounts", "users", "username description directory shell", 3600, lambda now: P.equals({"uid": 0}), "uid"),
    HostQuery("world_writable_dirs_in_path", _reads(file="directory path writable type", process_envs="pid key value"),
              _path_dirs, 3600),
    HostQuery("kernel_module_unsigned", _reads(kernel_modules="name address used_by status"), _modules, 3600),
    plain("etc_hosts_changes", "etc_hosts", "address hostnames", 3600),
    HostQuery("unexpected_network_listeners_snapshot",
              _reads(listening_ports="pid port protocol address socket", processes="pid name path"), _listeners, 3600, True,
              order=("port", *HOST_KEYS, "pid")),
    plain("crontab_unusual", "crontab", "command path minute hour", 3600, lambda now: P.like("command", CRON_PATTERNS)),
    HostQuery("ssh_authorized_keys_snapshot", _reads(users="uid username", authorized_keys="uid key key_type comment key_file"),
              _using("users", "username uid", "authorized_keys", "key key_type comment key_file", "uid"), 3600, True),
    HostQuery("environment_ld_preload", _reads(process_envs="pid key value", processes="pid name path"),
              _using("process_envs", "pid key value", "processes", "name path", "pid",
                     where=lambda: P.one_of("key", LINKER_VARIABLES)), 300),
    HostQuery("docker_privileged_containers",
              _reads(docker_containers="id name image status", docker_container_security_options="id privileged"),
              _privileged, 3600),
    HostQuery("namespace_escapes",
              _reads(processes="pid name cmdline", process_namespaces="pid host_ipc host_net host_pid host_uts"), _namespaces, 300),
    plain("memory_stats", "memory_info", "memory_total memory_free memory_available buffers cached swap_total swap_free swap_cached",
          300, snapshot=True),
    HostQuery("recent_logins", _reads(last="username tty pid type time host"), _recent_logins, 3600, True, order=("-time", "pid"), timed=True),
]

HARDWARE_PACK = [
    plain("hardware_events_usb", "hardware_events", "time action model serial vendor_id model_id path", 30,
          lambda now: P.equals({"subsystem": "usb"}), "subsystem", removed=False),
    plain("usb_devices", "usb_devices", "usb_address usb_port vendor_id model_id model serial subclass protocol removable", 300),
    plain("smart_drive_info", "smart_drive_info", "device driver model serial_number firmware_version healthy self_assessment",
          3600, snapshot=True),
]

# The larger schedule of the operator guide, where it differs from DEPLOYED.
EXTENDED = [
    plain("bpf_socket_events", "bpf_socket_events",
          "tid pid parent uid gid cid exit_code probe_error syscall path local_address remote_address local_port remote_port time",
          30, removed=False),
    plain("process_events_audit", "process_events", "pid parent uid gid euid egid auid path cmdline cwd time syscall", 30, removed=False),
    plain("socket_events_audit", "socket_events",
          "pid path fd auid family protocol local_address remote_address local_port remote_port status time", 30, removed=False),
    plain("user_events", "user_events", "uid auid pid message type path time", 30, removed=False),
    plain("apparmor_events", "apparmor_events",
          "time uptime eid apparmor operation parent profile name pid denied_mask capname fsuid ouid", 30, removed=False),
    plain("selinux_events", "selinux_events", "time uptime scontext tcontext tclass type message", 30, removed=False),
    plain("file_events_fim", "file_events",
          "target_path category action transaction_id inode uid gid time md5 sha1 sha256", 60, removed=False),
    plain("process_file_events_audit", "process_file_events", "operation pid parent uid gid auid euid egid exe path time", 60, removed=False),
    plain("open_sockets", "process_open_sockets",
          "pid fd socket family protocol local_address remote_address local_port remote_port path state", 300,
          lambda now: F.col("family") != 1),
    HostQuery("process_open_files", _reads(process_open_files="pid fd path"),
              lambda t, as_of=None: _project(P.filter_like(t["process_open_files"], "path", ["/proc/%", "/dev/%"], negate=True), ("pid", "fd", "path")),
              300, order=("pid",)),
    plain("memory_mapped_executables", "process_memory_map", "pid start end permissions offset path", 300, _mapped("/usr/%", "/lib%")),
    plain("iptables_rules", "iptables",
          "filter_name chain policy target protocol src_ip dst_ip src_port dst_port match packets bytes", 3600),
    plain("apt_sources", "apt_sources", "name source base_uri release version maintainer type components architectures", 3600),
    plain("interface_details", "interface_details", "interface mac ip_mask flags type last_change", 3600, snapshot=True),
    plain("routes", "routes", "destination netmask gateway source flags interface mtu metric", 3600),
    plain("apparmor_profiles", "apparmor_profiles", "path name attach mode", 3600, snapshot=True),
    plain("selinux_settings", "selinux_settings", "scope key value", 3600, snapshot=True),
    plain("hash_etc", "hash", "path sha256", 3600, lambda now: P.one_of("path", HASHED_ETC)),
    HostQuery("osquery_health",
              _reads(osquery_schedule="name interval executions output_size wall_time user_time system_time average_memory last_executed"),
              _health("avg_system_ms"), 3600, True),
    plain("system_info_snapshot", "system_info",
          "hostname cpu_brand cpu_physical_cores cpu_logical_cores physical_memory hardware_vendor hardware_model "
          "hardware_serial hardware_version computer_name local_hostname", 86400, snapshot=True),
    plain("disk_info", "disk_info",
          "disk_index type id partition_table_type disk_size hardware_model name serial vendor", 86400, snapshot=True),
    plain("os_version_snapshot", "os_version", "name version major minor patch build platform platform_like codename", 86400, snapshot=True),
    plain("shadow_hashes", "shadow", "username password_status last_change expire flag", 86400, snapshot=True),
    plain("cpu_info", "cpu_info",
          "number_of_cores physical_cores logical_cores cpu_brand cpu_type cpu_subtype cpu_brand_string cpu_microcode",
          86400, snapshot=True),
]

PACKS = {"deployed": DEPLOYED, "agent_defaults": AGENT_DEFAULTS, "detection": DETECTION_PACK,
         "hardware": HARDWARE_PACK, "extended": EXTENDED}

# Host columns that hold whole numbers; all others are text.
WHOLE_NUMBERS = frozenset((
    "pid parent tid uid gid euid egid auid fsuid ouid cid exit_code probe_error duration ntime time start_time "
    "resident_size total_size user_time system_time disk_bytes_read disk_bytes_written on_disk port protocol family "
    "fd socket local_port remote_port memory_total memory_free memory_available swap_total swap_free swap_cached "
    "buffers cached reads_completed writes_completed read_bytes write_bytes read_time write_time created gid_signed "
    "encrypted size mtime atime writable pid_with_namespace install_time netmask mtu metric last_change expire "
    "cpu_physical_cores cpu_logical_cores physical_memory major minor patch interval executions output_size wall_time "
    "average_memory last_executed total_seconds days hours minutes disk_index disk_size privileged host_ipc host_net "
    "host_pid host_uts removable uptime eid transaction_id inode packets bytes number_of_cores physical_cores logical_cores"
).split())


def host_tables(packs: Mapping[str, Sequence[HostQuery]] = PACKS) -> dict[str, dict[str, str]]:
    """Every host table the packs read, as column -> type."""
    out: dict[str, dict[str, str]] = {}
    for queries in packs.values():
        for q in queries:
            for table, cols in q.reads.items():
                for c in cols:
                    out.setdefault(table, {})[c] = "bigint" if c in WHOLE_NUMBERS else "string"
    return out


def catalogue(spark: SparkSession, queries: Sequence[HostQuery]) -> DataFrame:
    """Built-in queries in the shape of ``load_catalogue``."""
    rows = [(q.name, None, q.interval, q.snapshot, q.removed, "linux", None) for q in queries]
    return spark.createDataFrame(rows, CATALOGUE)


def load_catalogue(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """Scheduled queries from configuration files.

    JSON files hold a ``schedule`` or ``queries`` object by name, TOML files a
    list of ``[[queries]]``. A later file replaces queries of the same name.
    ``SELECT 1`` section markers are left out. The files are small settings, read
    through Spark so that they may lie on shared storage.
    """
    found: dict[str, tuple] = {}
    for path in files:
        text = spark.read.text(str(path), wholetext=True).first()[0]
        if str(path).endswith(".toml"):
            entries = {e["name"]: e for e in tomllib.loads(text).get("queries", [])}
        else:
            doc = json.loads(text)
            entries = {**doc.get("schedule", {}), **doc.get("queries", {})}
        for name, e in entries.items():
            if e["query"].strip().rstrip(";").lower() == "select 1":
                continue
            found[name] = (name, e["query"], int(e.get("interval_secs", e.get("interval", 0))),
                           bool(e.get("snapshot", False)), bool(e.get("removed", True)), e.get("platform"), e.get("description"))
    return spark.createDataFrame(list(found.values()), CATALOGUE)
