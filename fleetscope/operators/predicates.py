"""Filters and computed columns shared by the shipped queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetscope.functions.ordered import lag_in_slots, time_slot
from fleetscope.functions.text import matches_any

# Watched-path categories with their patterns.
WATCHED_PATHS = {
    "system_binaries": ["/usr/bin/%%", "/usr/sbin/%%", "/bin/%%", "/sbin/%%", "/usr/local/bin/%%"],
    "etc_configs": ["/etc/%%"],
    "ssh_keys": ["/root/.ssh/%%", "/home/%/.ssh/%%"],
    "cron_dirs": ["/etc/cron.d/%%", "/etc/cron.daily/%%", "/etc/cron.hourly/%%", "/etc/cron.monthly/%%",
                  "/etc/cron.weekly/%%", "/var/spool/cron/%%"],
    "systemd_units": ["/etc/systemd/system/%%", "/usr/lib/systemd/system/%%", "/usr/local/lib/systemd/system/%%"],
    "startup_scripts": ["/etc/init.d/%%", "/etc/rc.d/%%", "/etc/profile.d/%%", "/etc/ld.so.conf.d/%%"],
    "tmp_exec": ["/tmp/%%", "/var/tmp/%%", "/dev/shm/%%"],
}
EXCLUDED_PATHS = {
    "etc_configs": ["/etc/mtab", "/etc/fstab", "/etc/sysfs.conf", "/etc/udev/rules.d/%%"],
    "tmp_exec": ["/tmp/ssh-%%"],
}
ACCESS_TRACKED = ["ssh_keys", "etc_configs"]

# Kernel functions in which a waiting thread is flagged.
UNUSUAL_WAITS = ["sys_epoll_wait", "futex_wait"]


def like_any(col: Column, patterns: Sequence[str], ignore_case: bool = False) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | (col.ilike(p) if ignore_case else col.like(p))
    return out


def like(col: str, patterns: Sequence[str], negate: bool = False, ignore_case: bool = False) -> Column:
    """Whether a column matches any pattern (or none of them). NULL gives NULL."""
    hit = like_any(F.col(col), patterns, ignore_case)
    return ~hit if negate else hit


def one_of(col: str, values: Sequence, negate: bool = False) -> Column:
    """``IN`` / ``NOT IN`` over a literal list."""
    hit = F.col(col).isin(list(values))
    return ~hit if negate else hit


def equals(values: Mapping[str, object]) -> Column:
    """Whether every named column has the given value."""
    out = F.lit(True)
    for name, value in values.items():
        out = out & (F.col(name) == F.lit(value))
    return out


def recent(ts: str, seconds: int, as_of) -> Column:
    """Whether a time is less than ``seconds`` before ``as_of``: epoch seconds against a number, timestamps against anything else."""
    if as_of is None:
        raise ValueError("as_of is needed: the newest time in the data may come from a host whose clock runs ahead")
    age = F.lit(seconds) if isinstance(as_of, (int, float)) else F.make_dt_interval(secs=F.lit(seconds))
    return F.col(ts) > F.lit(as_of) - age


def filter_like(df: DataFrame, col: str, patterns: Sequence[str], negate: bool = False,
                ignore_case: bool = False) -> DataFrame:
    """Rows whose column matches any pattern (or none of them). NULL never passes."""
    return df.filter(like(col, patterns, negate, ignore_case))


def filter_in(df: DataFrame, col: str, values: Sequence, negate: bool = False) -> DataFrame:
    """``IN`` / ``NOT IN`` over a literal list; NULL never passes."""
    return df.filter(one_of(col, values, negate))


def filter_eq(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Rows equal to the given value in every named column."""
    return df.filter(equals(values))


def filter_recent(df: DataFrame, ts: str, seconds: int, as_of) -> DataFrame:
    """Rows younger than ``seconds`` at ``as_of``, which the caller gives, as for retention.

    ``ts`` is a timestamp, or epoch seconds as host tables have them (``as_of`` is
    a number then).
    """
    return df.filter(recent(ts, seconds, as_of))


def with_total_cpu(df: DataFrame, out: str = "total_cpu_time") -> DataFrame:
    return df.withColumn(out, F.col("user_time") + F.col("system_time"))


def int_div(a: str, b: str) -> Column:
    """Integer division as the host daemon does it: truncated, NULL when dividing by zero."""
    return F.expr(f"`{a}` div nullif(`{b}`, 0)")


def with_cost(df: DataFrame, total: str = "user_time", runs: str = "executions", out: str = "avg_user_ms") -> DataFrame:
    return df.withColumn(out, int_div(total, runs))


def fim_category(df: DataFrame, include: Mapping[str, Sequence[str]] | None = None,
                 exclude: Mapping[str, Sequence[str]] | None = None, path: str = "path") -> DataFrame:
    """One row per (file row, category whose patterns match and whose excludes do not).

    The pattern lists are configuration, so they become literal expressions and
    the file rows are scanned once, without a join.
    """
    include = WATCHED_PATHS if include is None else include
    exclude = EXCLUDED_PATHS if exclude is None else exclude
    hits = [F.when(matches_any(F.col(path), pats) & ~matches_any(F.col(path), exclude.get(cat, ())), F.lit(cat))
            for cat, pats in include.items()]
    return df.withColumn("category", F.explode_outer(F.array_compact(F.array(*hits)))).filter(F.col("category").isNotNull())


def tracked_access(df: DataFrame, categories: Sequence[str] = tuple(ACCESS_TRACKED)) -> DataFrame:
    """Categorised file rows whose category has access tracking on."""
    return df.filter(F.col("category").isin(list(categories)))


def loss_gaps(df: DataFrame, key: str = "node_id", ts: str = "ts", ident: str = "event_id",
              flag: str = "probe_error", slot_seconds: int = 10) -> DataFrame:
    """Intervals in which a host lost events: from the previous event to each flagged one."""
    lagged = lag_in_slots(df.select(key, ts, ident, flag), [key], [ts, ident], time_slot(F.col(ts), slot_seconds, F.col(ident)),
                          {"gap_start": ts, "previous_id": ident})
    return lagged.filter(F.col(flag) == 1).select(
        key, F.col(ident), "previous_id", "gap_start", F.col(ts).alias("gap_end"))


def distinct_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def hidden_processes(pids: DataFrame, exes: DataFrame, keys: Sequence[str] = ("node_id", "pid")) -> DataFrame:
    """Processes that are listed but have no executable link."""
    return pids.join(exes.select(*keys), list(keys), "left_anti").withColumn("reason", F.lit("exe_link_missing"))


def wait_anomalies(df: DataFrame, names: Sequence[str] = tuple(UNUSUAL_WAITS), col: str = "wchan") -> DataFrame:
    """Threads that wait in one of the listed kernel functions; values with a ``0`` mean running."""
    wait = F.trim(F.col(col))
    return (df.withColumn(col, wait).filter(~F.col(col).contains("0") & F.col(col).isin(list(names)))
              .withColumn("anomaly_type", F.lit("unusual_wait")))


def inventory(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("node_id",)) -> DataFrame:
    """Plain projection of a host table; the host (and run) columns always come along."""
    return df.select(*[k for k in keys if k in df.columns], *cols)
