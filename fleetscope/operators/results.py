"""Query-result payloads: explode to rows, type the columns, attach host facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetscope.functions.rowkey import entries_to_map, merge_maps
from fleetscope.functions.text import first_nonblank, kv_entries, os_label_of, UNKNOWN_MACHINE
from fleetscope.schemas import COLUMN_ALIASES, EVENT_KINDS, QUERY_RESULT


def explode_results(df: DataFrame, col: str = "payload") -> DataFrame:
    """One row per result row, with its columns as a string map and its position in the result."""
    parsed = df.withColumn("__r", F.from_json(F.col(col), QUERY_RESULT, {"mode": "PERMISSIVE"}))
    kept = [c for c in df.columns if c != col]
    return parsed.select(
        *kept,
        F.col("__r.query_name").alias("query_name"),
        F.upper(F.col("__r.action")).alias("action"),
        F.posexplode_outer(F.col("__r.rows")).alias("row_no", "__row"),  # outer: keeps Spark from parsing once more in a filter
    ).filter(F.col("row_no").isNotNull()).select(
        *kept, "query_name", "action", F.col("row_no").cast("bigint").alias("row_no"),
        entries_to_map(F.col("__row.columns")).alias("columns"),
    )


def executions_of(df: DataFrame, col: str = "payload") -> DataFrame:
    """One row per result that a payload reports, with how many rows it has; also those without any.

    The table of runs that ``diff.differential`` needs: an empty result removes
    everything, and leaves no row of its own in ``explode_results``.
    """
    kept = [c for c in df.columns if c != col]
    parsed = df.withColumn("__r", F.from_json(F.col(col), QUERY_RESULT, {"mode": "PERMISSIVE"}))
    return parsed.filter(F.col("__r.query_name").isNotNull()).select(
        *kept, F.col("__r.query_name").alias("query_name"), F.upper(F.col("__r.action")).alias("action"),
        F.coalesce(F.size("__r.rows"), F.lit(0)).cast("bigint").alias("rows_reported"), F.lit(0).alias("status_code"))


def to_long(df: DataFrame, col: str = "columns") -> DataFrame:
    """Long form of exploded results: one row per (name, value)."""
    kept = [c for c in df.columns if c != col]
    return df.select(*kept, F.explode(F.col(col)).alias("name", "value"))


def from_long(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inverse of ``to_long``; a result row's columns are few, so the collected array is small."""
    return df.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", "value")))).alias("columns"))


def _source(columns: Column, name: str) -> Column:
    return F.coalesce(*[columns[n] for n in (name, *COLUMN_ALIASES.get(name, ()))])


def normalise(df: DataFrame, kind: str, col: str = "columns") -> DataFrame:
    """Typed columns of a process, file or network event from a string map.

    Text that does not cast becomes NULL and raises ``cast_failed``; the row stays.
    """
    fields = EVENT_KINDS[kind]
    raw = {n: _source(F.col(col), n) for n in fields}
    typed = {n: raw[n].try_cast(t) if t != "string" else raw[n] for n, t in fields.items()}
    failed = F.lit(False)
    for n, t in fields.items():
        if t != "string":
            failed = failed | (raw[n].isNotNull() & typed[n].isNull())
    return df.select(*[c for c in df.columns if c != col],
                     *[typed[n].alias(n) for n in fields], failed.alias("cast_failed"))


def normalised_event(df: DataFrame, kind: str, host: Column | None = None) -> DataFrame:
    """The common event envelope around a typed event; needs node_id, timestamp_ns and sequence_id."""
    fields = list(EVENT_KINDS[kind])
    return df.select(
        F.md5(F.concat_ws(":", "node_id", "sequence_id")).alias("id"),
        "node_id", F.lit(kind).alias("event_type"), "timestamp_ns",
        (host if host is not None else F.lit(None).cast("string")).alias("hostname"),
        F.to_json(F.struct(*fields)).alias("payload"),
        F.col("sequence_id").alias("raw_sequence_id"),
    )


def typed_view(df: DataFrame, columns: dict[str, str], col: str = "columns") -> DataFrame:
    """A host table from result rows: declared columns with safe casts, node and run kept."""
    return df.select(*[c for c in df.columns if c != col],
                     *[_source(F.col(col), n).try_cast(t).alias(n) for n, t in columns.items()])


def host_facts(load: DataFrame, *later: DataFrame, key: str = "node_id", col: str = "facts") -> DataFrame:
    """One map of facts per host; each further layer wins over the ones before it."""
    out = load.select(key, F.col(col).alias("__f0"))
    merged = F.col("__f0")
    for i, layer in enumerate(later, 1):
        out = out.join(layer.select(key, F.col(col).alias(f"__f{i}")), key, "full")
        merged = merge_maps(merged, F.col(f"__f{i}"))
    return out.select(key, merged.alias(col))


def decorate(df: DataFrame, facts: DataFrame, key: str = "node_id", out: str = "decorations") -> DataFrame:
    """Attach a host's facts to each of its rows; rows of hosts without facts stay.

    ``facts`` has one row per host. Spark broadcasts it while it is under the
    broadcast threshold and otherwise splits noisy hosts (AQE skew join).
    """
    mapped = facts.select(key, F.col("facts").alias("__facts"))
    joined = df.join(mapped, key, "left")
    base = F.col(out) if out in df.columns else F.expr("cast(map() as map<string,string>)")
    return joined.withColumn(out, merge_maps(base, F.col("__facts"))).drop("__facts")


def parse_kv(df: DataFrame, col: str, sep: str = "\0") -> DataFrame:
    """One row per name/value pair of a text column."""
    kept = [c for c in df.columns if c != col]
    return df.select(*kept, F.explode_outer(kv_entries(F.col(col), sep)).alias("__e")).filter(F.col("__e").isNotNull()).select(
        *kept, F.col("__e.name").alias("key"), F.col("__e.value").alias("value"))


def os_label(df: DataFrame, col: str, out: str = "os_label") -> DataFrame:
    """Printable OS name from release-file text."""
    return df.withColumn(out, os_label_of(F.col(col)))


def machine_id(df: DataFrame, a: str, b: str, out: str = "machine_id") -> DataFrame:
    """Machine id with fallback to a second source and then to a fixed marker."""
    return df.withColumn(out, first_nonblank(F.col(a), F.col(b), default=UNKNOWN_MACHINE))
