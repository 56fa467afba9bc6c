"""Running whole packs of host queries."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fleetscope.operators import diff, topk
from fleetscope.plans.catalogue import HOST_KEYS, HostQuery


def run_query(tables: Mapping[str, DataFrame], query: HostQuery, as_of=None) -> DataFrame:
    """One query over the host tables of the whole fleet. ``as_of`` is the clock (epoch seconds) of queries that ask for it."""
    out = query.run(tables, as_of)
    order = [c for c in query.order if c.lstrip("-") in out.columns]
    return topk.order_by(out, [F.desc(c[1:]) if c.startswith("-") else c for c in order]) if order else out


def as_json(cols: Iterable[str]) -> Column:
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def fused(table: DataFrame, queries: Iterable[HostQuery], as_of=None) -> DataFrame:
    """Plain projections of one table in one scan of it: a row gives one result for each query whose condition it meets."""
    keys = [k for k in HOST_KEYS if k in table.columns]
    hits = []
    for q in queries:
        if q.timed and as_of is None:
            raise ValueError(f"{q.name} compares times with the clock: give as_of")
        hit = F.struct(F.lit(q.name).alias("query_name"), as_json(q.columns).alias("row"))
        hits.append(F.when(q.where(as_of), hit) if q.where else hit)
    return table.select(*keys, F.explode(F.array_compact(F.array(*hits))).alias("__hit")).select(*keys, "__hit.query_name", "__hit.row")


def run_pack(tables: Mapping[str, DataFrame], pack: Iterable[HostQuery], as_of=None) -> DataFrame:
    """All queries of a pack as one frame: host keys, query name and the row as JSON text.

    Plain projections of the same table share one scan; rows come in no order.
    Queries whose tables were not collected are left out.
    """
    parts, single = [], {}
    for q in pack:
        if not all(t in tables for t in q.reads):
            continue
        if q.columns:
            (table,) = q.reads
            single.setdefault(table, []).append(q)
            continue
        out = q.run(tables, as_of)
        keys = [k for k in HOST_KEYS if k in out.columns]
        parts.append(out.select(*keys, F.lit(q.name).alias("query_name"), as_json(c for c in out.columns if c not in keys).alias("row")))
    parts += [fused(tables[table], queries, as_of) for table, queries in single.items()]
    return reduce(DataFrame.unionByName, parts)


def report(executions: DataFrame, rows: DataFrame, catalogue: DataFrame, **names) -> DataFrame:
    """What the agents would have reported: snapshots where the schedule says so, changes elsewhere,
    and no removals for the queries that switch them off."""
    flags = catalogue.select(F.col("name").alias("query_name"), "snapshot")
    snap = flags.filter("snapshot").select("query_name")
    full = diff.snapshots(executions, rows.join(snap, "query_name", "left_semi"), **names)
    changes = diff.differential(executions, rows.join(snap, "query_name", "left_anti"), **names)
    return diff.suppress_removed(changes, catalogue).unionByName(full.select(*changes.columns))
