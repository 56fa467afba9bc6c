"""Differential results: what changed between runs of a query, and the way back.

Rows are string maps; two rows are the same when their entries are, in any
order. Runs are a table of their own, because a run with no rows removes
everything and leaves no trace in the row data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetscope.functions.rowkey import row_json

KEYS = ("node_id", "query_name")


def with_row_key(df: DataFrame, col: str = "columns", out: str = "row") -> DataFrame:
    """Replace the column map by its canonical text."""
    return df.withColumn(out, row_json(F.col(col))).drop(col)


def diff(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """Rows only in ``curr`` (ADDED) and only in ``prev`` (REMOVED), each once.

    One aggregation over both sides instead of two anti joins: copies of a row
    collapse before the shuffle.
    """
    cols = prev.columns
    both = (prev.withColumn("__p", F.lit(1)).withColumn("__c", F.lit(0))
            .unionByName(curr.withColumn("__p", F.lit(0)).withColumn("__c", F.lit(1))))
    seen = both.groupBy(*cols).agg(F.max("__p").alias("__p"), F.max("__c").alias("__c"))
    return seen.filter(F.col("__p") != F.col("__c")).select(
        *cols, F.when(F.col("__c") == 1, "ADDED").otherwise("REMOVED").alias("action"))


def successful_runs(executions: DataFrame, status: str = "status_code") -> DataFrame:
    """Runs that returned a result. Failed ones do not move the baseline."""
    return executions.filter(F.col(status) == 0)


def _neighbours(executions: DataFrame, keys: Sequence[str], run: str) -> DataFrame:
    """Each run with the run before and after it. One row per run, so groups are small; a run recorded twice is one run."""
    w = Window.partitionBy(*keys).orderBy(run)
    return executions.select(*keys, run).distinct().select(*keys, run, F.lag(run).over(w).alias("__prev_run"), F.lead(run).over(w).alias("__next_run"))


def differential(executions: DataFrame, rows: DataFrame, keys: Sequence[str] = KEYS, run: str = "execution_no",
                 session: str | None = None, status: str | None = "status_code", row: str = "row") -> DataFrame:
    """History of changes per (node, query): first run SNAPSHOT, later ADDED / REMOVED.

    The first run keeps duplicate rows, later ones are set differences. With
    ``session`` each agent session starts over with a SNAPSHOT, since agents
    hold the baseline in memory.

    A row was added where the run before did not have it, and removed at the
    run after its last sighting. Both are read off neighbouring sightings of
    the same row, so rows are shuffled once, by (node, query) and a hash of the
    row, and no run is joined to the next one. Runs join before that; they are one row each.
    """
    groups = [*keys, *([session] if session else [])]
    good = successful_runs(executions, status) if status else executions
    runs = _neighbours(good, groups, run)
    sightings = rows.select(*groups, run, row).join(runs, [*groups, run]).withColumn("__h", F.xxhash64(row))
    once = sightings.repartition(*groups, "__h").groupBy(*groups, "__h", row, run, "__prev_run", "__next_run").agg(
        F.count(F.lit(1)).cast("int").alias("__n"))
    w = Window.partitionBy(*groups, "__h", row).orderBy(run)
    seen = (once.withColumn("__seen_before", F.lag(run).over(w))
                .withColumn("__seen_after", F.lead(run).over(w)))
    is_new = F.col("__prev_run").isNotNull() & ~F.col("__seen_before").eqNullSafe(F.col("__prev_run"))
    is_gone = F.col("__next_run").isNotNull() & ~F.col("__seen_after").eqNullSafe(F.col("__next_run"))

    def change(at: str, action: str) -> Column:
        return F.struct(F.col(at).alias("run"), F.lit(action).alias("action"))

    came = F.when(F.col("__prev_run").isNull(), F.array_repeat(change(run, "SNAPSHOT"), F.col("__n"))).when(
        is_new, F.array(change(run, "ADDED")))
    went = F.when(is_gone, F.array(change("__next_run", "REMOVED")))
    none = F.array().cast(f"array<struct<run:{rows.schema[run].dataType.simpleString()},action:string>>")
    return seen.select(*groups, row, F.explode(F.concat(F.coalesce(came, none), F.coalesce(went, none))).alias("__c")).select(
        *groups, F.col("__c.run").alias(run), row, F.col("__c.action").alias("action"))


def snapshot_runs(executions: DataFrame, keys: Sequence[str] = KEYS, run: str = "execution_no", session: str | None = None,
                  status: str | None = "status_code") -> DataFrame:
    """(keys, run) of the runs that ``differential`` reports as SNAPSHOT, also those without rows: the first of each session."""
    good = successful_runs(executions, status) if status else executions
    groups = [*keys, *([session] if session else [])]
    return good.groupBy(*groups).agg(F.min(run).alias(run)).select(*keys, run)


def snapshots(executions: DataFrame, rows: DataFrame, keys: Sequence[str] = KEYS, run: str = "execution_no",
              status: str | None = "status_code") -> DataFrame:
    """Snapshot mode: all rows of every successful run."""
    good = successful_runs(executions, status) if status else executions
    return rows.join(good.select(*keys, run), [*keys, run], "left_semi").withColumn("action", F.lit("SNAPSHOT"))


def suppress_removed(diffs: DataFrame, catalogue: DataFrame, name: str = "query_name") -> DataFrame:
    """Drop REMOVED rows of queries whose schedule switches removals off."""
    mute = catalogue.filter(~F.col("removed")).select(F.col("name").alias(name), F.lit(True).alias("__mute"))
    return diffs.join(mute, name, "left").filter(
        (F.col("action") != "REMOVED") | F.col("__mute").isNull()).drop("__mute").select(*diffs.columns)


def state_as_of(diffs: DataFrame, t, keys: Sequence[str] = KEYS, run: str = "execution_no", row: str = "row",
                snapshot_runs: DataFrame | None = None) -> DataFrame:
    """The rows a query would return at ``t``: replay of the history since the last SNAPSHOT.

    A history whose first SNAPSHOT had no rows starts from nothing.
    ``snapshot_runs`` (keys and run, see the function of that name) names the
    SNAPSHOT runs; without it they are read off ``diffs``, which is then
    evaluated twice and knows nothing of later ones without rows. ``sources.validity``
    keeps histories in a form that needs no replay.
    """
    past = diffs.filter(F.col(run) <= F.lit(t))
    starts = past.filter(F.col("action") == "SNAPSHOT") if snapshot_runs is None else \
        snapshot_runs.filter(F.col(run) <= F.lit(t))
    base = starts.groupBy(*keys).agg(F.max(run).alias("__base"))
    live = past.join(base, list(keys), "left").filter(F.col("__base").isNull() | (F.col(run) >= F.col("__base")))
    gone = F.col("action") == "REMOVED"
    last = live.groupBy(*keys, row).agg(F.max(F.when(~gone, F.col(run))).alias("__in"), F.max(F.when(gone, F.col(run))).alias("__out"))
    return last.filter(F.col("__in").isNotNull() & (F.col("__out").isNull() | (F.col("__in") > F.col("__out")))).select(*keys, row)


def process_feed(bpf: DataFrame, audit: DataFrame) -> DataFrame:
    """Both process-event feeds as one, with the parent pid under one name and the feed marked."""
    if "ppid" in audit.columns and "parent" not in audit.columns:
        audit = audit.withColumnRenamed("ppid", "parent")
    return bpf.withColumn("feed", F.lit("bpf")).unionByName(
        audit.withColumn("feed", F.lit("audit")), allowMissingColumns=True)
