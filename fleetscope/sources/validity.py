"""Histories of changes kept as validity intervals, so that a past state is a range filter and no replay (D8).

An interval is (node, query, row, valid_from, valid_to): the run that brought the row
and the first one without it. Open intervals lie in a bucketed table that
batches of changes keep current; closed ones lie in folders by the day on which
they ended, one folder for each batch, and are never read again by the upkeep. The state at
a time reads the open intervals and the days from that time on: whatever
ended before is pruned by its folder, whatever began later by the statistics of the files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from fleetscope.operators.diff import KEYS
from fleetscope.sources.versioned import BucketedTable, Folder

FROM, TO = "valid_from", "valid_to"


def intervals(changes: DataFrame, keys: Sequence[str] = KEYS, run: str = "execution_no", row: str = "row") -> DataFrame:
    """(keys, row, valid_from, valid_to) out of SNAPSHOT / ADDED / REMOVED changes; ``valid_to`` is NULL while a row is there.

    A row that came at some run goes at its next REMOVED, or at the next SNAPSHOT
    of its (node, query), which starts over. Copies in a SNAPSHOT are one row.
    """
    comes = F.col("action").isin("SNAPSHOT", "ADDED")
    moves = changes.filter(comes | (F.col("action") == "REMOVED")).select(*keys, row, F.col(run).alias(FROM), comes.alias("__in")).distinct()
    later = Window.partitionBy(*keys, row).orderBy(F.desc(FROM), F.col("__in").asc())
    gone = F.min(F.when(~F.col("__in"), F.col(FROM))).over(later.rowsBetween(Window.unboundedPreceding, -1))
    paired = moves.withColumn("__gone", gone).filter("__in").select(*keys, row, FROM, "__gone")
    starts = changes.filter(F.col("action") == "SNAPSHOT").select(*keys, F.col(run).alias("__start")).distinct()
    over = paired.join(starts, list(keys)).filter(F.col("__start") > F.col(FROM)).groupBy(*keys, row, FROM).agg(F.min("__start").alias("__over"))
    return paired.join(over, [*keys, row, FROM], "left").select(*keys, row, FROM, F.least("__gone", "__over").alias(TO))


def valid_at(held: DataFrame, t) -> DataFrame:
    """Intervals that hold ``t``."""
    at = t if isinstance(t, Column) else F.lit(t)
    return held.filter((F.col(FROM) <= at) & (F.col(TO).isNull() | (F.col(TO) > at)))


class IntervalStore:
    """Intervals under ``path``. ``run`` names the run column of changes, of type ``kind``: a date, a timestamp or a number of which
    ``per_day`` make a day (folders by day are then folders by that many runs)."""

    def __init__(self, spark: SparkSession, path: str, run: str = "execution_no", kind: T.DataType | None = None, per_day: int = 1,
                 keys: Sequence[str] = KEYS, key_types: Sequence[T.DataType] | None = None, buckets: int = 16):
        self.spark, self.path, self.run, self.keys, self.per_day = spark, path.rstrip("/"), run, list(keys), per_day
        self.kind = kind or T.LongType()
        types = key_types or [T.StringType()] * len(self.keys)
        self.schema = T.StructType([*(T.StructField(k, t) for k, t in zip(self.keys, types)), T.StructField("row", T.StringType()),
                                    T.StructField(FROM, self.kind), T.StructField(TO, self.kind)])
        self.open = BucketedTable(spark, f"{self.path}/open", self.schema, self.keys, buckets)

    def _day(self, at: Column) -> Column:
        return F.floor(at / self.per_day).cast("string") if isinstance(self.kind, T.NumericType) else at.cast("date").cast("string")

    def fold(self, changes: DataFrame, batch_id: int) -> None:
        """Take in the next changes; those of a (node, query) have to come in the order of their runs. A batch counts once.

        Closed intervals are written before the commit that takes them out of the
        open ones, and readers take closed folders of committed batches only.
        """
        if self.open.seen("changes", batch_id):
            return
        changes = changes.select(*self.keys, "row", F.col(self.run).cast(self.kind).alias(self.run), "action").persist()
        try:
            touched = [r[0] for r in changes.select(self.open.bucket()).distinct().collect()]
            now = self._merged(self.open.read(only=touched), changes).persist()
            closed = now.filter(F.col(TO).isNotNull()).withColumn("day", self._day(F.col(TO)))
            (closed.repartition("day").sortWithinPartitions(FROM).write.mode("overwrite").partitionBy("day")
                   .parquet(f"{self.path}/closed/batch_id={batch_id}"))
            self.open.fold(changes, lambda current, new: self._merged(current, new).filter(F.col(TO).isNull()), "changes", batch_id)
            now.unpersist()
        finally:
            changes.unpersist()

    def _merged(self, held: DataFrame, changes: DataFrame) -> DataFrame:
        """Open intervals count as rows that came when they did."""
        before = held.select(*self.keys, "row", F.col(FROM).alias(self.run), F.lit("ADDED").alias("action"))
        return intervals(before.unionByName(changes.select(before.columns)), self.keys, self.run)

    def as_of(self, t) -> DataFrame:
        """The rows that were there after the last run up to ``t``."""
        at = (t if isinstance(t, Column) else F.lit(t)).cast(self.kind)
        commit = self.open.commit()
        now = self.open.read(commit.version)
        if Folder(self.spark, f"{self.path}/closed").names():
            schema = T.StructType([*self.schema.fields, T.StructField("batch_id", T.LongType()), T.StructField("day", T.StringType())])
            closed = self.spark.read.schema(schema).option("basePath", f"{self.path}/closed").parquet(f"{self.path}/closed")
            day = F.col("day").cast("long") if isinstance(self.kind, T.NumericType) else F.col("day")
            ref = F.floor(at / self.per_day) if isinstance(self.kind, T.NumericType) else self._day(at)
            now = now.unionByName(closed.filter((day >= ref) & (F.col("batch_id") <= commit.batches.get("changes", -1))).drop("batch_id", "day"))
        return valid_at(now, at).select(*self.keys, "row")
