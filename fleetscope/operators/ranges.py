"""Delivery reconciliation on ranges of ids instead of single ids (G8).

Sequence ids are nearly dense, so what was sent and what was acknowledged are a few
runs of consecutive ids each. Ids are counted once and coalesced to runs inside
slots of an id range; a sweep over the borders of both sides in a slot gives
stretches with the same delivery state, and stretches that touch across slots
become one. No step sees all ids of a host in one task, and neither side is joined to the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetscope.functions.ordered import ID_WIDTH


def delivery_state(sent: Column, acked: Column) -> Column:
    return F.when(sent == 0, "unknown").when(acked == 0, "lost").when((sent > 1) | (acked > 1), "duplicate").otherwise("delivered")


def id_runs(df: DataFrame, ident: str, keys: Sequence[str] = (), width: int = ID_WIDTH) -> DataFrame:
    """(keys, slot, first, last, times): runs of consecutive ids that occur equally often, cut at slot borders. NULL ids are left out."""
    counts = df.filter(F.col(ident).isNotNull()).groupBy(*keys, F.col(ident).cast("bigint").alias("id")).agg(F.count(F.lit(1)).alias("times"))
    slotted = counts.withColumn("slot", F.floor(F.col("id") / F.lit(width)).cast("bigint"))
    place = F.row_number().over(Window.partitionBy(*keys, "slot", "times").orderBy("id"))
    return slotted.withColumn("run", F.col("id") - place).groupBy(*keys, "slot", "times", "run").agg(
        F.min("id").alias("first"), F.max("id").alias("last")).select(*keys, "slot", "first", "last", "times")


def reconcile_ranges(sent: DataFrame, acks: DataFrame, ident: str = "sequence_no", keys: Sequence[str] = (), up_to: DataFrame | None = None,
                     width: int = ID_WIDTH) -> DataFrame:
    """(keys, first, last, sent, acked, delivery): stretches of ids of one state, in the terms of ``registry.reconcile``.

    ``up_to`` (keys, up_to) holds cumulative acknowledgements: the largest of a
    key counts once for every id sent up to it. Ids that occur on neither side are in no stretch.
    """
    def borders(runs: DataFrame, side: str) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        step = lambda at, n: F.struct(at.alias("at"), (n if side == "sent" else zero).alias("sent"), (zero if side == "sent" else n).alias("acked"),
                                      (n if side == "through" else zero).alias("through"))
        return runs.select(*keys, "slot", F.explode(F.array(step(F.col("first"), F.col("times")), step(F.col("last") + 1, -F.col("times")))).alias("b")).select(
            *keys, "slot", "b.*")

    went = id_runs(sent, ident, keys, width)
    moves = borders(went, "sent").unionByName(borders(id_runs(acks, ident, keys, width), "acked"))
    if up_to is not None:
        mark = up_to.groupBy(*keys).agg(F.max("up_to").cast("bigint").alias("__to"))
        slots = went.select(*keys, "slot").distinct()
        met = (slots.join(mark, list(keys)) if keys else slots.withColumn("__to", mark.scalar())).withColumn("first", F.col("slot") * F.lit(width)).filter("__to >= first")
        through = met.select(*keys, "slot", "first", F.least(F.col("first") + F.lit(width - 1), F.col("__to")).alias("last"), F.lit(1).cast("bigint").alias("times"))
        moves = moves.unionByName(borders(through, "through"))
    steps = moves.groupBy(*keys, "slot", "at").agg(*[F.sum(c).alias(c) for c in ("sent", "acked", "through")])
    sweep = Window.partitionBy(*keys, "slot").orderBy("at")
    level = lambda c: F.sum(c).over(sweep.rowsBetween(Window.unboundedPreceding, 0))
    flat = steps.select(*keys, "slot", F.col("at").alias("first"), (F.lead("at").over(sweep) - 1).alias("last"), level("sent").alias("sent"),
                        level("acked").alias("acked"), level("through").alias("through"))
    # A cumulative acknowledgement says nothing about ids that were not sent; ``through`` is inside ``acked`` already.
    held = flat.withColumn("acked", F.when(F.col("sent") == 0, F.col("acked") - F.col("through")).otherwise(F.col("acked"))).filter("sent > 0 or acked > 0")
    # Only stretches that reach a slot's border may go on in the next one; there are two a slot at most.
    edge = (F.col("first") == F.col("slot") * F.lit(width)) | (F.col("last") == (F.col("slot") + 1) * F.lit(width) - 1)
    held = held.withColumn("__alone", F.when(~edge, F.col("first")))
    order = Window.partitionBy(*keys, "__alone").orderBy("first")
    same = (F.lag("last").over(order) + 1 == F.col("first")) & (F.lag("sent").over(order) == F.col("sent")) & (F.lag("acked").over(order) == F.col("acked"))
    joined = held.withColumn("__new", (~F.coalesce(same, F.lit(False))).cast("bigint")).withColumn("__no", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = joined.groupBy(*keys, "__alone", "__no").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("sent").alias("sent"), F.first("acked").alias("acked"))
    return out.select(*keys, "first", "last", "sent", "acked", delivery_state(F.col("sent"), F.col("acked")).alias("delivery"))


def expand(ranges: DataFrame, ident: str = "sequence_no") -> DataFrame:
    """One row an id again."""
    rest = [c for c in ranges.columns if c not in ("first", "last")]
    return ranges.select(F.explode(F.sequence("first", "last")).alias(ident), *rest)
