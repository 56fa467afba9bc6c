"""Ordered work inside groups that may be very large.

A plain ``Window.partitionBy(node)`` sends all rows of a node to one task. One
noisy host can hold a third of a fleet's rows, so the helpers here cut every
group into ordered *slots* (a slice of time or of an id range), do the row-level
work per (group, slot), and settle the borders on one summary row per slot. The
results are exactly those of the plain window. Nothing is counted or run while
the plan is built, and the plan is the same at every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BEFORE_ALL = -(2**62)

ID_WIDTH = 1 << 18


def time_slot(ts: Column, seconds: int = 10, ident: Column | None = None) -> Column:
    """Order-preserving slot number of a timestamp; NULL sorts first, as in Spark's ASC order.

    Rows without a time are cut by ``ident``, the integer id that follows the
    time in the order, so that they don't share one slot.
    """
    micros = F.unix_micros(ts.cast("timestamp"))
    unknown = F.lit(BEFORE_ALL)
    if ident is not None:
        unknown = F.lit(BEFORE_ALL // 2) + F.coalesce(F.floor(ident / F.lit(ID_WIDTH)).cast("bigint"), F.lit(BEFORE_ALL // 2))
    return F.coalesce(F.floor(micros / F.lit(seconds * 1_000_000)).cast("bigint"), unknown)


def id_slot(ident: Column, width: int = ID_WIDTH) -> Column:
    """Order-preserving slot number of an integer id."""
    return F.coalesce(F.floor(ident / F.lit(width)).cast("bigint"), F.lit(BEFORE_ALL))


def _safe_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Non-null twins of the key columns, so that a NULL group still joins to its own summary."""
    added, names = {}, []
    for i, key in enumerate(keys):
        twin, flag = f"__k{i}", f"__n{i}"
        added[twin] = F.coalesce(F.col(key).cast("string"), F.lit(""))
        added[flag] = F.col(key).isNull()
        names += [twin, flag]
    return df.withColumns(added), names


def lag_in_slots(df: DataFrame, keys: Sequence[str], order: Sequence[str], slot: Column, take: dict[str, str]) -> DataFrame:
    """Add ``{new: old}`` columns holding the previous row's value in ascending ``order``.

    ``slot`` must not decrease along ``order``. The last row of each slot is
    found by a partially combined aggregate and handed to the next slot.
    """
    base, names = _safe_keys(df, keys)
    base = base.withColumn("__slot", slot)
    inside = Window.partitionBy(*names, "__slot").orderBy(*order)
    local = base.select(*base.columns, *[F.lag(old).over(inside).alias(f"__in_{new}") for new, old in take.items()],
                        (F.row_number().over(inside) == 1).alias("__first"))
    values = F.struct(*[F.col(old).alias(f"__up_{new}") for new, old in take.items()])
    tails = base.groupBy(*names, "__slot").agg(F.max_by(values, F.struct(*order)).alias("__tail"))
    carried = tails.select(*names, "__slot", F.lag("__tail").over(
        Window.partitionBy(*names).orderBy("__slot")).alias("__carry")).select(*names, "__slot", "__carry.*")
    joined = local.join(carried, [*names, "__slot"], "left")
    return joined.select(*df.columns, *[
        F.when(F.col("__first"), F.col(f"__up_{new}")).otherwise(F.col(f"__in_{new}")).alias(new) for new in take])


def number_in_slots(df: DataFrame, keys: Sequence[str], order: Sequence[str], slot: Column, name: str = "row_no") -> DataFrame:
    """Add the 1-based position of each row in its group, in ascending ``order``."""
    base, names = _safe_keys(df, keys)
    base = base.withColumn("__slot", slot)
    sizes = base.groupBy(*names, "__slot").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*names).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*names, "__slot", F.sum("__n").over(earlier).alias("__off"))
    inside = Window.partitionBy(*names, "__slot").orderBy(*order)
    return (base.withColumn("__rn", F.row_number().over(inside))
                .join(offsets, [*names, "__slot"], "left")
                .select(*df.columns, (F.coalesce("__off", F.lit(0)) + F.col("__rn")).cast("bigint").alias(name)))


def newest_in_slots(df: DataFrame, keys: Sequence[str], order: Sequence[str], slot: Column, n: int) -> DataFrame:
    """Keep the last ``n`` rows of each group in ascending ``order``, for any ``n``.

    Slots wholly inside or outside the limit are decided by their counts alone;
    only the one slot per group that straddles the limit is sorted.
    """
    base, safe = _safe_keys(df, keys)
    base = base.withColumn("__slot", slot)
    sizes = base.groupBy(*safe, "__slot").agg(F.count(F.lit(1)).alias("__n"))
    later = Window.partitionBy(*safe).orderBy(F.desc("__slot")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("__newer", F.coalesce(F.sum("__n").over(later), F.lit(0)))
    needed = (ranked.filter(F.col("__newer") < n)
                    .select(*safe, "__slot", (F.lit(n) - F.col("__newer")).alias("__room"),
                            (F.col("__n") > F.lit(n) - F.col("__newer")).alias("__cut")))
    rows = base.join(needed, [*safe, "__slot"])
    inside = Window.partitionBy(*safe, "__slot").orderBy(*[F.desc(c) for c in order])
    whole = rows.filter(~F.col("__cut")).select(*df.columns)
    part = (rows.filter("__cut").withColumn("__rn", F.row_number().over(inside))
                .filter(F.col("__rn") <= F.col("__room")).select(*df.columns))
    return whole.unionByName(part)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                splits: int = 64) -> DataFrame:
    """First ``n`` rows of each group in ``order`` (which must be total).

    Two rounds: each input split group is cut to ``n`` first, so the last round
    sees at most ``n * splits`` rows of a group. Spark also limits the groups
    before each shuffle (``WindowGroupLimit``).
    """
    cut = df.withColumn("__part", F.spark_partition_id() % splits)
    first = Window.partitionBy(*keys, "__part").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    return (cut.withColumn("__rn", F.row_number().over(first)).filter(F.col("__rn") <= n)
               .withColumn("__rn", F.row_number().over(last)).filter(F.col("__rn") <= n)
               .drop("__rn", "__part"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``; copies are thinned out before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")
