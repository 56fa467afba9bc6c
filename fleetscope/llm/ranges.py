"""Rows in the order of a key, cut into parts of about equal size, for work that needs neighbours or positions."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys sampled for each border, so that parts differ little in size.
PER_PART = 16


def key_column(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def ordered(row) -> tuple:
    """A key whose NULLs come first."""
    return tuple((v is not None, v) for v in row)


def borders(df: DataFrame, keys: Sequence[str], parts: int) -> list[tuple]:
    """The first key of each of at most ``parts`` parts; the first one is the least key of all.

    At most about ``PER_PART`` distinct keys a part come to the driver, chosen by their hash.
    """
    key = key_column(keys)
    rows, least = df.agg(F.count(F.lit(1)), F.min(key)).first()
    if not rows:
        return []
    every = max(1, rows // (PER_PART * parts))
    chosen = df.select(*[F.col(k) for k in keys]).where(F.pmod(F.xxhash64(*keys), F.lit(every)) == 0).distinct().collect()
    sample = sorted({ordered(r) for r in chosen} | {ordered(least)})
    step = max(1.0, len(sample) / parts)
    return [sample[int(i * step)] for i in range(min(parts, len(sample))) if i * step < len(sample)]


def with_part(df: DataFrame, keys: Sequence[str], edges: list[tuple], part: str, head: str) -> DataFrame:
    """Add the number of the part that a row belongs to, and whether its key is that part's first."""
    def place(keyed: pd.DataFrame) -> pd.Series:
        columns = [[None if v is pd.NA or v != v else v for v in keyed[c]] for c in keyed.columns]
        out = []
        for row in zip(*columns):
            own = ordered(row)
            at = max(bisect_right(edges, own) - 1, 0)
            out.append(2 * at + bool(edges and edges[at] == own))
        return pd.Series(out, dtype="int64")

    # Whole numbers with NULLs would turn into doubles on the way to pandas, so they travel as decimals.
    exact = [F.col(k).cast("decimal(20,0)").alias(f"k{i}") if dict(df.dtypes)[k] in ("bigint", "int") else F.col(k).alias(f"k{i}")
             for i, k in enumerate(keys)]
    code = F.pandas_udf(place, "long")(F.struct(*exact))
    return (df.withColumn(part, code).withColumn(head, F.col(part) % 2 == 1)
              .withColumn(part, F.floor(F.col(part) / 2).cast("int")))
