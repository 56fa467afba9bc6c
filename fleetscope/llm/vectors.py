"""Vector columns as matrices, query blocks, and running top-k lists, for the two vector searches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Queries that are searched together: the block is what goes to the tasks.
QUERY_BLOCK = 2048
#: Rows that a task compares with a block of queries at a time.
ROWS = 1024


def matrices(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, rows) for each length of vector. NULL ids, NULL or empty vectors, and vectors with NULL, NaN or infinite components are left out."""
    length = np.asarray(vectors.value_lengths().fill_null(0))
    values = np.asarray(vectors.flatten().cast(pa.float64()).fill_null(np.nan))
    start = np.cumsum(length) - length
    known = np.asarray(ids.is_valid()) & (length > 0)
    numbers = np.asarray(ids.fill_null(0))
    for size in np.unique(length[known]).tolist():
        at = np.flatnonzero(known & (length == size))
        rows = values[start[at][:, None] + np.arange(size)]
        good = np.isfinite(rows).all(axis=1)
        if good.any():
            yield numbers[at[good]], rows[good]


def usable(vector: str) -> Column:
    """The same rule as ``matrices``, for counting and for picking queries."""
    v = F.col(vector)
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


class Best:
    """The k best (score, id) of each query so far; smaller scores first, then smaller ids."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.worst = np.full(queries, np.inf)

    def add(self, query: np.ndarray, ident: np.ndarray, score: np.ndarray) -> None:
        query, ident, score = (np.concatenate(p) for p in ((self.query, query), (self.id, ident), (self.score, score)))
        order = np.lexsort((ident, score, query))
        query, ident, score = query[order], ident[order], score[order]
        first = np.searchsorted(query, query)
        place = np.arange(len(query)) - first
        keep = place < self.k
        self.query, self.id, self.score = query[keep], ident[keep], score[keep]
        full = place == self.k - 1
        self.worst[query[full]] = score[full]


def search(queries: DataFrame, rows: DataFrame, k: int, block_of: Callable[[list], object],
           task: Callable[[object, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind: str, ascending: bool) -> DataFrame:
    """The k best rows of each query: each block of queries goes to all tasks, which return k rows of each query at most.

    A block holds about ``QUERY_BLOCK`` queries, whatever the size of the table;
    several blocks are searched one after another, each into a written table.
    """
    spark = rows.sparkSession
    blocks = -(-queries.count() // QUERY_BLOCK)
    parts = []
    for i in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i) if blocks > 1 else queries
        shared = spark.sparkContext.broadcast(block_of(part.orderBy("id").collect()))
        found = rows.mapInArrow(lambda it, b=shared: task(b.value, it), f"query_id long, vec_id long, score {kind}")
        best = Window.partitionBy("query_id").orderBy(F.col("score").asc() if ascending else F.col("score").desc(), "vec_id")
        top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        parts.append(saved(top, "top") if blocks > 1 else top)
    if not parts:
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {kind}")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def query_rows(df: DataFrame, is_query: Column, id_col: str, vector_col: str) -> DataFrame:
    """One row for each query id; where an id repeats, the least of its vectors."""
    rows = df.where(is_query & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(usable("vector")).groupBy("id").agg(F.min("vector").alias("vector"))
