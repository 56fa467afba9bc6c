"""Exact top-k search (operator 1) with multi-resolution segment statistics.

A vector is cut into segments; each keeps its mean m and deviation s, times the
root of its length. For two vectors the squared distance is at least the sum of
(m - m')² + (s - s')² over the segments, so their inner product is at most the
inner product of these statistics. Bounds go from one segment to many; a pair
whose bound falls below the query's k-th best score is dropped, and survivors
get their exact score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import ROWS, Best, matrices, query_rows, search

LEVELS = (1, 4, 16)
#: Room for rounding in the bounds, as a share of the product of the norms.
SLACK = 1e-9
#: Share of live pairs above which a whole matrix product is cheaper than single pairs.
DENSE = 0.1


def statistics(rows: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, scaled by the root of their length, side by side."""
    edges = np.unique(np.linspace(0, rows.shape[1], segments + 1).astype(int))[:-1]
    size = np.diff(np.append(edges, rows.shape[1]))
    mean = np.add.reduceat(rows, edges, axis=1) / size
    spread = rows - np.repeat(mean, size, axis=1)
    deviation = np.sqrt(np.add.reduceat(spread * spread, edges, axis=1) / size)
    return np.concatenate((mean, deviation), axis=1) * np.sqrt(np.tile(size, 2))


def inner(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs (a, b) of whole-number rows; beyond 2**53 by Python's integers."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**53:
        if len(a) > DENSE * len(q) * len(x):
            return (q @ x.T)[a, b]
        return np.einsum("ij,ij->i", q[a], x[b])
    return np.array([sum(int(u) * int(v) for u, v in zip(q[i], x[j])) for i, j in zip(a, b)], object)


def block_of(scale: float):
    def build(rows: list) -> dict[int, tuple]:
        out: dict[int, tuple] = {}
        for size in sorted({len(r["vector"]) for r in rows}):
            ids = np.array([r["id"] for r in rows if len(r["vector"]) == size], np.int64)
            out[size] = ids, np.floor(np.array([r["vector"] for r in rows if len(r["vector"]) == size]) * scale)
        return out
    return build


def scan(block: dict[int, tuple], batches: Iterator[pa.RecordBatch], k: int, scale: float) -> Iterator[pa.RecordBatch]:
    held = {size: (ids, q, [statistics(q, s) for s in LEVELS if s <= size], np.linalg.norm(q, axis=1), Best(len(ids), k)) for size, (ids, q) in block.items()}
    for batch in batches:
        for ids, rows in matrices(batch.column(0), batch.column(1)):
            if rows.shape[1] not in held:
                continue
            own, q, stats, norm, best = held[rows.shape[1]]
            rows = np.floor(rows * scale)
            for at in range(0, len(ids), ROWS):
                x, name = rows[at:at + ROWS], ids[at:at + ROWS]
                alive = own[:, None] != name[None, :]
                # Scores are kept negative: a pair lives while its bound, with room for rounding, reaches -worst.
                room = norm[:, None] * np.linalg.norm(x, axis=1)[None, :] * SLACK + 1e-6 + best.worst[:, None]
                for level, mine in zip(LEVELS, stats):
                    theirs = statistics(x, level)
                    if alive.mean() > DENSE:
                        alive &= mine @ theirs.T + room >= 0
                    else:
                        a, b = np.nonzero(alive)
                        alive[a, b] = np.einsum("ij,ij->i", mine[a], theirs[b]) + room[a, b] >= 0
                a, b = np.nonzero(alive)
                if len(a):
                    best.add(a, name[b], -inner(q, x, a, b))
    for own, _, _, _, best in held.values():
        if len(best.score) and max(map(abs, best.score)) >= 2**63:
            raise OverflowError("an inner product does not fit into a long: scale the vectors down")
        yield pa.RecordBatch.from_arrays(
            [pa.array(own[best.query]), pa.array(best.id), pa.array([int(-s) for s in best.score], pa.int64())], ["query_id", "vec_id", "score"])


def exact_top_k(df: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the highest inner product of each query, over floor(scale * x).

    Ties go to the smaller id; a query's own id is no candidate. Vectors of
    different lengths don't meet. NULL ids, NULL and empty vectors, and those
    with NULL or non-finite components take no part. A repeated id is one
    query, with the least of its vectors, and as many candidates as it has rows.
    Scores are longs: a pair whose score does not fit into one stops the job
    with a message. An empty table gives no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return search(query_rows(df, is_query, id_col, vector_col), rows, k, block_of(scale),
                  lambda block, it: scan(block, it, k, scale), "long", ascending=False)
