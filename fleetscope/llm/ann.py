"""Approximate nearest neighbours (operator 6) by an inverted multi-index.

Two halves of the vector have their own centroids, fitted on a bounded sample;
a row's cell is the pair of its nearest ones. A query walks through the cells
by the sum of its two distances, with a heap, until they hold enough rows, and
those rows are ranked by their exact distance.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .vectors import ROWS, Best, matrices, query_rows, search, usable

#: Rows that the centroids are fitted on at most, centroids of a half, rounds of the fit.
SAMPLE, CENTROIDS, ROUNDS = 20_000, 256, 8
#: Share of all rows that a query's cells hold together before its walk ends, and the least number of them.
PROBE, LEAST = 0.4, 2_000


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows * rows).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(axis=1)


def fit_half(rows: np.ndarray, count: int) -> np.ndarray:
    """Lloyd's rounds from evenly spaced sample rows; empty centroids stay where they are."""
    centres = rows[np.unique(np.linspace(0, len(rows) - 1, min(count, len(rows))).astype(int))].copy()
    for _ in range(ROUNDS):
        near = distances(rows, centres).argmin(axis=1)
        size = np.bincount(near, minlength=len(centres))
        order = np.argsort(near, kind="stable")
        used = np.flatnonzero(size)
        centres[used] = np.add.reduceat(rows[order], (np.cumsum(size) - size)[used], axis=0) / size[used, None]
    return centres


def halves(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = rows.shape[1] // 2
    return rows[:, :cut], rows[:, cut:]


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, need: int) -> list[int]:
    """Cells in order of first[i] + second[j] until they hold ``need`` rows."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, out, held, seen = [(first[a[0]] + second[b[0]], 0, 0)], [], 0, {(0, 0)}
    while heap and held < need:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(second) + int(b[j])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        for u, v in ((i + 1, j), (i, j + 1)):
            if u < len(a) and v < len(b) and (u, v) not in seen:
                seen.add((u, v))
                heapq.heappush(heap, (first[a[u]] + second[b[v]], u, v))
    return out


class Index:
    """Centroids for each length of vector, and how many rows each cell holds."""

    def __init__(self, sample: list):
        self.books: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({len(v) for v in sample}):
            rows = np.array([v for v in sample if len(v) == size], float)
            self.books[size] = tuple(fit_half(h, CENTROIDS) for h in halves(rows))
        self.counts: dict[int, np.ndarray] = {n: np.zeros(len(a) * len(b), np.int64) for n, (a, b) in self.books.items()}

    def cells(self, rows: np.ndarray) -> np.ndarray:
        book = self.books[rows.shape[1]]
        i, j = (distances(h, c).argmin(axis=1) for h, c in zip(halves(rows), book))
        return i * len(book[1]) + j


def assign(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector, size, cell) of each row; lengths that the sample has not seen share cell 0."""
    for batch in batches:
        for ids, rows in matrices(batch.column(0), batch.column(1)):
            if not rows.any(axis=1).all():
                keep = rows.any(axis=1)
                ids, rows = ids[keep], rows[keep]
            cells = index.cells(rows) if rows.shape[1] in index.books else np.zeros(len(ids), np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids), flat, pa.array(np.full(len(ids), rows.shape[1])), pa.array(cells)], ["id", "vector", "size", "cell"])


def block_of(index: Index, probe: float, least: int):
    """The queries of a block by length, each with a bit for every cell that it visits."""
    def build(rows: list) -> dict[int, tuple]:
        out: dict[int, tuple] = {}
        for size in sorted({len(r["vector"]) for r in rows}):
            mine = [r for r in rows if len(r["vector"]) == size]
            q = np.array([r["vector"] for r in mine], float)
            if size in index.books:
                counts = index.counts[size]
                near = [distances(h, c) for h, c in zip(halves(q), index.books[size])]
                visit = np.zeros((len(q), len(counts)), bool)
                need = max(least, int(np.ceil(probe * counts.sum())))
                for n in range(len(q)):
                    visit[n, walk(near[0][n], near[1][n], counts, need)] = True
            else:
                visit = np.ones((len(q), 1), bool)
            out[size] = np.array([r["id"] for r in mine], np.int64), q, np.packbits(visit.T, axis=1)
        return out
    return build


def scan(block: dict[int, tuple], batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    best = {size: Best(len(own), k) for size, (own, _, _) in block.items()}
    for batch in batches:
        cells = batch.column(2).to_numpy()
        size = np.asarray(batch.column(1).value_lengths())
        for n in np.unique(size).tolist():
            if n not in block:
                continue
            own, q, visit = block[n]
            at = np.flatnonzero(size == n)
            part = batch.take(pa.array(at))
            ids = part.column(0).to_numpy()
            rows = np.asarray(part.column(1).flatten()).reshape(len(at), n)
            for i in range(0, len(at), ROWS):
                x, name = rows[i:i + ROWS], ids[i:i + ROWS]
                alive = np.unpackbits(visit[cells[at[i:i + ROWS]]], axis=1, count=len(own)).astype(bool).T & (own[:, None] != name[None, :])
                rough = distances(q, x)
                room = 1e-9 * ((q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :])
                alive &= rough <= best[n].worst[:, None] ** 2 + room
                a, b = np.nonzero(alive)
                if len(a):
                    gap = q[a] - x[b]
                    best[n].add(a, name[b], np.sqrt((gap * gap).sum(axis=1)))
    for n, (own, _, _) in block.items():
        yield pa.RecordBatch.from_arrays([pa.array(own[best[n].query]), pa.array(best[n].id), pa.array(best[n].score)], ["query_id", "vec_id", "score"])


def nearest(df: DataFrame, is_query: Column, k: int = 10, probe: float = PROBE, least: int = LEAST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, by Euclidean distance.

    Ties go to the smaller id; a query's own id is no candidate. Zero vectors,
    NULL ids, NULL and empty vectors, and those with NULL or non-finite
    components take no part; vectors of different lengths don't meet. The
    sample are the ``SAMPLE`` rows of the least id hash; every row is indexed.
    A cell may hold any number of rows: they stay where they are read, and a
    task compares them in blocks.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = rows.where(usable("vector") & F.col("id").isNotNull() & F.exists("vector", lambda x: x != 0))
    index = Index([r["vector"] for r in good.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()])
    shared = spark.sparkContext.broadcast(index)
    placed = saved(good.mapInArrow(lambda it: assign(shared.value, it), "id long, vector array<double>, size long, cell long"), "cells")
    for r in placed.groupBy("size", "cell").agg(F.count("*").alias("n")).where(F.col("size").isin(list(index.books))).collect():  # at most CENTROIDS² for each length
        index.counts[r["size"]][r["cell"]] = r["n"]
    queries = query_rows(df.where(F.exists(vector_col, lambda x: x != 0)), is_query, id_col, vector_col)
    return search(queries, placed.select("id", "vector", "cell"), k, block_of(index, probe, least), lambda block, it: scan(block, it, k), "double", ascending=True)
