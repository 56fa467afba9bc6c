"""Helpers shared by the training-data operators: Arrow text buffers, scratch tables, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..session import scratch_dir

#: Bytes that separate words in every contract of this package.
SPACES = b" \t\n\x0b\x0c\r"
#: What ends a word, as a Java and Python pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows that go to a Python worker at a time. At Spark's 64 MB (or 10,000 rows) Java and Python each hold a task's
#: whole share of the texts, several times over, and neither gives the memory back.
BATCH_BYTES = 1 << 22
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column end to end, and the border of each row in them. NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    data = data.cast(pa.large_binary())
    if data.null_count:
        data = data.fill_null(b"")
    _, borders, content = data.buffers()
    off = np.frombuffer(borders, np.int64)[data.offset:data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
    buf = np.frombuffer(content, np.uint8)[off[0]:off[-1]] if content is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def per_batch(fn: Callable[[pa.RecordBatch], dict], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function out of one that turns a batch into columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(fn(batch), schema=schema)
    return run


def slices(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes together; a longer row is a run of its own."""
    start, rows = 0, len(off) - 1
    while start < rows:
        end = max(start + 1, int(np.searchsorted(off, off[start] + limit, side="right")) - 1)
        yield start, min(end, rows)
        start = end


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def short_batches(df: DataFrame) -> DataFrame:
    """The frame, its session set to Arrow batches of BATCH_BYTES unless it has a setting of its own. The rows are the same."""
    if df.sparkSession.conf.get(BATCH_CONF, None) is None:
        df.sparkSession.conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df


def few_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of rows that the driver has, inside the plan: a list would go through Python workers of another kind, which executors then keep."""
    kinds = to_arrow_schema(_parse_datatype_string(schema))
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds))


def saved(df: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared scratch folder and read back: lineage ends there and survives lost executors."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_crc32(column: Column | str) -> Column:
    """crc32 of an id's text."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components as (node, root); ``root`` is the smallest node of the component.

    Alternating stars: first each node hands its larger neighbours to its
    smallest one, then its smaller neighbours. Rounds grow with the logarithm
    of the diameter; each ends in a written table. Groups are summarised by
    ``min`` (combined before the shuffle) and a join, so that no node's
    neighbours ever meet in one row. Nodes without an edge are not returned.
    """
    spark = edges.sparkSession
    now = saved(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct(), "stars")

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        both = pairs.select(F.col("hi").alias("n"), F.col("lo").alias("m"))
        if larger:
            both = both.union(pairs.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("root"))
        out = both.join(least, "n")
        if larger:
            out = out.where("m > n").select(F.col("m").alias("hi"), F.col("root").alias("lo"))
        else:
            out = out.select(F.col("m").alias("hi"), F.col("root").alias("lo")).union(
                least.select(F.col("n").alias("hi"), F.col("root").alias("lo")))
        return out.where("hi <> lo").distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        now = saved(star(star(now, True), False), "stars")
        found = mark(now)
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)


def keep_on_disk(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.DISK_ONLY)
