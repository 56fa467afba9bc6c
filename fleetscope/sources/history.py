"""Ids that were seen before, for de-duplication against everything stored (G6).

Ids lie in a table bucketed by id, which Spark joins without shuffling it. In
front of it stand Bloom segments by day and share of the ids: a new batch
asks them first, and only ids that may be known are looked up. A further segment
of a day takes twice as many ids as the one before, or all that the batch brings,
so an id asks few of them however many ids a day has. Segments of one size are
asked together.

Order of writes: segments, the caller's rows, ids. Segments may know ids that the
table does not have yet, never the other way round; ids carry the batch that
brought them, and a batch that is run again does not take its own for duplicates.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetscope.operators.registry import dedup_events, has_id
from fleetscope.sources.versioned import BucketedTable

SEGMENTS = T.StructType([T.StructField("share", T.IntegerType()), T.StructField("day", T.DateType()), T.StructField("part", T.IntegerType()),
                         T.StructField("ids", T.LongType()), T.StructField("bits", T.BinaryType())])
#: Bits that an id sets, and bits of a segment for each id that it takes.
PROBES, BITS_AN_ID = 5, 10
#: Bits of the largest segment: 20 MB, for 16 million ids.
MOST_BITS = 160 << 20
#: Places of a segment up to which 32 stand together, and up to which 8 do; larger ones are asked one by one.
FEW_PLACES, MANY_PLACES = 1 << 22, 1 << 24
ODD, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, one row for each probe."""
    h = hashes.view(np.uint64)
    second = (h ^ (h >> np.uint64(29))) * STEP | np.uint64(1)
    mixed = (((h + np.uint64(i) * second) * ODD >> np.uint64(17)) for i in range(PROBES))
    if bits & (bits - 1):
        return np.stack([m % np.uint64(bits) for m in mixed]).astype(np.int64)
    return np.stack([m & np.uint64(bits - 1) for m in mixed]).astype(np.int64)


def has_all(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def stacked(segments: list[np.ndarray]) -> list[tuple[int, np.ndarray, bool]]:
    """(places, table, whether stacked): segments of one size side by side, at each place a number with a bit for each of them."""
    alike, out = defaultdict(list), []
    for bits in segments:
        alike[len(bits) * 8].append(bits)
    for size, same in alike.items():
        if size > MANY_PLACES:
            out += [(size, bits, False) for bits in same]
            continue
        width = 32 if size <= FEW_PLACES else 8
        for some in (same[i:i + width] for i in range(0, len(same), width)):
            kind = np.min_scalar_type((1 << len(some)) - 1).type
            table = np.zeros(size, kind)
            for n, bits in enumerate(some):
                table |= np.unpackbits(bits, bitorder="little").astype(kind) << kind(n)
            out.append((size, table, True))
    return out


def in_some(tables: list[tuple[int, np.ndarray, bool]], h: np.ndarray) -> np.ndarray:
    """Whether some segment has all bits of a hash."""
    found, at = np.zeros(len(h), bool), {size: places(h, size) for size in {t[0] for t in tables}}
    for size, table, together in tables:
        if together:
            held = table[at[size][0]]
            for probe in at[size][1:]:
                held &= table[probe]
            found |= held != 0
        else:
            found |= has_all(table, at[size])
    return found


def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids that some segment of their share may hold. Rows are (share, bits, h, id), a share's segments before its ids."""
    share, segments, tables = None, [], []
    for batch in batches:
        shares, is_id = batch.column(0).to_numpy(), np.asarray(batch.column(1).is_null())
        edges = [0, *(np.flatnonzero((shares[1:] != shares[:-1]) | (is_id[1:] != is_id[:-1])) + 1).tolist(), batch.num_rows]
        for a, z in zip(edges[:-1], edges[1:]):
            if z == a:
                continue
            if shares[a] != share:
                share, segments, tables = shares[a], [], []
            if not is_id[a]:
                segments += [np.frombuffer(b, np.uint8) for b in batch.column(1).slice(a, z - a).to_pylist()]
                continue
            if segments:
                segments, tables = [], stacked(segments)
            found = in_some(tables, batch.column(2).slice(a, z - a).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(3).slice(a, z - a).filter(pa.array(found))], ["id"])


def filled(held: list[tuple[int, int, bytes]], hashes: np.ndarray, least: int) -> list[tuple[int, int, bytes]]:
    """A day's segments (part, ids, bits) with new ids: the last one up to its room, then larger ones; ``least`` ids fit into the first."""
    out = [[part, ids, bits] for part, ids, bits in sorted(held)]
    while len(hashes):
        room = max(len(out[-1][2]) * 8 // BITS_AN_ID, 1) if out else 0
        if not out or out[-1][1] >= room:
            wanted = max(2 * room, least, len(hashes)) * BITS_AN_ID
            size = least * BITS_AN_ID // 8 if wanted == least * BITS_AN_ID else min(1 << (wanted - 1).bit_length(), MOST_BITS) // 8
            out.append([out[-1][0] + 1 if out else 0, 0, bytes(max(size, 1))])
            continue
        now, hashes = np.split(hashes, [room - out[-1][1]])
        bits = np.frombuffer(out[-1][2], np.uint8).copy()
        at = places(now, len(bits) * 8).ravel()
        np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        out[-1][1:] = out[-1][1] + len(now), bits.tobytes()
    return [tuple(x) for x in out]


class IdHistory:
    """Stored ids under ``path``; ``segment_ids`` is how many the first segment of a day takes before the day gets another, unless a batch brings more."""

    def __init__(self, spark: SparkSession, path: str, key: str = "sequence_id", ts: str = "ts", shares: int = 16, segment_ids: int = 1 << 16):
        self.spark, self.path, self.key, self.ts, self.shares, self.segment_ids = spark, path.rstrip("/"), key, ts, shares, segment_ids
        self.segments = BucketedTable(spark, f"{self.path}/segments", SEGMENTS, ["share"], shares)
        self.name = f"seen_ids_{zlib.crc32(self.path.encode()):08x}"
        # The catalogue may be new to this session; the files say what the table holds.
        spark.sql(f"create table if not exists {self.name} (id string, day date, batch_id bigint) using parquet "
                  f"clustered by (id) into {shares} buckets location '{self.path}/ids'")

    def _ids(self, df: DataFrame) -> DataFrame:
        named = df.filter(has_id(df, self.key)).select(F.col(self.key).cast("string").alias("id"), F.col(self.ts).cast("date").alias("day"))
        return named.withColumn("h", F.xxhash64("id")).withColumn("share", F.pmod("h", F.lit(self.shares)).cast("int"))

    def known(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Ids of the batch that earlier batches brought."""
        ids = self._ids(batch).select("share", "h", "id").distinct().select("share", F.lit(None).cast("binary").alias("bits"), "h", "id")
        segments = self.segments.read().select("share", "bits", F.lit(None).cast("long").alias("h"), F.lit(None).cast("string").alias("id"))
        asked = segments.union(ids).repartition("share").sortWithinPartitions(F.col("share") * 2 + F.col("bits").isNull().cast("int"))
        maybe = asked.mapInArrow(possible, "id string")
        stored = self.spark.table(self.name).filter(F.col("batch_id") < batch_id)
        return stored.join(maybe, "id", "left_semi").select("id").distinct()

    def fresh(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Rows whose id no earlier batch brought; rows without an id are always fresh."""
        return self._without(batch, self.known(batch, batch_id))

    def _without(self, rows: DataFrame, known: DataFrame) -> DataFrame:
        return rows.join(known.withColumnRenamed("id", "__known"), F.col(self.key).cast("string") == F.col("__known"), "left_anti")

    def remember(self, rows: DataFrame, batch_id: int) -> None:
        stored = self._ids(rows).select("id", "day", F.lit(batch_id).cast("bigint").alias("batch_id")).repartition(self.shares, "id")
        stored.write.insertInto(self.name)

    def announce(self, rows: DataFrame, batch_id: int) -> None:
        """Put the ids of new rows into the segments of their days."""
        least, schema = self.segment_ids, to_arrow_schema(SEGMENTS)

        def add(key: tuple, held: pa.Table, new: pa.Table) -> pa.Table:
            share, day = (k.as_py() for k in key)
            old = list(zip(*(held.column(n).to_pylist() for n in ("part", "ids", "bits"))))
            rows = filled(old, new.column("h").to_numpy(), least)
            return pa.Table.from_pylist([dict(zip(SEGMENTS.names, (share, day, *row))) for row in rows], schema=schema)

        def merge(current: DataFrame, new: DataFrame) -> DataFrame:
            return current.groupBy("share", "day").cogroup(new.distinct().groupBy("share", "day")).applyInArrow(add, SEGMENTS)

        self.segments.fold(self._ids(rows).select("share", "day", "h"), merge, "ids", batch_id)

    def take(self, batch: DataFrame, batch_id: int, write: Callable[[DataFrame, int], None]) -> None:
        """``foreachBatch`` step: the batch's new rows, each id once, go to ``write``; a batch that is run again writes the same rows.

        ``write`` has to replace what it wrote for the same batch id, as the sinks here do.
        """
        # The batch as it came has the same ids as its first rows, and needs no order to tell them.
        firsts = dedup_events(batch, self.key, [self.ts, *[c for c in ("event_id",) if c in batch.columns]])
        rows = self._without(firsts, self.known(batch, batch_id)).persist()
        try:
            self.announce(rows, batch_id)
            write(rows, batch_id)
            if not self.spark.table(self.name).filter(F.col("batch_id") == batch_id).isEmpty():
                return  # an earlier attempt got this far
            self.remember(rows, batch_id)
        finally:
            rows.unpersist()
