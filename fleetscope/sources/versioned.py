"""Tables that batches keep up to date: buckets, copy on write, and a manifest for each commit.

A commit rewrites only the buckets whose keys a batch touches, each into a folder
of its own, and then publishes a manifest that names the folder of every bucket.
Folders are never changed afterwards, so a reader holds on to whole commits, and a
writer that dies before the manifest has changed nothing. The manifest records
which batch of which stream it took in: a batch that is run again is passed over.

One writer at a time; any number of readers. The manifest holds one line a bucket,
so its size does not grow with the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BUCKET = "__bucket"


class Folder:
    """A folder in whatever store Spark reads, through Spark's own file system classes."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.path, self._new = path.rstrip("/"), jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, below: str = "") -> list[str]:
        at = self._new(f"{self.path}/{below}".rstrip("/"))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._new(f"{self.path}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a small file under a name of its own, then rename it: it is there whole or not at all."""
        hidden, final = self._new(f"{self.path}/.{uuid.uuid4().hex}"), self._new(f"{self.path}/{name}")
        stream = self._fs.create(hidden, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.rename(hidden, final):
            raise RuntimeError(f"{final} is there already: another writer is at work")

    def delete(self, name: str) -> None:
        self._fs.delete(self._new(f"{self.path}/{name}"), True)


class Commit(NamedTuple):
    version: int
    folders: dict[int, str]
    batches: dict[str, int]


class BucketedTable:
    """A keyed table under ``path`` with ``schema``; ``key`` columns choose the bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str], buckets: int = 16):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self.commits = Folder(spark, f"{self.path}/commits")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.key]), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        return [int(n) for n in self.commits.names() if n.isdigit()]

    def commit(self, version: int | None = None) -> Commit:
        """A commit, by default the newest; version 0 is the empty table."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Commit(0, {}, {})
        held = json.loads(self.commits.read(f"{version:012d}"))
        return Commit(version, {int(b): f for b, f in held["folders"].items()}, held["batches"])

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The table at a commit, or some of its buckets; others' files are not looked at."""
        folders = self.commit(version).folders
        paths = [f"{self.path}/{f}" for b, f in sorted(folders.items()) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def seen(self, stream: str, batch_id: int) -> bool:
        """Whether a batch of a stream is part of the newest commit."""
        return self.commit().batches.get(stream, -1) >= batch_id

    def fold(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], stream: str, batch_id: int) -> int:
        """Merge a batch into the buckets that its keys fall in; returns the version that holds it.

        ``merge(current, batch)`` gets the rows of those buckets and gives all of them
        back, changed or not. A batch that is part of the table already changes nothing.
        """
        before = self.commit()
        if before.batches.get(stream, -1) >= batch_id:
            return before.version
        touched = sorted(r[0] for r in batch.select(self.bucket().alias(BUCKET)).distinct().collect())
        folders = dict(before.folders)
        if touched:
            merged = merge(self.read(before.version, touched), batch).select(*self.schema.names)
            place = f"data/{before.version + 1:012d}-{uuid.uuid4().hex}"
            (merged.withColumn(BUCKET, self.bucket()).repartition(BUCKET)
                   .write.partitionBy(BUCKET).parquet(f"{self.path}/{place}"))
            written = {int(n.partition("=")[2]) for n in Folder(self.spark, f"{self.path}/{place}").names() if n.startswith(BUCKET)}
            if not written <= set(touched):
                raise ValueError("merge returned keys of buckets that the batch does not touch")
            for b in touched:
                folders.pop(b, None)
            folders |= {b: f"{place}/{BUCKET}={b}" for b in written}
        version = before.version + 1
        self.commits.publish(f"{version:012d}", json.dumps({"folders": folders, "batches": before.batches | {stream: batch_id}}))
        return version

    def vacuum(self, keep: int = 5) -> None:
        """Forget all but the newest ``keep`` commits, then drop the folders that none of them names."""
        versions = self.versions()
        kept = [self.commit(v) for v in versions[-keep:]]
        for v in versions[:-keep]:
            self.commits.delete(f"{v:012d}")
        used = {f for c in kept for f in c.folders.values()}
        newest, data = max(versions, default=0), Folder(self.spark, f"{self.path}/data")
        for place in data.names():
            if int(place.split("-")[0]) > newest:
                continue  # a commit that is being written
            for name in data.names(place):
                if name.startswith(BUCKET) and f"data/{place}/{name}" not in used:
                    data.delete(f"{place}/{name}")
            if not any(n.startswith(BUCKET) for n in data.names(place)):
                data.delete(place)
