"""A host table served by user code, as a Spark data source.

The class and what it needs are created inside a function, so Spark ships them
to the workers by value and nothing has to be installed there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import SparkSession


def host_table_source(name: str, schema: str, split: Callable[[Mapping], list],
                      generate: Callable[[Mapping, object, Mapping], Iterator[tuple]]):
    """A ``DataSource`` class for a custom table.

    ``split(options)`` lists the parts that tasks read independently.
    ``generate(options, part, constraints)`` yields the rows of a part, as tuples
    or as Arrow record batches;
    ``constraints`` maps a column to the values a query asks for with ``=`` or
    ``IN``, so the generator can skip what nobody wants. Spark checks the
    filters again, so a generator may ignore them.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

    class Part(InputPartition):
        def __init__(self, value):
            self.value = value

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = options
            self.constraints = {}

        def pushFilters(self, filters):
            for f in filters:
                if isinstance(f, EqualTo):
                    wanted = {f.value}
                elif isinstance(f, In):
                    wanted = set(f.value)
                else:
                    yield f
                    continue
                column = ".".join(f.attribute)
                known = self.constraints.get(column)
                self.constraints[column] = wanted if known is None else known & wanted
                yield f

        def partitions(self):
            return [Part(v) for v in split(self.options)]

        def read(self, partition):
            if partition is not None:  # a table without parts is read once, with none
                yield from generate(self.options, partition.value, self.constraints)

    class HostTableSource(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(dict(self.options))

    return HostTableSource


def register(spark: SparkSession, source) -> str:
    """Make a host table readable by name; switches on Spark's filter push-down to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return source.name()


def parquet_env_table(spark: SparkSession) -> str:
    """Register ``process_envs_extended``: environment variables from collected env blocks.

    Option ``path`` names a parquet file or folder with node_id, pid and
    ``environ`` (NUL-separated text). Each row group is one part; a constraint on
    ``pid`` is applied while reading. Returns the format name.
    """
    def split(options):
        import pyarrow.dataset as ds
        files = ds.dataset(options["path"], format="parquet").get_fragments()
        return [(frag.path, group) for frag in files for group in range(frag.metadata.num_row_groups)]

    def generate(options, part, constraints):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        path, group = part
        table = pq.ParquetFile(path).read_row_group(group, columns=["node_id", "pid", "environ"])
        if "pid" in constraints:
            table = table.filter(pc.is_in(table["pid"], pa.array(list(constraints["pid"]), pa.int64())))
        for batch in table.to_batches(max_chunksize=8192):
            parts = pc.split_pattern(batch.column("environ"), "\0")
            owner, var = pc.list_parent_indices(parts), pc.list_flatten(parts)
            pair = pc.extract_regex(var, r"(?s)^(?P<key>[^=]*)=(?P<value>.*)$")
            found = pc.is_valid(pair)
            pair, owner = pair.filter(found), owner.filter(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node_id").take(owner), batch.column("pid").take(owner),
                 pc.struct_field(pair, "key"), pc.struct_field(pair, "value")], ["node_id", "pid", "key", "value"])

    source = host_table_source("process_envs_extended", "node_id bigint, pid bigint, key string, value string", split, generate)
    return register(spark, source)


# The layout of a login record as hosts keep them (wtmp), 384 bytes.
LOGIN_RECORD = [("type", "<i2"), ("gap", "V2"), ("pid", "<i4"), ("tty", "S32"), ("line_id", "S4"), ("username", "S32"), ("host", "S256"),
                ("exit", "V4"), ("session", "<i4"), ("time", "<i4"), ("micros", "<i4"), ("address", "V16"), ("rest", "V20")]
#: Records that a task reads at a time, and bytes of a file that make a part.
LOGIN_BLOCK, LOGIN_PART = 1 << 14, 1 << 26


def login_records(spark: SparkSession) -> str:
    """Register ``login_records``: the ``last`` table straight from collected wtmp files, which Spark has no reader for.

    Option ``path`` names a folder with files below ``node_id=<id>``, in any store
    that Arrow opens. Files are cut into parts of whole records, so a long one is
    read by many tasks; a node that a query does not ask for is not opened, and
    ``pid``, ``type`` and ``username`` are applied while reading. A last record that
    was cut off is left out. Returns the format name.
    """
    layout, block, part_bytes = list(LOGIN_RECORD), LOGIN_BLOCK, LOGIN_PART

    def opened(path):
        from pyarrow import fs
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def split(options):
        import re

        from pyarrow import fs
        store, root = opened(options["path"])
        parts = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            node = re.search(r"node_id=([^/]+)/[^/.][^/]*$", info.path)
            if info.is_file and node:
                step = max(part_bytes // 384, 1) * 384
                parts += [(node[1], info.path, at, min(at + step, info.size // 384 * 384)) for at in range(0, info.size // 384 * 384, step)]
        return parts

    def generate(options, part, constraints):
        import numpy as np
        import pyarrow as pa
        node, path, at, end = part
        if "node_id" in constraints and node not in {str(n) for n in constraints["node_id"]}:
            return
        record, store = np.dtype(layout), opened(options["path"])[0]
        with store.open_input_file(path) as file:
            file.seek(at)
            while at < end:
                rows = np.frombuffer(file.read(min(block * record.itemsize, end - at)), record)
                at += rows.nbytes
                for name in ("pid", "type"):
                    if name in constraints:
                        rows = rows[np.isin(rows[name], list(constraints[name]))]
                if "username" in constraints:
                    rows = rows[np.isin(rows["username"], [str(u).encode()[:32] for u in constraints["username"]])]
                text = lambda name: pa.array([v.decode(errors="replace") for v in rows[name].tolist()], pa.string())  # noqa: E731, B023
                number = lambda name: pa.array(rows[name].astype(np.int64))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array([node] * len(rows), pa.string()), text("username"), text("tty"), number("pid"), number("type"),
                                                  number("time"), text("host")], ["node_id", "username", "tty", "pid", "type", "time", "host"])

    source = host_table_source("login_records", "node_id string, username string, tty string, pid bigint, type bigint, time bigint, host string", split, generate)
    return register(spark, source)
