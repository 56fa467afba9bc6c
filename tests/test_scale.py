"""Queries on tables of other shapes than the driver's: own events, and inputs of several files."""

import collections
import datetime as dt
import glob
import uuid

import duckdb
import pytest

import __spark_entry__ as entry
from checks.cases import in_steps, rocksdb
from checks.compare import compare
from checks.standins import Fleet
from fleetscope.streaming import jobs, stateful

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
TYPES = ["click", "view", "error", "signup", "purchase"]
EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark, path, n=600, kind=lambda i: TYPES[i % 5], files=1, days=30):
    """A folder with an events table of its own."""
    start, step = dt.datetime(2024, 1, 1), dt.timedelta(days=days) / n
    rows = [(i, start + i * step, i * 7 % 90, kind(i), float(i), f'{{"k": {i % 10}}}') for i in range(n)]
    spark.createDataFrame(rows, EVENT).repartition(files).write.parquet(f"{path}/events.parquet")
    return str(path)


def problem(spark, key, folder):
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{folder}/events.parquet/*.parquet')")
    return compare(spark, con, QUERIES[key], ORACLE[key], folder)


@pytest.mark.parametrize("kind", ["purchase", "click"])
def test_retention_where_a_newer_row_keeps_a_folder(spark, tmp_path, kind):
    """The row from 2099 stands in one class or the other: in the first case no folder expires."""
    folder = events(spark, tmp_path, kind=lambda i: kind if i == 77 else TYPES[i % 5])
    assert problem(spark, "g7_retention_of_folders", folder) is None


@pytest.mark.parametrize("key", ["d7_differential_stream", "s5_differential_stream", "s3_split_stream"])
def test_streams_over_events_in_parts(spark, tmp_path, key):
    assert problem(spark, key, events(spark, tmp_path, n=900, files=3)) is None


def test_steps_are_written_by_several_tasks(spark, tmp_path):
    """One frame a micro-batch, in order, also an empty one; none of them goes through a single task."""
    f = Fleet(spark, events(spark, tmp_path, files=3))
    parts, label, seen = f.table("events").rdd.getNumPartitions(), uuid.uuid4().hex, []
    stream = in_steps(f, [f.telemetry.where(w) for w in ("event_id % 2 = 0", "event_id < 0", "event_id % 2 = 1", "event_id = 5")], label)
    files = glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/{label}-*/in/*.parquet")
    jobs.run_batches(stream, lambda batch, n: seen.append(sorted(r.event_id for r in batch.collect())), str(tmp_path / "cp"))
    assert parts > 1 and len(files) == 4 * parts
    assert seen == [list(range(0, 600, 2)), [], list(range(1, 600, 2)), [5]]


def test_split_stream_holds_few_rows_at_a_time(spark, tmp_path, monkeypatch):
    """A bucket is many keys, its slices are short pieces, and all of them go when their time has passed."""
    schema, day = "sequence_id string, ts timestamp_ntz", dt.datetime(2024, 1, 1)
    monkeypatch.setattr(stateful, "PIECE", 4, raising=False)
    ids = [(str(i), day) for i in range(600)]
    states, out = [], str(tmp_path / "out")
    with rocksdb(spark):
        for batch in (ids, ids[:50], [("late", day + dt.timedelta(days=9))], [("end", day + dt.timedelta(days=9))]):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            jobs.write_outcomes(stateful.split_stream(stream, "1 hour", buckets=1), out, str(tmp_path / "cp"))
            states.append(spark.read.format("statestore").option("stateVarName", "pieces").load(str(tmp_path / "cp")).collect())
    first, last = states[0], states[-1]
    assert sorted(i for r in first for i in r.user_map_value.ids) == sorted(i for i, _ in ids)
    assert len({r.key for r in first}) > 30 and max(len(r.user_map_value.ids) for r in first) <= 4 and any(r.user_map_key.piece for r in first)
    assert {i for r in last for i in r.user_map_value.ids} == {"late", "end"}
    got = collections.Counter(r.outcome for r in spark.read.parquet(out).collect())
    assert got == {"kept": 602, "duplicate": 50}
