import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from checks.cases import rocksdb
from fleetscope.operators import diff as D
from fleetscope.sources import sinks
from fleetscope.streaming import jobs, stateful
from tests.test_diff import ROWS, RUNS, random_case

RECORD = "node_id string, query_name string, execution_no bigint, status_code int, rows array<string>"


def test_differential_over_several_batches(spark, tmp_path, rows):
    runs, data = random_case(11)
    expected = D.differential(spark.createDataFrame(runs, RUNS), spark.createDataFrame(data, ROWS)).select(
        F.col("node_id").cast("string"), "query_name", "execution_no", "row", "action")
    records = [(str(n), q, run, status, [d[4] for d in data if d[:3] == (n, q, run)]) for n, q, run, status, _ in runs]
    src = str(tmp_path / "in")
    with rocksdb(spark):
        for lo, hi in ((1, 4), (5, 5), (6, 11)):
            part = [r for r in records if lo <= r[2] <= hi]
            spark.createDataFrame(part, RECORD).coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(RECORD).parquet(src)
            jobs.run_to_end(stateful.differential_stream(stateful.run_records(stream), 3), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(expected)


def test_offline_and_back(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    src, schema = str(tmp_path / "in"), "node_id string, recorded_at timestamp"
    with rocksdb(spark):
        for beats in ([("a", t(0)), ("b", t(0))], [("b", t(30))], [("a", t(31)), ("b", t(60))]):
            spark.createDataFrame(beats, schema).coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(schema).parquet(src)
            jobs.run_to_end(stateful.offline_stream(stream, 600, "0 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
    seen = sorted((r.node_id, (r.last_seen_ms - int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp() * 1000)) // 60000)
                  for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert ("a", 0) in seen and ("a", 31) in seen and len(seen) == len(set(seen))


def test_dedup_across_batches(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    src, schema = str(tmp_path / "in"), "sequence_id string, ts timestamp_ntz"
    for ids in ("aab", "bc"):
        spark.createDataFrame([(i, t) for i in ids], schema).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        jobs.run_to_end(jobs.dedup_stream(stream, "1 hour").select("sequence_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.sequence_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_router_stream_restarts_without_loss_or_repeats(spark, tmp_path):
    src = str(tmp_path / "in")
    conf = {"format": "text", "path": src, "schema": "value string", "raw": "value"}
    for k in range(3):
        lines = [('{"node_id": "n", "event_type": "%s", "sequence_id": "%d"}' % (e, k * 10 + i),) for i, e in enumerate(("process_start", "user_login", "odd"))] + [("broken",)]
        spark.createDataFrame(lines, "value string").write.mode("append").text(src)
        jobs.run_to_end(jobs.route_stream(spark, conf), str(tmp_path / "out"), str(tmp_path / "cp"), partition_by=["topic"])
    got = {r.topic: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("topic").count().collect()}
    assert got == {"process": 3, "auth": 3, "raw": 3}


def test_log_sink_replay(spark, tmp_path):
    df = spark.range(10)
    for batch in (0, 1, 1):
        sinks.write_logs(df, str(tmp_path / "logs"), batch)
    assert spark.read.parquet(str(tmp_path / "logs")).count() == 20


def record(run, row=None, ended=False, status=0, node="n", t=0):
    return (node, "q", run, row, ended, status, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=t))


RECORDS = "node_id string, query_name string, execution_no bigint, row string, ended boolean, status_code int, ts timestamp"


def differed(spark, path, batches, **options):
    """What the stream says after these micro-batches."""
    with rocksdb(spark):
        for batch in batches:
            spark.createDataFrame(batch, RECORDS).coalesce(1).write.mode("append").parquet(f"{path}/in")
            stream = spark.readStream.schema(RECORDS).parquet(f"{path}/in")
            jobs.run_to_end(stateful.differential_stream(stream, 3, **options), f"{path}/out", f"{path}/cp")
    return sorted((r.execution_no, r.action, r.row or "") for r in spark.read.parquet(f"{path}/out").collect())


def test_runs_that_come_row_by_row(spark, tmp_path):
    """A run over three micro-batches, an empty one, a failed one, one recorded again, and one that comes too late."""
    got = differed(spark, str(tmp_path), [
        [record(1, "a"), record(1, "a")],
        [record(1, "b"), record(1, ended=True), record(2, "b")],
        [record(2, "c")],
        [record(2, "b"), record(2, "c"), record(2, ended=True), record(3, "x"), record(3, ended=True, status=1)],
        [record(2, "c"), record(2, ended=True), record(1, "z"), record(1, ended=True)],
        [record(5, ended=True)],
        [record(6, "b"), record(6, "b"), record(6, ended=True)]])
    assert got == [(1, "LATE", ""), (1, "SNAPSHOT", "a"), (1, "SNAPSHOT", "a"), (1, "SNAPSHOT", "b"), (2, "ADDED", "c"), (2, "REMOVED", "a"),
                   (5, "REMOVED", "b"), (5, "REMOVED", "c"), (6, "ADDED", "b")]


def test_a_newer_run_gives_up_an_open_one(spark, tmp_path):
    got = differed(spark, str(tmp_path), [
        [record(1, "a"), record(1, ended=True), record(2, "b")],
        [record(3, "c"), record(2, "d")],
        [record(3, ended=True)],
        [record(2, ended=True)]])
    assert got == [(1, "SNAPSHOT", "a"), (2, "LATE", ""), (3, "ADDED", "c"), (3, "REMOVED", "a")]


def test_the_watermark_gives_up_an_open_run(spark, tmp_path):
    """Rows of the run that never ended are forgotten; late records still count as data."""
    got = differed(spark, str(tmp_path), [
        [record(1, "a", t=0), record(1, ended=True, t=0), record(2, "b", t=10)],
        [record(1, "z", node="m", t=200), record(1, ended=True, node="m", t=200)],
        [record(9, "z", node="m", t=201)],
        [record(2, "c", t=10), record(2, ended=True, t=11)]], timeout_seconds=600, delay="1 minute")
    assert got == [(1, "SNAPSHOT", "a"), (1, "SNAPSHOT", "z"), (2, "ADDED", "c"), (2, "REMOVED", "a")]


def test_rows_are_read_from_state_only_where_some_are_missing(spark, tmp_path, monkeypatch):
    """The handler's state, stood in for by dictionaries that count how often they are gone through."""
    class Held(dict):
        scans = 0

        def containsKey(self, key):
            return key in self

        def getValue(self, key):
            return self.get(key)

        def updateValue(self, key, value):
            self[key] = value

        def removeKey(self, key):
            self.pop(key, None)

        def keys(self):
            Held.scans += 1
            return list(super().keys())

        def iterator(self):
            return iter(list(self.items()))

    differ = stateful.differ(0)
    differ.live, differ.fresh, differ.marks = Held(), Held(), Held()

    class Meta:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    differ.meta = Meta()

    def feed(*records):
        pdf = pd.DataFrame([(r[2], r[3], r[4], r[5], 0) for r in records], columns=["execution_no", "row", "ended", "status", "ms"])
        return [tuple(x) for out in differ.handleInputRows(("n", "q", 0), iter([pdf]), None) for x in out[["row", "action"]].itertuples(index=False)]

    same = [record(1, r) for r in "abc"]
    feed(*same, record(1, ended=True))
    for run in (2, 3):
        assert feed(*[record(run, r) for r in "abc"], record(run, ended=True)) == []
    assert feed(*[record(4, r) for r in "abcd"], record(4, ended=True)) == [("d", "ADDED")]
    assert Held.scans == 0
    assert feed(*[record(5, r) for r in "abc"], record(5, ended=True)) == [("d", "REMOVED")]
    assert Held.scans == 1


LOG = "node_id string, sequence_id string, n bigint, payload binary, ts timestamp_ntz"


def test_every_row_comes_out_once(spark, tmp_path):
    """Late rows, duplicates across micro-batches, forgotten ids, rows without an id or a time; NULLs and bytes as they came."""
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, microseconds=7)
    batches = [[("a", "1", 1, b"\x00", t(10)), ("a", "1", 2, None, t(10)), ("a", None, 3, None, t(9)), ("a", " ", 4, None, None)],
               [("b", "1", None, None, t(11)), ("b", "2", 6, None, t(8)), ("b", "3", 7, None, t(9.5)), ("b", None, 8, None, t(1)), ("b", "5", 9, None, None)],
               [("c", "9", 10, None, t(40))],
               [("d", "1", 11, None, t(39.5)), ("d", "9", 12, None, t(40)), ("d", "1", 13, None, t(12))]]
    with rocksdb(spark):
        for batch in batches:
            spark.createDataFrame(batch, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))
            jobs.write_outcomes(stateful.split_stream(stream, "1 hour", buckets=2), str(tmp_path / "out"), str(tmp_path / "cp"))
    out = spark.read.parquet(str(tmp_path / "out"))
    got = {(r.node_id, r.sequence_id, r.n, r.payload and bytes(r.payload), r.ts): r.outcome for r in out.collect()}
    assert set(got) == {r for b in batches for r in b} and out.count() == sum(map(len, batches))
    assert sorted(got.values()).count("kept") == 7 and {k[2] for k, v in got.items() if v == "late"} == {6, 8, 13}
    assert len([k for k, v in got.items() if v == "duplicate" and k[1] == "1" and k[2] in (1, 2, None)]) == 2
    assert got["d", "9", 12, None, t(40)] == "duplicate" and got["d", "1", 11, None, t(39.5)] == "kept"


def test_replaced_results_keep_the_newest(spark, tmp_path):
    """Old results go, a result that was not finished is not read, a batch that runs again replaces itself."""
    write, path = jobs.replace_table(str(tmp_path)), str(tmp_path)
    for batch in (0, 1, 2, 2, 3):
        write(spark.range(batch + 1), batch)
    assert sorted(p.name for p in tmp_path.glob("batch_id=*")) == ["batch_id=2", "batch_id=3"]
    spark.range(99).write.parquet(f"{path}/batch_id=4")
    (tmp_path / "batch_id=4" / "_SUCCESS").unlink()
    assert jobs.read_replaced(spark, path).count() == 4
