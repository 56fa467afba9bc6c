"""Versioned tables and the registry kept from streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import registry
from fleetscope.sources.versioned import BucketedTable, Folder
from fleetscope.streaming.upkeep import RegistryUpkeep

PAIR = "k string, v bigint"


def newest(current, new):
    return current.join(new, "k", "left_anti").unionByName(new)


@pytest.fixture
def table(spark, tmp_path):
    return BucketedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], PAIR).schema, ["k"], 4)


def held(table, version=None):
    return sorted((r.k, r.v) for r in table.read(version).collect())


def test_commits_replace_only_touched_buckets(spark, table):
    first = spark.createDataFrame([(f"k{i}", i) for i in range(40)], PAIR)
    assert held(table) == [] and table.fold(first, newest, "s", 0) == 1
    before = table.commit()
    assert table.fold(spark.createDataFrame([("k3", 300)], PAIR), newest, "s", 1) == 2
    after = table.commit()
    assert sum(before.folders[b] != after.folders[b] for b in before.folders) == 1
    assert held(table) == sorted([(f"k{i}", i) for i in range(40) if i != 3] + [("k3", 300)])
    assert held(table, 1) == sorted((f"k{i}", i) for i in range(40))


def test_a_batch_counts_once(spark, table):
    add = lambda current, new: current.unionByName(new)
    one = spark.createDataFrame([("a", 1)], PAIR)
    assert [table.fold(one, add, "s", b) for b in (0, 0, 1, 0)] == [1, 1, 2, 2]
    assert table.fold(one, add, "other", 0) == 3
    assert held(table) == [("a", 1)] * 3


def test_empty_batch_and_emptied_bucket(spark, table):
    table.fold(spark.createDataFrame([("a", 1)], PAIR), newest, "s", 0)
    table.fold(spark.createDataFrame([], PAIR), newest, "s", 1)
    assert held(table) == [("a", 1)] and table.seen("s", 1)
    table.fold(spark.createDataFrame([("a", 1)], PAIR), lambda current, new: current.limit(0), "s", 2)
    assert held(table) == []


def test_a_writer_that_dies_changes_nothing(spark, table):
    table.fold(spark.createDataFrame([("a", 1), ("b", 2)], PAIR), newest, "s", 0)
    batch = spark.createDataFrame([("a", 9)], PAIR)
    publish = Folder.publish
    try:
        Folder.publish = lambda *a: (_ for _ in ()).throw(OSError("gone"))
        with pytest.raises(OSError):
            table.fold(batch, newest, "s", 1)
    finally:
        Folder.publish = publish
    assert held(table) == [("a", 1), ("b", 2)]
    table.fold(batch, newest, "s", 1)
    assert held(table) == [("a", 9), ("b", 2)]


def test_vacuum_keeps_what_newer_commits_name(spark, table):
    for n in range(6):
        table.fold(spark.createDataFrame([("a", n), (f"z{n}", n)], PAIR), newest, "s", n)
    want = held(table)
    table.vacuum(2)
    assert table.versions() == [5, 6] and held(table) == want and len(held(table, 5)) == 6
    table.vacuum(1)
    assert held(table) == want
    kept = {f.split("/")[1] for f in table.commit().folders.values()}
    assert set(Folder(spark, f"{table.path}/data").names()) == kept


def test_merge_may_not_leave_its_buckets(spark, table):
    table.fold(spark.createDataFrame([(f"k{i}", i) for i in range(40)], PAIR), newest, "s", 0)
    with pytest.raises(ValueError):
        table.fold(spark.createDataFrame([("k3", 1)], PAIR), lambda current, new: table.read(), "s", 1)


REQUEST = "event_id bigint, machine_id string, hostname string, os_version string, agent_version string, requested_at timestamp_ntz"


def test_late_request_does_not_overwrite_newer_host_data(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    up = RegistryUpkeep(spark, str(tmp_path / "r"), 2)
    up.enrolments(spark.createDataFrame([(2, "m", "new", "os", "2", t(5))], REQUEST), 0)
    up.enrolments(spark.createDataFrame([(1, "m", "old", "os", "1", t(3))], REQUEST), 1)
    node, = up.nodes().collect()
    assert (node.hostname, node.agent_version, node.last_enrolled_at) == ("new", "2", t(5))
    assert sorted((r.event_id, r.event_type) for r in up.audit().collect()) == [(1, "re_enrollment"), (2, "new_enrollment")]


BEAT = "event_id bigint, node_id string, status string, events_buffered bigint, recorded_at timestamp_ntz"


def test_heartbeats(spark, tmp_path):
    """A late one extends the series but not the state; unknown and malformed ones are rejected; a replay changes nothing."""
    t = lambda h: dt.datetime(2024, 1, 1, h)
    up = RegistryUpkeep(spark, str(tmp_path / "r"), 2)
    assert up.nodes().count() == up.health().count() == up.rejected().count() == 0
    up.enrolments(spark.createDataFrame([(1, "m", "h", "os", "1", t(0))], REQUEST), 0)
    node = up.nodes().first().node_id
    other = spark.range(1).select(registry.node_id_of(F.lit("else"))).first()[0]
    batches = [[(1, node, "degraded", 3, t(5)), (2, "no id", "healthy", 0, t(5))], [(3, node, "healthy", 0, t(2)), (4, other, "healthy", 0, t(6))]]
    for n in (0, 1, 1):
        up.heartbeats(spark.createDataFrame(batches[n], BEAT), n)
    assert [(r.agent_status, r.operator_status) for r in up.nodes().collect()] == [("degraded", "active")]
    assert sorted(r.health_id for r in up.health().collect()) == [1, 3]
    assert sorted((r.event_id, r.reason) for r in up.rejected().collect()) == [(2, "invalid_id"), (4, "unknown_node")]


def test_uncommitted_batch_is_not_read(spark, tmp_path, monkeypatch):
    up = RegistryUpkeep(spark, str(tmp_path / "r"), 2)
    one = spark.createDataFrame([(1, "m", "h", "os", "1", dt.datetime(2024, 1, 1))], REQUEST)
    monkeypatch.setattr(Folder, "publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        up.enrolments(one, 0)
    monkeypatch.undo()
    assert up.nodes().count() == up.audit().count() == 0
    up.enrolments(one, 0)
    assert [r.event_type for r in up.audit().collect()] == ["new_enrollment"]
