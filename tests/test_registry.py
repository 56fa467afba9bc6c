import datetime as dt

from pyspark.sql import functions as F

from fleetscope.operators import joins, rates, registry as G

T0 = dt.datetime(2024, 1, 1)
at = lambda m: T0 + dt.timedelta(minutes=m)
REQ = "event_id bigint, machine_id string, hostname string, os_version string, agent_version string, requested_at timestamp_ntz"
UUID = lambda n: f"00000000-0000-0000-0000-{n:012d}"


def test_enrollment(spark):
    reqs = spark.createDataFrame([(1, "m1", "a", "o", "1", at(0)), (2, "m1", "b", "o", "2", at(5)), (4, "m2", "x", "o", "1", at(1)), (3, "m2", "y", "o", "1", at(1))], REQ)
    nodes, audit = G.enroll(None, reqs)
    n = {r.machine_id: r for r in nodes.collect()}
    assert n["m1"].hostname == "b" and n["m1"].first_seen_at == at(0) and n["m1"].last_enrolled_at == at(5)
    assert n["m2"].hostname == "x" and n["m1"].agent_status == "healthy" and n["m1"].operator_status == "active"
    kinds = {r.event_id: r.event_type for r in audit.collect()}
    assert kinds == {1: "new_enrollment", 2: "re_enrollment", 3: "new_enrollment", 4: "re_enrollment"}
    assert len({r.node_id for r in audit.collect()}) == 2

    again, audit2 = G.enroll(nodes.withColumn("operator_status", F.lit("isolated")), spark.createDataFrame(
        [(9, "m1", "c", "p", "3", at(60)), (10, "m3", "z", "o", "1", at(61))], REQ))
    a = {r.machine_id: r for r in again.collect()}
    assert len(a) == 3 and a["m1"].node_id == n["m1"].node_id and a["m1"].first_seen_at == at(0) and a["m1"].hostname == "c"
    assert a["m1"].operator_status == "isolated" and a["m2"].hostname == "x" and a["m3"].operator_status == "active"
    assert {r.event_id: r.event_type for r in audit2.collect()} == {9: "re_enrollment", 10: "new_enrollment"}


def test_schedule(spark):
    cols = "name string, query string, interval_secs bigint, snapshot boolean, updated_at bigint"
    empty = spark.createDataFrame([], cols)
    new = spark.createDataFrame([("mine", "select 1", 10, True, 5)], cols)
    seeded = G.upsert_schedule(empty, new)
    assert seeded.count() == 4
    update = spark.createDataFrame([("users", "select 2", 10, True, 6), ("mine", "select 3", 20, False, 5)], cols)
    after = {r.name: r for r in G.upsert_schedule(seeded, update).collect()}
    assert len(after) == 4 and after["users"].query == "select 2" and after["mine"].interval_secs == 20


def test_heartbeats(spark):
    nodes = spark.createDataFrame([(UUID(1), "isolated", "healthy"), (UUID(2), "active", "healthy")], "node_id string, operator_status string, agent_status string")
    hb = spark.createDataFrame([(1, UUID(1), "isolated", 3, at(1)), (2, UUID(1), "healthy", 4, at(0)), (3, "bad", "healthy", 0, at(0)), (4, UUID(9), "healthy", 0, at(0))],
                               "event_id bigint, node_id string, status string, events_buffered bigint, recorded_at timestamp_ntz")
    now, series, rejected = G.apply_heartbeats(nodes, hb)
    n = {r.node_id: r for r in now.collect()}
    assert (n[UUID(1)].agent_status, n[UUID(1)].operator_status) == ("degraded", "isolated") and n[UUID(2)].agent_status == "healthy"
    assert series.count() == 2 and {r.event_id: r.reason for r in rejected.collect()} == {3: "invalid_id", 4: "unknown_node"}
    assert {r.node_id: r.effective_status for r in G.effective_status(now).collect()} == {UUID(1): "isolated", UUID(2): "healthy"}
    stale = {r.node_id: r.last_seen for r in G.stale_nodes(nodes, series, at(20), 5).collect()}
    assert stale == {UUID(1): at(1), UUID(2): None}


def test_orphans_with_null_nodes(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "node_id string")
    known, orphan = joins.split_known_nodes(df, spark.createDataFrame([("a",), (None,)], "node_id string"))
    assert [r.node_id for r in known.collect()] == ["a"] and sorted((r.node_id for r in orphan.collect()), key=str) == [None, "b"]


def test_modules_with_null_names(spark):
    mods = spark.createDataFrame([(1, "a", "Live"), (1, "b", "Loading"), (1, None, "Live"), (1, "c", None), (1, "a", None), (2, "a", None)], "node_id int, name string, status string")
    got = sorted((r.node_id, r.name, str(r.status)) for r in joins.unusual_modules(mods).collect())
    assert got == [(1, "b", "Loading"), (1, "c", "None"), (2, "a", "None")]


def test_retention_and_expiry(spark):
    df = spark.createDataFrame([(1, "raw", at(0)), (2, "auth", at(0)), (3, "other", at(0)), (4, "raw", at(60 * 24 * 10))], "event_id bigint, topic string, ts timestamp_ntz")
    assert sorted(r.event_id for r in G.apply_retention(df, at(60 * 24 * 10)).collect()) == [2, 3, 4]
    ev = spark.createDataFrame([(1, i, at(i)) for i in range(100)], "node_id int, event_id bigint, ts timestamp_ntz")
    assert sorted(r.event_id for r in G.expire_events(ev, at(99), 3600, 5).collect()) == [95, 96, 97, 98, 99]
    assert G.expire_events(ev, at(99), 3600, 500).count() == 61


def test_reconcile(spark):
    sent = spark.createDataFrame([(1,), (2,), (2,), (3,), (4,)], "sequence_no int")
    acks = spark.createDataFrame([(1,), (2,), (4,), (4,), (9,)], "sequence_no int")
    assert {r.sequence_no: r.delivery for r in G.reconcile(sent, acks).collect()} == {1: "delivered", 2: "duplicate", 3: "lost", 4: "duplicate", 9: "unknown"}


def test_commands(spark):
    nodes = spark.createDataFrame([(1, "isolated"), (2, "active"), (3, "isolated")], "node_id int, operator_status string")
    cmds = spark.createDataFrame([(1, 1, True, at(0)), (2, 1, False, at(1)), (3, 2, False, at(0)), (4, 2, True, at(0))], "event_id int, node_id int, isolate boolean, issued_at timestamp_ntz")
    assert {r.node_id: r.operator_status for r in G.operator_status(nodes, cmds).collect()} == {1: "active", 2: "isolated", 3: "isolated"}


def test_rates_and_replicas(spark):
    df = spark.createDataFrame([(1, 1, at(0), 100), (1, 2, at(1), 160), (1, 3, at(1), 170), (1, 4, at(2), 5), (2, 5, at(9), 1)], "node_id int, event_id bigint, ts timestamp_ntz, c bigint")
    got = {r.event_id: r.c_per_sec for r in rates.counter_rates(df, ["c"], slot_seconds=60).collect()}
    assert got == {1: None, 2: 1.0, 3: None, 4: None, 5: None}
    lags = spark.createDataFrame([(0,), (20_000,), (20_001,), (10**9,)], "lag bigint")
    assert [r[0] for r in lags.select(rates.replicas(F.col("lag"))).collect()] == [2, 2, 3, 64]


def test_consumer_lag(spark):
    latest = spark.createDataFrame([("t", 0, 100), ("t", 1, 50)], "topic string, partition int, latest bigint")
    committed = spark.createDataFrame([("g", "t", 0, 90)], "group_id string, topic string, partition int, committed bigint")
    assert [tuple(r) for r in rates.consumer_lag(latest, committed).collect()] == [("g", 60)]


def test_rows_without_an_id_stay(spark):
    df = spark.createDataFrame([(1, "a", at(0)), (2, "a", at(1)), (3, "", at(0)), (4, " ", at(0)), (5, None, at(0)), (6, None, at(1))], "event_id bigint, sequence_id string, ts timestamp_ntz")
    assert sorted(r.event_id for r in G.dedup_events(df).collect()) == [1, 3, 4, 5, 6]


def test_a_clock_that_runs_ahead_removes_nothing_else(spark):
    df = spark.createDataFrame([(1, "raw", at(0)), (2, "raw", at(60 * 24 * 365 * 70))], "event_id bigint, topic string, ts timestamp_ntz")
    assert sorted(r.event_id for r in G.apply_retention(df, at(5)).collect()) == [1, 2]
