import json

from pyspark.sql import functions as F

from fleetscope.operators import hooks, results
from fleetscope.plans import catalogue as C, packs
from fleetscope.sources import events as S, host_table


def test_result_log(spark, tmp_path):
    lines = [json.dumps({"name": "q", "hostIdentifier": "h", "calendarTime": "Thu Jun  4 12:00:00 2026 UTC", "unixTime": 1748996400, "action": "added",
                         "decorations": {"hostname": "x"}, "columns": {"pid": "1"}}), "{broken", json.dumps({"name": "z", "unixTime": 0})]
    (tmp_path / "log").write_text("\n".join(lines))
    got = S.read_result_log(spark, str(tmp_path / "log")).collect()
    assert (got[0].event_time.isoformat(), got[0].action, got[0].columns) == ("2025-06-04T00:20:00", "ADDED", {"pid": "1"})
    assert got[1]._corrupt_record == "{broken" and got[2].event_time is None


def test_catalogue_files(spark, tmp_path):
    (tmp_path / "a.conf").write_text(json.dumps({"schedule": {"x": {"query": "SELECT 1 AS a;", "interval": 60, "removed": False}, "── mark": {"query": "SELECT 1;", "interval": 9}}}))
    (tmp_path / "b.toml").write_text('[[queries]]\nname = "y"\nquery = "SELECT b"\ninterval_secs = 30\nsnapshot = true\n[[queries]]\nname = "x"\nquery = "SELECT c"\ninterval_secs = 5\n')
    (tmp_path / "p.conf").write_text(json.dumps({"queries": {"z": {"query": "SELECT d", "interval": "120", "platform": "linux"}}}))
    got = {r.name: (r.query, r.interval_secs, r.snapshot, r.removed) for r in C.load_catalogue(spark, [str(tmp_path / n) for n in ("a.conf", "b.toml", "p.conf")]).collect()}
    assert got == {"x": ("SELECT c", 5, False, True), "y": ("SELECT b", 30, True, True), "z": ("SELECT d", 120, False, True)}


def test_pack_sizes():
    assert [len(C.PACKS[p]) for p in ("deployed", "agent_defaults", "detection", "hardware")] == [42, 10, 18, 3]
    for queries in C.PACKS.values():
        assert len({q.name for q in queries}) == len(queries)


def test_queries_keep_runs_apart(spark):
    """With histories, joins and top-k stay inside (node, run)."""
    schema = ", ".join(f"{c} {t}" for c, t in C.host_tables()["processes"].items())
    base = spark.createDataFrame([{"pid": 1, "parent": 0, "name": "init", "state": "S", "user_time": 1, "system_time": 1},
                                  {"pid": 2, "parent": 1, "name": "traced", "state": "T", "user_time": 2, "system_time": 2}], schema)
    procs = base.crossJoin(spark.sql("select * from values (1, 1), (1, 2), (2, 1) as t(node_id, execution_no)"))
    by_name = {q.name: q for q in [*C.DEPLOYED, *C.DETECTION_PACK]}
    traced = packs.run_query({"processes": procs}, by_name["ptrace_activity"])
    assert traced.count() == 3 and set(traced.columns) == {"node_id", "execution_no", "tracer_pid", "tracer_name", "tracer_cmd", "tracee_pid", "tracee_name"}
    assert packs.run_query({"processes": procs}, by_name["cpu_utilization"]).count() == 6
    out = packs.run_pack({"processes": procs}, C.DETECTION_PACK)
    assert out.columns == ["node_id", "execution_no", "query_name", "row"]


def test_host_table_push_down(spark, tmp_path):
    df = spark.createDataFrame([(1, p, f"PATH=/bin\0N={p}\0junk") for p in range(20)] + [(1, 99, None)], "node_id bigint, pid bigint, environ string")
    df.write.parquet(str(tmp_path / "env"))
    t = spark.read.format(host_table.parquet_env_table(spark)).option("path", str(tmp_path / "env")).load()
    assert t.count() == 40
    assert sorted((r.key, r.value) for r in t.filter("pid = 7").collect()) == [("N", "7"), ("PATH", "/bin")]
    assert t.filter("pid in (3, 4) and key = 'N'").count() == 2 and t.filter("pid = 3 and pid = 4").count() == 0


def test_custom_table(spark):
    source = host_table.host_table_source("squares", "n bigint, sq bigint", lambda o: list(range(int(o["parts"]))),
                                          lambda o, part, want: ((n, n * n) for n in range(part * 10, part * 10 + 10) if "n" not in want or n in want["n"]))
    t = spark.read.format(host_table.register(spark, source)).option("parts", "3").load()
    assert t.count() == 30 and t.filter("n = 12").first().sq == 144


def test_hook(spark):
    df = spark.createDataFrame([("k", "1", "t", 0, i) for i in range(3)] + [("k", "x", "t", 0, 9)], "key string, payload string, topic string, partition int, offset bigint")
    good, bad = hooks.split_processed(hooks.process_with(df, lambda key, payload, topic, partition, offset: str(int(payload) + offset)))
    assert sorted(r.result for r in good.collect()) == ["1", "2", "3"]
    assert [(r.offset, r.error.split(":")[0]) for r in bad.collect()] == [(9, "ValueError")]


def test_report_follows_the_schedule(spark):
    runs = spark.createDataFrame([(1, q, r, 0) for q in ("snap", "diff", "quiet") for r in (1, 2)], "node_id int, query_name string, execution_no bigint, status_code int")
    rows = spark.createDataFrame([(1, q, 1, "a") for q in ("snap", "diff", "quiet")] + [(1, "snap", 2, "a")], "node_id int, query_name string, execution_no bigint, row string")
    q = lambda name, **kw: C.HostQuery(name, {}, lambda t: None, 60, **kw)
    out = packs.report(runs, rows, C.catalogue(spark, [q("snap", snapshot=True), q("diff"), q("quiet", removed=False)]))
    assert sorted((r.query_name, r.execution_no, r.action) for r in out.collect()) == [
        ("diff", 1, "SNAPSHOT"), ("diff", 2, "REMOVED"), ("quiet", 1, "SNAPSHOT"), ("snap", 1, "SNAPSHOT"), ("snap", 2, "SNAPSHOT")]


def test_heartbeat_series(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node_id string")
    s = S.heartbeat_series(nodes, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), 60)
    assert s.count() == 120 and s.agg(F.min("recorded_at")).first()[0].isoformat() == "2023-12-31T23:00:00"


def test_explode_feeds_typed_views(spark):
    text = json.dumps({"query_name": "processes", "rows": [{"columns": [{"name": "pid", "value": "4"}, {"name": "ppid", "value": "1"}]}], "action": "SNAPSHOT"})
    df = spark.createDataFrame([(1, text)], "node_id int, payload string")
    view = results.typed_view(results.explode_results(df), C.host_tables()["processes"])
    assert (view.first().pid, view.first().parent) == (4, 1)


def test_login_records(spark, tmp_path):
    """Two nodes, a file in two parts, a cut-off last record, constraints that reach the reader."""
    import numpy as np

    from fleetscope.sources import host_table

    def rows(n, user):
        out = np.zeros(n, np.dtype(host_table.LOGIN_RECORD))
        out["pid"], out["type"], out["time"], out["username"], out["host"] = np.arange(n), np.arange(n) % 3, 7, user, "ü".encode()
        return out.tobytes()

    for node, data in (("a", rows(5, b"ann") + b"x" * 100), ("b", rows(3, b"bob"))):
        (tmp_path / f"node_id={node}").mkdir()
        (tmp_path / f"node_id={node}" / "wtmp").write_bytes(data)
    (tmp_path / "node_id=b" / ".hidden").write_bytes(b"x" * 384)
    kept = host_table.LOGIN_PART
    host_table.LOGIN_PART = 2 * 384
    try:
        fmt = host_table.login_records(spark)
    finally:
        host_table.LOGIN_PART = kept
    df = spark.read.format(fmt).option("path", str(tmp_path)).load()
    assert df.rdd.getNumPartitions() == 5
    assert sorted((r.node_id, r.pid, r.username, r.host) for r in df.collect()) == [("a", i, "ann", "ü") for i in range(5)] + [("b", i, "bob", "ü") for i in range(3)]
    assert sorted((r.node_id, r.pid) for r in df.where("type = 1 and node_id = 'a'").collect()) == [("a", 1), ("a", 4)]
    assert df.where("username in ('bob', 'eve') and pid = 2").count() == 1
    (tmp_path / "none").mkdir()
    assert spark.read.format(fmt).option("path", str(tmp_path / "none")).load().count() == 0
