import json

from pyspark.sql import functions as F

from fleetscope.functions.rowkey import merge_maps, row_json
from fleetscope.operators import predicates as P, results as R


def payload(*rows, **extra):
    return json.dumps({"query_name": "q", "agent_uuid": "n", "timestamp_ns": 1, "action": "added",
                       "rows": [{"columns": [{"name": k, "value": v} for k, v in r]} for r in rows], **extra})


def test_explode_keeps_last_duplicate_and_order(spark):
    df = spark.createDataFrame([(1, payload([("a", "1"), ("a", "2"), ("b", None)], [("c", "x")])), (2, payload()), (3, "junk")], "id int, payload string")
    got = {(r.id, r.row_no): r.columns for r in R.explode_results(df).collect()}
    assert got == {(1, 0): {"a": "2", "b": None}, (1, 1): {"c": "x"}}
    assert {r.action for r in R.explode_results(df).collect()} == {"ADDED"}


def test_normalise_kinds(spark):
    m = {"pid": "12", "parent": "x1", "path": "/bin/sh", "cwd": "/", "uid": "0", "name": "sh"}
    df = spark.createDataFrame([(m,)], "columns map<string,string>")
    r = R.normalise(df, "process").first()
    assert (r.pid, r.ppid, r.exe_path, r.working_dir, r.uid, r.cast_failed) == (12, None, "/bin/sh", "/", 0, True)
    net = spark.createDataFrame([({"local_address": "1.1.1.1", "remote_port": "443"},)], "columns map<string,string>")
    n = R.normalise(net, "network").first()
    assert (n.src_ip, n.dst_port, n.src_port, n.cast_failed) == ("1.1.1.1", 443, None, False)
    f = spark.createDataFrame([({"path": "/a", "return_code": "99999999999"},)], "columns map<string,string>")
    assert R.normalise(f, "file").first().cast_failed


def test_normalised_event_envelope(spark):
    df = spark.createDataFrame([("n", 5, "s", {"path": "/a", "operation": "write"})], "node_id string, timestamp_ns bigint, sequence_id string, columns map<string,string>")
    ev = R.normalised_event(R.normalise(df, "file"), "file").first()
    assert ev.event_type == "file" and json.loads(ev.payload)["operation"] == "write" and ev.raw_sequence_id == "s"


def test_typed_view(spark):
    df = spark.createDataFrame([(1, {"pid": "7", "ppid": "1", "name": "x"})], "node_id int, columns map<string,string>")
    assert R.typed_view(df, {"pid": "bigint", "parent": "bigint", "name": "string"}).first() == (1, 7, 1, "x")


def test_row_json_ignores_order(spark):
    df = spark.sql("select map('b', '1', 'a', cast(null as string)) as m union all select map('a', cast(null as string), 'b', '1')")
    assert {r[0] for r in df.select(row_json(F.col("m"))).collect()} == {'{"a":null,"b":"1"}'}


def test_merge_maps(spark):
    df = spark.sql("select map('a', '1', 'b', '2') as x, map('b', '3') as y, cast(null as map<string,string>) as z")
    r = df.select(merge_maps(F.col("x"), F.col("y")).alias("p"), merge_maps(F.col("z"), F.col("y")).alias("q"), merge_maps(F.col("x"), F.col("z")).alias("r")).first()
    assert (r.p, r.q, r.r) == ({"a": "1", "b": "3"}, {"b": "3"}, {"a": "1", "b": "2"})


def test_environment_blocks(spark):
    df = spark.createDataFrame([(1, "A=1\0B=x=y\0noise\0\0C=\0=v")], "pid int, env string")
    assert sorted((r.key, r.value) for r in R.parse_kv(df, "env").collect()) == [("", "v"), ("A", "1"), ("B", "x=y"), ("C", "")]


def test_os_label(spark):
    texts = ['NAME="X"\nVERSION="1"\nPRETTY_NAME="X One"', 'NAME="X"\n VERSION = "1 (y)" \n', "VERSION=2", "# PRETTY_NAME=no\n", 'PRETTY_NAME=""', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.os_label for r in R.os_label(df, "t").orderBy("i").collect()]
    assert got == ["X One", "X 1 (y)", "Linux 2", "Linux", "", "Unknown Linux (os-release not found)"]


def test_machine_id(spark):
    df = spark.createDataFrame([(" a\n", "b"), ("\t", " b "), (None, ""), ("", None)], "a string, b string")
    assert [r.machine_id for r in R.machine_id(df, "a", "b").collect()] == ["a", "b", "unknown-machine-id", "unknown-machine-id"]


def test_watched_paths(spark):
    paths = ["/etc/passwd", "/etc/fstab", "/etc/udev/rules.d/x", "/home/a/.ssh/id", "/home/a/b/.ssh/id", "/root/.ssh/d/e", "/tmp/ssh-1/agent",
             "/tmp/new\nline", "/etc/cron.d/x", "/usr/bin", "/etc/sysfsXconf"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {}
    for r in P.fim_category(df).collect():
        got.setdefault(r.path, set()).add(r.category)
    assert got == {"/etc/passwd": {"etc_configs"}, "/home/a/.ssh/id": {"ssh_keys"}, "/root/.ssh/d/e": {"ssh_keys"}, "/tmp/new\nline": {"tmp_exec"},
                   "/etc/cron.d/x": {"etc_configs", "cron_dirs"}, "/etc/sysfsXconf": {"etc_configs"}}
    assert {r.path for r in P.tracked_access(P.fim_category(df)).collect()} == set(got) - {"/tmp/new\nline"}


def test_custom_watch_pattern(spark):
    df = spark.createDataFrame([("/data/a.log",), ("/data/x/a.log",), ("/data/ab",)], "path string")
    one = P.fim_category(df, {"c": ["/data/%.log"]}, {})
    assert [r.path for r in one.collect()] == ["/data/a.log"]


def test_integer_cost(spark):
    df = spark.createDataFrame([(7, 2), (7, 0), (-7, 2)], "user_time bigint, executions bigint")
    assert [r.avg_user_ms for r in P.with_cost(df).collect()] == [3, None, -3]


def test_waits(spark):
    df = spark.createDataFrame([(1, " futex_wait "), (2, "0"), (3, "futex_wait0"), (4, "poll"), (5, None)], "pid int, wchan string")
    assert [r.pid for r in P.wait_anomalies(df).collect()] == [1]
