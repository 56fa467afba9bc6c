"""Differential results against a direct simulation of the agent's rules."""

import random

import pytest

from fleetscope.operators import diff as D

RUNS = "node_id int, query_name string, execution_no bigint, status_code int, session_id int"
ROWS = "node_id int, query_name string, execution_no bigint, session_id int, row string"


def simulate(runs, rows, by_session=False):
    out, base = [], {}
    for node, query, run, status, session in sorted(runs, key=lambda r: (r[0], r[1], r[2])):
        key = (node, query, session if by_session else 0)
        if status:
            continue
        current = [r[4] for r in rows if (r[0], r[1], r[2]) == (node, query, run)]
        if key not in base:
            out += [(node, query, run, r, "SNAPSHOT") for r in current]
        else:
            out += [(node, query, run, r, "ADDED") for r in set(current) - base[key]]
            out += [(node, query, run, r, "REMOVED") for r in base[key] - set(current)]
        base[key] = set(current)
    return sorted(out)


def history(spark, runs, rows, **kw):
    df = D.differential(spark.createDataFrame(runs, RUNS), spark.createDataFrame(rows, ROWS), **kw)
    return df.select("node_id", "query_name", "execution_no", "row", "action")


def random_case(seed):
    rnd = random.Random(seed)
    runs, rows = [], []
    for node in (1, 2):
        for query in ("p", "q"):
            session = 0
            for run in range(1, 12):
                session += rnd.random() < 0.2
                status = int(rnd.random() < 0.2)
                runs.append((node, query, run, status, session))
                if not status and rnd.random() > 0.2:
                    rows += [(node, query, run, session, rnd.choice("abcd")) for _ in range(rnd.randrange(0, 6))]
    return runs, rows


@pytest.mark.parametrize("seed", range(6))
def test_random_histories(spark, rows, seed):
    runs, data = random_case(seed)
    assert rows(history(spark, runs, data)) == sorted(simulate(runs, data), key=repr)
    assert rows(history(spark, runs, data, session="session_id")) == sorted(simulate(runs, data, True), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_replay_gives_the_state_back(spark, seed):
    runs, data = random_case(seed)
    h = history(spark, runs, data).cache()
    for t in (1, 4, 7, 11):
        expected = set()
        for node, query in {(r[0], r[1]) for r in runs}:
            good = [r[2] for r in runs if (r[0], r[1]) == (node, query) and r[2] <= t and r[3] == 0]
            if good:
                expected |= {(node, query, d[4]) for d in data if (d[0], d[1], d[2]) == (node, query, max(good))}
        got = [tuple(r) for r in D.state_as_of(h, t).collect()]
        assert len(got) == len(set(got)) and set(got) == expected


def test_replay_after_an_empty_snapshot(spark):
    diffs = spark.createDataFrame([(1, "p", 1, "a", "SNAPSHOT")], "node_id int, query_name string, execution_no bigint, row string, action string")
    restarts = spark.createDataFrame([(1, "p", 1), (1, "p", 5)], "node_id int, query_name string, execution_no bigint")
    assert D.state_as_of(diffs, 9).count() == 1
    assert D.state_as_of(diffs, 9, snapshot_runs=restarts).count() == 0


def test_edge_cases(spark, rows):
    runs = [(1, "p", 1, 0, 0), (1, "p", 2, 0, 0), (1, "p", 3, 1, 0), (1, "p", 4, 0, 0)]
    data = [(1, "p", 1, 0, "a"), (1, "p", 1, 0, "a"), (1, "p", 3, 0, "z"), (1, "p", 4, 0, "a")]
    assert rows(history(spark, runs, data)) == sorted([
        (1, "p", 1, "a", "SNAPSHOT"), (1, "p", 1, "a", "SNAPSHOT"), (1, "p", 2, "a", "REMOVED"), (1, "p", 4, "a", "ADDED")], key=repr)


def test_diff_sets(spark, rows):
    m = lambda *ms: D.with_row_key(spark.createDataFrame([(x,) for x in ms], "columns map<string,string>"))
    a, b = m({"x": "1", "y": "2"}, {"x": "3"}, {"x": "3"}), m({"y": "2", "x": "1"}, {"x": "4"}, {"x": "4"})
    assert rows(D.diff(a, b)) == [('{"x":"3"}', "REMOVED"), ('{"x":"4"}', "ADDED")]
    assert D.diff(a, a).count() == 0
    empty = a.filter("false")
    assert rows(D.diff(empty, a)) == [('{"x":"1","y":"2"}', "ADDED"), ('{"x":"3"}', "ADDED")]
    assert {r.action for r in D.diff(a, empty).collect()} == {"REMOVED"}


def test_process_feed(spark):
    bpf = spark.createDataFrame([(1, 2, 0)], "pid int, parent int, probe_error int")
    audit = spark.createDataFrame([(3, 4, 5)], "pid int, ppid int, auid int")
    got = {r.feed: (r.pid, r.parent, r.probe_error, r.auid) for r in D.process_feed(bpf, audit).collect()}
    assert got == {"bpf": (1, 2, 0, None), "audit": (3, 4, None, 5)}


def test_a_run_recorded_twice_is_one_run(spark):
    runs = spark.createDataFrame([(1, "q", n, 0) for n in (1, 2, 2, 3)], "node_id int, query_name string, execution_no int, status_code int")
    rows = spark.createDataFrame([(1, "q", n, r) for n in (1, 2, 3) for r in "ab"], "node_id int, query_name string, execution_no int, row string")
    assert {r.action for r in D.differential(runs, rows).collect()} == {"SNAPSHOT"}
