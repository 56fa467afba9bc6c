"""Validity intervals and running counts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F, types as T

from fleetscope.operators import diff as D, rates
from fleetscope.sources import baseline, validity
from tests.test_diff import ROWS, RUNS, random_case

CHANGE = "node_id string, query_name string, execution_no bigint, row string, action string"


def c(run, row, action):
    return ("n", "q", run, row, action)


HISTORY = [c(1, "a", "SNAPSHOT"), c(1, "a", "SNAPSHOT"), c(1, "b", "SNAPSHOT"), c(3, "a", "REMOVED"), c(5, "a", "ADDED"), c(7, "b", "REMOVED"), c(7, "d", "ADDED"),
           c(9, "b", "SNAPSHOT"), c(11, "b", "REMOVED")]


def test_intervals(spark):
    got = sorted((r.row, r.valid_from, r.valid_to) for r in validity.intervals(spark.createDataFrame(HISTORY, CHANGE)).collect())
    assert got == [("a", 1, 3), ("a", 5, 9), ("b", 1, 7), ("b", 9, 11), ("d", 7, 9)]


@pytest.mark.parametrize("cuts", [[99], [4, 8, 10, 99], [2, 3, 5, 6, 7, 9, 99]])
def test_store_equals_replay(spark, tmp_path, cuts):
    store = validity.IntervalStore(spark, str(tmp_path / "s"), per_day=4, buckets=2)
    low = 0
    for n, cut in enumerate(cuts):
        batch = spark.createDataFrame([h for h in HISTORY if low <= h[2] < cut], CHANGE)
        store.fold(batch, n)
        store.fold(batch, n)
        low = cut
    every = spark.createDataFrame(HISTORY, CHANGE)
    for t in range(0, 13):
        want = sorted(r.row for r in D.state_as_of(every, t).collect())
        assert sorted(r.row for r in store.as_of(t).collect()) == want, t


def test_random_histories(spark, tmp_path, rows):
    runs, data = random_case(5)
    changes = D.differential(spark.createDataFrame(runs, RUNS), spark.createDataFrame(data, ROWS)).withColumn("node_id", F.col("node_id").cast("string")).select(
        "node_id", "query_name", "execution_no", "row", "action").persist()
    store = validity.IntervalStore(spark, str(tmp_path / "s"), per_day=3, buckets=2)
    for n in range(3):
        store.fold(changes.where(F.least(F.lit(2), F.floor(F.col("execution_no") / 4)) == n), n)
    for t in (1, 4, 7, 11):
        assert rows(store.as_of(t)) == rows(D.state_as_of(changes, t))


def test_days_that_ended_before_are_not_read(spark, tmp_path):
    store = validity.IntervalStore(spark, str(tmp_path / "s"), "day", T.DateType(), buckets=1)
    day = lambda n: dt.date(2024, 1, n)
    dated = [("n", "q", day(h[2]), h[3], h[4]) for h in HISTORY]
    store.fold(spark.createDataFrame(dated, CHANGE.replace("execution_no bigint", "day date")), 0)
    out = store.as_of(day(8))
    assert sorted(r.row for r in out.collect()) == ["a", "d"]
    files = [f for f in out.inputFiles() if "/closed/" in f]
    assert files and all(f.split("day=")[1][:10] >= "2024-01-08" for f in files) or "PartitionFilters: [" in out._jdf.queryExecution().executedPlan().toString()
    assert "day" in out._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_running_counts(spark, tmp_path):
    rnd = random.Random(2)
    schema = "node_id string, event_type string, ts timestamp_ntz"
    data = [(rnd.choice("ab"), "e", dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(rnd.triangular(0, 240, 200)))) for _ in range(600)]
    data += [("a", "e", dt.datetime(2024, 1, 10, 5))] * 200
    held = baseline.RunningBaseline(spark, str(tmp_path / "b"), "6 hours", buckets=2)
    for n in range(4):
        for _ in range(1 + n % 2):
            held.fold(spark.createDataFrame(data[n::4], schema), n)
    want = rates.frequency_anomalies(spark.createDataFrame(data, schema), "6 hours")
    assert sorted(map(tuple, held.anomalies().collect())) == sorted(map(tuple, want.collect())) and want.count()
    held.forget(dt.datetime(2024, 1, 8))
    assert held.counts.read().where("window_start < timestamp '2024-01-08'").count() == 0 and held.counts.read().count()
